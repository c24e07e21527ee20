"""One metadata fetch after the other, from its exchanged messages to its outcome.

A fetch is a group of messages that is bounded by the metadata limit (640 pieces of
16 KiB) and what a peer repeats; pieces are reduced to the last copy of each before
they are put together. Defined results: a fetch without messages keeps what its
connection gave; messages of a fetch that is not listed are left out; null sizes
and ids count as missing; pieces that were not announced are not used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftnet.functions.bencode import decode_info
from driftnet.operators.metadata import MAX_METADATA, PIECE
from driftnet.operators.wire import SAMPLES, sample

#: Columns of messages: kind is ``handshake`` (size, ext_id), ``data`` (piece, data) or any other, which is ignored.
MESSAGES = "fetch_id long, seq long, kind string, size long, ext_id int, piece int, data binary"


def _last(column: str) -> Column:
    """The latest known value of a column by seq."""
    return F.max(F.when(F.col(column).isNotNull(), F.struct("seq", F.col(column).alias("v"))))["v"]


def folded(messages: DataFrame, piece: int = PIECE) -> DataFrame:
    """(fetch_id, size, ext_id, downloaded, complete, block) of each fetch: downloaded counts
    every data message, block is put together from the last copy of each announced piece."""
    talk = messages.where(F.col("kind") == "handshake").groupBy("fetch_id").agg(_last("size").alias("size"), _last("ext_id").alias("ext_id"))
    data = messages.where((F.col("kind") == "data") & F.col("data").isNotNull())
    copies = data.groupBy("fetch_id", "piece").agg(F.sum(F.octet_length("data").cast("long")).alias("bytes"), F.max(F.struct("seq", "data"))["data"].alias("data"))
    told = copies.join(talk.where((F.col("size") > 0) & (F.col("size") <= MAX_METADATA) & (F.col("ext_id") > 0)), "fetch_id", "left")
    count = F.floor((F.col("size") + piece - 1) / piece)
    used = F.when((F.col("piece") >= 0) & (F.col("piece") < count), F.struct("piece", F.hex("data").alias("data")))
    per = told.groupBy("fetch_id").agg(
        F.sum("bytes").alias("downloaded"), F.sum(F.when(F.col("size").isNotNull(), F.octet_length("data").cast("long"))).alias("held"),
        F.array_sort(F.collect_list(used)).alias("parts"), F.max(count).alias("count"), F.max("size").alias("size"),
    )
    block = F.unhex(F.array_join(F.transform("parts", lambda p: p["data"]), ""))
    complete = F.coalesce((F.col("held") >= F.col("size")) & (F.size("parts") == F.col("count")), F.lit(False))
    blocks = per.select("fetch_id", "downloaded", complete.alias("complete"), F.when(complete, block).alias("block"))
    return talk.join(blocks, "fetch_id", "full")


def fetch_stages(fetches: DataFrame, messages: DataFrame, piece: int = PIECE) -> DataFrame:
    """fetches (fetch_id, connection, extension, digest) with ``outcome``, ``info`` and ``samples``.

    connection is success, failed or timeout; extension whether the peer takes extension
    messages; digest is the SHA-1 in hex that the block must have. The outcome is the stage that
    ends a fetch: connect_failed, connect_timeout, no_extension_support, size_limit, timeout,
    sha1_mismatch, parse_error or success. A failure while messages are exchanged also counts
    as a timeout, as does waiting in vain."""
    f = fetches.join(folded(messages, piece), "fetch_id", "left")
    ready = F.coalesce((F.col("size") > 0) & (F.col("ext_id") > 0), F.lit(False))
    good = F.coalesce(F.sha1("block") == F.lower("digest"), F.lit(False))
    staged = f.withColumn("stage", F.when(F.col("connection") == "failed", "connect_failed").when(F.coalesce(F.col("connection") != "success", F.lit(True)), "connect_timeout")
        .when(~F.coalesce("extension", F.lit(False)), "no_extension_support").when(ready & (F.col("size") > MAX_METADATA), "size_limit")
        .when(~ready | ~F.coalesce("complete", F.lit(False)), "timeout").when(~good, "sha1_mismatch").otherwise("parse"))
    parsed = staged.withColumn("info", decode_info(F.when(F.col("stage") == "parse", F.col("block"))))
    outcome = F.when(F.col("stage") != "parse", F.col("stage")).when(F.coalesce(F.col("info.ok"), F.lit(False)), "success").otherwise("parse_error")
    known = parsed.withColumn("outcome", outcome)
    o = F.col("outcome")
    connected = F.when(o == "connect_failed", "failed").when(o == "connect_timeout", "timeout").otherwise("success")
    talked = ~o.isin("connect_failed", "connect_timeout", "no_extension_support")
    samples = F.concat(
        sample("dht_metadata_fetch_attempts_total"),
        sample("dht_metadata_connection_result_total", "result", connected),
        sample("dht_metadata_handshake_result_total", "result", F.lit("no_extension_support"), when=o == "no_extension_support"),
        sample("dht_metadata_handshake_result_total", "result", F.lit("success"), when=o.isin("success", "parse_error")),
        sample("dht_metadata_bytes_downloaded_total", value=F.col("downloaded"), when=talked & (F.col("downloaded") > 0) & (o != "size_limit")),
        sample("dht_metadata_fetch_fail_total", "reason", o, when=o.isin("size_limit", "sha1_mismatch", "parse_error")),
        sample("dht_metadata_fetch_fail_total", "reason", F.lit("timeout"), when=o.isin("size_limit", "sha1_mismatch", "timeout")),
        sample("dht_metadata_fetch_success_total", when=o == "success"),
        sample("dht_metadata_size_bytes", "below", F.pow(F.lit(2), F.length(F.bin("info.value.total_size"))).cast("long"), when=o == "success"),
    ).cast(SAMPLES)
    value = F.col("info.value")
    return known.select(*fetches.columns, "outcome", F.col("downloaded"), F.when(o == "success", value).alias("info"), samples.alias("samples"))
