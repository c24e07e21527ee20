"""Messages on the wire: their samples of the metric series, and what they are answered with.

Null columns of a message count as missing. Each message is one row; no step needs a
shuffle before the samples are summed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftnet.functions.bencode import decode_message
from driftnet.operators.gate import discover, message_label, packet_status, query_label
from driftnet.operators.nodes import V4_BYTES, V6_BYTES, neighbour_id

SAMPLES = "array<struct<metric:string,label_key:string,label_value:string,value:long>>"


def sample(metric: str, key: str | None = None, label: Column | None = None, value: Column | None = None, when: Column | None = None) -> Column:
    """An array of one sample, empty where ``when`` does not hold."""
    one = F.array(F.struct(
        F.lit(metric).alias("metric"), F.lit(key).cast("string").alias("label_key"),
        (F.lit(None) if label is None else label).cast("string").alias("label_value"), (F.lit(1) if value is None else value).cast("long").alias("value"),
    ))
    return (one if when is None else F.when(when, one).otherwise(F.array())).cast(SAMPLES)


def totals(samples: DataFrame) -> DataFrame:
    """(metric, label_key, label_value, value) summed over rows with an array ``samples``."""
    return samples.select(F.inline("samples")).groupBy("metric", "label_key", "label_value").agg(F.sum("value").alias("value"))


def received(packets: DataFrame, secret: str, allowed: Column | None = None, queue_full: Column | None = None) -> DataFrame:
    """packets (data, source_ip, source_port) with status, the decoded message ``m``, the
    columns of gate.discover and ``samples``. Only packets that pass the gates are decoded;
    queue_full marks those that no worker took. allowed is a test of the column info_hash."""
    status = packet_status(F.col("data"))
    full = F.lit(False) if queue_full is None else F.coalesce(queue_full, F.lit(False))
    gated = packets.withColumn("status", F.when((status == "ok") & full, "queue_full").otherwise(status))
    read = gated.withColumn("m", decode_message(F.when(F.col("status") == "ok", F.col("data"))))
    a, q = F.col("m.value.a"), F.col("m.value.q")
    flat = read.select(
        "*", F.col("m.value.y").alias("y"), q.alias("q"), a.isNotNull().alias("has_args"), F.lower(F.hex(a["token"])).alias("token"),
        F.lower(F.hex(a["info_hash"])).alias("info_hash"), a["implied_port"].alias("implied"), a["port"].alias("port"),
    )
    done = discover(flat, secret, allowed)
    parsed = (F.col("status") == "ok") & F.coalesce(F.col("m.ok"), F.lit(False))
    asked = parsed & (F.col("y") == "q") & F.col("has_args") & F.col("q").isNotNull()
    nodes, nodes6 = (F.octet_length(F.col(f"m.value.r.{c}")) for c in ("nodes", "nodes6"))
    answer = parsed & (F.col("y") == "r")
    outcome = F.col("outcome")
    samples = [
        sample("dht_udp_bytes_received_total", value=F.coalesce(F.octet_length("data"), F.lit(0))),
        sample("dht_udp_packets_received_total", "status", F.col("status")),
        sample("dht_messages_parse_error_total", when=(F.col("status") == "ok") & ~parsed),
        sample("dht_messages_processed_total", "type", message_label(F.col("y")), when=parsed),
        sample("dht_queries_total", "q", query_label(F.col("q")), when=asked),
        sample("dht_announce_peer_blocked_total", "reason", outcome, when=asked & outcome.isin("invalid_token", "filtered")),
        sample("dht_info_hashes_discovered_total", when=asked & outcome.isin("no_port", "discovered")),  # before the test of the port
        sample("dht_nodes_discovered_total", "ip_version", F.lit("v4"), nodes / V4_BYTES, answer & (nodes > 0) & (nodes % V4_BYTES == 0)),
        sample("dht_nodes_discovered_total", "ip_version", F.lit("v6"), nodes6 / V6_BYTES, answer & (nodes6 > 0) & (nodes6 % V6_BYTES == 0)),
    ]
    return done.withColumn("samples", F.concat(*samples))


def bytes_field(key: str, value: Column) -> Column:
    """A key and its byte string, as they stand in a dictionary; empty for null."""
    written = F.concat(F.lit(f"{len(key)}:{key}".encode()), F.octet_length(value).cast("string").cast("binary"), F.lit(b":"), value)
    return F.when(value.isNotNull(), written).otherwise(F.lit(b""))


def response(transaction: Column, reference: Column, own_id: Column, token: Column, nodes: Column, nodes6: Column) -> Column:
    """The bencoded answer to a query: an id near the reference (the own one without it),
    the token, and node records of the requester's family; null or empty ones are left out."""
    near = F.when(reference.isNotNull(), neighbour_id(reference, own_id)).otherwise(own_id)
    some = [F.when(F.octet_length(n) > 0, n) for n in (nodes, nodes6)]
    body = F.concat(F.lit(b"d"), bytes_field("id", near), bytes_field("nodes", some[0]), bytes_field("nodes6", some[1]), bytes_field("token", token), F.lit(b"e"))
    return F.concat(F.lit(b"d1:r"), body, bytes_field("t", transaction), F.lit(b"1:y1:re"))


def sent(answers: DataFrame, data: str, kind: str) -> DataFrame:
    """answers with the samples of sending column ``data``."""
    there = F.col(data).isNotNull()
    return answers.withColumn("samples", F.concat(
        sample("dht_udp_bytes_sent_total", value=F.octet_length(data), when=there), sample("dht_udp_packets_sent_total", "type", F.lit(kind), when=there)
    ))
