"""From announced hashes to records: lookups, piece assembly, checks, assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftnet.operators.skew import spread_join

PIECE = 16_384
MAX_METADATA = 10 * 1024 * 1024


def latest_record(torrents: DataFrame, key: str) -> DataFrame:
    """One record per key: the latest timestamp, then the greatest delivery."""
    rest = [c for c in torrents.columns if c != key]
    best = F.max(F.struct("timestamp", "delivery_id", *[c for c in rest if c not in ("timestamp", "delivery_id")])).alias("__b")
    return torrents.where(F.col(key).isNotNull()).groupBy(key).agg(best).select(key, *[F.col(f"__b.{c}").alias(c) for c in rest])


def last_piece(pieces: DataFrame, *keys: str) -> DataFrame:
    """Of pieces with equal keys the one that arrived last (data breaks ties)."""
    return pieces.groupBy(*keys).agg(F.max(F.struct("arrival", "data")).alias("__l")).select(*keys, "__l.arrival", "__l.data")


def piece_count(size: Column) -> Column:
    """Number of pieces of a size of any greatness; 0 for no or a negative size."""
    whole = F.shiftright(size.cast("long"), PIECE.bit_length() - 1)  # exact, where a quotient of doubles is not
    return F.when(size > 0, whole + (size % PIECE > 0).cast("long")).otherwise(F.lit(0).cast("long"))


def requested_pieces(size: Column) -> Column:
    """0 .. number of pieces - 1; empty for no or a negative size. For metadata
    sizes, which end at MAX_METADATA (640 pieces); of others take piece_count."""
    return F.when(size > 0, F.sequence(F.lit(0), (F.ceil(size / PIECE) - 1).cast("int"))).otherwise(F.array().cast("array<int>"))


def reassembled(pieces: DataFrame, key: str) -> DataFrame:
    """(key, data, n, complete): the pieces of each key in order; complete means that all
    indices from 0 to the last are there. A key's pieces meet in one row: they are those of one
    block, which the caller bounds (a metadata block has at most 640)."""
    parts = F.array_sort(F.collect_list(F.struct("piece", F.hex("data").alias("data"))))
    g = pieces.groupBy(key).agg(parts.alias("parts"), F.max("piece").alias("last"))
    data = F.unhex(F.array_join(F.transform("parts", lambda x: x["data"]), ""))
    return g.select(key, data.alias("data"), F.size("parts").alias("n"), (F.size("parts") == F.col("last") + 1).alias("complete"))


def fetch_outcome(connected: Column, size: Column, complete: Column, digest_ok: Column, total: Column) -> Column:
    """All counters that one fetch raises, in order: a failure after the
    connection also counts as timeout."""
    return (
        F.when(~connected, F.array(F.lit("connect_failed")))
        .when(size > MAX_METADATA, F.array(F.lit("size_limit"), F.lit("timeout")))
        .when(~complete, F.array(F.lit("timeout")))
        .when(~digest_ok, F.array(F.lit("sha1_mismatch"), F.lit("timeout")))
        .when(F.coalesce(total, F.lit(0)) <= 0, F.array(F.lit("parse_error")))
        .otherwise(F.array(F.lit("success")))
    )


def magnet(info_hash: Column) -> Column:
    return F.concat(F.lit("magnet:?xt=urn:btih:"), info_hash)


def socket_text(ip: Column, port: Column) -> Column:
    """ip:port, with brackets around IPv6."""
    return F.when(ip.contains(":"), F.concat(F.lit("["), ip, F.lit("]:"), port.cast("string"))).otherwise(F.concat(ip, F.lit(":"), port.cast("string")))


def human_size(size: Column) -> Column:
    """Two decimals, rounded half to even, and a unit from B to TB. Of a bigint or a whole
    decimal of up to 31 digits; whole units and the rest apart, so that no digit is lost."""
    units = [(1024**power, unit) for power, unit in enumerate(["B", "KB", "MB", "GB", "TB"])]
    one, name = F.lit(units[-1][0]).cast("long"), F.lit(units[-1][1])
    for (below, _), (amount, unit) in list(zip(units[1:], units))[::-1]:
        one, name = F.when(size < below, F.lit(amount).cast("long")).otherwise(one), F.when(size < below, F.lit(unit)).otherwise(name)
    n = size.cast("decimal(31,0)")
    rest = n % one
    number = ((n - rest) / one).cast("decimal(28,0)") + F.bround(rest.cast("decimal(38,18)") / one, 2)
    return F.concat(number.cast("decimal(30,2)").cast("string"), F.lit(" "), name)


def flattened_files(files: Column) -> Column:
    """Files with a size; a missing path is an empty text."""
    return F.transform(
        F.filter(files, lambda f: f["size"].isNotNull()),
        lambda f: F.struct(F.coalesce(f["path"], F.lit("")).alias("path"), f["size"].alias("size")),
    )


def total_of(files: Column) -> Column:
    return F.aggregate(files, F.lit(0).cast("long"), lambda acc, f: acc + F.coalesce(f["size"], F.lit(0).cast("long")))


def single_file(files: Column, name: Column, size: Column) -> Column:
    """The file list; without one, a single file that is called like the record."""
    return F.when(files.isNull(), F.array(F.struct(name.alias("path"), size.alias("size")))).otherwise(files)


def assemble(announces: DataFrame, records: DataFrame, *spread: str) -> DataFrame:
    """One output record per announcement that the lookup finds; a miss makes the
    row vanish. announces: info_hash, peer_ip, peer_port, discovered_at and, if there are any,
    columns ``spread`` that tell them apart better than these; records: one row per info_hash with name, files, piece_length.

    What a record gives is worked out before the join, once per record, and a hash that
    holds a large share of the announcements is split (skew.spread_join)."""
    made = records.select("info_hash", "name", flattened_files(F.col("files")).alias("files"), "piece_length").select(
        "info_hash", magnet(F.col("info_hash")).alias("magnet_link"), F.coalesce("name", F.lit("Unknown")).alias("name"),
        total_of(F.col("files")).alias("total_size"), "files", F.coalesce("piece_length", F.lit(0)).cast("long").alias("piece_length"),
    ).where(F.col("total_size") > 0)
    met = spread_join(announces.select("info_hash", "peer_ip", "peer_port", "discovered_at", *spread), made, "info_hash", spread or ["peer_ip", "peer_port", "discovered_at"])
    peers = F.array(socket_text(F.col("peer_ip"), F.col("peer_port")))
    return met.select("info_hash", "magnet_link", "name", "total_size", "files", "piece_length", peers.alias("peers"), F.unix_timestamp("discovered_at").alias("timestamp"))
