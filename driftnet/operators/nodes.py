"""The node frontier: sharding, compact records, bounded queues, batches and samples."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARDS = 16
V4_BYTES, V6_BYTES = 26, 38


def shard_of(last_octet: Column, port: Column) -> Column:
    return (last_octet.bitwiseXOR(port) % SHARDS).cast("int")


def last_octet(address_hex: Column) -> Column:
    """Last byte of an address in hex digits."""
    return F.conv(F.substring(address_hex, -2, 2), 16, 10).cast("int")


def neighbour_id(remote: Column, local: Column) -> Column:
    """The first 6 bytes of the remote id and the rest of the local one; of a
    shorter remote id all its bytes. Binary in, binary out."""
    return F.concat(F.substring(remote, 1, 6), F.substring(local, F.least(F.octet_length(remote), F.lit(6)) + 1, F.lit(1 << 20)))


# -- compact node records ---------------------------------------------------


def compact_record(node_id: Column, address_hex: Column, port: Column) -> Column:
    """20 bytes id, 4 or 16 bytes address, 2 bytes port."""
    return F.concat(node_id, F.unhex(address_hex), F.unhex(F.lpad(F.hex(port), 4, "0")))


def decode_compact(df: DataFrame, blob: str, width: int) -> DataFrame:
    """One row per record of a blob: node_id (hex), address (hex), port, at. A
    blob that is null, empty or no multiple of the width gives no rows; an
    unspecified or multicast IPv6 address drops its record."""
    ok = df.where((F.octet_length(blob) > 0) & (F.octet_length(blob) % width == 0))
    rows = ok.select("*", F.explode(F.sequence(F.lit(0), (F.octet_length(blob) / width).cast("int") - 1)).alias("at"))
    piece = F.hex(F.substring(F.col(blob), (F.col("at") * width + 1).cast("int"), F.lit(width)))
    out = rows.select("*", piece.alias("__p")).select(
        "*", F.lower(F.substring("__p", 1, 40)).alias("node_id"),
        F.lower(F.substring("__p", 41, 2 * (width - 22))).alias("address"),
        F.conv(F.substring("__p", 2 * width - 3, 4), 16, 10).cast("int").alias("port"),
    )
    if width == V6_BYTES:
        out = out.where((F.col("address") != "0" * 32) & ~F.col("address").startswith("ff"))
    return out.drop("__p", blob)


# -- queues -----------------------------------------------------------------


def first_per_address(nodes: DataFrame, *address: str) -> DataFrame:
    """The earliest node of each address, by seq then id: an aggregate with
    partial results before the shuffle, so a crowded address is no hot task."""
    rest = [c for c in nodes.columns if c not in address]
    first = F.min(F.struct("seq", *[c for c in rest if c != "seq"])).alias("__f")
    return nodes.groupBy(*address).agg(first).select(*address, *[F.col(f"__f.{c}").alias(c) for c in rest])


def shard_capacity(total: int) -> int:
    """Capacity of one shard's queue; each family has ``total`` to itself."""
    return -(-total // SHARDS)


_QUEUE = pa.schema([("family", pa.int32()), ("shard", pa.int32()), ("position", pa.int32()), ("address", pa.string()), ("seq", pa.int64())])


class Frontier:
    """A bounded first-in-first-out queue that ignores addresses it holds."""

    def __init__(self, capacity: int):
        self.capacity, self.held = max(1, capacity), OrderedDict()

    def push(self, address: str, item: object) -> bool:
        if address in self.held:
            return False
        while len(self.held) >= self.capacity:
            self.held.popitem(last=False)
        self.held[address] = item
        return True


def bounded_queues(nodes: DataFrame, capacity: int, address: str = "address") -> DataFrame:
    """(family, shard, position, address, seq) left in each shard's queue after all
    pushes in order of seq.

    Whether a push enters depends on all pushes before it, so a shard is folded
    in order; it streams through with a state of at most ``capacity`` nodes and
    is never held as a whole. More shards give more parallel work. A push without
    address, shard or family is left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queues: dict[tuple[int, int], Frontier] = {}
        for batch in batches:
            for family, shard, addr, seq in zip(*(c.to_pylist() for c in batch.columns)):
                queues.setdefault((family, shard), Frontier(capacity)).push(addr, seq)
        rows = [(f, s, i, a, q) for (f, s), queue in queues.items() for i, (a, q) in enumerate(queue.held.items())]
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 5, _QUEUE)], schema=_QUEUE)

    pushes = nodes.where(F.col(address).isNotNull()).select(F.col("family").cast("int"), F.col("shard").cast("int"), F.col(address).alias("address"), "seq")
    # a place of its own for each shard of either family: by hash some would share one
    place = F.pmod(F.col("shard"), F.lit(SHARDS)) + F.when(F.col("family") == 4, 0).otherwise(SHARDS)
    ordered = pushes.where(F.col("shard").isNotNull() & F.col("family").isNotNull()).repartitionById(2 * SHARDS, place).sortWithinPartitions("family", "shard", "seq", "address")
    return ordered.mapInArrow(run, "family int, shard int, position int, address string, seq long")


def pop_batch(nodes: DataFrame, count: int, family: int | None) -> DataFrame:
    """The nodes that a batch pop of ``count`` removes. Shards are visited in
    order and each gives up to ceil(count/16); the stop test comes before a
    shard, so the batch may exceed count. With family None each shard gives up
    to half of that from either family, v4 first, so small counts give nothing."""
    per_shard = -(-count // SHARDS)
    if family is not None:
        some, take = nodes.where(F.col("family") == family), per_shard
        turn = F.col("shard")
    else:
        some, take = nodes, per_shard // 2
        turn = F.col("shard") * 2 + F.when(F.col("family") == 4, 0).otherwise(1)
    ranked = some.withColumn("turn", turn).withColumn("rank", F.row_number().over(Window.partitionBy("turn").orderBy("seq", "node_id")))
    taken = ranked.where(F.col("rank") <= take)
    before = Window.orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)  # at most 32 rows
    starts = taken.groupBy("turn").agg(F.count(F.lit(1)).alias("n")).select("turn", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return taken.join(F.broadcast(starts.where(F.col("before") < count)), "turn").drop("before", "rank", "turn")


def seeded(key: Column, seed: str) -> Column:
    """A pseudo-random text that stands for a draw, the same on each run."""
    return F.sha1(F.concat(F.lit(seed), key.cast("string")).cast("binary"))


def sample_per_shard(nodes: DataFrame, count: int, seed: str) -> DataFrame:
    """At most ``count`` nodes: one drawn node from each of the first non-empty
    shards (a sample over shards, not over nodes)."""
    if count > SHARDS:
        raise ValueError("use reservoir for more nodes than shards")
    drawn = nodes.groupBy("shard").agg(F.min(F.struct(seeded(F.col("seq"), seed).alias("draw"), *nodes.columns)).alias("n"))
    return drawn.select("n.*").drop("draw").orderBy("shard").limit(count)


def reservoir(nodes: DataFrame, count: int, seed: str) -> DataFrame:
    """``count`` nodes, each set of them equally likely over seeds."""
    return nodes.orderBy(seeded(F.col("seq"), seed), "seq").limit(count)


def sample_both_families(nodes: DataFrame, count: int, seed: str) -> DataFrame:
    """Half of count from v4 and the rest from v6, without filling up."""
    v4, v6 = nodes.where(F.col("family") == 4), nodes.where(F.col("family") == 6)
    return sample_per_shard(v4, count // 2, seed).unionByName(sample_per_shard(v6, count - count // 2, seed))
