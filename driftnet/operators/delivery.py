"""Exactly one copy of each message that was delivered at least once.

Method: exact quotient hash tables. A fixed-width identifier is permuted by a
bijection; its leading bits (the quotient) choose a shard, and all remaining
bits (the remainder) are stored in full, so that two identifiers meet only if
they are equal; there is no false match. An identifier is inserted once.

Inserting goes in two steps, so that full rows move once and no group of copies
meets in one task. Before the shuffle each task inserts the rows of bounded pieces
of PIECE_ROWS rows into a table of its own: of a message that is delivered a billion
times one row per piece is left, the others are surplus there and then. Then the
rows move to the shards of their quotients, where sorted remainders are inserted
one after the other.

A table that lasts is kept in the shared folder (QuotientStore): shards in folders, one
part per batch. A later batch is first reduced in itself, and then inserted by comparing
its remainders with the stored ones shard by shard.

Defined results
- a row whose identifier has a null part names no message: it is neither kept
  as a duplicate nor reported as surplus (``keep_one`` passes it through);
- the kept delivery has the earliest arrival, then the smallest delivery number;
  a null arrival or delivery number sorts last;
- rows equal in message, arrival and delivery number are one delivery: ``keep_one``
  keeps one of them, and neither is surplus;
- an empty table gives an empty result; extra columns are carried along, those
  called like the operator's own (with two leading underscores) are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftnet.functions.identity import once
from driftnet.session import cut_lineage

#: Bits of the permuted head; its highest QUOTIENT_BITS choose the shard.
HEAD_BITS = 60
QUOTIENT_BITS = 20
#: Rows that a task inserts before the shuffle at a time.
PIECE_ROWS = 200_000
#: Folders of a stored table.
STORED_SHARDS = 64
_KEY = ["__quotient", "__rem_head", "__rem_tail"]
_OWN = ["__id", "__order", "__first", "__arrival", "__number", "__state", *_KEY]
#: States of a row before it is inserted: it may be kept, it is surplus, it names no message.
LIVE, SURPLUS, NAMELESS = 0, 1, 2


def identifier_columns(hex_id: Column) -> list[Column]:
    """Quotient and complete remainder of a hex identifier of at least 16 digits.

    The permutation is one Feistel step: the 60 leading bits are xored with a
    hash of the rest, which is kept, so the step can be undone."""
    head = F.conv(F.substring(hex_id, 1, 15), 16, 10).cast("long")
    rest = F.substring(hex_id, F.lit(16), F.length(hex_id))
    tail = F.when(F.length(rest) % 2 == 0, F.concat(F.lit(b"\x00"), F.unhex(rest))).otherwise(F.concat(F.lit(b"\x01"), F.unhex(F.concat(F.lit("0"), rest))))
    mixed = head.bitwiseXOR(F.xxhash64(tail).bitwiseAND(F.lit((1 << HEAD_BITS) - 1)))
    low_bits = HEAD_BITS - QUOTIENT_BITS
    return [
        F.shiftright(mixed, low_bits).cast("int").alias("__quotient"),
        mixed.bitwiseAND(F.lit((1 << low_bits) - 1)).alias("__rem_head"),
        tail.alias("__rem_tail"),
    ]


def hex_of_long(c: Column) -> Column:
    """16 hex digits of a bigint."""
    return F.lpad(F.lower(F.hex(c)), 16, "0")


def _keyed(df: DataFrame, hex_id: Column, received_at: Column, delivery_id: Column) -> DataFrame:
    last = F.lit((1 << 63) - 1)
    bare = df.drop("__made", *_OWN)
    identified = once(bare, __id=hex_id, __arrival=F.coalesce(F.unix_micros(received_at), last), __number=F.coalesce(delivery_id.cast("long"), last))
    return identified.select(*bare.columns, "__arrival", "__number", F.when(F.col("__id").isNull(), NAMELESS).otherwise(LIVE).alias("__state"), *identifier_columns(F.col("__id")))


def _insert_piece(piece: pa.Table) -> pa.Table:
    """A piece in which only the first row of each message is live; of rows that are the same
    delivery all but one are left out."""
    quotient, head, arrival, number, state = (
        piece[c].combine_chunks().fill_null(0).to_numpy(zero_copy_only=False) for c in ("__quotient", "__rem_head", "__arrival", "__number", "__state")
    )
    tail = pc.rank(piece["__rem_tail"].combine_chunks(), tiebreaker="dense").to_numpy().astype(np.int64)
    order = np.lexsort((number, arrival, tail, head, quotient))
    q, h, t, a, n = (x[order] for x in (quotient, head, tail, arrival, number))
    live = state[order] == LIVE
    seen = np.zeros(len(order), bool)
    seen[1:] = (q[1:] == q[:-1]) & (h[1:] == h[:-1]) & (t[1:] == t[:-1]) & live[1:] & live[:-1]
    first = np.maximum.accumulate(np.where(seen, 0, np.arange(len(order))))  # of each row's message
    again = seen & (a == a[first]) & (n == n[first])  # the kept delivery itself
    state = state.copy()
    state[order[seen]] = SURPLUS
    left = np.ones(len(order), bool)
    left[order[again]] = False
    piece = piece.set_column(piece.schema.get_field_index("__state"), piece.schema.field("__state"), pa.array(state.astype(np.int32)))
    return piece.filter(pa.array(left))


def _inserted_before(keyed: DataFrame) -> DataFrame:
    """keyed after the first step; surplus rows are spread by their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= PIECE_ROWS:
                yield from _insert_piece(pa.Table.from_batches(held)).to_batches()
                held, rows = [], 0
        if held:
            yield from _insert_piece(pa.Table.from_batches(held)).to_batches()

    settled = F.col("__state") != LIVE
    spread = F.xxhash64("__number", "__arrival").bitwiseAND(F.lit((1 << QUOTIENT_BITS) - 1)).cast("int")
    return keyed.mapInArrow(run, keyed.schema).select(
        *[c for c in keyed.columns if c not in _KEY],
        F.when(settled, spread).otherwise(F.col("__quotient")).alias("__quotient"),
        # without it the rows of one quotient that are settled stay apart
        F.when(settled, F.col("__number")).otherwise(F.col("__rem_head")).alias("__rem_head"), F.when(~settled, F.col("__rem_tail")).alias("__rem_tail"),
    )


def _inserted(keyed: DataFrame) -> DataFrame:
    """keyed with ``__state`` of each delivery."""
    shard = Window.partitionBy(*_KEY)
    order = shard.orderBy("__arrival", "__number").rowsBetween(Window.unboundedPreceding, 0)
    first = F.first(F.struct("__arrival", "__number")).over(order)
    place = F.row_number().over(shard.orderBy("__arrival", "__number"))
    ranked = _inserted_before(keyed).repartition("__quotient").select("*", place.alias("__order"), (first == F.struct("__arrival", "__number")).alias("__first"))
    late = (F.col("__state") == LIVE) & (F.col("__order") > 1)
    return ranked.where(~(late & F.col("__first"))).withColumn("__state", F.when(late, SURPLUS).otherwise(F.col("__state")))


def surplus_deliveries(df: DataFrame, hex_id: Column, received_at: Column, delivery_id: Column) -> DataFrame:
    """Rows of df that repeat a message already kept, with df's columns."""
    keyed = _keyed(df, hex_id, received_at, delivery_id).where(F.col("__state") == LIVE)
    return _inserted(keyed).where(F.col("__state") == SURPLUS).drop(*_OWN)


def keep_one(df: DataFrame, hex_id: Column, received_at: Column, delivery_id: Column) -> DataFrame:
    """One row per message (its first delivery), and the rows without identifier."""
    keyed = _keyed(df, hex_id, received_at, delivery_id)
    return _inserted(keyed).where(F.col("__state") != SURPLUS).drop(*_OWN)


class QuotientStore:
    """A table of identifiers that lasts across batches, in a folder that all executors see.

    Stored are quotients and complete remainders, in STORED_SHARDS folders by quotient
    and a part per batch. A batch that is inserted again (after a failure) replaces its
    own part and sees the parts before it only, so its result is the same."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _stored(self, before: int) -> DataFrame | None:
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return None
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        parts = [n for n in names if n.startswith("batch=") and int(n[6:]) < before and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))]
        if not parts:
            return None
        schema = "__quotient int, __rem_head long, __rem_tail binary, shard int"
        return self.spark.read.schema(schema).option("basePath", self.path).parquet(*[f"{self.path}/{n}" for n in sorted(parts)])

    def insert(self, df: DataFrame, batch: int, hex_id: Column, received_at: Column, delivery_id: Column) -> DataFrame:
        """The rows of a batch whose message no batch before it had, one of each, and those
        without identifier. Batches are numbered in the order of their arrival."""
        keyed = _keyed(df, hex_id, received_at, delivery_id)
        kept = _inserted(keyed).where(F.col("__state") != SURPLUS)
        stored = self._stored(batch)
        if stored is not None:
            kept = kept.join(stored.select(*_KEY), _KEY, "left_anti")
        kept = cut_lineage(kept)
        shard = F.shiftright("__quotient", QUOTIENT_BITS - (STORED_SHARDS - 1).bit_length()).alias("shard")
        fresh = kept.where(F.col("__state") == LIVE).select(*_KEY, shard)
        fresh.repartition("shard").write.mode("overwrite").partitionBy("shard").parquet(f"{self.path}/batch={batch}")
        return kept.drop(*_OWN)
