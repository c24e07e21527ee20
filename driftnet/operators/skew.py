"""Per-key results and joins when a few keys hold most rows.

Method: value-frequency compression. Rows are first grouped by key *and* value;
that shuffle is balanced however hot a key is, and a value met a billion times
becomes one row with a weight. The results per key are then exact functions of
weighted values: distinct counts are counts of compressed rows, a mode is the
heaviest value, a percentile is found by radix refinement of the weights. No
step gathers the rows of one key in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftnet.session import cut_lineage

#: A side of at most this many bytes (as JSON) is broadcast.
BROADCAST_BYTES = 32 << 20
#: A key with at least this share of all rows is hot; there are at most 1/HOT_SHARE of them.
HOT_SHARE = 1 / 2048
#: The parts into which the rows of a hot key are split.
SALTS = 64
#: Bits of a bigint that one round of refinement settles.
DIGIT_BITS = 12


def compress(df: DataFrame, key: str, value: str, *extra: Column) -> DataFrame:
    """(key, value, weight, extra aggregates): one row per distinct pair. Null
    values keep a row of their own, null keys are dropped."""
    return df.where(F.col(key).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("weight"), *extra)


def compress_all(df: DataFrame, key: str, texts: Sequence[str], numbers: Sequence[str], *extra: Column) -> DataFrame:
    """The compressed rows of several values of a key from one scan and one
    shuffle: (key, field, text, number, weight, extra aggregates). The values of
    a field named in texts stand in text, those of numbers in number; extra
    aggregates are over all rows of the pair, see ``field``."""
    made = [F.struct(F.lit(n).alias("field"), F.col(n).alias("text"), F.lit(None).cast("long").alias("number")) for n in texts]
    made += [F.struct(F.lit(n).alias("field"), F.lit(None).cast(df.schema[texts[0]].dataType if texts else "string").alias("text"), F.col(n).cast("long").alias("number")) for n in numbers]
    rest = [c for c in df.columns if c not in (*texts, *numbers)]
    rows = df.where(F.col(key).isNotNull()).select(*rest, F.inline(F.array(*made)))
    return rows.groupBy(key, "field", "text", "number").agg(F.count(F.lit(1)).alias("weight"), *extra)


def weighted_distinct(compressed: DataFrame, key: str, value: str, name: str, *extra: Column) -> DataFrame:
    """Exact count of distinct non-null values per key."""
    return compressed.groupBy(key).agg(F.count(value).cast("long").alias(name), *extra)


def _heaviest(value: str) -> Column:
    """Sorts first for the heaviest non-null value; a tie goes to the smallest."""
    return F.when(F.col(value).isNotNull(), F.struct((-F.col("weight")).alias("w"), F.col(value).alias("v")))


def weighted_mode(compressed: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """The heaviest non-null value per key; a tie goes to the smallest value.
    A key with nulls only gives null."""
    return compressed.groupBy(key).agg(F.min(_heaviest(value)).alias("__m")).select(key, F.col("__m.v").alias(name))


def _shifts(low: int, high: int) -> list[int]:
    """The shifts of the rounds for values between two bounds: at the first one
    there are at most 2**DIGIT_BITS digits, each next one settles DIGIT_BITS more."""
    bits = 0
    while (high >> bits) - (low >> bits) >= 1 << DIGIT_BITS:
        bits += DIGIT_BITS
    return list(range(bits, -1, -DIGIT_BITS))


def weighted_percentiles(compressed: DataFrame, key: str, value: str, wanted: dict[str, float]) -> DataFrame:
    """Exact discrete percentiles of a bigint value per key: the smallest value
    whose cumulative weight reaches ceil(p * n); null if a key has no value.

    Each round sums weights by the next digit of the value, so a window holds at
    most 2**DIGIT_BITS rows, however many rows or distinct values the key has and
    wherever its values lie. compressed is read twice and once more per round.
    """
    live = compressed.where(F.col(value).isNotNull()).select(F.col(key).alias("k"), F.col(value).alias("v"), "weight")
    low, high = live.agg(F.min("v"), F.max("v")).first()
    probs = F.array(*[F.struct(F.lit(n).alias("q"), F.lit(float(p)).alias("p")) for n, p in wanted.items()])
    open_ = live.groupBy("k").agg(F.sum("weight").alias("n")).select("k", "n", F.inline(probs)).select(
        "k", "q", F.greatest(F.ceil(F.col("p") * F.col("n")), F.lit(1)).cast("long").alias("rank"), F.lit(0).cast("long").alias("prefix")
    )
    order = Window.partitionBy("k", "prefix").orderBy("digit").rowsBetween(Window.unboundedPreceding, 0)
    for i, shift in enumerate(_shifts(low or 0, high or 0)):
        up = F.lit(0).cast("long") if i == 0 else F.shiftright("digit", DIGIT_BITS)
        digits = live.groupBy("k", F.shiftright("v", shift).alias("digit")).agg(F.sum("weight").alias("w")).withColumn("prefix", up)
        upto = digits.withColumn("upto", F.sum("w").over(order))
        hit = open_.join(upto, ["k", "prefix"]).where((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("w") < F.col("rank")))
        open_ = hit.select("k", "q", (F.col("rank") - (F.col("upto") - F.col("w"))).alias("rank"), F.col("digit").alias("prefix"))
    found = open_.groupBy("k").agg(*[F.max(F.when(F.col("q") == n, F.col("prefix"))).alias(n) for n in wanted])
    return found.withColumnRenamed("k", key)


def hash_profile(announces: DataFrame) -> DataFrame:
    """Per announced hash: rows, distinct peers, first and last discovery, the
    sensor that saw it most, and median and 90th percentile of the delay from
    discovery to receipt in whole seconds. Expects canonical columns info_hash,
    peer, sensor, discovered_at, delay_s; a null hash gives no row, null values
    count as rows only, an empty table gives no rows.

    The table is scanned once: one shuffle compresses all three values of a hash,
    and the result, written to the shared folder, serves all that follows."""
    is_peer = F.col("field") == "peer"
    rows = announces.select("info_hash", "peer", "sensor", "delay_s", "discovered_at")
    compressed = cut_lineage(
        compress_all(
            rows, "info_hash", ["peer", "sensor"], ["delay_s"],
            F.min(F.when(is_peer, F.col("discovered_at"))).alias("first_at"), F.max(F.when(is_peer, F.col("discovered_at"))).alias("last_at"),
        ),
        "field",
    )
    is_peer, is_sensor = F.col("field") == "peer", F.col("field") == "sensor"
    base = compressed.where(is_peer | is_sensor).groupBy("info_hash").agg(
        F.sum(F.when(is_peer, F.col("weight"))).cast("long").alias("announces"),
        F.count(F.when(is_peer, F.col("text"))).cast("long").alias("peers"),
        F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"),
        F.min(F.when(is_sensor, _heaviest("text"))).alias("__m"),
    ).select("info_hash", "announces", "peers", "first_at", "last_at", F.col("__m.v").alias("top_sensor"))
    delays = weighted_percentiles(compressed.where(F.col("field") == "delay_s"), "info_hash", "number", {"delay_p50": 0.5, "delay_p90": 0.9})
    return base.join(delays, "info_hash", "left")


def hot_keys(df: DataFrame, key: str, share: float = HOT_SHARE) -> DataFrame:
    """(key): the keys with at least this share of all rows that have a key, at most 1/share of them."""
    counts = cut_lineage(df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("__n")))
    total = counts.agg(F.sum("__n")).first()[0] or 0
    return counts.where(F.col("__n") >= max(1.0, total * share)).select(key)


def spread_join(left: DataFrame, right: DataFrame, key: str, spread: Sequence[str]) -> DataFrame:
    """The inner join of left with right, which has a row per key, when a few keys
    hold most rows of left.

    If right is measured to be small, it is broadcast. Otherwise the rows of each
    hot key of left are split in SALTS parts by a hash of the columns ``spread``
    (which should tell rows of a key apart), and the one row of right that they
    meet is repeated for each part: no part holds more than HOT_SHARE + 1/SALTS
    of the rows. Null keys meet nothing; empty tables give none."""
    size = right.agg(F.sum(F.octet_length(F.to_json(F.struct(*right.columns))))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        return left.join(F.broadcast(right), key)
    hot = F.broadcast(hot_keys(left, key).withColumn("__hot", F.lit(True)))
    salt = F.when(F.col("__hot"), F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int")).otherwise(0)
    split = left.join(hot, key, "left").withColumn("__salt", salt).drop("__hot")
    parts = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    repeated = right.join(hot, key, "left").withColumn("__salt", F.explode(parts)).drop("__hot")
    return split.join(repeated, [key, "__salt"]).drop("__salt")
