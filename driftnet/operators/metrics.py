"""Counters, gauges, histograms and rates over the pipeline's samples."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_gauge(metrics: DataFrame, *keys: str) -> DataFrame:
    """The latest non-null value of each gauge; a tie goes to the greatest value."""
    live = metrics.where(F.col("value").isNotNull() & F.col("ts").isNotNull())
    return live.groupBy(*keys).agg(F.max(F.struct("ts", "value")).alias("__l")).select(*keys, F.col("__l.value").alias("value"))


def log2_bucket(size: Column) -> Column:
    """Upper bound (exclusive) of the power-of-two bucket of a size; 0 for no size."""
    return F.when(size > 0, F.pow(F.lit(2), F.length(F.bin(size))).cast("long")).otherwise(F.lit(0).cast("long"))


#: Least pressure, batch and sleep in ms of each tier; a bound belongs to the stricter one.
TIERS = ((0.95, 0, 1000), (0.8, 20, 500), (float("-inf"), 200, 10))


def batch_of(pressure: float) -> int:
    """The batch of the tier of a pressure."""
    return next(batch for least, batch, _ in TIERS if pressure >= least)


def pressure_tier(pressure: Column) -> Column:
    """(batch, sleep_ms) by queue pressure; null for null."""
    out = None
    for least, batch, sleep in TIERS:
        tier = F.struct(F.lit(batch).alias("batch"), F.lit(sleep).alias("sleep_ms"))
        out = F.when(pressure >= least, tier) if out is None else out.when(pressure >= least, tier)
    return out


def drop_rate(received: Column, dropped: Column) -> Column:
    return F.when(received > 0, dropped / received * F.lit(100.0)).otherwise(F.lit(0.0))


def severity(pressure_percent: Column) -> Column:
    return F.when(pressure_percent > 80, "warn").otherwise("info")


def running_total(df: DataFrame, delta: str, block: Column, *order: str, name: str = "running") -> DataFrame:
    """df with the running sum of delta in order. Rows are summed by block (an
    increasing function of the order), only block totals are accumulated in one
    place, and the rest is a window per block: no task sees all rows."""
    blocked = df.withColumn("__b", block)
    before = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocked.groupBy("__b").agg(F.sum(delta).alias("__s")).select("__b", F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy("__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return blocked.join(starts, "__b").withColumn(name, F.col("__start") + F.sum(delta).over(inside)).drop("__b", "__start")


def admission_ticks(arrivals: DataFrame, key: str, tick: str, capacity: int, drain: int) -> DataFrame:
    """(key, tick, received, dropped, depth) after each tick of a bounded queue per key that takes
    ``drain`` items per tick and drops the newest that do not fit; received and dropped
    are totals since the beginning. arrivals has one row per key and tick with ``n``: a
    summary (a row a minute, whatever the load), folded in order of ticks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: dict[str, tuple[int, int, int, int]] = {}  # depth, last tick, received, dropped
        for pdf in batches:
            out = []
            for k, t, n in zip(pdf["k"], pdf["t"].tolist(), pdf["n"].tolist()):
                depth, last, received, dropped = state.get(k, (0, t, 0, 0))
                depth = max(0, depth - drain * (t - last))
                fits = min(n, capacity - depth)
                state[k] = depth + fits, t, received + n, dropped + n - fits
                out.append((k, t, received + n, dropped + n - fits, depth + fits))
            yield pd.DataFrame(out, columns=["k", "t", "received", "dropped", "depth"])

    rows = arrivals.select(F.col(key).alias("k"), F.col(tick).cast("long").alias("t"), F.col("n").cast("long").alias("n"))
    folded = rows.repartition("k").sortWithinPartitions("k", "t").mapInPandas(run, "k string, t long, received long, dropped long, depth long")
    return folded.withColumnsRenamed({"k": key, "t": tick})


def admission(arrivals: DataFrame, key: str, tick: str, capacity: int, drain: int) -> DataFrame:
    """(key, received, dropped, dispatched) in the end: what admission_ticks gives last."""
    last = F.max(F.struct(tick, "received", "dropped")).alias("__l")
    end = admission_ticks(arrivals, key, tick, capacity, drain).groupBy(key).agg(last)
    return end.select(key, "__l.received", "__l.dropped", (F.col("__l.received") - F.col("__l.dropped")).alias("dispatched"))
