"""Distinct counts within their bound, and exact frequent values."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from driftnet.llm import distinct, heavy


def one_estimate(bitmaps):
    return distinct.estimates(bitmaps, ["g"], ["f"]).select("f").first()[0]


@pytest.mark.parametrize("n", [1, 50, 3_000, 60_000, 400_000])
def test_error_bound(spark, n):
    df = spark.range(n).select(F.lit("x").alias("g"), F.concat(F.lit("peer-"), "id").alias("v"))
    got = one_estimate(distinct.partial_bitmaps(df, ["g"], {"f": "v"}))
    assert abs(got - n) <= max(1, distinct.ERROR_BOUND * n)


def test_merge_is_union(spark):
    df = spark.range(20_000).select(F.lit("x").alias("g"), F.col("id").cast("string").alias("v"))
    a = distinct.partial_bitmaps(df.where("id < 15000"), ["g"], {"f": "v"})
    b = distinct.partial_bitmaps(df.where("id >= 5000").unionByName(df.where("id < 100")), ["g"], {"f": "v"})
    merged = distinct.merge_bitmaps(a.unionByName(b), ["g"])
    assert one_estimate(merged) == one_estimate(distinct.partial_bitmaps(df, ["g"], {"f": "v"}))


def test_combinations_and_nulls(spark):
    rows = [("d1", "s1", "a"), ("d1", "s2", "a"), ("d2", None, "b"), ("d2", None, None), ("d1", "s1", "a")]
    df = spark.createDataFrame(rows, "day string, sensor string, chunk string")
    parts = distinct.partial_bitmaps(df, ["day", "sensor"], {"n": "chunk"})
    got = {(r["grouping"], r["day"], r["sensor"]): r["n"] for r in distinct.estimates(distinct.combinations(parts, ["day", "sensor"]), ["day", "sensor", "grouping"], ["n"]).collect()}
    assert got[(3, None, None)] == 2 and got[(0, "d2", None)] == 1 and got[(1, "d1", None)] == 1 and got[(2, None, None)] == 1
    assert distinct.partial_bitmaps(df.limit(0), ["day"], {"n": "chunk"}).count() == 0


def hashes(spark, counts, extra=()):
    rows = [(h,) for h, n in counts.items() for _ in range(n)] + [(x,) for x in extra]
    random.Random(2).shuffle(rows)
    return spark.createDataFrame(rows, "v string")


def test_frequent_values(spark):
    rnd = random.Random(7)
    counts = Counter({f"{rnd.getrandbits(160):040x}": 1 for _ in range(800)})
    shared = "ab" * 14
    for i in range(5):
        counts[f"{shared}{i:012x}"] = 20 + i  # a long common prefix
    counts["f" * 40] = 24
    df = hashes(spark, counts, [None] * 30)
    top = {r["value"]: r["n"] for r in heavy.top_values(df, F.col("v"), 3).collect()}
    order = counts.most_common()
    assert top == {v: n for v, n in order if n >= order[2][1]}
    share = 0.02
    got = {r["value"]: r["n"] for r in heavy.values_over_share(df, F.col("v"), share).collect()}
    assert got == {v: n for v, n in counts.items() if n >= share * df.count()}


def test_few_or_no_values(spark):
    df = hashes(spark, {"0" * 40: 2, "0" * 39 + "1": 2})
    assert heavy.top_values(df, F.col("v"), 10).count() == 2
    assert heavy.top_values(df.limit(0), F.col("v"), 10).count() == 0
    assert heavy.values_over_share(df.limit(0), F.col("v"), 0.5).count() == 0


def test_flat_values(spark, monkeypatch):
    """More values tie at the bound than are broadcast: all are returned, with exact counts."""
    rnd = random.Random(11)
    counts = Counter({f"{rnd.getrandbits(160):040x}": 2 for _ in range(3000)}) | Counter({f"{'cd' * 15}{i:010x}": 2 for i in range(300)})
    df = hashes(spark, counts)
    monkeypatch.setattr(heavy, "KEEP_MAX", 20)
    assert {r["value"]: r["n"] for r in heavy.top_values(df, F.col("v"), 10).collect()} == dict(counts)


def test_more_flat_values_than_counters_of_a_round(spark):
    df = spark.range(100_000).select(F.sha1(F.col("id").cast("string").cast("binary")).alias("v"))
    top = heavy.top_values(df, F.col("v"), 10)
    assert top.count() == 100_000 and top.where("n <> 1").count() == 0
