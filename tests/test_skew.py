"""Weighted results per key against plain Python."""

from __future__ import annotations

import datetime as dt
import math
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from driftnet.operators import skew
from driftnet.operators.skew import compress, hash_profile, hot_keys, spread_join, weighted_percentiles

SCHEMA = "info_hash string, peer string, sensor string, discovered_at timestamp, delay_s long, weight int"


def test_profile_against_brute_force(spark):
    rnd = random.Random(1)
    t0 = dt.datetime(2025, 3, 1)
    rows = []
    for i in range(1500):
        h = "hot" if rnd.random() < 0.4 else rnd.choice(["a", "b", "c", None])
        rows.append((h, rnd.choice([None, "p1", "p2", f"p{i}"]), rnd.choice([None, "s1", "s2"]), rnd.choice([None, t0 + dt.timedelta(seconds=i)]), rnd.choice([None, -5, 0, 7, 1 << 30, rnd.randrange(100000)]), 9))
    rows += rows[:50] + [("nulls", None, None, None, None, None)]
    by = defaultdict(list)
    for r in rows:
        if r[0] is not None:
            by[r[0]].append(r)
    got = {r["info_hash"]: r for r in hash_profile(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert set(got) == set(by)
    for h, rs in by.items():
        g = got[h]
        assert (g["announces"], g["peers"]) == (len(rs), len({r[1] for r in rs} - {None}))
        times = [r[3] for r in rs if r[3]]
        assert (g["first_at"], g["last_at"]) == (min(times, default=None), max(times, default=None))
        sensors = Counter(r[2] for r in rs if r[2])
        assert g["top_sensor"] == (min(sensors, key=lambda s: (-sensors[s], s)) if sensors else None)
        delays = sorted(r[4] for r in rs if r[4] is not None)
        for name, p in (("delay_p50", 0.5), ("delay_p90", 0.9)):
            assert g[name] == (delays[max(1, math.ceil(p * len(delays))) - 1] if delays else None)


def test_empty(spark):
    assert hash_profile(spark.createDataFrame([], SCHEMA)).count() == 0


def test_percentile_of_one_value(spark):
    df = spark.createDataFrame([("k", 5)] * 7, "k string, v long")
    out = weighted_percentiles(compress(df, "k", "v"), "k", "v", {"lo": 0.0, "hi": 1.0}).collect()
    assert [(r["lo"], r["hi"]) for r in out] == [(5, 5)]
    assert compress(df, "k", "v").select(F.sum("weight")).first()[0] == 7


def test_percentiles_of_any_bigint(spark):
    """Values over the whole range of a bigint, close to a bound, and of one sign; ties and wide gaps."""
    rnd = random.Random(3)
    sets = {
        "wide": [rnd.randrange(-(1 << 63), 1 << 63) for _ in range(400)] + [-(1 << 63), (1 << 63) - 1],
        "high": [(1 << 62) + rnd.randrange(5000) for _ in range(300)],
        "negative": [-rnd.randrange(1, 9000) for _ in range(300)],
        "one": [7] * 50,
    }
    for name, values in sets.items():
        df = spark.createDataFrame([("k", v) for v in values], "k string, v long")
        wanted = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p99": 0.99, "p100": 1.0}
        got = weighted_percentiles(compress(df, "k", "v"), "k", "v", wanted).first()
        values.sort()
        for q, p in wanted.items():
            assert got[q] == values[max(1, math.ceil(p * len(values))) - 1], (name, q)


def test_profile_reads_its_table_once(spark, tmp_path):
    schema = "info_hash string, peer string, sensor string, discovered_at timestamp, delay_s long"
    spark.createDataFrame([("a", "p", "s", None, 1)], schema).write.parquet(str(tmp_path / "t"))
    plan = hash_profile(spark.read.parquet(str(tmp_path / "t")))._jdf.queryExecution().toString()
    assert str(tmp_path) not in plan  # what is left reads the compressed rows only


def test_spread_join(spark, monkeypatch):
    rnd = random.Random(2)
    left = [("hot" if i % 3 == 0 else f"k{rnd.randrange(40)}" if i % 7 else None, i) for i in range(3000)]
    right = [(k, f"v{k}") for k in ["hot", *(f"k{i}" for i in range(30))]]
    a, b = spark.createDataFrame(left, "k string, i long"), spark.createDataFrame(right, "k string, v string")
    want = sorted((k, i, f"v{k}") for k, i in left if k in dict(right))
    for most in (0, 1 << 20):
        monkeypatch.setattr(skew, "BROADCAST_BYTES", most)
        monkeypatch.setattr(skew, "HOT_SHARE", 0.05)
        joined = spread_join(a, b, "k", ["i"])
        assert sorted(map(tuple, joined.select("k", "i", "v").collect())) == want
    assert spread_join(a.limit(0), b, "k", ["i"]).count() == 0 == spread_join(a, b.limit(0), "k", ["i"]).count()
    assert [r["k"] for r in hot_keys(a, "k", 0.3).collect()] == ["hot"]
