"""Keeping one delivery of each message."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from driftnet.operators.delivery import keep_one, surplus_deliveries

SCHEMA = "hex string, received_at timestamp, delivery_id long, note string, __order int"
T0 = dt.datetime(2025, 3, 1)


def brute(rows):
    best, extra = {}, []
    key = lambda r: (r[1] or dt.datetime.max, r[2] if r[2] is not None else 1 << 63)
    for r in sorted((r for r in rows if r[0] is not None), key=key):
        if r[0] in best:
            if key(best[r[0]]) != key(r):
                extra.append(r)
        else:
            best[r[0]] = r
    return best, extra


def test_against_brute_force(spark):
    rnd = random.Random(5)
    ids = [f"{rnd.getrandbits(160):040x}" for _ in range(20)] + ["0" * 40, "f" * 40, "0" * 15 + "1" * 25]
    rows = [(rnd.choice(ids[:1] * 10 + ids), T0 + dt.timedelta(seconds=rnd.randrange(5)), i, "n", 1) for i in range(400)]
    rows += [(None, T0, 1000, None, None), (ids[0], None, 1001, None, 0), (ids[1], T0, None, "x", 0), rows[0]]
    best, extra = brute(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    args = F.col("hex"), F.col("received_at"), F.col("delivery_id")
    got = surplus_deliveries(df, *args)
    assert sorted(r["delivery_id"] or -1 for r in got.collect()) == sorted((r[2] if r[2] is not None else -1) for r in extra)
    assert got.columns == ["hex", "received_at", "delivery_id", "note"]
    kept = keep_one(df, *args).collect()
    assert sorted(r["delivery_id"] for r in kept if r["hex"]) == sorted(r[2] for r in best.values())
    assert sum(r["hex"] is None for r in kept) == 1


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert surplus_deliveries(df, F.col("hex"), F.col("received_at"), F.col("delivery_id")).count() == 0
    assert keep_one(df, F.col("hex"), F.col("received_at"), F.col("delivery_id")).count() == 0


def test_long_identifiers_that_differ_at_the_end(spark):
    """No part of an identifier is left out of the comparison, however long; an odd number of digits is no even one."""
    base = "a" * 4111
    rows = [(base + "0", T0, 1, "", 0), (base + "1", T0, 2, "", 0), (base, T0, 3, "", 0), (base[:-1], T0, 4, "", 0), ("0" + base[:-2] + "0", T0, 5, "", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert keep_one(df, F.col("hex"), F.col("received_at"), F.col("delivery_id")).count() == 5


def test_small_pieces_and_hot_message(spark, monkeypatch):
    from driftnet.operators import delivery

    monkeypatch.setattr(delivery, "PIECE_ROWS", 64)
    rnd = random.Random(8)
    ids = [f"{rnd.getrandbits(200):050x}" for _ in range(60)]
    rows = [(ids[0] if rnd.random() < 0.4 else rnd.choice(ids), T0 + dt.timedelta(microseconds=rnd.randrange(40)), i, None, None) for i in range(3000)]
    rows += [rows[3], rows[3]]  # one delivery that is read three times
    best, extra = brute(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    args = F.col("hex"), F.col("received_at"), F.col("delivery_id")
    got = {r["delivery_id"] for r in surplus_deliveries(df, *args).collect()}
    assert got == {r[2] for r in extra}
    assert sorted(r["delivery_id"] for r in keep_one(df, *args).collect()) == sorted(r[2] for r in best.values())


def test_batches(spark, tmp_path):
    """A table that lasts: copies in later batches are no new messages, and a batch may be repeated."""
    from driftnet.operators.delivery import QuotientStore

    rnd = random.Random(9)
    ids = [f"{rnd.getrandbits(160):040x}" for _ in range(50)]
    store, seen, number = QuotientStore(spark, str(tmp_path / "table")), set(), 0
    args = F.col("hex"), F.col("received_at"), F.col("delivery_id")
    for batch in range(3):
        rows = [(rnd.choice(ids[: 20 * (batch + 1)]), T0, (number := number + 1), "n", 1) for _ in range(60)] + [(None, T0, -batch, "x", 1)]
        df = spark.createDataFrame(rows, SCHEMA)
        want = sorted({r[0] for r in rows if r[0]} - seen)
        for _ in range(2 if batch == 1 else 1):
            got = store.insert(df, batch, *args)
            assert got.columns == ["hex", "received_at", "delivery_id", "note"]
            found = got.collect()
            assert sorted(r["hex"] for r in found if r["hex"]) == want and [r["delivery_id"] for r in found if not r["hex"]] == [-batch]
        seen |= set(want)
    assert store.insert(df.limit(0), 9, *args).count() == 0
