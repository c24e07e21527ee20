"""Registered queries give every row, checked by counting and by simulation on small tables."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest

import __spark_entry__ as entry_point
from driftnet.plans.catalogue import CATALOGUE


def stored(spark, path, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(str(path / f"{name}.parquet"))
    return str(path)


def test_pieces_of_every_size(spark, tmp_path):
    sizes = [None, -5, 0, 1, 16384, 16385, 1_999_999_999, 2_000_000_000, 5 * 10**13, (1 << 60) + 1, (1 << 63) - 1]
    sf = stored(spark, tmp_path, "torrents", list(enumerate(sizes)), "delivery_id long, total_size long")
    got = {r["delivery_id"]: r["pieces"] for r in CATALOGUE.queries["requested_pieces"](spark, sf).collect()}
    assert got == {i: -(-max(0, s or 0) // 16384) for i, s in enumerate(sizes)}


def test_text_of_every_size(spark, tmp_path):
    """Sizes whose multiples are beyond a bigint; each next to a tie of two decimals."""
    from decimal import ROUND_HALF_EVEN, Context, Decimal

    sizes = [None, -5, 0, 1, 1023, 5 * 10**11, (1 << 43) - 1, 1 << 43, (1 << 43) + 1, *[(1 << 60) + (1 << 37) + i for i in (-1, 0, 1)], (1 << 63) - 1]
    sf = stored(spark, tmp_path, "torrents", list(enumerate(sizes)), "delivery_id long, total_size long")
    got = {(r["delivery_id"], r["f"]): r["shown"] for r in CATALOGUE.queries["format_size"](spark, sf).collect()}

    def text(n):
        power = next((p for p in range(4) if n < 1024 ** (p + 1)), 4)
        return f"{(Context(prec=80).divide(Decimal(n), 1024**power)).quantize(Decimal('0.01'), ROUND_HALF_EVEN)} {['B', 'KB', 'MB', 'GB', 'TB'][power]}"

    assert got == {(i, f): text(s * f) for i, s in enumerate(sizes) if s is not None for f in (1, 1024, 1048576)}
    assert got[12, 1048576] == "8796093022208.00 TB" and got[9, 1] == "1048576.12 TB" and got[11, 1] == "1048576.13 TB"


def test_union_of_every_shard(spark, tmp_path):
    rows = [(s, f) for s in range(16) for f in (4, 6) for _ in range(s % 3 + f)]
    sf = stored(spark, tmp_path, "nodes", rows, "shard int, family int")
    got = {(r["shard"], r["family"]): r["n"] for r in CATALOGUE.queries["union_shards"](spark, sf).collect()}
    assert got == {(s, f): s % 3 + f for s in range(16) for f in (4, 6)}


def crowded(spark, tmp_path):
    """A queue that runs over and two that do not, with addresses that come again while held and after."""
    rnd = random.Random(4)
    where = [(4, 0)] * 8000 + [(6, 3)] * 8000 + [(4, 7)] * 50
    rnd.shuffle(where)
    rows = [(f"h{rnd.randrange(9000)}", 1, f, s, i) for i, (f, s) in enumerate(where)]
    late = [("h0", 1, 4, 0, 20_000 + i) if i % 2 else (f"n{i}", 1, 6, 3, 20_000 + i) for i in range(3000)]
    rows += late
    held = {}
    for ip, port, f, s, seq in rows:
        queue, known = held.setdefault((f, s), ([], set()))
        if ip not in known:
            if len(queue) == 6250:
                known.discard(queue.pop(0)[0])
            queue.append((ip, seq))
            known.add(ip)
    want = sorted((f, s, i, f"{ip}|1", q) for (f, s), (queue, _) in held.items() for i, (ip, q) in enumerate(queue))
    assert len(held[6, 3][0]) == 6250 and held[6, 3][0][0][1] > 1000  # it has dropped some
    return stored(spark, tmp_path, "nodes", rows, "ip string, port int, family int, shard int, seq long"), want


@pytest.mark.parametrize("name", ["bounded_fifo", "stream_fifo"])
def test_frontier_of_default_capacity(spark, tmp_path, name):
    sf, want = crowded(spark, tmp_path)
    assert sorted(map(tuple, entry_point.queries()[name](spark, sf).select("family", "shard", "position", "address", "seq").collect())) == want


def test_admission_of_default_capacity(spark, tmp_path):
    minute = datetime(2026, 1, 1)
    arrivals = [("a", 0, 10_050), ("a", 3, 7), ("b", 0, 40)]
    rows = [(s, minute + timedelta(minutes=t)) for s, t, n in arrivals for _ in range(n)]
    sf = stored(spark, tmp_path, "announces", rows, "sensor string, received_at timestamp")
    got = sorted(map(tuple, CATALOGUE.queries["admission_drop"](spark, sf).select("sensor", "received", "dropped", "dispatched").collect()))
    assert got == [("a", 10_057, 54, 10_003), ("b", 40, 0, 40)]
