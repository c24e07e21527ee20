"""Gate rules, ports, tokens, queues, batches and samples, case by case."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from driftnet.operators import gate, nodes

H = "ab" * 20


def col(spark, rows, schema, expr):
    return [r["x"] for r in spark.createDataFrame(rows, schema).select(expr.alias("x")).collect()]


def test_packet_gate(spark):
    rows = [(b"d" * 8192,), (b"d" * 8193,), (b"x" * 9000,), (b"",), (None,), (b"x",), (b"d",)]
    assert col(spark, rows, "p binary", gate.packet_status(F.col("p"))) == ["ok", "dropped_size", "dropped_size", "dropped_magic", "dropped_magic", "dropped_magic", "ok"]


def test_effective_port(spark):
    rows = [(1, 80, 5000), (0, 80, 5000), (0, None, 5000), (None, None, 5000), (None, 80, 5000)]
    assert col(spark, rows, "i int, p int, s int", gate.effective_port(F.col("i"), F.col("p"), F.col("s"))) == [5000, 80, 0, 5000, 80]


def test_labels(spark):
    assert col(spark, [("q",), ("e",), ("z",), (None,)], "y string", gate.message_label(F.col("y"))) == ["q", "e", "unknown", "unknown"]
    assert col(spark, [("ping",), ("vote",), ("get",), (None,)], "q string", gate.query_label(F.col("q"))) == ["ping", "vote", "other_or_invalid", "other_or_invalid"]


def test_discover_outcomes(spark):
    schema = "y string, q string, has_args boolean, token string, info_hash string, implied int, port int, source_ip string, source_port int"
    token = spark.range(1).select(gate.token_for(F.lit("1.1.1.1"), "s")).first()[0]
    base = ["q", "announce_peer", True, token, H, None, 80, "1.1.1.1", 5000]
    cases = {
        "discovered": {}, "not_announce": {0: "r"}, "no_args": {2: False}, "missing": {3: None}, "invalid_token": {3: token[:-2]}, "bad_hash": {4: H[:-2]},
        "no_port": {5: 0, 6: None}, "filtered": {4: "cd" * 20},
    }
    rows = [[changes.get(i, v) for i, v in enumerate(base)] for changes in cases.values()]
    got = gate.discover(spark.createDataFrame(rows, schema), "s", ~F.col("info_hash").startswith("cd"))
    assert [r["outcome"] for r in got.collect()] == list(cases)


def test_compact_round_trip(spark):
    ids = bytes(range(20))
    v4 = spark.createDataFrame([(ids + bytes([10, 0, 0, 1]) + b"\x05\xdc" + ids + bytes(6),), (ids,), (b"",), (None,)], "b binary")
    got = [(r["node_id"], r["address"], r["port"]) for r in nodes.decode_compact(v4, "b", 26).orderBy("at").collect()]
    assert got == [(ids.hex(), "0a000001", 1500), (ids.hex(), "00000000", 0)]
    six = [bytes(16), bytes.fromhex("ff02" + "0" * 27 + "1"), bytes.fromhex("20010db8" + "0" * 23 + "1")]
    v6 = spark.createDataFrame([(b"".join(ids + a + b"\x00\x07" for a in six),)], "b binary")
    assert [r["address"] for r in nodes.decode_compact(v6, "b", 38).collect()] == [six[2].hex()]


def test_shard_and_neighbour(spark):
    assert col(spark, [("0a000001", 1500)], "a string, p int", nodes.shard_of(nodes.last_octet(F.col("a")), F.col("p"))) == [13]
    rows = [(bytes(range(1, 21)), bytes(range(0xA1, 0xB5))), (b"\x01\x02", bytes(range(0xA1, 0xB5)))]
    got = col(spark, rows, "r binary, l binary", nodes.neighbour_id(F.col("r"), F.col("l")))
    assert bytes(got[0]) == rows[0][0][:6] + rows[0][1][6:] and bytes(got[1]) == rows[1][0] + rows[1][1][2:]


def test_queues_against_simulation(spark):
    for capacity, pushes, want in ((2, "abaca", "ca"), (0, "ab", "b")):
        q = nodes.Frontier(capacity)
        for p in pushes:
            q.push(p, None)
        assert "".join(q.held) == want
    rnd = random.Random(2)
    rows = [(rnd.choice([4, 6]), rnd.randrange(3), f"a{rnd.randrange(12)}", i) for i in range(400)] + [(4, 0, None, 999)]
    want = {}
    for f, s, a, i in rows:
        if a:
            want.setdefault((f, s), nodes.Frontier(5)).push(a, i)
    df = spark.createDataFrame(rows, "family int, shard int, address string, seq long").repartition(5)
    got = sorted((r["family"], r["shard"], r["position"], r["address"], r["seq"]) for r in nodes.bounded_queues(df, 5).collect())
    assert got == sorted((f, s, i, a, q) for (f, s), k in want.items() for i, (a, q) in enumerate(k.held.items()))
    assert nodes.bounded_queues(df.limit(0), 5).count() == 0


def test_batches_against_the_loop(spark):
    rnd = random.Random(8)
    rows = [(i, b"x", rnd.choice([4, 6]), rnd.randrange(16)) for i in range(700)]
    df = spark.createDataFrame(rows, "seq long, node_id binary, family int, shard int")
    for count, family in ((200, 4), (20, 4), (1, 4), (200, None), (20, None), (16, None)):
        queues = {(f, s): [r[0] for r in rows if r[2] == f and r[3] == s] for f in (4, 6) for s in range(16)}
        per, taken = -(-count // 16), []
        for s in range(16):
            for f in (4, 6) if family is None else (family,):
                if len(taken) < count:
                    taken += queues[f, s][: per // 2 if family is None else per]
        assert sorted(r["seq"] for r in nodes.pop_batch(df, count, family).collect()) == sorted(taken)
    assert nodes.pop_batch(df.limit(0), 20, None).count() == 0


def test_samples(spark):
    df = spark.createDataFrame([(i, 4 if i % 3 else 6, i % 5) for i in range(60)], "seq long, family int, shard int")
    one = nodes.sample_per_shard(df, 8, "s").collect()
    assert sorted(r["shard"] for r in one) == [0, 1, 2, 3, 4]
    assert len({r["seq"] for r in nodes.reservoir(df, 20, "s").collect()}) == 20
    both = nodes.sample_both_families(df, 8, "s").collect()
    assert sum(r["family"] == 4 for r in both) == 4 and sum(r["family"] == 6 for r in both) == 4


def test_requests_and_answers(spark):
    from driftnet.functions.bencode import decode

    ids = bytes(range(20)), bytes(range(20, 40))
    raw = col(spark, [ids], "i binary, t binary", gate.find_node_message(F.col("i"), F.col("t")))[0]
    assert decode(bytes(raw)) == {b"a": {b"id": ids[0], b"target": ids[1]}, b"q": b"find_node", b"t": b"\x00\x01", b"y": b"q"}
    rows = [("q", "ping", True), ("q", "get_peers", True), ("q", "announce_peer", True), ("q", "ping", False), ("r", "ping", True), (None, None, None), ("q", None, True)]
    got = col(spark, rows, "y string, q string, a boolean", gate.response_kind(F.col("y"), F.col("q"), F.col("a")))
    assert got == ["id_token", "id_token_nodes", "id_token", "none", "none", "none", "id_token"]
