"""Messages, fetches and the crawl, in small and by hand."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from driftnet.functions import bencode
from driftnet.operators import fetch, gate, metadata, metrics, nodes, wire
from driftnet.plans import pipeline


def packets(spark, *data):
    return spark.createDataFrame([(d, "10.0.0.1", 77) for d in data], "data binary, source_ip string, source_port int")


def series(df):
    return {(r["metric"], r["label_value"]): r["value"] for r in wire.totals(df).collect()}


def test_samples_of_odd_packets(spark):
    good = {"t": b"aa", "y": "q", "q": "announce_peer", "a": {"id": b"i" * 20, "info_hash": b"h" * 20, "port": 0, "token": hashlib.sha1(b"10.0.0.1s").digest()[:8]}}
    some = [None, b"", b"d" * 9000, b"x", b"d", b"de", bencode.encode(good), bencode.encode({**good, "q": "vote"}), bencode.encode({"t": b"a", "y": "r", "r": {"nodes": b"n" * 52, "nodes6": b"n" * 37}})]
    got = series(wire.received(packets(spark, *some), "s", queue_full=F.length("data") == 2))
    assert got["dht_udp_packets_received_total", "dropped_size"] == 1 and got["dht_udp_packets_received_total", "dropped_magic"] == 3
    assert got["dht_udp_packets_received_total", "queue_full"] == 1 and got["dht_udp_packets_received_total", "ok"] == 4
    assert got["dht_messages_parse_error_total", None] == 1 and got["dht_messages_processed_total", "q"] == 2
    assert got["dht_info_hashes_discovered_total", None] == 1  # counted before the port is tested
    assert got["dht_nodes_discovered_total", "v4"] == 2 and ("dht_nodes_discovered_total", "v6") not in got
    assert wire.received(packets(spark, *some), "s").where("outcome = 'no_port'").count() == 1
    assert series(wire.received(packets(spark), "s")) == {}


def test_response_reads_back(spark):
    c = F.lit
    ref, own = c(b"r" * 20), c(b"o" * 20)
    df = spark.range(1).select(
        wire.response(c(b"tt"), ref, own, c(b"token678"), c(b"n" * 26), c(None).cast("binary")).alias("a"), wire.response(c(b"tt"), c(None).cast("binary"), own, c(b"token678"), c(b""), c(b"m" * 38)).alias("b"),
    )
    a, b = (bencode.decode(bytes(x)) for x in df.first())
    assert a == {b"t": b"tt", b"y": b"r", b"r": {b"id": b"r" * 6 + b"o" * 14, b"nodes": b"n" * 26, b"token": b"token678"}}
    assert b[b"r"] == {b"id": b"o" * 20, b"nodes6": b"m" * 38, b"token": b"token678"}


def run_fetches(spark, cases):
    """cases: id -> (connection, extension, digest, messages without id)."""
    f = spark.createDataFrame([(i, c, e, d) for i, (c, e, d, _) in cases.items()], "fetch_id long, connection string, extension boolean, digest string")
    m = spark.createDataFrame([(i, *x) for i, (*_, ms) in cases.items() for x in ms], fetch.MESSAGES)
    return {r["fetch_id"]: r for r in fetch.fetch_stages(f, m, piece=4).collect()}


def test_every_stage_of_a_fetch(spark):
    info = bencode.encode({"name": "n", "length": 9})
    cut = [(k + 1, "data", None, None, k, info[4 * k : 4 * k + 4]) for k in range(-(-len(info) // 4))]
    sha = hashlib.sha1(info).hexdigest()
    hello = (0, "handshake", len(info), 3, None, None)
    zero = bencode.encode({"name": "n", "length": 0})
    cases = {
        1: ("success", True, sha, [hello, *cut, (0, "data", None, None, 0, b"old!")]),
        2: ("failed", None, sha, []), 3: ("timeout", True, sha, []), 4: ("success", False, sha, [hello, *cut]), 5: ("success", None, sha, []),
        6: ("success", True, sha, [(0, "handshake", 11 << 20, 3, None, None)]), 7: ("success", True, sha, [(0, "handshake", len(info), 0, None, None), *cut]),
        8: ("success", True, sha, [hello, *cut[:-1]]), 9: ("success", True, "0" * 40, [hello, *cut]),
        10: ("success", True, hashlib.sha1(zero).hexdigest(), [(0, "handshake", len(zero), 1, None, None), *[(k + 1, "data", None, None, k, zero[4 * k : 4 * k + 4]) for k in range(-(-len(zero) // 4))]]),
        11: ("success", True, sha, [(0, "handshake", None, 3, None, None), (1, "handshake", len(info), None, None, None), *cut, (9, "data", None, None, 99, b"not asked"), (9, "data", None, None, -1, b"x")]),
        12: (None, True, None, [hello]), 13: ("success", True, None, []),
    }
    got = run_fetches(spark, cases)
    assert {i: r["outcome"] for i, r in got.items()} == {
        1: "success", 2: "connect_failed", 3: "connect_timeout", 4: "no_extension_support", 5: "no_extension_support", 6: "size_limit", 7: "timeout", 8: "timeout", 9: "sha1_mismatch", 10: "parse_error",
        11: "success", 12: "connect_timeout", 13: "timeout",
    }
    assert got[1]["downloaded"] == len(info) + 4 and got[1]["info"]["total_size"] == 9
    counted = {i: sorted((s["metric"].removeprefix("dht_metadata_"), s["label_value"]) for s in r["samples"]) for i, r in got.items()}
    assert ("fetch_fail_total", "timeout") in counted[9] and ("fetch_fail_total", "sha1_mismatch") in counted[9] and ("fetch_fail_total", "timeout") not in counted[10]
    assert ("handshake_result_total", "success") in counted[10] and ("size_bytes", "16") in counted[1]
    assert run_fetches(spark, {1: ("success", True, sha, [])})[1]["outcome"] == "timeout"


def test_names_that_are_no_text():
    info = bencode.read_info(bencode.encode({"name": b"\xff\xfe", "files": [{"length": 3, "path": [b"a", b"\xff", b"b"]}]}))
    assert info == {"name": "Unknown", "piece_length": 0, "total_size": 3, "files": [{"path": "a/b", "size": 3}]}


def test_crawl_against_a_fold(spark):
    rnd = random.Random(5)
    rows = [(i, bytes([i % 256] * 20), 4, rnd.randrange(16), f"a{rnd.randrange(70)}") for i in range(90)] + [(500, b"x" * 20, 6, 0, "z")]
    replies = [(1000 + i, bytes([i % 256] * 20), 4, rnd.randrange(16), f"b{i}", rnd.randrange(90)) for i in range(60)]
    schema = "seq long, node_id binary, family int, shard int, address string"
    pressure = [0.85, 0.97, 0.1]
    got = pipeline.crawl(spark.createDataFrame(rows, schema), spark.createDataFrame(replies, schema + ", asked long"), pressure, 4, 3)
    found = {(r["turn"], r["seq"]) for r in got.collect()}
    held, want = [r for r in rows if r[2] == 4], set()
    for turn, p in enumerate(pressure):
        queues = {s: nodes.Frontier(3) for s in range(16)}
        for r in sorted(held):
            queues[r[3]].push(r[4], r)
        batch, popped = metrics.batch_of(p), []
        left = [list(queues[s].held.values()) for s in range(16)]
        for s in range(16):
            if len(popped) >= batch:
                break
            take = -(-batch // 16)
            popped, left[s] = popped + left[s][:take], left[s][take:]
        want |= {(turn, r[0]) for r in popped}
        asked = {r[0] for r in popped}
        held = [r for some in left for r in some] + [(r[0] + (turn + 1) * (1 << 40), *r[1:5]) for r in replies if r[5] in asked]
    assert found == want and len(want) > 20


def test_tiers(spark):
    for p, batch in ((0.0, 200), (0.79, 200), (0.8, 20), (0.949, 20), (0.95, 0), (2.0, 0)):
        assert metrics.batch_of(p) == batch == spark.range(1).select(metrics.pressure_tier(F.lit(p))["batch"]).first()[0]


def test_failing_user_function(spark):
    def test(text):
        if text == "bad":
            raise ValueError(text)
        return text == "yes"

    df = spark.createDataFrame([("yes",), ("no",), ("bad",), (None,)], "t string")
    assert [r[0] for r in df.select(gate.user_predicate(test)("t")).collect()] == [True, False, False, False]
    assert [r[0] for r in df.select(gate.user_predicate(test, True)("t")).collect()] == [True, False, True, False]
    with pytest.raises(Exception, match="bad"):
        df.select(gate.user_predicate(test, None)("t")).collect()


def test_severity_by_the_queue(spark):
    rows = [("k", t, n) for t, n in ((0, 9), (1, 9), (2, 1), (40, 1))]
    got = metrics.admission_ticks(spark.createDataFrame(rows, "key string, t long, n long"), "key", "t", 10, 1).orderBy("t").collect()
    assert [(r["received"], r["dropped"], r["depth"]) for r in got] == [(9, 0, 9), (18, 7, 10), (19, 7, 10), (20, 7, 1)]
    warn = spark.createDataFrame([(80.0,), (80.1,)], "p double").select(metrics.severity(F.col("p"))).collect()
    assert [r[0] for r in warn] == ["info", "warn"]


def test_pieces_in_order(spark):
    df = spark.createDataFrame([("a", 1, b"y"), ("a", 0, b"x"), ("b", 1, b"z")], "k string, piece int, data binary")
    got = {r["k"]: (bytes(r["data"]), r["n"], r["complete"]) for r in metadata.reassembled(df, "k").collect()}
    assert got == {"a": (b"xy", 2, True), "b": (b"z", 1, False)}
