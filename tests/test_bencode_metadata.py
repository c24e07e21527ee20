"""Wire format, records, sizes and metrics."""

from __future__ import annotations

import hashlib

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from driftnet.functions import bencode
from driftnet.operators import metadata, metrics

VALUES = st.recursive(st.integers() | st.binary(max_size=20), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.binary(max_size=5), x, max_size=4), max_leaves=20)


@given(VALUES)
def test_round_trip(value):
    assert bencode.decode(bencode.encode(value)) == value


@pytest.mark.parametrize("raw", [b"", b"i12", b"ie", b"i1-2e", b"5:abc", b"d1:ae", b"di1ei2ee", b"le1:x", b"e", b"x", b"l" * 50])
def test_what_does_not_decode(raw):
    with pytest.raises(ValueError):
        bencode.decode(raw)


def test_deep_lists():
    assert bencode.encode(bencode.decode(b"l" * 20000 + b"e" * 20000)) == b"l" * 20000 + b"e" * 20000


def test_messages(spark):
    ok = bencode.encode({"t": b"aa", "y": "q", "q": "announce_peer", "a": {"id": b"i" * 20, "port": 65535, "implied_port": 1, "more": [1]}, "v": b"x"})
    rows = [(ok,), (b"d1:y1:qe",), (b"d1:t2:aa1:y1:ee",), (bencode.encode({"t": "a", "y": "q", "a": {"port": 65536}}),), (bencode.encode({"t": "a", "y": "q", "a": {"implied_port": 256}}),), (b"", ), (None,)]
    got = spark.createDataFrame(rows, "b binary").select(bencode.decode_message("b").alias("m")).select("m.ok", "m.value.y", "m.value.a.port").collect()
    assert [r["ok"] for r in got] == [True, False, True, False, False, False, False]
    assert (got[0]["y"], got[0]["port"], got[2]["y"]) == ("q", 65535, "e")


def test_info_dictionaries():
    read = lambda v: bencode.read_info(bencode.encode(v))
    many = read({"name": "n", "files": [{"length": 3, "path": ["a", 7, "b"]}, {"path": ["c"]}, {"length": 4}], "length": 99})
    assert many == {"name": "n", "piece_length": 0, "total_size": 7, "files": [{"path": "a/b", "size": 3}, {"path": "", "size": 4}]}
    assert read({"files": [], "length": 5}) is None
    assert read({"length": 5}) == {"name": "Unknown", "piece_length": 0, "total_size": 5, "files": [{"path": "Unknown", "size": 5}]}
    assert read({"length": 0}) is read({"length": -5}) is read([1]) is None


def test_sizes(spark):
    sizes = {0: "0.00 B", 512: "512.00 B", 1024: "1.00 KB", 1152: "1.12 KB", 1 << 50: "1024.00 TB", (1 << 30) - 1: "1024.00 MB"}
    got = spark.createDataFrame([(s,) for s in sizes] + [(None,)], "s long").select("s", metadata.human_size(F.col("s")).alias("t")).collect()
    assert {r["s"]: r["t"] for r in got} == {**sizes, None: None}


def test_pieces(spark):
    rows = [("h", 0, b"zz", 1), ("h", 0, b"a", 2), ("h", 1, b"bc", 3), ("gap", 1, b"x", 1)]
    last = metadata.last_piece(spark.createDataFrame(rows, "k string, piece int, data binary, arrival long"), "k", "piece")
    got = {r["k"]: r for r in metadata.reassembled(last, "k").collect()}
    assert hashlib.sha1(got["h"]["data"]).hexdigest() == "a9993e364706816aba3e25717850c26c9cd0d89d" and got["h"]["complete"] and not got["gap"]["complete"]
    n = spark.createDataFrame([(0,), (-1,), (1,), (16384,), (16385,), (None,)], "s long").select(F.size(metadata.requested_pieces(F.col("s"))).alias("n")).collect()
    assert [r["n"] for r in n] == [0, 0, 1, 1, 2, 0]


def test_outcomes(spark):
    rows = [(False, 1, True, True, 1), (True, 10485761, True, True, 1), (True, 10485760, False, True, 1), (True, 1, True, False, 1), (True, 1, True, True, 0), (True, 1, True, True, 9)]
    df = spark.createDataFrame(rows, "c boolean, s long, p boolean, d boolean, t long")
    got = [r["x"] for r in df.select(metadata.fetch_outcome(*map(F.col, "cspdt")).alias("x")).collect()]
    assert got == [["connect_failed"], ["size_limit", "timeout"], ["timeout"], ["sha1_mismatch", "timeout"], ["parse_error"], ["success"]]


def test_assemble(spark):
    a = spark.createDataFrame([("h", "::1", 5), ("h", "1.1.1.1", 6), ("miss", "1.1.1.1", 7)], "info_hash string, peer_ip string, peer_port int").withColumn("discovered_at", F.timestamp_seconds(F.lit(9)))
    r = spark.createDataFrame([("h", None, [("a", 3), (None, 4), ("c", None)], None)], "info_hash string, name string, files array<struct<path:string,size:long>>, piece_length long")
    got = sorted(metadata.assemble(a, r).collect(), key=lambda x: x["peers"])
    assert [x["peers"] for x in got] == [["1.1.1.1:6"], ["[::1]:5"]]
    assert (got[0]["name"], got[0]["total_size"], len(got[0]["files"]), got[0]["piece_length"], got[0]["timestamp"]) == ("Unknown", 7, 2, 0, 9)


def test_rates_and_tiers(spark):
    df = spark.createDataFrame([(0.79, 0, 0), (0.8, 200, 3), (0.95, 1, 1)], "p double, r long, d long")
    got = df.select(metrics.pressure_tier(F.col("p")).alias("t"), metrics.drop_rate(F.col("r"), F.col("d")).alias("x")).collect()
    assert [tuple(r["t"]) for r in got] == [(200, 10), (20, 500), (0, 1000)] and [r["x"] for r in got] == [0.0, 1.5, 100.0]
    sizes = spark.createDataFrame([(0,), (1,), (2,), (1023,), (1024,), (None,)], "s long").select(metrics.log2_bucket(F.col("s")).alias("b")).collect()
    assert [r["b"] for r in sizes] == [0, 2, 4, 1024, 2048, 0]
