"""Canonical hashes and addresses against the standard library."""

from __future__ import annotations

import ipaddress

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from driftnet.functions.identity import address_key, canonical_hash, with_socket_key

H = "0123456789abcdef0123456789abcdef01234567"


def expected_socket(text):
    text = (text or "").strip(" ")
    ip, _, port = text.rpartition(":")
    try:
        a = ipaddress.ip_address(ip[1:-1] if ip.startswith("[") else ip)
        p = int(port)
    except ValueError:
        return None
    if not 0 <= p <= 65535 or (a.version == 6) != ip.startswith("["):
        return None
    return f"{a.version}{a.packed.hex()}-{p:04x}"


def test_hash_forms(spark):
    rows = [(H, H), (H.upper(), H), (f"  urn:btih:{H}\t", H), (f"URN:BTIH:{H.upper()}", H), (H[:-1], None), (H + "0", None), ("z" * 40, None), ("", None), (None, None)]
    got = spark.createDataFrame(rows, "a string, b string").select(canonical_hash("a").alias("x"), "b").collect()
    assert all(r["x"] == r["b"] for r in got)


def test_socket_forms(spark):
    texts = [
        "10.0.0.1:80", " 10.0.0.1:80 ", "256.1.1.1:3", "1.2.3:4", "x", None, "", "10.0.0.1:", "10.0.0.1:70000", "10.0.0.1:0",
        "[2001:db8::1]:5", "[2001:0DB8:0:0:0:0:0:1]:5", "[::1]:1", "[::]:1", "[1::]:1", "[1:2:3:4:5:6:7:8]:9", "[1:2:3:4:5:6:7::]:9",
        "[::ffff:10.0.0.1]:9", "[1:2]:3", "[1:::2]:3", "[12345::]:1", "[:1::2]:1", "[1::2::3]:1", "2001:db8::1:80", "[10.0.0.1]:80",
    ]
    df = spark.createDataFrame([(t,) for t in texts], "a string")
    got = {r["a"]: r["k"] for r in with_socket_key(df, "a", "k").collect()}
    assert got == {t: expected_socket(t) for t in texts}


@settings(max_examples=3, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2**128 - 1), st.integers(0, 65535)), min_size=40, max_size=40))
def test_socket_matches_library(spark, draws):
    texts = []
    for n, p in draws:
        six = ipaddress.IPv6Address(n & ~(0xFFFF << 32) if p % 3 == 0 else n)
        texts += [f"[{six}]:{p}", f"[{six.exploded.upper()}]:{p}", f"{ipaddress.IPv4Address(n & 0xFFFFFFFF)}:{p}"]
    df = spark.createDataFrame([(t,) for t in texts], "a string")
    assert all(r["k"] == expected_socket(r["a"]) for r in with_socket_key(df, "a", "k").collect())


def test_address_key_agrees_with_socket_key(spark):
    ips = ["10.1.2.3", "2001:db8::7", "FE80::1:2", "1:2:3:4:5:6:7:8", "::", "nope", None]
    got = spark.createDataFrame([(x,) for x in ips], "ip string").select("ip", address_key(F.col("ip")).alias("k")).collect()
    for r in got:
        try:
            a = ipaddress.ip_address(r["ip"])
            assert r["k"] == f"{a.version}{a.packed.hex()}"
        except ValueError:
            assert r["k"] is None


def test_odd_hashes_against_the_pattern(spark):
    import re

    h = "0123456789abcdefABCDEF0123456789abcdef01"
    odd = [
        h, f" {h}", f"\t{h}\n", f"URN:btih:{h}", f" urn:btih:{h} ", f"urn:btih: {h}", f"urn:btih:urn:btih:{h}", h[:-1], h + "0", h[:-1] + "g", h[:-1] + " ", " " + h, h[:39] + "١",
        "", " ", "urn:btih:", h[:-1] + "é", h[:20] + " " + h[20:39], "x" * 5000, h[:-1] + "-", "+" + h[:-1], "0x" + h[:38],
    ]
    rule = re.compile(r"[ \t\n\x0b\f\r]*(?:urn:btih:)?([0-9a-f]{40})[ \t\n\x0b\f\r]*")
    want = [m[1] if (m := rule.fullmatch(t.lower())) else None for t in odd]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(odd)] + [(99, None)], "i int, t string")
    got = [r["h"] for r in df.orderBy("i").select(canonical_hash("t").alias("h")).collect()]
    assert got == [*want, None]
