"""Nested records against a recursive walk, and the odd shapes by hand."""

from __future__ import annotations

import json
import random

from driftnet.operators.nested import elements_of, flatten, subtype_tables, supertype_tables


def nodes(payload):
    return {(e[0], e[1], e[2]) for e in elements_of(payload)}


def brute(payload):
    try:
        root = json.loads(payload)
    except ValueError:
        return set()
    out = set()

    def held(v):
        while isinstance(v, str):
            try:
                v = json.loads(v)
            except ValueError:
                break
        return v

    def walk(value, letter, parent):
        value = held(value)
        items = [] if value is None else value if isinstance(value, list) else [value]
        for i, x in enumerate(items):
            x = held(x)
            if x is None:
                continue
            node = f"{parent}.{letter}{i}" if parent else f"{letter}{i}"
            o = x if isinstance(x, dict) else {}
            kind = {"t": "torrent", "p": "peer", "h": "have"}.get(letter) or ("dir" if "dir" in o else "file")
            out.add((node, parent, kind))
            for field, child in {"t": [("files", "f"), ("peers", "p")], "f": [("children", "f")], "p": [("have", "h")]}.get(letter, []):
                walk(o.get(field), child, node)

    root = held(root)
    if isinstance(root, dict):
        walk(root.get("torrents"), "t", "")
    return out


def random_value(rnd, depth):
    file = lambda: {"path": rnd.choice(["a", ["x", "y"], None]), "size": rnd.choice([1, "2", None])}
    def tree(d):
        kids = [rnd.choice([None, file(), tree(d - 1) if d else file()]) for _ in range(rnd.randrange(4))]
        v = rnd.choice([kids, kids, kids[0] if kids else None, json.dumps(kids), [], None])
        return {"dir": "d", "children": v} if rnd.random() < 0.8 else {"dir": "d"}

    peers = [rnd.choice(["1.2.3.4:5", "[::1]:7", None, {"ip": "1.1.1.1", "port": "9", "have": rnd.choice([{"piece_from": 0, "piece_to": 1}, [None, {}], "[]", None])}]) for _ in range(3)]
    one = {"info_hash": "h", "files": rnd.choice([[tree(depth), file()], file(), None]), "peers": rnd.choice([peers, peers[0], json.dumps(peers)])}
    return rnd.choice([{"torrents": [one, None, one]}, {"torrents": one}, {"torrents": json.dumps([one])}, {"other": 1}, [1]])


def test_random_payloads():
    rnd = random.Random(3)
    for _ in range(300):
        p = json.dumps(random_value(rnd, 4))
        assert nodes(p) == brute(p)


def test_what_does_not_parse():
    for p in (None, "", "{", '{"torrents": NaN}', "nul", '{"torrents": [}', "[" * 5000):
        assert list(elements_of(p)) == []


def test_depth_without_limit():
    deep = 30_000
    p = '{"torrents":{"files":' + '{"dir":"d","children":' * deep + '{"path":"x"}' + "}" * deep + "}}"
    n = 0
    for node, parent, kind, *_ in elements_of(p):
        assert node.startswith(parent)
        n += 1
    assert n == deep + 2


def test_numbers_of_any_length():
    p = '{"torrents": [{"total_size": ' + "9" * 5000 + ', "name": "n"}, {"total_size": 12}]}'
    rows = list(elements_of(p))
    assert [r[0] for r in rows] == ["t0", "t1"] and [r[6] for r in rows] == [None, 12]
    assert "9" * 5000 in rows[0][-1]  # kept as it was


def test_deep_value_of_an_unknown_field():
    deep = 20_000
    p = '{"torrents":{"name":"x","odd":' + '{"a":[1,' * deep + '"é"' + "]}" * deep + "}}"
    (row,) = elements_of(p)
    more = row[-1]
    assert more.replace(" ", "") == '{"odd":' + '{"a":[1,' * deep + '"é"' + "]}" * deep + "}"


def test_tables(spark):
    payload = json.dumps({"capture": {"by": "x"}, "torrents": [{"name": "n", "total_size": "7", "files": [{"path": "a", "size": 5}, {"path": "b", "md5": "z"}, "c", 3, {"dir": "d"}], "peers": ["1.2.3.4:56", {"ip": "::1", "port": 70000}]}]})
    raw = spark.createDataFrame([(1, payload, "z"), (None, payload, None), (2, None, None), (3, "x", None)], "raw_id long, payload string, node string")
    t = subtype_tables(flatten(raw))
    assert set(t) == {
        "record_object", "torrent_object_name_total_size_files_peers", "file_object_path_size", "file_object_path", "file_text", "file_scalar", "dir_object_dir", "peer_text", "peer_object_ip_odd_port"
    }
    keys = ["raw_id", "node", "parent", "kind", "variant"]
    assert t["torrent_object_name_total_size_files_peers"].columns == [*keys, "name", "size", "more"] and t["file_object_path"].columns == [*keys, "name", "more"]
    assert t["peer_object_ip_odd_port"].columns == [*keys, "ip", "more"] and t["file_scalar"].columns == [*keys, "more"]
    assert [json.loads(r["more"]) for r in t["file_object_path"].collect()] == [{"md5": "z"}] * 2
    assert {r["more"] for r in t["peer_object_ip_odd_port"].collect()} == {'{"port": 70000}'}
    s = supertype_tables(t)
    assert sorted((r["raw_id"] or 0, r["name"], r["size"]) for r in s["torrents"].collect()) == [(0, "n", 7), (1, "n", 7)]
    assert s["files"].count() == 8 and {(r["ip"], r.asDict().get("port")) for r in s["peers"].collect()} == {("1.2.3.4", 56), ("::1", None)}
    assert [json.loads(r["more"]) for r in s["records"].collect()] == [{"capture": {"by": "x"}}] * 2
    assert flatten(raw.limit(0)).count() == 0 and subtype_tables(flatten(raw.limit(0))) == {}
