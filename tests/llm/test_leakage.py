"""Leaked passages against a brute-force search."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from driftnet.llm import leakage
from driftnet.llm.words import WordHashes, words


def brute(docs, items):
    out = set()
    for d, text in docs:
        w = words(text or "")
        grams = {tuple(w[i : i + 12]) for i in range(len(w) - 11)}
        for i, item in items:
            v = words(item or "")
            if any(tuple(v[k : k + 12]) in grams for k in range(len(v) - 11)):
                out.add((d, i))
    return out


def data():
    rnd = random.Random(4)
    vocab = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rnd.choices(vocab, k=rnd.choice([5, 12, 40])))) for i in range(25)] + [(100, None), (101, ""), (7, "again " * 30), (None, "again " * 30)]
    docs = []
    for d in range(120):
        w = rnd.choices(vocab, k=rnd.randrange(60))
        if d % 3 == 0:
            src = (rnd.choice(items)[1] or "x").split()
            n = rnd.choice([11, 12, 13, 40])
            cut = rnd.randrange(max(1, len(src) - n + 1))
            piece = re.sub("w", lambda m: rnd.choice(["W", "w​", "w"]), rnd.choice([", ", " ", "\n- "]).join(src[cut : cut + n]))
            w = [*w, piece, *rnd.choices(vocab, k=20)]
        docs.append((d, " ".join(w)))
    docs += [(500, None), (501, ""), (502, "again " * 12), (None, "again " * 12), docs[0]]
    return docs, items


def test_verbatim(spark):
    docs, items = data()
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS item_id")
    i = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "2 AS doc_id")
    got = leakage.leaked_passages(d, i, verbatim=True)
    rows = [(r["doc_id"], r["item_id"]) for r in got.collect()]
    assert set(rows) == brute(docs, [x for x in items if x[0] is not None])
    assert len(rows) == sum((a, b) in set(rows) for a, _ in docs for b in {i for i, _ in items})  # a repeated document gives its rows again
    assert leakage.leaked_passages(d.limit(0), i).count() == 0 == leakage.leaked_passages(d, i.limit(0)).count()


def test_very_long_text_and_blocks_of_items(spark, monkeypatch):
    docs, items = data()
    monkeypatch.setattr(leakage, "SLAB_WORDS", 50)
    monkeypatch.setattr(leakage, "INDEX_WINDOWS", 700)
    monkeypatch.setattr(leakage, "PIECE", 4096)
    long = " ".join((t or "") for _, t in docs)
    some = [(1, long), (2, None)]
    d, i = spark.createDataFrame(some, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in leakage.leaked_passages(d, i, verbatim=True).collect()}
    assert got == brute(some, [x for x in items if x[0] is not None])


@pytest.mark.parametrize(("piece", "blocks"), [(1 << 21, True), (1 << 17, True), (1 << 21, False)])
def test_every_pair_within_the_radius(monkeypatch, piece, blocks):
    monkeypatch.setattr(leakage, "PIECE", piece)
    rnd = np.random.default_rng(1)
    cache = WordHashes()
    index = leakage.WindowIndex(12, [(i, cache.of([f"v{x}" for x in rnd.integers(0, 500, 40)])) for i in range(30)])
    if blocks:
        monkeypatch.setattr(leakage, "BLOCKS", 0)  # the index counts as too large to be compared as a whole
    flips = []
    for p in index.prints[:300]:
        for k in rnd.permutation(64)[: leakage.RADIUS]:
            p ^= np.uint64(1) << np.uint64(k)
        flips.append(p)
    prints = np.array([*flips, *rnd.integers(0, 1 << 63, 200).astype(np.uint64)], np.uint64)
    a, b = index.pairs(prints)
    want = {(i, j) for i, p in enumerate(prints) for j, q in enumerate(index.prints) if int(p ^ q).bit_count() <= leakage.RADIUS}
    assert set(zip(a.tolist(), b.tolist())) == want and len(want) >= 300


def test_distances_of_similar_windows():
    """The figures that RADIUS was chosen by: the least similar windows that must be found."""
    rnd = np.random.default_rng(3)
    one = rnd.integers(0, 1 << 63, (40_000, 12)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    two = one.copy()
    for at in (4, 2):  # weights 5 and 3 of 40
        two[:, at] = rnd.integers(0, 1 << 63, len(two)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    assert np.allclose(leakage.similarities(one, two, 5), 0.8)
    d = np.bitwise_count(leakage.fingerprints(one) ^ leakage.fingerprints(two))
    assert (d <= leakage.RADIUS).mean() > 0.995 and 13 < d.mean() < 14


def test_a_stock_phrase_is_one_class(spark):
    index = leakage.window_indexes([(i, "again " * 400) for i in range(50)])
    assert [(x.length, len(x.words)) for x in index] == [(12, 1)]
    of, h = np.zeros(200_000, int), WordHashes().of(["again"] * 200_000)
    got = list(index[0].links(of, h, np.ones(len(h), bool), 0.8))
    assert got == [(0, i, 199_989, 199_989, 1.0) for i in range(50)]
