"""Changed passages and items of any length, against plain counting."""

from __future__ import annotations

import random
from collections import Counter

from driftnet.llm import leakage
from driftnet.llm.words import words


def shingles(w, size):
    return [tuple(w[i : i + size]) for i in range(len(w) - size + 1)]


def similarity(a, b):
    """The mean over shingles of the share of words that agree, if one agrees as a whole."""
    size = min(5, len(a))
    parts = [[x == y for x, y in zip(s, t)] for s, t in zip(shingles(a, size), shingles(b, size))]
    return sum(sum(p) / size for p in parts) / len(parts) if any(map(all, parts)) else 0.0


def brute(docs, items, least):
    """(doc, item): windows, verbatim ones of 12 words and best similarity."""
    out = {}
    for d, text in docs:
        w = words(text)
        for i, item in items:
            v = words(item)
            n = min(12, len(v))
            best = [max(similarity(w[at : at + n], v[k : k + n]) for k in range(len(v) - n + 1)) for at in range(len(w) - n + 1)]
            best = [b for b in best if b >= least - 1e-12]
            if best:
                out[d, i] = (len(best), sum(b == 1 and n == 12 for b in best), round(max(best), 9))
    return out


def bag_links(docs, items, least):
    """Links by the Jaccard similarity of the shingles of windows as long as the item."""
    out = set()
    for d, text in docs:
        w = words(text)
        for i, item in items:
            v = words(item)
            size, bag = min(5, len(v)), Counter(shingles(v, min(5, len(v))))
            own = [Counter(shingles(w[at : at + len(v)], size)) for at in range(len(w) - len(v) + 1)]
            if any((o & bag).total() / (o | bag).total() >= least for o in own):
                out.add((d, i))
    return out


def planted():
    rnd = random.Random(6)
    vocab = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rnd.choices(vocab, k=k))) for i, k in enumerate([3, 5, 8, 11, 12, 13, 30, 60, 60])] + [(20, "again " * 20)]
    docs = []
    for i, text in items:
        v = text.split()
        docs.append((100 + i, " ".join([*rnd.choices(vocab, k=9), *v, *rnd.choices(vocab, k=9)])))
        docs.append((200 + i, " ".join([*v[:-1], "other", "end"])))
        docs.append((300 + i, " ".join([*v[: len(v) // 2], "changed", *v[len(v) // 2 + 1 :]])))
        docs.append((400 + i, " ".join([*v[: len(v) // 2], "inserted", *v[len(v) // 2 :]])))
    docs.append((900, "again " * 35))
    return docs, items


def test_changed_words_and_short_items(spark):
    docs, items = planted()
    want = brute(docs, items, 0.8)
    assert (102, 2) in want and (304, 4) in want and want[307, 7][2] == 1
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["windows"], r["verbatim"], round(r["similarity"], 9)) for r in leakage.leaked_passages(d, i).collect()}
    missed = {k for k in want if got.get(k) != want[k]}
    assert set(got) <= set(want) and all(got.get(k, (0,))[0] >= 0.9 * want[k][0] for k in want), missed  # the radius may cost a window
    assert bag_links(docs, items, 0.8) <= set(got)


def test_recall_of_edited_passages(spark):
    rnd = random.Random(9)
    items = [(i, " ".join(f"w{rnd.randrange(3000)}" for _ in range(rnd.randrange(12, 90)))) for i in range(60)]
    i = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame([(k, "some text before and after the passage " * 3) for k in range(300)], "doc_id long, text string")
    made = leakage.edited_passages(i, docs).collect()
    assert len(made) == 720 and {r["changed"] for r in made} == {1, 2, 3} and all("zq" in r["text"] for r in made)
    edited = spark.createDataFrame(made)
    got = {(r["doc_id"], r["item_id"]) for r in leakage.leaked_passages(edited, i).collect()}
    for changed in (1, 2, 3):
        some = [(r["doc_id"], r["item_id"]) for r in made if r["changed"] == changed]
        assert sum(x in got for x in some) >= 0.9 * len(some), changed
