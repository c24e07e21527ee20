"""Target mixtures and hostile language."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from driftnet.llm import abuse, mixing


def test_rates_fill_up():
    targets = [("a", 0.5, 1), ("b", 0.3, 4), ("c", 0.2, 1), ("gone", 0.0, 2), ("absent", 0.1, 3), ("null", None, None)]
    sizes = {"a": 1000, "b": 100, "c": 500}
    r = mixing.rates(sizes, targets)
    assert r["b"] == 4 and r["gone"] == r["absent"] == r["null"] == 0
    assert sum(r[s] * n for s, n in sizes.items()) == pytest.approx(1600)
    assert r["a"] <= 1 and r["c"] <= 1
    assert mixing.rates({}, targets) == {s: 0.0 for s, _, _ in targets}


@pytest.mark.parametrize("rate,limit", [(0.3, 1), (0.99, 1), (1.7, 2), (2.5, 4), (0.01, 9)])
def test_poisson_mean(rate, limit):
    steps = mixing.poisson_steps(rate, limit)
    assert len(steps) == limit and steps == sorted(steps)
    assert sum(1 - s for s in steps) == pytest.approx(rate, abs=1e-6)


def test_mixture(spark):
    n = {"big": 6000, "small": 300, "other": 3000}
    docs = spark.createDataFrame([(f"{s}{i}", s, 10) for s, k in n.items() for i in range(k)] + [("x", None, 5), ("y", "unlisted", 5), ("z", "big", 0), (None, "big", 10)], "doc_id string, source string, n_tokens long").withColumn("copy", F.lit(0))
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.2, 3), ("other", 0.3, 2), ("absent", 0.0, 1)], "source string, target_share double, max_repeats int")
    mixed = mixing.mix(docs, targets)
    rows = mixed.collect()
    assert [r["position"] for r in rows] == sorted(r["position"] for r in rows)
    keys = [(r["doc_id"], r["copy"]) for r in rows]
    assert len(keys) == len(set(keys)) and {r["source"] for r in rows} == set(n)
    assert sum(r["source"] == "small" for r in rows) == 900  # its limit
    report = {r["source"]: r for r in mixing.shares(docs, mixed, targets).collect()}
    assert set(report) == {"big", "small", "other", "absent"}
    assert report["big"]["reached_share"] / report["other"]["reached_share"] == pytest.approx(5 / 3, rel=0.1)
    assert sum(r["drawn_tokens"] for r in report.values()) == pytest.approx(93000, rel=0.03)
    again = mixing.mix(docs.repartition(7), targets).collect()
    assert [(r["doc_id"], r["copy"]) for r in again] == keys
    assert mixing.mix(docs.limit(0), targets).count() == 0 == mixing.mix(docs, targets.limit(0)).count()


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "Hello world, hello!"), (2, None), (3, ""), (4, "naïve 日本 <|endoftext|> " * 400)], "doc_id long, text string").withColumn("n_tokens", F.lit(-1))
    got = {r["doc_id"]: r["n_tokens"] for r in mixing.with_token_counts(df).collect()}
    assert got[1] == 5 and got[2] == got[3] == 0 and got[4] > 4000


def corpus():
    rnd = random.Random(6)
    noun, place = ["dock", "kiln", "tram", "weir", "loom", "roof"], ["Vintry", "Karrow", "Mirrin"]
    ordinary = lambda: f"The {rnd.choice(noun)} at {rnd.choice(place)} opened in {rnd.randrange(1800, 1990)}."
    near = ["Damn good soup, they said.", "The idiot light on the panel was red.", "Moderators remove posts that call members idiots."]
    bad = lambda: rnd.choice(["You are a miserable {}, leave.", "Shut up, you filthy {}.", "What a spineless {} you are."]).format(rnd.choice(["idiot", "scumbag", "moron"]))
    docs = []
    for i in range(400):
        parts = [ordinary() for _ in range(rnd.randrange(2, 7))]
        y = i % 4 == 0
        parts.insert(rnd.randrange(len(parts)), bad() if y else rnd.choice(near) if i % 4 == 1 else ordinary())
        docs.append((i, " ".join(parts), y))
    return docs


def test_hostile_documents(spark):
    docs = corpus()
    rows = [(i, "s" if i % 2 else None, t) for i, t, _ in docs]
    spelled = "The weir at Karrow opened in 1900. YOU ARE A MISERABLE 1D10T, LEAVE."
    rows += [(1000, "s", None), (1001, "s", ""), (1002, "s", spelled), (1003, "s", "Shut up, you f-i-l-t-h-y mоrоn."), (1004, "s", "The tram opened. " * 3000)]
    labels = [(i, "r1", ("hate" if y else "none") if i % 80 else ("none" if y else "abuse")) for i, _, y in docs if i % 2 == 0 or not y] + [(3, "r2", None), (5, "r1", "odd"), (None, "r1", "none")]
    d = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("score", F.lit(1))
    lab = spark.createDataFrame(labels, "doc_id long, rater string, category string")
    scored = abuse.score_documents(d, abuse.fit_model(d, lab))
    got = {r["doc_id"]: r["flagged"] for r in scored.collect()}
    assert {i: got[i] for i, _, y in docs} == {i: y for i, _, y in docs}
    assert [got[i] for i in range(1000, 1005)] == [False, False, True, True, False]
    rates = {r["source"]: r for r in abuse.rates_by_source(scored).collect()}
    assert sum(r["documents"] for r in rates.values()) == len(rows) and None in rates
    none = abuse.score_documents(d, abuse.fit_model(d, lab.limit(0)))
    assert none.where("flagged").count() == 0 and abuse.score_documents(d.limit(0), None).count() == 0


def test_spelling():
    assert abuse.tokens(abuse.plain("F-U-C-K p***y puuussy sh1t 1984 ｗｏｒｄ wоrd 你好")) == ["fuck", abuse.MASKED, "pussy", "shit", abuse.NUMBER, "word", "word", "你", "好"]


def test_rates_of_any_size():
    """A high repeat limit: the mean of the drawn counts is the rate that was asked for."""
    for limit, rate in ((1000, 700.0), (1000, 740.0), (1000, 900.0), (1000, 999.5), (5000, 4000.0), (3, 2.9), (1, 0.2)):
        steps = mixing.poisson_steps(rate, limit)
        assert len(steps) == limit and all(0 <= a <= b <= 1 for a, b in zip(steps, steps[1:]))
        assert abs(sum(1 - x for x in steps) - rate) < 1e-6 * rate + 1e-6


def test_arrays_say_what_the_model_says():
    rnd = random.Random(4)
    vocab = [f"w{i}" for i in range(40)]
    rated = [(". ".join(" ".join(rnd.choices(vocab, k=rnd.randrange(1, 9))) for _ in range(4)), rnd.random() < 0.4) for _ in range(60)]
    model = abuse.train(rated)
    arrays = abuse.ArrayModel(model)
    texts = [t for t, _ in rated] + ["unknown words here. w1 w2", "", None, "...", " ".join(rnd.choices(vocab, k=500))]
    ids, memo = abuse.WordHashes(), {}
    for _ in range(2):
        got = arrays.scores(texts, ids, memo)
        assert all(abs(g - model.score(t)) < 1e-9 for g, t in zip(got, texts))


def test_long_documents_teach_too(spark, monkeypatch):
    """A rated document of any length is part of the sample; the sample is bounded by its segments and words."""
    letters = "abcdefghijklmnop"
    filler = ". ".join(f"plain line q{letters[i % 16]}{letters[i // 16 % 16]}{letters[i // 256]}z of a long page" for i in range(4000))
    docs = [(i, f"you are a vile worm {i % 3}. {filler if i == 0 else 'good day'}" if i % 2 == 0 else f"good day {i}. {filler if i == 1 else 'nice work'}") for i in range(40)]
    assert len(docs[0][1]) > 25_000
    d = spark.createDataFrame(docs, "doc_id long, text string")
    seen = []
    monkeypatch.setattr(abuse, "train_bags", lambda bags: seen.append(bags))
    labels = spark.createDataFrame([(i, "r", "abuse" if i % 2 == 0 else "none") for i in range(40)], "doc_id long, rater string, category string")
    abuse.fit_model(d, labels)
    assert len(seen[0]) == 40 and sorted(len(b) for b, _ in seen[0])[-2:] == [4001, 4001]
    monkeypatch.setattr(abuse, "MAX_SEGMENTS", 500)
    abuse.fit_model(d, labels)
    assert sum(len(b) for b, _ in seen[1]) == 500
    monkeypatch.setattr(abuse, "MAX_WORDS", 600)
    abuse.fit_model(d, labels)
    assert 500 < sum(len(w) for b, _ in seen[2] for w in b) <= 600
