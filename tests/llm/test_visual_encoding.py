"""Texts that look alike, and texts in the wrong encoding."""

from __future__ import annotations

import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st

from driftnet.llm import encoding, visual

TITLES = ["Naïve Raft", "Café Post-Office - Live", "숨은 등대 (2015)", "ガラスのパズル", "Ήσυχη ψυχή", "Тихая звезда 5", "Paper"]
SAME = {
    "Naïνе Rаft": 0, "Ｎaïve　Ｒａｆｔ": 0, "Na​ïve Raft﻿": 0, "Café Pоst‑Oﬃce - Live": 1,
    unicodedata.normalize("NFD", TITLES[2]): 2, "ｶﾞﾗｽのﾊﾟｽﾞﾙ": 3, unicodedata.normalize("NFD", TITLES[4]): 4, "Tиxaя звeздa 5": 5, "𝐏𝐚𝐩𝐞𝐫": 6,
}
OTHER = ["NAÏVE RAFT", "Naive Raft", "Naïve Raft!", "Naïve  Raft", "Naïve² Raft", "", "ⓅPaper", None, "Ρaрer x", "Naïve Raft"]


def test_recognised(spark):
    titles = spark.createDataFrame(list(enumerate(TITLES)) + [(99, None)], "title_id int, title string")
    rows = spark.createDataFrame([(t, "k") for t in [*SAME, *SAME, *OTHER]], "text string, form string")
    got = [(r["text"], r["title_id"]) for r in visual.recognised(rows, titles).collect() if r["text"] != TITLES[r["title_id"]]]
    assert sorted(got) == sorted([*SAME.items()] * 2)
    assert visual.recognised(rows.limit(0), titles).count() == 0 == visual.recognised(rows, titles.limit(0)).count()


def test_forms_against_plain_python(spark):
    texts = [*SAME, *(t for t in OTHER if t is not None), "q̣̇", "q̣̇", "a" * 5000 + "é", "각" * 300, "​"]
    got = {r["text"]: r["form"] for r in visual.consistent_forms(spark.createDataFrame([(t,) for t in texts] + [(None,)], "text string")).collect()}
    assert got == {t: unicodedata.normalize("NFC", "".join(visual.shown(c) if c > "\x7f" else c for c in t)) for t in set(texts)}


GOOD = [f"{a} {b}" for a in ("Café", "Niño", "Fenêtre", "Über", "Canção", "Mañana", "Große", "Wälder", "Tür") for b in ("pequeño", "brûlée", "Straße", "verão", "Höhle", "río", "Flöte")]
CYRILLIC = [f"{a} {b}" for a in ("Тихая", "Белая", "Старая", "Зимняя") for b in ("звезда", "птица", "дорога", "гавань", "крыша")]
PLAIN = ["Amber Raft", "Night Choir", "½ Moon ©", "ESTAÇÃO Nº 7", "Señor «Pez» ¿Dónde?", "Winter™ Reef", "†Night Choir†"]


def test_garbled(spark):
    wrong = {t.encode("utf-8").decode(p): t for t in ("Café pequeño", "Canção verão", "Тихая птица") for p in ("latin1", "cp437")}
    wrong |= {"Белая звезда".encode("cp1251").decode("latin1"): "Белая звезда", "Große Höhle".encode("utf-8").decode("cp1252").encode("utf-8").decode("cp1252", "replace"): None}
    lost = ["Can�o", "Stra\x81e"]
    rows = [(t,) for t in (GOOD + CYRILLIC) * 2 + PLAIN + list(wrong) + lost + [None, ""]]
    got = {r["text"]: r["restored"] for r in encoding.garbled_texts(spark.createDataFrame(rows, "text string")).collect()}
    assert set(got) == set(wrong) | set(lost)
    assert all(got[w] == t for w, t in wrong.items() if t is not None)
    assert all(got[x] is None for x in lost)


def shown_again(text, page, times):
    for _ in range(times):
        text = text.encode("utf-8").decode(page)
    return text


def restored(spark, texts):
    return {r["text"]: r["restored"] for r in encoding.garbled_texts(spark.createDataFrame([(t,) for t in texts], "text string")).collect()}


def test_mistakes_repeated_any_number_of_times(spark):
    wrong = {shown_again(t, p, n): t for t, p in (("Canção verão", "cp437"), ("Große Höhle", "latin1"), ("Белая звезда", "cp850")) for n in (3, 4, 5, 6)}
    assert restored(spark, [*(GOOD + CYRILLIC), *PLAIN, *wrong]) == wrong


def test_any_number_of_garbled_runs_in_a_word(spark):
    # the word as a whole was not shown in the page: what is Cyrillic was meant
    words = ["Canção", "Mañana", "Große", "Wälder", "Höhle", "Straße"] * 5
    wrong = {"_".join([*(shown_again(w, p, 1) for w in words[:n]), "звезда"]): "_".join([*words[:n], "звезда"]) for p in ("cp437", "latin1") for n in (4, 6, 30)}
    assert restored(spark, [*(GOOD + CYRILLIC), *PLAIN, *wrong]) == wrong


def test_weak_words_count_together_by_any_mapping(spark):
    # each word alone gains too little; what the first was is the fifth of its repairs
    cjk = ["我们的山河", "山河与我们", "大海的声音", "春天的花园", "花园与大海", "声音的山", "河与海", "我的春天", "天与山", "青いプログラム", "静かな海", "山の声", "春の海", "숨은 등대", "바다의 노래", "산과 바다"]
    greek = ["Ήσυχη ψυχή", "μικρή θάλασσα", "άσπρη νύχτα", "ψυχή και νύχτα"]
    wrong = {"青 海".encode("big5").decode("iso8859_2"): "青 海"}
    assert restored(spark, [*GOOD, *CYRILLIC, *cjk, *greek, *wrong]) == wrong


def test_no_texts(spark):
    assert encoding.garbled_texts(spark.createDataFrame([], "text string")).count() == 0


def brute_segments(x):
    """Maximal scoring segments by their definition: recursively the best run, then what is left and right of it."""
    best = max(((sum(x[i:j]), -(j - i), -i, i, j) for i in range(len(x)) for j in range(i + 1, len(x) + 1)), default=(0,))
    if best[0] <= 0:
        return []
    i, j = best[3], best[4]
    return [*brute_segments(x[:i]), (i, j), *((a + j, b + j) for a, b in brute_segments(x[j:]))]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-4, 4), max_size=14))
def test_maximal_segments(x):
    got = encoding.improbable_runs(x)
    assert sum(sum(x[a:b]) for a, b in got) == sum(sum(x[a:b]) for a, b in brute_segments(x))
    assert all(a < b for a, b in got) and all(p[1] <= q[0] for p, q in zip(got, got[1:]))
