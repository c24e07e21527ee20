"""Texts that were decoded with a wrong character encoding.

Method: adjacent character pairs are scored by the corpus: the log-probability of
a character after another is their mutual information plus the log-frequency of
the second. (Mutual information alone can't tell: garbled pairs occur together and
inform about each other as much as any.) Improbable runs are isolated as
maximum-scoring segments of the improbability of their pairs. Inverse mappings
(encode as it was shown, decode as it was meant) are tested only inside these
runs; one is taken if the text gains enough log-probability by it. Runs are tried
again after a repair, as often as one gains enough, which undoes repeated mistakes;
repairs of a word that do not touch are made together. A character that no text is
written in (a replacement mark, a control or unassigned code point) has probability
zero after any other: its segment is infinitely improbable and the text is damaged,
recoverable or not.

All of this is done once per distinct word, not per text: texts are cut at the
signs and digits below ``@``, which no encoding uses as a second byte, and the
words are counted with one partial aggregate. So the slow part grows with the
vocabulary. The model is counted twice: the second time without the words that
the first judged to be garbled, so that a mistake that is often repeated does not
become usual. Words that gain a little count together, if one text holds several
that the same mapping explains.

The model is bounded whatever the corpus: counts of pairs lie in PAIR_SLOTS
hashed counters of 64 bits, single characters by code point (51 MB in all with their kinds). Of P
distinct pairs in the corpus, a pair shares its counter with another one with a
probability of at most P / PAIR_SLOTS and then looks as usual as both together.

Defined results: null is no case; ASCII texts are no case; texts of any length
are looked at in full; empty tables give no rows; columns called like an added
one (with two leading underscores) are replaced.
"""

from __future__ import annotations

import functools
import itertools
import math
import re
import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftnet.llm.visual import shown as shown_as
from driftnet.operators.skew import spread_join
from driftnet.session import cut_lineage

PAIR_SLOTS = 1 << 22
_SLOT_SHIFT = np.uint64(64 - 22)
_POINTS = 0x110000
#: Weight of single-character frequencies against pair counts.
BACKOFF = 4.0
#: What a character that was never seen counts.
UNSEEN = 0.05
_KINDS = 40
#: Bits above which a pair counts as improbable.
USUAL_BITS = 9.0
#: Bits that a text must gain by a repair, in all and per character that was replaced.
LEAST_GAIN = 10.0
LEAST_GAIN_EACH = 3.0
#: Bits that each byte after the first of a UTF-8 character adds to a gain: chance seldom makes one.
UTF8_BITS = 3.0
#: Words that a task judges together, and words of a task.
CHUNK = 128
TASK_WORDS = 2_048
START, END = "\x02", "\x03"
_BREAK = r"[\x00-\x3f]+"
_WORD = re.compile(r"[^\x00-\x3f]+")

# fixed values: code pages a text may have been shown in, and those it may have been written in
SHOWN_IN = ("cp1252", "latin1", "cp437", "cp850", "mac_roman", "cp1251", "koi8_r", "cp866", "cp1253", "iso8859_7", "cp1250", "iso8859_2", "cp949", "cp932", "gbk", "big5")
WRITTEN_IN = ("utf-8", "cp1251", "koi8_r", "cp866", "cp1253", "iso8859_7", "cp1252", "mac_roman", "cp437", "cp850", "cp932", "euc_jp", "gbk", "big5", "cp949", "cp1250")
#: Single-byte pages that leave some bytes undefined; readers pass those on as control characters.
_PASSING = {"cp1252", "cp1251", "cp1253", "cp1250"}


def _encoded(run: str, page: str) -> bytes | None:
    try:
        return run.encode(page)
    except UnicodeEncodeError:
        if page not in _PASSING:
            return None
    out = bytearray()
    for ch in run:
        try:
            out += ch.encode(page)
        except UnicodeEncodeError:
            if not 0x80 <= ord(ch) < 0xA0:
                return None
            out.append(ord(ch))
    return bytes(out)


def _decoded(raw: bytes, page: str) -> str | None:
    try:
        return raw.decode(page)
    except UnicodeDecodeError:
        return None


@functools.lru_cache(65536)
def impossible(ch: str) -> bool:
    """A replacement mark, a control character or a code point that stands for nothing."""
    if ch == "�" or "\x80" <= ch < "\xa0":
        return True
    return ch > "\x7f" and unicodedata.category(ch) in ("Cn", "Co", "Cs")


def _utf8_in_disguise(word: str) -> bool:
    """Whether what is not ASCII, or a long run of it, is UTF-8 that was shown in a single-byte page."""
    runs = _wide_runs(word)
    for page in ("cp1252", "latin1", "cp437", "cp850", "mac_roman", "cp1251"):
        valid = [(raw := _encoded(run, page)) is not None and _decoded(raw, "utf-8") is not None for run in runs]
        if valid and (all(valid) or any(v and len(run) >= 4 for v, run in zip(valid, runs))):
            return True
    return False


def teaches(word: str) -> bool:
    """Whether the model may be counted from a word: it is not provably garbled."""
    return word.isascii() or not (any(map(impossible, word)) or _utf8_in_disguise(word))


def _wide_runs(text: str) -> list[str]:
    return ["".join(g) for wide, g in itertools.groupby(text, lambda c: c > "\x7f") if wide]


def pair_slot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    mixed = (a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    return ((mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93) >> _SLOT_SHIFT).astype(np.int64)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


@functools.lru_cache(1)
def _kinds() -> np.ndarray:
    """The kind of each character: its general category and, of a cased letter, whether it is Latin."""
    names: dict[tuple[str, bool], int] = {}
    kinds = np.zeros(_POINTS, np.int64)
    for o in range(_POINTS):
        c = chr(o)
        what = unicodedata.category(c)
        ordinal = what == "Lo" and o < 0x100  # a small letter, raised
        kinds[o] = names.setdefault(("Ll", True) if ordinal else (what, what in ("Lu", "Ll") and _latin(c)), len(names))
    kinds[ord(START)], kinds[ord(END)] = len(names), len(names) + 1
    return kinds


class PairModel:
    """Log-probabilities of characters after characters, in bits. A pair that is rare
    is as probable as its kinds of character and the second one among its kind. Made
    from the counters that are not zero: (slots, counts) of pairs, (code points,
    counts), (pairs of kinds, counts)."""

    def __init__(self, pairs: tuple[np.ndarray, np.ndarray], points: tuple[np.ndarray, np.ndarray], kinds: tuple[np.ndarray, np.ndarray]):
        self.pairs, self.points, by_kind = np.zeros(PAIR_SLOTS, np.int64), np.zeros(_POINTS, np.int64), np.zeros(_KINDS * _KINDS)
        self.pairs[pairs[0]], self.points[points[0]], by_kind[kinds[0]] = pairs[1], points[1], kinds[1]
        k = _kinds()
        size = np.bincount(k, minlength=_KINDS)
        self.of_kind = np.bincount(k, weights=self.points, minlength=_KINDS) + UNSEEN * size
        by_kind = by_kind.reshape(_KINDS, _KINDS) + 0.5
        self.by_kind = by_kind / by_kind.sum(axis=1, keepdims=True)

    def pair_bits(self, a: np.ndarray, b: np.ndarray, own: int = 0) -> np.ndarray:
        """Improbability of each b after its a, as seen own times less: a text that was
        counted itself is judged by the others."""
        ka, kb = _kinds()[a], _kinds()[b]
        single = self.by_kind[ka, kb] * (np.maximum(self.points[b] - own, 0) + UNSEEN) / self.of_kind[kb]
        pair, first = np.maximum(self.pairs[pair_slot(a, b)] - own, 0), np.maximum(self.points[a] - own, 0)
        return -np.log2((pair + BACKOFF * single) / (first + BACKOFF))

    def bits(self, words: Sequence[str], own: int = 0) -> list[np.ndarray]:
        """Per word the improbability of each character (and the end) given the one before it."""
        if not words:
            return []
        points = code_points("".join([f"{START}{w}{END}" for w in words]))
        bits = self.pair_bits(points[:-1], points[1:], own)
        ends = np.cumsum([len(w) + 2 for w in words])
        return [bits[e - len(w) - 2 : e - 1] for w, e in zip(words, ends.tolist())]

    def costs(self, texts: Sequence[str], own: int = 0, possible: bool = False) -> np.ndarray:
        """Cost of each stretch of text, of two characters or more, after its first one;
        if asked, of the possible characters only."""
        points = code_points("".join(texts))
        bits = np.zeros(len(points))
        bits[1:] = self.pair_bits(points[:-1], points[1:], own)
        if possible:
            bits[[i for i, p in enumerate(points.tolist()) if p > 0x7F and impossible(chr(p))]] = 0.0
        starts = np.cumsum([0, *map(len, texts[:-1])])
        bits[starts] = 0.0
        return np.add.reduceat(bits, starts)


def improbable_runs(x: Sequence[float]) -> list[tuple[int, int]]:
    """All maximal scoring segments [start, end) of a sequence of scores."""
    kept: list[list[float]] = []  # start, end, sum before, sum after
    total = 0.0
    for i, v in enumerate(x):
        if v <= 0:
            total += v
            continue
        seg = [i, i + 1, total, total + v]
        total += v
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= seg[2]:
                j -= 1
            if j < 0 or kept[j][3] >= seg[3]:
                kept.append(seg)
                break
            seg = [kept[j][0], seg[1], kept[j][2], seg[3]]
            del kept[j:]
    return [(int(s[0]), int(s[1])) for s in kept]


def _widened(word: str, start: int, end: int) -> list[tuple[int, int]]:
    """The run with the non-ASCII characters that touch it, as it is, with one more
    character (the second byte of a pair may be ASCII), and the whole word."""
    while start > 0 and word[start - 1] > "\x7f":
        start -= 1
    while end < len(word) and word[end] > "\x7f":
        end += 1
    spans = [(start, end), (0, len(word))]
    if end < len(word):
        spans.append((start, end + 1))
    return spans


@functools.lru_cache(65536)
def _latin(ch: str) -> bool:
    return ch.isascii() or unicodedata.name(ch, "").startswith("LATIN")


def _mixes_scripts(part: str) -> bool:
    """Whether a Latin letter touches a letter of another script."""
    return any(a.isalpha() and b.isalpha() and _latin(a) != _latin(b) for a, b in zip(part, part[1:]))


@functools.lru_cache(65536)
def _plain(ch: str) -> bool:
    """Whether a repair by a single-byte or double-byte page may give a character: ASCII, letters and marks; unusual
    signs are no more probable than what was there."""
    return " " <= ch <= "\x7e" or ch > "\x9f" and unicodedata.category(ch)[0] in "LM"


def _same_page(a: str, b: str) -> bool:
    return a == b or {a, b} in ({"cp1252", "latin1"}, {"cp1253", "iso8859_7"}, {"cp1250", "cp1252"}, {"cp1250", "iso8859_2"})


def _inverse_mappings(run: str) -> Iterator[tuple[str, str]]:
    """(mapping, what the run becomes) of each mapping that applies and changes it."""
    seen, raws = {run}, {}
    for shown in SHOWN_IN:
        raw = _encoded(run, shown)
        if raw is not None and not raw.isascii():
            raws.setdefault(raw, shown)
    for raw, shown in raws.items():
        for meant in WRITTEN_IN:
            if not _same_page(shown, meant) and (back := _decoded(raw, meant)) is not None and back not in seen:
                seen.add(back)
                yield meant, f"{shown}>{meant}", back


def repairs(words: Sequence[str], model: PairModel, own: int = 1) -> list[tuple[float, list[tuple[float, str, str]], tuple[float, str] | None]]:
    """Per word the greatest score of its improbable runs, its sound repairs (gain in
    bits, mapping, repaired word), best first, of each mapping the best, and (gain,
    repaired word) of all repairs that gain enough alone and touch no better one."""
    out: list[tuple[float, list]] = []
    tests: list[tuple[int, str, str, str, str, int, int]] = []  # word, mapping, meant, back, its neighbourhood, start and end of the run
    texts: list[str] = []
    at_now: dict[tuple[int, int, int], int] = {}
    nows: list[int] = []
    for k, (word, bits) in enumerate(zip(words, model.bits(words, own))):
        x = [
            math.inf if impossible(c) else b - USUAL_BITS if c > "\x7f" or (i and word[i - 1] > "\x7f") else -USUAL_BITS
            for i, (c, b) in enumerate(zip(word, bits.tolist()))
        ]
        runs = improbable_runs(x) if any(v > 0 for v in x) else []
        out.append((max((sum(x[s:e]) for s, e in runs), default=0.0), []))
        for start, end in dict.fromkeys(w for s, e in runs for w in _widened(word, s, e)):
            run, before, after = word[start:end], word[start - 1 : start] or START, word[end : end + 1] or END
            if run.isascii():
                continue
            now = at_now.setdefault((k, start, end), len(texts))
            if now == len(texts):
                texts.append(before + run + after)
            for meant, mapping, back in _inverse_mappings(run):
                tests.append((k, mapping, meant, back, before + back + after, start, end))
                nows.append(now)
                texts.append(before + back + after)
    if not tests:
        return [(score, some, None) for score, some in out]
    costs = model.costs(texts, own)
    is_now = np.zeros(len(texts), bool)
    is_now[list(at_now.values())] = True
    gains = costs[nows] - costs[~is_now]
    # an impossible character proves damage, but only as a part of UTF-8 it also says of what kind
    single = np.array([t[2] != "utf-8" for t in tests])
    texts_now = [t for t, n in zip(texts, is_now.tolist()) if n]
    spared = np.zeros(len(texts))
    spared[is_now] = costs[is_now] - model.costs(texts_now, own, possible=True)
    gains -= np.where(single, spared[nows], 0.0)
    gains += [0.0 if t[2] != "utf-8" else UTF8_BITS * (len(t[3].encode("utf-8", "surrogatepass")) - len(t[3])) for t in tests]
    alikes: dict[int, str] = {}

    def alike_is_better(k: int, whole: str) -> bool:
        """Not garbled, if characters of the same look explain the word better."""
        word = words[k]
        if k not in alikes:
            alikes[k] = unicodedata.normalize("NFC", "".join(shown_as(c) if c > "\x7f" else c for c in word))
        if alikes[k] == word:
            return False
        a, b = model.costs([f"{START}{alikes[k]}{END}", f"{START}{whole}{END}"], own)
        return a < b

    best: dict[tuple[int, str], tuple[float, str]] = {}
    apart: dict[int, list[tuple[int, int, str, float]]] = {}
    taken: dict[int, bytearray] = {}
    for i in np.argsort(-gains, kind="stable").tolist():
        gain, (k, mapping, meant, back, near, start, end) = float(gains[i]), tests[i]
        if gain < LEAST_GAIN_EACH:
            break
        word, known = words[k], (k, mapping) in best
        free = gain >= LEAST_GAIN and taken.setdefault(k, bytearray(len(word))).find(1, max(start - 1, 0), end + 1) < 0
        if known and not free or gain < LEAST_GAIN_EACH * sum(c > "\x7f" for c in back):
            continue
        if meant != "utf-8" and (_mixes_scripts(near.strip(START + END)) or not all(map(_plain, back))):
            continue
        whole = word[:start] + back + word[end:]
        if not known:
            best[k, mapping] = gain, whole
        if free and not alike_is_better(k, whole):
            taken[k][start:end] = b"\1" * (end - start)
            apart.setdefault(k, []).append((start, end, back, gain))
    for (k, mapping), (gain, whole) in best.items():
        if not alike_is_better(k, whole):
            out[k][1].append((gain, mapping, whole))
    return [(score, some, _replaced(words[k], apart[k]) if k in apart else None) for k, (score, some) in enumerate(out)]


def _replaced(word: str, apart: list[tuple[int, int, str, float]]) -> tuple[float, str]:
    """(gain, word) with all of some repairs (start, end, new run, gain) that do not touch."""
    parts, at = [], 0
    for start, end, back, _ in sorted(apart):
        parts += [word[at:start], back]
        at = end
    return sum(a[3] for a in apart), "".join(parts) + word[at:]


def judge(words: Sequence[str], model: PairModel) -> list[tuple[bool, str | None, float, list[tuple[float, str, str]]]]:
    """Per word: garbled, what it was (null where that can't be told), bits gained, and
    single repairs that, by a mapping that explains other words too, may count."""
    found = repairs(words, model)
    now, gained, seen = list(words), [0.0] * len(words), [{w} for w in words]
    better = {k: sure for k, (_, _, sure) in enumerate(found) if sure}
    while better:  # until nothing gains enough or a text comes back
        for k, (gain, whole) in better.items():
            now[k], gained[k] = whole, gained[k] + gain
            seen[k].add(whole)
        live = list(better)
        again = repairs([now[k] for k in live], model, own=0)
        better = {k: sure for k, (_, _, sure) in zip(live, again) if sure and sure[1] not in seen[k]}
    out = []
    for word, new, gain, (score, some, _) in zip(words, now, gained, found):
        garbled = new != word or score == math.inf
        weak = some if new != word else [r for r in some if r[0] < LEAST_GAIN] if not garbled and not gain else []
        out.append((garbled, new if new != word and not any(map(impossible, new)) else None, gain, weak))
    return out


def vocabulary(rows: DataFrame, text: str = "text") -> DataFrame:
    """(word, n) of a table: each distinct word and the distinct texts that hold it,
    written to the shared folder."""
    texts = rows.where(F.col(text).isNotNull()).select(F.col(text).alias("__t")).distinct()
    words = texts.select(F.explode(F.array_distinct(F.split("__t", _BREAK))).alias("word")).where("word <> ''")
    return cut_lineage(words.groupBy("word").agg(F.count(F.lit(1)).alias("n")))


def pair_counts(words: DataFrame) -> tuple[tuple[np.ndarray, np.ndarray], ...]:
    """The counters of a vocabulary: what PairModel is made from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, points, kinds = np.zeros(PAIR_SLOTS, np.int64), np.zeros(_POINTS, np.int64), np.zeros(_KINDS * _KINDS, np.int64)
        for batch in batches:
            some = [(w, n) for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if teaches(w)]
            for at in range(0, len(some), 4096):
                part = some[at : at + 4096]
                p = code_points("".join([f"{START}{w}{END}" for w, _ in part]))
                weight = np.repeat([n for _, n in part], [len(w) + 2 for w, _ in part])
                inside = p[:-1] != ord(END)
                np.add.at(pairs, pair_slot(p[:-1], p[1:])[inside], weight[1:][inside])
                np.add.at(points, p, weight)
                k = _kinds()[p]
                np.add.at(kinds, (k[:-1] * _KINDS + k[1:])[inside], weight[1:][inside])
        for kind, counts in enumerate((pairs, points, kinds)):
            at = np.flatnonzero(counts)
            for i in range(0, len(at), 65536):
                some_at = at[i : i + 65536]
                yield pa.record_batch([pa.array(np.full(len(some_at), kind, np.int32)), pa.array(some_at), pa.array(counts[some_at])], names=["kind", "slot", "n"])

    counted = words.select("word", "n").mapInArrow(run, "kind int, slot long, n long")
    rows = counted.groupBy("kind", "slot").agg(F.sum("n").alias("n")).toPandas()  # at most PAIR_SLOTS + Unicode rows
    split = [rows[rows["kind"] == kind] for kind in range(3)]
    return tuple((own["slot"].to_numpy(np.int64), own["n"].to_numpy(np.int64)) for own in split)


_JUDGED = "word string, garbled boolean, fixed string, gain double, weak array<struct<gain:double,mapping:string,fixed:string>>"
_WEAK = pa.list_(pa.struct([("gain", pa.float64()), ("mapping", pa.string()), ("fixed", pa.string())]))


def _judged(words: DataFrame, model: tuple) -> DataFrame:
    """The words that are garbled, or may be with others, written to the shared folder."""
    spark = words.sparkSession
    wide = words.where(F.col("word").rlike("[^\\x00-\\x7F]"))
    shared = spark.sparkContext.broadcast(model)  # at most PAIR_SLOTS + Unicode counters

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = PairModel(*shared.value)
        for batch in batches:
            some = batch.column(0).to_pylist()
            out = []
            for at in range(0, len(some), CHUNK):
                part = some[at : at + CHUNK]
                out += [(w, *j) for w, j in zip(part, judge(part, own)) if j[0] or j[3]]
            yield pa.record_batch(
                [
                    pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.bool_()), pa.array([o[2] for o in out], pa.string()),
                    pa.array([o[3] for o in out], pa.float64()), pa.array([[dict(zip(("gain", "mapping", "fixed"), x)) for x in o[4]] for o in out], _WEAK),
                ],
                names=["word", "garbled", "fixed", "gain", "weak"],
            )

    # spread by number of words: a word costs much more time than it has bytes
    tasks = max(1, -(-wide.count() // TASK_WORDS))
    return cut_lineage(wide.select("word").repartition(tasks, "word").mapInArrow(run, _JUDGED))


def garbled_words(rows: DataFrame, text: str = "text") -> DataFrame:
    """(word, garbled, fixed, gain, weak) of the words of a table that are garbled or
    may be with others of a text."""
    words = vocabulary(rows, text)
    first = _judged(words, pair_counts(words))
    usual = words.join(first.where("garbled").select("word"), "word", "left_anti")
    return _judged(words, pair_counts(usual))


def garbled_rows(rows: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """(keys, fixes, lost, gain) of each row of a table that is garbled: the words to
    replace, whether one can't be recovered, bits gained. keys tell rows apart."""
    judged = garbled_words(rows, text)
    wide = rows.where(F.col(text).rlike("[^\\x00-\\x7F]"))
    held = wide.select(*keys, F.explode(F.array_distinct(F.split(F.col(text), _BREAK))).alias("word"))
    alone = F.struct(F.col("gain"), F.lit(None).cast("string").alias("mapping"), F.col("fixed"))
    hints = judged.select("word", F.concat(F.when(F.col("garbled"), F.array(alone)).otherwise(F.array().cast(judged.schema["weak"].dataType)), "weak").alias("hints"))
    met = spread_join(held, hints, "word", keys).select(*keys, "word", F.inline("hints"))
    # a word that is garbled by itself has no mapping here
    per = met.groupBy(*keys, "mapping").agg(
        F.sum("gain").alias("gain"), F.collect_list(F.struct("word", "fixed")).alias("fixes"), F.max(F.col("fixed").isNull()).alias("lost")  # words of one text
    ).where(F.col("mapping").isNull() | (F.col("gain") >= LEAST_GAIN))
    return per.groupBy(*keys).agg(
        F.flatten(F.array_sort(F.collect_list(F.struct(F.col("mapping").isNotNull(), -F.col("gain"), "mapping", "fixes")))["fixes"]).alias("fixes"), F.max("lost").alias("lost"), F.max("gain").alias("gain")
    )


def garbled_texts(rows: DataFrame, text: str = "text") -> DataFrame:
    """(text, restored, gain) of each distinct text that is garbled; restored is
    null where the original cannot be recovered in full."""
    texts = rows.where(F.col(text).isNotNull()).select(F.col(text).alias("text")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t, fixes, lost in zip(*(c.to_pylist() for c in batch.columns[:3])):
                to = {f["word"]: f["fixed"] for f in reversed(fixes)}
                out.append(None if lost else _WORD.sub(lambda m, to=to: to.get(m[0], m[0]), t))
            yield pa.record_batch([batch.column(0), pa.array(out, pa.string()), batch.column(3)], names=["text", "restored", "gain"])

    return garbled_rows(texts, ["text"]).select("text", "fixes", "lost", "gain").mapInArrow(run, "text string, restored string, gain double")
