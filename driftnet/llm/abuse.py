"""Scores documents for abusive, hateful or sexually explicit language.

Method: class-conditional Kneser-Ney models. One trigram model of hostile and one
of ordinary language score each segment (sentence or line) of a document by the
difference of their log-likelihoods over its length; both fall back on the same
word frequencies, so a rare expression is smoothed alike in either. A document's
score is that of its worst segment, with the length raised by LENGTH_PRIOR words,
so that a word or two is no verdict.

Training: raters judge documents, not sentences, and err. A model is first trained
on all segments of documents rated hostile against those rated ordinary. Then,
ROUNDS times, each half of the documents is judged by a model of the other half:
segments of hostile documents stay hostile only if they score so, and clearly
hostile ones of ordinary documents teach nothing. The threshold is the one with
the best F1 on a fifth of the rated documents that is held out. Documents rated
both ways, or not at all, are left out.

The training sample is bounded: at most MAX_LABELLED rated documents, chosen by a hash of
their id, and of their distinct segments (of all lengths of document) at most
MAX_SEGMENTS, chosen by a hash, of MAX_WORDS words in all, are sent to the driver. So the
model has at most MAX_WORDS + MAX_SEGMENTS trigrams, and the arrays that are broadcast hold at
most MODEL_BYTES. Scoring has no bound: every segment of every document is scored.

A segment is a sentence or line; a longer one than SEGMENT_WORDS words counts as several.

Spelling: letter case, invisible characters, look-alike letters, letters spelled
with separators, stretched letters, and digits inside words are undone; masked
words (with stars) are one word of their own. Chinese and Japanese are read by character.

Defined results: a null or empty text scores 0 and is not flagged; without rated
documents of both kinds nothing is flagged; repeated documents are scored each.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftnet.llm.visual import shown
from driftnet.llm.words import INVISIBLE, WordHashes

MAX_LABELLED = 6_000
MAX_SEGMENTS = 200_000
MAX_WORDS = 1_500_000
SEGMENT_WORDS = 60
#: Five tables of at most so many entries of 16 or 24 bytes for each of two classes.
MODEL_BYTES = (MAX_WORDS + 2 * MAX_SEGMENTS) * 5 * 24 * 2
LENGTH_PRIOR = 3.0
DISCOUNT = 0.75
ROUNDS = 2
#: A segment of an ordinary document was overlooked there by its rater from this score on.
CLEARLY_HOSTILE = 0.75
#: Uses that raters may overlook of any segment.
OVERLOOKED_LEAST = 2
#: A segment that ordinary documents use up to this often, against hostile ones, was overlooked there by raters; beyond it is ordinary.
OVERLOOKED = 0.2
DEFAULT_THRESHOLD = 1.0
#: However wide the gap that the held-out documents leave: from here on a segment is hostile.
MOST_THRESHOLD = 1.5
#: A segment of a hostile document stays hostile in training from this score on.
HOSTILE_FROM = 0.5
#: What raters call hostile, and what they call ordinary.
HOSTILE = ("abuse", "hate", "sexual")
ORDINARY = "none"
MASKED, NUMBER, START, END = "<masked>", "<number>", "<s>", "</s>"
_MEMO = 1_000_000
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)

_BREAK = re.compile(r"[.!?]+(?=\s|$)|[。！？…]+|[\r\n]+")
_CJK = "぀-ヿ㐀-鿿"
_TOKEN = re.compile(rf"[{_CJK}]|[^\W_{_CJK}](?:[^\W_{_CJK}]|[*@$](?=[*@$\w]))*|[@$](?=[^\W_]{{2}})[^\W_]+")
_SPELLED = re.compile(r"(?<![^\W_])[^\W\d_]([-.*_·~+/ ])(?:[^\W\d_]\1)+[^\W\d_](?![^\W_*])")
_STRETCHED = re.compile(r"([^\W\d_])\1{2,}")
_MIXED = re.compile("[A-Za-z][Ͱ-֏]|[Ͱ-֏][A-Za-z]|[！-～℀-⅏\U0001d400-\U0001d7ff]")
# fixed values: digits and signs that stand for letters inside a word
_LETTERS = str.maketrans("0134578@$", "oieastbas")


def _word(token: str) -> str:
    if token.isalpha():
        return token
    if "*" in token:
        return MASKED
    if token.isdigit():
        return NUMBER
    stem = token.rstrip("0123456789")
    if stem != token:  # a numbered name
        return stem + NUMBER
    return token.translate(_LETTERS) if any(c.isalpha() for c in token) else token


def _unspelled(m: re.Match) -> str:
    return re.sub(r"[-.*_·~+/ ]", "", m[0])


def plain(text: str) -> str:
    """The text in the spelling that the models know."""
    if not text.isascii():
        text = INVISIBLE.sub("", text)
        if _MIXED.search(text):
            text = "".join(shown(c) if c > "\x7f" else c for c in text)
    text = _SPELLED.sub(_unspelled, text.lower())
    return _STRETCHED.sub(r"\1", text) if _stretches(text) else text


def _stretches(text: str) -> bool:
    """Whether a character that may be a letter stands three times in a row: cheaper than the pattern."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return bool(((c[2:] == c[1:-1]) & (c[1:-1] == c[:-2]) & (c[2:] > 64)).any())


def segments(text: str) -> list[str]:
    """Sentences and lines of a text, in plain spelling."""
    return [s for s in _BREAK.split(plain(text)) if s and not s.isspace()]


def tokens(segment: str) -> list[str]:
    """The words of a segment in plain spelling."""
    return [t if t.isalpha() else _word(t) for t in _TOKEN.findall(segment)]


def pieces(words: list[str]) -> list[list[str]]:
    """The words of a segment in parts of at most SEGMENT_WORDS; none of no words."""
    return [words[i : i + SEGMENT_WORDS] for i in range(0, len(words), SEGMENT_WORDS)]


class _Counts:
    """Trigram counts of one class and the continuation counts of its bigrams."""

    def __init__(self, bags: Iterable[tuple[tuple[str, ...], float]]):
        self.tri: Counter = Counter()
        for words, n in bags:
            w = (START, START, *words, END)
            for t in zip(w, w[1:], w[2:]):
                self.tri[t] += n
        self.of: dict = defaultdict(float)
        self.kinds: Counter = Counter()
        self.bi: Counter = Counter()
        for (u, v, w), n in self.tri.items():
            self.of[u, v] += n
            self.kinds[u, v] += 1
            self.bi[v, w] += 1
        self.bi_of: Counter = Counter()
        self.bi_kinds: Counter = Counter()
        for (v, _), n in self.bi.items():
            self.bi_of[v] += n
            self.bi_kinds[v] += 1


class Model:
    """The pair of class-conditional models."""

    def __init__(self, hostile: _Counts, ordinary: _Counts, threshold: float):
        self.classes, self.threshold = (hostile, ordinary), threshold
        shared: Counter = Counter()
        for c in self.classes:
            for _, w in c.bi:
                shared[w] += 1
        self.shared, self.total = shared, sum(shared.values()) + 0.5 * (len(shared) + 1)
        self._memo: dict = {}

    def _p(self, c: _Counts, u: str, v: str, w: str) -> float:
        p = (self.shared.get(w, 0) + 0.5) / self.total
        n = c.bi_of.get(v, 0)
        if n:
            p = max(c.bi.get((v, w), 0) - DISCOUNT, 0) / n + DISCOUNT * c.bi_kinds[v] / n * p
        n = c.of.get((u, v), 0)
        if n:
            p = max(c.tri.get((u, v, w), 0) - DISCOUNT, 0) / n + min(1.0, DISCOUNT * c.kinds[u, v] / n) * p
        return p

    def _ratio(self, t: tuple[str, str, str]) -> float:
        # a word that neither class knows says nothing
        known = t[2] in self.shared
        r = math.log(self._p(self.classes[0], *t) / self._p(self.classes[1], *t)) if known else 0.0
        if len(self._memo) >= _MEMO:
            self._memo.clear()
        self._memo[t] = r
        return r

    def score_words(self, words: tuple[str, ...] | list[str]) -> float:
        memo, total, u, v = self._memo, 0.0, START, START
        for w in (*words, END):
            t = (u, v, w)
            r = memo.get(t)
            total += self._ratio(t) if r is None else r
            u, v = v, w
        return total / (len(words) + LENGTH_PRIOR)

    def score(self, text: str | None) -> float:
        """Score of the worst segment; 0 for a text without words."""
        return max((self.score_words(w) for s in segments(text or "") for w in pieces(tokens(s))), default=0.0)


def _key(*hashes: np.ndarray) -> np.ndarray:
    """One hash of words in a row."""
    out = hashes[0] * _MIX[0]
    for k, h in enumerate(hashes[1:], 1):
        out = (out ^ (out >> np.uint64(29))) * _MIX[k] + h
    return out ^ (out >> np.uint64(32))


class _Table:
    """Numbers by key, in sorted arrays; missing keys give zeros."""

    def __init__(self, keys: np.ndarray, *values: np.ndarray):
        order = np.argsort(keys)
        self.keys = keys[order]
        self.values = [np.append(v[order], 0.0) for v in values]

    def of(self, keys: np.ndarray) -> list[np.ndarray]:
        if not len(self.keys):
            return [np.zeros(len(keys)) for _ in self.values]
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        at = np.where(self.keys[at] == keys, at, len(self.keys))
        return [v[at] for v in self.values]

    def nbytes(self) -> int:
        return self.keys.nbytes + sum(v.nbytes for v in self.values)


class ArrayModel:
    """What a Model says, in sorted arrays of hashed n-grams (64 bits; two n-grams of a model share a
    hash with a probability of about n**2 / 2**65). Scores whole batches of documents at once."""

    def __init__(self, model: Model):
        ids = WordHashes()

        def table(counts: dict, *more: dict) -> _Table:
            grams = list(counts)
            rows = [g if isinstance(g, tuple) else (g,) for g in grams]
            keys = _key(*(ids.of(list(c)) for c in zip(*rows))) if rows else np.zeros(0, np.uint64)
            return _Table(keys, *(np.array([c[g] for g in grams], float) for c in (counts, *more)))

        self.threshold, self.total = model.threshold, float(model.total)
        self.shared = table(model.shared)
        self.classes = [(table(c.tri), table(c.of, c.kinds), table(c.bi), table(c.bi_of, c.bi_kinds)) for c in model.classes]
        if self.nbytes() > MODEL_BYTES:
            raise ValueError("the model is larger than its sample allows")

    def nbytes(self) -> int:
        return self.shared.nbytes() + sum(t.nbytes() for c in self.classes for t in c)

    def ratios(self, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        """The logarithm of how much more hostile than ordinary each word w is after u and v."""
        (seen,) = self.shared.of(_key(w))
        uvw, uv, vw, one = _key(u, v, w), _key(u, v), _key(v, w), _key(v)
        logs = []
        for tri, pairs, bi, singles in self.classes:
            p = (seen + 0.5) / self.total
            n, kinds = singles.of(one)
            some = np.maximum(n, 1.0)
            p = np.where(n > 0, np.maximum(bi.of(vw)[0] - DISCOUNT, 0.0) / some + DISCOUNT * kinds / some * p, p)
            n, kinds = pairs.of(uv)
            some = np.where(n > 0, n, 1.0)
            p = np.where(n > 0, np.maximum(tri.of(uvw)[0] - DISCOUNT, 0.0) / some + np.minimum(1.0, DISCOUNT * kinds / some) * p, p)
            logs.append(np.log(p))
        return np.where(seen > 0, logs[0] - logs[1], 0.0)

    def score_segments(self, some: list[list[str]], ids: WordHashes) -> np.ndarray:
        """The score of each piece of words."""
        h = ids.of([x for words in some for x in (START, START, *words, END)])
        sizes = np.array([len(words) + 3 for words in some])
        last = np.cumsum(sizes)
        inside = np.ones(len(h), bool)
        inside[last - sizes] = inside[last - sizes + 1] = False
        at = np.flatnonzero(inside)
        r = self.ratios(h[at - 2], h[at - 1], h[at])
        starts = np.cumsum(sizes - 2) - (sizes - 2)
        return np.add.reduceat(r, starts) / (sizes - 3 + LENGTH_PRIOR)

    def scores(self, texts: list[str | None], ids: WordHashes, memo: dict[str, float]) -> list[float]:
        """Score of the worst segment of each text; 0 for one without words. Short segments that
        were met before are looked up."""
        split = [segments(t) if t else [] for t in texts]
        fresh = list({s for some in split for s in some if s not in memo})
        if fresh:
            cut = [(k, p) for k, s in enumerate(fresh) for p in pieces(tokens(s))]
            worst = np.full(len(fresh), -math.inf)
            if cut:
                np.maximum.at(worst, np.array([k for k, _ in cut]), self.score_segments([p for _, p in cut], ids))
            memo.update(zip(fresh, worst.tolist()))
        out = [max((memo[s] for s in some), default=-math.inf) for some in split]
        if len(memo) > 100_000:
            memo.clear()
        else:
            for s in fresh:
                if len(s) >= 300:
                    del memo[s]
        return [0.0 if x == -math.inf else x for x in out]


def _best_threshold(scored: list[tuple[float, bool]]) -> float:
    """The score with the best F1 (a third up the gap below it)."""
    scored = sorted(scored, reverse=True)
    positives, hits, best, at = sum(y for _, y in scored), 0, 0.0, DEFAULT_THRESHOLD
    for i, (x, y) in enumerate(scored):
        hits += y
        f1 = 2 * hits / (i + 1 + positives)
        if y and f1 >= best and x > 0:
            below = max(0.0, scored[i + 1][0]) if i + 1 < len(scored) else 0.0
            best, at = f1, below + (x - below) / 3
    return at


Bag = Counter  # of the segments of a document, each a tuple of words


def bag_of(text: str) -> Bag:
    return Counter(tuple(p) for s in segments(text) for p in pieces(tokens(s)))


def train(rated: list[tuple[str, bool]]) -> Model | None:
    """A model from (text, hostile) pairs; None without both kinds."""
    return train_bags([(bag_of(t), y) for t, y in rated])


def train_bags(docs: list[tuple[Bag, bool]]) -> Model | None:
    """A model from (segments, hostile) pairs; None without both kinds."""
    if not any(y for _, y in docs) or all(y for _, y in docs):
        return None

    def fit(some: list, kept: list[set | None]) -> Model:
        # a segment counts once per document
        hostile, ordinary = Counter(), Counter()
        for (bag, y), keep in zip(some, kept):
            for w in bag:
                if keep is None:
                    (hostile if y else ordinary)[w] += 1
                elif w not in keep:
                    ordinary[w] += 1
                elif y:
                    hostile[w] += 1
                # else a rater overlooked it: it teaches nothing
        return Model(_Counts(hostile.items()), _Counts(ordinary.items()), DEFAULT_THRESHOLD)

    ids = WordHashes()

    def scored_by(model: Model, bags: list[Bag]) -> dict[tuple[str, ...], float]:
        every = list({w for bag in bags for w in bag})
        return dict(zip(every, ArrayModel(model).score_segments(every, ids).tolist())) if every else {}

    def learn(some: list) -> Model:
        some = sorted(some, key=lambda d: d[1])  # both halves get their share of either kind
        rated = {y: Counter(w for bag, z in some if bool(z) == y for w in bag) for y in (False, True)}
        common = {w for w, n in rated[False].items() if n > OVERLOOKED * rated[True][w] + OVERLOOKED_LEAST}
        kept: list[set | None] = [None] * len(some)
        for _ in range(ROUNDS):
            # each half is judged by what the other half taught
            halves = [scored_by(fit(some[1 - h :: 2], kept[1 - h :: 2]), [b for b, _ in some[h::2]]) for h in (0, 1)]
            next_kept = [
                {w for w in bag if w not in common and halves[i % 2][w] >= (HOSTILE_FROM if y else CLEARLY_HOSTILE)}
                for i, (bag, y) in enumerate(some)
            ]
            if not any(k for k, (_, y) in zip(next_kept, some) if y):
                break  # too few examples to tell segments apart
            kept = next_kept
        return fit(some, kept)

    held_out = docs[::5]
    first = learn([d for i, d in enumerate(docs) if i % 5])
    by_segment = scored_by(first, [bag for bag, _ in held_out])
    scored = [(max((by_segment[w] for w in bag), default=0.0), y) for bag, y in held_out]
    model = learn(docs)
    if any(y for _, y in scored) and not all(y for _, y in scored):
        model.threshold = min(_best_threshold(scored), MOST_THRESHOLD)
    return model


def fit_model(docs: DataFrame, labels: DataFrame) -> Model | None:
    """The model of a bounded, hash-ordered sample of the rated documents' segments."""
    rated = labels.where(F.col("category").isin(*HOSTILE, ORDINARY)).groupBy("doc_id").agg(
        F.min((F.col("category") != ORDINARY).cast("int")).alias("low"), F.max((F.col("category") != ORDINARY).cast("int")).alias("high")
    )
    clear = rated.where(F.col("low") == F.col("high")).select("doc_id", (F.col("high") == 1).alias("hostile"))
    first = clear.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED)
    chosen = first.withColumn("doc", F.row_number().over(Window.orderBy(F.xxhash64("doc_id"), "doc_id")))  # MAX_LABELLED rows
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id")
    one = texts.groupBy("doc").agg(F.min("text").alias("text"), F.max("hostile").alias("hostile")).select("doc", "hostile", "text")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, hostile, text in zip(*(c.to_pylist() for c in batch.columns)):
                bag = [" ".join(w) for w in bag_of(text)]
                yield pa.record_batch([pa.array([doc] * len(bag), pa.int32()), pa.array([hostile] * len(bag), pa.bool_()), pa.array(bag, pa.string())], names=["doc", "hostile", "segment"])

    most = MAX_WORDS

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the sample as one compressed block, each segment once with its documents
        held: dict[str, list[int]] = {}
        words = 0
        for batch in batches:  # in the order of the hash
            for doc, hostile, segment in zip(*(c.to_pylist() for c in batch.columns)):
                words += segment.count(" ") + 1
                if words <= most:
                    held.setdefault(segment, []).append(2 * doc + hostile)
        lines = [" ".join(map(str, held[s])) + "\t" + s for s in sorted(held)]
        yield pa.record_batch([pa.array([zlib.compress("\n".join(lines).encode("utf-8", "surrogatepass"))], pa.binary())], names=["block"])

    parts = one.mapInArrow(split, "doc int, hostile boolean, segment string")
    sample = parts.orderBy(F.xxhash64("doc", "segment"), "segment").limit(MAX_SEGMENTS).mapInArrow(packed, "block binary")
    bags: dict[int, Bag] = {}
    for row in sample.collect():  # MAX_SEGMENTS segments of at most SEGMENT_WORDS words
        for line in zlib.decompress(row["block"]).decode("utf-8", "surrogatepass").split("\n"):
            keys, _, text = line.partition("\t")
            segment = tuple(text.split(" "))
            for key in map(int, keys.split()):
                bags.setdefault(key, Counter())[segment] = 1
    return train_bags([(bags[key], bool(key % 2)) for key in sorted(bags)])


def score_documents(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """docs with score and flagged instead of the text column; columns that are
    called so are replaced."""
    state = docs.sparkSession.sparkContext.broadcast(model and ArrayModel(model))  # at most MODEL_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, ids, memo = state.value, WordHashes(), {}
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            x: list[float] = []
            for at in range(0, len(texts), 500):
                x += own.scores(texts[at : at + 500], ids, memo) if own else [0.0] * len(texts[at : at + 500])
            flags = [bool(own) and v >= own.threshold for v in x]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(x, pa.float64()), pa.array(flags, pa.bool_())], names=[*batch.schema.names[:-1], "score", "flagged"])

    keep = [c for c in docs.columns if c.lower() not in (text.lower(), "score", "flagged")]
    schema = docs.select(*keep).schema.add("score", "double").add("flagged", "boolean")
    return docs.select(*keep, text).mapInArrow(run, schema)


def rates_by_source(scored: DataFrame) -> DataFrame:
    """Documents, flagged documents and their rate per source; null is a source of its own."""
    return scored.groupBy("source").agg(
        F.count(F.lit(1)).alias("documents"), F.sum(F.col("flagged").cast("long")).alias("flagged"),
        F.avg(F.col("flagged").cast("double")).alias("rate"),
    )
