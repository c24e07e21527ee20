"""Passages of held-out items inside corpus documents.

Method: SimHash of item-sized windows. A held-out item leaks whole or in part, and a
part is of WINDOW words, so the windows of an item are all its runs of WINDOW words;
an item that is shorter has one window of its own length. A window's fingerprint
is the SimHash of its words, each with the number of the window's shingles that hold
it. The index of item windows is cut in four blocks of 16 bits: two fingerprints that
differ in at most RADIUS = 23 bits differ in at most 5 bits of one block, so looking up
all values within 5 bits of each block (multi-index Hamming blocks) misses no pair
within the radius. (An index with fewer windows than there are such values is compared
as a whole, which gives the same pairs.) Windows of a similarity of 0.8 differ in 13.5
bits on average at most, with a standard deviation of 3.2; the radius is three of these
above, and unrelated windows differ in 32.

Candidates are verified by the exact weighted similarity of their shingles of
SHINGLE words: each shingle of the window counts by the share of its words that
stand in the same place in both windows, and at least one shingle must be the same as
a whole. A window with no shingle of any item is therefore never similar, and gets
no fingerprint. p8_found then asks for the same WINDOW words in the same order.

Equal windows are one row: items that share a stock phrase share its class, and each
distinct window of a slab is looked up once, however often it occurs; the Hamming test is
made on bounded pieces, before pairs are kept.

Documents are never shuffled: the item index is broadcast in blocks of at most about
INDEX_WINDOWS windows (100 MB), and only links (document, item) leave a task. With
several blocks the documents' words are hashed once, written to the shared folder, and
read once per block. Documents of any length are cut into slabs; all windows are looked at.

Defined results: items without a number are left out; null and empty texts, and texts
shorter than an item's window, give no rows; repeated documents give rows each, repeated
items count as one; an empty table gives none.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftnet.llm.words import WordHashes, words
from driftnet.session import cut_lineage

WINDOW = 12
SHINGLE = 5
BLOCKS, BLOCK_BITS, BLOCK_RADIUS = 4, 16, 5
RADIUS = BLOCKS * (BLOCK_RADIUS + 1) - 1
INDEX_WINDOWS = 500_000
SLAB_WORDS = 40_000
#: Candidates that are tested at a time, and windows that are fingerprinted at a time.
PIECE = 1 << 21
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)
#: All changes of at most BLOCK_RADIUS bits of a block.
_NEAR = np.array([sum(1 << b for b in bits) for k in range(BLOCK_RADIUS + 1) for bits in itertools.combinations(range(BLOCK_BITS), k)], np.int64)


def shingle_hashes(h: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hashes of all runs of ``size`` words, at most SHINGLE."""
    n = len(h) - size + 1
    out = np.zeros(max(n, 0), np.uint64)
    if n > 0:
        for i in range(size):
            out += (h[i : i + n] ^ (h[i : i + n] >> np.uint64(29))) * _ODD[i]
        out ^= out >> np.uint64(32)
        out *= _ODD[4]
        out ^= out >> np.uint64(29)
    return out


def place_weights(length: int, size: int) -> np.ndarray:
    """In how many shingles of a window each of its words stands."""
    return np.convolve(np.ones(length - size + 1, np.int64), np.ones(size, np.int64))


def fingerprints(windows: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """SimHash of each row of word hashes."""
    n, length = windows.shape
    weights = place_weights(length, size).astype(np.uint8)
    out = np.zeros(n, np.uint64)
    step = max(1, PIECE // (8 * length))
    for at in range(0, n, step):
        part = np.ascontiguousarray(windows[at : at + step])
        ones = np.unpackbits(part.view(np.uint8).reshape(len(part), length, 8), axis=2)
        total = np.zeros((len(part), 64), np.uint8)  # at most 40
        for i in range(length):
            total += ones[:, i] * weights[i]
        out[at : at + step] = np.packbits(total > int(weights.sum()) // 2, axis=1).reshape(-1).view(np.uint64)
    return out


def similarities(a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """Weighted shingle similarity of each two rows of words; 0 without a common shingle."""
    same = a == b
    weights = place_weights(a.shape[1], size)
    shared = np.lib.stride_tricks.sliding_window_view(same, size, axis=1).all(axis=2).any(axis=1)
    return np.where(shared, (same * weights).sum(axis=1) / weights.sum(), 0.0)


def distinct_rows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of the first of each kind of row, kind of each row). Rows are told apart
    by a hash and then compared in full."""
    key = np.zeros(len(rows), np.uint64)
    for i in range(rows.shape[1]):
        key = (key ^ rows[:, i] ^ (rows[:, i] >> np.uint64(31))) * _ODD[i % 5]
        key ^= key >> np.uint64(29)
    _, first, kind = np.unique(key, return_index=True, return_inverse=True)
    other = np.flatnonzero((rows != rows[first[kind]]).any(axis=1))  # two rows of one hash: kinds of their own
    kind[other] = len(first) + np.arange(len(other))
    return np.concatenate([first, other]), kind


def _spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each run of ``count``, one after the other."""
    return np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())


class WindowIndex:
    """The distinct windows of some items, of one length, found by their fingerprints."""

    def __init__(self, length: int, items: list[tuple[int, np.ndarray]]):
        self.length, self.size = length, min(SHINGLE, length)
        every = np.concatenate([np.lib.stride_tricks.sliding_window_view(h, length) for _, h in items])
        ids = np.repeat(np.array([i for i, _ in items], np.int64), [len(h) - length + 1 for _, h in items])
        first, kind = distinct_rows(every)
        self.words = np.ascontiguousarray(every[first])
        members = np.unique(np.stack([kind, ids], axis=1), axis=0)
        self.first_member, self.members = np.searchsorted(members[:, 0], np.arange(len(first) + 1)), members[:, 1]
        self.prints = fingerprints(self.words, self.size)
        self.shingles = np.unique(np.concatenate([shingle_hashes(h, self.size) for _, h in items]))
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.shingles >> np.uint64(44)] = True
        self.blocks = []
        for b in range(BLOCKS):
            value = self._block(self.prints, b)
            order = np.argsort(value, kind="stable")
            self.blocks.append((np.searchsorted(value[order], np.arange((1 << BLOCK_BITS) + 1)), order))

    @staticmethod
    def _block(prints: np.ndarray, b: int) -> np.ndarray:
        return ((prints >> np.uint64(b * BLOCK_BITS)) & np.uint64((1 << BLOCK_BITS) - 1)).astype(np.int64)

    def has_shingle(self, s: np.ndarray) -> np.ndarray:
        """Whether each shingle is one of an item."""
        known = self.maybe[s >> np.uint64(44)]
        at = np.flatnonzero(known)
        rank = np.minimum(np.searchsorted(self.shingles, s[at]), len(self.shingles) - 1)
        known[at] = self.shingles[rank] == s[at]
        return known

    def pairs(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in prints, item window) within the radius; no pair is missed."""
        found = [np.zeros((0, 2), np.int64)]
        if len(self.prints) <= BLOCKS * len(_NEAR):
            step = max(1, PIECE // (4 * len(self.prints)))
            for at in range(0, len(prints), step):
                pos, item = np.divmod(np.flatnonzero(np.bitwise_count(prints[at : at + step, None] ^ self.prints) <= RADIUS), len(self.prints))
                found.append(np.stack([pos + at, item], axis=1))
            both = np.concatenate(found)
            return both[:, 0], both[:, 1]
        for b, (starts, order) in enumerate(self.blocks):
            value = self._block(prints, b)
            step = max(1, PIECE // (8 * len(_NEAR)))
            for at in range(0, len(prints), step):
                probe = value[at : at + step, None] ^ _NEAR
                count = starts[probe + 1] - starts[probe]
                place, near = np.nonzero(count)
                count, low = count[place, near], starts[probe[place, near]]
                cuts = np.searchsorted(np.cumsum(count), np.arange(PIECE, count.sum() + PIECE, PIECE), "left") + 1 if len(count) else []
                for lo, hi in zip([0, *cuts], cuts):
                    c = count[lo:hi]
                    pos, item = np.repeat(place[lo:hi] + at, c), order[_spread(low[lo:hi], c)]
                    ok = np.bitwise_count(prints[pos] ^ self.prints[item]) <= RADIUS
                    found.append(np.stack([pos[ok], item[ok]], axis=1))
        both = np.unique(np.concatenate(found), axis=0)
        return both[:, 0], both[:, 1]

    def matches(self, windows: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of windows, item, similarity) of each item with a window so similar to the row; the best of each."""
        pos, kind = self.pairs(fingerprints(windows, self.size))
        # similar windows agree in one of some words: together these weigh more than may differ
        weights = place_weights(self.length, self.size)
        heavy = np.argsort(-weights, kind="stable")
        heavy = heavy[: 1 + np.searchsorted(np.cumsum(weights[heavy]), (1 - least) * weights.sum() + 1e-9, "right")]
        agree = np.zeros(len(pos), bool)
        for w in heavy:
            agree |= windows[:, w][pos] == self.words[:, w][kind]
        pos, kind = pos[agree], kind[agree]
        score = np.concatenate([similarities(windows[pos[i : i + 65536]], self.words[kind[i : i + 65536]], self.size) for i in range(0, len(pos), 65536)] or [np.zeros(0)])
        ok = score >= least
        pos, kind, score = pos[ok], kind[ok], score[ok]
        count = self.first_member[kind + 1] - self.first_member[kind]
        pos, item, score = np.repeat(pos, count), self.members[_spread(self.first_member[kind], count)], np.repeat(score, count)
        order = np.lexsort((-score, item, pos))
        pos, item, score = pos[order], item[order], score[order]
        new = np.ones(len(pos), bool)
        new[1:] = (pos[1:] != pos[:-1]) | (item[1:] != item[:-1])
        return pos[new], item[new], score[new]

    def links(self, of: np.ndarray, h: np.ndarray, starts: np.ndarray, least: float) -> Iterator[tuple[int, int, int, int, float]]:
        """(document, item, windows, verbatim ones, best similarity) of a slab: word hashes h
        of documents ``of``, with windows from the places where starts is true."""
        n = len(h) - self.length + 1
        if n <= 0:
            return
        known = np.concatenate([[0], np.cumsum(self.has_shingle(shingle_hashes(h, self.size)))])
        m = self.length - self.size + 1
        at = np.flatnonzero((known[m:] > known[:-m]) & starts[:n] & (of[:n] == of[self.length - 1 :]))
        if not len(at):
            return
        mine = np.lib.stride_tricks.sliding_window_view(h, self.length)[at]
        first, kind = distinct_rows(mine)
        pos, item, score = self.matches(mine[first], least)
        if not len(pos):
            return
        held, times = np.unique(np.stack([of[at], kind], axis=1), axis=0, return_counts=True)  # (document, window)
        low = np.searchsorted(pos, held[:, 1], "left")
        count = np.searchsorted(pos, held[:, 1], "right") - low
        which = _spread(low, count)
        times, whole = np.repeat(times, count), score[which] == 1.0
        docs, items = np.repeat(held[:, 0], count), item[which]
        order = np.lexsort((items, docs))
        cut = np.flatnonzero(np.concatenate([[True], (np.diff(docs[order]) != 0) | (np.diff(items[order]) != 0)]))
        yield from zip(
            docs[order][cut].tolist(), items[order][cut].tolist(), np.add.reduceat(times[order], cut).tolist(),
            np.add.reduceat((times * whole)[order], cut).tolist(), np.maximum.reduceat(score[which][order], cut).tolist(),
        )


def window_indexes(items: list[tuple[int, str]]) -> list[WindowIndex]:
    """An index per length of window: WINDOW, and those of shorter items."""
    cache, by_length = WordHashes(), {}
    for item_id, text in items:
        h = cache.of(words(text or ""))
        if len(h):
            by_length.setdefault(min(len(h), WINDOW), []).append((item_id, h))
    return [WindowIndex(length, some) for length, some in sorted(by_length.items())]


def _slabs(hashes: Iterator[tuple[int, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document, word hash, may a window start here) of pieces of about SLAB_WORDS words. A
    longer text is cut in overlapping pieces, so that each window starts in one of them."""
    held: list[tuple[int, np.ndarray, int]] = []
    size = 0
    for place, h in hashes:
        for at in range(0, len(h), SLAB_WORDS):
            piece = h[at : at + SLAB_WORDS + WINDOW - 1]
            held.append((place, piece, min(SLAB_WORDS, len(h) - at)))
            size += len(piece)
            if size >= SLAB_WORDS:
                yield _joined(held)
                held, size = [], 0
    if held:
        yield _joined(held)


def _joined(held: list[tuple[int, np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = [len(h) for _, h, _ in held]
    starts = np.concatenate([np.arange(len(h)) < n for _, h, n in held])
    return np.repeat(np.array([p for p, _, _ in held]), sizes), np.concatenate([h for _, h, _ in held]), starts


_SCHEMA = "doc_no long, item_id long, windows long, verbatim long, similarity double"
_ARROW = pa.schema([("doc_no", pa.int64()), ("item_id", pa.int64()), ("windows", pa.int64()), ("verbatim", pa.int64()), ("similarity", pa.float64())])
_HASHED = pa.schema([("doc_no", pa.int64()), ("words", pa.list_(pa.int64()))])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as the hashes of their words."""
    cache = WordHashes()
    for batch in batches:
        yield pa.record_batch([batch.column(0), pa.array([cache.of(words(t)).view(np.int64) if t else [] for t in batch.column(1).to_pylist()], _HASHED[1].type)], schema=_HASHED)


def leaked_passages(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = 0.8, verbatim: bool = False) -> DataFrame:
    """(doc_id, item_id, windows, verbatim, similarity) of each document and item that
    share a window at least this similar: the windows of the document that do, those of
    them that are the same words, and the best similarity. With verbatim only links
    with WINDOW words that are the same."""
    spark = docs.sparkSession
    items = items.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text")
    rough = items.agg(F.coalesce(F.sum(F.length("text") / 2), F.lit(0)).cast("long")).first()[0]
    parts = max(1, -(-rough // INDEX_WINDOWS))
    source = docs.select(F.col(doc_id).cast("long").alias("doc_no"), F.col(text).alias("text"))
    if parts > 1:
        source = cut_lineage(source.mapInArrow(_hashed, "doc_no long, words array<long>"))
    out = None
    for part in range(parts):
        some = items.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part) if parts > 1 else items
        shared = spark.sparkContext.broadcast([(r[0], r[1]) for r in some.collect()])

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            indexes, cache = window_indexes(shared.value), WordHashes()
            if not indexes:
                return
            for batch in batches:
                ids, told = batch.column(0).to_pylist(), batch.column(1)
                if told.type == pa.string():
                    hashes = ((i, cache.of(words(t))) for i, t in enumerate(told.to_pylist()) if t)
                else:
                    hashes = ((i, np.asarray(told[i].values).view(np.uint64)) for i in range(len(ids)))
                # a document is named by its place in the batch, so that repeated and null ids stay apart
                best: dict[tuple[int, int], list] = {}
                for slab in _slabs(hashes):
                    for index in indexes:
                        for place, item, n, exact, score in index.links(*slab, least):
                            b = best.setdefault((place, item), [0, 0, 0.0])
                            b[0], b[1], b[2] = b[0] + n, b[1] + (exact if index.length == WINDOW else 0), max(b[2], score)
                rows = [(ids[p], i, *b) for (p, i), b in best.items() if b[1] or not verbatim]
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 5, _ARROW)], schema=_ARROW)

        one = source.mapInArrow(run, _SCHEMA)
        out = one if out is None else out.unionByName(one)
    return out.withColumnRenamed("doc_no", doc_id)


def edited_passages(items: DataFrame, docs: DataFrame, per_item: int = 12) -> DataFrame:
    """(doc_id, text, item_id, changed): documents into which a passage of an item was put of
    which 1 to 3 words were changed; passages of 12 to 60 words. For measuring recall."""
    w = items.where(F.col("item_id").isNotNull()).select(
        F.col("item_id").cast("long").alias("item_id"), F.filter(F.split(F.lower("text"), r"[^\p{L}\p{Nd}]+"), lambda x: x != "").alias("w")
    ).where(F.size("w") >= WINDOW)
    many = w.select("item_id", "w", F.explode(F.sequence(F.lit(0), F.lit(per_item - 1))).alias("copy"))

    def draw(what: str, below) -> F.Column:
        return F.pmod(F.xxhash64(F.lit(what), "item_id", "copy"), below.cast("long")).cast("int")

    cut = many.withColumn("n", F.least(F.size("w"), 12 + draw("length", F.lit(49)))).withColumn("at", draw("start", F.size("w") - F.col("n") + 1))
    cut = cut.withColumn("changed", 1 + F.pmod(F.col("copy"), F.lit(3)).cast("int")).withColumn("p", F.slice("w", F.col("at") + 1, F.col("n")))
    order = F.array_sort(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.struct(F.xxhash64("item_id", "copy", i).alias("h"), i.alias("i"))))
    hit = cut.withColumn("hit", F.transform(F.slice(order, 1, F.col("changed")), lambda x: x["i"]))
    edited = hit.withColumn("p", F.transform("p", lambda x, i: F.when(F.array_contains("hit", i), F.concat(F.lit("zq"), F.substring(F.md5(x), 1, 6))).otherwise(x)))
    doc = edited.select((F.col("item_id") * per_item + F.col("copy")).alias("doc_id"), "item_id", "changed", F.array_join("p", " ").alias("passage"))
    hosts = docs.select("doc_id", F.col("text").alias("host")).join(doc.select("doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    half = (F.length(F.coalesce("host", F.lit(""))) / 2).cast("int")
    return doc.join(hosts, "doc_id", "left").select(
        "doc_id", "item_id", "changed",
        F.concat_ws(" ", F.substring(F.col("host"), F.lit(1), half), "passage", F.substring(F.col("host"), half + 1, F.length("host"))).alias("text"),
    )
