"""Mixing sources to target shares of tokens.

Method: Poisson replication. A source's mean repetition rate follows from its
share, its size and its repeat limit. A document's count is a hash-seeded
uniform number put through the inverse of a Poisson distribution that is cut off
at the limit and whose mean is that rate; the document is exploded by its count
and the copies are put in a global order by a second hash. Nothing depends on
the order or the partitioning of the input.

Rates: of a total of T tokens (default: all tokens of the listed sources) each
source is due share * T. A source that cannot reach this within its limit gives
limit * size; what is left of T goes to the others in proportion to their
shares, so that T is reached if any set of rates within the limits reaches it.

Defined results: sources that are not listed, null sources and documents without
tokens are not drawn; a listed source without documents is reported with zero;
null shares and limits count as 0; repeated documents are drawn each by their own
key, or alike if all their columns are equal; empty tables give a report of zeros.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftnet.session import cut_lineage

SEED = 20_250_310
#: Listed sources are held on the driver; more than this many are refused.
MAX_SOURCES = 100_000
TOKENIZER = "byte_bpe_50k.tiktoken"


def with_token_counts(docs: DataFrame, text: str = "text", tokenizer: str = TOKENIZER, path: str | None = None) -> DataFrame:
    """docs with n_tokens by a public byte-level tokenizer instead of the text
    column. A null text has 0 tokens. path overrides where the file lies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers
        import tiktoken

        with open(path or public_tokenizers.path(tokenizer), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        coder = tiktoken.Encoding("counts", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            n = [len(coder.encode_ordinary(t)) if t else 0 for t in batch.column(batch.num_columns - 1).to_pylist()]
            cols = [*batch.columns[:-1], pa.array(n, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names[:-1], "n_tokens"])

    keep = [c for c in docs.columns if c.lower() not in (text.lower(), "n_tokens")]
    schema = docs.select(*keep).schema.add("n_tokens", "long")
    return docs.select(*keep, text).mapInArrow(run, schema)


def rates(sizes: dict[str, int], targets: list[tuple[str, float, int]], total: float | None = None) -> dict[str, float]:
    """Mean repetitions per source; see the module text."""
    due = {s: (max(0.0, w or 0.0), max(0, c or 0)) for s, w, c in targets}
    live = {s for s, (w, c) in due.items() if w > 0 and c > 0 and sizes.get(s, 0) > 0}
    left = float(sum(sizes.get(s, 0) for s in due) if total is None else total)
    out = {s: 0.0 for s in due}
    while live:
        scale = left / sum(due[s][0] for s in live)
        full = {s for s in live if due[s][0] * scale >= due[s][1] * sizes[s]}
        for s in full or live:
            out[s] = float(due[s][1]) if full else due[s][0] * scale / sizes[s]
        if not full:
            break
        left = max(0.0, left - sum(due[s][1] * sizes[s] for s in full))
        live -= full
    return out


def poisson_steps(rate: float, limit: int) -> list[float]:
    """The points where a uniform number turns into the next count: the
    cumulative distribution of min(Poisson(m), limit), with m such that its
    mean is rate."""
    if rate <= 0 or limit <= 0:
        return []
    if rate >= limit:
        return [0.0] * limit

    log_k = np.array([math.lgamma(k + 1) for k in range(limit)])

    def steps(m: float) -> np.ndarray:
        # in logarithms, as exp(-m) is 0 from about 745 on
        return np.minimum(np.cumsum(np.exp(np.arange(limit) * math.log(m) - m - log_k)), 1.0)

    def mean(m: float) -> float:
        return float((1 - steps(m)).sum())

    low, high = 0.0, 1.0
    while mean(high) < rate:  # ends: the mean comes as near to the limit as numbers do
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if mean(mid) < rate else (low, mid)
    return steps(high).tolist()


def _uniform(*cols: Column) -> Column:
    return (F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") + 0.5) / float(1 << 53)


def mix(counted: DataFrame, targets: DataFrame, key: str = "doc_id", total: float | None = None, seed: int = SEED) -> DataFrame:
    """The drawn copies: columns of counted (those called like an added one are replaced), ``copy`` (from 1) and ``position``,
    a uniform number by which the rows are globally ordered. counted has source
    and n_tokens and is read twice."""
    listed = targets.groupBy("source").agg(F.max("target_share").alias("w"), F.max("max_repeats").alias("c"))
    wanted = [(r[0], r[1], r[2]) for r in listed.where(F.col("source").isNotNull()).limit(MAX_SOURCES + 1).collect()]
    if len(wanted) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} listed sources")
    names = counted.sparkSession.createDataFrame([(s,) for s, _, _ in wanted], "source string")
    sums = counted.join(F.broadcast(names), "source", "left_semi").groupBy("source").agg(F.sum("n_tokens"))
    sizes = {r[0]: r[1] or 0 for r in sums.collect()}
    mean = rates(sizes, wanted, total)
    rows = [(s, poisson_steps(mean[s], c or 0)) for s, _, c in wanted]
    plan = counted.sparkSession.createDataFrame(rows, "source string, steps array<double>")  # a row per listed source
    counted = counted.drop("steps", "copy", "position", "__n")
    drawn = counted.where(F.col("n_tokens") > 0).join(F.broadcast(plan), "source")
    u = _uniform(F.lit(seed), F.col(key), F.col("source"))
    counts = drawn.select("*", F.size(F.filter("steps", lambda x: x <= u)).alias("__n")).where(F.col("__n") > 0)
    copies = counts.select(*counted.columns, F.explode(F.sequence(F.lit(1), F.col("__n"))).alias("copy"))
    return copies.select("*", _uniform(F.lit(seed + 1), F.col(key), F.col("copy")).alias("position")).orderBy("position", key, "copy")


def shares(counted: DataFrame, mixture: DataFrame, targets: DataFrame) -> DataFrame:
    """Per listed source: target and reached share, tokens there are and were drawn, documents drawn."""
    have = counted.groupBy("source").agg(F.sum("n_tokens").alias("available_tokens"))
    got = mixture.groupBy("source").agg(F.sum("n_tokens").alias("drawn_tokens"), F.count(F.lit(1)).alias("drawn_documents"), F.max("copy").alias("most_copies"))
    zero = {c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("available_tokens", "drawn_tokens", "drawn_documents", "most_copies")}
    joined = targets.join(have, "source", "left").join(got, "source", "left")
    everything = Window.partitionBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # a row per listed source
    return joined.select(
        "source", "target_share", "max_repeats", *zero.values(),
        F.coalesce(F.col("drawn_tokens") / F.sum("drawn_tokens").over(everything), F.lit(0.0)).alias("reached_share"),
    )


def count_once(docs: DataFrame, **kw: str) -> DataFrame:
    """Token counts written to the shared folder, as they are read several times."""
    return cut_lineage(with_token_counts(docs, **kw))
