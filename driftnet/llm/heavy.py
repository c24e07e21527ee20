"""The most frequent values of a column with too many distinct values to count.

Method: exact prefix refinement. All rows are counted by a short prefix of the
value, prefixes that cannot reach the bound are dropped, and what is left is
counted again by a longer prefix until full values remain. A group knows the
least and greatest value in it; where they are equal the value is resolved
early, with its exact count. A round holds at most (kept prefixes) x 16**STEP
counters, however many distinct values there are; with a share bound at most
1/share prefixes are kept.

What a round keeps is a table in the shared folder. Up to KEEP_MAX prefixes are
broadcast, so that only their rows are counted again. If a bound keeps more (many
values tie, or it is low), the rows are counted by their whole values at once: the
result is then of the order of the table, and a spilling aggregate is its exact way.

Values are hex texts of fixed width (canonical hashes), written once to the shared
folder as three numbers each; null is counted in the denominator only. Counts are
exact. Ties at the k-th place are all returned. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftnet.session import cut_lineage

WIDTH = 40
STEP = 4
_PARTS = [(1, 15), (16, 15), (31, 10)]
_NUMBERS = [f"n{i}" for i in range(len(_PARTS))]
#: Prefixes that are broadcast: the number of counters of the first round.
KEEP_MAX = 16**STEP


def _numbered(df: DataFrame, value: Column) -> DataFrame:
    """The values as three numbers that order like them; null values are left out."""
    named = df.select(value.alias("value")).where(F.col("value").isNotNull())
    return named.select(*[F.conv(F.substring("value", at, n), 16, 10).cast("long").alias(c) for c, (at, n) in zip(_NUMBERS, _PARTS)])


def _prefix(width: int) -> list[Column]:
    """The first digits of a value, as the numbers p0, p1 and p2."""
    out = []
    for i, (c, (at, n)) in enumerate(zip(_NUMBERS, _PARTS)):
        digits = min(max(width - at + 1, 0), n)
        out.append((F.shiftright(c, 4 * (n - digits)) if digits else F.lit(0).cast("long")).alias(f"p{i}"))
    return out


def _count_prefixes(rows: DataFrame, width: int) -> DataFrame:
    """(p0, p1, p2, n, value): value is set where a prefix holds a single one."""
    ends = [f(c).alias(f"{f.__name__}_{c}") for c in _NUMBERS for f in (F.min, F.max)]
    pure = F.lit(True)
    for c in _NUMBERS:
        pure = pure & (F.col(f"min_{c}") == F.col(f"max_{c}"))
    whole = F.concat(*[F.lpad(F.lower(F.hex(f"min_{c}")), n, "0") for c, (_, n) in zip(_NUMBERS, _PARTS)])
    grouped = rows.groupBy(*_prefix(width)).agg(F.count(F.lit(1)).alias("n"), *ends)
    return grouped.select("p0", "p1", "p2", "n", F.when(pure, whole).alias("value"))


def _rows_of(values: DataFrame, kept: DataFrame, width: int) -> DataFrame:
    """The values with one of at most KEEP_MAX prefixes."""
    live = F.broadcast(kept.select(*[F.col(f"p{i}").alias(f"k{i}") for i in range(3)]))
    same = [p == F.col(f"k{i}") for i, p in enumerate(_prefix(width))]
    return values.join(live, same[0] & same[1] & same[2], "left_semi")


def _refine(values: DataFrame, at_least: int) -> DataFrame:
    """(value, n): all values that occur at_least times."""
    found, rows, width = None, values, STEP
    while True:
        heavy = cut_lineage(_count_prefixes(rows, width).where(F.col("n") >= at_least))
        whole = heavy.where(F.col("value").isNotNull()).select("value", "n")
        found = whole if found is None else found.unionByName(whole)
        kept = heavy.where(F.col("value").isNull())
        n = kept.count()
        if not n:
            return found
        if n <= KEEP_MAX:
            rows, width = _rows_of(values, kept, width), min(width + STEP, WIDTH)
        else:
            resolved = found.select(F.col("value"))
            every = _count_prefixes(values, WIDTH).where(F.col("n") >= at_least).select("value", "n")
            return found.unionByName(every.join(resolved, "value", "left_anti"))


def _beam(values: DataFrame, k: int) -> int:
    """A lower bound of the k-th largest count: the exact counts of the values
    found by following only the heaviest prefixes."""
    found: list[int] = []
    rows, width = values, STEP
    while True:
        best = cut_lineage(_count_prefixes(rows, width).orderBy(F.desc("n"), "p0", "p1", "p2").limit(4 * k))
        held = [(r["n"], r["value"] is None) for r in best.collect()]  # 4 k rows
        found += [n for n, open_ in held if not open_]
        if not any(open_ for _, open_ in held):
            break
        rows, width = _rows_of(values, best.where(F.col("value").isNull()), width), min(width + STEP, WIDTH)
    found.sort(reverse=True)
    return found[k - 1] if len(found) >= k else 1


def values_over_share(df: DataFrame, value: Column, share: float) -> DataFrame:
    """(value, n, total): each value that at least this share of all rows has."""
    total = df.count()
    values = cut_lineage(_numbered(df, value))
    found = _refine(values, max(1, _ceil_share(total, share)))
    return found.withColumn("total", F.lit(total).cast("long"))


def _ceil_share(total: int, share: float) -> int:
    """The least count n with n/total >= share, for shares of whole millionths."""
    return -(-total * round(share * 1_000_000) // 1_000_000)


def top_values(df: DataFrame, value: Column, k: int) -> DataFrame:
    """(value, n): the k most frequent values and all that tie with the last."""
    values = cut_lineage(_numbered(df, value))
    found = _refine(values, _beam(values, k))
    best = [r["n"] for r in found.orderBy(F.desc("n")).limit(k).collect()]
    return found.where(F.col("n") >= (best[-1] if best else 1))
