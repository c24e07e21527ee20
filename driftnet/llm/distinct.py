"""Distinct counts over identifier sets that are too large to hold.

Method: multiresolution bitmaps. A hash sends each identifier to a slice with
geometric probability (slice i gets 2**-(i+1) of all, the last what is left)
and to one of SLICE_BITS bits there. Bitmaps are merged by OR, so partial
results of batches, days or groups combine into exactly the bitmap of the
union. An estimate sums linear counts of the unsaturated slices and scales by
the share of identifiers that reaches them.

Error: the first slice used has a load between SLICE_LOAD/2 and SLICE_LOAD (or
is slice 0), which gives a standard error of at most 1.5 % at any cardinality up
to CAPACITY; ERROR_BOUND is three of them (99.7 %), at least one identifier.

State: 40 slices of 4096 bits, 20 KB per group at most, whatever its size. Rows
are reduced to distinct set bits by a map-side hash aggregate; at most that many
are shuffled per task and group.

Defined results: null identifiers are not counted; a null group value is a
group of its own, told from "all" by the grouping mask; an empty table gives no
rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLICES = 40
SLICE_BITS = 4096
#: A slice whose load would exceed this (fill above 1 - exp(-load)) counts as saturated.
SLICE_LOAD = 1.6
SET_MAX = int(SLICE_BITS * (1 - math.exp(-SLICE_LOAD)))
ERROR_BOUND = 0.045
CAPACITY = SLICE_BITS << (SLICES - 1)
_CHUNK_BITS = 32768
_CHUNK_SLICES = _CHUNK_BITS // SLICE_BITS
_SLICE_BYTES = SLICE_BITS // 8


def bit_position(identifier: Column) -> Column:
    """Position of an identifier's bit over all slices. The 60 leading bits of
    its MD5 digest give the slice by trailing zeros and the bit by the 12 top bits."""
    h = F.conv(F.substring(F.md5(identifier.cast("binary")), 1, 15), 16, 10).cast("long")
    zeros = F.bit_count(h.bitwiseAND(-h) - F.lit(1)).cast("int")
    slice_no = F.when(h == 0, SLICES - 1).otherwise(F.least(zeros, F.lit(SLICES - 1)))
    return (slice_no * SLICE_BITS + F.shiftright(h, 48).cast("int")).cast("int")


def partial_bitmaps(df: DataFrame, groups: Sequence[str], identifiers: dict[str, str]) -> DataFrame:
    """Mergeable partial results: groups, field, chunk, bitmap. identifiers maps
    the name of a field to its (canonical text) column."""
    fields = F.array(*[F.struct(F.lit(n).alias("field"), F.col(c).cast("string").alias("v")) for n, c in identifiers.items()])
    seen = df.select(*groups, F.explode(fields).alias("__f")).select(
        *groups, F.col("__f.field").alias("field"), bit_position(F.col("__f.v")).alias("__pos")
    )
    bits = seen.where(F.col("__pos").isNotNull()).distinct()
    return bits.groupBy(*groups, "field", F.floor(F.col("__pos") / _CHUNK_BITS).cast("int").alias("chunk")).agg(
        F.expr(f"bitmap_construct_agg(cast(__pos % {_CHUNK_BITS} as bigint))").alias("bitmap")
    )


def merge_bitmaps(partials: DataFrame, groups: Sequence[str]) -> DataFrame:
    """The bitmaps of the unions of all partial results with equal groups."""
    return partials.groupBy(*groups, "field", "chunk").agg(F.expr("bitmap_or_agg(bitmap)").alias("bitmap"))


def combinations(partials: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Partial results for each subset of the groups: a group that is summed
    over is null and has its bit set in ``grouping`` (first group = highest bit)."""
    n = len(groups)
    masks = partials.select("*", F.explode(F.sequence(F.lit(0), F.lit((1 << n) - 1))).alias("grouping"))
    out = masks.select(
        *[F.when(F.col("grouping").bitwiseAND(F.lit(1 << (n - 1 - i))) == 0, F.col(g)).alias(g) for i, g in enumerate(groups)],
        "grouping", "field", "chunk", "bitmap",
    )
    return merge_bitmaps(out, [*groups, "grouping"])


def estimates(bitmaps: DataFrame, groups: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """One row per group with the estimated distinct count of each field."""
    counted = F.transform(
        F.sequence(F.lit(0), F.lit(_CHUNK_SLICES - 1)),
        lambda i: F.struct(
            (F.col("chunk") * _CHUNK_SLICES + i).alias("s"),
            F.bitmap_count(F.substring(F.col("bitmap"), i * _SLICE_BYTES + 1, F.lit(_SLICE_BYTES))).alias("set"),
        ),
    )
    rows = bitmaps.select(*groups, "field", F.explode(counted).alias("c")).select(*groups, "field", "c.*")
    base = rows.groupBy(*groups, "field").agg(
        F.coalesce(F.max(F.when(F.col("set") > SET_MAX, F.col("s"))) + 1, F.lit(0)).alias("base"),
        F.collect_list(F.struct("s", "set")).alias("slices"),  # at most SLICES entries
    )
    linear = F.aggregate(
        F.filter(F.array_sort("slices"), lambda x: x["s"] >= F.col("base")),
        F.lit(0.0),
        lambda acc, x: acc + SLICE_BITS * F.log(SLICE_BITS / (SLICE_BITS - F.least(x["set"], F.lit(SLICE_BITS - 1))).cast("double")),
    )
    scale = F.pow(F.lit(2.0), F.col("base").cast("double"))
    each = base.select(*groups, "field", F.round(linear * scale).cast("long").alias("estimate"))
    return each.groupBy(*groups).agg(
        *[F.coalesce(F.max(F.when(F.col("field") == f, F.col("estimate"))), F.lit(0)).cast("long").alias(f) for f in fields]
    )
