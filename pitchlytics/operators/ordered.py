"""Running totals over a sort order without sorting a whole group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import settle


def running_totals(
    df: DataFrame, by: Sequence[str], order: Sequence[str], columns: Sequence[str], previous: Sequence[str] = ()
) -> DataFrame:
    """Each row with ``<c>_before``, the sum of ``c`` over the earlier rows of its group, and
    ``<c>_all``, the sum over the group, for every column ``c``; with ``<c>_previous``, the value
    of the row before it in its group, for every column of ``previous``.

    Rows are range-partitioned on group and order and that placement is written down, since
    a recomputed range partitioning may draw other boundaries. A slice is an equal share of
    the rows however they are spread over groups and values. Totals run inside a slice; one
    row per group and slice carries them across slices. ``by`` must not be NULL, NULLs in
    ``order`` come last and rows should be distinct in ``by`` and ``order``."""
    ordering = [F.col(c).asc_nulls_last() for c in order]
    # no partition number: adaptive execution merges neighbouring ranges of a small input
    placed = df.repartitionByRange(*by, *ordering).withColumn("slice", F.spark_partition_id())
    placed = settle(placed, "slices")

    whole = Window.partitionBy(*by)
    earlier = whole.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    last = F.struct(*(x for c in order for x in (F.col(c).isNull(), F.col(c))))
    offsets = placed.groupBy(*by, "slice").agg(
        *(F.sum(c).alias(c) for c in columns), *(F.max_by(c, last).alias(f"{c}_last") for c in previous)
    )
    offsets = offsets.select(
        *by,
        "slice",
        *(_sum(c, earlier).alias(f"{c}_offset") for c in columns),
        *(_sum(c, whole).alias(f"{c}_all") for c in columns),
        *(F.lag(f"{c}_last").over(whole.orderBy("slice")).alias(f"{c}_carried") for c in previous),
    )
    before = Window.partitionBy(*by, "slice").orderBy(*ordering).rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*by, "slice").orderBy(*ordering)
    out = placed.withColumns(
        {f"{c}_before": _sum(c, before) for c in columns} | {f"{c}_previous": F.lag(c).over(inside) for c in previous}
        | ({"first": F.row_number().over(inside) == 1} if previous else {})
    )
    out = out.join(offsets, [*by, "slice"])
    out = out.withColumns(
        {f"{c}_before": F.col(f"{c}_before") + F.col(f"{c}_offset") for c in columns}
        | {f"{c}_previous": F.when(F.col("first"), F.col(f"{c}_carried")).otherwise(F.col(f"{c}_previous")) for c in previous}
    )
    return out.drop("slice", "first", *(f"{c}_offset" for c in columns), *(f"{c}_carried" for c in previous))


def _sum(c: str, window) -> Column:
    return F.coalesce(F.sum(c).over(window), F.lit(0))


def quantiles(counts: DataFrame, value: str, weight: str, probs: Sequence[float]) -> DataFrame:
    """One row ``e``: linearly interpolated quantiles of ``value`` occurring ``weight`` times,
    one row per distinct value. Each is found by its rank in running totals. NULL without rows."""
    ranked = running_totals(counts, [], [value], [weight])
    total, first = F.col(f"{weight}_all"), F.col(f"{weight}_before")
    ends = []
    for i, p in enumerate(probs):
        place = (total - 1) * F.lit(p)
        for name, at in ((f"lo{i}", F.floor(place)), (f"hi{i}", F.ceil(place))):
            here = (first <= at) & (at < first + F.col(weight))
            ends.append(F.max(F.when(here, F.col(value))).alias(name))
    found = ranked.agg(F.max(total).alias(f"{weight}_all"), *ends)
    edges = []
    for i, p in enumerate(probs):
        place = (total - 1) * F.lit(p)
        lo, hi = F.col(f"lo{i}"), F.col(f"hi{i}")
        edges.append(lo + (hi - lo) * (place - F.floor(place)))
    return found.select(F.when(total.isNotNull(), F.array(*edges)).alias("e"))
