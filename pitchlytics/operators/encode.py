"""Quantile groups of players and integer labels of categories."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import settle
from .ordered import quantiles, running_totals

# Group names from the lowest to the highest whiff rate.
THREE_GROUPS = ("Low", "Medium", "High")
SIX_GROUPS = ("Very_Low", "Low", "Medium", "Med_High", "High", "Extreme")

#: Digits kept when a rate is compared with a quantile edge, so that the last bit of an
#: interpolated edge never moves a player to another group.
EDGE_DIGITS = 9

UNSEEN = -1


def _edges(counts: DataFrame, rate: str, sizes: Sequence[int]) -> Column:
    """Rounded quantile edges, one array per number of groups in ``sizes``, from players per
    distinct rate, as one scalar subquery. Raises on equal edges."""
    probs = [k / q for q in sizes for k in range(q + 1)]
    exact = quantiles(counts, rate, "players", probs)
    rounded = exact.select(F.transform("e", lambda e: F.round(e, EDGE_DIGITS)).alias("e"))
    repeated = F.raise_error(F.lit("quantile edges are not unique")).cast("array<double>")
    arrays, start = [], 1
    for q in sizes:
        own = F.slice("e", start, q + 1)
        arrays.append(F.when(F.size(F.array_distinct(own)) < F.size(own), repeated).otherwise(own))
        start += q + 1
    return rounded.select(F.array(*arrays)).scalar()


def _group_of(rate: Column, edges: Column, names: Sequence[str]) -> Column:
    value = F.round(rate, EDGE_DIGITS)
    out = F.when(rate.isNull(), F.lit(None).cast("string"))
    for k, name in enumerate(names[:-1], start=1):
        out = out.when(value <= edges[k], name)
    return out.otherwise(names[-1])


def quantile_groups(rates: DataFrame, groups: Mapping[str, Sequence[str]], rate="whiff_rate") -> DataFrame:
    """Add one column per entry of ``groups``, the name of the quantile group of ``rate``.

    Groups are right-closed bins on linearly interpolated quantiles; equal edges raise.
    ``rates`` has one row per player and is read twice (edges, rows), so hand in a settled
    table when it comes from a large scan. Edges are found by rank in a range-partitioned order."""
    counts = rates.where(F.col(rate).isNotNull()).groupBy(rate).agg(F.count(F.lit(1)).alias("players"))
    edges = _edges(counts, rate, [len(names) for names in groups.values()])
    return rates.withColumns(
        {name: _group_of(F.col(rate), edges[i], names) for i, (name, names) in enumerate(groups.items())}
    )


def _is_integer(dtype: str) -> bool:
    return dtype in ("tinyint", "smallint", "int", "bigint")


def value_counts(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), label: str | None = None) -> DataFrame:
    """Distinct values of several columns from one scan: ``(col, num, value, *by, n[, whiffs])``.
    Integer columns fill ``num``, the others ``value``."""
    types = dict(df.dtypes)
    entries = []
    for c in cols:
        number = _is_integer(types[c])
        entries.append(
            F.struct(
                F.lit(c).alias("col"),
                (F.col(c).cast("bigint") if number else F.lit(None).cast("bigint")).alias("num"),
                (F.lit(None).cast("string") if number else F.col(c).cast("string")).alias("value"),
            )
        )
    kept = [*by, *([label] if label else [])]
    sums = [F.count(F.lit(1)).alias("n")] + ([F.sum(label).cast("bigint").alias("whiffs")] if label else [])
    return (
        df.select(*kept, F.explode(F.array(*entries)).alias("e"))
        .select("e.*", *kept)
        .groupBy("col", "num", "value", *by)
        .agg(*sums)
    )


def labels_of(values: DataFrame) -> DataFrame:
    """0-based index of each value in sorted order per column, a NULL value last.

    ``values`` holds ``(col, num, value)``; the order of a column is range-partitioned."""
    distinct = values.select("col", "num", "value").distinct().withColumn("one", F.lit(1))
    numbered = running_totals(distinct, ["col"], ["num", "value"], ["one"]).withColumnRenamed("one_before", "idx")
    text = F.coalesce("value", F.col("num").cast("string"))
    return numbered.select("col", text.alias("value"), F.col("idx").cast("int").alias("idx"))


def fit_labels(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Label table ``(col, value, idx)``: integers in numeric order, text in byte order."""
    return labels_of(settle(value_counts(df, cols), "values"))


#: Labels of a column up to which they become a map in the projection instead of a join.
LITERAL_LABELS = 256


def _literal_index(values: Column, pairs: Sequence[tuple[str | None, int]]) -> Column:
    """Index of a value in a short closed list, NULL for others."""
    known = [F.lit(x) for value, idx in pairs if value is not None for x in (value, idx)]
    found = F.element_at(F.create_map(*known), values.cast("string")) if known else F.lit(None).cast("int")
    null_idx = next((idx for value, idx in pairs if value is None), None)
    return F.when(values.isNull(), F.lit(null_idx).cast("int")).otherwise(found)


def apply_labels(df: DataFrame, labels: DataFrame, cols: Sequence[str], fit_missing: bool = False) -> DataFrame:
    """Add ``<col>_idx`` for every column, -1 for values the labels do not know.

    With ``fit_missing`` a column absent from the label table gets labels fitted on ``df``.
    A column of at most ``LITERAL_LABELS`` labels is looked up in the projection, without a
    join. The others, players in practice, are joined to a table of their own labels, so the
    planner knows its size; hot values fall under the split of skewed joins. ``labels`` is read
    a few times and should be a settled table."""
    types = dict(df.dtypes)
    if fit_missing:
        known = {r["col"] for r in labels.select("col").distinct().collect()}
        missing = [c for c in cols if c not in known]
        if missing:
            labels = settle(labels.unionByName(fit_labels(df, missing)), "labels")
    own = labels.where(F.col("col").isin(list(cols)))
    sizes = {r["col"]: r["count"] for r in own.groupBy("col").count().collect()}  # one row per column
    short = [c for c in cols if sizes.get(c, 0) <= LITERAL_LABELS]
    pairs: dict[str, list[tuple[str | None, int]]] = {c: [] for c in short}
    for r in own.where(F.col("col").isin(short)).collect():
        pairs[r["col"]].append((r["value"], r["idx"]))
    out = df
    for c in cols:
        if c in pairs:
            out = out.withColumn(f"{c}_idx", F.coalesce(_literal_index(F.col(c), pairs[c]), F.lit(UNSEEN)))
            continue
        lookup = settle(
            own.where(F.col("col") == c).select(F.col("value").cast(types[c]).alias("_value"), F.col("idx").alias("_idx")), f"labels-{c}")
        out = (
            out.join(lookup, F.col(c).eqNullSafe(F.col("_value")), "left")
            .withColumn(f"{c}_idx", F.coalesce("_idx", F.lit(UNSEEN)))
            .drop("_value", "_idx")
        )
    return out
