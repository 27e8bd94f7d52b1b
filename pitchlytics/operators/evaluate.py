"""Classification metrics as distributed jobs.

Every function takes ``scored`` (a 0/1 label and a score per row) and optional group
columns; rows with a NULL group are left out. A row without a score or a label fails the
metric, unless ``unscored="drop"`` leaves such rows out; the report then counts them.

Ranking metrics never sort the rows. Rows are counted per distinct score (a map-side
aggregate, so a score or group shared by very many rows costs one row per task), and running
totals over the distinct scores are taken in range-partitioned slices.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import settle
from .ordered import running_totals

# Fixed value: machine epsilon of a double, the distance log loss keeps from 0 and 1.
EPSILON = 2.220446049250313e-16
CUT = 0.5


def _scored(scored: DataFrame, label: str, score: str, by: Sequence[str] = (), unscored: str = "raise") -> DataFrame:
    """The rows that count: in a group, with a label and a score."""
    if unscored not in ("raise", "drop"):
        raise ValueError("unscored is 'raise' or 'drop'")
    rows = scored.dropna(subset=list(by)) if by else scored
    if unscored == "drop":
        return rows.dropna(subset=[label, score])
    return _checked(rows, F.col(label).isNotNull() & F.col(score).isNotNull(), "a row has no score or no label")


def _checked(rows: DataFrame, right: Column, message: str) -> DataFrame:
    """``rows``, which fail where ``right`` is false. A filter looks at a row once, whereas a check
    inside a column is repeated wherever that column is used."""
    return rows.where(F.when(right, True).otherwise(F.raise_error(F.lit(message)).cast("boolean")))


def _per_score(scored: DataFrame, label: str, score: str, by: Sequence[str], unscored: str) -> DataFrame:
    """Positives and negatives per (group, distinct score)."""
    rows = _scored(scored, label, score, by, unscored)
    y = F.col(label).cast("bigint")
    return rows.groupBy(*by, F.col(score).alias("score")).agg(
        F.sum(y).alias("pos"), F.sum(F.lit(1) - y).alias("neg")
    )


def _log_loss(p: Column, y: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(EPSILON)), F.lit(1.0 - EPSILON))
    return -F.when(y == 1, F.log(q)).otherwise(F.log(1.0 - q))


def _summary(
    scored: DataFrame, label: str, score: str, by: Sequence[str], cut: float = CUT, unscored: str = "raise"
) -> DataFrame:
    """One row per group with every overall metric, from one pass over the rows."""
    by = list(by)
    ranked = running_totals(_per_score(scored, label, score, by, unscored), by, ["score"], ["neg"])
    p, pos, neg = F.col("score"), F.col("pos"), F.col("neg")
    totals = ranked.groupBy(*by).agg(
        F.sum("pos").alias("pos"),
        F.sum("neg").alias("neg"),
        F.sum(pos * (F.col("neg_before") + neg / 2.0)).alias("wins"),
        F.sum(pos * F.pow(1.0 - p, F.lit(2.0)) + neg * F.pow(p, F.lit(2.0))).alias("squares"),
        F.sum(pos * _log_loss(p, F.lit(1)) + neg * _log_loss(p, F.lit(0))).alias("losses"),
        F.sum(F.when(p > cut, pos).otherwise(0)).alias("tp"),
        F.sum(F.when(p > cut, neg).otherwise(0)).alias("fp"),
    )
    n = pos + neg
    return totals.select(
        *by,
        n.alias("n"),
        F.try_divide("wins", pos.cast("double") * neg).alias("auc"),
        F.try_divide("squares", n).alias("brier_score"),
        F.try_divide("losses", n).alias("log_loss"),
        (neg - F.col("fp")).alias("tn"),
        "fp",
        (pos - F.col("tp")).alias("fn"),
        "tp",
    )


def auc(
    scored: DataFrame, label="is_whiff", score="score", group_cols: Sequence[str] = (), unscored: str = "raise"
) -> DataFrame:
    """Area under the ROC curve, ties counted half, NULL for a group of one class."""
    return _summary(scored, label, score, group_cols, unscored=unscored).select(*group_cols, "auc")


def brier_score(
    scored: DataFrame, label="is_whiff", score="score", group_cols: Sequence[str] = (), unscored: str = "raise"
) -> DataFrame:
    rows = _scored(scored, label, score, group_cols, unscored)
    error = F.pow(F.col(score) - F.col(label), F.lit(2.0))
    return rows.groupBy(*group_cols).agg(F.avg(error).alias("brier_score"))


def log_loss(
    scored: DataFrame, label="is_whiff", score="score", group_cols: Sequence[str] = (), unscored: str = "raise"
) -> DataFrame:
    rows = _scored(scored, label, score, group_cols, unscored)
    return rows.groupBy(*group_cols).agg(F.avg(_log_loss(F.col(score), F.col(label))).alias("log_loss"))


def confusion_matrix(
    scored: DataFrame, label="is_whiff", score="score", cut: float = CUT, group_cols: Sequence[str] = (), unscored: str = "raise"
) -> DataFrame:
    rows = _scored(scored, label, score, group_cols, unscored)
    said, true = F.col(score) > cut, F.col(label) == 1

    def cell(said_it: Column, name: str) -> Column:
        return F.count_if(said_it).alias(name)

    return rows.groupBy(*group_cols).agg(
        cell(~said & ~true, "tn"), cell(said & ~true, "fp"), cell(~said & true, "fn"), cell(said & true, "tp")
    )


def _ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole), F.lit(0.0))


def _class_rates(hit: str, false_hit: str, miss: str) -> tuple[Column, Column, Column]:
    """Precision, recall and F1 of a class, 0 where undefined."""
    h, f, m = F.col(hit), F.col(false_hit), F.col(miss)
    return _ratio(h, h + f), _ratio(h, h + m), _ratio(2 * h, 2 * h + f + m)


def classification_report(
    scored: DataFrame, label="is_whiff", score="score", cut: float = CUT, group_cols: Sequence[str] = (), unscored: str = "raise"
) -> DataFrame:
    """Precision, recall, F1 and support, one row per class."""
    cells = confusion_matrix(scored, label, score, cut, group_cols, unscored)
    rows = []
    for cls, hit, false_hit, miss in ((0, "tn", "fn", "fp"), (1, "tp", "fp", "fn")):
        precision, recall, f1 = _class_rates(hit, false_hit, miss)
        rows.append(
            F.struct(
                F.lit(cls).alias("class"),
                precision.alias("precision"),
                recall.alias("recall"),
                f1.alias("f1"),
                (F.col(hit) + F.col(miss)).alias("support"),
            )
        )
    return cells.select(*group_cols, F.explode(F.array(*rows)).alias("r")).select(*group_cols, "r.*")


def classification_averages(
    scored: DataFrame, label="is_whiff", score="score", cut: float = CUT, group_cols: Sequence[str] = (), unscored: str = "raise"
) -> DataFrame:
    """Precision, recall and F1 over both classes: their plain mean (``macro``) and their mean
    by support (``weighted``)."""
    report = classification_report(scored, label, score, cut, group_cols, unscored)
    names = ("precision", "recall", "f1")
    means = report.groupBy(*group_cols).agg(
        *(F.avg(c).alias(f"macro_{c}") for c in names),
        *(F.try_divide(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(f"weighted_{c}") for c in names),
        F.sum("support").alias("support"),
    )
    kinds = [F.struct(F.lit(k).alias("average"), *(F.col(f"{k}_{c}").alias(c) for c in names), "support") for k in ("macro", "weighted")]
    return means.select(*group_cols, F.explode(F.array(*kinds)).alias("r")).select(*group_cols, "r.*")


def _rates() -> list[Column]:
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    return [
        F.try_divide(tn + tp, tn + fp + fn + tp).alias("accuracy"),
        F.try_divide(tp, tp + fn).alias("sensitivity"),
        F.try_divide(tn, tn + fp).alias("specificity"),
    ]


def rate_summary(
    scored: DataFrame, label="is_whiff", score="score", cut: float = CUT, group_cols: Sequence[str] = (), unscored: str = "raise"
) -> DataFrame:
    """Accuracy, sensitivity and specificity."""
    return confusion_matrix(scored, label, score, cut, group_cols, unscored).select(*group_cols, *_rates())


def evaluation_report(
    scored: DataFrame, label="is_whiff", score="score", cut: float = CUT, group_cols: Sequence[str] = (), unscored: str = "raise"
) -> DataFrame:
    """Every overall metric as ``(*group_cols, metric, value)``, and ``n_unscored`` where rows
    may be left out."""
    table = _summary(scored, label, score, group_cols, cut, unscored)
    values = {c: F.col(c).cast("double") for c in ("n", "auc", "brier_score", "log_loss", "tn", "fp", "fn", "tp")}
    for cls, cells in (("no_whiff", ("tn", "fn", "fp")), ("whiff", ("tp", "fp", "fn"))):
        for metric, value in zip(("precision", "recall", "f1"), _class_rates(*cells)):
            values[f"{metric}_{cls}"] = value
    for name, value in zip(("accuracy", "sensitivity", "specificity"), _rates()):
        values[name] = value
    wide = table.select(*group_cols, *(v.alias(k) for k, v in values.items()))
    report = wide.unpivot(list(group_cols), list(values), "metric", "value")
    if unscored == "raise":
        return report
    rows = scored.dropna(subset=list(group_cols)) if group_cols else scored
    left_out = F.count_if(F.col(label).isNull() | F.col(score).isNull()).cast("double").alias("value")
    return report.unionByName(rows.groupBy(*group_cols).agg(F.lit("n_unscored").alias("metric"), left_out))


def metrics_by_group(
    scored: DataFrame, by: str, label="is_whiff", score="score", cut: float = CUT, both_classes: bool = True,
    unscored: str = "raise",
) -> DataFrame:
    """Metrics per value of ``by``; values with a single class are left out."""
    table = _summary(scored, label, score, [by], cut, unscored).where(F.col("auc").isNotNull())
    out = [by, "n", "auc", "brier_score", "log_loss"]
    names = ("precision", "recall", "f1")
    out += [v.alias(f"{m}_whiff") for m, v in zip(names, _class_rates("tp", "fp", "fn"))]
    if both_classes:
        out += [v.alias(f"{m}_no_whiff") for m, v in zip(names, _class_rates("tn", "fn", "fp"))]
    return table.select(*out)


def top_pitch_types(metrics: DataFrame, by="pitch_subtype", k: int = 6) -> DataFrame:
    """The ``k`` groups with the most rows, by name on ties."""
    return metrics.orderBy(F.col("n").desc(), F.col(by).asc_nulls_last()).limit(k)


def rank_groups_by_auc(metrics: DataFrame, by="pitch_subtype") -> DataFrame:
    """Group metrics with their place by AUC, unknown last, by name on ties."""
    keyed = metrics.withColumns({"_falling": -F.col("auc"), "_one": F.lit(1)})
    ranked = running_totals(keyed, [], ["_falling", by], ["_one"])
    return ranked.withColumn("auc_rank", (F.col("_one_before") + 1).cast("int")).select(*metrics.columns, "auc_rank")


def roc_curve(
    scored: DataFrame, label="is_whiff", score="score", group_cols: Sequence[str] = (), unscored: str = "raise",
    thin: bool = False,
) -> DataFrame:
    """False and true positive rate at each distinct score, with the (0, 0) start at a NULL
    threshold. Groups of one class have a NULL rate.

    ``thin`` leaves out the points on a straight line between their neighbours, exactly: a point
    stays if the step to the next lower score turns. The curve and its area are the same."""
    by = list(group_cols)
    steps = ("pos", "neg")
    ranked = running_totals(_per_score(scored, label, score, by, unscored), by, ["score"], steps, steps if thin else ())

    def at_or_above(c: str) -> Column:
        return F.try_divide((F.col(f"{c}_all") - F.col(f"{c}_before")).cast("double"), F.col(f"{c}_all"))

    # the lowest score of a group is its last point, so it also stands for the start
    point = F.struct(F.col("score").alias("threshold"), at_or_above("neg").alias("fpr"), at_or_above("pos").alias("tpr"))
    start = F.struct(F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    lowest = (F.col("pos_before") == 0) & (F.col("neg_before") == 0)
    points = F.when(lowest, F.array(point, start)).otherwise(F.array(point))
    if thin:
        pos, neg, next_pos, next_neg = (F.col(c).cast("decimal(19,0)") for c in ("pos", "neg", "pos_previous", "neg_previous"))
        ranked = ranked.where(lowest | (pos * next_neg != neg * next_pos))
    return ranked.select(*by, F.explode(points).alias("p")).select(*by, "p.*")


def roc_by_group(
    scored: DataFrame, by="pitch_subtype", label="is_whiff", score="score", k: int = 6, unscored: str = "raise"
) -> DataFrame:
    """ROC curves of the ``k`` largest groups that hold both classes."""
    y, scored = F.col(label), _scored(scored, label, score, [by], unscored)
    sizes = (
        scored.groupBy(by)
        .agg(F.count(F.lit(1)).alias("n"), F.min(y).alias("low"), F.max(y).alias("high"))
        .where(F.col("low") < F.col("high"))
    )
    top = settle(top_pitch_types(sizes, by, k).select(by), "groups")
    return roc_curve(scored.join(top, by, "left_semi"), label, score, [by])


def calibration_curve(
    scored: DataFrame, label="is_whiff", score="score", bins: int = 10, unscored: str = "raise"
) -> DataFrame:
    """Mean score and share of positives per uniform, right-closed score bin."""
    p, scored = F.col(score), _scored(scored, label, score, unscored=unscored)
    bin_no = F.lit(0)
    for k in range(1, bins):
        bin_no = bin_no + (p > k * (1.0 / bins)).cast("int")
    return scored.groupBy(bin_no.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_score"), F.avg(label).alias("share_positive")
    )


def score_histogram(
    scored: DataFrame, label="is_whiff", score="score", bins: int = 30, unscored: str = "raise"
) -> DataFrame:
    """Density histogram of the scores of each class between its own extremes. All bins are
    listed, the last one is closed. A label other than 0 and 1 fails."""
    p, scored = F.col(score), _scored(scored, label, score, unscored=unscored)
    scored = _checked(scored, F.col(label).isin(0, 1), "a label is not 0 or 1")
    # one row per class, two in all, so it may be broadcast
    extremes = (
        scored.groupBy(label)
        .agg(F.min(p).alias("low"), F.max(p).alias("high"), F.count(F.lit(1)).alias("total"))
        .withColumn("flat", F.col("low") == F.col("high"))
        .withColumn("low", F.when(F.col("flat"), F.col("low") - 0.5).otherwise(F.col("low")))
        .withColumn("high", F.when(F.col("flat"), F.col("high") + 0.5).otherwise(F.col("high")))
        .drop("flat")
    )
    extremes = settle(extremes, "extremes")
    place = F.floor((p - F.col("low")) / (F.col("high") - F.col("low")) * bins).cast("int")
    counts = (
        scored.select(label, score)
        .join(F.broadcast(extremes), label)
        .groupBy(label, F.least(place, F.lit(bins - 1)).alias("bin"))
        .agg(F.count(F.lit(1)).alias("count"))
    )
    width = (F.col("high") - F.col("low")) / bins
    every = extremes.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return every.join(counts, [label, "bin"], "left").select(
        label,
        "bin",
        (F.col("low") + F.col("bin") * width).alias("bin_start"),
        F.coalesce("count", F.lit(0)).alias("count"),
        (F.coalesce("count", F.lit(0)) / (F.col("total") * width)).alias("density"),
    )


def residuals(scored: DataFrame, label="is_whiff", score="score") -> DataFrame:
    return scored.withColumn("residual", F.col(label) - F.col(score))
