"""Train a whiff model on a sample and evaluate it on a hold-out."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate as V
from ..operators.aggregates import swing_cells
from ..operators.games import start_game
from ..operators.fitting import fit, posterior_draws
from ..operators.model import Term, key_columns, score
from ..sources.tables import load_tables, overwrite_table, save_eval_tables, save_tables, write_report_csv
from ..storage import settle
from .samples import Encoding, Variant, fit_encoding, model_frame


@dataclass(frozen=True)
class Trained:
    """What scoring needs: the encoding of the training sample and the parameter table, and the
    point estimates if the parameters are draws around them."""

    encoding: Encoding
    params: DataFrame
    estimates: DataFrame | None = None


@dataclass(frozen=True)
class Draws:
    """How many draws to take around a fit: chains, draws in each, draws in a row."""

    chains: int
    draws: int
    block: int
    seed: int = 0


def train(sample: DataFrame, variant: Variant, terms: Sequence[Term], draws: Draws | None = None) -> Trained:
    """Encode the sample, collapse it to cells and fit the terms and their scales; with ``draws``
    the parameters are draws around the fit."""
    encoding = fit_encoding(sample, variant)
    frame = model_frame(sample, variant, encoding)
    cells = settle(swing_cells(frame, key_columns(terms)), "cells")
    estimates = settle(fit(cells, terms), "params")
    if draws is None:
        return Trained(encoding, estimates, estimates)
    return Trained(encoding, posterior_draws(cells, estimates, terms, draws.chains, draws.draws, draws.block, draws.seed), estimates)


def save_trained(trained: Trained, path: str) -> None:
    """Persist the encoding and the parameters as tables; effects are split by term on disk,
    so that scoring reads each term alone."""
    groups = {f"groups_{player}": df for player, df in trained.encoding.groups.items()}
    save_tables({"labels": trained.encoding.labels, **groups}, path)
    for name, df in (("params", trained.params), ("estimates", trained.estimates)):
        if df is not None:
            df.write.mode("overwrite").partitionBy("term").parquet(f"{path}/{name}")


def load_trained(spark: SparkSession, path: str, variant: Variant) -> Trained:
    players = list(variant.groups)
    saved = load_tables(spark, path, ["labels", "params", *(f"groups_{p}" for p in players)])
    try:
        estimates = spark.read.parquet(f"{path}/estimates")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        estimates = None
    return Trained(Encoding({p: saved[f"groups_{p}"] for p in players}, saved["labels"]), saved["params"], estimates)


def score_hold_out(sample: DataFrame, trained: Trained, variant: Variant, terms: Sequence[Term]) -> DataFrame:
    """The hold-out frame with a score per row. It carries the score in its own row, so
    metrics of a group always use the scores of that group."""
    return score(model_frame(sample, variant, trained.encoding), trained.params, terms)


def evaluate(scored: DataFrame, path: str) -> dict[str, DataFrame]:
    """Compute and save the evaluation of a scored hold-out: overall metrics, predictions,
    metrics per pitch subtype and per zone, and the curves. Group reports are also written
    as CSV. The scored rows are settled once and every table is read from them."""
    kept = [c for c in ("is_whiff", "score", "pitch_subtype", "zone") if c in scored.columns]
    scored = settle(scored.select(*kept), "scored")
    tables = {
        "roc": V.roc_curve(scored),
        "calibration": V.calibration_curve(scored),
        "histogram": V.score_histogram(scored),
        "by_pitch_subtype": V.metrics_by_group(scored, "pitch_subtype"),
        "roc_by_pitch_subtype": V.roc_by_group(scored, "pitch_subtype"),
    }
    reports = ["by_pitch_subtype"]
    if "zone" in kept:
        tables["by_zone"] = V.metrics_by_group(scored, "zone", both_classes=False)
        reports.append("by_zone")
    rate = scored.agg(F.lit("whiff_rate").alias("metric"), F.avg("is_whiff").alias("value"))
    save_eval_tables(path, V.evaluation_report(scored).unionByName(rate), V.residuals(scored), **tables)
    saved = load_tables(scored.sparkSession, path, ["metrics", "predictions", *tables])
    for name in reports:
        write_report_csv(saved[name], f"{path}/{name}_csv")
    return saved


def rebuild_start_game(pitches: DataFrame, path: str) -> DataFrame:
    """Replace the stored line-up table by one built from all pitches."""
    return overwrite_table(start_game(pitches), path)
