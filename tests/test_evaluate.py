import math
import random

import numpy as np
import pytest

from pitchlytics.operators import evaluate as V
from pitchlytics.operators import ordered

SCHEMA = "is_whiff int, score double, zone int"
SMALL = [(0, 0.1, 1), (0, 0.4, 1), (1, 0.4, 1), (1, 0.8, 1)]


def scored(n=4000, seed=2):
    """Scores with ties; a third of the rows share one score and half share one zone."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        p = 0.37 if i % 3 == 0 else round(rng.random(), 3)
        out.append((int(rng.random() < p), p, 5 if i % 2 else rng.randrange(1, 5)))
    return out


def brute_auc(data):
    pos = np.array([p for y, p, _ in data if y == 1])[:, None]
    neg = np.array([p for y, p, _ in data if y == 0])[None, :]
    return float(((pos > neg) + 0.5 * (pos == neg)).mean())


def test_small_example(frame):
    df = frame(SCHEMA, SMALL)
    assert V.auc(df).first().auc == 0.875
    assert V.brier_score(df).first().brier_score == pytest.approx(0.1425)
    m = V.confusion_matrix(df).first()
    assert (m.tn, m.fp, m.fn, m.tp) == (2, 0, 1, 1)
    report = {r["class"]: r for r in V.classification_report(df).collect()}
    assert (report[1].precision, report[1].recall, report[1].support) == (1.0, 0.5, 2)
    assert (report[0].precision, report[0].recall) == (pytest.approx(2 / 3), 1.0)
    rates = V.rate_summary(df).first()
    assert (rates.accuracy, rates.sensitivity, rates.specificity) == (0.75, 0.5, 1.0)


@pytest.mark.usefixtures("many_slices")
def test_auc_against_all_pairs(frame):
    data = scored()
    df = frame(SCHEMA, data)
    assert V.auc(df).first().auc == pytest.approx(brute_auc(data), abs=1e-12)
    by_zone = {r.zone: r.auc for r in V.auc(df, group_cols=["zone"]).collect()}
    for z in range(1, 6):
        assert by_zone[z] == pytest.approx(brute_auc([d for d in data if d[2] == z]), abs=1e-12)


def test_auc_of_the_complement(frame):
    data = scored(800)
    flipped = [(y, 1 - p, z) for y, p, z in data]
    total = V.auc(frame(SCHEMA, data)).first().auc + V.auc(frame(SCHEMA, flipped)).first().auc
    assert total == pytest.approx(1.0)


def test_report_agrees_with_single_metrics(frame):
    data = scored()
    df = frame(SCHEMA, data)
    report = {r.metric: r.value for r in V.evaluation_report(df).collect()}
    y, p = np.array([d[0] for d in data]), np.array([d[1] for d in data])
    eps = np.finfo(float).eps
    q = np.clip(p, eps, 1 - eps)
    assert report["n"] == len(data)
    assert report["brier_score"] == pytest.approx(((p - y) ** 2).mean())
    assert report["log_loss"] == pytest.approx(-(y * np.log(q) + (1 - y) * np.log(1 - q)).mean())
    assert report["brier_score"] == pytest.approx(V.brier_score(df).first().brier_score)
    assert report["log_loss"] == pytest.approx(V.log_loss(df).first().log_loss)
    assert sum(report[c] for c in ("tn", "fp", "fn", "tp")) == len(data)
    assert report["sensitivity"] == report["recall_whiff"]


@pytest.mark.usefixtures("many_slices")
def test_scores_really_lie_in_several_slices(spark, frame, monkeypatch):
    slices = []
    settle = ordered.settle
    monkeypatch.setattr(ordered, "settle", lambda df, label: slices.append(settle(df, label)) or slices[-1])
    V.auc(frame(SCHEMA, scored(900))).collect()
    assert slices[0].select("slice").distinct().count() > 3


SINGLE = (V.auc, V.brier_score, V.log_loss, V.confusion_matrix, V.classification_report, V.classification_averages, V.rate_summary,
          V.evaluation_report, V.roc_curve, V.calibration_curve, V.score_histogram)


@pytest.mark.parametrize("metric", [*SINGLE, lambda df, **k: V.metrics_by_group(df, "zone", **k), lambda df, **k: V.roc_by_group(df, "zone", **k)])
def test_unscored_rows_fail_or_are_left_out(frame, rows, metric):
    data = scored(60)
    plain = frame(SCHEMA, data)
    gaps = frame(SCHEMA, [*data, (1, None, 1), (0, None, 5), (None, 0.4, 2)])
    with pytest.raises(Exception, match="no score or no label"):
        metric(gaps).collect()
    left = metric(gaps, unscored="drop")
    if "metric" in left.columns:
        assert [tuple(r) for r in left.where("metric = 'n_unscored'").collect()] == [("n_unscored", 3.0)]
        left = left.where("metric <> 'n_unscored'")
    assert str(rows(left)) == str(rows(metric(plain)))
    with pytest.raises(ValueError):
        metric(plain, unscored="keep")


def test_averages_over_classes(frame):
    df = frame(SCHEMA, SMALL + [(0, 0.9, 1)])
    report = {r["class"]: r for r in V.classification_report(df).collect()}
    got = {r.average: r for r in V.classification_averages(df).collect()}
    for c in ("precision", "recall", "f1"):
        assert got["macro"][c] == pytest.approx((report[0][c] + report[1][c]) / 2)
        assert got["weighted"][c] == pytest.approx((3 * report[0][c] + 2 * report[1][c]) / 5)


def test_other_labels_fail_the_histogram(frame):
    with pytest.raises(Exception, match="not 0 or 1"):
        V.score_histogram(frame(SCHEMA, [(2, 0.5, 1)])).collect()


def test_log_loss_at_the_ends(frame):
    got = V.log_loss(frame(SCHEMA, [(1, 0.0, 1), (0, 0.0, 1)])).first().log_loss
    assert got == pytest.approx(-math.log(V.EPSILON) / 2)


def test_single_class_group_is_left_out(frame, rows):
    data = scored(300) + [(1, 0.5, 8)] * 20 + [(1, 0.5, None)] * 5
    out = V.metrics_by_group(frame(SCHEMA, data), "zone", both_classes=False)
    assert [r[0] for r in rows(out, "zone")] == [1, 2, 3, 4, 5]
    assert sum(r.n for r in out.collect()) == 300


def test_undefined_precision_is_zero(frame):
    report = {r["class"]: r for r in V.classification_report(frame(SCHEMA, [(1, 0.2, 1), (0, 0.1, 1)])).collect()}
    assert (report[1].precision, report[1].recall, report[1].f1) == (0.0, 0.0, 0.0)


@pytest.mark.usefixtures("many_slices")
def test_roc_curve_points_and_area(frame):
    data = scored(900)
    curve = sorted((r.fpr, r.tpr) for r in V.roc_curve(frame(SCHEMA, data)).collect())
    assert curve[0] == (0.0, 0.0) and curve[-1] == (1.0, 1.0)
    assert len(curve) == len({p for _, p, _ in data}) + 1
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(curve, curve[1:]))
    assert area == pytest.approx(brute_auc(data))


@pytest.mark.usefixtures("many_slices")
@pytest.mark.parametrize("by", [[], ["zone"]])
def test_thin_curve_keeps_the_corners(frame, by):
    rng = random.Random(6)
    runs = [(rng.randint(0, 1), i, rng.choice([1, 1, 5])) for i in range(300)]
    data = [(y, i / 300, z) for y, i, z in runs] + [(y, 0.5001, 1) for y in (0, 1, 1)]
    whole, thin = (V.roc_curve(frame(SCHEMA, data), group_cols=by, thin=t).collect() for t in (False, True))
    for z in {r.zone for r in whole} if by else {None}:
        mine = sorted(((r.fpr, r.tpr) for r in whole if not by or r.zone == z))
        kept = sorted(((r.fpr, r.tpr) for r in thin if not by or r.zone == z))
        p, n = (sum(d[0] == y and (z is None or d[2] == z) for d in data) for y in (1, 0))
        exact = [(round(a * n), round(b * p)) for a, b in mine]
        turn = [(b[0] - a[0]) * (c[1] - b[1]) != (b[1] - a[1]) * (c[0] - b[0]) for a, b, c in zip(exact, exact[1:], exact[2:])]
        assert kept == [mine[0], *(m for m, t in zip(mine[1:-1], turn) if t), mine[-1]]
        assert len(kept) < len(mine)


def test_a_check_of_rows_stands_once_in_the_plan(frame, capsys):
    V.score_histogram(frame(SCHEMA, scored(50))).count()
    V.calibration_curve(frame(SCHEMA, scored(50))).explain("extended")
    optimised = capsys.readouterr().out.split("Optimized Logical Plan")[1].split("Physical Plan")[0]
    assert optimised.count("raise_error") == 1


def test_roc_by_group_takes_the_largest(frame, rows):
    data = scored(600) + [(1, 0.3, 9)] * 400
    out = V.roc_by_group(frame(SCHEMA, data), "zone", k=2)
    zones = {r.zone for r in out.collect()}
    assert 5 in zones and 9 not in zones and len(zones) == 2


def test_calibration_bins_are_right_closed(frame, rows):
    df = frame(SCHEMA, [(0, 0.0, 1), (1, 0.1, 1), (1, 0.1000001, 1), (1, 1.0, 1)])
    assert rows(V.calibration_curve(df), "bin", "n") == [(0, 2), (1, 1), (9, 1)]


@pytest.mark.parametrize("data", [scored(500), [(0, 0.5, 1), (1, 0.2, 1), (1, 0.9, 1)]])
def test_histogram_against_numpy(frame, data):
    got = V.score_histogram(frame(SCHEMA, data)).collect()
    for cls in (0, 1):
        p = np.array([d[1] for d in data if d[0] == cls])
        mine = sorted((r for r in got if r.is_whiff == cls), key=lambda r: r.bin)
        assert sum(r["count"] for r in mine) == len(p)
        _, edges = np.histogram(p, bins=30)
        assert [r.bin_start for r in mine] == pytest.approx(list(edges[:-1]))
        width = edges[1] - edges[0]
        assert sum(r.density for r in mine) * width == pytest.approx(1.0)


def test_ranking(frame, rows):
    df = frame("g string, n int, auc double", [("a", 5, 0.6), ("b", 9, None), ("c", 5, 0.9)])
    assert rows(V.rank_groups_by_auc(df, "g"), "auc_rank", "g") == [(1, "c"), (2, "a"), (3, "b")]
    assert [r.g for r in V.top_pitch_types(df, "g", 2).collect()] == ["b", "a"]
