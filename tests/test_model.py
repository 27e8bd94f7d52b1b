import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitchlytics.operators import aggregates as A
from pitchlytics.operators import fitting as P
from pitchlytics.operators import model as M
from pitchlytics.storage import settle

SIZES = {
    "batter_idx": 5, "pitcher_idx": 6, "league_idx": 2, "zone_idx": 2, "pitch_subtype_idx": 3, "p_throws_idx": 2,
    "stand_idx": 2, "batter_whiff_group_idx": 3, "zone_num_idx": 4, "count_bucket_idx": 3,
    "whiff_group_6_idx": 3, "pitcher_whiff_group_6_idx": 2,
}
PARAMS = "term string, k1 int, k2 int, k3 int, k4 int, draw_block int, draws array<double>"


def frame_rows(terms, n, seed=1):
    rng = random.Random(seed)
    keys = M.key_columns(terms)
    return keys, [tuple(rng.randrange(SIZES[k]) for k in keys) + (int(rng.random() < 0.3),) for _ in range(n)]


def posterior(terms, draws=12, block=5, seed=4):
    """All effects as arrays, and the same as parameter rows with a short last block."""
    rng = np.random.default_rng(seed)
    arrays, rows = {}, []
    for t in (M.INTERCEPT, *terms):
        a = rng.normal(size=(*(SIZES[k] for k in t.keys), draws))
        arrays[t.name] = a
        for idx in np.ndindex(*a.shape[:-1]):
            k = (*idx, *[0] * (4 - len(idx)))
            for b in range(0, draws, block):
                rows.append((t.name, *map(int, k), b // block, [float(v) for v in a[idx][b : b + block]]))
    return arrays, rows


@pytest.mark.parametrize(
    "terms", [M.ENHANCED, M.HIERARCHICAL, M.TWO_WAY, M.without(M.ENHANCED, ["batter_league", "group_count"])]
)
def test_score_is_the_mean_over_draws(frame, terms):
    keys, data = frame_rows(terms, 60)
    arrays, rows = posterior(terms)
    df = frame(", ".join(f"{k} int" for k in keys) + ", is_whiff int", data)
    got = M.score(df, frame(PARAMS, rows), terms).collect()
    assert len(got) == 60
    for r in got:
        logit = arrays["intercept"] + sum(arrays[t.name][tuple(r[k] for k in t.keys)] for t in terms)
        assert r.score == pytest.approx(float((1 / (1 + np.exp(-logit))).mean()))


def test_missing_parameter_gives_no_score(frame):
    keys, data = frame_rows(M.TWO_WAY, 40)
    _, rows = posterior(M.TWO_WAY)
    gone = [r for r in rows if not (r[0] == "pitcher_zone" and r[1] == 2 and r[2] == 1)]
    df = frame(", ".join(f"{k} int" for k in keys) + ", is_whiff int", data)
    got = M.score_2way(df, frame(PARAMS, gone)).collect()
    assert len(got) == 40
    assert all((r.score is None) == (r.pitcher_idx == 2 and r.zone_idx == 1) for r in got)


def test_only_optional_terms_may_be_left_out():
    with pytest.raises(ValueError):
        M.without(M.ENHANCED, ["batter_zone"])


def test_effect_draws_multiply_by_scale(frame):
    offsets = frame(PARAMS, [("a", 1, 2, 0, 0, 0, [1.0, 2.0]), ("a", 1, 2, 0, 0, 1, [3.0]), ("b", 0, 0, 0, 0, 0, [4.0, 5.0])])
    sigmas = frame("term string, draw_block int, draws array<double>", [("a", 0, [2.0, 3.0]), ("a", 1, [0.5]), ("b", 0, [1.0, 0.0])])
    got = {(r.term, r.draw_block): r.draws for r in M.effect_draws(offsets, sigmas).collect()}
    assert got == {("a", 0): [2.0, 6.0], ("a", 1): [1.5], ("b", 0): [4.0, 0.0]}


@pytest.fixture
def cells(frame):
    keys, data = frame_rows(M.ENHANCED, 3000, seed=8)
    at = keys.index("pitcher_idx")
    rng = random.Random(3)
    data = [(*r[:-1], int(rng.random() < 0.1 + 0.1 * r[at])) for r in data]
    return A.swing_cells(frame(", ".join(f"{k} int" for k in keys) + ", is_whiff int", data), keys)


@pytest.fixture(scope="module")
def fitted(spark):
    """Cells whose pitchers differ, a fit at the prior scales and one that learns them."""
    keys, data = frame_rows(M.ENHANCED, 3000, seed=8)
    at = keys.index("pitcher_idx")
    rng = random.Random(3)
    data = [(*r[:-1], int(rng.random() < 0.1 + 0.1 * r[at])) for r in data]
    frame = spark.createDataFrame(data, ", ".join(f"{k} int" for k in keys) + ", is_whiff int")
    cells = settle(A.swing_cells(frame, keys), "cells")
    return cells, settle(P.fit_enhanced(cells, learn=False), "fixed"), settle(P.fit_enhanced(cells), "learned")


def loss(p):
    return -F.sum(F.col("whiffs") * F.log(p) + (F.col("n") - F.col("whiffs")) * F.log(1 - p)) / F.sum("n")


def test_fit_is_the_penalised_optimum(fitted):
    cells, fixed, learned = fitted
    for params in (fixed, learned):
        assert params.groupBy("term", *M.KEY_COLUMNS).count().where("count > 1").count() == 0
        scales = P.scales_of(params, M.ENHANCED)
        scored = M.score_enhanced(cells, params).cache()
        assert scored.where("score IS NULL").count() == 0
        miss = F.col("n") * F.col("score") - F.col("whiffs")
        assert abs(scored.agg(F.sum(miss)).first()[0]) < 0.05 * 3000**0.5  # free intercept
        slopes = P.gradient(cells, params, M.ENHANCED)
        assert slopes.agg(F.max(F.abs("slope") / F.sqrt("n"))).first()[0] < 0.05
        for t in M.ENHANCED[:3]:
            effect = params.where(F.col("term") == t.name)
            keyed = effect.select(*(F.col(k).alias(c) for k, c in zip(M.KEY_COLUMNS, t.keys)), F.col("draws")[0].alias("b"))
            slope = scored.groupBy(*t.keys).agg(F.sum(miss).alias("m"), F.sum("n").alias("n")).join(keyed, list(t.keys))
            # gradient: residual sum plus effect over squared scale
            worst = slope.agg(F.max(F.abs(F.col("m") + F.col("b") / scales[t.name] ** 2) / F.sqrt("n"))).first()[0]
            assert worst < 0.05, t.name
    assert P.scales_of(fixed, M.ENHANCED) == {t.name: t.scale for t in M.ENHANCED}


def test_every_combination_of_levels_has_an_effect(fitted):
    counts = {r["term"]: r["count"] for r in fitted[2].groupBy("term").count().collect()}
    for t in M.ENHANCED:
        assert counts[t.name] == np.prod([SIZES[k] for k in t.keys]) and counts[P.scale_name(t.name)] == 1
    assert counts["intercept"] == 1


def test_learned_scales_rest_and_follow_the_data(fitted):
    cells, _, learned = fitted
    scales = P.scales_of(learned, M.ENHANCED)
    for r in P.scale_gaps(cells, learned, M.ENHANCED).collect():
        assert r["sigma"] == pytest.approx(scales[r["term"]])
        assert abs(np.log(r["step"] / r["sigma"])) < 0.02, r["term"]
    # pitchers differ, batters don't
    assert scales["pitcher_zone"] + scales["pitcher_subtype"] + scales["pitcher_stand"] > 2 * (
        scales["batter_zone"] + scales["batter_subtype"] + scales["batter_p_throws"])


def test_learned_scales_do_not_lose_on_a_hold_out(spark, fitted):
    cells, fixed, learned = fitted
    keys, data = frame_rows(M.ENHANCED, 6000, seed=99)
    at, rng = keys.index("pitcher_idx"), random.Random(17)
    data = [(*r[:-1], int(rng.random() < 0.1 + 0.1 * r[at])) for r in data]
    held = A.swing_cells(spark.createDataFrame(data, ", ".join(f"{k} int" for k in keys) + ", is_whiff int"), keys)
    rate = cells.agg(F.sum("whiffs") / F.sum("n")).first()[0]
    found = [M.score_enhanced(held, p).agg(loss(F.col("score"))).first()[0] for p in (fixed, learned)]
    assert found[1] <= found[0] + 1e-4
    assert found[1] < held.agg(loss(F.lit(rate))).first()[0] - 0.01


def test_draws_have_the_mean_and_the_covariance_of_the_fit(spark, fitted):
    cells, _, params = fitted
    draws = settle(P.posterior_draws(cells, params, M.ENHANCED, 2, 1000, 300, seed=5), "draws")
    assert draws.where("term NOT LIKE 'sigma%'").groupBy("draw_block").agg(F.max(F.size("draws")), F.count("*")).count() == 7
    # the systems once more with plain arrays: block of the pitchers
    block = next(b for b in P.blocks_of(M.ENHANCED) if b.who == "pitcher_idx")
    scales, rows = P.scales_of(params, M.ENHANCED), M.score_enhanced(cells, params).collect()
    names = [(t.name, *ks) for t in block.terms for ks in np.ndindex(*(SIZES[k] for k in t.keys[1:]))]
    effects = {(r["term"], r["k1"], r["k2"]): r["draws"][0] for r in params.collect()}
    matrix = np.diag([scales[n[0]] ** -2 for n in names])
    for r in rows:
        if r["pitcher_idx"] == 2:
            x = np.array([float(all(r[k] == v for k, v in zip(next(t for t in block.terms if t.name == n[0]).keys[1:], n[1:], strict=True))) for n in names])
            matrix += r["n"] * r["score"] * (1 - r["score"]) * np.outer(x, x)
    long = draws.where("k1 = 2 AND term LIKE 'pitcher%'").orderBy("draw_block").collect()
    drawn = np.array([sum((r["draws"] for r in long if (r["term"], r["k2"]) == n), []) for n in names])
    assert drawn.shape[1] == 2000
    centre, spread = np.array([effects[(n[0], 2, n[1])] for n in names]), np.linalg.inv(matrix)
    assert np.abs((drawn.mean(axis=1) - centre) / np.sqrt(np.diag(spread) / 2000)).max() < 4.5
    assert np.cov(drawn) == pytest.approx(spread, abs=0.12 * np.diag(spread).max())
    again = P.posterior_draws(cells.repartition(3), params, M.ENHANCED, 2, 1000, 300, seed=5)
    first = (F.col("term") == "pitcher_zone") & (F.col("k1") == 4) & (F.col("draw_block") == 6)
    for a, b in zip(draws.where(first).orderBy("k2").collect(), again.where(first).orderBy("k2").collect(), strict=True):
        assert a["draws"] == pytest.approx(b["draws"]) and len(a["draws"]) == 200


def test_a_fit_without_swings_says_so(spark):
    cells = spark.createDataFrame([], ", ".join(f"{k} int" for k in M.key_columns(M.TWO_WAY)) + ", n long, whiffs long")
    with pytest.raises(ValueError):
        P.fit(cells, M.TWO_WAY)


def test_posterior_summary_against_numpy(frame):
    rng = np.random.default_rng(0)
    chains, draws = 3, 41
    values = rng.normal(size=(2, chains, draws)).round(2)
    data = [(f"p{p}", c, d, float(values[p, c, d])) for p in range(2) for c in range(chains) for d in range(draws)]
    got = {r.param: r for r in M.posterior_summary(frame("param string, chain int, draw int, value double", data)).collect()}
    for p in range(2):
        x, flat = values[p], np.sort(values[p].ravel())
        span = int(np.floor(0.94 * flat.size))
        widths = flat[span:] - flat[: flat.size - span]
        i = int(np.argmin(widths.round(12)))
        half = draws // 2
        parts = np.concatenate([x[:, :half], x[:, -half:]])
        within, between = parts.var(axis=1, ddof=1).mean(), parts.mean(axis=1).var(ddof=1)
        row = got[f"p{p}"]
        assert row["mean"] == pytest.approx(flat.mean())
        assert row.sd == pytest.approx(flat.std(ddof=1))
        assert row.hdi_high - row.hdi_low == pytest.approx(widths[i])
        assert row.r_hat == pytest.approx(np.sqrt(((half - 1) / half * within + between) / within))


@pytest.mark.parametrize("chains, draws, block", [(3, 41, 10), (2, 8, 8), (1, 5, 2), (2, 7, 20), (1, 1, 1)])
def test_summary_of_blocks_equals_that_of_single_draws(frame, rows, chains, draws, block):
    rng = np.random.default_rng(chains * draws)
    # Few distinct values, so intervals tie.
    flat = {key: rng.integers(0, 9, chains * draws) / 8 for key in range(4)}
    flat[3] = flat[3][: chains * draws - min(2, chains * draws - 1)]  # a last chain that is cut short
    data = [("t", key, 0, 0, 0, at // block, [float(v) for v in values[at : at + block]])
            for key, values in flat.items() for at in range(0, len(values), block)]
    params = frame(PARAMS, random.Random(1).sample(data, len(data)))
    names = ["term", *M.KEY_COLUMNS, "mean", "sd", "hdi_low", "hdi_high", "r_hat"]
    assert rows(M.summary_of_blocks(params, draws), *names) == rows(
        M.posterior_summary(M.long_draws(params, draws, block), by=names[:5]), *names)


def test_one_array_at_most_travels_on_the_way_to_the_groups(spark, frame, monkeypatch, capsys):
    """With joins that shuffle, no exchange carries the arrays of two parts."""
    monkeypatch.setattr(M, "settle", lambda df, name: df)
    keys, data = frame_rows(M.ENHANCED, 60)
    df, params = frame(", ".join(f"{k} int" for k in keys) + ", is_whiff int", data), frame(PARAMS, posterior(M.ENHANCED)[1])
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        M.score(df, params, M.ENHANCED).explain("formatted")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    exchanged = [x.split("\n\n")[0] for x in capsys.readouterr().out.split(") Exchange\n")[1:]]
    parts = [{f"_part{i}" for i in range(3) if f"_part{i}#" in x} for x in exchanged]
    assert any(parts) and all(len(p) <= 1 for p in parts)


def test_draws_of_players_are_never_broadcast(spark, frame, capsys):
    """A file of few distinct draws is small on disk and large in memory, so its size is no measure."""
    keys, data = frame_rows(M.ENHANCED, 20)
    cells = frame(", ".join(f"{k} int" for k in keys) + ", is_whiff int", data).select(*keys)
    params = settle(frame(PARAMS, posterior(M.ENHANCED)[1]), "params")
    for term in M.ENHANCED:
        M.gather_effect(cells, params, term).explain()
        assert ("BroadcastExchange" in capsys.readouterr().out) == (term.name.startswith("group"))
    M.score(cells, params, M.TWO_WAY[:1]).explain()
    assert "BroadcastExchange" not in capsys.readouterr().out


def test_a_sweep_broadcasts_nothing(spark, cells, monkeypatch):
    """The sums of a sweep are small files of compressed numbers, so none is left to the planner."""
    plans = []

    def watched(df, label):
        plans.append((label, df._jdf.queryExecution().executedPlan().toString()))
        return settle(df, label)

    monkeypatch.setattr(P, "settle", watched)
    with pytest.raises(RuntimeError, match="did not rest"):
        P.fit(cells, M.ENHANCED, max_sweeps=2)
    solved = [plan for label, plan in plans if label == "solved"]
    assert len(solved) == 6
    assert [line for plan in solved for line in plan.splitlines() if "Broadcast" in line] == []


def test_draws_of_players_cross_the_network_once(spark, frame, monkeypatch, capsys):
    """All effects of a player lie in one row, so a cell meets them in one join."""
    monkeypatch.setattr(M, "settle", lambda df, name: df)
    keys, data = frame_rows(M.TWO_WAY, 60)
    df, params = frame(", ".join(f"{k} int" for k in keys) + ", is_whiff int", data), frame(PARAMS, posterior(M.TWO_WAY)[1])
    M.score(df, params, M.TWO_WAY).explain("formatted")
    out = capsys.readouterr().out
    # cells with their batter and their pitcher, rows with their score
    assert out.count(") SortMergeJoin") == 3


def test_score_of_cells_without_a_player_is_null(frame):
    """A player without parameters and an index that is NULL give no score, others keep theirs."""
    keys, data = frame_rows(M.ENHANCED, 30)
    _, rows = posterior(M.ENHANCED)
    known = [r for r in rows if not (r[0].startswith("batter") and r[1] == 3)]
    at = keys.index("zone_idx")
    data[0] = (*data[0][:at], None, *data[0][at + 1:])
    df = frame(", ".join(f"{k} int" for k in keys) + ", is_whiff int", data)
    got = M.score(df, frame(PARAMS, known), M.ENHANCED).collect()
    assert len(got) == 30
    assert all((r.score is None) == (r.batter_idx == 3 or r.zone_idx is None) for r in got)


def test_a_sweep_meets_no_cells_in_joins(cells, monkeypatch):
    """The sums of a player's cells come in the order of the cells: one exchange by part, and no join."""
    plans = []

    def watched(df, label):
        plans.append((label, df._jdf.queryExecution().executedPlan().toString()))
        return settle(df, label)

    monkeypatch.setattr(P, "settle", watched)
    with pytest.raises(RuntimeError, match="did not rest"):
        P.fit(cells, M.TWO_WAY[:2] + M.TWO_WAY[4:6], max_sweeps=2)
    solved = [plan for label, plan in plans if label == "solved"]
    assert len(solved) == 6
    for plan in solved:
        assert "Join" not in plan
        assert plan.count("Exchange hashpartitioning") <= 1


def test_a_fit_does_not_depend_on_the_pieces(frame, rows, monkeypatch):
    """Many small pieces, and a batter of several, give the effects of a single piece."""
    terms = (*M.ENHANCED[1:3], *M.ENHANCED[4:6], M.ENHANCED[9])
    keys, data = frame_rows(terms, 2500, seed=5)
    at, rng = keys.index("batter_idx"), random.Random(2)
    data = [(*r[:at], 1, *r[at + 1:]) if rng.random() < 0.4 else r for r in data]
    cells = settle(A.swing_cells(frame(", ".join(f"{k} int" for k in keys) + ", is_whiff int", data), keys), "cells")
    whole = P.fit(cells, terms, learn=False).collect()
    packed = []

    def watched(df, label):
        out = settle(df, label)
        if label == "pieces":
            packed.append(out)
        return out

    monkeypatch.setattr(P, "settle", watched)
    monkeypatch.setattr(P, "PIECE", 150)
    cut = {tuple(r[c] for c in ("term", *M.KEY_COLUMNS)): r["draws"][0] for r in P.fit(cells, terms, learn=False).collect()}
    pieces = [df.groupBy("part").count().agg(F.max("count"), F.count("*")).first() for df in packed]
    assert pieces[0][0] > 1 and min(p[1] for p in pieces) > 2
    assert len(whole) == len(cut)
    for r in whole:
        assert cut[tuple(r[c] for c in ("term", *M.KEY_COLUMNS))] == pytest.approx(r["draws"][0], abs=1e-4)


@pytest.mark.parametrize("terms", [M.ENHANCED[1:3], M.ENHANCED[4:6] + M.ENHANCED[9:], M.ENHANCED[8:]])
def test_a_fit_of_one_player_or_none_is_stationary(frame, terms):
    keys, data = frame_rows(terms, 800, seed=6)
    cells = settle(A.swing_cells(frame(", ".join(f"{k} int" for k in keys) + ", is_whiff int", data), keys), "cells")
    params = settle(P.fit(cells, terms, learn=False), "params")
    slopes = P.gradient(cells, params, terms)
    assert slopes.agg(F.max(F.abs("slope") / F.sqrt("n"))).first()[0] < 0.05
