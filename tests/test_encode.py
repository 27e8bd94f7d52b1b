import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitchlytics.operators import encode as E
from pitchlytics.operators.ordered import quantiles, running_totals
from pitchlytics.plans import samples

RATES = [0.1, 0.2, 0.2, 0.3, 0.5, 0.7, 0.9]


def test_quantile_groups(frame, rows, many_slices):
    df = frame("player int, whiff_rate double", list(enumerate(RATES)))
    got = E.quantile_groups(df, {"g": E.THREE_GROUPS})
    assert [r[1] for r in rows(got, "player", "g")] == ["Low"] * 3 + ["Medium"] * 2 + ["High"] * 2


def test_equal_edges_raise(frame):
    df = frame("player int, whiff_rate double", list(enumerate([0.0, 0.0, 0.0, 0.0, 1.0])))
    with pytest.raises(Exception, match="not unique"):
        E.quantile_groups(df, {"g": E.THREE_GROUPS}).collect()


def test_quantiles_against_numpy(frame, many_slices):
    rng = random.Random(5)
    values = [round(rng.random(), 2) for _ in range(500)] + [0.25] * 300
    df = frame("v double", [(v,) for v in values]).groupBy("v").agg(F.count(F.lit(1)).alias("w"))
    probs = [0.0, 1 / 6, 1 / 3, 0.5, 0.9, 1.0]
    got = quantiles(df, "v", "w", probs).first()["e"]
    assert got == pytest.approx(list(np.quantile(values, probs)))


def test_running_totals_with_a_group_that_holds_most_rows(frame, many_slices):
    data = [("big", i, i % 7) for i in range(900)] + [("small", i, 1) for i in range(50)]
    random.Random(1).shuffle(data)
    got = running_totals(frame("g string, k int, n int", data), ["g"], ["k"], ["n"]).collect()
    assert len(got) == len(data)
    for group in ("big", "small"):
        total = 0
        for r in sorted((r for r in got if r.g == group), key=lambda r: r.k):
            assert r.n_before == total
            total += r.n
        assert {r.n_all for r in got if r.g == group} == {total}


def test_labels_sort_numbers_as_numbers(frame, rows, many_slices):
    df = frame("p int, g string", [(10, "Low"), (9, "High"), (9, "Medium"), (100, None)])
    got = E.labels_of(E.value_counts(df, ["p", "g"]))
    assert rows(got.where("col = 'p'"), "idx", "value") == [(0, "9"), (1, "10"), (2, "100")]
    assert rows(got.where("col = 'g'"), "idx", "value") == [(0, "High"), (1, "Low"), (2, "Medium"), (3, None)]


def test_apply_labels(frame, rows):
    train = frame("g string, h string", [("High", "a"), ("Low", "b"), ("Medium", "a")])
    labels = E.fit_labels(train, ["g"])
    held = frame("g string, h string", [("X", "q"), ("Low", "p"), (None, "p")])
    got = E.apply_labels(held, labels, ["g", "h"], fit_missing=True)
    assert rows(got, "g", "g_idx", "h_idx") == [("Low", 1, 0), ("X", -1, 1), (None, -1, 0)]


def test_long_and_short_label_lists_agree(frame, rows, monkeypatch):
    df = frame("p int, g string", [(i % 40, f"g{i % 3}" if i % 5 else None) for i in range(200)])
    labels = E.fit_labels(df.where("p < 30"), ["p", "g"])
    short = E.apply_labels(df, labels, ["p", "g"])
    assert "Join" not in short._jdf.queryExecution().executedPlan().toString()
    expected = rows(short)
    monkeypatch.setattr(E, "LITERAL_LABELS", 0)
    assert rows(E.apply_labels(df, labels, ["p", "g"])) == expected
    assert {r[2] for r in expected if r[0] >= 30} == {-1}


def test_no_players_no_edges(frame):
    df = frame("player int, whiff_rate double", [(1, None)])
    assert E.quantile_groups(df, {"g": E.THREE_GROUPS}).first().g is None


SAMPLE = (
    "batter int, pitcher int, stand string, pitch_subtype string, is_zone int, zone int, p_throws string, "
    "balls int, strikes int, league string, is_whiff int"
)


def swings(n, seed=3, minor_only=()):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        batter, pitcher = rng.randrange(12), rng.randrange(100, 112)
        league = "minor" if batter in minor_only else rng.choice(["major", "minor"])
        whiff = int(rng.random() < 0.1 + 0.05 * (batter % 8))
        out.append(
            (batter, pitcher, rng.choice("LR"), rng.choice(["Slider", "Sinker", "Cutter"]), rng.randrange(2),
             rng.choice([1, 5, 9, 11, 14]), rng.choice("LR"), rng.randrange(4), rng.randrange(3), league, whiff)
        )
    return out


def test_player_without_major_swings_gets_its_own_last_index(frame, rows):
    df = frame(SAMPLE, swings(3000, minor_only=(11,)))
    out = samples.model_frame(df, samples.HIERARCHICAL)
    assert out.count() == 3000
    for names, col in ((3, "whiff_group_3_idx"), (6, "whiff_group_6_idx")):
        got = {r[0] for r in out.where("batter = 11").select(col).distinct().collect()}
        assert got == {names}
        assert out.where("batter <> 11").agg(F.max(col)).first()[0] == names - 1


def test_hold_out_uses_training_groups(frame, rows):
    train, held = frame(SAMPLE, swings(3000)), frame(SAMPLE, swings(500, seed=9) + [(99, 100, "L", "Slider", 1, 1, "L", 0, 0, "major", 1)])
    fitted = samples.fit_encoding(train)
    out = samples.model_frame(held, samples.ENHANCED, fitted)
    assert out.count() == 500  # the unknown batter is dropped
    groups = dict(rows(fitted.groups["batter"], "batter", "batter_whiff_group"))
    assert all(groups[r.batter] == r.batter_whiff_group for r in out.collect())
    own = samples.regroup(held, fitted)
    assert rows(own.labels) == rows(fitted.labels)
