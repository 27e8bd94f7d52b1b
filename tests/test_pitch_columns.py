import math

import pytest
from pyspark.sql import functions as F

from pitchlytics.functions import pitch as P
from pitchlytics.operators import derive as D
from pitchlytics.operators import filters as L

BATTED = "hc_x double, hc_y double, estimated_ba_using_speedangle double, estimated_slg_using_speedangle double"
PLACE = "plate_x double, plate_z double, sz_top double, sz_bot double, pitch_type string"


def batted(frame, *values):
    df = frame(f"{BATTED}, {PLACE}", [(*values, 0.0, 2.5, 3.5, 1.69, "FF")])
    return D.advanced_metrics(df).first()


def test_hit_angle_straight_ahead(frame):
    row = batted(frame, 125.42, 100.0, None, None)
    assert row.phi == 0.0
    assert row.HA_factor == pytest.approx(0.569)
    assert row.estimated_iso_using_speedangle is None
    assert row.HA_Adj_estimated_xISO is None and row.blast is None


def test_level_with_home_plate_is_unknown(frame):
    row = batted(frame, 130.0, 198.27, 0.2, 0.6)
    assert (row.phi, row.HA_factor, row.HA_Adj_estimated_xISO, row.blast) == (None, None, None, None)


def test_factor_is_clamped(frame):
    got = frame("phi double", [(1.4,), (-1.4,), (0.5,), (None,)]).select(P.ha_factor().alias("f")).collect()
    assert [g.f for g in got] == pytest.approx([1.138, 1.138, 0.569 * 0.25 + 0.569, None])


def test_blast_threshold(frame):
    df = frame("estimated_iso_using_speedangle double, HA_factor double", [(0.3, 1.138), (0.2, 1.138), (None, 1.0)])
    got = D.blast_flag(D.ha_adj_xiso(df)).collect()
    assert got[0].HA_Adj_estimated_xISO == pytest.approx(0.3414)
    assert [g.blast for g in got] == [1, 0, None]


@pytest.mark.parametrize(
    "x, z, top, bot, inside",
    [
        (0.0, 2.5, 3.5, 1.69, 1),
        (0.0, 1.44, 3.5, 1.69, 1),
        (0.0, 3.51, 3.5, 1.69, 0),
        (10 / 12, 2.5, 3.5, 1.69, 1),
        (0.9, 2.5, 3.5, 1.69, 0),
        (0.0, 2.5, None, 1.69, 0),
        (None, 2.5, 3.5, 1.69, None),
        (0.0, None, 3.5, 1.69, None),
    ],
)
def test_zone_flag(frame, x, z, top, bot, inside):
    df = frame("plate_x double, plate_z double, sz_top double, sz_bot double", [(x, z, top, bot)])
    assert D.zone_flag(df).first().is_zone == inside


def test_pitch_codes(frame):
    df = D.pitch_bucket(D.pitch_subtype(frame("pitch_type string", [(c,) for c in ("FF", "SV", "FO", "KN", "ZZ", None)])))
    assert [(r.pitch_bucket, r.pitch_subtype) for r in df.collect()] == [
        ("Fastball", "Fastball"),
        ("Breaking Ball", "Curveball"),
        ("Off-speed", "Splitter"),
        ("Other", "Other"),
        (None, None),
        (None, None),
    ]
    assert len(P.PITCH_CODES) == 20 and len({c for c, _, _ in P.PITCH_CODES}) == 20


def test_names(frame):
    names = [("Smith, Jr., Bob",), ("Ohtani, Shohei",), ("Madonna",), (None,)]
    got = D.flip_player_name(frame("player_name string", names)).collect()
    assert [r.player_name for r in got] == ["Jr. Smith", "Shohei Ohtani", "Madonna", None]


COUNTS = [(0, 0), (3, 2), (2, 1), (3, 0), (1, 2)]


def test_count_buckets(frame):
    df = frame("balls int, strikes int", COUNTS)
    assert [r.count_bucket for r in D.count_bucket(df).collect()] == ["neutral", "at_risk", "ahead", "neutral", "at_risk"]
    assert [r.count_bucket for r in D.count_bucket_strict(df).collect()] == ["neutral", "ahead", "ahead", "at_risk"]


def test_zone_numbers(frame):
    got = D.zone_index(frame("is_zone int, zone int", [(1, z) for z in (1, 9, 10, 11, 14, 0)])).collect()
    assert [r.zone_num_idx for r in got] == [0, 8, None, 9, 12, None]


def test_rounding_ties_go_to_the_even_digit(frame):
    df = frame("x double, y int", [(0.00025, 1), (0.00035, 2)])
    assert [tuple(r) for r in D.round_doubles(df).collect()] == [(0.0002, 1), (0.0004, 2)]


def test_metrics_twice_change_nothing(frame):
    df = frame(f"{BATTED}, {PLACE}", [(140.0, 90.0, 0.3, 0.9, 0.1, 2.0, 3.4, 1.5, "CH")])
    once = D.advanced_metrics(df)
    assert D.advanced_metrics(once).collect() == once.collect()
    assert math.isclose(once.first().phi, math.atan((140.0 - 125.42) / (198.27 - 90.0)))


def test_complete_cases(frame):
    schema = "pitch_subtype string, is_zone int, zone int, p_throws string, stand string, pitcher int, balls int, strikes int"
    good = ("Slider", 1, 11, "L", "R", 7, 0, 0)
    bad = [("Other", *good[1:]), ("Slider", 1, 10, *good[3:]), ("Slider", None, *good[2:]), (None, *good[1:])]
    assert [tuple(r) for r in L.complete_cases(frame(schema, [good, *bad])).collect()] == [good]


def test_date_window_is_inclusive_and_prunes(spark, frame):
    df = frame("d string", [("2000-09-30",), ("2000-10-01",), ("2001-08-01",), ("2001-08-02",)])
    df = df.select(F.col("d").cast("date").alias("game_date")).withColumn("game_year", F.year("game_date"))
    kept = L.date_window(df, "2000-10-01", "2001-08-01", year_col="game_year")
    assert kept.count() == 2
