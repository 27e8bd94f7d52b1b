"""Table schemas and other fixed values of the pitch data model."""

from __future__ import annotations

from pyspark.sql import types as T

# Column names and types of the pitch table, in table order.
PITCH_DDL = """
    game_pk INT, game_date DATE, pitch_type STRING, release_speed DOUBLE,
    release_pos_x DOUBLE, release_pos_z DOUBLE, batter INT, pitcher INT,
    events STRING, description STRING, zone INT, stand STRING, p_throws STRING,
    home_team STRING, away_team STRING, hit_location INT, bb_type STRING,
    balls INT, strikes INT, game_year INT, pfx_x DOUBLE, pfx_z DOUBLE,
    plate_x DOUBLE, plate_z DOUBLE, outs_when_up INT, inning INT,
    inning_topbot STRING, hc_x DOUBLE, hc_y DOUBLE, vx0 DOUBLE, vy0 DOUBLE,
    vz0 DOUBLE, ax DOUBLE, ay DOUBLE, az DOUBLE, sz_top DOUBLE, sz_bot DOUBLE,
    hit_distance_sc DOUBLE, launch_speed DOUBLE, launch_angle DOUBLE,
    effective_speed DOUBLE, release_spin_rate DOUBLE, release_extension DOUBLE,
    release_pos_y DOUBLE, estimated_ba_using_speedangle DOUBLE,
    estimated_woba_using_speedangle DOUBLE, estimated_slg_using_speedangle DOUBLE,
    estimated_iso_using_speedangle DOUBLE, phi DOUBLE, pitch_name STRING,
    post_away_score INT, post_home_score INT, if_fielding_alignment STRING,
    of_fielding_alignment STRING, spin_axis INT, delta_home_win_exp DOUBLE,
    delta_run_exp DOUBLE, bat_speed DOUBLE, swing_length DOUBLE,
    home_win_exp DOUBLE, api_break_z_with_gravity DOUBLE,
    api_break_x_batter_in DOUBLE, arm_angle DOUBLE, attack_angle DOUBLE,
    attack_direction DOUBLE, swing_path_tilt DOUBLE,
    intercept_ball_minus_batter_pos_x_inches DOUBLE,
    intercept_ball_minus_batter_pos_y_inches DOUBLE, HA_factor DOUBLE,
    HA_Adj_estimated_xISO DOUBLE, is_zone INT, pitch_bucket STRING,
    pitch_subtype STRING
"""

# Columns computed from a pitch, never loaded from a landed file.
DERIVED_DDL = """
    phi DOUBLE, estimated_iso_using_speedangle DOUBLE, HA_factor DOUBLE,
    HA_Adj_estimated_xISO DOUBLE, blast INT, is_zone INT, pitch_bucket STRING,
    pitch_subtype STRING
"""

PITCHERS_DDL = "player_id INT, player_name STRING, p_throws STRING"
BATTERS_DDL = "player_id INT, player_name STRING, stand STRING"

LINEUP_SIZE = 9

# Season start and end (first and last regular-season day) per league and year.
SEASONS = (
    ("major", 2021, "2021-04-01", "2021-10-03"),
    ("major", 2022, "2022-04-07", "2022-10-05"),
    ("major", 2023, "2023-03-30", "2023-10-01"),
    ("major", 2024, "2024-03-28", "2024-09-29"),
    ("major", 2025, "2025-03-27", "2025-09-28"),
    ("minor", 2023, "2023-03-31", "2023-09-24"),
    ("minor", 2024, "2024-03-29", "2024-09-22"),
    ("minor", 2025, "2025-03-28", "2025-09-21"),
)


_TYPES = {"INT": T.IntegerType(), "DOUBLE": T.DoubleType(), "STRING": T.StringType(), "DATE": T.DateType()}


def _struct(ddl: str) -> T.StructType:
    columns = (column.split() for column in ddl.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in columns])


PITCH_SCHEMA = _struct(PITCH_DDL)
DERIVED_SCHEMA = _struct(DERIVED_DDL)
PITCHERS_SCHEMA = _struct(PITCHERS_DDL)
BATTERS_SCHEMA = _struct(BATTERS_DDL)

#: Columns a landed file may supply: the pitch table without the derived ones.
LANDED_COLUMNS = [c for c in PITCH_SCHEMA.names if c not in DERIVED_SCHEMA.names]

START_GAME_SCHEMA = _struct(
    "game_pk INT, game_date DATE, home_team STRING, away_team STRING, "
    "home_starting_pitcher INT, away_starting_pitcher INT, "
    + ", ".join(
        f"{side}_batter_{k} INT" for side in ("home", "away") for k in range(1, LINEUP_SIZE + 1)
    )
)
