"""Pitch-shaped views over the driver tables, in SQL that Spark and the checker both run.

They only shape the inputs; nothing in the library depends on them."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

# A batter is forty parts, so there are more at a larger scale; every tenth one has no player row.
# The descriptions and pitch codes.
PITCH_VIEW = """
SELECT CAST(floor(l_orderkey / 10) AS BIGINT) AS game_pk, CAST(o_orderdate AS DATE) AS game_date, year(o_orderdate) AS game_year,
  CAST(floor(l_partkey / 40) AS BIGINT) AS batter, l_suppkey AS pitcher, l_linenumber AS inning,
  CAST(l_quantity AS INT) % 3 AS outs_when_up,
  CASE WHEN CAST(l_quantity AS INT) % 2 = 0 THEN 'Top' ELSE 'Bot' END AS inning_topbot,
  concat('T', CAST(o_custkey % 30 AS STRING)) AS home_team,
  concat('T', CAST((o_custkey + 7) % 30 AS STRING)) AS away_team,
  CASE CAST(l_quantity AS INT) % 9 WHEN 0 THEN 'swinging_strike' WHEN 1 THEN 'foul' WHEN 2 THEN 'hit_into_play'
    WHEN 3 THEN 'foul_tip' WHEN 4 THEN 'swinging_strike_blocked' WHEN 5 THEN 'hit_into_play_score'
    WHEN 6 THEN 'ball' WHEN 7 THEN 'called_strike' ELSE 'foul_bunt' END AS description,
  CASE (l_partkey + l_linenumber) % 10 WHEN 0 THEN 'FF' WHEN 1 THEN 'SI' WHEN 2 THEN 'FC' WHEN 3 THEN 'SL' WHEN 4 THEN 'CU'
    WHEN 5 THEN 'CH' WHEN 6 THEN 'FS' WHEN 7 THEN 'KN' WHEN 8 THEN 'ZZ' END AS pitch_type,
  CAST(floor(l_extendedprice) AS BIGINT) % 15 AS zone,
  (l_discount - 0.05) * 30 AS plate_x, l_tax * 60 AS plate_z,
  CASE WHEN l_tax = 0 THEN NULL ELSE 3.4 + l_discount END AS sz_top, 1.5 + l_discount AS sz_bot,
  CASE WHEN CAST(l_quantity AS INT) % 9 IN (2, 5) THEN 125.42 + (l_discount - 0.05) * 1500 END AS hc_x,
  CASE WHEN CAST(l_quantity AS INT) % 9 IN (2, 5) THEN 198.27 - l_quantity * 3 END AS hc_y,
  CASE WHEN CAST(l_quantity AS INT) % 9 IN (2, 5) THEN l_discount * 6 END AS estimated_ba_using_speedangle,
  CASE WHEN CAST(l_quantity AS INT) % 9 IN (2, 5) THEN l_discount * 6 + l_tax * 15 END AS estimated_slg_using_speedangle,
  CASE WHEN l_suppkey % 4 = 0 THEN 'L' ELSE 'R' END AS p_throws,
  CASE WHEN floor(l_partkey / 40) % 5 = 0 THEN CASE WHEN l_suppkey % 4 = 0 THEN 'R' ELSE 'L' END
       WHEN floor(l_partkey / 40) % 5 IN (1, 2) THEN 'L' ELSE 'R' END AS stand,
  l_linenumber % 4 AS balls, CAST(l_quantity AS INT) % 3 AS strikes,
  CASE l_linestatus WHEN 'F' THEN 'major' ELSE 'minor' END AS league
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
"""

PITCHERS_VIEW = """
SELECT s_suppkey AS player_id, concat(s_name, ', N', CAST(s_nationkey AS STRING)) AS player_name FROM supplier
"""

BATTERS_VIEW = """
SELECT player_id, CASE WHEN player_id % 3 = 0 THEN full_name ELSE replace(full_name, ' ', ', ') END AS player_name
FROM (SELECT CAST(floor(p_partkey / 40) AS BIGINT) AS player_id, min(p_name) AS full_name FROM part GROUP BY 1) grouped
WHERE player_id % 10 <> 9
"""

SCORED_VIEW = """
SELECT *, round(CAST((batter * 7 + pitcher * 13 + inning * 29) % 101 AS DOUBLE) / 101 * 0.6 + 0.1 + 0.2 * is_whiff, 6) AS score
FROM (SELECT game_pk, batter, pitcher, inning, zone, pitch_type, league,
        CASE WHEN description IN ('swinging_strike', 'swinging_strike_blocked') THEN 1 ELSE 0 END AS is_whiff
      FROM pitch_view WHERE description NOT IN ('ball', 'called_strike')) s
"""


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _view(spark: SparkSession, text: str, **frames: DataFrame) -> DataFrame:
    for name in frames:
        text = re.sub(rf"\b(FROM|JOIN) {name}\b", rf"\1 {{{name}}}", text)
    return spark.sql(text, **frames)


def pitch_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {t: _table(spark, sf_dir, t) for t in ("lineitem", "orders")}
    return _view(spark, PITCH_VIEW, **tables)


def pitchers_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, PITCHERS_VIEW, supplier=_table(spark, sf_dir, "supplier"))


def batters_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, BATTERS_VIEW, part=_table(spark, sf_dir, "part"))


def scored_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, SCORED_VIEW, pitch_view=pitch_view(spark, sf_dir))

