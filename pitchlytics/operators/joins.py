"""Joins of pitches with players and groups.

No side is broadcast by hint here. Player-sized sides come in as written tables (see
``storage.settle``), so the planner knows their size and broadcasts those under its
threshold; a larger side is shuffled and adaptive execution splits its skewed keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def semi_join_qualified(
    df: DataFrame, batters: DataFrame, pitchers: DataFrame, batter="batter", pitcher="pitcher"
) -> DataFrame:
    """Rows whose batter and pitcher both qualified."""
    return df.join(batters.select(batter), batter, "left_semi").join(
        pitchers.select(pitcher), pitcher, "left_semi"
    )


def anti_join_new(df: DataFrame, other: DataFrame, key) -> DataFrame:
    """Rows of ``df`` whose key is not in ``other``."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.join(other.select(*keys), keys, "left_anti")


def attach_groups(df: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """Every row with the groups of its player, NULL for players without one."""
    return df.join(groups, key, "left")


def fk_violations(fact: DataFrame, dim: DataFrame, fk: str, pk: str) -> DataFrame:
    """Rows whose non-null key is missing in the dimension."""
    known = dim.select(F.col(pk).alias(fk))
    return fact.where(F.col(fk).isNotNull()).join(known, fk, "left_anti")


def union_leagues(major: DataFrame, minor: DataFrame) -> DataFrame:
    """Both leagues in one frame, tagged by league."""
    return major.withColumn("league", F.lit("major")).unionByName(
        minor.withColumn("league", F.lit("minor"))
    )


def games_with_pitchers(games: DataFrame, pitchers: DataFrame) -> DataFrame:
    """Games with the names of both starters, NULL where unknown."""
    out = games
    for side in ("home", "away"):
        names = pitchers.select(
            F.col("player_id").alias(f"{side}_starting_pitcher"),
            F.col("player_name").alias(f"{side}_pitcher"),
        )
        out = out.join(names, f"{side}_starting_pitcher", "left")
    return out.select("game_pk", "game_date", "home_team", "away_team", "home_pitcher", "away_pitcher")
