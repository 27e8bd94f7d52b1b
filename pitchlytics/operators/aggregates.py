"""Grouped counts and rates. Every one is a hash aggregate with a map-side partial step, so
a key that holds a large share of the rows arrives at its reducer as one row per task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .filters import season_filter, swings_only


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows"))


def latest_date(df: DataFrame, col="game_date") -> DataFrame:
    """High-water mark; one NULL row when the table is empty."""
    return df.agg(F.max(col).alias("latest_date"))


def metric_coverage(df: DataFrame, col="HA_Adj_estimated_xISO", by="league") -> DataFrame:
    """Rows with a value against all rows, per league."""
    return df.groupBy(by).agg(F.count(col).alias("with_metric"), F.count(F.lit(1)).alias("total"))


def qualified_players(df: DataFrame, key: str, year: int, min_swings: int = 100) -> DataFrame:
    """Players with more than ``min_swings`` swings in a season."""
    swings = swings_only(season_filter(df, year)).where(F.col(key).isNotNull())
    return (
        swings.groupBy(key).agg(F.count(F.lit(1)).alias("swings")).where(F.col("swings") > min_swings)
    )


def qualified_both(df: DataFrame, year: int, min_batter: int = 100, min_pitcher: int = 100) -> DataFrame:
    """Qualified batters and pitchers as ``(role, player_id)``, from one scan of the season."""
    swings = swings_only(season_filter(df, year)).select("batter", "pitcher")
    per_player = swings.groupingSets([["batter"], ["pitcher"]], "batter", "pitcher").agg(
        F.grouping("batter").alias("is_pitcher"), F.count(F.lit(1)).alias("swings")
    )
    pitcher = F.col("is_pitcher") == 1
    return (
        per_player.select(
            F.when(pitcher, "pitcher").otherwise("batter").alias("role"),
            F.when(pitcher, F.col("pitcher")).otherwise(F.col("batter")).alias("player_id"),
            "swings",
        )
        .where(F.col("player_id").isNotNull())
        .where(F.col("swings") > F.when(F.col("role") == "pitcher", min_pitcher).otherwise(min_batter))
    )


def distinct_players(df: DataFrame) -> DataFrame:
    return df.select("player_id", "player_name").distinct()


def player_whiff_rate(df: DataFrame, key: str, league: str | None = None) -> DataFrame:
    """Swings and share of whiffs per player, on all rows or on one league."""
    rows = df if league is None else df.where(F.col("league") == league)
    return (
        rows.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("swings"), F.avg("is_whiff").alias("whiff_rate"))
    )


def overall_whiff_rate(df: DataFrame, label="is_whiff") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"), F.avg(label).alias("whiff_rate"))


def first_group_per_player(df: DataFrame, key: str, col: str) -> DataFrame:
    """One group index per player (the index is constant within a player)."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(col).alias(col))


def swing_cells(frame: DataFrame, keys, label="is_whiff") -> DataFrame:
    """Swings and whiffs per distinct key combination, all the model likelihood needs."""
    return frame.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(label).cast("bigint").alias("whiffs")
    )


def pk_violations(df: DataFrame, key) -> DataFrame:
    """Keys that occur more than once."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
