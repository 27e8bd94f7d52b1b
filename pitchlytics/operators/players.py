"""Player dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import anti_join_new


def one_name_per_player(df: DataFrame) -> DataFrame:
    """One row per player id; the smallest name wins when a player was renamed."""
    return df.groupBy("player_id").agg(F.min("player_name").alias("player_name"))


def insert_new_players(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """``existing`` plus the incoming players whose id is new. Columns only the existing
    table has are NULL for the new rows."""
    new = anti_join_new(incoming, existing, "player_id")
    return existing.unionByName(new, allowMissingColumns=True)


def player_hand(players: DataFrame, pitches: DataFrame, player: str, attr: str) -> DataFrame:
    """Fill ``attr`` of each player from the pitches: the most frequent value, the smallest on
    ties, NULL for players without pitches."""
    seen = (
        pitches.where(F.col(player).isNotNull() & F.col(attr).isNotNull())
        .groupBy(F.col(player).alias("player_id"), attr)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    best = seen.groupBy("player_id").agg(F.min(F.struct(-F.col("n"), F.col(attr)))[attr].alias(attr))
    return players.drop(attr).join(best, "player_id", "left")
