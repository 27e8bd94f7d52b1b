"""One line-up row per game.

Pitches are first reduced to one row per (game, half, batter, pitcher) with a codegen hash
aggregate on plain columns, so a game with very many pitches is already small when it
reaches the reducer of its game. All later steps are keyed by game and share one exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import LINEUP_SIZE, START_GAME_SCHEMA

# The home side pitches in the top half of an inning and bats in the bottom half.
PITCHING = {"Top": "home", "Bot": "away"}
BATTING = {"Bot": "home", "Top": "away"}

_LAST = (1 << 31) - 1


def _moment(inning="inning", outs="outs_when_up") -> Column:
    """Inning and outs as one sortable BIGINT, unknown values last."""

    def part(c: str) -> Column:
        v = F.col(c).cast("bigint")
        bad = F.raise_error(F.concat(F.lit(f"{c} out of range: "), v.cast("string"))).cast("bigint")
        return F.when(v.isNull(), F.lit(_LAST)).when(v.between(0, _LAST - 1), v).otherwise(bad)

    return F.shiftleft(part(inning), 31) + part(outs)


def _nulls_last(*cols: str) -> Column:
    """A struct that orders like its columns with NULLs last."""
    fields = []
    for c in cols:
        fields += [F.col(c).isNull().alias(f"{c}_unknown"), F.col(c)]
    return F.struct(*fields)


def _appearances(df: DataFrame, *extra: str) -> DataFrame:
    keys = ["game_pk", "inning_topbot", "game_date", *extra]
    return df.where(F.col("game_pk").isNotNull()).groupBy(*keys).agg(F.min(_moment()).alias("moment"))


def unique_games(df: DataFrame) -> DataFrame:
    """One row per game; a game spread over several dates keeps the earliest."""
    games = df.select("game_pk", "game_date", "home_team", "away_team").where(F.col("game_pk").isNotNull())
    first = _nulls_last("game_date", "home_team", "away_team")
    return (
        games.distinct()
        .groupBy("game_pk")
        .agg(F.min(first).alias("g"))
        .select("game_pk", "g.game_date", "g.home_team", "g.away_team")
    )


def starting_pitchers(df: DataFrame) -> DataFrame:
    """First pitcher of each half of a game, by date, inning, outs and then pitcher id."""
    seen = _appearances(df.where(F.col("pitcher").isNotNull() & F.col("inning_topbot").isNotNull()), "pitcher")
    first = _nulls_last("game_date", "moment", "pitcher")
    return seen.groupBy("game_pk").agg(
        *(
            F.min(F.when(F.col("inning_topbot") == half, first))["pitcher"].alias(f"{side}_starting_pitcher")
            for half, side in PITCHING.items()
        )
    )


def first_nine_batters(df: DataFrame, n: int = LINEUP_SIZE) -> DataFrame:
    """The first ``n`` distinct batters of each side, in order of appearance, batter id on ties."""
    seen = _appearances(
        df.where(F.col("batter").isNotNull() & F.col("inning_topbot").isin(*BATTING)), "batter"
    )
    first = seen.repartition("game_pk").groupBy("game_pk", "inning_topbot", "batter").agg(
        F.min(_nulls_last("game_date", "moment")).alias("first_seen")
    )
    order = Window.partitionBy("game_pk", "inning_topbot").orderBy("first_seen", "batter")
    side = F.when(F.col("inning_topbot") == "Bot", "home").otherwise("away")
    return (
        first.withColumn("position", F.row_number().over(order))
        .where(F.col("position") <= n)
        .select("game_pk", side.alias("side"), "position", "batter")
    )


def start_game(df: DataFrame) -> DataFrame:
    """One row per game: date, teams, both starters and nine batters a side, NULL-padded."""
    seen = _appearances(df, "home_team", "away_team", "batter", "pitcher")
    pitcher_seen = F.when(F.col("pitcher").isNotNull(), _nulls_last("game_date", "moment", "pitcher"))
    per_batter = seen.repartition("game_pk").groupBy("game_pk", "inning_topbot", "batter").agg(
        F.min(_nulls_last("game_date", "moment")).alias("first_seen"),
        F.min(pitcher_seen).alias("pitcher_seen"),
        F.min(_nulls_last("game_date", "home_team", "away_team")).alias("game"),
    )
    order = Window.partitionBy("game_pk", "inning_topbot").orderBy(
        F.col("batter").isNull(), "first_seen", "batter"
    )
    placed = per_batter.withColumn("position", F.row_number().over(order))

    starters = [
        F.min(F.when(F.col("inning_topbot") == half, F.col("pitcher_seen")))["pitcher"].alias(
            f"{side}_starting_pitcher"
        )
        for half, side in PITCHING.items()
    ]
    batters = [
        F.max(
            F.when((F.col("inning_topbot") == half) & (F.col("position") == k), F.col("batter"))
        ).alias(f"{side}_batter_{k}")
        for half, side in BATTING.items()
        for k in range(1, LINEUP_SIZE + 1)
    ]
    games = placed.groupBy("game_pk").agg(F.min("game").alias("game"), *starters, *batters)
    return games.select("*", "game.game_date", "game.home_team", "game.away_team").select(
        *START_GAME_SCHEMA.names
    )


def preview_games(games: DataFrame, n: int = 5) -> DataFrame:
    """The first ``n`` games by key."""
    return games.orderBy("game_pk").limit(n)
