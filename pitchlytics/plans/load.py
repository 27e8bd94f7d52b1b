"""Incremental load of landed pitches by date, and the whole load pipeline."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.aggregates import metric_coverage
from ..operators.derive import advanced_metrics, flip_player_name, round_doubles
from ..operators.joins import anti_join_new
from ..schema import DERIVED_SCHEMA, LANDED_COLUMNS, SEASONS
from ..sources.landing import DayRange, landed_schema, on_days, read_pitch_csv, read_player_csv
from ..operators.players import player_hand
from ..sources.tables import (
    LOAD, PARTITIONS, TABLES, append_pitches, conform_to_schema, current_path, newest_seasons, overwrite_table, read_pitches,
    replace_table,
)


def season_calendar(spark: SparkSession, seasons: Sequence[tuple] = SEASONS) -> DataFrame:
    """One row per league and season with its first and last day."""
    rows = [(lg, y, dt.date.fromisoformat(a), dt.date.fromisoformat(b)) for lg, y, a, b in seasons]
    return spark.createDataFrame(rows, "league string, game_year int, start date, end date")


def ranges_to_load(calendar: DataFrame, latest: DataFrame, as_of: str) -> DataFrame:
    """First and last due day per league and season: after the league's high-water mark, up
    to the day before ``as_of``. ``latest`` is ``(league, latest_date)``; a league without a
    mark starts at its first season."""
    before = F.date_sub(F.lit(dt.date.fromisoformat(as_of)), 1)
    ranges = calendar.join(latest, "league", "left").select(
        "league",
        F.greatest("start", F.date_add("latest_date", 1)).alias("first"),
        F.least("end", before).alias("last"),
    )
    return ranges.where(F.col("first") <= F.col("last"))


def dates_to_load(calendar: DataFrame, latest: DataFrame, as_of: str) -> DataFrame:
    """The due days one by one, at most one row per league and day of the calendar."""
    return ranges_to_load(calendar, latest, as_of).select(
        "league", F.explode(F.sequence("first", "last")).alias("game_date")
    )


def marks(table: DataFrame) -> DataFrame:
    """Latest loaded date per league."""
    return table.groupBy("league").agg(F.max("game_date").alias("latest_date"))


def stored_marks(spark: SparkSession, path: str, table: DataFrame) -> DataFrame:
    """``marks`` of a stored table from its newest season only; from all of it if a league's
    newest season holds no rows."""
    newest = newest_seasons(spark, path)
    if not newest:
        return marks(table)
    last = reduce(lambda a, b: a | b, ((F.col("league") == lg) & (F.col("game_year") == y) for lg, y in newest.items()))
    found = marks(table.where(last)).collect()  # one row per league
    if {r["league"] for r in found if r["latest_date"] is not None} != newest.keys():
        return marks(table)
    return spark.createDataFrame([tuple(r) for r in found], "league string, latest_date date")


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A Parquet table, empty before its first write."""
    try:
        return read_pitches(spark, path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], schema)


@dataclass(frozen=True)
class Landing:
    """Where files land and how pitches are typed.

    Pitches land under ``<path>/<league>``, best in one folder per day (``day=YYYY-MM-DD``):
    a load then opens the folders of its days only, however long the history is. ``headers``
    names the shared header of a league's files, which saves a pass over their text."""

    path: str
    schema: T.StructType
    headers: Mapping[str, Sequence[str]] = field(default_factory=dict)

    def pitches(self, spark: SparkSession, league: str, ranges: Sequence[DayRange]) -> DataFrame:
        header = self.headers.get(league)
        rows = read_pitch_csv(spark, f"{self.path}/{league}", self.schema, ranges, header)
        return rows.where(on_days("game_date", ranges)).withColumn("league", F.lit(league))


def table_schema(landed: T.StructType) -> T.StructType:
    """The pitch table with the key types of the landed files, ``blast`` and the league."""
    fields = [landed[f.name] if f.name in landed.names else f for f in TABLES["pitches_major"].fields]
    return T.StructType([*fields, T.StructField("league", T.StringType())])


def landed_rows(pitches: DataFrame, schema: T.StructType, header: Iterable[str] | None = None) -> DataFrame:
    """What of a landed row must travel to its place in the table: the columns that its files have
    (``header``, all if unknown), conformed and rounded, with the league and the season."""
    have = set(LANDED_COLUMNS if header is None else header) | {"game_year", "game_date"}
    kept = [c for c in schema.names if c == "league" or (c in LANDED_COLUMNS and c in have)]
    ready = round_doubles(conform_to_schema(pitches, T.StructType([schema[c] for c in kept]), kept))
    return ready.withColumn("game_year", F.coalesce(F.col("game_year"), F.year("game_date")))


def completed(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """``landed_rows`` as table rows, with derived columns; columns beside the table's stay. The
    derived columns depend on their own row only, so they are computed as rows arrive, when they
    lie in their place, and the table is never rewritten."""
    beside = [c for c in rows.columns if c not in schema.names]
    full = conform_to_schema(rows, T.StructType([*schema.fields, *(rows.schema[c] for c in beside)]), rows.columns)
    return advanced_metrics(full).select(*schema.names, *beside)


def pending(
    spark: SparkSession, landing: Landing, latest: DataFrame, calendar: DataFrame, as_of: str
) -> DataFrame | None:
    """Landed rows of the days that are due, None when no day is. One range per season comes
    to the driver and selects the files to open."""
    due: dict[str, list[DayRange]] = {}
    for row in ranges_to_load(calendar, latest, as_of).collect():
        due.setdefault(row["league"], []).append((row["first"], row["last"]))
    parts = [landing.pitches(spark, league, sorted(ranges)) for league, ranges in sorted(due.items())]
    return reduce(DataFrame.unionByName, parts) if parts else None


def incremental_append(
    spark: SparkSession, landing: Landing, table_path: str, as_of: str, seasons: Sequence[tuple] = SEASONS
) -> None:
    """Append every due day of both leagues in one job. Days already loaded are not read
    again, so a second run with the same files appends nothing."""
    schema = table_schema(landing.schema)
    table = read_table(spark, table_path, schema)
    latest = stored_marks(spark, table_path, table)
    rows = pending(spark, landing, latest, season_calendar(spark, seasons), as_of)
    if rows is not None:
        known = [landing.headers.get(league) for league in {s[0] for s in seasons}]
        header = set().union(*known) if all(known) else None
        append_pitches(landed_rows(rows, schema, header), table_path, derive=lambda placed: completed(placed, schema))


def load_players(spark: SparkSession, landing: Landing, base: str, kind: str) -> None:
    """Add the landed players of one kind whose id is new."""
    schema = TABLES[kind]
    ids = landing.schema["pitcher"].dataType
    schema = T.StructType([T.StructField("player_id", ids), *schema.fields[1:]])
    existing = read_table(spark, f"{base}/{kind}", schema)
    incoming = read_player_csv(spark, f"{landing.path}/{kind}", ids, landing.headers.get(kind))
    new = conform_to_schema(anti_join_new(incoming, existing, "player_id"), schema, schema.names)
    new.write.mode("append").parquet(current_path(spark, f"{base}/{kind}"))


def pipeline_run(
    spark: SparkSession,
    landing_path: str,
    base: str,
    as_of: str,
    seasons: Sequence[tuple] = SEASONS,
    landed: T.StructType | None = None,
    headers: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    """Players, then both leagues with derived columns, then the coverage report."""
    landing = Landing(landing_path, landed or landed_schema(), headers or {})
    for kind in ("pitchers", "batters"):
        load_players(spark, landing, base, kind)
    incremental_append(spark, landing, f"{base}/pitches", as_of, seasons)
    return metric_coverage(read_table(spark, f"{base}/pitches", table_schema(landing.schema)))


def clean_players(spark: SparkSession, base: str) -> None:
    """Write back both player tables with the hand seen in the stored pitches and the name as
    first name, last name. Names without a comma stay, so running it again changes no name."""
    pitches = read_pitches(spark, f"{base}/pitches")
    for kind, player, attr in (("pitchers", "pitcher", "p_throws"), ("batters", "batter", "stand")):
        path = f"{base}/{kind}"
        players = read_pitches(spark, path)
        overwrite_table(flip_player_name(player_hand(players, pitches, player, attr)).select(players.columns), path)


def refresh_metrics(spark: SparkSession, path: str) -> None:
    """Derive the columns of a stored pitch table again, as after a change of a formula. The new
    rows are a version of the table that replaces it at once; layout and loads stay. Stale columns do
    not travel, the new ones are derived from rows that lie in their place."""
    stored = spark.read.parquet(current_path(spark, path))
    given = stored.drop(*DERIVED_SCHEMA.names)
    replace_table(given, path, [*PARTITIONS, LOAD], lambda placed: advanced_metrics(placed).select(stored.columns))
