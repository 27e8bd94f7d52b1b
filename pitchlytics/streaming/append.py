"""Streaming form of the incremental load: process what has landed, then stop.

A file is read once, so rows of days that are not yet due are held: a batch writes them to a table
of its own beside the stream's progress, as they landed, and a later call releases them."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.load import completed, landed_rows, ranges_to_load, season_calendar, table_schema
from ..schema import LANDED_COLUMNS, SEASONS
from ..sources.landing import as_schema, on_days, texts
from ..sources.tables import LOAD, append_pitches, current_path

#: A day after all seasons.
NEVER = "9999-12-31"
#: Partitions of the held rows: the batch that read them and their day.
HELD = ("held_batch", "held_day")


def landed_stream(spark: SparkSession, path: str, header: Sequence[str], schema: T.StructType) -> DataFrame:
    """A stream of landed files that all have the column order ``header``. A file whose
    header differs stops the stream instead of being read by position."""
    raw = (
        spark.readStream.schema(texts(header))
        .option("header", True)
        .option("enforceSchema", False)
        .option("escape", '"')
        .csv(path)
    )
    return as_schema(raw, header, schema)


def stream_append(
    spark: SparkSession,
    landing: str,
    league: str,
    header: Sequence[str],
    table_path: str,
    progress_path: str,
    as_of: str,
    landed: T.StructType,
    seasons: Sequence[tuple] = SEASONS,
) -> None:
    """Append the in-season rows of all files not yet processed, up to the day before
    ``as_of``, and those that earlier calls held back until their days came; return when done.

    The stream's own progress log remembers the files. Each batch is written as a load of its
    own, named by stream and batch, so a batch that is replayed after a lost executor or a
    restarted driver replaces what it wrote before, held rows too. Held rows are released after
    all batches are done, one load per batch and day, and are deleted when they are in the table;
    a release that is cut short is done again and replaces itself. The table has no sink log:
    batch loads and readers see the same rows. Days are judged by the calendar only: a late file
    for an old day is still taken. A held day that a batch load has taken meanwhile, from the same
    files, is not released again. Files that landed after the call are left to the next one."""
    unmarked = spark.createDataFrame([], "league string, latest_date date")
    # one range per season, so rows are picked by a filter and do not move
    ranges = ranges_to_load(season_calendar(spark, seasons), unmarked, NEVER).where(F.col("league") == league)
    in_season = on_days("game_date", [(r["first"], r["last"]) for r in ranges.collect()])
    schema = table_schema(landed)
    rows = landed_stream(spark, f"{landing}/{league}", header, landed).withColumn("league", F.lit(league))
    stream = hashlib.sha256(progress_path.encode()).hexdigest()[:16]
    held, due = f"{progress_path}-held", F.col("game_date") < F.lit(as_of).cast("date")

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            append_pitches(batch.where(due), table_path, f"stream-{stream}-{number}", derive=lambda placed: completed(placed, schema))
            # A replay may find more days due than the first run did.
            _delete(spark, f"{held}/{HELD[0]}={number}")
            later = batch.where(~due).withColumns({HELD[0]: F.lit(number), HELD[1]: F.col("game_date")})
            later.hint("rebalance", *HELD).write.mode("append").partitionBy(*HELD).parquet(held)
        finally:
            batch.unpersist()

    query = (
        landed_rows(rows.where(in_season), schema, header)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", progress_path)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    _release(spark, held, table_path, schema, league, stream, as_of)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _release(
    spark: SparkSession, held: str, table_path: str, schema: T.StructType, league: str, stream: str, as_of: str
) -> None:
    """Append the held rows of the days before ``as_of`` and delete them where they were held."""
    given = [f for f in schema.fields if f.name in LANDED_COLUMNS or f.name == "league"]
    layout = T.StructType([*given, T.StructField(HELD[0], T.LongType()), T.StructField(HELD[1], T.DateType())])
    try:
        stored = spark.read.schema(layout).parquet(held)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return
    due = stored.where(F.col(HELD[1]) < F.lit(as_of).cast("date"))
    places = due.select(*HELD).distinct().collect()  # one row per held batch and day
    if not places:
        return
    name = F.concat_ws("-", F.lit(f"stream-{stream}"), HELD[0], F.lit("held"), HELD[1])
    try:
        table = spark.read.parquet(current_path(spark, table_path))
        taken = table.where((F.col("league") == league) & ~F.col(LOAD).startswith("stream-")).select("game_date").distinct()
        due = due.join(taken, "game_date", "left_anti")
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
    append_pitches(due, table_path, name, columns=[f.name for f in given], derive=lambda placed: completed(placed, schema))
    for r in places:
        _delete(spark, f"{held}/{HELD[0]}={r[HELD[0]]}/{HELD[1]}={r[HELD[1]]}")
