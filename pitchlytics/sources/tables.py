"""Parquet tables: schema conformance, scans and sinks."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S

PARTITIONS = ("league", "game_year")

#: Innermost partition of a pitch table: the load that wrote the rows. A load that is written
#: again under the same name replaces itself.
LOAD = "load"

#: The day of a row, by which rows lie inside a file.
DAY = "game_date"

#: The tables of the data model. Both leagues share one pitch schema; ``blast`` is the
#: column added after the declared ones.
TABLES = {
    "pitchers": S.PITCHERS_SCHEMA,
    "batters": S.BATTERS_SCHEMA,
    "pitches_major": T.StructType([*S.PITCH_SCHEMA.fields, T.StructField("blast", T.IntegerType())]),
    "pitches_minor": T.StructType([*S.PITCH_SCHEMA.fields, T.StructField("blast", T.IntegerType())]),
    "start_game": S.START_GAME_SCHEMA,
}


def create_tables(spark: SparkSession, base: str, database: str) -> list[str]:
    """Create the five tables as external Parquet tables unless they exist. Pitch tables are
    partitioned by season."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database} LOCATION '{base}'")
    names = []
    for table, schema in TABLES.items():
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        by = "PARTITIONED BY (game_year)" if "game_year" in schema.names else ""
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {database}.{table} ({columns}) USING parquet {by} "
            f"LOCATION '{base}/{table}'"
        )
        names.append(f"{database}.{table}")
    return names


def insert_rows(df: DataFrame, name: str, season: str = "game_year") -> None:
    """Add rows to a created table, column by column in its order. A table partitioned by season takes
    one season after the other, from the folders of that season when ``df`` is a stored table: rows of one
    folder need no sort before they are written, which wide rows would spill."""
    spark = df.sparkSession
    if season not in df.columns:
        return df.write.insertInto(name)
    found = {r[0] for r in df.select(season).distinct().collect()}  # one row per season
    for year in sorted(found - {None}):
        rows = df.where(F.col(season) == year).drop(season)
        spark.sql(f"INSERT INTO {name} PARTITION ({season} = {int(year)}) SELECT * FROM {{rows}}", rows=rows)
    if None in found:
        df.where(F.col(season).isNull()).write.insertInto(name)


def add_columns_if_missing(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Typed NULL columns for the names ``df`` lacks; others are left alone."""
    have = {c.lower() for c in df.columns}
    new = {c: F.lit(None).cast(t) for c, t in columns.items() if c.lower() not in have}
    return df.withColumns(new) if new else df


def conform_to_schema(df: DataFrame, schema: T.StructType, keep: Iterable[str] = S.LANDED_COLUMNS) -> DataFrame:
    """The kept columns both sides have, in table order, NULL for every other table column."""
    taken = set(keep) & set(df.columns)
    return df.select(
        *(
            F.col(f"`{f.name}`").cast(f.dataType).alias(f.name)
            if f.name in taken
            else F.lit(None).cast(f.dataType).alias(f.name)
            for f in schema.fields
        )
    )


def scan_pitches(spark: SparkSession, path: str, league: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Pitches of one league, only the named columns, tagged with the league. On a table
    partitioned by league the tag is a partition filter."""
    df = read_pitches(spark, path)
    if "league" in df.columns:
        df = df.where(F.col("league") == league)
    else:
        df = df.withColumn("league", F.lit(league))
    return df.select(*dict.fromkeys([*columns, "league"])) if columns else df


def _files(spark: SparkSession, path: str):
    """The store behind a path, and the path in it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def current_path(spark: SparkSession, path: str) -> str:
    """Where the rows of a table are now: in the version its pointer names, or, if it was never
    replaced, in its own folder."""
    store, pointer = _files(spark, f"{path}.versions/current")
    if not store.exists(pointer):
        return path
    stream = store.open(pointer)
    try:
        name = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return f"{path}.versions/{name}"


def _point_to(spark: SparkSession, path: str, version: str) -> None:
    """Move the pointer of a table in one step."""
    jvm = spark.sparkContext._jvm
    store, aside = _files(spark, f"{path}.versions/.current-{version}")
    out = store.create(aside, True)
    out.write(bytearray(version.encode()))
    out.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(aside, _files(spark, f"{path}.versions/current")[1], options)


def _laid_out(df: DataFrame, partitions: Sequence[str], spread: Sequence[str] | None = None) -> DataFrame:
    """Rows in evenly sized files of their partitions, those of a file in order of their day, so
    that a scan of some days of a season skips the pages of the others. The writer sorts by
    partition anyway; the day is one more sort key."""
    rows = df.hint("rebalance", *(partitions if spread is None else spread))
    return rows.sortWithinPartitions(*partitions, DAY) if DAY in df.columns else rows


def replace_table(
    df: DataFrame, path: str, partitions: Sequence[str] = (), derive: Callable[[DataFrame], DataFrame] | None = None
) -> None:
    """Replace the contents of a table all at once. ``df`` may read from it; ``derive`` as in
    ``append_pitches``.

    The rows are written to a version of their own and the table's pointer then moves to it: a
    reader (``current_path``) sees the old rows or the new ones, and a driver that is lost on the
    way leaves the old ones. The version before stays for those who still read it; older ones
    go."""
    spark = df.sparkSession
    before, version = current_path(spark, path), f"v-{uuid.uuid4().hex}"
    placed = _laid_out(df, partitions)
    if derive is not None:
        placed = derive(placed)
    placed.write.partitionBy(*partitions).parquet(f"{path}.versions/{version}")
    _point_to(spark, path, version)
    store, folder = _files(spark, f"{path}.versions")
    for status in store.listStatus(folder):
        name = status.getPath().getName()
        if name.startswith("v-") and name != version and not before.endswith(name):
            store.delete(status.getPath(), True)


def append_pitches(
    df: DataFrame, path: str, load: str | Column | None = None, partitions: Sequence[str] = PARTITIONS,
    columns: Sequence[str] | None = None, derive: Callable[[DataFrame], DataFrame] | None = None,
) -> None:
    """Add rows to a table partitioned by league, season and load. The rebalance hint lets
    adaptive execution merge small partitions and split a season that holds most of the rows,
    so files come out evenly sized. Rows of a ``load`` that was written before are replaced,
    those of other loads stay; without a name the load is a new one. A name may depend on the row,
    also on columns that are not among those kept (``columns``). ``derive`` adds columns to rows that
    already lie in their place, so that they need not travel and be sorted; it keeps the others."""
    named = df.withColumn(LOAD, F.lit(f"load-{uuid.uuid4().hex}") if load is None else F.lit(load))
    if columns is not None:
        named = named.select(*columns, LOAD)
    path = current_path(df.sparkSession, path)
    placed = _laid_out(named, [*partitions, LOAD], partitions)
    if derive is not None:
        placed = derive(placed)
    placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions, LOAD).parquet(path)


def read_pitches(spark: SparkSession, path: str) -> DataFrame:
    """A stored pitch table without the load column."""
    return spark.read.parquet(current_path(spark, path)).drop(LOAD)


def newest_seasons(spark: SparkSession, path: str) -> dict[str, int]:
    """Last season of each league from the partition folders, without opening a file."""
    jvm = spark.sparkContext._jvm
    pattern = jvm.org.apache.hadoop.fs.Path(f"{current_path(spark, path)}/league=*/game_year=*")
    found: dict[str, int] = {}
    for status in pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern) or []:
        season = status.getPath()
        league, year = season.getParent().getName().partition("=")[2], season.getName().partition("=")[2]
        if year.isdigit():
            found[league] = max(int(year), found.get(league, 0))
    return found


def overwrite_table(df: DataFrame, path: str) -> DataFrame:
    """Replace the contents of a table and return it as it is now. ``df`` may read from it."""
    replace_table(df, path)
    return read_pitches(df.sparkSession, path)


def write_report_csv(df: DataFrame, path: str) -> None:
    """A report (one row per metric or group) as a single CSV file with header."""
    df.repartition(1).write.mode("overwrite").option("header", True).csv(path)


def save_tables(tables: Mapping[str, DataFrame], path: str) -> None:
    """Persist named results (metrics, predictions, labels, parameters) side by side."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_tables(spark: SparkSession, path: str, names: Iterable[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def save_eval_tables(path: str, metrics: DataFrame, predictions: DataFrame, **by_group: DataFrame) -> None:
    """Results of an evaluation: overall metrics, predictions, one table per grouping."""
    save_tables({"metrics": metrics, "predictions": predictions, **by_group}, path)


def save_labels(labels: DataFrame, path: str) -> None:
    save_tables({"labels": labels}, path)


def register_frame(df: DataFrame, name: str) -> None:
    """Make a frame queryable in SQL by name."""
    df.createOrReplaceTempView(name)
