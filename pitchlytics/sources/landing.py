"""Readers for landed CSV files."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.players import one_name_per_player
from ..schema import LANDED_COLUMNS, PITCH_SCHEMA
from ..storage import settle

# Texts that stand for a missing value in a landed file.
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


#: First and last day of a stretch of days.
DayRange = tuple[dt.date, dt.date]


def in_ranges(day: str | Column, ranges: Sequence[DayRange]) -> Column:
    """Whether a day lies in one of the ranges."""
    day = F.col(day) if isinstance(day, str) else day
    hits = (day.between(F.lit(first), F.lit(last)) for first, last in ranges)
    return reduce(lambda a, b: a | b, hits, F.lit(False))


def on_days(day: str, ranges: Sequence[DayRange]) -> Column:
    """``in_ranges`` for a day that is read from a text: bound in a lambda, so it is read once and
    not once per bound when the planner moves the filter below the reading."""
    return F.exists(F.array(day), lambda d: in_ranges(d, ranges))


def readable(name: str, text: Column, dtype: T.DataType) -> Column:
    """A text that is not plainly written as its type: a token, a whole number with a decimal point, or wrong."""
    value = text.try_cast(dtype)
    if isinstance(dtype, T.IntegralType):
        value = F.coalesce(value, F.round(text.try_cast("double"), 0).try_cast(dtype))
    wrong = F.raise_error(F.concat(F.lit(f"{name}: unreadable "), text)).cast(dtype)
    return F.when(F.trim(text).isin(*NULL_TOKENS), F.lit(None).cast(dtype)).otherwise(F.coalesce(value, wrong))


def typed(name: str, dtype: T.DataType) -> Column:
    """A text column as its table type. A missing-value token is NULL, any other text that the
    type can't hold fails the read. Whole numbers may be written with a decimal point.

    The rare texts are read in a lambda: Spark then generates a small method per column, which the JVM
    compiles, where all of a file's columns in line make one method that it only interprets."""
    text = F.col(f"`{name}`")
    if isinstance(dtype, T.StringType):
        return F.when(~text.isin(*NULL_TOKENS), text).alias(name)
    plain = text.try_cast(dtype)
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        plain = F.nanvl(plain, F.lit(None).cast(dtype))
    rare = F.get(F.transform(F.array(text), lambda t: readable(name, t, dtype)), F.lit(0))
    return F.when(text.isNotNull(), F.coalesce(plain, rare)).alias(name)


def file_headers(spark: SparkSession, path: str, days: Sequence[DayRange] | None = None) -> DataFrame:
    """``file`` and ``fields``, its first line's, of every landed file: a pass over the text whose
    lines are reduced to one per file before they move."""
    lines = spark.read.text(path)
    if days is not None and "day" in lines.columns:
        lines = lines.where(in_ranges("day", days))
    placed = lines.select(
        F.col("_metadata.file_path").alias("file"), "value",
        F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")).alias("place"),
    )
    first = placed.groupBy("file").agg(F.min_by("value", "place").alias("value"))
    return first.select("file", F.transform(F.split("value", ","), lambda f: F.trim(f, F.lit(' "\ufeff'))).alias("fields"))


def texts(header: Sequence[str]) -> T.StructType:
    """A file schema with every column as text."""
    return T.StructType([T.StructField(c, T.StringType()) for c in header])


def as_schema(raw: DataFrame, header: Sequence[str], schema: T.StructType) -> DataFrame:
    """Text columns as the table columns, NULL for those the file lacks."""
    return raw.select(
        *(
            typed(f.name, f.dataType) if f.name in header else F.lit(None).cast(f.dataType).alias(f.name)
            for f in schema.fields
        )
    )


def read_landed_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    days: Sequence[DayRange] | None = None,
    header: Sequence[str] | None = None,
) -> DataFrame:
    """Header CSV files as ``schema``, each column found by its name in its own file.

    Files may order columns differently, lack any or carry extra ones; a column that a file
    lacks is NULL in its rows. A plain read of a folder applies the first header to all files,
    so a first pass over the text writes a table of the files and their headers. Where they
    differ, files are read by position and joined with that table, which tells where each
    column lies; of the files, only the folders of the days come to the driver. Give ``header``
    where all files share it: they are read in one pass, and a file with another header fails
    the read.

    ``days`` limits a folder laid out as ``day=YYYY-MM-DD`` to those ranges, and files of
    other days are not opened."""
    reader = spark.read.option("header", True).option("escape", '"')
    if header is not None:
        raw = reader.schema(texts(header)).option("enforceSchema", False).csv(path)
        if days is not None and "day" in raw.columns:
            raw = raw.where(in_ranges("day", days))
        return as_schema(raw, header, schema)
    # Where each column of the table lies in each file, from 1, and 0 for those it lacks.
    places = F.array(*(F.array_position("fields", f.name).cast("int") for f in schema.fields))
    ledger = settle(file_headers(spark, path, days).withColumn("places", places), "headers")
    kinds = ledger.select("fields").distinct().limit(2).collect()
    if not kinds:
        return spark.createDataFrame([], schema)
    # One folder a day, or the flat folder itself.
    folder = F.regexp_replace("file", "/[^/]*$", "").alias("folder")
    source = path if days is None else sorted(r["folder"] for r in ledger.select(folder).distinct().collect())
    if len(kinds) == 1:
        fields = kinds[0]["fields"]
        return as_schema(reader.schema(texts(fields)).csv(source), fields, schema)
    cells = [f"_{i}" for i in range(ledger.agg(F.max(F.size("fields"))).first()[0])]
    found = reader.schema(texts(cells)).csv(source).select(F.col("_metadata.file_path").alias("file"), F.array(*cells).alias("_cells"))
    named = found.join(ledger.select("file", "places"), "file").select(
        *(F.get("_cells", F.col("places")[i] - 1).alias(f.name) for i, f in enumerate(schema.fields)))
    return as_schema(named, schema.names, schema)


def landed_schema(ids: str = "int") -> T.StructType:
    """Schema of a landed pitch file. ``ids`` widens the game and player keys to bigint."""
    keys = ("game_pk", "batter", "pitcher")
    wide = T.LongType() if ids == "bigint" else None
    return T.StructType(
        [
            T.StructField(c, wide if wide and c in keys else PITCH_SCHEMA[c].dataType)
            for c in LANDED_COLUMNS
        ]
    )


def read_pitch_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    days: Sequence[DayRange] | None = None,
    header: Sequence[str] | None = None,
) -> DataFrame:
    """Landed pitches, typed; ``days`` and ``header`` as in ``read_landed_csv``."""
    return read_landed_csv(spark, path, schema or landed_schema(), days, header)


def read_player_csv(
    spark: SparkSession, path: str, id_type: T.DataType | None = None, header: Sequence[str] | None = None
) -> DataFrame:
    """Landed players, one row per id; ``header`` as in ``read_landed_csv``."""
    schema = T.StructType(
        [T.StructField("player_id", id_type or T.IntegerType()), T.StructField("player_name", T.StringType())]
    )
    rows = read_landed_csv(spark, path, schema, header=header)
    return one_name_per_player(rows.where(F.col("player_id").isNotNull()))
