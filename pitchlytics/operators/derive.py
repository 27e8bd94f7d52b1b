"""Derived columns on a pitch table, one projection each, no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import pitch as P


def round_doubles(df: DataFrame, digits: int = 4, half_even: bool = True) -> DataFrame:
    """Round every DOUBLE column; ``half_even`` sends ties to the even digit."""
    rounded = F.bround if half_even else F.round
    return df.withColumns({c: rounded(F.col(f"`{c}`"), digits) for c, t in df.dtypes if t == "double"})


def hit_angle(df: DataFrame) -> DataFrame:
    return df.withColumn("phi", P.hit_angle())


def expected_iso(df: DataFrame) -> DataFrame:
    return df.withColumn("estimated_iso_using_speedangle", P.expected_iso())


def ha_factor(df: DataFrame) -> DataFrame:
    return df.withColumn("HA_factor", P.ha_factor())


def ha_adj_xiso(df: DataFrame) -> DataFrame:
    return df.withColumn("HA_Adj_estimated_xISO", P.ha_adj_xiso())


def blast_flag(df: DataFrame) -> DataFrame:
    return df.withColumn("blast", P.blast_flag())


def zone_flag(df: DataFrame) -> DataFrame:
    return df.withColumn("is_zone", P.zone_flag())


def pitch_bucket(df: DataFrame) -> DataFrame:
    return df.withColumn("pitch_bucket", P.pitch_bucket())


def pitch_subtype(df: DataFrame) -> DataFrame:
    return df.withColumn("pitch_subtype", P.pitch_subtype())


def advanced_metrics(df: DataFrame) -> DataFrame:
    """All eight derived columns in one pass. Running it again changes nothing."""
    return (
        df.withColumns(
            {
                "phi": P.hit_angle(),
                "estimated_iso_using_speedangle": P.expected_iso(),
                "is_zone": P.zone_flag(),
                "pitch_bucket": P.pitch_bucket(),
                "pitch_subtype": P.pitch_subtype(),
            }
        )
        .withColumn("HA_factor", P.ha_factor())
        .withColumn("HA_Adj_estimated_xISO", P.ha_adj_xiso())
        .withColumn("blast", P.blast_flag())
    )


def flip_player_name(df: DataFrame) -> DataFrame:
    return df.withColumn("player_name", P.flip_name())


def whiff_flag(df: DataFrame) -> DataFrame:
    return df.withColumn("is_whiff", P.whiff_flag())


def count_bucket(df: DataFrame) -> DataFrame:
    return df.withColumn("count_bucket", P.count_bucket())


def count_bucket_strict(df: DataFrame) -> DataFrame:
    """Strict buckets; rows with a count outside the lists are dropped."""
    return df.withColumn("count_bucket", P.count_bucket_strict()).where(F.col("count_bucket").isNotNull())


def zone_index(df: DataFrame) -> DataFrame:
    """Integer positions: ``zone_idx`` in/out of zone, ``zone_num_idx`` in the 13-zone grid."""
    out = df.withColumn("zone_idx", F.col("is_zone").cast("int"))
    return out.withColumn("zone_num_idx", P.zone_num_index()) if "zone" in df.columns else out
