"""Row filters, all plain predicates that the planner pushes to the scan."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import pitch as P

#: Columns a swing needs to enter a sample.
REQUIRED = ("pitch_subtype", "is_zone", "zone", "p_throws", "stand", "pitcher", "balls", "strikes")


def swings_only(df: DataFrame) -> DataFrame:
    return df.where(P.is_swing())


def date_window(df: DataFrame, start: str, end: str, date_col="game_date", year_col: str | None = None) -> DataFrame:
    """Rows of an inclusive date range. Name ``year_col`` on a table partitioned by the year
    of the date, so that the range also prunes partitions."""
    first, last = dt.date.fromisoformat(start), dt.date.fromisoformat(end)
    keep = F.col(date_col).between(F.lit(first), F.lit(last))
    if year_col is not None:
        keep = keep & F.col(year_col).between(first.year, last.year)
    return df.where(keep)


def season_filter(df: DataFrame, year: int, year_col="game_year") -> DataFrame:
    return df.where(F.col(year_col) == year)


def complete_cases(df: DataFrame, cols=REQUIRED) -> DataFrame:
    """Rows with every listed column, a real pitch subtype and, when ``zone`` is listed, a
    zone of the 13-zone grid."""
    out = df.dropna(subset=list(cols))
    if "pitch_subtype" in cols:
        out = out.where(F.col("pitch_subtype") != "Other")
    if "zone" in cols:
        out = out.where(F.col("zone").isin(*P.ZONES))
    return out


def drop_unseen(df: DataFrame, cols) -> DataFrame:
    """Rows whose label indexes are all known (an unseen value has index -1)."""
    keep = F.lit(True)
    for c in cols:
        keep = keep & (F.col(c) != -1)
    return df.where(keep)
