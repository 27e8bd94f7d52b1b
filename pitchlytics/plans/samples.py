"""From pitches to a model-ready frame."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import pitch as P
from ..operators.aggregates import qualified_both
from ..operators.encode import (
    SIX_GROUPS,
    THREE_GROUPS,
    apply_labels,
    labels_of,
    quantile_groups,
    value_counts,
)
from ..operators.derive import count_bucket, count_bucket_strict, zone_index
from ..operators.filters import REQUIRED, complete_cases, date_window, drop_unseen, swings_only
from ..operators.joins import attach_groups, semi_join_qualified, union_leagues
from ..storage import settle

SAMPLE_COLUMNS = (
    "batter", "pitcher", "stand", "pitch_subtype", "is_zone", "zone", "p_throws", "balls",
    "strikes", "league",
)


@dataclass(frozen=True)
class Variant:
    """What a model variant takes from the sample and how it encodes it."""

    name: str
    columns: tuple[str, ...] = SAMPLE_COLUMNS
    required: tuple[str, ...] = REQUIRED
    #: quantile groups per player column: {group column: names from low to high}
    groups: dict[str, dict[str, tuple[str, ...]]] = field(default_factory=dict)
    #: league whose swings give the whiff rates, all leagues when None
    rates_from: str | None = None
    labels: tuple[str, ...] = ()
    strict_counts: bool = False


ENHANCED = Variant(
    "enhanced",
    groups={"batter": {"batter_whiff_group": THREE_GROUPS}},
    labels=(
        "batter", "pitcher", "stand", "pitch_subtype", "p_throws", "league",
        "batter_whiff_group", "count_bucket",
    ),
)
HIERARCHICAL = Variant(
    "hierarchical",
    groups={
        "batter": {"whiff_group_3": THREE_GROUPS, "whiff_group_6": SIX_GROUPS},
        "pitcher": {"pitcher_whiff_group_3": THREE_GROUPS, "pitcher_whiff_group_6": SIX_GROUPS},
    },
    rates_from="major",
    labels=(
        "batter", "pitcher", "stand", "pitch_subtype", "p_throws", "league", "whiff_group_3",
        "whiff_group_6", "pitcher_whiff_group_3", "pitcher_whiff_group_6",
    ),
)
TWO_WAY = Variant(
    "two_way",
    columns=tuple(c for c in SAMPLE_COLUMNS if c not in ("zone", "league")),
    required=tuple(c for c in REQUIRED if c != "zone"),
    labels=("batter", "pitcher", "stand", "pitch_subtype", "p_throws", "count_bucket"),
    strict_counts=True,
)


def swing_sample(
    major: DataFrame,
    minor: DataFrame,
    year: int,
    start: str,
    end: str,
    min_batter: int = 100,
    min_pitcher: int = 100,
    variant: Variant = ENHANCED,
    year_col: str | None = None,
) -> DataFrame:
    """Swings of both leagues in a date range by batters and pitchers who qualified in the
    majors that year, complete cases only, with the whiff flag.

    The qualified sets come from one scan of the season and are settled, so both semi joins
    are planned on their true size and the pitches are not shuffled while the sets are
    small. Name ``year_col`` on tables partitioned by year."""
    qualified = settle(qualified_both(major, year, min_batter, min_pitcher), "qualified")
    batters, pitchers = (
        qualified.where(F.col("role") == role).select(F.col("player_id").alias(role))
        for role in ("batter", "pitcher")
    )
    pitches = union_leagues(major, minor)
    rows = complete_cases(swings_only(date_window(pitches, start, end, year_col=year_col)), variant.required)
    rows = semi_join_qualified(rows, batters, pitchers)
    return rows.select(*variant.columns, P.whiff_flag().alias("is_whiff"))


@dataclass(frozen=True)
class Encoding:
    """Groups per player and labels fitted on a training sample, as settled tables."""

    groups: dict[str, DataFrame]
    labels: DataFrame


def _with_counts(sample: DataFrame, variant: Variant) -> DataFrame:
    return count_bucket_strict(sample) if variant.strict_counts else count_bucket(sample)


def _profile(sample: DataFrame, variant: Variant) -> DataFrame:
    """Swings and whiffs per value of every labelled column (and league): the one pass over
    the sample that groups, rates and labels are all read from."""
    own = [g for names in variant.groups.values() for g in names]
    cols = [c for c in variant.labels if c not in own]
    league = F.col("league") if "league" in variant.columns else F.lit(None).cast("string")
    tagged = _with_counts(sample, variant).withColumn("_league", league)
    return settle(value_counts(tagged, cols, ["_league"], "is_whiff"), "profile")


def _groups(profile: DataFrame, variant: Variant, types: dict[str, str]) -> dict[str, DataFrame]:
    out = {}
    for player, names in variant.groups.items():
        rows = profile.where(F.col("col") == player)
        if variant.rates_from is not None:
            rows = rows.where(F.col("_league") == variant.rates_from)
        rates = rows.groupBy(F.col("num").cast(types[player]).alias(player)).agg(
            (F.sum("whiffs") / F.sum("n")).alias("whiff_rate")
        )
        out[player] = settle(quantile_groups(rates, names).drop("whiff_rate"), "groups")
    return out


def fit_encoding(sample: DataFrame, variant: Variant = ENHANCED) -> Encoding:
    """Fit groups and labels on a sample, reading it once."""
    profile = _profile(sample, variant)
    groups = _groups(profile, variant, dict(sample.dtypes))
    values = profile.select("col", "num", "value")
    for player, names in variant.groups.items():
        players = profile.where(F.col("col") == player).select(F.col("num").alias(player)).distinct()
        grouped = attach_groups(players, groups[player], player)
        for g in names:
            values = values.unionByName(
                grouped.select(F.lit(g).alias("col"), F.lit(None).cast("bigint").alias("num"), F.col(g).alias("value"))
            )
    return Encoding(groups, settle(labels_of(values), "labels"))


def regroup(sample: DataFrame, encoding: Encoding, variant: Variant = ENHANCED) -> Encoding:
    """The encoding with player groups taken from ``sample`` itself and the labels kept. On a
    hold-out this lets outcomes choose the groups; the training groups are the default."""
    return Encoding(_groups(_profile(sample, variant), variant, dict(sample.dtypes)), encoding.labels)


def encode(sample: DataFrame, encoding: Encoding, variant: Variant = ENHANCED) -> DataFrame:
    """The sample with groups, buckets and label indexes; rows with unseen values dropped."""
    out = _with_counts(sample, variant)
    for player, groups in encoding.groups.items():
        out = attach_groups(out, groups, player)
    out = zone_index(apply_labels(out, encoding.labels, variant.labels))
    return drop_unseen(out, [f"{c}_idx" for c in variant.labels])


def model_frame(sample: DataFrame, variant: Variant = ENHANCED, encoding: Encoding | None = None) -> DataFrame:
    """A frame ready to fit (encoding fitted on it) or to score (training encoding given)."""
    return encode(sample, encoding or fit_encoding(sample, variant), variant)
