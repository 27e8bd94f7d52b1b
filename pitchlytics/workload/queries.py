"""Registered queries: one per operator, over the whole driver tables.

A query takes ``(spark, sf_dir)`` and returns a DataFrame. Computed doubles are rounded to
nine digits, since the order of a sum differs between runs and engines."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import derive as D
from ..operators import encode as E
from ..operators import evaluate as V
from ..operators import filters as L
from ..operators import fitting as P
from ..operators import games as G
from ..operators import joins as J
from ..operators import model as M
from ..operators import players as R
from ..plans import load, modelling, samples
from ..schema import DERIVED_SCHEMA, LANDED_COLUMNS, PITCH_SCHEMA
from ..sources import landing, tables
from ..storage import new_folder, settle
from ..streaming import append as stream
from . import settings as S
from . import views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

ID = ("game_pk", "game_date", "batter", "pitcher", "inning")


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    """Doubles to nine digits, with negative zero as zero."""
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c, t in df.dtypes if t == "double"})


def with_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return D.advanced_metrics(views.pitch_view(spark, sf))


# --- scans, sources, sinks ------------------------------------------------------------


#: What a session has already written, by kind: landed files and the stored pitch table.
_WRITTEN: dict[tuple[str, str, str], str] = {}


def written_once(spark: SparkSession, sf: str, kind: str, write: Callable[[str], None]) -> str:
    """Path of an input that many queries start from, written once per session."""
    key = (spark.sparkContext.applicationId, sf, kind)
    if key not in _WRITTEN:
        path = new_folder(spark, kind)
        write(path)
        _WRITTEN[key] = path
    return _WRITTEN[key]


def headers(spark: SparkSession, sf: str) -> dict[str, list[str]]:
    """Column order of each league's landed files; the minor ones have it turned round."""
    order = [c for c in views.pitch_view(spark, sf).columns if c != "league"]
    return {"major": order, "minor": order[::-1]}


def landed_players(spark: SparkSession, sf: str, kind: str) -> str:
    """The players of a kind as landed CSV files."""
    players = {"pitchers": views.pitchers_view, "batters": views.batters_view}[kind]
    return written_once(spark, sf, kind, lambda path: players(spark, sf).write.option("header", True).csv(path))


def land(spark: SparkSession, sf: str) -> str:
    """The driver tables as landed CSV files, one folder per league and player kind."""

    def write(path: str) -> None:
        pitches = views.pitch_view(spark, sf)
        for league, columns in headers(spark, sf).items():
            rows = pitches.where(F.col("league") == league).select(*columns)
            rows.write.option("header", True).csv(f"{path}/{league}")
        for kind, players in (("pitchers", views.pitchers_view), ("batters", views.batters_view)):
            players(spark, sf).write.option("header", True).csv(f"{path}/{kind}")

    return written_once(spark, sf, "landing", write)


LANDED = landing.landed_schema("bigint")


@query
def read_pitch_csv(spark, sf):
    path, orders = land(spark, sf), headers(spark, sf)
    major, minor = (
        landing.read_pitch_csv(spark, f"{path}/{lg}", LANDED, header=orders[lg]) for lg in ("major", "minor")
    )
    return rounded(J.union_leagues(major, minor).select(*orders["major"], "league"))


@query
def read_pitch_csv_mixed(spark, sf):
    """Files of two column orders in one read, which looks for their headers."""
    path, pitches, orders = new_folder(spark, "mixed"), views.pitch_view(spark, sf), headers(spark, sf)
    for league, order in orders.items():
        rows = pitches.where(F.col("league") == league).select(*order)
        rows.write.mode("append").option("header", True).csv(path)
    return rounded(landing.read_pitch_csv(spark, path, LANDED).select(*orders["major"]))


@query
def read_player_csv(spark, sf):
    return landing.read_player_csv(spark, landed_players(spark, sf, "batters"), LANDED["batter"].dataType)


def pitch_table(spark: SparkSession, sf: str) -> str:
    """The stored pitch table with its derived columns, partitioned by league and season.
    The queries on samples and models start from it, as they would in production."""

    def write(path: str) -> None:
        tables.append_pitches(views.pitch_view(spark, sf), path, derive=D.advanced_metrics)

    return written_once(spark, sf, "pitches", write)


def stored_leagues(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    path = pitch_table(spark, sf)
    major, minor = (tables.scan_pitches(spark, path, lg).drop("league") for lg in ("major", "minor"))
    return major, minor


@query
def build_pitch_table(spark, sf):
    """Rows of a pitch table that is derived and written anew."""
    path = new_folder(spark, "pitches")
    tables.append_pitches(with_metrics(spark, sf), path)
    return spark.read.parquet(path).groupBy("league", "game_year").agg(
        F.count(F.lit(1)).alias("n"), F.sum("blast").cast("bigint").alias("blasts")
    )


@query
def scan_pitches(spark, sf):
    return tables.scan_pitches(spark, pitch_table(spark, sf), "minor", ["game_pk", "batter", "pitcher", "description"])


@query
def create_tables(spark, sf):
    base = new_folder(spark, "warehouse")
    names = tables.create_tables(spark, base, f"pitchlytics_{uuid.uuid4().hex[:12]}")
    major, minor = stored_leagues(spark, sf)
    content = {
        "pitchers": views.pitchers_view(spark, sf),
        "batters": views.batters_view(spark, sf),
        "pitches_major": major,
        "pitches_minor": minor,
        "start_game": G.start_game(major.unionByName(minor)),
    }
    out = None
    for name in names:
        short = name.split(".")[1]
        schema = spark.table(name).schema
        tables.insert_rows(tables.conform_to_schema(content[short], schema, schema.names), name)
        table = spark.table(name)
        filled = F.sum(sum((F.col(c).isNotNull().cast("long") for c in table.columns), F.lit(0)))
        key = F.sum(F.coalesce("game_pk" if "game_pk" in table.columns else "player_id", F.lit(0)).cast("long"))
        rows = table.agg(
            F.lit(short).alias("table_name"), F.count(F.lit(1)).alias("n_rows"), filled.alias("n_filled"), key.alias("key_sum"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query
def add_columns_if_missing(spark, sf):
    wanted = {f.name: f.dataType.simpleString() for f in DERIVED_SCHEMA} | {"description": "string"}
    df = tables.add_columns_if_missing(views.pitch_view(spark, sf), wanted)
    return df.select(*ID, "description", *DERIVED_SCHEMA.names)


@query
def conform_to_schema(spark, sf):
    df = views.pitch_view(spark, sf).withColumn("unknown_column", F.lit(1))
    return rounded(tables.conform_to_schema(df, PITCH_SCHEMA))


@query
def append_pitches(spark, sf):
    path = new_folder(spark, "pitches")
    pitches = views.pitch_view(spark, sf)
    for league in ("major", "minor"):
        tables.append_pitches(pitches.where(F.col("league") == league), path)
    return spark.read.parquet(path).groupBy("league", "game_year").agg(
        F.count(F.lit(1)).alias("n"), F.sum("pitcher").alias("pitcher_sum")
    )


@query
def overwrite_table(spark, sf):
    path = new_folder(spark, "games")
    pitches = views.pitch_view(spark, sf)
    tables.overwrite_table(G.unique_games(pitches.where(F.col("league") == "major")), path)
    return tables.overwrite_table(G.unique_games(pitches), path)


@query
def insert_new_players(spark, sf):
    players = views.batters_view(spark, sf)
    known = players.where(~F.col("player_name").contains(",")).withColumn("stand", F.lit("L"))
    return R.insert_new_players(known, players)


@query
def write_report_csv(spark, sf):
    path = new_folder(spark, "report")
    report = V.metrics_by_group(views.scored_view(spark, sf), "pitch_type")
    tables.write_report_csv(rounded(report), path)
    return spark.read.schema(report.schema).option("header", True).csv(path)


@query
def save_eval_tables(spark, sf):
    path = new_folder(spark, "evaluation")
    scored = views.scored_view(spark, sf)
    tables.save_eval_tables(
        path,
        V.evaluation_report(scored),
        scored.select("is_whiff", "score"),
        by_pitch_type=V.metrics_by_group(scored, "pitch_type"),
    )
    saved = tables.load_tables(spark, path, ["metrics", "predictions", "by_pitch_type"])
    overall = saved["metrics"].select(F.lit("all").alias("group"), "metric", "value")
    sums = (F.count("score").cast("double").alias("scores"), F.sum("score").alias("score_sum"), F.sum("is_whiff").cast("double").alias("whiffs"))
    predicted = saved["predictions"].agg(F.lit("predictions").alias("group"), *sums)
    wide = saved["by_pitch_type"].withColumn("n", F.col("n").cast("double")).withColumnRenamed("pitch_type", "group")
    for df in (predicted, wide):
        overall = overall.unionByName(df.unpivot("group", [c for c in df.columns if c != "group"], "metric", "value"))
    return rounded(overall, 6)


@query
def save_labels(spark, sf):
    path = new_folder(spark, "labels")
    tables.save_labels(E.fit_labels(train_sample(spark, sf), ["batter", "pitcher", "stand", "pitch_subtype"]), path)
    return tables.load_tables(spark, path, ["labels"])["labels"]


@query
def register_frame(spark, sf):
    name = f"frame_{uuid.uuid4().hex[:12]}"
    tables.register_frame(views.pitch_view(spark, sf), name)
    return spark.sql(
        f"SELECT league, description, count(*) AS n FROM {name} GROUP BY league, description"
    )


# --- incremental load -----------------------------------------------------------------


@query
def latest_date(spark, sf):
    return A.latest_date(views.pitch_view(spark, sf))


@query
def season_calendar(spark, sf):
    """In-season pitches per season of the calendar."""
    calendar = load.season_calendar(spark, S.SEASONS)
    pitches = views.pitch_view(spark, sf)
    return (
        pitches.join(calendar, ["league", "game_year"])
        .groupBy("league", "game_year", "start", "end")
        .agg(F.count_if(F.col("game_date").between(F.col("start"), F.col("end"))).alias("in_season"))
    )


@query
def dates_to_load(spark, sf):
    loaded = views.pitch_view(spark, sf).where(
        (F.col("game_date") < F.lit(S.FIRST_AS_OF).cast("date")) & (F.col("league") == "major")
    )
    return load.dates_to_load(load.season_calendar(spark, S.SEASONS), load.marks(loaded), S.AS_OF)


def table_totals(table: DataFrame) -> DataFrame:
    return rounded(
        table.groupBy("league", "game_year").agg(
            F.count(F.lit(1)).alias("n"),
            F.max("game_date").alias("last_day"),
            F.sum("pitcher").alias("pitcher_sum"),
            F.avg("plate_x").alias("mean_plate_x"),
            F.sum("blast").cast("bigint").alias("blasts"),
        )
    )


@query
def incremental_append(spark, sf):
    """Two loads a year apart and a third that finds nothing new."""
    source = load.Landing(land(spark, sf), LANDED, headers(spark, sf))
    path = new_folder(spark, "pitches")
    for as_of in (S.FIRST_AS_OF, S.AS_OF, S.AS_OF):
        load.incremental_append(spark, source, path, as_of, S.SEASONS)
    return table_totals(spark.read.parquet(path))


@query
def incremental_append_stream(spark, sf):
    """One table filled by both leagues' streams, by two batch loads a year later, the second
    of which finds nothing new, and by the streams again, which find no new file."""
    path, table, orders = land(spark, sf), new_folder(spark, "pitches"), headers(spark, sf)
    progress = {lg: new_folder(spark, "progress") for lg in orders}

    def streams() -> None:
        for lg, order in orders.items():
            stream.stream_append(spark, path, lg, order, table, progress[lg], S.FIRST_AS_OF, LANDED, S.SEASONS)

    streams()
    for _ in range(2):
        load.incremental_append(spark, load.Landing(path, LANDED, orders), table, S.AS_OF, S.SEASONS)
    streams()
    return table_totals(spark.read.parquet(table))


@query
def stream_held_rows(spark, sf):
    """Both leagues' streams over files that hold all days, at three dates: rows that are not yet
    due are held, and released by the later calls."""
    path, table, orders = land(spark, sf), new_folder(spark, "pitches"), headers(spark, sf)
    for lg, order in orders.items():
        progress = new_folder(spark, "progress")
        for as_of in (S.FIRST_AS_OF, S.SECOND_AS_OF, S.AS_OF):
            stream.stream_append(spark, path, lg, order, table, progress, as_of, LANDED, S.SEASONS)
    return table_totals(spark.read.parquet(table))


@query
def pipeline_run(spark, sf):
    base = new_folder(spark, "base")
    return load.pipeline_run(spark, land(spark, sf), base, S.AS_OF, S.SEASONS, LANDED, headers(spark, sf))


@query
def clean_players(spark, sf):
    """Both player tables after a load and the clean-up."""
    base = new_folder(spark, "base")
    load.pipeline_run(spark, land(spark, sf), base, S.AS_OF, S.SEASONS, LANDED, headers(spark, sf))
    load.clean_players(spark, base)
    pitchers, batters = (tables.read_pitches(spark, f"{base}/{kind}") for kind in ("pitchers", "batters"))
    kinds = (pitchers.withColumnRenamed("p_throws", "hand"), "pitcher"), (batters.withColumnRenamed("stand", "hand"), "batter")
    first, second = (df.withColumn("kind", F.lit(kind)) for df, kind in kinds)
    return first.unionByName(second)


@query
def refresh_metrics(spark, sf):
    """Derived columns after a table with stale ones was refreshed."""
    path = new_folder(spark, "pitches")
    stale = {"phi": F.lit(0.0), "blast": F.lit(None).cast("int"), "pitch_bucket": F.lit("old")}
    tables.append_pitches(views.pitch_view(spark, sf), path, derive=lambda placed: D.advanced_metrics(placed).withColumns(stale))
    load.refresh_metrics(spark, path)
    return rounded(tables.read_pitches(spark, path).select(*ID, *DERIVED_SCHEMA.names))


# --- derived columns ------------------------------------------------------------------


@query
def round_doubles(spark, sf):
    df = views.pitch_view(spark, sf).select(*ID, "plate_x", "plate_z", "sz_top", "sz_bot", "hc_x", "hc_y")
    return D.round_doubles(df, 4).transform(rounded)


def derived(name: str, op: Callable[[DataFrame], DataFrame], column: str, *needs: Callable) -> None:
    def run(spark, sf):
        df = views.pitch_view(spark, sf)
        for need in needs:
            df = need(df)
        return rounded(op(df).select(*ID, column))

    QUERIES[name] = run


derived("hit_angle", D.hit_angle, "phi")
derived("expected_iso", D.expected_iso, "estimated_iso_using_speedangle")
derived("ha_factor", D.ha_factor, "HA_factor", D.hit_angle)
derived("ha_adj_xiso", D.ha_adj_xiso, "HA_Adj_estimated_xISO", D.hit_angle, D.ha_factor, D.expected_iso)
derived("blast_flag", D.blast_flag, "blast", D.hit_angle, D.ha_factor, D.expected_iso, D.ha_adj_xiso)
derived("zone_flag", D.zone_flag, "is_zone")
derived("pitch_bucket", D.pitch_bucket, "pitch_bucket")
derived("pitch_subtype", D.pitch_subtype, "pitch_subtype")
derived("whiff_flag", D.whiff_flag, "is_whiff")
derived("count_bucket", D.count_bucket, "count_bucket")
derived("count_bucket_strict", D.count_bucket_strict, "count_bucket")


@query
def advanced_metrics(spark, sf):
    return rounded(with_metrics(spark, sf).select(*ID, *DERIVED_SCHEMA.names))


@query
def blast_share(spark, sf):
    """Batted balls, blasts and mean adjusted ISO per pitch bucket."""
    df = with_metrics(spark, sf).groupBy("pitch_bucket").agg(
        F.count("blast").alias("batted_balls"),
        F.sum("blast").cast("bigint").alias("blasts"),
        F.avg("HA_Adj_estimated_xISO").alias("mean_xiso"),
    )
    return rounded(df)


@query
def flip_player_name(spark, sf):
    players = views.pitchers_view(spark, sf).unionByName(views.batters_view(spark, sf))
    return D.flip_player_name(players)


@query
def zone_index(spark, sf):
    return D.zone_index(D.zone_flag(views.pitch_view(spark, sf))).select(*ID, "zone_idx", "zone_num_idx")


# --- filters --------------------------------------------------------------------------


@query
def swings_only(spark, sf):
    return L.swings_only(views.pitch_view(spark, sf)).select(*ID, "description")


@query
def date_window(spark, sf):
    path = pitch_table(spark, sf)
    return L.date_window(spark.read.parquet(path), *S.HOLD_OUT, year_col="game_year").select(*ID, "league")


@query
def season_filter(spark, sf):
    return L.season_filter(views.pitch_view(spark, sf), S.YEAR).select(*ID, "game_year")


@query
def complete_cases(spark, sf):
    return L.complete_cases(with_metrics(spark, sf)).select(*ID, *L.REQUIRED[:-3])


@query
def drop_unseen(spark, sf):
    labels = settle(E.fit_labels(train_sample(spark, sf), ["pitcher"]), "labels")
    pitches = E.apply_labels(views.pitch_view(spark, sf), labels, ["pitcher"])
    return L.drop_unseen(pitches, ["pitcher_idx"]).select(*ID, "pitcher_idx")


# --- joins ----------------------------------------------------------------------------


@query
def semi_join_qualified(spark, sf):
    pitches = views.pitch_view(spark, sf)
    major = pitches.where(F.col("league") == "major")
    batters = settle(A.qualified_players(major, "batter", S.YEAR, S.MIN_BATTER), "batters")
    pitchers = settle(A.qualified_players(major, "pitcher", S.YEAR, S.MIN_PITCHER), "pitchers")
    return J.semi_join_qualified(pitches, batters, pitchers).select(*ID, "league")


@query
def anti_join_new(spark, sf):
    pitches = views.pitch_view(spark, sf)
    return J.anti_join_new(
        pitches.select(F.col("batter").alias("player_id")).distinct(), views.batters_view(spark, sf), "player_id"
    )


@query
def games_with_pitchers(spark, sf):
    return J.games_with_pitchers(G.start_game(views.pitch_view(spark, sf)), views.pitchers_view(spark, sf))


@query
def player_hand(spark, sf):
    pitches = views.pitch_view(spark, sf)
    p = R.player_hand(views.pitchers_view(spark, sf), pitches, "pitcher", "p_throws")
    b = R.player_hand(views.batters_view(spark, sf), pitches, "batter", "stand")
    kinds = (p.withColumnRenamed("p_throws", "hand"), "pitcher"), (b.withColumnRenamed("stand", "hand"), "batter")
    first, second = (df.withColumn("kind", F.lit(kind)) for df, kind in kinds)
    return first.unionByName(second)


@query
def attach_groups(spark, sf):
    sample = train_sample(spark, sf)
    rates = settle(A.player_whiff_rate(sample, "batter"), "rates")
    groups = E.quantile_groups(rates, {"batter_whiff_group": E.THREE_GROUPS})
    return J.attach_groups(sample, groups.select("batter", "batter_whiff_group"), "batter").select(
        "batter", "pitcher", "zone", "is_whiff", "batter_whiff_group"
    )


@query
def fk_violations(spark, sf):
    bad = J.fk_violations(views.pitch_view(spark, sf), views.batters_view(spark, sf), "batter", "player_id")
    return bad.select(*ID, "league")


@query
def gather_effect(spark, sf):
    frame, params = scoring_inputs(spark, sf, samples.ENHANCED, M.ENHANCED)
    keys = M.key_columns(M.ENHANCED)
    cells = settle(frame.select(*keys).distinct(), "cells")
    out = None
    for term in M.ENHANCED:
        total = F.aggregate(term.name, F.lit(0.0), lambda a, x: a + x)
        # cells that share a term's keys share its effect, which meets them once
        shared = cells.groupBy(*term.keys).agg(F.count(F.lit(1)).alias("n"))
        found = F.sum(F.when(F.col(term.name).isNotNull(), F.col("n")).otherwise(0))
        part = M.gather_effect(shared, params, term).groupBy("draw_block").agg(
            F.lit(term.name).alias("term"), found.alias("found"), F.sum(F.col("n") * total).alias("effect_sum"))
        out = part if out is None else out.unionByName(part)
    return rounded(out)


# --- aggregates -----------------------------------------------------------------------


@query
def row_count(spark, sf):
    return A.row_count(views.pitch_view(spark, sf))


@query
def metric_coverage(spark, sf):
    return A.metric_coverage(with_metrics(spark, sf))


def qualified(name: str, key: str, least: int) -> None:
    def run(spark, sf):
        major = views.pitch_view(spark, sf).where(F.col("league") == "major")
        return A.qualified_players(major, key, S.YEAR, least)

    QUERIES[name] = run


qualified("qualified_players", "batter", S.MIN_BATTER)
qualified("qualified_pitchers", "pitcher", S.MIN_PITCHER)


@query
def qualified_both(spark, sf):
    major = views.pitch_view(spark, sf).where(F.col("league") == "major")
    return A.qualified_both(major, S.YEAR, S.MIN_BATTER, S.MIN_PITCHER)


@query
def unique_games(spark, sf):
    return G.unique_games(views.pitch_view(spark, sf))


@query
def distinct_players(spark, sf):
    players = views.batters_view(spark, sf)
    seen = views.pitch_view(spark, sf).select(F.col("batter").alias("player_id"))
    return A.distinct_players(seen.join(players, "player_id"))


@query
def player_whiff_rate(spark, sf):
    sample = train_sample(spark, sf)
    every = A.player_whiff_rate(sample, "batter").withColumn("rates_from", F.lit("all"))
    major = A.player_whiff_rate(sample, "batter", "major").withColumn("rates_from", F.lit("major"))
    return rounded(every.unionByName(major))


@query
def quantile_groups(spark, sf):
    rates = settle(A.player_whiff_rate(train_sample(spark, sf), "pitcher"), "rates")
    return rounded(E.quantile_groups(rates, {"group_3": E.THREE_GROUPS, "group_6": E.SIX_GROUPS}))


@query
def first_group_per_player(spark, sf):
    return A.first_group_per_player(frame_of(spark, sf, samples.HIERARCHICAL), "batter_idx", "whiff_group_6_idx")


@query
def overall_whiff_rate(spark, sf):
    return rounded(A.overall_whiff_rate(train_sample(spark, sf)))


@query
def pk_violations(spark, sf):
    return A.pk_violations(views.pitch_view(spark, sf), ["game_pk", "batter", "pitcher", "inning"])


# --- games ----------------------------------------------------------------------------


@query
def starting_pitchers(spark, sf):
    return G.starting_pitchers(views.pitch_view(spark, sf))


@query
def first_nine_batters(spark, sf):
    return G.first_nine_batters(views.pitch_view(spark, sf))


@query
def start_game(spark, sf):
    return G.start_game(views.pitch_view(spark, sf))


@query
def preview_games(spark, sf):
    return G.preview_games(G.unique_games(views.pitch_view(spark, sf)))


# --- samples and encoding -------------------------------------------------------------


def sample(spark: SparkSession, sf: str, window: tuple[str, str], variant=samples.ENHANCED) -> DataFrame:
    major, minor = stored_leagues(spark, sf)
    return samples.swing_sample(
        major, minor, S.YEAR, *window, S.MIN_BATTER, S.MIN_PITCHER, variant, year_col="game_year"
    )


def train_sample(spark: SparkSession, sf: str, variant=samples.ENHANCED) -> DataFrame:
    return sample(spark, sf, S.TRAIN, variant)


def frame_of(spark: SparkSession, sf: str, variant) -> DataFrame:
    """The training frame of a model variant."""
    return samples.model_frame(train_sample(spark, sf, variant), variant)


def indexes(variant) -> list[str]:
    positions = ["zone_idx"] + (["zone_num_idx"] if "zone" in variant.columns else [])
    return [f"{c}_idx" for c in variant.labels] + positions


@query
def union_leagues(spark, sf):
    pitches = views.pitch_view(spark, sf)
    major, minor = (pitches.where(F.col("league") == lg).drop("league") for lg in ("major", "minor"))
    return J.union_leagues(major, minor).groupBy("league", "description").agg(F.count(F.lit(1)).alias("n"))


@query
def swing_sample(spark, sf):
    return train_sample(spark, sf)


@query
def swing_sample_hold_out(spark, sf):
    return sample(spark, sf, S.HOLD_OUT)


@query
def swing_sample_2way(spark, sf):
    return sample(spark, sf, S.HOLD_OUT, samples.TWO_WAY)


@query
def fit_labels(spark, sf):
    cols = ["batter", "pitcher", "stand", "pitch_subtype", "p_throws", "league"]
    return E.fit_labels(train_sample(spark, sf), cols)


@query
def apply_labels(spark, sf):
    cols = ["batter", "pitcher", "pitch_type"]
    train = L.date_window(views.pitch_view(spark, sf), *S.TRAIN)
    major = train.where(F.col("league") == "major")
    labels = settle(E.fit_labels(major, cols[:2]), "labels")
    out = E.apply_labels(views.pitch_view(spark, sf), labels, cols, fit_missing=True)
    return out.select(*ID, "pitch_type", *(f"{c}_idx" for c in cols))


def framed(name: str, variant, hold_out: bool, own_groups: bool = False) -> None:
    def run(spark, sf):
        train = train_sample(spark, sf, variant)
        if not hold_out:
            frame = samples.model_frame(train, variant)
        else:
            held, encoding = sample(spark, sf, S.HOLD_OUT, variant), samples.fit_encoding(train, variant)
            if own_groups:
                encoding = samples.regroup(held, encoding, variant)
            frame = samples.model_frame(held, variant, encoding)
        return frame.select("batter", "pitcher", "is_whiff", *indexes(variant))

    QUERIES[name] = run


framed("model_frame", samples.ENHANCED, hold_out=False)
framed("model_frame_hold_out", samples.ENHANCED, hold_out=True)
framed("model_frame_own_groups", samples.ENHANCED, hold_out=True, own_groups=True)
framed("model_frame_hierarchical", samples.HIERARCHICAL, hold_out=False)
framed("model_frame_2way", samples.TWO_WAY, hold_out=False)


# --- model ----------------------------------------------------------------------------


@query
def swing_cells(spark, sf):
    return A.swing_cells(frame_of(spark, sf, samples.ENHANCED), M.key_columns(M.ENHANCED))


def fitted(name: str, variant, terms, fit) -> None:
    """Whether the fit is stationary in every effect that has data and in every scale."""

    def run(spark, sf):
        cells = A.swing_cells(frame_of(spark, sf, variant), M.key_columns(terms))
        cells = settle(cells, "cells")
        params = settle(fit(cells), "params")
        slopes = P.gradient(cells, params, terms)
        flat = F.abs("slope") <= FLAT * F.sqrt(F.col("n").cast("double"))
        effects = slopes.select("term", *M.KEY_COLUMNS, flat.alias("stationary"))
        rests = F.abs(F.log(F.col("step") / F.col("sigma"))) <= AT_REST
        scales = P.scale_gaps(cells, params, terms).select(
            F.concat(F.lit("sigma_"), "term").alias("term"), *(F.lit(0).alias(k) for k in M.KEY_COLUMNS), rests.alias("stationary"))
        return effects.unionByName(scales)

    QUERIES[name] = run


#: Slope of a fit, in standard errors of a sum of as many swings, that counts as flat.
FLAT = 0.05
#: Share by which a further step may move a scale that rests.
AT_REST = 0.02

fitted("fit_enhanced", samples.ENHANCED, M.ENHANCED, P.fit_enhanced)
fitted("fit_hierarchical", samples.HIERARCHICAL, M.HIERARCHICAL, P.fit_hierarchical)


def fitted_model(spark: SparkSession, sf: str) -> modelling.Trained:
    """The enhanced model fitted to the training sample, with draws around the fit, saved and
    loaded as a trained model."""
    variant, terms = samples.ENHANCED, M.ENHANCED

    def write(path: str) -> None:
        sampled = train_sample(spark, sf, variant)
        modelling.save_trained(modelling.train(sampled, variant, terms, draws=modelling.Draws(S.CHAINS, S.DRAWS, S.BLOCK, seed=1)), path)

    return modelling.load_trained(spark, written_once(spark, sf, "fitted_enhanced", write), variant)


@query
def posterior_of_fit(spark, sf):
    """Summary of the fit's own draws per term: whether the draws of its effects centre on the
    fit, agree between chains and spread."""
    trained = fitted_model(spark, sf)
    keys = ["term", *M.KEY_COLUMNS]
    summary = M.summary_of_blocks(trained.params, S.DRAWS)
    fit = trained.estimates.select(*keys, F.col("draws")[0].alias("effect"))
    draws = S.CHAINS * S.DRAWS
    # Scales are repeated, not drawn: their spread is that of rounding.
    sd = F.when(F.col("sd") > 1e-9, F.col("sd"))
    off = F.abs(F.col("mean") - F.col("effect")) / sd * draws**0.5
    both = summary.join(fit.hint("merge"), keys)
    # Of thousands of means of independent draws none lies six standard errors off.
    return both.groupBy("term").agg(
        F.count(F.lit(1)).alias("effects"), (F.coalesce(F.max(off), F.lit(0.0)) < 6).alias("means_agree"),
        (F.coalesce(F.max(F.when(sd.isNotNull(), F.col("r_hat"))), F.lit(1.0)) < 1.5).alias("chains_agree"),
        (F.count(sd) > 0).alias("spread"))


@query
def score_of_fit(spark, sf):
    """The hold-out scored by the fit's own draws, against the training rate."""
    trained, held = fitted_model(spark, sf), sample(spark, sf, S.HOLD_OUT)
    scored = settle(modelling.score_hold_out(held, trained, samples.ENHANCED, M.ENHANCED), "scored")
    rate = train_sample(spark, sf).agg(F.avg("is_whiff")).scalar()
    loss, plain = V.log_loss(scored).scalar(), V.log_loss(scored.select("is_whiff", rate.alias("score"))).scalar()
    return scored.agg(F.count(F.lit(1)).cast("double").alias("n"), (F.count("score") == F.count(F.lit(1))).alias("all_scored")).select(
        "n", "all_scored", (loss < plain).alias("beats_the_rate"))


def sizes_of(labels: DataFrame, variant) -> dict[str, int]:
    """Number of values of every index column."""
    counts = {r["col"]: r["count"] for r in labels.groupBy("col").count().collect()}  # one row per column
    return {f"{c}_idx": counts.get(c, 0) for c in variant.labels} | {"zone_idx": 2, "zone_num_idx": 13}


def made_up(salt: int) -> Callable[[Column], Column]:
    def value(i: Column) -> Column:
        at = F.col("draw_block") * S.BLOCK + i
        chain, draw = F.floor(at / S.DRAWS).cast("int"), at % S.DRAWS
        mixed = F.col("k1") * 31 + F.col("k2") * 17 + F.col("k3") * 11 + F.col("k4") * 5
        return ((mixed + chain * 3 + draw * 7 + salt) % 100 - 50) / F.lit(100.0)

    return value


def made_up_draws(labels: DataFrame, variant, terms) -> DataFrame:
    """A parameter table with a value for every key combination of the fitted labels."""
    sizes, blocks, out = sizes_of(labels, variant), S.CHAINS * S.DRAWS // S.BLOCK, None
    for salt, term in enumerate((M.INTERCEPT, *terms)):
        # a partitioned range of codes, read as the digits of the keys and the block
        total = blocks
        for c in term.keys:
            total *= sizes[c]
        rest, digits = F.floor(F.col("id") / blocks), {}
        for k, c in reversed(list(zip(M.KEY_COLUMNS, term.keys))):
            digits[k], rest = rest % sizes[c], F.floor(rest / sizes[c])
        keys = [digits.get(k, F.lit(0)).cast("int").alias(k) for k in M.KEY_COLUMNS]
        rows = labels.sparkSession.range(total).select(*keys, (F.col("id") % blocks).cast("int").alias("draw_block"))

        draws = F.transform(F.sequence(F.lit(0), F.lit(S.BLOCK - 1)), made_up(salt))
        part = rows.select(F.lit(term.name).alias("term"), *M.KEY_COLUMNS, "draw_block", draws.alias("draws"))
        out = part if out is None else out.unionByName(part)
    return out


def stored_model(spark: SparkSession, sf: str, variant, terms) -> modelling.Trained:
    """Encoding of the training sample and its made-up posterior, saved and loaded as a
    trained model would be."""

    def write(path: str) -> None:
        encoding = samples.fit_encoding(train_sample(spark, sf, variant), variant)
        params = made_up_draws(encoding.labels, variant, terms)
        modelling.save_trained(modelling.Trained(encoding, params), path)

    path = written_once(spark, sf, f"model_{variant.name}", write)
    return modelling.load_trained(spark, path, variant)


@query
def build_model(spark, sf):
    """Labels per column of an encoding that is fitted, saved with its parameters and loaded."""
    path, variant = new_folder(spark, "model"), samples.ENHANCED
    encoding = samples.fit_encoding(train_sample(spark, sf), variant)
    modelling.save_trained(modelling.Trained(encoding, made_up_draws(encoding.labels, variant, M.ENHANCED)), path)
    trained = modelling.load_trained(spark, path, variant)
    labels = trained.encoding.labels.groupBy("col").agg(F.count(F.lit(1)).alias("n"))
    return labels.unionByName(trained.params.groupBy(F.col("term").alias("col")).agg(F.count(F.lit(1)).alias("n")))


def scoring_inputs(spark, sf, variant, terms) -> tuple[DataFrame, DataFrame]:
    """The hold-out frame and the parameter table of a model variant."""
    trained = stored_model(spark, sf, variant, terms)
    held = sample(spark, sf, S.HOLD_OUT, variant)
    return samples.model_frame(held, variant, trained.encoding), trained.params


def scored_by(name: str, variant, terms, missing=()) -> None:
    def run(spark, sf):
        frame, params = scoring_inputs(spark, sf, variant, terms)
        used = M.without(terms, missing)
        scored = M.score(frame, params, used)
        return rounded(scored.select("batter", "pitcher", "is_whiff", *M.key_columns(used), "score"))

    QUERIES[name] = run


scored_by("score_enhanced", samples.ENHANCED, M.ENHANCED)
scored_by(
    "score_enhanced_core", samples.ENHANCED, M.ENHANCED, ("batter_league", "pitcher_league", "group_count")
)
scored_by("score_2way", samples.TWO_WAY, M.TWO_WAY)
scored_by("score_hierarchical", samples.HIERARCHICAL, M.HIERARCHICAL)


def enhanced_draws(spark, sf) -> DataFrame:
    return stored_model(spark, sf, samples.ENHANCED, M.ENHANCED).params


@query
def effect_draws(spark, sf):
    offsets = enhanced_draws(spark, sf)
    first = F.col("k1") + F.col("k2") + F.col("k3") + F.col("k4") == 0
    sigmas = offsets.where(first).withColumn("draws", F.transform("draws", lambda x: F.abs(x) + 0.5))
    effects = M.effect_draws(offsets, sigmas)
    return rounded(
        effects.select(
            "term", *M.KEY_COLUMNS, "draw_block",
            F.element_at("draws", 1).alias("first_draw"),
            F.aggregate("draws", F.lit(0.0), lambda a, x: a + x).alias("draw_sum"),
        )
    )


@query
def posterior_summary(spark, sf):
    params = enhanced_draws(spark, sf)
    return rounded(M.summary_of_blocks(params, S.DRAWS))


@query
def evaluate_hold_out(spark, sf):
    """Hold-out evaluation of the enhanced model under the made-up posterior."""
    trained = stored_model(spark, sf, samples.ENHANCED, M.ENHANCED)
    held = sample(spark, sf, S.HOLD_OUT)
    scored = rounded(modelling.score_hold_out(held, trained, samples.ENHANCED, M.ENHANCED))
    saved = modelling.evaluate(scored, new_folder(spark, "evaluation"))
    overall = saved["metrics"].select(F.lit("all").alias("group"), "metric", "value")
    for name, by in (("by_pitch_subtype", "pitch_subtype"), ("by_zone", "zone")):
        group = F.concat_ws("=", F.lit(by), F.col(by).cast("string")).alias("group")
        wide = saved[name].select(group, F.col("n").cast("double").alias("n"), "auc", "log_loss", "f1_whiff")
        overall = overall.unionByName(wide.unpivot("group", ["n", "auc", "log_loss", "f1_whiff"], "metric", "value"))
    return rounded(overall)


@query
def train_and_evaluate(spark, sf):
    """Fit the two-way model on the training window, save and load it, score the hold-out. The
    sizes of the report, and whether the model beats the training rate."""
    path = new_folder(spark, "model")
    variant, terms = samples.TWO_WAY, M.TWO_WAY
    sampled = train_sample(spark, sf, variant)
    modelling.save_trained(modelling.train(sampled, variant, terms), path)
    trained = modelling.load_trained(spark, path, variant)
    scored = settle(modelling.score_hold_out(sample(spark, sf, S.HOLD_OUT, variant), trained, variant, terms), "scored")
    report = V.evaluation_report(scored)
    sizes = report.groupBy().agg(
        F.max(F.when(F.col("metric") == "n", F.col("value"))).alias("n"),
        F.sum(F.when(F.col("metric").isin("fn", "tp"), F.col("value"))).alias("whiffs"),
        F.count("value").cast("double").alias("metrics"),
        F.max(F.when(F.col("metric") == "log_loss", F.col("value"))).alias("loss"),
    )
    rate = sampled.agg(F.avg("is_whiff")).scalar()
    plain = V.log_loss(scored.select("is_whiff", rate.alias("score"))).scalar()
    return sizes.select("n", "whiffs", "metrics", (F.col("loss") < plain).alias("beats_the_rate"))


@query
def rebuild_start_game(spark, sf):
    return modelling.rebuild_start_game(views.pitch_view(spark, sf), new_folder(spark, "start_game"))


# --- evaluation -----------------------------------------------------------------------


def evaluated(name: str, op: Callable[[DataFrame], DataFrame]) -> None:
    def run(spark, sf):
        return rounded(op(views.scored_view(spark, sf)))

    QUERIES[name] = run


evaluated("auc", V.auc)
evaluated("auc_by_league", lambda df: V.auc(df, group_cols=["league"]))
evaluated("brier_score", V.brier_score)
evaluated("log_loss", V.log_loss)
evaluated("confusion_matrix", V.confusion_matrix)
evaluated("classification_report", V.classification_report)
evaluated("classification_averages", V.classification_averages)
evaluated("rate_summary", V.rate_summary)
evaluated("metrics_by_group", lambda df: V.metrics_by_group(df, "pitch_type"))
evaluated("metrics_by_zone", lambda df: V.metrics_by_group(df, "zone", both_classes=False))
evaluated("top_pitch_types", lambda df: V.top_pitch_types(V.metrics_by_group(df, "pitch_type"), "pitch_type"))
evaluated("rank_groups_by_auc", lambda df: V.rank_groups_by_auc(V.metrics_by_group(df, "pitch_type"), "pitch_type"))
evaluated("roc_curve", V.roc_curve)
evaluated("roc_curve_thin", lambda df: V.roc_curve(df, thin=True))
evaluated("roc_curve_thin_by_zone", lambda df: V.roc_curve(df, group_cols=["zone"], thin=True))
evaluated("roc_by_group", lambda df: V.roc_by_group(df, "pitch_type"))
evaluated("calibration_curve", V.calibration_curve)
evaluated("score_histogram", V.score_histogram)
evaluated("residuals", lambda df: V.residuals(df).select("game_pk", "batter", "pitcher", "score", "residual"))
evaluated("evaluation_report", V.evaluation_report)
evaluated("evaluation_report_by_league", lambda df: V.evaluation_report(df, group_cols=["league"]))


@query
def evaluation_report_unscored(spark, sf):
    """The report on a frame where every seventh pitcher has no score."""
    gaps = F.when(F.col("pitcher") % 7 != 0, F.col("score"))
    return rounded(V.evaluation_report(views.scored_view(spark, sf).withColumn("score", gaps), unscored="drop"))
