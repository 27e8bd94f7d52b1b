import datetime as dt
import os
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitchlytics import schema as S
from pitchlytics.plans import load
from pitchlytics.sources import landing, tables
from pitchlytics.streaming.append import stream_append

SUMMER = (("major", 2000, "2000-04-01", "2000-09-30"),)
SEASONS = tuple((lg, y, f"{y}-04-01", f"{y}-04-05") for lg in ("major", "minor") for y in (2000, 2001))
HEADER = ["game_pk", "game_date", "batter", "pitcher", "plate_x", "plate_z", "pitch_type", "zone", "game_year"]


def line(day, game, x="0.12345", pitch="FF", zone="5"):
    return [str(game), day, "7", "8", x, "2.5", pitch, zone, day[:4]]


def write(path, header, lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(",".join(r) for r in [header, *lines]) + "\n")


def test_schema_has_the_declared_shape():
    kinds = [f.dataType.simpleString() for f in S.PITCH_SCHEMA]
    assert len(kinds) == 73
    assert {k: kinds.count(k) for k in set(kinds)} == {"double": 44, "int": 14, "string": 14, "date": 1}
    assert len(S.LANDED_COLUMNS) == 66
    assert len(S.START_GAME_SCHEMA) == 24


def test_columns_are_found_by_name_in_each_file(spark, rows, tmp_path):
    write(tmp_path / "a.csv", HEADER, [line("2000-04-01", 1, x="NA", pitch="null", zone="5.0")])
    turned = HEADER[::-1]
    write(tmp_path / "b.csv", turned, [line("2000-04-02", 2, x="nan", zone="")[::-1]])
    write(tmp_path / "c.csv", [*HEADER, "extra"], [[*line("2000-04-03", 3, x="0.5"), "1"]])
    write(tmp_path / "d.csv", ['"game_pk"', '"game_date"'], [["4", '"2000-04-04"']])
    got = rows(landing.read_pitch_csv(spark, str(tmp_path)), "game_pk", "game_date", "plate_x", "pitch_type", "zone", "pitcher")
    day = dt.date(2000, 4, 1)
    assert got == [
        (1, day, None, None, 5, 8),
        (2, day + dt.timedelta(1), None, "FF", None, 8),
        (3, day + dt.timedelta(2), 0.5, "FF", 5, 8),
        (4, day + dt.timedelta(3), None, None, None, None),
    ]


@pytest.mark.parametrize("bad", [{"x": "abc"}, {"zone": "five"}, {"day": "2000-13-01"}])
def test_unreadable_cells_fail(spark, tmp_path, bad):
    cells = {"day": "2000-04-01", **bad}
    write(tmp_path / "a.csv", HEADER, [line(cells.pop("day"), 1, **cells)])
    with pytest.raises(Exception, match="unreadable"):
        landing.read_pitch_csv(spark, str(tmp_path)).collect()


def test_texts_are_read_as_their_type(spark, frame):
    cells = ["7", " 7 ", "7.0", "1e2", "", " ", "NA", " NULL ", "NaN", "-nan", "Infinity", None]
    df = frame("i string", [(c,) for c in cells]).select(
        landing.typed("i", T.DoubleType()).alias("d"), F.when(F.col("i") != "Infinity", landing.typed("i", T.IntegerType())).alias("n"))
    nothing = [None] * 6
    assert [r["d"] for r in df.collect()] == [7.0, 7.0, 7.0, 100.0, *nothing, float("inf"), None]
    assert [r["n"] for r in df.collect()] == [7, 7, 7, 100, *nothing, None, None]


def test_a_read_of_all_columns_is_compiled_and_reads_a_day_once(spark, tmp_path):
    """The JVM only interprets methods of more than 8,000 bytes, however often they run."""
    header = S.LANDED_COLUMNS
    write(tmp_path / "major" / "a.csv", header, [["" if c != "game_date" else "2000-04-01" for c in header]])
    source = load.Landing(str(tmp_path), landing.landed_schema(), {"major": header})
    days = [(dt.date(y, 4, 1), dt.date(y, 9, 30)) for y in range(1995, 2002)]
    rows = load.landed_rows(source.pitches(spark, "major", days), load.table_schema(source.schema), header)
    assert rows.count() == 1
    plan = rows._jdf.queryExecution()
    sizes = re.findall(r"maxMethodCodeSize:(\d+)", spark._jvm.PythonSQLUtils.explainString(plan, "codegen"))
    assert sizes and max(map(int, sizes)) < 8000
    [day] = [x for x in plan.optimizedPlan().toString().splitlines() if " Filter " in x]
    assert day.count("unreadable") == 1


def test_files_without_the_key_keep_their_rows(spark, rows, tmp_path):
    write(tmp_path / "a.csv", HEADER, [line("2000-04-01", 1), [*line("2000-04-01", 1)[:6], "game_pk", "5", "2000"]])
    write(tmp_path / "b.csv", ["GAME_PK", *HEADER[1:]], [line("2000-04-02", 2)])
    write(tmp_path / "c.csv", HEADER[1:], [line("2000-04-03", 3)[1:]])
    (tmp_path / "empty.csv").write_text("")
    got = rows(landing.read_pitch_csv(spark, str(tmp_path)), "game_date", "game_pk", "pitch_type")
    day = dt.date(2000, 4, 1)
    assert got == [(day, 1, "FF"), (day, 1, "game_pk"), (day + dt.timedelta(1), None, "FF"), (day + dt.timedelta(2), None, "FF")]


def test_players_are_read_once_each(spark, rows, tmp_path):
    write(tmp_path / "p.csv", ["player_name", "player_id"], [['"Smith, Bob"', "2"], ['"Ada, Al"', "2"], ["Zed", "1"], ["x", ""]])
    assert rows(landing.read_player_csv(spark, str(tmp_path)), "player_id", "player_name") == [(1, "Zed"), (2, "Ada, Al")]


def test_an_empty_landing_folder_reads_as_no_rows(spark, tmp_path):
    assert landing.read_pitch_csv(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize(
    "latest, as_of, first, last, n",
    [
        (None, "2001-07-01", "2000-04-01", "2001-04-05", 10),
        (dt.date(2000, 4, 3), "2000-04-06", "2000-04-04", "2000-04-05", 2),
        (dt.date(2000, 4, 5), "2001-04-03", "2001-04-01", "2001-04-02", 2),
    ],
)
def test_due_days(spark, frame, latest, as_of, first, last, n):
    marks = frame("league string, latest_date date", [("major", latest)])
    days = load.dates_to_load(load.season_calendar(spark, SEASONS), marks, as_of).where("league = 'major'")
    row = days.agg(F.min("game_date"), F.max("game_date"), F.count("game_date")).first()
    assert (str(row[0]), str(row[1]), row[2]) == (first, last, n)


def test_nothing_is_due_when_up_to_date(spark, frame):
    marks = frame("league string, latest_date date", [(lg, dt.date(2001, 4, 5)) for lg in ("major", "minor")])
    assert load.dates_to_load(load.season_calendar(spark, SEASONS), marks, "2001-07-01").count() == 0


@pytest.fixture
def landed(tmp_path):
    """One folder per day, with a day out of season and one after the as-of date."""
    for league in ("major", "minor"):
        for day in ("2000-03-31", "2000-04-01", "2000-04-02", "2000-04-05", "2001-04-01"):
            header = HEADER if league == "major" else HEADER[::-1]
            lines = [line(day, g) for g in (1, 2)]
            if league == "minor":
                lines = [r[::-1] for r in lines]
            write(tmp_path / "land" / league / f"day={day}" / "f.csv", header, lines)
    for kind in ("pitchers", "batters"):
        write(tmp_path / "land" / kind / "f.csv", ["player_id", "player_name"], [["7", '"B, A"'], ["8", "C"]])
    return tmp_path / "land"


def test_pipeline_loads_each_day_once(spark, rows, landed, tmp_path):
    base = str(tmp_path / "base")
    first = rows(load.pipeline_run(spark, str(landed), base, "2000-04-03", SEASONS))
    assert first == [("major", 0, 4), ("minor", 0, 4)]
    assert rows(load.pipeline_run(spark, str(landed), base, "2000-04-03", SEASONS)) == first
    write(landed / "major" / "day=2000-04-02" / "late.csv", HEADER, [line("2000-04-02", 3)])
    # the late file belongs to a day that is already loaded
    assert rows(load.pipeline_run(spark, str(landed), base, "2001-07-01", SEASONS)) == [("major", 0, 8), ("minor", 0, 8)]
    table = spark.read.parquet(f"{base}/pitches")
    assert {(r.plate_x, r.is_zone, r.pitch_subtype) for r in table.collect()} == {(0.1234, 0, "Fastball")}
    assert {(r.league, r.game_year) for r in table.collect()} == {(lg, y) for lg in ("major", "minor") for y in (2000, 2001)}
    assert spark.read.parquet(f"{base}/pitchers").count() == 2


def test_a_load_opens_the_due_days_only(spark, landed):
    ranges = [(dt.date(2000, 4, 2), dt.date(2000, 4, 5))]
    df = landing.read_pitch_csv(spark, str(landed / "major"), days=ranges)
    opened = {os.path.basename(os.path.dirname(f)) for f in df.inputFiles()}
    assert opened == {"day=2000-04-02", "day=2000-04-05"}


def test_a_known_header_is_read_in_one_pass(spark, rows, landed):
    ranges = [(dt.date(2000, 4, 2), dt.date(2000, 4, 5))]
    path = str(landed / "minor")
    searched = landing.read_pitch_csv(spark, path, days=ranges)
    known = landing.read_pitch_csv(spark, path, days=ranges, header=HEADER[::-1])
    assert rows(known) == rows(searched) and known.count() == 4
    with pytest.raises(Exception):
        landing.read_pitch_csv(spark, path, days=ranges, header=HEADER).collect()


def test_stream_takes_each_file_once(spark, landed, tmp_path):
    table, progress = str(tmp_path / "t"), str(tmp_path / "progress")
    args = (spark, str(landed), "major", HEADER, table, progress, "2001-07-01", landing.landed_schema(), SEASONS)
    stream_append(*args)
    assert spark.read.parquet(table).count() == 8
    stream_append(*args)
    assert spark.read.parquet(table).count() == 8
    write(landed / "major" / "day=2000-04-03" / "new.csv", HEADER, [line("2000-04-03", 9)])
    stream_append(*args)
    assert spark.read.parquet(table).count() == 9


def test_stream_and_batch_share_a_table(spark, rows, landed, tmp_path):
    table, progress = str(tmp_path / "t"), str(tmp_path / "progress")
    source = load.Landing(str(landed), landing.landed_schema())
    args = (spark, str(landed), "major", HEADER, table, progress, "2000-04-03", landing.landed_schema(), SEASONS)
    stream_append(*args)
    assert spark.read.parquet(table).count() == 4
    for _ in range(2):
        load.incremental_append(spark, source, table, "2001-07-01", SEASONS)
        assert rows(spark.read.parquet(table).groupBy("league").count()) == [("major", 8), ("minor", 8)]
    stream_append(*args)
    assert spark.read.parquet(table).count() == 16
    assert not list((tmp_path / "t").glob("_spark_metadata"))


def test_a_load_written_twice_replaces_itself(spark, frame, tmp_path):
    df = frame("a int, league string, game_year int", [(1, "major", 2000), (2, "minor", 2001)])
    for name in ("x", "x", "y"):
        tables.append_pitches(df, str(tmp_path / "t"), load=name)
    assert tables.read_pitches(spark, str(tmp_path / "t")).count() == 4
    assert tables.newest_seasons(spark, str(tmp_path / "t")) == {"major": 2000, "minor": 2001}
    assert tables.newest_seasons(spark, str(tmp_path / "none")) == {}


def test_clean_players_and_refresh(spark, rows, landed, tmp_path):
    base = str(tmp_path / "base")
    load.pipeline_run(spark, str(landed), base, "2001-07-01", SEASONS)
    for _ in range(2):
        load.clean_players(spark, base)
        assert rows(tables.read_pitches(spark, f"{base}/pitchers"), "player_id", "player_name", "p_throws") == [(7, "A B", None), (8, "C", None)]
    before = rows(spark.read.parquet(f"{base}/pitches").drop("load"))
    load.refresh_metrics(spark, f"{base}/pitches")
    assert rows(tables.read_pitches(spark, f"{base}/pitches")) == before
    # later loads go on in the version that is current
    write(landed / "major" / "day=2001-07-02" / "f.csv", HEADER, [line("2001-07-02", 1)])
    load.pipeline_run(spark, str(landed), base, "2001-08-01", [*SEASONS, ("major", 2002, "2001-06-30", "2001-07-30")])
    assert tables.read_pitches(spark, f"{base}/pitches").count() == len(before) + 1


def test_a_replacement_is_seen_all_at_once(spark, frame, rows, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    frame("a int", [(1,), (2,)]).write.parquet(path)
    tables.overwrite_table(frame("a int", [(3,)]), path)
    assert rows(tables.read_pitches(spark, path)) == [(3,)]

    def lost(*_):
        raise RuntimeError("driver lost")

    with monkeypatch.context() as patch:
        patch.setattr(tables, "_point_to", lost)
        with pytest.raises(RuntimeError):
            tables.overwrite_table(frame("a int", [(4,)]), path)
    assert rows(tables.read_pitches(spark, path)) == [(3,)]
    reader = tables.read_pitches(spark, path)
    # the new rows may come from the table itself, and those who read it go on
    grown = tables.overwrite_table(reader.selectExpr("a + 1 AS a").union(reader), path)
    assert rows(grown) == [(3,), (4,)] and rows(reader) == [(3,)]
    tables.overwrite_table(frame("a int", []), path)
    assert rows(tables.read_pitches(spark, path)) == [] and len(list((tmp_path / "t.versions").glob("v-*"))) == 2


def test_stream_keeps_rows_that_are_not_yet_due(spark, rows, tmp_path):
    table, progress = str(tmp_path / "t"), str(tmp_path / "p")
    days = ["2000-05-01", "2000-05-10", "2000-05-10", "2000-06-20", "2000-12-24"]
    write(tmp_path / "land" / "major" / "f.csv", HEADER, [line(d, g) for g, d in enumerate(days)])

    def call(as_of):
        stream_append(spark, str(tmp_path / "land"), "major", HEADER, table, progress, as_of, landing.landed_schema(), SUMMER)
        return [r[0].isoformat() for r in rows(spark.read.parquet(table), "game_date")]

    assert call("2000-05-05") == days[:1]
    assert call("2000-06-01") == days[:3]
    assert call("2000-05-05") == days[:3]
    write(tmp_path / "land" / "major" / "g.csv", HEADER, [line("2000-06-25", 7), line("2000-05-02", 8)])
    for _ in range(2):
        assert call("2000-06-22") == ["2000-05-01", "2000-05-02", "2000-05-10", "2000-05-10", "2000-06-20"]
    for _ in range(2):
        assert call("2001-01-01")[-1] == "2000-06-25" and spark.read.parquet(table).count() == 6


def test_a_release_that_was_cut_short_is_done_again(spark, rows, tmp_path, monkeypatch):
    from pitchlytics.streaming import append

    table, progress = str(tmp_path / "t"), str(tmp_path / "p")
    write(tmp_path / "land" / "major" / "f.csv", HEADER, [line(d, 1) for d in ("2000-05-01", "2000-05-10")])
    args = (spark, str(tmp_path / "land"), "major", HEADER, table, progress)
    more = (landing.landed_schema(), SUMMER)
    stream_append(*args, "2000-05-05", *more)

    def lost(*_):
        raise RuntimeError("driver lost")

    with monkeypatch.context() as patch:
        patch.setattr(append, "_delete", lost)
        with pytest.raises(RuntimeError):
            stream_append(*args, "2000-06-01", *more)
    for as_of in ("2000-05-05", "2000-06-01", "2000-07-01"):
        stream_append(*args, as_of, *more)
        assert spark.read.parquet(table).count() == 2


def test_held_days_that_a_batch_load_took_are_not_released(spark, tmp_path):
    table, progress = str(tmp_path / "t"), str(tmp_path / "p")
    write(tmp_path / "land" / "major" / "f.csv", HEADER, [line(d, 1) for d in ("2000-05-01", "2000-05-10")])
    args = (spark, str(tmp_path / "land"), "major", HEADER, table, progress)
    stream_append(*args, "2000-05-05", landing.landed_schema(), SUMMER)
    load.incremental_append(spark, load.Landing(str(tmp_path / "land"), landing.landed_schema()), table, "2000-06-01", SUMMER)
    stream_append(*args, "2000-06-01", landing.landed_schema(), SUMMER)
    assert spark.read.parquet(table).count() == 2


def test_stream_refuses_another_column_order(spark, landed, tmp_path):
    args = (str(landed), "minor", HEADER, str(tmp_path / "t"), str(tmp_path / "p"), "2001-07-01")
    with pytest.raises(Exception):
        stream_append(spark, *args, landing.landed_schema(), SEASONS)


def test_conform_and_add_columns(frame):
    df = frame("batter bigint, extra int, phi double", [(1, 2, 3.0)])
    out = tables.conform_to_schema(df, S.PITCH_SCHEMA)
    assert out.columns == S.PITCH_SCHEMA.names
    assert (out.first().batter, out.first().phi) == (1, None)  # derived columns are not loaded
    grown = tables.add_columns_if_missing(df, {"PHI": "int", "blast": "int"})
    assert dict(grown.dtypes) == {"batter": "bigint", "extra": "int", "phi": "double", "blast": "int"}


def test_report_is_one_file_with_header(frame, tmp_path):
    path = tmp_path / "report"
    tables.write_report_csv(frame("a string, b int", [("x", 1), ("y", 2)]), str(path))
    parts = [p for p in path.iterdir() if p.suffix == ".csv"]
    assert len(parts) == 1 and parts[0].read_text().splitlines()[0] == "a,b"


def test_headers_that_drift_between_days(spark, rows, tmp_path):
    """Files of other headers, by day, with many files of each: columns by name, other days not read."""
    for i in range(1, 10):
        day = f"2000-04-0{i}"
        (tmp_path / f"day={day}").mkdir()
        cells = line(day, i, x=f"0.{i}")
        header = HEADER if i % 3 else HEADER[::-1]
        write(tmp_path / f"day={day}" / "a.csv", header, [cells if i % 3 else cells[::-1]] * 2)
    span = [(dt.date(2000, 4, 2), dt.date(2000, 4, 7))]
    found = landing.read_pitch_csv(spark, str(tmp_path), days=span)
    assert rows(found, "game_pk", "plate_x", "pitcher") == [(i, i / 10, 8) for i in range(2, 8) for _ in range(2)]
    plain = landing.read_pitch_csv(spark, str(tmp_path), days=[(dt.date(2000, 4, 4), dt.date(2000, 4, 5))])
    assert rows(plain, "game_pk", "plate_x") == [(4, 0.4)] * 2 + [(5, 0.5)] * 2
    assert landing.read_pitch_csv(spark, str(tmp_path), days=[(dt.date(2001, 1, 1), dt.date(2001, 1, 2))]).count() == 0


def test_rows_of_a_file_lie_in_order_of_their_day(spark, frame, tmp_path):
    import pyarrow.parquet as pq

    day = dt.date(2000, 4, 1)
    data = [(lg, 2000, day + dt.timedelta(i * 37 % 90), i) for i in range(2000) for lg in ("major", "minor")]
    df = frame("league string, game_year int, game_date date, game_pk int", data).repartition(5)
    tables.append_pitches(df, str(tmp_path / "t"))
    tables.replace_table(spark.read.parquet(str(tmp_path / "t")), str(tmp_path / "t"), [*tables.PARTITIONS, tables.LOAD])
    assert tables.read_pitches(spark, str(tmp_path / "t")).count() == len(data)
    files = [f for where in ("t", "t.versions") for f in (tmp_path / where).rglob("*.parquet")]
    assert len(files) >= 4
    for f in files:
        days = pq.read_table(str(f), columns=["game_date"], partitioning=None)["game_date"].to_pylist()
        assert days == sorted(days)


def test_derived_columns_are_added_to_rows_in_their_place(spark, frame, tmp_path, monkeypatch):
    import pyarrow.parquet as pq

    day = dt.date(2000, 4, 1)
    data = [(lg, 2000, day + dt.timedelta(i * 37 % 90), i) for i in range(2000) for lg in ("major", "minor")]
    df = frame("league string, game_year int, game_date date, game_pk int", data).repartition(5)
    travelled, laid_out = [], tables._laid_out
    monkeypatch.setattr(tables, "_laid_out", lambda rows, *by: travelled.append(rows.columns) or laid_out(rows, *by))
    tables.append_pitches(df, str(tmp_path / "t"), derive=lambda rows: rows.withColumn("twice", F.col("game_pk") * 2))
    assert travelled == [[*df.columns, tables.LOAD]]
    assert tables.read_pitches(spark, str(tmp_path / "t")).where(F.col("twice") == F.col("game_pk") * 2).count() == len(data)
    files = list((tmp_path / "t").rglob("*.parquet"))
    assert files
    for f in files:
        days = pq.read_table(str(f), columns=["game_date"], partitioning=None)["game_date"].to_pylist()
        assert days == sorted(days)


def test_only_landed_columns_travel_to_their_place(spark, landed, tmp_path, monkeypatch):
    """Derived columns and those that no file has are added to rows in their place."""
    travelled, laid_out = [], tables._laid_out
    monkeypatch.setattr(tables, "_laid_out", lambda rows, *by: travelled.append(set(rows.columns)) or laid_out(rows, *by))
    headers = {"major": HEADER, "minor": HEADER[::-1]}
    source = load.Landing(str(landed), landing.landed_schema(), headers)
    table, kept = str(tmp_path / "t"), {*HEADER, "game_year", "game_date", "league", tables.LOAD}
    load.incremental_append(spark, source, table, "2001-07-01", SEASONS)
    before = sorted(map(str, tables.read_pitches(spark, table).collect()))
    load.refresh_metrics(spark, table)
    stream_append(spark, str(landed), "major", HEADER, str(tmp_path / "s"), str(tmp_path / "p"), "2001-07-01", landing.landed_schema(), SEASONS)
    assert travelled[0] <= kept and travelled[2] <= kept
    assert not any(set(S.DERIVED_SCHEMA.names) & columns for columns in travelled)
    assert before == sorted(map(str, tables.read_pitches(spark, table).collect()))
    assert spark.read.parquet(str(tmp_path / "s")).columns == spark.read.parquet(tables.current_path(spark, table)).columns


def test_a_stream_picks_its_days_by_a_filter(spark, landed, tmp_path, monkeypatch):
    """Days of the calendar are a few ranges, so rows need not move to be compared with them."""
    from pitchlytics.streaming import append

    plans, added = [], append.append_pitches

    def watched(df, *args, **kwargs):
        plans.append(df._jdf.queryExecution().toString())
        return added(df, *args, **kwargs)

    monkeypatch.setattr(append, "append_pitches", watched)
    stream_append(spark, str(landed), "major", HEADER, str(tmp_path / "t"), str(tmp_path / "p"), "2001-07-01", landing.landed_schema(), SEASONS)
    assert plans and not any("Join" in p or "LeftSemi" in p for p in plans)
    assert spark.read.parquet(str(tmp_path / "t")).where("game_date = DATE'2000-03-31'").count() == 0


def test_refreshed_rows_lie_in_order_of_their_day(spark, landed, tmp_path):
    import pyarrow.parquet as pq

    source = load.Landing(str(landed), landing.landed_schema(), {"major": HEADER, "minor": HEADER[::-1]})
    load.incremental_append(spark, source, str(tmp_path / "t"), "2001-07-01", SEASONS)
    load.refresh_metrics(spark, str(tmp_path / "t"))
    files = list((tmp_path / "t.versions").rglob("*.parquet"))
    assert files
    for f in files:
        days = pq.read_table(str(f), columns=["game_date"], partitioning=None)["game_date"].to_pylist()
        assert days == sorted(days)


def test_created_tables_take_their_rows_season_by_season(spark, rows, tmp_path):
    name = tables.create_tables(spark, str(tmp_path / "base"), f"seasons_{os.getpid()}")[2]
    df = spark.range(30).selectExpr("cast(id as int) AS game_pk", "IF(id % 3 = 2, NULL, 2000 + cast(id % 3 as int)) AS game_year")
    schema = spark.table(name).schema
    for season in (2000, 2001, None):
        mine = df.where(F.col("game_year").eqNullSafe(F.lit(season)))
        tables.insert_rows(tables.conform_to_schema(mine, schema, schema.names), name)
    tables.insert_rows(tables.conform_to_schema(df, schema, schema.names), name)
    assert rows(spark.table(name), "game_pk", "game_year") == sorted(rows(df.unionAll(df)), key=lambda t: tuple((v is None, v) for v in t))
