"""What the registered queries write before they start."""

import os

import pytest

from pitchlytics.workload import queries as Q

SF_DIR = os.environ.get("TWIN_SF_DIR", "/root/testdata/sf0.01")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no driver tables")


def test_reading_players_lands_no_pitches(spark, monkeypatch):
    monkeypatch.setattr(Q, "_WRITTEN", {})
    assert Q.read_player_csv(spark, SF_DIR).count() > 0
    assert [kind for _, _, kind in Q._WRITTEN] == ["batters"]


def test_line_ups_of_the_tables_come_from_the_stored_pitches(spark, monkeypatch):
    """The view's join is not run again beside the stored table."""
    Q.pitch_table(spark, SF_DIR)
    monkeypatch.setattr(Q.views, "pitch_view", None)
    filled = {r["table_name"]: r["n_rows"] for r in Q.create_tables(spark, SF_DIR).collect()}
    assert filled["start_game"] > 0 and filled["pitches_major"] > 0
