import datetime as dt

from pitchlytics.operators import aggregates as A
from pitchlytics.operators import games as G
from pitchlytics.operators import joins as J
from pitchlytics.operators import players as R

PITCH = (
    "game_pk int, game_date date, home_team string, away_team string, inning int, outs_when_up int, "
    "inning_topbot string, batter int, pitcher int"
)
DAY, NEXT = dt.date(2000, 5, 1), dt.date(2000, 5, 2)


def pitch(half, batter, pitcher, inning=1, outs=0, day=DAY, game=1):
    return (game, day, "H", "A", inning, outs, half, batter, pitcher)


def test_start_game_orders_and_pads(frame):
    df = frame(
        PITCH,
        [
            pitch("Bot", 20, 9, inning=2),
            pitch("Bot", 22, 8, inning=1, outs=1),
            pitch("Bot", 21, 8, inning=1, outs=1),
            pitch("Bot", 20, 9, inning=1, outs=2),
            pitch("Top", 30, 5, inning=None),
            pitch("Top", 31, 4, inning=7),
        ],
    )
    row = G.start_game(df).first()
    assert [row[f"home_batter_{k}"] for k in range(1, 10)] == [21, 22, 20] + [None] * 6
    assert [row[f"away_batter_{k}"] for k in range(1, 4)] == [31, 30, None]
    assert (row.home_starting_pitcher, row.away_starting_pitcher) == (4, 8)
    assert (row.game_date, row.home_team, row.away_team) == (DAY, "H", "A")


def test_start_game_matches_its_parts(frame, rows):
    data = [
        pitch("Top" if i % 2 else "Bot", (i * 7) % 23, (i * 3) % 5, i % 9, i % 3, DAY if i % 4 else NEXT, i % 3)
        for i in range(400)
    ]
    df = frame(PITCH, data + [pitch(None, 1, 1, game=8), pitch("Top", None, 3, game=9)])
    games = G.start_game(df)
    pitchers = G.starting_pitchers(df)
    assert rows(games.where("game_pk < 8"), *pitchers.columns) == rows(pitchers.where("game_pk < 8"))
    assert rows(games, "game_pk", "game_date", "home_team", "away_team") == rows(G.unique_games(df))
    long = rows(G.first_nine_batters(df), "game_pk", "side", "position", "batter")
    wide = []
    for g in games.collect():
        for side in ("home", "away"):
            wide += [(g.game_pk, side, k, g[f"{side}_batter_{k}"]) for k in range(1, 10) if g[f"{side}_batter_{k}"] is not None]
    assert sorted(wide) == long
    assert rows(games.where("game_pk = 9"), "home_starting_pitcher", "home_batter_1") == [(3, None)]


def test_one_row_per_game_on_two_dates(frame, rows):
    df = frame(PITCH, [pitch("Top", 1, 2, day=NEXT), pitch("Top", 1, 2, day=DAY)])
    assert rows(G.unique_games(df), "game_pk", "game_date") == [(1, DAY)]


def test_moment_out_of_range_fails_loudly(frame):
    df = frame(PITCH, [pitch("Top", 1, 2, inning=-1)])
    try:
        G.starting_pitchers(df).collect()
    except Exception as e:
        assert "out of range" in str(e)
    else:
        raise AssertionError("a negative inning must not be ordered silently")


def test_player_hand_takes_the_most_frequent(frame, rows):
    players = frame("player_id int, player_name string", [(1, "a"), (2, "b"), (3, "c")])
    pitches = frame("batter int, stand string", [(1, "R"), (1, "L"), (1, "L"), (2, "R"), (2, "L"), (None, "L")])
    assert rows(R.player_hand(players, pitches, "batter", "stand"), "player_id", "stand") == [(1, "L"), (2, "L"), (3, None)]


def test_insert_new_players_is_idempotent(frame, rows):
    have = frame("player_id int, player_name string, stand string", [(1, "a", "L")])
    new = frame("player_id int, player_name string", [(1, "z"), (2, "b")])
    once = R.insert_new_players(have, new)
    assert rows(once) == [(1, "a", "L"), (2, "b", None)]
    assert rows(R.insert_new_players(once, new)) == rows(once)


def test_renamed_player_keeps_one_row(frame, rows):
    assert rows(R.one_name_per_player(frame("player_id int, player_name string", [(1, "b"), (1, "a")]))) == [(1, "a")]


def test_violations(frame, rows):
    ids = frame("player_id int", [(1,), (2,), (2,)])
    assert rows(A.pk_violations(ids, "player_id")) == [(2, 2)]
    fact = frame("batter int", [(1,), (5,), (None,)])
    assert rows(J.fk_violations(fact, ids, "batter", "player_id")) == [(5,)]


def test_qualified_both_equals_each(frame, rows):
    swing = [(2000, "foul", i % 3, i % 2) for i in range(60)] + [(2000, "foul", None, 9)] * 30
    df = frame("game_year int, description string, batter int, pitcher int", swing + [(2000, "ball", 0, 0)] * 50)
    both = A.qualified_both(df, 2000, 19, 29)
    for role, least in (("batter", 19), ("pitcher", 29)):
        assert rows(both.where(f"role = '{role}'"), "player_id", "swings") == rows(A.qualified_players(df, role, 2000, least))
