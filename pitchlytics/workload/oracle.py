"""The same queries in plain SQL over the driver tables, for the checker.

``CTES`` holds named steps. A query is written against them and gets the steps it names,
and the steps those name, as its WITH clause."""

from __future__ import annotations

import re

from ..schema import PITCH_SCHEMA
from . import settings as S
from .views import BATTERS_VIEW, PITCH_VIEW, PITCHERS_VIEW, SCORED_VIEW

# Descriptions, pitch codes, counts and group names, and the constants in the formulas below.
SWINGS = (
    "('swinging_strike', 'swinging_strike_blocked', 'foul', 'hit_into_play', 'foul_tip', "
    "'hit_into_play_no_out', 'hit_into_play_score', 'foul_bunt')"
)
WHIFFS = "('swinging_strike', 'swinging_strike_blocked')"
BUCKET = """CASE WHEN pitch_type IN ('FF', 'FA', 'SI', 'FT', 'FC') THEN 'Fastball'
  WHEN pitch_type IN ('SL', 'ST', 'SV', 'CU', 'KC', 'CS') THEN 'Breaking Ball'
  WHEN pitch_type IN ('CH', 'FS', 'FO') THEN 'Off-speed'
  WHEN pitch_type IN ('SC', 'KN', 'EP', 'UN', 'XX', 'PO') THEN 'Other' END"""
SUBTYPE = """CASE WHEN pitch_type IN ('FF', 'FA') THEN 'Fastball' WHEN pitch_type IN ('SI', 'FT') THEN 'Sinker'
  WHEN pitch_type = 'FC' THEN 'Cutter' WHEN pitch_type IN ('SL', 'ST') THEN 'Slider'
  WHEN pitch_type IN ('SV', 'CU', 'KC', 'CS') THEN 'Curveball' WHEN pitch_type = 'CH' THEN 'Changeup'
  WHEN pitch_type IN ('FS', 'FO') THEN 'Splitter'
  WHEN pitch_type IN ('SC', 'KN', 'EP', 'UN', 'XX', 'PO') THEN 'Other' END"""
COUNT = "concat(CAST(balls AS VARCHAR), '-', CAST(strikes AS VARCHAR))"
COUNT_BUCKET = f"""CASE WHEN {COUNT} IN ('0-2', '1-2', '2-2', '3-2') THEN 'at_risk'
  WHEN {COUNT} IN ('2-0', '2-1', '3-1') THEN 'ahead' ELSE 'neutral' END"""
COUNT_STRICT = f"""CASE WHEN {COUNT} IN ('0-0', '1-1', '0-1', '1-0') THEN 'neutral'
  WHEN {COUNT} IN ('0-2', '1-2', '2-2') THEN 'at_risk' WHEN {COUNT} IN ('2-0', '2-1', '3-1', '3-2') THEN 'ahead' END"""
ZONE_NUM = "CASE WHEN zone BETWEEN 1 AND 9 THEN zone - 1 WHEN zone BETWEEN 11 AND 14 THEN zone - 2 END"
IS_ZONE = """CASE WHEN plate_x IS NULL OR plate_z IS NULL THEN NULL
  WHEN plate_x BETWEEN -10.0 / 12 AND 10.0 / 12 AND plate_z BETWEEN sz_bot - 0.25 - (sz_bot - 1.69) / 4
  AND sz_top - (sz_top - 3.5) / 3 THEN 1 ELSE 0 END"""
ID = "game_pk, game_date, batter, pitcher, inning"


def r(expr: str, name: str | None = None) -> str:
    """Nine digits, negative zero as zero."""
    return f"round({expr}, 9) + 0.0 AS {name or expr}"


def _sample(window, columns: str, zones: bool) -> str:
    return f"""
SELECT {columns}, CASE WHEN description IN {WHIFFS} THEN 1 ELSE 0 END AS is_whiff FROM metrics
WHERE batter IN (SELECT batter FROM q_batters) AND pitcher IN (SELECT pitcher FROM q_pitchers)
  AND game_date BETWEEN DATE '{window[0]}' AND DATE '{window[1]}' AND description IN {SWINGS}
  AND pitch_subtype IS NOT NULL AND pitch_subtype <> 'Other' AND is_zone IS NOT NULL AND p_throws IS NOT NULL
  AND stand IS NOT NULL AND balls IS NOT NULL AND strikes IS NOT NULL
  {"AND zone IN (1, 2, 3, 4, 5, 6, 7, 8, 9, 11, 12, 13, 14)" if zones else ""}"""


FULL = "batter, pitcher, stand, pitch_subtype, is_zone, zone, p_throws, balls, strikes, league"
SHORT = "batter, pitcher, stand, pitch_subtype, is_zone, p_throws, balls, strikes"
THREE = ("Low", "Medium", "High")
SIX = ("Very_Low", "Low", "Medium", "Med_High", "High", "Extreme")


def _edges(rates: str, q: int) -> str:
    probs = ", ".join(f"CAST({k} AS DOUBLE) / {q}" for k in range(1, q))
    return f"(SELECT quantile_cont(whiff_rate, [{probs}]) FROM {rates})"


def _group(names, rates: str) -> str:
    edges = _edges(rates, len(names))
    whens = " ".join(
        f"WHEN round(whiff_rate, 9) <= round({edges}[{k}], 9) THEN '{n}'" for k, n in enumerate(names[:-1], 1)
    )
    return f"CASE {whens} ELSE '{names[-1]}' END"


def _rates(sample: str, key: str, where: str = "") -> str:
    return f"SELECT {key}, count(*) AS swings, avg(is_whiff) AS whiff_rate FROM {sample} {where} GROUP BY {key}"


def _labels(frame: str, cols) -> str:
    """Sorted distinct values of each column; integer columns sort as numbers."""
    parts = []
    for c in cols:
        num = f"CAST({c} AS BIGINT)" if c in ("batter", "pitcher") else "CAST(NULL AS BIGINT)"
        parts.append(f"SELECT DISTINCT '{c}' AS col, {num} AS num, CAST({c} AS VARCHAR) AS value FROM {frame}")
    return f"""SELECT col, value, row_number() OVER (PARTITION BY col ORDER BY num NULLS LAST, value NULLS LAST) - 1 AS idx
FROM ({" UNION ALL ".join(parts)})"""


def _encoded(frame: str, labels: str, cols, zone_num: bool) -> str:
    joins = " ".join(
        f"JOIN {labels} l_{c} ON l_{c}.col = '{c}' AND l_{c}.value IS NOT DISTINCT FROM CAST(f.{c} AS VARCHAR)"
        for c in cols
    )
    idx = ", ".join(f"l_{c}.idx AS {c}_idx" for c in cols)
    num = f", {ZONE_NUM} AS zone_num_idx" if zone_num else ""
    return f"SELECT f.*, {idx}, is_zone AS zone_idx{num} FROM {frame} f {joins}"


ENH = ("batter", "pitcher", "stand", "pitch_subtype", "p_throws", "league", "batter_whiff_group", "count_bucket")
HIER = (
    "batter", "pitcher", "stand", "pitch_subtype", "p_throws", "league", "whiff_group_3", "whiff_group_6",
    "pitcher_whiff_group_3", "pitcher_whiff_group_6",
)
TWO = ("batter", "pitcher", "stand", "pitch_subtype", "p_throws", "count_bucket")


def _enh_frame(sample: str, groups: str) -> str:
    return (
        f"SELECT s.*, batter_whiff_group, {COUNT_BUCKET} AS count_bucket FROM {sample} s LEFT JOIN {groups} USING (batter)"
    )


def _hier_frame(sample: str) -> str:
    return f"""SELECT s.*, whiff_group_3, whiff_group_6, pitcher_whiff_group_3, pitcher_whiff_group_6
FROM {sample} s LEFT JOIN hier_batters USING (batter) LEFT JOIN hier_pitchers USING (pitcher)"""


def _two_frame(sample: str) -> str:
    return f"SELECT * FROM (SELECT *, {COUNT_STRICT} AS count_bucket FROM {sample}) WHERE count_bucket IS NOT NULL"


# formulas again, written out for the checker: (term, index columns)
FORMULAS = {
    "enh": (
        ("intercept", ()),
        ("batter_league", ("batter", "league")),
        ("batter_zone", ("batter", "zone")),
        ("batter_subtype", ("batter", "pitch_subtype")),
        ("batter_p_throws", ("batter", "p_throws")),
        ("pitcher_zone", ("pitcher", "zone")),
        ("pitcher_subtype", ("pitcher", "pitch_subtype")),
        ("pitcher_stand", ("pitcher", "stand")),
        ("pitcher_league", ("pitcher", "league")),
        ("group_zone_subtype", ("batter_whiff_group", "zone_num", "pitch_subtype")),
        ("group_count", ("batter_whiff_group", "count_bucket")),
    ),
    "hier": (
        ("intercept", ()),
        ("batter_group_league", ("whiff_group_6", "league")),
        ("batter_league", ("batter", "league")),
        ("pitcher_group_league", ("pitcher_whiff_group_6", "league")),
        ("pitcher_league", ("pitcher", "league")),
        ("batter_group_zone_subtype", ("whiff_group_6", "zone", "pitch_subtype")),
        ("batter_zone_subtype", ("batter", "zone", "pitch_subtype")),
        ("batter_p_throws", ("batter", "p_throws")),
        ("pitcher_group_zone_subtype", ("pitcher_whiff_group_6", "zone", "pitch_subtype")),
        ("pitcher_zone_subtype", ("pitcher", "zone", "pitch_subtype")),
        ("pitcher_stand", ("pitcher", "stand")),
        ("zone_num_subtype", ("zone_num", "pitch_subtype")),
        ("group_group_zone_subtype", ("whiff_group_6", "pitcher_whiff_group_6", "zone", "pitch_subtype")),
    ),
    "two": (
        ("intercept", ()),
        ("batter_zone", ("batter", "zone")),
        ("batter_subtype", ("batter", "pitch_subtype")),
        ("batter_p_throws", ("batter", "p_throws")),
        ("batter_count", ("batter", "count_bucket")),
        ("pitcher_zone", ("pitcher", "zone")),
        ("pitcher_subtype", ("pitcher", "pitch_subtype")),
        ("pitcher_stand", ("pitcher", "stand")),
        ("pitcher_count", ("pitcher", "count_bucket")),
    ),
}


def _params(formula: str, labels: str) -> str:
    """One row per term, key combination, chain and draw."""

    def size(c: str) -> str:
        return {"zone": "2", "zone_num": "13"}.get(c, f"(SELECT count(*) FROM {labels} WHERE col = '{c}')")

    parts = []
    for salt, (term, keys) in enumerate(FORMULAS[formula]):
        sources = [f"(SELECT unnest(range({size(c)})) AS k{i})" for i, c in enumerate(keys, 1)]
        sources += [f"(SELECT 0 AS k{i})" for i in range(len(keys) + 1, 5)]
        sources += [f"(SELECT unnest(range({S.CHAINS})) AS chain)", f"(SELECT unnest(range({S.DRAWS})) AS draw)"]
        parts.append(
            f"""SELECT '{term}' AS term, k1, k2, k3, k4, chain, draw,
  ((k1 * 31 + k2 * 17 + k3 * 11 + k4 * 5 + chain * 3 + draw * 7 + {salt}) % 100 - 50) / CAST(100 AS DOUBLE) AS value
FROM {" CROSS JOIN ".join(sources)}"""
        )
    return " UNION ALL ".join(parts)


def _lists(params: str) -> str:
    """All draws of one effect in a list."""
    return f"""SELECT term, k1, k2, k3, k4, list(value ORDER BY chain, draw) AS v
FROM {params} GROUP BY term, k1, k2, k3, k4"""


def _score(formula: str, frame: str, params: str, missing=(), extra: str = "") -> str:
    """Mean over draws of the logistic of the summed effects, per row of the frame."""
    terms = [t for t in FORMULAS[formula] if t[0] not in missing]
    keys = list(dict.fromkeys(f"{k}_idx" for _, ks in terms for k in ks))
    cols = ", ".join(keys)
    joins = " ".join(
        f"LEFT JOIN (SELECT * FROM {params} WHERE term = '{term}') t{i} ON "
        + (" AND ".join(f"t{i}.k{j} = c.{k}_idx" for j, k in enumerate(ks, 1)) or "true")
        for i, (term, ks) in enumerate(terms)
    )
    effects = ", ".join(f"unnest(t{i}.v) AS e{i}" for i in range(len(terms)))
    logit = " + ".join(f"e{i}" for i in range(len(terms)))
    return f"""SELECT batter, pitcher, is_whiff, {extra}{cols}, {r("score")} FROM {frame} JOIN (
  SELECT {cols}, avg(1 / (1 + exp(-({logit})))) AS score FROM (
    SELECT {", ".join(f"c.{k}" for k in keys)}, {effects} FROM (SELECT DISTINCT {cols} FROM {frame}) c {joins})
  GROUP BY {cols}) p USING ({cols})"""


CTES = {
    "pitch_view": PITCH_VIEW,
    "pitchers_view": PITCHERS_VIEW,
    "batters_view": BATTERS_VIEW,
    "scored_view": SCORED_VIEW,
    "angled": """SELECT *, CASE WHEN 198.27 - hc_y <> 0 THEN atan((hc_x - 125.42) / (198.27 - hc_y)) END AS phi,
  estimated_slg_using_speedangle - estimated_ba_using_speedangle AS estimated_iso_using_speedangle FROM pitch_view""",
    "weighted": """SELECT *, CASE WHEN phi < -1 OR phi > 1 THEN 1.138 WHEN phi IS NOT NULL THEN 0.569 * phi * phi + 0.569 END
  AS HA_factor FROM angled""",
    "adjusted": "SELECT *, estimated_iso_using_speedangle * HA_factor AS HA_Adj_estimated_xISO FROM weighted",
    "metrics": f"""SELECT *, CASE WHEN HA_Adj_estimated_xISO > 0.3 THEN 1 WHEN HA_Adj_estimated_xISO IS NOT NULL THEN 0 END AS blast,
  {IS_ZONE} AS is_zone, {BUCKET} AS pitch_bucket, {SUBTYPE} AS pitch_subtype FROM adjusted""",
    "q_season": f"SELECT * FROM pitch_view WHERE league = 'major' AND game_year = {S.YEAR} AND description IN {SWINGS}",
    "q_batters": f"SELECT batter, count(*) AS swings FROM q_season GROUP BY batter HAVING count(*) > {S.MIN_BATTER}",
    "q_pitchers": f"SELECT pitcher, count(*) AS swings FROM q_season GROUP BY pitcher HAVING count(*) > {S.MIN_PITCHER}",
    "train": _sample(S.TRAIN, FULL, True),
    "held": _sample(S.HOLD_OUT, FULL, True),
    "train_two": _sample(S.TRAIN, SHORT, False),
    "held_two": _sample(S.HOLD_OUT, SHORT, False),
    "b_rates": _rates("train", "batter"),
    "b_rates_held": _rates("held", "batter"),
    "b_rates_major": _rates("train", "batter", "WHERE league = 'major'"),
    "p_rates": _rates("train", "pitcher"),
    "p_rates_major": _rates("train", "pitcher", "WHERE league = 'major'"),
    "enh_groups": f"SELECT batter, {_group(THREE, 'b_rates')} AS batter_whiff_group FROM b_rates",
    "own_groups": f"SELECT batter, {_group(THREE, 'b_rates_held')} AS batter_whiff_group FROM b_rates_held",
    "hier_batters": f"""SELECT batter, {_group(THREE, 'b_rates_major')} AS whiff_group_3,
  {_group(SIX, 'b_rates_major')} AS whiff_group_6 FROM b_rates_major""",
    "hier_pitchers": f"""SELECT pitcher, {_group(THREE, 'p_rates_major')} AS pitcher_whiff_group_3,
  {_group(SIX, 'p_rates_major')} AS pitcher_whiff_group_6 FROM p_rates_major""",
    "enh_train": _enh_frame("train", "enh_groups"),
    "enh_held": _enh_frame("held", "enh_groups"),
    "enh_own": _enh_frame("held", "own_groups"),
    "enh_labels": _labels("enh_train", ENH),
    "enh_frame": _encoded("enh_train", "enh_labels", ENH, True),
    "enh_held_frame": _encoded("enh_held", "enh_labels", ENH, True),
    "enh_own_frame": _encoded("enh_own", "enh_labels", ENH, True),
    "hier_train": _hier_frame("train"),
    "hier_held": _hier_frame("held"),
    "hier_labels": _labels("hier_train", HIER),
    "hier_frame": _encoded("hier_train", "hier_labels", HIER, True),
    "hier_held_frame": _encoded("hier_held", "hier_labels", HIER, True),
    "two_train": _two_frame("train_two"),
    "two_held": _two_frame("held_two"),
    "two_labels": _labels("two_train", TWO),
    "two_frame": _encoded("two_train", "two_labels", TWO, False),
    "two_held_frame": _encoded("two_held", "two_labels", TWO, False),
    "enh_params": _params("enh", "enh_labels"),
    "hier_params": _params("hier", "hier_labels"),
    "two_params": _params("two", "two_labels"),
    "enh_lists": _lists("enh_params"),
    "hier_lists": _lists("hier_params"),
    "two_lists": _lists("two_params"),
    # games
    "games": """SELECT game_pk, game_date, home_team, away_team FROM (
  SELECT *, row_number() OVER (PARTITION BY game_pk ORDER BY game_date NULLS LAST, home_team NULLS LAST, away_team NULLS LAST) AS rn
  FROM pitch_view WHERE game_pk IS NOT NULL) WHERE rn = 1""",
    "starters": """SELECT game_pk, max(CASE WHEN inning_topbot = 'Top' THEN pitcher END) AS home_starting_pitcher,
  max(CASE WHEN inning_topbot = 'Bot' THEN pitcher END) AS away_starting_pitcher FROM (
  SELECT *, row_number() OVER (PARTITION BY game_pk, inning_topbot
    ORDER BY game_date NULLS LAST, inning NULLS LAST, outs_when_up NULLS LAST, pitcher) AS rn
  FROM pitch_view WHERE pitcher IS NOT NULL AND inning_topbot IS NOT NULL) WHERE rn = 1 GROUP BY game_pk""",
    "first_seen": """SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY game_pk, inning_topbot, batter
    ORDER BY game_date NULLS LAST, inning NULLS LAST, outs_when_up NULLS LAST) AS rn
  FROM pitch_view WHERE batter IS NOT NULL AND inning_topbot IN ('Top', 'Bot')) WHERE rn = 1""",
    "nine": """SELECT game_pk, CASE inning_topbot WHEN 'Bot' THEN 'home' ELSE 'away' END AS side, position, batter FROM (
  SELECT game_pk, inning_topbot, batter, row_number() OVER (PARTITION BY game_pk, inning_topbot
    ORDER BY game_date NULLS LAST, inning NULLS LAST, outs_when_up NULLS LAST, batter) AS position
  FROM first_seen) WHERE position <= 9""",
    "line_ups": "SELECT game_pk, "
    + ", ".join(
        f"max(CASE WHEN side = '{side}' AND position = {k} THEN batter END) AS {side}_batter_{k}"
        for side in ("home", "away")
        for k in range(1, 10)
    )
    + " FROM nine GROUP BY game_pk",
    "start_games": "SELECT * FROM games LEFT JOIN starters USING (game_pk) LEFT JOIN line_ups USING (game_pk)",
    # load
    "calendar": " UNION ALL ".join(
        f"""SELECT '{lg}' AS league, {y} AS game_year, DATE '{a}' AS "start", DATE '{b}' AS "end" """
        for lg, y, a, b in S.SEASONS
    ),
    "loaded": f"""SELECT p.* FROM metrics p JOIN calendar c ON p.league = c.league AND game_date BETWEEN c."start" AND c."end"
WHERE game_date < DATE '{S.AS_OF}'""",
    # evaluation
    "by_score": "SELECT score, sum(is_whiff) AS pos, sum(1 - is_whiff) AS neg FROM scored_view GROUP BY score",
}


def _auc(by: str = "") -> str:
    """One row per group with counts and the area under the curve."""
    keys, part = (f"{by}, ", f"PARTITION BY {by}") if by else ("", "")
    where = f"WHERE {by} IS NOT NULL" if by else ""
    return f"""SELECT {keys}sum(pos * (below + neg / 2.0)) / nullif(sum(pos) * sum(neg), 0) AS auc FROM (
  SELECT *, coalesce(sum(neg) OVER ({part} ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
  FROM (SELECT {keys}score, CAST(sum(is_whiff) AS DOUBLE) AS pos, CAST(sum(1 - is_whiff) AS DOUBLE) AS neg
        FROM scored_view {where} GROUP BY {keys}score)) {"GROUP BY " + by if by else ""}"""


LOSS = "-(CASE WHEN is_whiff = 1 THEN ln(greatest(score, 2.220446049250313e-16)) ELSE ln(1 - least(score, 1 - 2.220446049250313e-16)) END)"
CELLS = """count(*) FILTER (score <= 0.5 AND is_whiff = 0) AS tn, count(*) FILTER (score > 0.5 AND is_whiff = 0) AS fp,
  count(*) FILTER (score <= 0.5 AND is_whiff = 1) AS fn, count(*) FILTER (score > 0.5 AND is_whiff = 1) AS tp"""


def _safe(part: str, whole: str) -> str:
    return f"coalesce(CAST({part} AS DOUBLE) / nullif({whole}, 0), 0)"


WHIFF_RATES = (
    ("precision_whiff", _safe("tp", "tp + fp")),
    ("recall_whiff", _safe("tp", "tp + fn")),
    ("f1_whiff", _safe("2 * tp", "2 * tp + fp + fn")),
)
NO_WHIFF_RATES = (
    ("precision_no_whiff", _safe("tn", "tn + fn")),
    ("recall_no_whiff", _safe("tn", "tn + fp")),
    ("f1_no_whiff", _safe("2 * tn", "2 * tn + fp + fn")),
)
RATES = (
    ("accuracy", "CAST(tn + tp AS DOUBLE) / nullif(tn + fp + fn + tp, 0)"),
    ("sensitivity", "CAST(tp AS DOUBLE) / nullif(tp + fn, 0)"),
    ("specificity", "CAST(tn AS DOUBLE) / nullif(tn + fp, 0)"),
)


def _overall(by: str = "") -> str:
    """One row per group with every overall metric."""
    keys = f"{by}, " if by else ""
    base = f"""SELECT {keys}count(*) AS n, avg((score - is_whiff) * (score - is_whiff)) AS brier_score,
  avg({LOSS}) AS log_loss, {CELLS} FROM scored_view {f"WHERE {by} IS NOT NULL GROUP BY {by}" if by else ""}"""
    join = f"JOIN ({_auc(by)}) a USING ({by})" if by else f"CROSS JOIN ({_auc()}) a"
    return f"SELECT * FROM ({base}) m {join}"


def _by_group(by: str, both: bool) -> str:
    rates = WHIFF_RATES + (NO_WHIFF_RATES if both else ())
    cols = ", ".join(r(e, n) for n, e in (("auc", "auc"), ("brier_score", "brier_score"), ("log_loss", "log_loss"), *rates))
    return f"SELECT {by}, n, {cols} FROM ({_overall(by)}) o WHERE auc IS NOT NULL"


def _report(by: str = "") -> str:
    keys = f"{by}, " if by else ""
    plain = [(c, f"CAST({c} AS DOUBLE)") for c in ("n", "auc", "brier_score", "log_loss", "tn", "fp", "fn", "tp")]
    rows = " UNION ALL ".join(
        f"SELECT {keys}'{n}' AS metric, {r(e, 'value')} FROM o" for n, e in (*plain, *NO_WHIFF_RATES, *WHIFF_RATES, *RATES)
    )
    return f"SELECT * FROM (WITH o AS ({_overall(by)}) {rows})"


def _roc_thin(by: str = "") -> str:
    """Corners of the curve: the lowest score of a group, and scores whose step turns against the next lower one's."""
    keys, part = (f"{by}, ", f"PARTITION BY {by}") if by else ("", "")
    same = f"k.{by} = t.{by} AND " if by else ""
    corners = f"""SELECT {keys}round(score, 9) + 0.0 AS corner FROM (SELECT *, lag(pos) OVER w AS q, lag(neg) OVER w AS m FROM (
    SELECT {keys}score, CAST(sum(is_whiff) AS HUGEINT) AS pos, CAST(sum(1 - is_whiff) AS HUGEINT) AS neg
    FROM scored_view {f"WHERE {by} IS NOT NULL" if by else ""} GROUP BY {keys}score) WINDOW w AS ({part} ORDER BY score)) WHERE q IS NULL OR pos * m <> neg * q"""
    return f"""SELECT * FROM ({_roc(by, f"WHERE {by} IS NOT NULL" if by else "")}) t
WHERE threshold IS NULL OR EXISTS (SELECT 1 FROM ({corners}) k WHERE {same}k.corner = t.threshold)"""


def _roc(by: str = "", where: str = "") -> str:
    keys, part = (f"{by}, ", f"PARTITION BY {by}") if by else ("", "")
    frame = f"({part} ORDER BY score DESC ROWS UNBOUNDED PRECEDING)"
    whole = f"({part})"
    start = f"SELECT DISTINCT {keys}CAST(NULL AS DOUBLE) AS threshold, CAST(0 AS DOUBLE) AS fpr, CAST(0 AS DOUBLE) AS tpr FROM c"
    return f"""SELECT * FROM (WITH c AS (SELECT {keys}score, CAST(sum(is_whiff) AS DOUBLE) AS pos,
    CAST(sum(1 - is_whiff) AS DOUBLE) AS neg FROM scored_view {where} GROUP BY {keys}score)
  SELECT {keys}round(score, 9) + 0.0 AS threshold, {r(f"sum(neg) OVER {frame} / sum(neg) OVER {whole}", "fpr")},
    {r(f"sum(pos) OVER {frame} / sum(pos) OVER {whole}", "tpr")} FROM c UNION ALL {start})"""


TOP_TYPES = """(SELECT pitch_type FROM scored_view WHERE pitch_type IS NOT NULL GROUP BY pitch_type
  HAVING min(is_whiff) < max(is_whiff) ORDER BY count(*) DESC, pitch_type LIMIT 6)"""
BIN = " + ".join(f"CASE WHEN score > {k} * CAST(0.1 AS DOUBLE) THEN 1 ELSE 0 END" for k in range(1, 10))
TOTALS = f"""SELECT league, game_year, count(*) AS n, max(game_date) AS last_day, CAST(sum(pitcher) AS BIGINT) AS pitcher_sum,
  {r("avg(round(plate_x, 4))", "mean_plate_x")}, CAST(sum(blast) AS BIGINT) AS blasts FROM loaded"""


def _modelled(frame: str, cols, zone_num: bool) -> str:
    idx = ", ".join(f"{c}_idx" for c in (*cols, "zone", *(("zone_num",) if zone_num else ())))
    return f"SELECT batter, pitcher, is_whiff, {idx} FROM {frame}"


def _column(name: str, source: str = "metrics", expr: str | None = None) -> str:
    return f"SELECT {ID}, {expr or r(name)} FROM {source}"


FLIP = """CASE WHEN contains(player_name, ',') THEN concat(ltrim(split_part(player_name, ',', 2)), ' ', split_part(player_name, ',', 1))
  ELSE player_name END"""
DOUBLES = (
    "plate_x", "plate_z", "sz_top", "sz_bot", "hc_x", "hc_y", "estimated_ba_using_speedangle",
    "estimated_slg_using_speedangle",
)
PITCH_COLUMNS = (
    "game_pk, game_date, game_year, batter, pitcher, inning, outs_when_up, inning_topbot, home_team, away_team, "
    "description, pitch_type, zone, p_throws, stand, balls, strikes, league"
)
PARAM_KEYS = "term, k1, k2, k3, k4"


def _hand(view: str, player: str, attr: str, kind: str, pitches: str = "pitch_view") -> str:
    return f"""SELECT player_id, player_name, hand, '{kind}' AS kind FROM {view} LEFT JOIN (
  SELECT {player} AS player_id, {attr} AS hand FROM (
    SELECT {player}, {attr}, row_number() OVER (PARTITION BY {player} ORDER BY count(*) DESC, {attr}) AS rn
    FROM {pitches} WHERE {attr} IS NOT NULL GROUP BY {player}, {attr}) WHERE rn = 1) USING (player_id)"""


def _conformed() -> str:
    have = [c.strip() for c in PITCH_COLUMNS.split(",")]
    cols = []
    for f in PITCH_SCHEMA.fields:
        if f.name in DOUBLES:
            cols.append(r(f.name))
        elif f.name in have:
            cols.append(f"CAST({f.name} AS {f.dataType.simpleString()}) AS {f.name}")
        else:
            cols.append(f"CAST(NULL AS {f.dataType.simpleString()}) AS {f.name}")
    return f"SELECT {', '.join(cols)} FROM pitch_view"


def _held_report() -> str:
    """Overall metrics and some per subtype and zone, from the scored hold-out."""
    parts = [f"SELECT 'all' AS \"group\", metric, value FROM ({_report()})"]
    parts.append("SELECT 'all', 'whiff_rate', round(avg(is_whiff), 9) + 0.0 FROM scored_view")
    for by in ("pitch_subtype", "zone"):
        table = _by_group(by, False)
        for m in ("n", "auc", "log_loss", "f1_whiff"):
            parts.append(
                f"SELECT concat('{by}=', CAST({by} AS VARCHAR)), '{m}', CAST({m} AS DOUBLE) FROM ({table})"
            )
    return " UNION ALL ".join(parts).replace("scored_view", "scored_held")


SUMMARY = f"""SELECT {PARAM_KEYS}, {r("mean")}, {r("sd")}, {r("hdi_low")}, {r("hdi_high")}, {r("r_hat")} FROM (
  SELECT {PARAM_KEYS}, avg(value) AS mean, stddev_samp(value) AS sd FROM enh_params GROUP BY {PARAM_KEYS}) JOIN (
  SELECT {PARAM_KEYS}, lo AS hdi_low, hi AS hdi_high FROM (
    SELECT *, row_number() OVER (PARTITION BY {PARAM_KEYS} ORDER BY hi - lo, lo) AS rn FROM (
      SELECT {PARAM_KEYS}, value AS lo, lead(value, {S.CHAINS * S.DRAWS * 94 // 100}) OVER (PARTITION BY {PARAM_KEYS} ORDER BY value) AS hi
      FROM enh_params) WHERE hi IS NOT NULL) WHERE rn = 1) USING ({PARAM_KEYS}) JOIN (
  SELECT {PARAM_KEYS}, sqrt(({S.DRAWS // 2 - 1} / CAST({S.DRAWS // 2} AS DOUBLE) * avg(v) + var_samp(m)) / nullif(avg(v), 0)) AS r_hat FROM (
    SELECT {PARAM_KEYS}, chain, draw < {S.DRAWS // 2} AS half, avg(value) AS m, var_samp(value) AS v
    FROM enh_params GROUP BY {PARAM_KEYS}, chain, draw < {S.DRAWS // 2}) GROUP BY {PARAM_KEYS}) USING ({PARAM_KEYS})"""

DERIVED = (
    "phi", "estimated_iso_using_speedangle", "HA_factor", "HA_Adj_estimated_xISO", "blast", "is_zone", "pitch_bucket", "pitch_subtype",
)
GAME_COLUMNS = ["game_pk", "game_date", "home_team", "away_team", "home_starting_pitcher", "away_starting_pitcher"] + [
    f"{side}_batter_{k}" for side in ("home", "away") for k in range(1, 10)
]


def _content(name: str, source: str, columns, key: str, where: str = "") -> str:
    """Rows, filled cells and the sum of the key of a table."""
    filled = " + ".join(f"count({c})" for c in columns)
    return f"""SELECT '{name}' AS table_name, count(*) AS n_rows, CAST({filled} AS BIGINT) AS n_filled,
  CAST(sum({key}) AS BIGINT) AS key_sum FROM {source} {where}"""


def _stationary(formula: str, frame: str) -> str:
    """Every effect that has data and every scale, as stationary."""
    parts = [f"SELECT 'sigma_{t}' AS term, 0 AS k1, 0 AS k2, 0 AS k3, 0 AS k4, TRUE AS stationary" for t, keys in FORMULAS[formula] if keys]
    for term, keys in FORMULAS[formula]:
        cols = [f"{keys[i]}_idx AS k{i + 1}" if i < len(keys) else f"0 AS k{i + 1}" for i in range(4)]
        parts.append(f"SELECT DISTINCT '{term}' AS term, {', '.join(cols)}, TRUE AS stationary FROM {frame}")
    return " UNION ALL ".join(parts)


def _gathered() -> str:
    """Sum of all draws of each term over the distinct cells of the hold-out, per block."""
    terms = [t for t in FORMULAS["enh"] if t[1]]
    cols = ", ".join(dict.fromkeys(f"{k}_idx" for _, ks in terms for k in ks))
    parts = []
    for term, keys in terms:
        on = " AND ".join(f"k{i} = c.{k}_idx" for i, k in enumerate(keys, 1))
        parts.append(f"""SELECT draw_block, '{term}' AS term, count(*) AS found, {r("sum(s)", "effect_sum")} FROM (
  SELECT DISTINCT {cols} FROM enh_held_frame) c JOIN (SELECT k1, k2, k3, k4, (chain * {S.DRAWS} + draw) // {S.BLOCK} AS draw_block, sum(value) AS s
  FROM enh_params WHERE term = '{term}' GROUP BY ALL) p ON {on} GROUP BY draw_block""")
    return " UNION ALL ".join(parts)


def _saved() -> str:
    """What an evaluation saves, cell by cell, six digits."""
    table = _by_group("pitch_type", True)
    names = ["n", "auc", "brier_score", "log_loss", *(n for n, _ in WHIFF_RATES + NO_WHIFF_RATES)]
    parts = [f"SELECT 'all' AS \"group\", metric, round(value, 6) + 0.0 AS value FROM ({_report()})"]
    for name, value in (("scores", "count(score)"), ("score_sum", "sum(score)"), ("whiffs", "sum(is_whiff)")):
        parts.append(f"SELECT 'predictions', '{name}', round(CAST({value} AS DOUBLE), 6) + 0.0 FROM scored_view")
    parts += [f"SELECT pitch_type, '{m}', round(CAST({m} AS DOUBLE), 6) + 0.0 FROM ({table})" for m in names]
    return " UNION ALL ".join(parts)


def _levels(c: str, labels: str) -> str:
    return {"zone": "2", "zone_num": "13"}.get(c, f"(SELECT count(*) FROM {labels} WHERE col = '{c}')")


def _drawn(labels: str) -> str:
    """Effects per term, with draws that agree with the fit."""
    parts = [
        f"SELECT '{t}' AS term, CAST({' * '.join(['1', *(_levels(k, labels) for k in keys)])} AS BIGINT) AS effects, TRUE AS means_agree, TRUE AS chains_agree, TRUE AS spread"
        for t, keys in FORMULAS["enh"]]
    parts += [f"SELECT 'sigma_{t}', 1, TRUE, TRUE, FALSE" for t, keys in FORMULAS["enh"] if keys]
    return " UNION ALL ".join(parts)


def _params_of(labels: str) -> str:
    """Rows per label column and parameter rows per term."""

    def size(c: str) -> str:
        return {"zone": "2", "zone_num": "13"}.get(c, f"(SELECT count(*) FROM {labels} WHERE col = '{c}')")

    blocks = S.CHAINS * S.DRAWS // S.BLOCK
    parts = [f"SELECT col, count(*) AS n FROM {labels} GROUP BY col"]
    parts += [f"SELECT '{t}', {' * '.join([str(blocks), *map(size, keys)])}" for t, keys in FORMULAS["enh"]]
    return " UNION ALL ".join(parts)


ORACLE = {
    # scans, sources, sinks
    "read_pitch_csv": f"SELECT {PITCH_COLUMNS}, {', '.join(r(c) for c in DOUBLES)} FROM pitch_view",
    "read_player_csv": "SELECT player_id, min(player_name) AS player_name FROM batters_view GROUP BY player_id",
    "scan_pitches": "SELECT game_pk, batter, pitcher, description, league FROM pitch_view WHERE league = 'minor'",
    "read_pitch_csv_mixed": f"SELECT {PITCH_COLUMNS.replace(', league', '')}, {', '.join(r(c) for c in DOUBLES)} FROM pitch_view",
    "build_pitch_table": "SELECT league, game_year, count(*) AS n, CAST(sum(blast) AS BIGINT) AS blasts FROM metrics GROUP BY league, game_year",
    "build_model": _params_of("enh_labels"),
    "create_tables": " UNION ALL ".join(
        [_content(f"{kind}s", f"{kind}s_view", ("player_id", "player_name"), "player_id") for kind in ("pitcher", "batter")]
        + [
            _content(f"pitches_{lg}", "metrics", (*PITCH_COLUMNS.replace(", league", "").split(", "), *DOUBLES, *DERIVED), "game_pk", f"WHERE league = '{lg}'")
            for lg in ("major", "minor")
        ]
        + [_content("start_game", "start_games", GAME_COLUMNS, "game_pk")]
    ),
    "add_columns_if_missing": f"""SELECT {ID}, description, CAST(NULL AS DOUBLE) AS phi,
  CAST(NULL AS DOUBLE) AS estimated_iso_using_speedangle, CAST(NULL AS DOUBLE) AS HA_factor,
  CAST(NULL AS DOUBLE) AS HA_Adj_estimated_xISO, CAST(NULL AS INT) AS blast, CAST(NULL AS INT) AS is_zone,
  CAST(NULL AS VARCHAR) AS pitch_bucket, CAST(NULL AS VARCHAR) AS pitch_subtype FROM pitch_view""",
    "conform_to_schema": _conformed(),
    "append_pitches": """SELECT league, game_year, count(*) AS n, CAST(sum(pitcher) AS BIGINT) AS pitcher_sum FROM pitch_view
GROUP BY league, game_year""",
    "overwrite_table": "SELECT * FROM games",
    "insert_new_players": """SELECT player_id, player_name, CASE WHEN NOT contains(player_name, ',') THEN 'L' END AS stand
FROM batters_view""",
    "write_report_csv": _by_group("pitch_type", True),
    "save_eval_tables": _saved(),
    "save_labels": f"SELECT * FROM ({_labels('train', ('batter', 'pitcher', 'stand', 'pitch_subtype'))})",
    "register_frame": "SELECT league, description, count(*) AS n FROM pitch_view GROUP BY league, description",
    # incremental load
    "latest_date": "SELECT max(game_date) AS latest_date FROM pitch_view",
    "season_calendar": """SELECT league, game_year, "start", "end",
  count(*) FILTER (game_date BETWEEN "start" AND "end") AS in_season
FROM pitch_view JOIN calendar USING (league, game_year) GROUP BY league, game_year, "start", "end" """,
    "dates_to_load": f"""SELECT league, CAST(d AS DATE) AS game_date FROM (
  SELECT c.league, unnest(generate_series(greatest("start", coalesce(latest + 1, "start")), least("end", DATE '{S.AS_OF}' - 1), INTERVAL 1 DAY)) AS d
  FROM calendar c LEFT JOIN (SELECT league, max(game_date) AS latest FROM pitch_view
    WHERE league = 'major' AND game_date < DATE '{S.FIRST_AS_OF}' GROUP BY league) USING (league))""",
    "incremental_append": f"{TOTALS} GROUP BY league, game_year",
    "incremental_append_stream": f"{TOTALS} GROUP BY league, game_year",
    "stream_held_rows": f"{TOTALS} GROUP BY league, game_year",
    "clean_players": f"""SELECT player_id, {FLIP} AS player_name, hand, kind FROM (
  {_hand("pitchers_view", "pitcher", "p_throws", "pitcher", "loaded")}
  UNION ALL {_hand("batters_view", "batter", "stand", "batter", "loaded")})""",
    "refresh_metrics": f"""SELECT {ID}, {r("phi")}, {r("estimated_iso_using_speedangle")}, {r("HA_factor")},
  {r("HA_Adj_estimated_xISO")}, blast, is_zone, pitch_bucket, pitch_subtype FROM metrics""",
    "pipeline_run": """SELECT league, count(HA_Adj_estimated_xISO) AS with_metric, count(*) AS total FROM loaded GROUP BY league""",
    # derived columns
    "round_doubles": f"SELECT {ID}, {', '.join(f'round(round({c}, 4), 9) + 0.0 AS {c}' for c in DOUBLES[:6])} FROM pitch_view",
    "hit_angle": _column("phi"),
    "expected_iso": _column("estimated_iso_using_speedangle"),
    "ha_factor": _column("HA_factor"),
    "ha_adj_xiso": _column("HA_Adj_estimated_xISO"),
    "blast_flag": _column("blast", expr="blast"),
    "zone_flag": _column("is_zone", expr="is_zone"),
    "pitch_bucket": _column("pitch_bucket", expr="pitch_bucket"),
    "pitch_subtype": _column("pitch_subtype", expr="pitch_subtype"),
    "whiff_flag": _column("is_whiff", "pitch_view", f"CASE WHEN description IN {WHIFFS} THEN 1 ELSE 0 END AS is_whiff"),
    "count_bucket": _column("count_bucket", "pitch_view", f"{COUNT_BUCKET} AS count_bucket"),
    "count_bucket_strict": f"""SELECT * FROM ({_column("count_bucket", "pitch_view", f"{COUNT_STRICT} AS count_bucket")})
WHERE count_bucket IS NOT NULL""",
    "advanced_metrics": f"""SELECT {ID}, {r("phi")}, {r("estimated_iso_using_speedangle")}, {r("HA_factor")},
  {r("HA_Adj_estimated_xISO")}, blast, is_zone, pitch_bucket, pitch_subtype FROM metrics""",
    "blast_share": f"""SELECT pitch_bucket, count(blast) AS batted_balls, CAST(sum(blast) AS BIGINT) AS blasts,
  {r("avg(HA_Adj_estimated_xISO)", "mean_xiso")} FROM metrics GROUP BY pitch_bucket""",
    "flip_player_name": f"""SELECT player_id, {FLIP} AS player_name FROM pitchers_view
UNION ALL SELECT player_id, {FLIP} FROM batters_view""",
    "zone_index": f"SELECT {ID}, is_zone AS zone_idx, {ZONE_NUM} AS zone_num_idx FROM metrics",
    # filters
    "swings_only": f"SELECT {ID}, description FROM pitch_view WHERE description IN {SWINGS}",
    "date_window": f"""SELECT {ID}, league FROM pitch_view
WHERE game_date BETWEEN DATE '{S.HOLD_OUT[0]}' AND DATE '{S.HOLD_OUT[1]}'""",
    "season_filter": f"SELECT {ID}, game_year FROM pitch_view WHERE game_year = {S.YEAR}",
    "complete_cases": f"""SELECT {ID}, pitch_subtype, is_zone, zone, p_throws, stand FROM metrics
WHERE pitch_subtype <> 'Other' AND is_zone IS NOT NULL AND zone IN (1, 2, 3, 4, 5, 6, 7, 8, 9, 11, 12, 13, 14)
  AND p_throws IS NOT NULL AND stand IS NOT NULL AND balls IS NOT NULL AND strikes IS NOT NULL""",
    "drop_unseen": f"""SELECT {ID}, idx AS pitcher_idx FROM pitch_view
JOIN ({_labels("train", ("pitcher",))}) l ON l.value = CAST(pitcher AS VARCHAR)""",
    # joins
    "semi_join_qualified": f"""SELECT {ID}, league FROM pitch_view
WHERE batter IN (SELECT batter FROM q_batters) AND pitcher IN (SELECT pitcher FROM q_pitchers)""",
    "anti_join_new": """SELECT DISTINCT batter AS player_id FROM pitch_view
WHERE batter NOT IN (SELECT player_id FROM batters_view)""",
    "games_with_pitchers": """SELECT game_pk, game_date, home_team, away_team, h.player_name AS home_pitcher, a.player_name AS away_pitcher
FROM start_games LEFT JOIN pitchers_view h ON h.player_id = home_starting_pitcher
LEFT JOIN pitchers_view a ON a.player_id = away_starting_pitcher""",
    "player_hand": _hand("pitchers_view", "pitcher", "p_throws", "pitcher")
    + " UNION ALL "
    + _hand("batters_view", "batter", "stand", "batter"),
    "attach_groups": "SELECT batter, pitcher, zone, is_whiff, batter_whiff_group FROM enh_train",
    "fk_violations": f"SELECT {ID}, league FROM pitch_view WHERE batter NOT IN (SELECT player_id FROM batters_view)",
    "gather_effect": _gathered(),
    # aggregates
    "row_count": "SELECT count(*) AS n_rows FROM pitch_view",
    "metric_coverage": """SELECT league, count(HA_Adj_estimated_xISO) AS with_metric, count(*) AS total
FROM metrics GROUP BY league""",
    "qualified_players": "SELECT * FROM q_batters",
    "qualified_pitchers": "SELECT * FROM q_pitchers",
    "qualified_both": """SELECT 'batter' AS role, batter AS player_id, swings FROM q_batters
UNION ALL SELECT 'pitcher', pitcher, swings FROM q_pitchers""",
    "unique_games": "SELECT * FROM games",
    "distinct_players": """SELECT DISTINCT player_id, player_name FROM batters_view
WHERE player_id IN (SELECT batter FROM pitch_view)""",
    "player_whiff_rate": f"""SELECT batter, swings, {r("whiff_rate")}, 'all' AS rates_from FROM b_rates
UNION ALL SELECT batter, swings, {r("whiff_rate")}, 'major' FROM b_rates_major""",
    "quantile_groups": f"""SELECT pitcher, swings, {r("whiff_rate")}, {_group(THREE, "p_rates")} AS group_3,
  {_group(SIX, "p_rates")} AS group_6 FROM p_rates""",
    "first_group_per_player": "SELECT batter_idx, min(whiff_group_6_idx) AS whiff_group_6_idx FROM hier_frame GROUP BY batter_idx",
    "overall_whiff_rate": f"SELECT count(*) AS n, {r('avg(is_whiff)', 'whiff_rate')} FROM train",
    "pk_violations": """SELECT game_pk, batter, pitcher, inning, count(*) AS n FROM pitch_view
GROUP BY game_pk, batter, pitcher, inning HAVING count(*) > 1""",
    # games
    "starting_pitchers": "SELECT * FROM starters",
    "first_nine_batters": "SELECT * FROM nine",
    "start_game": "SELECT * FROM start_games",
    "preview_games": "SELECT * FROM games ORDER BY game_pk LIMIT 5",
    # samples and encoding
    "union_leagues": "SELECT league, description, count(*) AS n FROM pitch_view GROUP BY league, description",
    "swing_sample": "SELECT * FROM train",
    "swing_sample_hold_out": "SELECT * FROM held",
    "swing_sample_2way": "SELECT * FROM held_two",
    "fit_labels": f"SELECT * FROM ({_labels('train', ('batter', 'pitcher', 'stand', 'pitch_subtype', 'p_throws', 'league'))})",
    "apply_labels": f"""SELECT {ID}, pitch_type, coalesce(b.idx, -1) AS batter_idx, coalesce(p.idx, -1) AS pitcher_idx,
  t.idx AS pitch_type_idx FROM pitch_view v
LEFT JOIN (SELECT * FROM l WHERE col = 'batter') b ON b.value = CAST(v.batter AS VARCHAR)
LEFT JOIN (SELECT * FROM l WHERE col = 'pitcher') p ON p.value = CAST(v.pitcher AS VARCHAR)
JOIN ({_labels("pitch_view", ("pitch_type",))}) t ON t.value IS NOT DISTINCT FROM v.pitch_type""",
    "model_frame": _modelled("enh_frame", ENH, True),
    "model_frame_hold_out": _modelled("enh_held_frame", ENH, True),
    "model_frame_own_groups": _modelled("enh_own_frame", ENH, True),
    "model_frame_hierarchical": _modelled("hier_frame", HIER, True),
    "model_frame_2way": _modelled("two_frame", TWO, False),
    # model
    "swing_cells": """SELECT batter_idx, league_idx, zone_idx, pitch_subtype_idx, p_throws_idx, pitcher_idx, stand_idx,
  batter_whiff_group_idx, zone_num_idx, count_bucket_idx, count(*) AS n, CAST(sum(is_whiff) AS BIGINT) AS whiffs
FROM enh_frame GROUP BY ALL""",
    "fit_enhanced": _stationary("enh", "enh_frame"),
    "fit_hierarchical": _stationary("hier", "hier_frame"),
    "posterior_of_fit": _drawn("enh_labels"),
    "score_of_fit": """SELECT CAST(count(*) AS DOUBLE) AS n, TRUE AS all_scored, TRUE AS beats_the_rate FROM enh_held_frame""",
    "train_and_evaluate": """SELECT CAST(count(*) AS DOUBLE) AS n, CAST(sum(is_whiff) AS DOUBLE) AS whiffs, CAST(17 AS DOUBLE) AS metrics,
  TRUE AS beats_the_rate FROM two_held_frame""",
    "score_enhanced": _score("enh", "enh_held_frame", "enh_lists"),
    "score_enhanced_core": _score(
        "enh", "enh_held_frame", "enh_lists", ("batter_league", "pitcher_league", "group_count")
    ),
    "score_2way": _score("two", "two_held_frame", "two_lists"),
    "score_hierarchical": _score("hier", "hier_held_frame", "hier_lists"),
    "effect_draws": f"""SELECT o.term, o.k1, o.k2, o.k3, o.k4, o.block AS draw_block,
  {r(f"sum(CASE WHEN o.at % {S.BLOCK} = 0 THEN o.value * (abs(s.value) + 0.5) END)", "first_draw")},
  {r("sum(o.value * (abs(s.value) + 0.5))", "draw_sum")}
FROM (SELECT *, chain * {S.DRAWS} + draw AS at, (chain * {S.DRAWS} + draw) // {S.BLOCK} AS block FROM enh_params) o
JOIN enh_params s ON s.term = o.term AND s.chain = o.chain AND s.draw = o.draw AND s.k1 + s.k2 + s.k3 + s.k4 = 0
GROUP BY o.term, o.k1, o.k2, o.k3, o.k4, o.block""",
    "posterior_summary": SUMMARY,
    "rebuild_start_game": "SELECT * FROM start_games",
    "evaluate_hold_out": _held_report(),
    # evaluation
    "auc": f"SELECT {r('auc')} FROM ({_auc()})",
    "auc_by_league": f"SELECT league, {r('auc')} FROM ({_auc('league')})",
    "brier_score": f"SELECT {r('avg((score - is_whiff) * (score - is_whiff))', 'brier_score')} FROM scored_view",
    "log_loss": f"SELECT {r(f'avg({LOSS})', 'log_loss')} FROM scored_view",
    "confusion_matrix": f"SELECT {CELLS} FROM scored_view",
    "classification_report": " UNION ALL ".join(
        f"""SELECT {cls} AS class, {r(rates[0][1], "precision")}, {r(rates[1][1], "recall")}, {r(rates[2][1], "f1")},
  {support} AS support FROM (SELECT {CELLS} FROM scored_view)"""
        for cls, rates, support in ((0, NO_WHIFF_RATES, "tn + fp"), (1, WHIFF_RATES, "fn + tp"))
    ),
    "classification_averages": " UNION ALL ".join(
        f"SELECT '{kind}' AS average, "
        + ", ".join(
            r(f"(({NO_WHIFF_RATES[i][1]}) * {no} + ({WHIFF_RATES[i][1]}) * {yes}) / CAST({no} + {yes} AS DOUBLE)", name)
            for i, name in enumerate(("precision", "recall", "f1"))
        )
        + f", tn + fp + fn + tp AS support FROM (SELECT {CELLS} FROM scored_view)"
        for kind, no, yes in (("macro", "1", "1"), ("weighted", "(tn + fp)", "(fn + tp)"))
    ),
    "rate_summary": f"SELECT {', '.join(r(e, n) for n, e in RATES)} FROM (SELECT {CELLS} FROM scored_view)",
    "metrics_by_group": _by_group("pitch_type", True),
    "metrics_by_zone": _by_group("zone", False),
    "top_pitch_types": f"{_by_group('pitch_type', True)} ORDER BY n DESC, pitch_type LIMIT 6",
    "rank_groups_by_auc": f"""SELECT *, row_number() OVER (ORDER BY auc DESC NULLS LAST, pitch_type) AS auc_rank
FROM ({_by_group("pitch_type", True)})""",
    "roc_curve": _roc(),
    "roc_curve_thin": _roc_thin(),
    "roc_curve_thin_by_zone": _roc_thin("zone"),
    "roc_by_group": _roc("pitch_type", f"WHERE pitch_type IN {TOP_TYPES}"),
    "calibration_curve": f"""SELECT {BIN} AS bin, count(*) AS n, {r("avg(score)", "mean_score")},
  {r("avg(is_whiff)", "share_positive")} FROM scored_view GROUP BY 1""",
    "score_histogram": f"""SELECT is_whiff, bin, {r("low + bin * width", "bin_start")}, count(score) AS count,
  {r("count(score) / (max(total) * max(width))", "density")} FROM (
  SELECT *, (high - low) / 30 AS width, unnest(range(30)) AS bin FROM (
    SELECT is_whiff, min(score) AS low, max(score) AS high, count(*) AS total FROM scored_view GROUP BY is_whiff)) e
LEFT JOIN (SELECT is_whiff, score, least(CAST(floor((score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) * 30) AS INT), 29) AS bin
  FROM scored_view WINDOW w AS (PARTITION BY is_whiff)) s USING (is_whiff, bin)
GROUP BY is_whiff, bin, low, width""",
    "residuals": f"SELECT game_pk, batter, pitcher, {r('score')}, {r('is_whiff - score', 'residual')} FROM scored_view",
    "evaluation_report": _report(),
    "evaluation_report_by_league": _report("league"),
    "evaluation_report_unscored": _report().replace("scored_view", "scored_some")
    + " UNION ALL SELECT 'n_unscored', CAST(count(*) AS DOUBLE) FROM scored_view WHERE pitcher % 7 = 0",
}
CTES["scored_held"] = f"""SELECT is_whiff, score, pitch_subtype, zone FROM (
  {_score("enh", "enh_held_frame", "enh_lists", extra="pitch_subtype, zone, ")})"""
CTES["scored_some"] = "SELECT * FROM scored_view WHERE pitcher % 7 <> 0"
CTES["l"] = _labels(
    f"(SELECT * FROM pitch_view WHERE league = 'major' AND game_date BETWEEN DATE '{S.TRAIN[0]}' AND DATE '{S.TRAIN[1]}')",
    ("batter", "pitcher"),
)


def _names(text: str) -> set[str]:
    return set(re.findall(r"[A-Za-z_]\w*", text)) & CTES.keys()


def with_steps(text: str) -> str:
    """``text`` with the steps it needs, in definition order of their dependencies."""
    ordered: list[str] = []

    def add(step: str) -> None:
        for inner in sorted(_names(CTES[step]) - {step}):
            if inner not in ordered:
                add(inner)
        if step not in ordered:
            ordered.append(step)

    for step in sorted(_names(text)):
        if step not in ordered:
            add(step)
    steps = ",\n".join(f"{s} AS ({CTES[s]})" for s in ordered)
    return f"WITH {steps}\n{text}" if steps else text


def oracle_sql() -> dict[str, str]:
    return {key: with_steps(text) for key, text in ORACLE.items()}
