"""Column expressions on one pitch: batted ball, strike zone, pitch type, count."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Pitch type code, bucket, subtype.
PITCH_CODES = (
    ("FF", "Fastball", "Fastball"),
    ("FA", "Fastball", "Fastball"),
    ("SI", "Fastball", "Sinker"),
    ("FT", "Fastball", "Sinker"),
    ("FC", "Fastball", "Cutter"),
    ("SL", "Breaking Ball", "Slider"),
    ("ST", "Breaking Ball", "Slider"),
    ("SV", "Breaking Ball", "Curveball"),
    ("CU", "Breaking Ball", "Curveball"),
    ("KC", "Breaking Ball", "Curveball"),
    ("CS", "Breaking Ball", "Curveball"),
    ("CH", "Off-speed", "Changeup"),
    ("FS", "Off-speed", "Splitter"),
    ("FO", "Off-speed", "Splitter"),
    ("SC", "Other", "Other"),
    ("KN", "Other", "Other"),
    ("EP", "Other", "Other"),
    ("UN", "Other", "Other"),
    ("XX", "Other", "Other"),
    ("PO", "Other", "Other"),
)

# Descriptions that count as a swing; the first two are whiffs.
SWINGS = (
    "swinging_strike", "swinging_strike_blocked", "foul", "hit_into_play", "foul_tip",
    "hit_into_play_no_out", "hit_into_play_score", "foul_bunt",
)
WHIFFS = SWINGS[:2]

# Counts (balls-strikes) of each bucket. Full counts (3-2) are at risk, in the
# strict variant ahead.
NEUTRAL = ("0-0", "1-1", "0-1", "1-0")
AT_RISK = ("0-2", "1-2", "2-2")
AHEAD = ("2-0", "2-1", "3-1")
FULL_COUNT = "3-2"

# The zone numbers with a place in the 13-zone grid.
ZONES = (1, 2, 3, 4, 5, 6, 7, 8, 9, 11, 12, 13, 14)

# Origin of the hit coordinates, weight of the hit angle, power threshold.
HOME_X, HOME_Y = 125.42, 198.27
ANGLE_WEIGHT = 0.569
BLAST_ABOVE = 0.3

# Half plate width, slack below the zone, reference zone bottom and top (feet).
HALF_PLATE = 10 / 12
LOW_SLACK = 3 / 12
REF_BOT, REF_TOP = 1.69, 3.5


def hit_angle(hc_x="hc_x", hc_y="hc_y") -> Column:
    """Spray angle of a batted ball in radians; NULL level with home plate."""
    depth = F.lit(HOME_Y) - F.col(hc_y)
    return F.when(depth != 0, F.atan((F.col(hc_x) - HOME_X) / depth))


def expected_iso(ba="estimated_ba_using_speedangle", slg="estimated_slg_using_speedangle") -> Column:
    return F.col(slg) - F.col(ba)


def ha_factor(phi="phi") -> Column:
    """Weight of the hit angle, clamped to one radian either way."""
    # greatest/least skip NULLs, so the guard keeps an unknown angle unknown
    clamped = F.greatest(F.least(F.col(phi), F.lit(1.0)), F.lit(-1.0))
    return F.when(F.col(phi).isNotNull(), ANGLE_WEIGHT * F.pow(clamped, F.lit(2.0)) + ANGLE_WEIGHT)


def ha_adj_xiso(iso="estimated_iso_using_speedangle", factor="HA_factor") -> Column:
    return F.col(iso) * F.col(factor)


def blast_flag(xiso="HA_Adj_estimated_xISO") -> Column:
    return F.when(F.col(xiso).isNotNull(), (F.col(xiso) > BLAST_ABOVE).cast("int"))


def zone_flag(plate_x="plate_x", plate_z="plate_z", sz_top="sz_top", sz_bot="sz_bot") -> Column:
    """1 inside the strike zone, 0 outside or where the zone height is unknown, NULL where
    the pitch location is unknown."""
    x, z, top, bot = (F.col(c) for c in (plate_x, plate_z, sz_top, sz_bot))
    low = bot - LOW_SLACK - (bot - REF_BOT) / 4
    high = top - (top - REF_TOP) / 3
    inside = x.between(-HALF_PLATE, HALF_PLATE) & z.between(low, high)
    return F.when(x.isNotNull() & z.isNotNull(), F.coalesce(inside, F.lit(False)).cast("int"))


def _by_code(pitch_type: str, position: int) -> Column:
    codes_of: dict[str, list[str]] = {}
    for row in PITCH_CODES:
        codes_of.setdefault(row[position], []).append(row[0])
    out = None
    for value, codes in codes_of.items():
        hit = F.col(pitch_type).isin(codes)
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out


def pitch_bucket(pitch_type="pitch_type") -> Column:
    return _by_code(pitch_type, 1)


def pitch_subtype(pitch_type="pitch_type") -> Column:
    return _by_code(pitch_type, 2)


def flip_name(name="player_name") -> Column:
    """'Last, First' to 'First Last'; anything after a second comma is dropped."""
    c = F.col(name)
    given = F.ltrim(F.split_part(c, F.lit(","), F.lit(2)))
    family = F.split_part(c, F.lit(","), F.lit(1))
    return F.when(c.contains(","), F.concat(given, F.lit(" "), family)).otherwise(c)


def is_swing(description="description") -> Column:
    return F.col(description).isin(*SWINGS)


def whiff_flag(description="description") -> Column:
    return F.coalesce(F.col(description).isin(*WHIFFS), F.lit(False)).cast("int")


def _count(balls: str, strikes: str) -> Column:
    return F.concat_ws("-", F.col(balls).cast("string"), F.col(strikes).cast("string"))


def count_bucket(balls="balls", strikes="strikes") -> Column:
    """Pitch count as neutral, at_risk or ahead; counts outside the lists are neutral."""
    c = _count(balls, strikes)
    return F.when(c.isin(*AT_RISK, FULL_COUNT), "at_risk").when(c.isin(*AHEAD), "ahead").otherwise("neutral")


def count_bucket_strict(balls="balls", strikes="strikes") -> Column:
    """As ``count_bucket`` with the full count ahead and unknown counts NULL."""
    c = _count(balls, strikes)
    return (
        F.when(c.isin(*NEUTRAL), "neutral")
        .when(c.isin(*AT_RISK), "at_risk")
        .when(c.isin(*AHEAD, FULL_COUNT), "ahead")
    )


def zone_num_index(zone="zone") -> Column:
    """Zones 1-9 and 11-14 as 0-12, NULL for other numbers."""
    z = F.col(zone)
    return F.when(z.between(1, 9), z - 1).when(z.between(11, 14), z - 2)
