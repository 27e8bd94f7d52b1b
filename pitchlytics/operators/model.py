"""Additive whiff models: formulas, posterior scoring and summaries.

A model is a list of terms. A term is a table of effects keyed by one to four index columns,
and the logit of a swing is the sum of its effects. Parameters of every model live in one
long table ``(term, k1, k2, k3, k4, draw_block, draws)``: unused keys are 0, ``draws`` holds
one block of posterior draws of that effect, and a point estimate is a single draw. Blocks
keep the arrays short (a few hundred draws), so no row grows with the length of the chains.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import settle

KEY_COLUMNS = ("k1", "k2", "k3", "k4")


@dataclass(frozen=True)
class Term:
    """One sum of the logit: its name, its index columns and its prior scale."""

    name: str
    keys: tuple[str, ...]
    scale: float = 1.0
    optional: bool = False


INTERCEPT = Term("intercept", ())

#: Index columns whose values grow in number with the data.
PLAYERS = ("batter_idx", "pitcher_idx")

# Terms of the three formulas, in formula order, with the prior scale of each.
ENHANCED = (
    Term("batter_league", ("batter_idx", "league_idx"), 0.3, optional=True),
    Term("batter_zone", ("batter_idx", "zone_idx"), 0.5),
    Term("batter_subtype", ("batter_idx", "pitch_subtype_idx"), 0.5),
    Term("batter_p_throws", ("batter_idx", "p_throws_idx"), 0.5),
    Term("pitcher_zone", ("pitcher_idx", "zone_idx"), 0.5),
    Term("pitcher_subtype", ("pitcher_idx", "pitch_subtype_idx"), 0.5),
    Term("pitcher_stand", ("pitcher_idx", "stand_idx"), 0.5),
    Term("pitcher_league", ("pitcher_idx", "league_idx"), 0.3, optional=True),
    Term("group_zone_subtype", ("batter_whiff_group_idx", "zone_num_idx", "pitch_subtype_idx"), 1.0),
    Term("group_count", ("batter_whiff_group_idx", "count_bucket_idx"), 0.5, optional=True),
)
HIERARCHICAL = (
    Term("batter_group_league", ("whiff_group_6_idx", "league_idx")),
    Term("batter_league", ("batter_idx", "league_idx")),
    Term("pitcher_group_league", ("pitcher_whiff_group_6_idx", "league_idx")),
    Term("pitcher_league", ("pitcher_idx", "league_idx")),
    Term("batter_group_zone_subtype", ("whiff_group_6_idx", "zone_idx", "pitch_subtype_idx")),
    Term("batter_zone_subtype", ("batter_idx", "zone_idx", "pitch_subtype_idx")),
    Term("batter_p_throws", ("batter_idx", "p_throws_idx")),
    Term("pitcher_group_zone_subtype", ("pitcher_whiff_group_6_idx", "zone_idx", "pitch_subtype_idx")),
    Term("pitcher_zone_subtype", ("pitcher_idx", "zone_idx", "pitch_subtype_idx")),
    Term("pitcher_stand", ("pitcher_idx", "stand_idx")),
    Term("zone_num_subtype", ("zone_num_idx", "pitch_subtype_idx")),
    Term(
        "group_group_zone_subtype",
        ("whiff_group_6_idx", "pitcher_whiff_group_6_idx", "zone_idx", "pitch_subtype_idx"),
    ),
)
TWO_WAY = (
    Term("batter_zone", ("batter_idx", "zone_idx")),
    Term("batter_subtype", ("batter_idx", "pitch_subtype_idx")),
    Term("batter_p_throws", ("batter_idx", "p_throws_idx")),
    Term("batter_count", ("batter_idx", "count_bucket_idx")),
    Term("pitcher_zone", ("pitcher_idx", "zone_idx")),
    Term("pitcher_subtype", ("pitcher_idx", "pitch_subtype_idx")),
    Term("pitcher_stand", ("pitcher_idx", "stand_idx")),
    Term("pitcher_count", ("pitcher_idx", "count_bucket_idx")),
)


def key_columns(terms: Iterable[Term]) -> list[str]:
    """Index columns a formula needs, without repeats."""
    return list(dict.fromkeys(k for t in terms for k in t.keys))


def without(terms: Sequence[Term], missing: Iterable[str]) -> tuple[Term, ...]:
    """The formula without some of its optional terms; leaving out any other term raises."""
    missing = set(missing)
    for t in terms:
        if t.name in missing and not t.optional:
            raise ValueError(f"term {t.name} is not optional")
    return tuple(t for t in terms if t.name not in missing)


# --- parameters -----------------------------------------------------------------------


def effect_draws(offsets: DataFrame, sigmas: DataFrame) -> DataFrame:
    """Effects from standardised offsets: each draw of an offset times the draw of its
    term's scale. ``offsets`` has the parameter columns, ``sigmas`` ``(term, draw_block, draws)``.

    ``sigmas`` is bounded by the formula (a dozen terms times the draws, under a megabyte for
    8,000 draws), so it is broadcast: one term can hold most of the offsets."""
    scale = sigmas.select("term", "draw_block", F.col("draws").alias("_scale"))
    return offsets.join(F.broadcast(scale), ["term", "draw_block"]).select(
        "term",
        *KEY_COLUMNS,
        "draw_block",
        F.zip_with("draws", "_scale", lambda x, s: x * s).alias("draws"),
    )


def effects_of(params: DataFrame, term: Term, name: str) -> DataFrame:
    """The draws of one term, keyed by its index columns."""
    keys = [F.col(k).alias(c) for k, c in zip(KEY_COLUMNS, term.keys)]
    return params.where(F.col("term") == term.name).select(*keys, "draw_block", F.col("draws").alias(name))


def met_by_key(table: DataFrame, keys: Iterable[str]) -> DataFrame:
    """A table to be joined on ``keys``: shuffled if they name a player, so that it never comes to
    the driver to be broadcast. Its file size, all that the planner knows, says little of draws,
    which may take far more in memory. Tables of levels only are left to the planner."""
    return table.hint("merge") if any(k in PLAYERS for k in keys) else table


def gather_effect(df: DataFrame, params: DataFrame, term: Term) -> DataFrame:
    """Each row with the draws of its effect, one row per block, NULL for unknown keys."""
    return df.join(met_by_key(effects_of(params, term, term.name), term.keys), list(term.keys), "left")


def _added(columns: Sequence[str]) -> Column:
    """Position-wise sum of array columns in one pass, NULL when one of them is."""
    first, *rest = (F.col(c) for c in columns)
    if not rest:
        return first
    known = reduce(lambda a, b: a & b, (c.isNotNull() for c in (first, *rest)))
    return F.when(known, F.transform(first, lambda x, i: reduce(lambda a, c: a + c[i], rest, x)))


# --- scoring --------------------------------------------------------------------------


def _parts(terms: Sequence[Term]) -> list[list[Term]]:
    """Terms that share a player are summed per player first, the others together and last."""
    parts: dict[str, list[Term]] = {"batter_idx": [], "pitcher_idx": [], "groups": []}
    for t in terms:
        parts[t.keys[0] if t.keys[0] in parts else "groups"].append(t)
    return [part for part in parts.values() if part]


def player_effects(params: DataFrame, part: Sequence[Term]) -> DataFrame:
    """One row per player and block with the draws of all the player's effects, a map column per
    term keyed by the levels beside the player, which bound its length."""
    player = part[0].keys[0]

    def effects(t: Term) -> Column:
        pair = F.struct(_levels(KEY_COLUMNS[1:len(t.keys)]).alias("level"), "draws")
        return F.map_from_entries(F.collect_list(F.when(F.col("term") == t.name, pair))).alias(f"_{t.name}")

    own = params.where(F.col("term").isin(*(t.name for t in part)))
    return own.groupBy(F.col(KEY_COLUMNS[0]).alias(player), "draw_block").agg(*(effects(t) for t in part))


def _levels(columns: Sequence[str]) -> Column:
    """The key of an effect beside its player, NULL when a level is."""
    known = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in columns), F.lit(True))
    return F.when(known, F.struct(*(F.col(c).cast("long").alias(k) for k, c in zip(KEY_COLUMNS[1:], columns))) if columns else F.lit(0))


def score(frame: DataFrame, params: DataFrame, terms: Sequence[Term], name: str = "score") -> DataFrame:
    """Posterior mean whiff probability of each row: the mean over draws of the logistic of
    the summed effects. NULL where a parameter is missing.

    Swings are collapsed to distinct index combinations first. A cell meets all effects of its
    batter in one row per block, then all of its pitcher, and adds up as it goes, so draws cross
    the network once per player and one array at most goes with a cell, once. The groups, which
    levels bound and not players, are summed on their own distinct keys and settled, so that the
    planner knows their size; they come last. The intercept lies beside the last effects, so no
    cell is joined on its block alone. Only (sum, count) leaves a block."""
    keys = key_columns(terms)
    cells = settle(frame.select(*keys).distinct(), "cells")
    # As long as the chains and no longer, whatever the number of players.
    intercept = settle(effects_of(params, INTERCEPT, "_intercept"), "intercept")
    blocks = intercept.agg(F.sort_array(F.collect_list("draw_block"))).scalar()
    of_block = intercept.agg(F.map_from_entries(F.collect_list(F.struct("draw_block", "_intercept")))).scalar()

    scored = cells.withColumn("draw_block", F.explode(blocks))
    parts = _parts(terms)
    for i, part in enumerate(parts):
        own, last, columns = part[0].keys[0] in PLAYERS, part is parts[-1], [f"_{t.name}" for t in part]
        part_keys = part[0].keys[:1] if own else key_columns(part)
        if own:
            summed = player_effects(params, part)
        else:
            summed = cells.select(*part_keys).distinct().withColumn("draw_block", F.explode(blocks))
            for t in part:
                summed = summed.join(met_by_key(effects_of(params, t, f"_{t.name}"), t.keys), [*t.keys, "draw_block"], "left")
        if last:
            summed = summed.withColumn("_intercept", F.try_element_at(of_block, F.col("draw_block"))).withColumn("_draws", F.size("_intercept"))
            columns = ["_intercept", *columns]
        if not own:
            summed = settle(summed.select(*part_keys, "draw_block", *(["_draws"] if last else []), _added(columns).alias(f"_part{i}")), "part")
        scored = scored.join(met_by_key(summed, part_keys), [*part_keys, "draw_block"], "left")
        if own:
            found = {f"_{t.name}": F.try_element_at(f"_{t.name}", _levels(t.keys[1:])) for t in part}
            scored = scored.withColumns(found).withColumn(f"_part{i}", _added(columns)).drop(*columns)
        if i > 0:
            scored = scored.withColumn(f"_part{i}", _added([f"_part{i - 1}", f"_part{i}"])).drop(f"_part{i - 1}")

    likely = F.aggregate(f"_part{len(parts) - 1}", F.lit(0.0), lambda total, logit: total + 1.0 / (1.0 + F.exp(-logit)))
    probabilities = (
        scored.select(*keys, likely.alias("_likely"), "_draws")
        .groupBy(*keys)
        .agg(
            F.when(F.count("_likely") == F.count(F.lit(1)), F.sum("_likely") / F.sum("_draws")).alias(name)
        )
    )
    return frame.join(met_by_key(probabilities, keys), keys, "left")


def score_enhanced(frame: DataFrame, params: DataFrame, missing: Iterable[str] = ()) -> DataFrame:
    return score(frame, params, without(ENHANCED, missing))


def score_hierarchical(frame: DataFrame, params: DataFrame) -> DataFrame:
    return score(frame, params, HIERARCHICAL)


def score_2way(frame: DataFrame, params: DataFrame) -> DataFrame:
    return score(frame, params, TWO_WAY)


# --- summaries ------------------------------------------------------------------------


def long_draws(params: DataFrame, draws: int, block: int) -> DataFrame:
    """One row per draw of a parameter table with ``draws`` draws a chain, ``block`` in a row."""
    at = F.col("draw_block") * block + F.col("pos")
    flat = params.select("term", *KEY_COLUMNS, "draw_block", F.posexplode("draws").alias("pos", "value"))
    return flat.select("term", *KEY_COLUMNS, F.floor(at / draws).alias("chain"), (at % draws).alias("draw"), "value")


def posterior_summary(draws: DataFrame, by: Sequence[str] = ("param",), prob: float = 0.94) -> DataFrame:
    """Mean, standard deviation, narrowest interval holding ``prob`` of the draws and split
    R-hat per parameter. ``draws`` is long: ``(*by, chain, draw, value)``.

    The interval spans ``floor(prob * n)`` steps of the sorted draws; the lowest one wins a
    tie. R-hat compares the halves of every chain, an odd middle draw is left out. The draws
    of a parameter, a number fixed by the sampler, are gathered once into an array."""
    by = list(by)
    kept = draws.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("chain", "draw", "value"))).alias("_draws"))
    chains = F.array_distinct(F.transform("_draws", lambda x: x["chain"]))
    values_of = lambda chain: F.transform(F.filter("_draws", lambda x: x["chain"] == chain), lambda x: x["value"])
    return _summarised(
        kept.select(*by, F.transform("_draws", lambda x: x["value"]).alias("_values"), F.transform(chains, values_of).alias("_chains")), by, prob)


def summary_of_blocks(params: DataFrame, draws: int, prob: float = 0.94) -> DataFrame:
    """``posterior_summary`` of a parameter table with ``draws`` draws a chain.

    The draws stay in their blocks on the way: a row travels per block, blocks of a parameter
    are laid end to end in order, and chains are slices of the whole. A last chain that is cut
    short counts as it is."""
    by = ["term", *KEY_COLUMNS]
    blocks = F.array_sort(F.collect_list(F.struct("draw_block", "draws")))
    kept = params.groupBy(*by).agg(blocks.alias("_blocks")).select(*by, F.flatten("_blocks.draws").alias("_values"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("_values"), F.lit(1)), F.lit(draws))
    chains = F.transform(starts, lambda at: F.slice("_values", at, draws))
    return _summarised(kept.withColumn("_chains", chains), by, prob)


def _summarised(kept: DataFrame, by: Sequence[str], prob: float) -> DataFrame:
    """Summary of the arrays ``_values`` (all draws) and ``_chains`` (those of each chain)."""
    kept = kept.withColumn("_all", F.array_sort("_values"))
    n = F.size("_all")
    span = F.floor(F.lit(prob) * n).cast("int")
    # Intervals by their lower end: the draw that is the span above less the draw itself.
    widths = F.zip_with(F.slice("_all", span + 1, n - span), F.slice("_all", F.lit(1), n - span), lambda high, low: high - low)

    def halves_of(chain: Column) -> Column:
        half = F.floor(F.size(chain) / 2).cast("int")
        return F.array(F.slice(chain, F.lit(1), half), F.slice(chain, F.size(chain) - half + 1, half))

    halves = F.filter(F.flatten(F.transform("_chains", halves_of)), lambda h: F.size(h) > 0)
    # A projection of its own for each array, so that none is computed once per use.
    kept = kept.withColumns({"_widths": widths, "_halves": halves})
    kept = kept.withColumns({
        "_low": F.array_position("_widths", F.array_min("_widths")).cast("int"), "_span": span,
        "_means": F.transform("_halves", _mean), "_spreads": F.filter(F.transform("_halves", _variance), lambda v: v.isNotNull())})
    kept = kept.withColumns({"_within": _mean(F.col("_spreads")), "_between": _variance(F.col("_means"))})
    length = F.array_max(F.transform("_halves", F.size)).cast("double")
    return kept.select(
        *by,
        _mean(F.col("_all")).alias("mean"),
        F.sqrt(_variance(F.col("_all"))).alias("sd"),
        F.get("_all", F.col("_low") - 1).alias("hdi_low"),
        F.get("_all", F.col("_low") + F.col("_span") - 1).alias("hdi_high"),
        F.sqrt(F.try_divide((length - 1) / length * F.col("_within") + F.col("_between"), F.col("_within"))).alias("r_hat"),
    )


def _mean(values: Column) -> Column:
    """Mean of an array, NULL of an empty one."""
    return F.try_divide(F.aggregate(values, F.lit(0.0), lambda total, x: total + x), F.size(values))


def _variance(values: Column) -> Column:
    """Sample variance of an array, NULL below two values."""
    # The mean is bound once; written into the sum it would be computed for every value.
    squares = F.transform(
        F.array(_mean(values)), lambda middle: F.aggregate(values, F.lit(0.0), lambda total, x: total + (x - middle) * (x - middle)))
    return F.when(F.size(values) > 1, F.get(squares, F.lit(0)) / (F.size(values) - 1))
