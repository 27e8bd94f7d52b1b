"""Fit of additive whiff models: effects, their scales, and draws around them.

The terms of a formula fall into blocks: those of a batter, those of a pitcher, and those of the
groups with the intercept. Given the rest of the logit, the effects of one player depend on that
player's swings only, so a block is a small linear system per player: Spark sums weights and
residuals per combination of a block's keys, gathers the combinations of a player (as many as its
levels have, whatever the swings), and tasks solve the systems. The driver sees of a sweep one row
per term and the effects of the groups, which levels bound and not players. No vector of all
effects exists anywhere.

A fit sweeps over cells that were packed once, by batter and by pitcher, into pieces of about
``PIECE`` cells in arrays. A piece finds sums, solves its players and sends the new sum of each cell
to the piece that holds the same cell for the other player. Both sides keep the cells of a pair of
pieces in the same order, so four bytes travel per cell, without keys, and no join is left. The
piece of the last player adds up what the groups need next.

Scales are learned beside the effects. A scale's step is the mode of a half-normal prior given
the squared effects and their variances, summed over the effects that have data; steps are
set by the secant of the last two. A fit rests when no effect has a slope above ``SLOPE``
standard errors of its swings and one more step moves no scale by more than ``REST``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import settle
from .model import (
    ENHANCED, HIERARCHICAL, INTERCEPT, KEY_COLUMNS, PLAYERS, Term, effects_of, key_columns, met_by_key, score, without,
)

SLOPE, REST = 0.03, 0.015
#: Logits that a step may span before the next is kept from overshooting.
LONG = 2.0
#: Blocks trade a common shift (of the intercept against all players, say) in small steps, so after
#: the first ``PLAIN`` sweeps each goes ``STRETCH`` times as far as its solution.
STRETCH, PLAIN = 1.65, 3
#: A scale never falls below this share of its prior scale, where its effects count for nothing.
LEAST = 0.01
#: Numbers in the systems that a task holds at a time.
ROOM = 1 << 22
#: Cells in a piece, about; a player with more has several pieces.
PIECE = 1 << 16


def scale_name(term: str) -> str:
    return f"sigma_{term}"


@dataclass(frozen=True)
class Block:
    """Terms that are solved together, per value of ``who`` or all at once."""

    name: str
    terms: tuple[Term, ...]
    who: str | None

    @property
    def keys(self) -> list[str]:
        return key_columns(self.terms)

    @property
    def own_keys(self) -> list[str]:
        return [k for k in self.keys if k != self.who]


def blocks_of(terms: Sequence[Term]) -> list[Block]:
    """Groups first, so that players start from what their groups explain."""
    found: dict[str, list[Term]] = {"groups": [INTERCEPT]}
    for t in terms:
        found.setdefault(t.keys[0] if t.keys[0] in PLAYERS else "groups", []).append(t)
    return [Block(name, tuple(ts), name if name in PLAYERS else None) for name, ts in found.items()]


class Layout:
    """Where the effects of a block stand in a player's vector."""

    def __init__(self, block: Block, size: dict[str, int]):
        self.block, self.size = block, size
        self.starts, self.width = [], 0
        for t in block.terms:
            self.starts.append(self.width)
            self.width += math.prod(size[k] for k in self._own(t))

    def _own(self, term: Term) -> list[str]:
        return [k for k in term.keys if k != self.block.who]

    def places(self, columns: dict[str, np.ndarray], n: int) -> list[np.ndarray]:
        """Per term the place of each combination's effect."""
        out = []
        for t, start in zip(self.block.terms, self.starts, strict=True):
            code = np.zeros(n, np.int64)
            for k in self._own(t):
                code = code * self.size[k] + columns[k]
            out.append(start + code)
        return out

    @property
    def codes(self) -> int:
        """Number of combinations of the block's keys beside ``who``."""
        return math.prod(self.size[k] for k in self.block.own_keys)

    def code_column(self) -> Column:
        """A row's combination of the block's keys beside ``who`` as one number."""
        return reduce(lambda code, k: code * self.size[k] + F.col(k), self.block.own_keys, F.lit(0).cast("long"))

    def keys_of(self, code: np.ndarray) -> dict[str, np.ndarray]:
        """The keys of ``code_column``."""
        code, out = code.astype(np.int64), {}
        for k in reversed(self.block.own_keys):
            code, out[k] = np.divmod(code, self.size[k])
        return out

    def place_columns(self) -> list[Column]:
        """``places`` of a row with the block's keys."""
        return [
            reduce(lambda code, k: code * self.size[k] + F.col(k), self._own(t), F.lit(0)) + start
            for t, start in zip(self.block.terms, self.starts, strict=True)]

    def precision(self, scales: dict[str, float]) -> np.ndarray:
        """Inverse squared scale of each effect; the intercept has none."""
        ends = [*self.starts[1:], self.width]
        per_term = [0.0 if t.name == INTERCEPT.name else scales[t.name] ** -2 for t in self.block.terms]
        return np.repeat(per_term, np.subtract(ends, self.starts))

    def _by_term(self, place: Column, value: Callable[[Term, Column], Column]) -> Column:
        first, *later = zip(self.block.terms, self.starts, strict=True)
        out = value(first[0], place - first[1])
        for t, start in later:
            out = F.when(place >= start, value(t, place - start)).otherwise(out)
        return out

    def names(self, place: str = "place", who: str = "who") -> list[Column]:
        """``term`` and keys of a place."""

        def key(i: int) -> Callable[[Term, Column], Column]:
            def value(t: Term, code: Column) -> Column:
                if i >= len(t.keys):
                    return F.lit(0)
                if t.keys[i] == self.block.who:
                    return F.col(who)
                below = math.prod(self.size[k] for k in t.keys[i + 1:])
                return F.floor(code / below) % self.size[t.keys[i]]

            return value

        at = F.col(place)
        return [self._by_term(at, lambda t, _: F.lit(t.name)).alias("term"),
                *(self._by_term(at, key(i)).cast("int").alias(k) for i, k in enumerate(KEY_COLUMNS))]


# --- sums per block ---------------------------------------------------------------------


def _contributions(params: DataFrame, cells: DataFrame, block: Block) -> DataFrame:
    """Sum of the block's effects per combination of its keys, from a parameter table."""
    out = cells.select(*block.keys).distinct() if block.keys else cells.sparkSession.range(1).select()
    total = F.lit(0.0)
    for t in block.terms:
        effect = effects_of(params, t, f"_{t.name}").drop("draw_block")
        if t.keys:
            out = out.join(met_by_key(effect, t.keys), list(t.keys), "left")
        else:
            out = out.withColumn(f"_{t.name}", effect.scalar())
        total = total + F.coalesce(F.col(f"_{t.name}")[0], F.lit(0.0))
    return settle(out.select(*block.keys, total.alias(f"_{block.name}")), "contributions")


#: Sums of a block's effects: a table by its keys, the same for all cells, or a value of a cell's keys.
Part = DataFrame | Column | float


def _pooled(cells: DataFrame, block: Block, parts: dict[Block, Part], bounded: bool) -> DataFrame:
    """Per ``who`` its combinations of keys, each with the weight ``a``, the residual ``s``, the
    present sum of the block's effects ``b`` and the swings ``n``.

    The weight is the curvature of the likelihood, or, ``bounded``, that of a parabola below it
    which meets it at the present logit: steps with it never overshoot."""
    joined = cells
    # The block's own sums last, so that its cells lie by its keys when they are summed.
    for other, part in sorted(parts.items(), key=lambda x: x[0] == block):
        if isinstance(part, float):
            joined = joined.withColumn(f"_{other.name}", F.lit(part))
        elif isinstance(part, Column):
            joined = joined.withColumn(f"_{other.name}", part)
        elif other.keys:
            joined = joined.join(met_by_key(part, other.keys), other.keys)
        else:
            joined = joined.withColumn(f"_{other.name}", part.scalar())
    logit = reduce(lambda x, y: x + y, (F.col(f"_{other.name}") for other in parts))
    joined = joined.withColumn("_logit", logit).withColumn("_p", 1 / (1 + F.exp(-F.col("_logit"))))
    if bounded:
        size = F.greatest(F.abs("_logit"), F.lit(1e-6))
        curvature = F.tanh(size / 2) / (2 * size)
    else:
        curvature = F.col("_p") * (1 - F.col("_p"))
    summed = joined.groupBy(*block.keys).agg(
        F.sum(F.col("n") * curvature).alias("a"), F.sum(F.col("whiffs") - F.col("n") * F.col("_p")).alias("s"),
        F.first(f"_{block.name}").alias("b"), F.sum("n").cast("double").alias("n"))
    who = F.col(block.who) if block.who else F.lit(0)
    combination = F.struct(*block.own_keys, "a", "s", "b", "n")
    return summed.groupBy(who.alias("who")).agg(F.collect_list(combination).alias("cells"))


@dataclass
class System:
    """The normal equations of some players."""

    who: pa.Array
    lists: pa.ListArray
    columns: dict[str, np.ndarray]
    owner: np.ndarray
    places: list[np.ndarray]
    matrix: np.ndarray
    effects: np.ndarray
    before: pa.ListArray | None


def _equations(
    layout: Layout, precision: np.ndarray, rows: int, owner: np.ndarray, places: list[np.ndarray], columns: dict[str, np.ndarray],
) -> tuple[np.ndarray, np.ndarray]:
    """The matrix of each of ``rows`` players and the effects that solve its system."""
    width = layout.width
    matrix, right = np.zeros((rows, width, width)), np.zeros((rows, width))
    matrix[:, np.arange(width), np.arange(width)] = precision
    target = columns["s"] + columns["a"] * columns["b"]
    for one in places:
        at = owner * width + one
        np.add.at(right.reshape(-1), at, target)
        for two in places:
            np.add.at(matrix.reshape(-1), at * width + two, columns["a"])
    return matrix, np.linalg.solve(matrix, right[..., None])[..., 0]


@dataclass
class Move:
    """How the players of some systems move: their new effects, the new sum of each combination,
    and what ``_steps`` wants of each player."""

    effects: np.ndarray
    sums: np.ndarray
    slope: np.ndarray
    jump: np.ndarray
    k: np.ndarray
    s: np.ndarray


def _moved(
    layout: Layout, owner: np.ndarray, places: list[np.ndarray], columns: dict[str, np.ndarray], matrix: np.ndarray, effects: np.ndarray,
    old: np.ndarray | None, stretch: float,
) -> Move:
    counts, slope = np.zeros(effects.shape), np.full(len(effects), np.inf)
    for place in places:
        np.add.at(counts, (owner, place), columns["n"])
    if old is not None:
        # The matrix times the step is the slope of the likelihood where the step starts.
        slopes = np.abs((matrix @ (effects - old)[..., None])[..., 0])
        slope = np.where(counts > 0, slopes / np.sqrt(np.maximum(counts, 1)), 0.0).max(axis=1)
        effects = old + stretch * (effects - old)
    sums = sum(effects[owner, place] for place in places)
    jump = np.zeros(len(effects))
    np.maximum.at(jump, owner, np.abs(sums - columns["b"]))
    seen = counts > 0
    squares = effects**2 + np.diagonal(np.linalg.inv(matrix), axis1=1, axis2=2)
    k, s = (np.add.reduceat(v, layout.starts, axis=1) for v in (seen.astype(float), np.where(seen, squares, 0.0)))
    return Move(effects, sums, slope, jump, k, s)


def _systems(batch: pa.RecordBatch, layout: Layout, precision: np.ndarray, room: int) -> Iterator[System]:
    for start in range(0, batch.num_rows, max(1, room)):
        piece = batch.slice(start, max(1, room))
        lists, rows = piece.column("cells"), piece.num_rows
        flat = lists.flatten()
        columns = {f.name: flat.field(f.name).to_numpy(zero_copy_only=False) for f in flat.type}
        owner = np.repeat(np.arange(rows), lists.value_lengths().to_numpy(zero_copy_only=False))
        places = layout.places(columns, len(owner))
        matrix, effects = _equations(layout, precision, rows, owner, places, columns)
        before = piece.column("before") if "before" in piece.schema.names else None
        yield System(piece.column("who"), lists, columns, owner, places, matrix, effects, before)


def _double_lists(rows: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), rows.shape[1]).cast(pa.list_(pa.float64()))


def _solved(
    pooled: DataFrame, layout: Layout, scales: dict[str, float], before: DataFrame | None = None, stretch: float = 1.0,
) -> DataFrame:
    """Per ``who`` its combinations with the new sums of effects, the effects in the order of the
    layout, the steepest slope before the step in standard errors of the swings, how far the
    farthest sum has moved in logits, and per term the number of effects with data and the sum of their squares and variances. Effects of
    the groups go ``stretch`` times as far from those of the table ``before`` as the solution is."""
    precision, keys = layout.precision(scales), layout.block.own_keys
    first = before is None
    if not first:
        # One row of each: players go on from their last effects in the pieces.
        pooled = pooled.withColumn("before", before.select("effects").scalar())

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in _systems(batch, layout, precision, ROOM // layout.width**2):
                before = None if first else x.before.flatten().to_numpy().reshape(x.effects.shape)
                move = _moved(layout, x.owner, x.places, x.columns, x.matrix, x.effects, before, stretch)
                fields = [pa.array(x.columns[k], pa.int32()) for k in keys]
                sums = pa.StructArray.from_arrays([*fields, pa.array(move.sums)], [*keys, "b"])
                offsets = np.concatenate([[0], np.cumsum(np.bincount(x.owner, minlength=len(x.who)))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [x.who, pa.ListArray.from_arrays(pa.array(offsets), sums), _double_lists(move.effects), pa.array(move.slope),
                     pa.array(move.jump), _double_lists(move.k), _double_lists(move.s)],
                    ["who", "sums", "effects", "slope", "jump", "k", "s"])

    combination = ", ".join([*(f"{k}: int" for k in keys), "b: double"])
    schema = f"who int, sums array<struct<{combination}>>, effects array<double>, slope double, jump double, k array<double>, s array<double>"
    return pooled.mapInArrow(solve, schema)


def _sums_of(solved: DataFrame, layout: Layout) -> Column:
    """Sum of the groups' effects: one row, as long as the levels, looked up by place."""
    effects = solved.select("effects").scalar()
    return reduce(lambda x, y: x + y, (F.get(effects, place) for place in layout.place_columns()))


def _effects_in(solved: DataFrame, layout: Layout) -> DataFrame:
    """``(term, k1, k2, k3, k4, effect)`` of every combination of levels; without swings it is 0."""
    return solved.select("who", F.posexplode("effects").alias("place", "effect")).select(*layout.names(), "effect")


# --- pieces -----------------------------------------------------------------------------


#: What a parcel holds: a piece's cells, the effects of a part's players, the sums that a piece sends
#: to another, or what a piece adds up for the groups.
CELLS, EFFECTS, SENT, GROUPS = range(4)
#: Parcels of a part meet in one task. ``piece`` is where one belongs, ``src`` where it comes from.
PARCEL = "part int, kind int, piece int, src int, data array<binary>"
#: With what ``_steps`` wants, beside effects only.
SWEPT = f"{PARCEL}, slope double, jump double, k array<double>, s array<double>"
_PARCEL = pa.schema([*((c, pa.int32()) for c in ("part", "kind", "piece", "src")), ("data", pa.list_(pa.binary()))])
_SWEPT = pa.schema([*_PARCEL, *((c, pa.float64()) for c in ("slope", "jump")), *((c, pa.list_(pa.float64())) for c in ("k", "s"))])


def _stored(x: np.ndarray) -> bytes:
    return x.dtype.char.encode().ljust(8) + x.tobytes()


def _read(x: bytes) -> np.ndarray:
    return np.frombuffer(x, chr(x[0]), offset=8)


def _narrow(x: np.ndarray) -> np.ndarray:
    """Whole numbers from 0 in as few bytes as the largest takes."""
    return x.astype(np.min_scalar_type(x.max())) if x.size and x.dtype.kind in "iu" and x.min() >= 0 else x


@dataclass
class Piece:
    """Cells of some players, in the order of the pieces that hold them for the other player: the
    players, the combinations (whose, and the code of their keys), those of the groups, per cell
    the place of both, its swings and whiffs, and the other pieces with the cells shared with each."""

    who: np.ndarray
    owner: np.ndarray
    code: np.ndarray
    group_code: np.ndarray
    combination: np.ndarray
    group: np.ndarray
    n: np.ndarray
    whiffs: np.ndarray
    end_part: np.ndarray
    end: np.ndarray
    shared: np.ndarray


def _placed(cells: DataFrame, players: Sequence[Layout]) -> DataFrame:
    """``cells`` with the part and the piece of each player of theirs. A part is solved in one task. It is one
    piece with the cells of some players; one with more than a piece's cells is a part alone, of several pieces."""
    total, out = cells.count(), cells
    usual = max(1, -(-total // PIECE))
    for i, x in enumerate(players):
        who, placed = F.col(x.block.who), F.lit(None).cast("struct<part:int,piece:int>")
        # One row for every piece full of cells at most.
        large = cells.groupBy(who.alias("who")).count().where(F.col("count") > PIECE).collect()
        if large:
            known, first = [], usual
            for r in sorted(large):
                known += [F.lit(r["who"]), F.struct(F.lit(first).alias("part"), F.lit(-(-r["count"] // PIECE)).alias("pieces"))]
                first += -(-r["count"] // PIECE)
            own = F.try_element_at(F.create_map(*known), who)
            # By the whole key, so that a cell falls to the same piece in every run.
            piece = own["part"] + F.pmod(F.xxhash64(*cells.columns), own["pieces"]).cast("int")
            placed = F.when(own.isNotNull(), F.struct(own["part"].alias("part"), piece.alias("piece")))
        part = F.pmod(F.hash(who), F.lit(usual)).cast("int")
        placed = F.coalesce(placed, F.struct(part.alias("part"), part.alias("piece")))
        out = out.withColumn(f"_at{i}", placed)
    return out


def _packed(cells: DataFrame, groups: Layout, players: Sequence[Layout]) -> list[DataFrame]:
    """Per player block the parcels with the cells of its pieces."""
    if not players:
        return []
    placed = _placed(cells, players).select(
        *(F.col(f"_at{i}.{c}").alias(f"{c}{i}") for i in range(len(players)) for c in ("part", "piece")),
        *(F.col(x.block.who).alias(f"who{i}") for i, x in enumerate(players)), *(x.code_column().alias(f"code{i}") for i, x in enumerate(players)),
        groups.code_column().alias("code"), "n", "whiffs")
    # Both sides pack from the same rows, and each cell is asked for its pieces once.
    placed = settle(placed, "placed") if len(players) > 1 else placed
    key = [c for c in placed.columns if c.startswith(("who", "code"))]
    return [
        settle(placed.groupBy(f"part{i}", f"piece{i}").applyInArrow(_packer(x, key, i, 1 - i if len(players) > 1 else None), PARCEL), "pieces")
        for i, x in enumerate(players)]


def _packer(layout: Layout, key: Sequence[str], own: int, other: int | None) -> Callable[[pa.Table], pa.Table]:
    codes = layout.codes

    def pack(table: pa.Table) -> pa.Table:
        cells = {c: table.column(c).to_numpy() for c in table.column_names}
        # Cells with the same key may change places: they have the same sums.
        order = np.lexsort([cells[c] for c in key] + ([cells[f"piece{other}"]] if other is not None else []))
        cells = {c: v[order] for c, v in cells.items()}
        who, player = np.unique(cells[f"who{own}"], return_inverse=True)
        pairs, combination = np.unique(player * codes + cells[f"code{own}"], return_inverse=True)
        owner, code = np.divmod(pairs, codes)
        group_code, group = np.unique(cells["code"], return_inverse=True)
        none = np.zeros(0, np.int32)
        end, first, shared = np.unique(cells[f"piece{other}"], return_index=True, return_counts=True) if other is not None else (none,) * 3
        end_part = cells[f"part{other}"][first] if other is not None else none
        arrays = (who, owner, code, group_code, combination, group, cells["n"], cells["whiffs"], end_part, end, shared)
        piece = Piece(*map(_narrow, arrays))
        row = {"part": int(cells[f"part{own}"][0]), "kind": CELLS, "piece": int(cells[f"piece{own}"][0]), "data": [_stored(x) for x in vars(piece).values()]}
        return pa.Table.from_pylist([row], _PARCEL)

    return pack


def _curved(logit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rate, the curvature of the likelihood and that of the parabola of ``_pooled``."""
    with np.errstate(over="ignore"):
        p = 1 / (1 + np.exp(-logit))
    size = np.maximum(np.abs(logit), 1e-6)
    return p, p * (1 - p), np.tanh(size / 2) / (2 * size)


def _swept(
    packed: DataFrame, layout: Layout, groups: Layout, explained: np.ndarray, scales: dict[str, float], before: DataFrame | None,
    sent: DataFrame | None, stretch: float, bounded: bool, last: bool,
) -> DataFrame:
    """Parcels of a block's step: the effects of each part's players, the sums for the pieces of the other
    player, and, of the ``last`` block of a sweep, those for the groups. ``explained`` are the effects of the groups,
    ``before`` the block's own last step and ``sent`` that of the other player."""
    columns = [c.split()[0] for c in PARCEL.split(", ")]
    parcels = packed
    for df, kind in ((before, EFFECTS), (sent, SENT)):
        if df is not None:
            parcels = parcels.unionByName(df.where(F.col("kind") == kind).select(columns))
    precision, expected = layout.precision(scales), sent is not None
    group_sums = lambda x: sum(explained[place] for place in groups.places(groups.keys_of(x.group_code), len(x.group_code)))

    def sweep(table: pa.Table) -> pa.Table:
        pieces, old, arrived = {}, None, {}
        for r in table.to_pylist():
            data = [_read(x) for x in r["data"]]
            if r["kind"] == CELLS:
                pieces[r["piece"]] = Piece(*data)
            elif r["kind"] == EFFECTS:
                old = data[1].reshape(-1, layout.width)
            else:
                arrived[r["piece"], r["src"]] = data[0]
        pieces = dict(sorted(pieces.items()))
        who = next(iter(pieces.values())).who
        known = np.zeros((len(who), layout.width)) if old is None else old
        rest, sums, starts = {}, [], [0]
        for at, x in pieces.items():
            rest[at] = group_sums(x)[x.group]
            if expected:
                found = [arrived[at, src] for src in x.end.tolist()]
                if [len(v) for v in found] != x.shared.tolist():
                    raise RuntimeError("the pieces of a cell's players do not match")
                rest[at] = rest[at] + np.concatenate(found)
            owner, places, m = x.owner.astype(np.int64), layout.places(layout.keys_of(x.code), len(x.code)), len(x.code)
            b = sum(known[owner, place] for place in places)
            p, curvature, wide = _curved(rest[at] + b[x.combination])
            a, s, n = (np.bincount(x.combination, v, m) for v in (x.n * (wide if bounded else curvature), x.whiffs - x.n * p, x.n))
            sums.append((owner, places, {"a": a, "s": s, "b": b, "n": n}))
            starts.append(starts[-1] + m)
        # A player of several pieces is alone, and the equations add up what repeats.
        owner, places = np.concatenate([x[0] for x in sums]), [np.concatenate(v) for v in zip(*(x[1] for x in sums), strict=True)]
        columns = {c: np.concatenate([x[2][c] for x in sums]) for c in ("a", "s", "b", "n")}
        moves, room = [], max(1, ROOM // layout.width**2)
        for low in range(0, len(who), room):
            rows, cut = min(room, len(who) - low), slice(*np.searchsorted(owner, [low, low + room]))
            of = (owner[cut] - low, [x[cut] for x in places], {c: v[cut] for c, v in columns.items()})
            matrix, effects = _equations(layout, precision, rows, *of)
            moves.append(_moved(layout, *of, matrix, effects, None if old is None else old[low:low + rows], stretch))
        effects, new = np.concatenate([x.effects for x in moves]), np.concatenate([x.sums for x in moves])
        part = table.column("part")[0].as_py()
        out = [{
            "part": part, "kind": EFFECTS, "data": [_stored(who), _stored(effects)],
            "slope": max(x.slope.max() for x in moves), "jump": max(x.jump.max() for x in moves),
            "k": sum(x.k.sum(axis=0) for x in moves).tolist(), "s": sum(x.s.sum(axis=0) for x in moves).tolist()}]
        for (at, x), low, high in zip(pieces.items(), starts, starts[1:], strict=False):
            b = new[low:high][x.combination]
            ends = zip(x.end_part.tolist(), x.end.tolist(), np.split(b.astype(np.float32), np.cumsum(x.shared)[:-1]), strict=True) if len(x.end) else ()
            out += [{"part": p, "kind": SENT, "piece": end, "src": at, "data": [_stored(v)]} for p, end, v in ends]
            if last:
                p, *curvatures = _curved(rest[at] + b)
                found = [np.bincount(x.group, v, len(x.group_code)) for v in (*(x.n * v for v in curvatures), x.whiffs - x.n * p, x.n)]
                out.append({"part": part, "kind": GROUPS, "piece": at, "data": [_stored(v) for v in (x.group_code, *found, group_sums(x))]})
        return pa.Table.from_pylist(out, _SWEPT)

    return parcels.groupBy("part").applyInArrow(sweep, SWEPT)


def _sums_of_groups(swept: DataFrame, groups: Layout, bounded: bool) -> DataFrame:
    """What ``_pooled`` gives for the groups, from the parcels of a sweep's last block."""
    keys = groups.block.keys

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("data").to_pylist():
                code, curvature, wide, s, n, b = (_read(x) for x in data)
                columns = groups.keys_of(code)
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(columns[k], pa.int32()) for k in keys), *map(pa.array, (wide if bounded else curvature, s, b, n))], [*keys, "a", "s", "b", "n"])

    schema = ", ".join([*(f"{k} int" for k in keys), *(f"{c} double" for c in "asbn")])
    found = swept.where(F.col("kind") == GROUPS).select("data").mapInArrow(rows, schema)
    summed = found.groupBy(*keys).agg(F.sum("a").alias("a"), F.sum("s").alias("s"), F.first("b").alias("b"), F.sum("n").alias("n"))
    return summed.groupBy(F.lit(0).alias("who")).agg(F.collect_list(F.struct(*keys, "a", "s", "b", "n")).alias("cells"))


def _effects_of_pieces(swept: DataFrame, layout: Layout) -> DataFrame:
    """``(who, effects)`` of a step's players."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("data").to_pylist():
                who, effects = (_read(x) for x in data)
                yield pa.RecordBatch.from_arrays([pa.array(who, pa.int32()), _double_lists(effects.reshape(-1, layout.width))], ["who", "effects"])

    return swept.where(F.col("kind") == EFFECTS).select("data").mapInArrow(rows, "who int, effects array<double>")


@dataclass(frozen=True)
class Step:
    """What a sweep tells of a term: the steepest slope that its block started from, in standard
    errors, how far it went in logits, and the scale that the effects with data and their variances call for, with the prior scale of
    the term as that of a half-normal."""

    slope: float
    jump: float
    scale: float


def _steps(solved: dict[Block, DataFrame]) -> dict[str, Step]:
    parts = [
        df.where(F.col("slope").isNotNull()).select(F.lit(i).alias("block"), "slope", "jump", F.posexplode(F.arrays_zip("k", "s")).alias("nth", "x"))
        for i, df in enumerate(solved.values())]
    sums = reduce(DataFrame.unionByName, parts).groupBy("block", "nth").agg(
        F.sum("x.k").alias("k"), F.sum("x.s").alias("s"), F.max("slope").alias("slope"), F.max("jump").alias("jump"))
    out, blocks = {}, list(solved)
    for r in sums.collect():  # one row per term
        t = blocks[r["block"]].terms[r["nth"]]
        square = t.scale**2
        out[t.name] = Step(r["slope"], r["jump"], math.sqrt(square / 2 * (math.sqrt(r["k"] ** 2 + 4 * r["s"] / square) - r["k"])))
    return out


def _sizes(cells: DataFrame, keys: Sequence[str]) -> tuple[dict[str, int], float]:
    """Levels per key and the logit of the whiff rate."""
    top = cells.agg(*(F.max(k).alias(k) for k in keys), F.sum("n").alias("_n"), F.sum("whiffs").alias("_whiffs")).first()
    if not top["_n"]:
        raise ValueError("no swings to fit")
    rate = (top["_whiffs"] + 0.5) / (top["_n"] + 1)
    return {k: int(top[k]) + 1 for k in keys}, math.log(rate / (1 - rate))


def _kept(cells: DataFrame, terms: Sequence[Term]) -> DataFrame:
    return settle(cells.select(*(F.col(k).cast("int").alias(k) for k in key_columns(terms)), "n", "whiffs"), "cells")


def _lengthened(at: float, r: float, last: tuple[float, float] | None, near: bool) -> float:
    """A step of a fixed point in logs: the plain step ``r``; once the effects are near their place,
    the step to where the secant of the last two says that it rests, up to five times as long and,
    after a step too far, shorter."""
    times = 1.0
    if near and last is not None and at != last[0]:
        slope = (r - last[1]) / (at - last[0])
        times = min(5.0, max(0.2, -1 / slope)) if slope < 0 else 2.0
    return min(0.7, max(-0.7, r * times))


# --- fit ----------------------------------------------------------------------------------


def fit(cells: DataFrame, terms: Sequence[Term], learn: bool = True, max_sweeps: int = 200) -> DataFrame:
    """Maximum a posteriori effects as a parameter table with one draw, and a row ``sigma_<term>``
    for the scale of each term.

    ``cells`` are swing counts per key (``swing_cells``). Scales are learned, or stay at their prior
    values. The intercept has no prior. Every combination of a player's or a group's levels has
    an effect, 0 where there are no swings."""
    cells = _kept(cells, terms)
    size, start = _sizes(cells, key_columns(terms))
    groups, *players = [Layout(block, size) for block in blocks_of(terms)]
    packed = _packed(cells, groups, players)
    parts: dict[Block, Part] = {x.block: 0.0 for x in players} | {groups.block: start}
    scales, last, solved = {t.name: t.scale for t in terms}, {}, {}
    jump, held = math.inf, False
    for sweep in range(max_sweeps):
        # Long steps are kept from overshooting; near the end the true curvature is faster.
        bounded, stretch = jump > LONG, STRETCH if sweep >= PLAIN and jump <= 1 else 1.0
        if sweep and players:
            pooled = _sums_of_groups(solved[players[-1].block], groups, bounded)
        else:
            pooled = _pooled(cells, groups.block, parts, bounded)
        solved[groups.block] = settle(_solved(pooled, groups, scales, solved.get(groups.block), stretch), "solved")
        parts[groups.block] = _sums_of(solved[groups.block], groups)
        explained = np.array(solved[groups.block].first()["effects"]) if players else None
        for i, x in enumerate(players):
            # What the other player's pieces sent last: nothing at the start, none without another.
            sent = solved.get(players[1 - i].block) if len(players) > 1 else None
            solved[x.block] = settle(_swept(
                packed[i], x, groups, explained, scales, solved.get(x.block), sent, stretch, bounded, last=x is players[-1]), "solved")
        steps = _steps(solved)
        jump = max(x.jump for x in steps.values())
        slope = max(x.slope for x in steps.values())
        new, gap = {}, 0.0
        for t in terms if learn else ():
            at, least = math.log(scales[t.name]), math.log(LEAST * t.scale)
            r = math.log(steps[t.name].scale) - at
            gap = max(gap, 0.0 if r < 0 and at <= least else abs(r))
            new[t.name] = math.exp(max(least, at + _lengthened(at, r, last.get(t.name), slope < 1)))
            last[t.name] = (at, r)
        # Scales that rest stay where they are while the effects come to theirs.
        held = gap <= REST * (1.3 if held else 1)
        if held and slope <= SLOPE:
            break
        if learn and not held:
            scales = new
    else:
        raise RuntimeError(f"the fit did not rest after {max_sweeps} sweeps")
    rows = [(scale_name(t.name), scales[t.name]) for t in terms]
    sigmas = cells.sparkSession.createDataFrame(rows, "term string, effect double").select("term", *(F.lit(0).alias(k) for k in KEY_COLUMNS), "effect")
    tables = [(solved[groups.block], groups), *((_effects_of_pieces(solved[x.block], x), x) for x in players)]
    every = reduce(DataFrame.unionByName, [*(_effects_in(df, x) for df, x in tables), sigmas])
    return every.select("term", *KEY_COLUMNS, F.lit(0).alias("draw_block"), F.array("effect").alias("draws"))


def scales_of(params: DataFrame, terms: Iterable[Term]) -> dict[str, float]:
    """Scale of each term in a parameter table, its prior scale where the table has none."""
    names = {scale_name(t.name): t for t in terms}
    rows = params.where(F.col("term").isin(*names) & (F.col("draw_block") == 0)).select("term", F.col("draws")[0].alias("x")).collect()
    return {t.name: t.scale for t in names.values()} | {names[r["term"]].name: r["x"] for r in rows}


def _at(cells: DataFrame, params: DataFrame, terms: Sequence[Term]) -> tuple[DataFrame, list[Layout], dict[Block, Part]]:
    """What the sums per block need, at a fitted parameter table."""
    cells = _kept(cells, terms)
    size, _ = _sizes(cells, key_columns(terms))
    layouts = [Layout(block, size) for block in blocks_of(terms)]
    return cells, layouts, {x.block: _contributions(params, cells, x.block) for x in layouts}


def scale_gaps(cells: DataFrame, params: DataFrame, terms: Sequence[Term]) -> DataFrame:
    """``(term, sigma, step)`` of a fit: each scale and the one that a further step from the fitted
    effects gives. They agree where the scales rest."""
    cells, layouts, parts = _at(cells, params, terms)
    scales = scales_of(params, terms)
    solved = {x.block: settle(_solved(_pooled(cells, x.block, parts, False), x, scales), "solved") for x in layouts}
    steps = _steps(solved)
    rows = [(t.name, scales[t.name], max(steps[t.name].scale, LEAST * t.scale)) for t in terms]
    return cells.sparkSession.createDataFrame(rows, "term string, sigma double, step double")


def posterior_draws(
    cells: DataFrame, params: DataFrame, terms: Sequence[Term], chains: int, draws: int, block: int, seed: int = 0,
) -> DataFrame:
    """A parameter table of ``chains`` times ``draws`` draws around a fit, ``block`` in each row.

    The effects of a player (or of the groups) are drawn together from the normal that the
    curvature at the fit gives, on executors. A draw depends on the seed, the player and the draw's
    number, so a retried task draws the same. Scales are repeated as fitted."""
    cells, layouts, parts = _at(cells, params, terms)
    scales, total = scales_of(params, terms), chains * draws
    out = []
    for number, x in enumerate(layouts):
        precision = x.precision(scales)
        drawn = _pooled(cells, x.block, parts, False).mapInArrow(
            _drawer(x, precision, total, block, (seed << 8) + number), "who int, draw_block int, effects array<array<double>>")
        flat = drawn.select("who", "draw_block", F.posexplode("effects").alias("place", "draws"))
        out.append(flat.select(*x.names(), "draw_block", "draws"))
    blocks = -(-total // block)
    sigmas = params.where(F.col("term").startswith("sigma_")).select("term", *KEY_COLUMNS, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("draw_block"), F.col("draws")[0].alias("x"))
    length = F.least(F.lit(block), total - F.col("draw_block") * block).cast("int")
    out.append(sigmas.select("term", *KEY_COLUMNS, "draw_block", F.array_repeat("x", length).alias("draws")))
    return reduce(DataFrame.unionByName, out)


def _drawer(layout: Layout, precision: np.ndarray, total: int, block: int, seed: int) -> Callable:
    room = ROOM // (layout.width * max(layout.width, block))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in _systems(batch, layout, precision, room):
                # matrix = L L', so the inverse of L' turns independent normals into effects.
                upper = np.swapaxes(np.linalg.cholesky(x.matrix), 1, 2)
                for i, start in enumerate(range(0, total, block)):
                    n = min(block, total - start)
                    noise = np.stack([
                        np.random.Generator(np.random.Philox(key=[seed, w], counter=[0, 0, 0, i])).standard_normal((layout.width, n))
                        for w in x.who.to_pylist()])
                    effects = x.effects[..., None] + np.linalg.solve(upper, noise)
                    inner = _double_lists(effects.reshape(-1, n))
                    ends = np.arange(len(x.who) + 1, dtype=np.int32) * layout.width
                    yield pa.RecordBatch.from_arrays(
                        [x.who, pa.array(np.full(len(x.who), i), pa.int32()), pa.ListArray.from_arrays(pa.array(ends), inner)],
                        ["who", "draw_block", "effects"])

    return draw


def gradient(cells: DataFrame, params: DataFrame, terms: Sequence[Term]) -> DataFrame:
    """Slope of the penalised log likelihood at a fit, per effect that has data: ``(term, k1,
    k2, k3, k4, n, slope)``. It is the sum of whiffs less those expected, less effect over
    squared scale; the intercept has no penalty. Zero at the optimum."""
    spread = [
        F.struct(F.lit(t.name).alias("term"), *(F.col(t.keys[i]).cast("int").alias(k) if i < len(t.keys) else F.lit(0).alias(k)
                                                for i, k in enumerate(KEY_COLUMNS)))
        for t in (INTERCEPT, *terms)
    ]
    scored = score(cells, params, terms, "_p").select("n", "whiffs", "_p", F.explode(F.array(*spread)).alias("e"))
    missed = F.sum(F.col("whiffs") - F.col("n") * F.col("_p"))
    sums = scored.groupBy("e").agg(missed.alias("missed"), F.sum("n").alias("n")).select("e.*", "missed", "n")
    scales = [F.lit(x) for name, s in scales_of(params, terms).items() for x in (name, s**-2)]
    pull = F.coalesce(F.element_at(F.create_map(*scales), F.col("term")), F.lit(0.0))
    effects = params.select("term", *KEY_COLUMNS, F.col("draws")[0].alias("effect"))
    return sums.join(effects.hint("merge"), ["term", *KEY_COLUMNS]).select(
        "term", *KEY_COLUMNS, "n", (F.col("missed") - pull * F.col("effect")).alias("slope")
    )


def fit_enhanced(cells: DataFrame, missing: Iterable[str] = (), learn: bool = True) -> DataFrame:
    return fit(cells, without(ENHANCED, missing), learn)


def fit_hierarchical(cells: DataFrame, learn: bool = True) -> DataFrame:
    return fit(cells, HIERARCHICAL, learn)
