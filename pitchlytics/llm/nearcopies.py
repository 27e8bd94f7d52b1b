"""Near copies by ProbMinHash: probability Jaccard of weighted word shingles.

A shingle of five words weighs one plus the logarithm of how often it occurs. Each shingle of a
document runs a Poisson process whose rate is its weight; every arrival picks one register, and
a register keeps the shingle that came first. Two documents agree in a register with exactly
their probability Jaccard similarity. Arrivals come in order of time, so a document stops as
soon as all registers are filled and no later arrival can change one: later shingles cost one
random number each.

Registers are banded. In each bucket of a band every text is joined to the bucket's best
connected text, that whose buckets are the largest, which is the original in a group of its
copies. These pairs are verified by their exact similarity, so a bucket of n texts makes n
pairs. Verified pairs give classes. What remains are buckets that hold texts of several classes:
there the members outside the bucket's largest class are compared with all members in blocks of
bounded size, first by registers, then exactly, each pair in the first bucket that it shares. A
block tells only links between classes that it has not joined already, fewer than it has
members. Thus no pair of texts that share a bucket and reach the threshold stays in two classes,
and no bucket is expanded into all pairs.

Equal texts are one text and always one class. Words are runs of letters and digits in lower
case; a text of one to four words is one shingle, a text without words is like equal texts
only. Null texts are empty. Rows with null or repeated ids are classed like all others. An
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchlytics.llm.components import components
from pitchlytics.llm.helpers import ROW, boxed, mixed64, unboxed, word_codes
from pitchlytics.storage import settle

WORDS = 5
LEAST = 0.8
#: At similarity 0.8 a pair shares no band with probability 5e-5.
BANDS, ROWS = 25, 5
REGISTERS = BANDS * ROWS
#: Registers that must agree for verification in the second round: four deviations below 0.8.
AGREE = int(REGISTERS * (LEAST - 4 * (LEAST * (1 - LEAST) / REGISTERS) ** 0.5))
#: Members of a bucket that one block holds in the second round.
BLOCK = 256

_POWERS = np.cumprod(np.full(4096, 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)
_PLACES = mixed64(np.arange(WORDS, dtype=np.uint64), seed=7) | np.uint64(1)


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word, in order."""
    codes = word_codes(text)
    inside = codes != 32
    if not inside.any():
        return np.zeros(0, np.uint64)
    start = np.flatnonzero(inside & np.concatenate([[True], ~inside[:-1]]))
    at = np.flatnonzero(inside)
    word = np.cumsum(np.isin(at, start, assume_unique=True)) - 1
    place = at - start[word]
    with np.errstate(over="ignore"):
        # Places beyond the table of powers fall back on a mixed place.
        power = _POWERS[np.minimum(place, len(_POWERS) - 1)] ^ (place >= len(_POWERS)) * place.astype(np.uint64)
        sums = np.add.reduceat(codes[at] * power, np.searchsorted(at, start))
    return mixed64(sums)


def shingles(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles, ascending, and how often each occurs."""
    words = word_hashes(text)
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    size = min(n, WORDS)
    with np.errstate(over="ignore"):
        h = sum((words[k:n - size + 1 + k] * _PLACES[k] for k in range(size)), np.zeros(n - size + 1, np.uint64))
    return np.unique(mixed64(h, seed=size), return_counts=True)


def weights(counts: np.ndarray) -> np.ndarray:
    return 1 + np.log(counts)


def signature(elements: np.ndarray, weight: np.ndarray) -> np.ndarray | None:
    """The element (32 bits of its hash) that arrives first at each register."""
    if not len(elements):
        return None
    enough = (np.log(REGISTERS) + 2) * REGISTERS
    until = enough / weight.sum()
    while True:
        times, owners = [], []
        alive, clock, drawn = np.arange(len(elements)), np.zeros(len(elements)), 0
        while len(alive):
            ahead = int(min(64, max(1, enough / len(alive))))
            draw = mixed64(elements[alive][:, None] + np.arange(drawn + 1, drawn + ahead + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95), seed=1)
            unit = ((draw >> np.uint64(11)).astype(np.float64) + 0.5) / 2**53
            arrival = clock[:, None] + np.cumsum(-np.log(unit) / weight[alive][:, None], axis=1)
            early = arrival <= until
            who, _ = np.nonzero(early)
            times.append(arrival[early])
            owners.append(np.stack([draw[early], elements[alive][who]]))
            drawn += ahead
            clock, alive = arrival[early[:, -1], -1], alive[early[:, -1]]
        time, (draw, owner) = np.concatenate(times), np.concatenate(owners, axis=1)
        register = (mixed64(draw, seed=2) % np.uint64(REGISTERS)).astype(np.int64)
        order = np.lexsort((owner, time, register))
        filled, first = np.unique(register[order], return_index=True)
        if len(filled) == REGISTERS:
            return (owner[order][first] >> np.uint64(32)).astype(np.uint32).view(np.int32)
        until *= 2


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact probability Jaccard of two weighted sets (sorted elements, weights)."""
    (x, u), (y, v) = a, b
    if not len(x) or not len(y):
        return 0.0
    both, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    one, two = u[i], v[j]
    ratio = one / two
    order = np.argsort(ratio, kind="stable")
    one, two, ratio = one[order], two[order], ratio[order]
    # Over all elements: those of ratio at least this one's count by u, the others by v.
    later = np.concatenate([np.cumsum(one[::-1])[::-1], [0.0]])
    earlier = np.concatenate([[0.0], np.cumsum(two)])
    at = np.searchsorted(ratio, ratio, "left")
    left = later[at] + (u.sum() - one.sum())
    right = earlier[at] + (v.sum() - two.sum())
    return float((1 / (left / one + right / two)).sum())


# -- on tables ----------------------------------------------------------------------------

def text_key(text_col: str = "text") -> Column:
    """A 128-bit key of a text, null as empty."""
    return F.unhex(F.md5(F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")))


def signed(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """A written row per distinct text: ``node`` (a number), ``key`` and ``registers`` (null
    without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column("text").to_pylist():
                elements, counts = shingles(text)
                found.append(signature(elements, weights(counts)))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(found, pa.list_(pa.int32()))], ["key", "registers"])

    rows = docs.select(text_key(text_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    distinct = rows.mapInArrow(run, "key binary, registers array<int>").groupBy("key").agg(F.first("registers").alias("registers"))
    # The numbers are fixed by being written.
    return settle(distinct.select(F.monotonically_increasing_id().alias("node"), "key", "registers"), "texts")


def packed(docs: DataFrame, wanted: DataFrame, text_col: str = "text") -> DataFrame:
    """A written row per wanted text (``node``, ``key``): its shingles in 32 bits with weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams, often = [], []
            for text in batch.column("text").to_pylist():
                elements, counts = shingles(text)
                short, at = np.unique((elements >> np.uint64(32)).astype(np.uint32), return_inverse=True)
                grams.append(short.tobytes())
                often.append(np.bincount(at, counts).astype("<u4").tobytes() if counts.max(initial=1) > 1 else b"")
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(grams, pa.binary()), pa.array(often, pa.binary())], ["node", "grams", "often"])

    rows = docs.select(text_key(text_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    one = rows.join(wanted.select("node", "key"), "key").groupBy("node").agg(F.first("text").alias("text"))
    return settle(one.mapInArrow(run, "node long, grams binary, often binary"), "shingles")


def weighted(grams: bytes, often: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A weighted set from its packed form."""
    x = np.frombuffer(grams, np.uint32)
    return x, weights(np.frombuffer(often, "<u4")) if often else np.ones(len(x))


def verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of at least the similarity, with it. ``texts``: from ``packed``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for a, b, *four in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                s = similarity(weighted(*four[:2]), weighted(*four[2:]))
                if s >= least - 1e-9:
                    rows.append((a, b, s))
            a, b, s = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.float64())], ["a", "b", "similarity"])

    side = lambda x: texts.select(F.col("node").alias(x), F.col("grams").alias(f"grams_{x}"), F.col("often").alias(f"often_{x}"))
    joined = pairs.join(side("b"), "b").join(side("a"), "a")
    return joined.select("a", "b", "grams_a", "often_a", "grams_b", "often_b").mapInArrow(run, "a long, b long, similarity double")


class Joined:
    """Classes that a block has joined."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def of(self, x: int) -> int:
        while (up := self.parent.get(x, x)) != x:
            x = up
        return x

    def join(self, x: int, y: int) -> None:
        self.parent[self.of(x)] = self.of(y)


def block_links(band: int, group: list[tuple], least: float) -> list[tuple[int, int]]:
    """Links between classes of one block: rows of (in the block, probe, node, label, registers,
    grams, often)."""
    here, probes = [r for r in group if r[0]], [r for r in group if r[1]]
    if not here or not probes:
        return []
    labels = np.array([r[3] for r in here])
    table = np.array([r[4] for r in here], np.int32)
    joined, links = Joined(), []
    for _, _, node, label, registers, *packed_ in probes:
        same = table == np.array(registers, np.int32)
        agree = same.sum(axis=1)
        first = same.reshape(len(here), BANDS, ROWS).all(axis=2).argmax(axis=1)
        near = np.flatnonzero((labels != label) & (agree >= AGREE) & (first == band))
        mine = weighted(*packed_) if len(near) else None
        for i in near[np.argsort(-agree[near], kind="stable")]:
            other = here[i]
            if joined.of(label) != joined.of(other[3]) and similarity(mine, weighted(*other[5:])) >= least - 1e-9:
                joined.join(label, other[3])
                links.append((min(node, other[2]), max(node, other[2])))
    return links


def linked_in_blocks(members: DataFrame, least: float) -> DataFrame:
    """Links (a, b) between classes of a bucket. ``members``: bucket, band, node, label,
    registers, grams, often, ``major`` (of the bucket's largest class) and the number of
    ``blocks`` of the bucket. Members of the major class stay in their block; the others also
    go to every block of the bucket."""
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("long")
    placed = members.withColumn("own", own).withColumn(
        "block", F.explode(F.when(F.col("major"), F.array("own")).otherwise(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))))
    order = ["bucket", "block"]
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = (
        placed.select(*order, "band", (F.col("own") == F.col("block")).alias("here"), (~F.col("major")).alias("probe"),
                      "node", "label", "registers", "grams", "often")
        .repartition(parts, *order).sortWithinPartitions(*order)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group = None, []

        def found() -> pa.RecordBatch:
            links = block_links(key[2], group, least)
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], ["a", "b"])

        for batch in batches:
            for bucket, block, band, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (bucket, block, band) != key:
                    if group:
                        yield found()
                    key, group = (bucket, block, band), []
                group.append(tuple(rest))
        if group:
            yield found()

    return rows.mapInArrow(run, "a long, b long")


def classes(docs: DataFrame, *, text_col: str = "text", least: float = LEAST) -> DataFrame:
    """A written row per distinct text: ``key`` and ``label``, equal for texts of one class."""
    texts = signed(docs, text_col)
    band = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.slice("registers", b * ROWS + 1, ROWS)))
    banded = texts.where("registers IS NOT NULL").select("node", F.posexplode(band).alias("band", "bucket"))
    shared = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    inside = settle(banded.join(shared, "bucket"), "inside")
    degree = inside.groupBy("node").agg(F.sum("n").alias("degree"))
    best = F.max(F.struct("degree", "node")).getField("node").alias("best")
    leaders = inside.join(degree, "node").groupBy("bucket").agg(best)
    stars = settle(
        inside.join(leaders, "bucket").where("node <> best").select(F.col("best").alias("a"), F.col("node").alias("b")).distinct(), "stars")

    def shingled(nodes: DataFrame) -> DataFrame:
        return packed(docs, texts.select("node", "key").join(nodes, "node"), text_col)

    ends = stars.select(F.col("a").alias("node")).unionByName(stars.select(F.col("b").alias("node"))).distinct()
    shingle = shingled(ends)
    links = settle(verified(stars, shingle, least).select("a", "b"), "links")
    labelled = settle(
        texts.select("node", "key").join(components(links), "node", "left").withColumn("label", F.coalesce("label", "node")), "labelled")

    # A bucket of two had its only pair verified; the others count if they hold several classes.
    labels = inside.where("n > 2").join(labelled.select("node", "label"), "node")
    sizes = labels.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("m"), F.first("n").alias("n"))
    open_ = (
        sizes.groupBy("bucket").agg(F.max(F.struct("m", "label")).getField("label").alias("major"), F.count(F.lit(1)).alias("k"), F.first("n").alias("n"))
        .where("k > 1").select("bucket", "major", F.ceil(F.col("n") / BLOCK).cast("long").alias("blocks"))
    )
    members = settle(
        labels.select("bucket", "band", "node", "label").join(settle(open_, "open"), "bucket")
        .select("bucket", "band", "node", "label", (F.col("label") == F.col("major")).alias("major"), "blocks"), "members")
    full = members.join(texts.select("node", "registers"), "node").join(shingle, "node")
    late = linked_in_blocks(full, least)
    of = lambda x: labelled.select(F.col("node").alias(x), F.col("label").alias(f"label_{x}"))
    joins = settle(late.join(of("a"), "a").join(of("b"), "b").select(F.col("label_a").alias("a"), F.col("label_b").alias("b")).distinct(), "joins")
    merged = components(joins).select(F.col("node").alias("label"), F.col("label").alias("merged"))
    return settle(labelled.select("key", "label").join(merged, "label", "left").select("key", F.coalesce("merged", "label").alias("label")), "classes")


def classed(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """Per row its id, ``class_id`` (the least id of its class) and ``class_size`` (rows)."""
    labels = classes(docs, text_col=text_col, least=least)
    rows = settle(docs.select(F.col(id_col), text_key(text_col).alias("key")).join(labels, "key").select(id_col, "label"), "rows")
    least_id = settle(rows.groupBy("label").agg(F.min(id_col).alias("class_id"), F.count(F.lit(1)).alias("class_size")), "least")
    return rows.join(least_id, "label").select(id_col, "class_id", "class_size")


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """One row of each class, with all columns: that of the least id, null ids last, then of
    the least text key; of rows that agree in both, any."""
    labels = classes(docs, text_col=text_col, least=least)
    place = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col("key"))
    narrow = docs.select(F.col(id_col), text_key(text_col).alias("key"))
    same = narrow.groupBy(id_col, "key").agg(F.count(F.lit(1)).alias("n")).join(labels, "key")
    keep = settle(
        same.groupBy("label").agg(F.min(F.struct(*[place.getField(f).alias(f) for f in ("none", "id", "key")], "n")).alias("x"))
        .select(F.col("x.id").alias("_id"), F.col("x.key").alias("_key"), F.col("x.n").alias("_n")), "keep")
    rows = boxed(docs).withColumn("_key", text_key(f"{ROW}.{text_col}"))
    kept = rows.join(keep, ["_key"]).where(F.col(f"{ROW}.{id_col}").eqNullSafe(F.col("_id")))
    once, often = kept.where("_n = 1"), kept.where("_n > 1").dropDuplicates(["_key"])
    return unboxed(once.unionByName(often), docs.columns)
