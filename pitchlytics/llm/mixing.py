"""Mixing overlapping sources to target weights by min-cost flow.

Documents are first added up by membership pattern, the set of sources that hold them. The
patterns' words are then routed to the sources' quotas by a min-cost flow in which the second
pass over a pattern costs more than the first (convex), so repetition is used only where a
quota needs it. Last, each pattern's share is drawn as whole documents in the order of a seeded
hash, up to a cut, and closed with the one further document that comes nearest to what is left.

A source that shares no document with another is a component of its own, whose cheapest flow is
its target; such sources, in any number, are settled in joins. Only the patterns of sources that
do overlap reach the driver, never documents; their number is checked against ``max_patterns``
and beyond it the call raises.

A null source is a source of its own and comes last. A document with no source, or of size 0,
adds nothing: it is taken with its pattern's whole passes and counts 0 words. Null texts have
size 0; texts of any length are counted whole. Rows that agree in all columns are one draw of
many copies, of which the cut may take some. Columns that hold maps don't tell rows apart, and
such a table raises if a cut falls between rows that are equal but for them. An empty table
gives an empty result. Input columns named like the added ones are replaced, all others are kept.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchlytics.llm.helpers import ROW, hashable
from pitchlytics.operators.ordered import running_totals
from pitchlytics.storage import settle

WORD = r"[^\x20\x09-\x0D]+"
#: Copies of one row that a task writes in one go where a cut falls between them.
COPIES = 4096
NO_SOURCE = "-"
ADDED = ("mix_size", "mix_pattern", "mix_times", "mix_source_size", "mix_target")


def words(text: str = "text") -> Column:
    """Number of maximal runs of other characters than ASCII white space."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """A source as a key that is never null: ``=`` and the name, or ``-``."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(NO_SOURCE))


def by_code_point(keys: Sequence[str]) -> list[str]:
    """Source keys in code point order, the null source last."""
    return sorted(keys, key=lambda k: (k == NO_SOURCE, k))


def targets(sizes: dict[str, int], weights: Sequence[float], share: float, most: float) -> dict[str, float]:
    """Words that each source should give: ``share`` of all words split by weight, where the
    weights repeat over the sources in order. What lies above ``most`` times a source's size
    goes to the others by weight, until none is above."""
    order = by_code_point(list(sizes))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    found: dict[str, float] = {}
    left, open_ = share * sum(sizes.values()), order
    while open_:
        each = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if each * weight[s] > most * sizes[s]]
        if not full:
            return found | {s: each * weight[s] for s in open_}
        found |= {s: float(most * sizes[s]) for s in full}
        left = max(0.0, left - sum(found[s] for s in full))
        open_ = [s for s in open_ if s not in found]
    return found


def route(capacity: dict[tuple[str, ...], int], quota: dict[str, float], passes: int,
          cost: Callable[[int], float] = lambda k: float(k * k)) -> dict[tuple[str, ...], dict[str, float]]:
    """Cheapest largest flow of words from patterns to the quotas of their sources.

    Each pattern offers its words ``passes`` times, the k-th time at ``cost(k)`` a word, which
    must not fall with k. Successive cheapest paths with potentials."""
    nodes: dict[object, int] = {"from": 0, "to": 1}
    graph: list[list[int]] = [[], []]
    head, room, price = [], [], []

    def node(x: object) -> int:
        if x not in nodes:
            nodes[x] = len(graph)
            graph.append([])
        return nodes[x]

    def arc(a: int, b: int, r: float, p: float) -> int:
        for x, y, r_, p_ in ((a, b, r, p), (b, a, 0.0, -p)):
            graph[x].append(len(head))
            head.append(y)
            room.append(r_)
            price.append(p_)
        return len(head) - 2

    carried: dict[tuple[tuple[str, ...], str], int] = {}
    for pattern, size in sorted(capacity.items()):
        for k in range(1, passes + 1):
            arc(0, node(pattern), float(size), cost(k))
        for s in pattern:
            carried[pattern, s] = arc(node(pattern), node(("source", s)), float("inf"), 0.0)
    for s, q in sorted(quota.items()):
        arc(node(("source", s)), 1, q, 0.0)
    least = 1e-9 * (1 + sum(quota.values()))
    height = [0.0] * len(graph)
    while True:
        far, via = [float("inf")] * len(graph), [-1] * len(graph)
        far[0], queue = 0.0, [(0.0, 0)]
        while queue:
            d, x = heapq.heappop(queue)
            if d > far[x]:
                continue
            for e in graph[x]:
                step = d + max(0.0, price[e] + height[x] - height[head[e]])
                if room[e] > least and step < far[head[e]] - 1e-12:
                    far[head[e]], via[head[e]] = step, e
                    heapq.heappush(queue, (step, head[e]))
        if via[1] < 0:
            break
        height = [h + min(f, far[1]) for h, f in zip(height, far, strict=True)]
        path, x = [], 1
        while x:
            path.append(via[x])
            x = head[via[x] ^ 1]
        amount = min(room[e] for e in path)
        for e in path:
            room[e] -= amount
            room[e ^ 1] += amount
    return {p: {s: room[carried[p, s] ^ 1] for s in p} for p in capacity}


def levelled(sources: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """``targets`` for any number of sources ``(s, size)``, with ``of_size`` and ``target``.

    In the order of the size that a unit of weight may draw on, the sources that are full come
    first. The level, the words a unit of weight gets, is what the full ones leave over the
    weight of the others."""
    keyed = sources.select("s", "size", (F.col("s") == NO_SOURCE).alias("last"), F.lit(1).alias("one"))
    at = (F.col("one_before") % len(weights) + 1).cast("int")
    weighed = running_totals(keyed, [], ["last", "s"], ["one"]).select(
        "s", "size", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), at).alias("weight"),
        (F.col("size") * F.lit(float(most))).alias("full"))
    filled = running_totals(weighed.withColumn("ratio", F.col("full") / F.col("weight")), [], ["ratio", "s"], ["full", "weight", "size"])
    level = (F.lit(float(share)) * F.col("size_all") - F.col("full_before")) / (F.col("weight_all") - F.col("weight_before"))
    filled = settle(filled.withColumn("level", level), "levels")
    reached = filled.agg(F.max(F.when(F.col("ratio") >= F.col("level"), F.col("level")))).scalar()
    # without a level all are full, and ``least`` passes over the null
    return filled.select("s", F.col("size").alias("of_size"), F.least("full", reached * F.col("weight")).alias("target"))


def taken_words(sums: DataFrame, quota: DataFrame, passes: int, max_patterns: int) -> DataFrame:
    """Patterns ``(p, size)`` with ``take``, the words the cheapest flow takes of each, and
    ``of_size`` and ``target`` of their first source."""
    spark = sums.sparkSession
    overlapping = sums.where(F.size("p") > 1).select(F.explode("p").alias("s")).distinct()
    tangled = sums.withColumn("s", F.explode("p")).join(overlapping, "s", "left_semi").select("p", "size").distinct()
    rows = tangled.limit(max_patterns + 1).collect()
    if len(rows) > max_patterns:
        raise ValueError(f"more than {max_patterns} membership patterns of sources that overlap")
    flow: dict[tuple[str, ...], dict[str, float]] = {}
    if rows:
        quotas = {r["s"]: r["target"] for r in quota.join(overlapping, "s", "left_semi").collect()}
        flow = route({tuple(r["p"]): r["size"] for r in rows}, quotas, passes)
    routed = spark.createDataFrame([(list(p), float(sum(f.values()))) for p, f in flow.items()], "p array<string>, routed double")
    nameless = (F.get("p", F.lit(0)) == NO_SOURCE) & (F.size("p") > 1)
    first = F.when(nameless, F.get("p", F.lit(1))).otherwise(F.get("p", F.lit(0)))
    return sums.withColumn("s", first).join(quota, "s", "left").join(routed, "p", "left").select(
        "p", "size", "of_size", "target", F.coalesce("routed", "target", F.lit(0.0)).alias("take"))


def cuts(draws: DataFrame, plan: DataFrame) -> DataFrame:
    """Per pattern with a ``rest`` the draw ``cut`` at which it ends, and ``special``: the draws
    ``(o, take, m)`` of which other copies are taken than all before the cut and none after.
    ``draws`` are distinct ``(p, o, size, m)`` in the order ``o``.

    What is left at the cut closes with the one further document of the nearest size, or with
    the next document less the one taken whose size is nearest to the excess."""
    some = plan.where("rest > 0").select("p", "rest")
    worth = draws.join(some, "p").withColumn("words", F.col("size") * F.col("m"))
    placed = settle(running_totals(worth, ["p"], ["o"], ["words"]), "draws")
    j = F.floor((F.col("rest") - F.col("words_before")) / F.col("size"))
    cut = settle(
        placed.where("words > 0 AND words_before <= rest AND words_before + words > rest")
        .select("p", F.col("o").alias("cut"), F.least(j, F.col("m") - 1).alias("j"), F.col("m").alias("of"), F.col("size").alias("next"),
                (F.col("rest") - F.col("words_before")).alias("open"))
        .withColumn("left", F.col("open") - F.col("j") * F.col("next")).drop("open"), "cuts")
    under = F.col("o") < F.col("cut")
    off = F.abs(F.col("size") - F.when(under, F.col("next") - F.col("left")).otherwise(F.col("left")))
    best = (
        placed.select("p", "o", "size", "m").join(cut, "p").where(off < F.col("left"))
        .groupBy("p").agg(F.min(F.struct(off.alias("off"), under.alias("swap"), "o", "m")).alias("best"))
    )

    def special(o: Column, take: Column, m: Column) -> Column:
        return F.struct(o.alias("o"), take.cast("long").alias("take"), m.cast("long").alias("m"))

    at, found, of = F.col("cut"), F.col("best"), F.col("of")
    here, one_more = special(at, F.col("j"), of), special(at, F.col("j") + 1, of)
    specials = (
        F.when(found.isNull(), F.array(here))
        .when(found["swap"], F.array(one_more, special(found["o"], found["m"] - 1, found["m"])))
        .when(found["o"] == at, F.array(one_more))
        .otherwise(F.array(here, special(found["o"], F.lit(1), found["m"])))
    )
    return cut.join(best, "p", "left").select("p", "cut", specials.alias("special"))


def mix(docs: DataFrame, sources: Column, weights: Sequence[float], *, share: float = 1.5, passes: int = 2,
        seed: int = 0, id_col: str = "doc_id", text_col: str = "text", max_patterns: int = 100_000) -> DataFrame:
    """``docs`` with ``mix_size`` (words), ``mix_pattern`` (source keys), ``mix_times`` (how
    often the mix takes the document) and, of its first source, ``mix_source_size`` and
    ``mix_target``. ``sources`` is an array of source names.

    The texts are read twice: once for sizes, once to mark the rows; everything between runs on
    a narrow written table of distinct draws. Where a cut falls between copies of a row, those
    copies are read once more, added up and dealt anew."""
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c not in ADDED]
    whole_row = [F.col(f"`{c}`") for c in kept if hashable(docs.schema[c].dataType)]
    drawn = F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col), *whole_row)
    order = drawn.bitwiseXOR(F.lit(-(2**63)))  # unsigned order
    pattern = F.array_sort(F.array_distinct(F.transform(sources, source_key)))
    known = F.coalesce(pattern, F.array().cast("array<string>"))
    draws = settle(
        docs.select(known.alias("p"), order.alias("o"), words(text_col).alias("size"))
        .groupBy("p", "o", "size").agg(F.count(F.lit(1)).alias("m")), "sizes")

    sums = settle(draws.groupBy("p").agg(F.sum(F.col("size") * F.col("m")).alias("size")), "patterns")
    sizes = sums.select(F.explode("p").alias("s"), "size").groupBy("s").agg(F.sum("size").alias("size"))
    quota = settle(levelled(sizes, weights, share, passes), "targets")
    whole = F.when(F.col("size") > 0, F.least(F.lit(passes), F.floor((F.col("take") + 1e-6) / F.col("size")))).otherwise(0).cast("int")
    rest = F.when(F.col("whole") < passes, F.col("take") - F.col("whole") * F.col("size")).otherwise(0.0)
    plan = settle(taken_words(sums, quota, passes, max_patterns).withColumn("whole", whole).withColumn("rest", rest), "plan")

    def of_kind(kind: Callable[[Column], Column]) -> Column:
        found = F.filter("special", kind)
        return F.coalesce(F.transform(found, lambda x: x["o"]), F.array().cast("array<long>"))

    marks = plan.join(cuts(draws, plan), "p", "left").select(
        F.col("p").alias("mix_pattern"), "whole", "of_size", "target", "cut", "special",
        of_kind(lambda x: x["take"] == x["m"]).alias("gain"), of_kind(lambda x: x["take"] == 0).alias("lose"),
        of_kind(lambda x: (x["take"] > 0) & (x["take"] < x["m"])).alias("part"))
    marks = settle(marks, "marks")

    row = F.struct(*[F.col(f"`{c}`") for c in kept]).alias(ROW)
    marked = docs.select(row, known.alias("mix_pattern"), order.alias("o"), words(text_col).alias("mix_size")).join(marks, "mix_pattern")
    before = F.coalesce(F.col("o") < F.col("cut"), F.lit(False)) & ~F.array_contains("lose", F.col("o"))
    extra = before | F.array_contains("gain", F.col("o"))
    split = F.array_contains("part", F.col("o"))

    def result(rows: DataFrame, more: Column) -> DataFrame:
        return rows.select(
            *[F.col(f"{ROW}.`{c}`").alias(c) for c in kept], "mix_pattern", "mix_size", (F.col("whole") + F.when(more, 1).otherwise(0)).alias("mix_times"),
            F.col("of_size").alias("mix_source_size"), F.col("target").alias("mix_target"))

    if marks.where(F.size("part") > 0).isEmpty():
        return result(marked, extra)
    take = F.filter("special", lambda x: x["o"] == F.col("o"))[0]["take"]
    copies = (
        marked.where(split).withColumn("take", take)
        .groupBy(ROW, "mix_pattern", "mix_size", "whole", "of_size", "target", "take").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {COPIES}"))))
        .repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "lot")
        .withColumn("k", F.explode(F.sequence(F.col("lot") * COPIES, F.least("n", (F.col("lot") + 1) * COPIES) - 1)))
    )
    return result(marked.where(~split), extra).unionByName(result(copies, F.col("k") < F.col("take")))
