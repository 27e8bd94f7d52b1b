import itertools
import random

import pytest
from pyspark.sql import functions as F

from pitchlytics.llm import mixing as M
from pitchlytics.llm.workload import MIX_WEIGHTS


def test_words_count_runs_between_ascii_blanks(docs, rows):
    texts = ["a b", " a\t\n\x0b\x0c\rb ", "", None, "a b c", "\x1c x"]
    got = [r[1] for r in rows(docs(texts).select("doc_id", M.words().alias("n")))]
    assert got == [2, 2, 0, 0, 2, 2]


def test_targets_stop_at_twice_the_size_and_keep_the_sum():
    rng = random.Random(1)
    for _ in range(300):
        sizes = {f"={i}": rng.choice([0, 1, 5, 100, 1000]) for i in range(rng.randint(1, 8))}
        got = M.targets(sizes, MIX_WEIGHTS, 1.5, 2)
        total = 1.5 * sum(sizes.values())
        assert abs(sum(got.values()) - total) < 1e-6 * (1 + total)
        weight = dict(zip(sorted(sizes), itertools.cycle(MIX_WEIGHTS), strict=False))
        rates = {got[s] / weight[s] for s in sizes if got[s] < 2 * sizes[s] - 1e-6}
        assert all(got[s] <= 2 * sizes[s] + 1e-6 for s in sizes)
        assert not rates or max(rates) - min(rates) < 1e-6 * (1 + total)


def test_null_source_comes_last():
    assert M.by_code_point(["-", "=b", "=a", "=é", "=Z"]) == ["=Z", "=a", "=b", "=é", "-"]


def cost_of(capacity, quota, passes, flow):
    """Flow and cost of a routing, from per-pattern totals."""
    total, cost = 0.0, 0.0
    for p, size in capacity.items():
        take = sum(flow[p].values())
        assert take <= passes * size + 1e-6
        total += take
        for k in range(1, passes + 1):
            cost += k * k * min(size, max(0.0, take - (k - 1) * size))
    for s, q in quota.items():
        assert sum(f.get(s, 0.0) for f in flow.values()) <= q + 1e-6
    return total, cost


def brute(capacity, quota, passes):
    """Largest flow, then least cost, over all whole amounts per arc of a small instance."""
    arcs = [(p, s) for p in capacity for s in p]
    best = (0, 0)
    for amounts in itertools.product(*[range(passes * capacity[p] + 1) for p, _ in arcs]):
        flow = {p: {} for p in capacity}
        for (p, s), a in zip(arcs, amounts, strict=True):
            flow[p][s] = a
        if any(sum(f.values()) > passes * capacity[p] for p, f in flow.items()):
            continue
        if any(sum(f.get(s, 0) for f in flow.values()) > q for s, q in quota.items()):
            continue
        total, cost = cost_of(capacity, quota, passes, flow)
        best = max(best, (total, -cost))
    return best[0], -best[1]


@pytest.mark.parametrize("seed", range(12))
def test_flow_is_the_cheapest_largest(seed):
    rng = random.Random(seed)
    names = ["a", "b", "c"]
    patterns = rng.sample([("a",), ("b",), ("a", "b"), ("b", "c"), ("c",), ("a", "b", "c")], 3)
    capacity = {p: rng.randint(0, 2) for p in patterns}
    quota = {s: float(rng.randint(0, 4)) for s in names if any(s in p for p in patterns)}
    got = cost_of(capacity, quota, 2, M.route(capacity, quota, 2))
    assert got == pytest.approx(brute(capacity, quota, 2))


def test_overlap_is_used_before_repetition():
    flow = M.route({("a",): 10, ("a", "b"): 10, ("b",): 10}, {"a": 15.0, "b": 15.0}, 2)
    assert all(sum(f.values()) == pytest.approx(10) for f in flow.values())


def mixed(table, sources=None, **kind):
    return M.mix(table, F.array("source") if sources is None else sources, MIX_WEIGHTS, seed=4, **kind)


def test_sources_come_near_their_targets_and_reruns_agree(docs):
    rng = random.Random(7)
    texts = ["w " * rng.randint(1, 60) for _ in range(600)] + [None, "", "w"]
    source = [rng.choice(["a", "b", "c", "d", None, "hot", "hot"]) for _ in texts]
    table = docs(texts, source=source, extra=("mix_size", "p", "u"))
    got = mixed(table.repartition(3)).select("doc_id", "source", "mix_size", "mix_times", "mix_source_size", "mix_target").collect()
    again = mixed(table.repartition(8)).select("doc_id", "mix_times").collect()
    assert sorted((r["doc_id"], r["mix_times"]) for r in got) == sorted(map(tuple, again))
    assert len(got) == len(texts) and all(0 <= r["mix_times"] <= 2 for r in got)
    for s in set(source):
        mine = [r for r in got if r["source"] == s]
        assert sum(r["mix_size"] for r in mine) == mine[0]["mix_source_size"]
        assert abs(sum(r["mix_size"] * r["mix_times"] for r in mine) - mine[0]["mix_target"]) <= 3


def test_overlapping_sources_meet_their_quotas(docs):
    rng = random.Random(8)
    table = docs(["w " * rng.randint(1, 9) for _ in range(400)]).withColumn(
        "of", F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("a"), F.lit("b"))).when(F.col("doc_id") % 3 == 1, F.array(F.lit("b"))).otherwise(F.array(F.lit("a"), F.lit("a"))))
    got = mixed(table, F.col("of"))
    total = got.agg(F.sum(F.col("mix_size") * F.col("mix_times"))).first()[0]
    sizes = {r["mix_pattern"][0] + str(len(r["mix_pattern"])): r["s"] for r in got.groupBy("mix_pattern").agg(F.sum("mix_size").alias("s")).collect()}
    a, b = sizes["=a1"] + sizes["=a2"], sizes["=b1"] + sizes["=a2"]
    quota = M.targets({"=a": a, "=b": b}, MIX_WEIGHTS, 1.5, 2)
    flow = M.route({("=a",): sizes["=a1"], ("=a", "=b"): sizes["=a2"], ("=b",): sizes["=b1"]}, quota, 2)
    assert abs(total - sum(sum(f.values()) for f in flow.values())) <= 6


def test_too_many_overlaps_are_refused_and_nothing_is_fine(docs):
    own = F.array(F.col("doc_id").cast("string"))
    with pytest.raises(ValueError, match="patterns"):
        mixed(docs(["a"] * 9), F.array_append(own, F.lit("all")), max_patterns=8)
    assert {r["mix_times"] for r in mixed(docs(["a"] * 9), own, max_patterns=8).collect()} <= {0, 1, 2}
    assert mixed(docs([])).collect() == []
    nowhere = mixed(docs(["a b"]), F.array().cast("array<string>")).first()
    assert (nowhere["mix_size"], nowhere["mix_times"]) == (2, 0)


def test_levels_equal_the_targets_one_by_one(spark):
    rng = random.Random(3)
    for n in (1, 2, 5, 40):
        sizes = {("-" if i == 0 else f"={i}"): rng.choice([0, 1, 5, 100, 1000, 10**6]) for i in range(n)}
        table = spark.createDataFrame(list(sizes.items()), "s string, size long")
        got = {r["s"]: r["target"] for r in M.levelled(table, MIX_WEIGHTS, 1.5, 2).collect()}
        assert got == pytest.approx(M.targets(sizes, MIX_WEIGHTS, 1.5, 2))


def test_two_hundred_thousand_sources(spark):
    n = 200_000
    table = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"), F.col("id").cast("string").alias("source"))
    got = mixed(table).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("mix_size") * F.col("mix_times")).alias("taken"), F.sum("mix_target").alias("target")).first()
    assert got["n"] == n and got["target"] == pytest.approx(3 * n)
    assert got["taken"] == pytest.approx(3 * n, rel=0.2)


def test_a_cut_falls_between_equal_rows(spark):
    rng = random.Random(5)
    hot = [(7, "w " * 10, "s", "x")] * 9000
    rest = [(1000 + i, "w " * rng.randint(1, 20), rng.choice("st"), None) for i in range(300)]
    table = spark.createDataFrame(hot + rest, "doc_id long, text string, source string, whole string")
    got = mixed(table.repartition(5)).collect()
    assert sorted((r["doc_id"], r["text"], r["source"]) for r in got) == sorted(x[:3] for x in hot + rest)
    for s in "st":
        mine = [r for r in got if r["source"] == s]
        assert abs(sum(r["mix_size"] * r["mix_times"] for r in mine) - mine[0]["mix_target"]) <= 5
    again = mixed(table.repartition(2)).collect()
    assert sorted((r["doc_id"], r["mix_times"]) for r in got) == sorted((r["doc_id"], r["mix_times"]) for r in again)


def test_rows_that_agree_in_id_and_text(spark):
    table = spark.createDataFrame([(1, "a b c", "s")] * 4 + [(2, "d e", "s"), (None, "f", "s"), (None, "g", None)], "doc_id long, text string, source string")
    got = mixed(table).collect()
    assert len(got) == 7 and sum(r["doc_id"] == 1 for r in got) == 4
    taken = sum(r["mix_size"] * r["mix_times"] for r in got if r["source"] == "s")
    assert abs(taken - next(r["mix_target"] for r in got if r["source"] == "s")) <= 1.5
