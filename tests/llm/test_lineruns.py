import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pitchlytics.llm import lineruns


def key_of(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(lineruns.BLANKS))


def brute_force(texts, min_docs, min_chars=1):
    lines = [(t or "").split("\n") for t in texts]
    held = Counter(k for own in lines for k in {key_of(x) for x in own})
    out = []
    for own in lines:
        kept = [x for x in own if held[key_of(x)] < min_docs or len(key_of(x)) < max(1, min_chars)]
        out.append((len(own), len(own) - len(kept), "\n".join(kept)))
    return out


def found(docs, min_docs, **options):
    rows = lineruns.without_common_lines(docs, min_docs, **options).collect()
    return sorted((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in rows)


TEXTS = [
    "Menu\nfirst\n\nfoot", " menu\t\r\nsecond\n\nFOOT\n", None, "", "\n\n", "Ménu\nÉcole\nécole", "MÉNU\nthird",
    "menu\nmenu\nmenu", "\x0bmenu\x0c", "\xa0menu", "a\tb\nA\tB",
]


@pytest.mark.parametrize("min_docs, min_chars", [(1, 1), (2, 1), (3, 1), (4, 5), (50, 1)])
def test_lines_are_those_of_a_plain_count(docs, min_docs, min_chars):
    got = found(docs(TEXTS, extra=("h1", "lines", "dropped", "t1")), min_docs, min_chars=min_chars, batches=3, fan=2)
    assert got == [(i, *x) for i, x in enumerate(brute_force(TEXTS, min_docs, min_chars))]


def test_many_batches_hot_lines_and_hot_texts(docs):
    rng = random.Random(3)
    texts = ["hot line\n" + "\n".join(f"line {rng.randrange(60)}" for _ in range(rng.randrange(6))) for _ in range(200)]
    texts += ["hot line\nthe same text\nline 1"] * 120 + ["x" * 40_000 + "\n" + "hot line\n" * 3_000]
    got = found(docs(texts), 10, batches=9, fan=2)
    assert got == [(i, *x) for i, x in enumerate(brute_force(texts, 10))]


def test_empty_table_and_repeated_rows(docs, spark):
    assert found(docs([]), 2) == []
    twice = spark.createDataFrame([(1, "a\nb"), (1, "a\nb"), (None, "b\nc")], "doc_id long, text string")
    rows = lineruns.without_common_lines(twice, 3, batches=2).collect()
    assert sorted((r["doc_id"] or 0, r["n_dropped"], r["kept"]) for r in rows) == [(0, 1, "c"), (1, 1, "a"), (1, 1, "a")]


def test_levels_are_merged_and_batches_meet_all_runs(spark):
    runs = lineruns.LineRuns(spark, min_docs=3, fan=2)

    def batch(*lines):
        return lineruns.batch_counts(spark.createDataFrame([(x,) for x in lines], "text string"))

    def hashes(*lines):
        return {tuple(r) for r in spark.createDataFrame([(x,) for x in lines], "k string").select(*lineruns.hashed(F.col("k"))).collect()}

    def keys(df):
        return {tuple(r) for r in df.select(*lineruns.HASH).collect()}

    assert keys(runs.unseen(batch("a", "b"))) == hashes("a", "b")
    shape = []
    for lines in (("a", "b", "a"), ("a", "c"), ("c", "d"), ("a", "c", "e"), ("f",)):
        runs.add(batch(*lines))
        shape.append([len(x) for x in runs.levels])
    assert shape == [[1], [0, 1], [1, 1], [0, 0, 1], [1, 0, 1]]
    assert keys(runs.common()) == hashes("a", "c")
    assert keys(runs.unseen(batch("A", "g", "f", "c"))) == hashes("g")
    # A common line is counted no further: the batch's own run does not hold it.
    runs.add(batch("a", "z"))
    assert keys(runs.tables()[0]) <= hashes("a", "b", "c", "d", "e", "f", "z")
    names = [t for level in runs.levels for t in level]
    runs.drop()
    assert not any(spark.catalog.tableExists(n) for n in names)


def test_runs_are_read_without_an_exchange(spark):
    runs = lineruns.LineRuns(spark, min_docs=1, fan=9)
    for text in ("a\nb", "c"):
        runs.add(lineruns.batch_counts(spark.createDataFrame([(text,)], "text string")))
    counts = lineruns.batch_counts(spark.createDataFrame([("a\nx",)], "text string"))
    plan = runs.unseen(counts)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 2 and plan.count("Exchange") == 1
    runs.drop()
