import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from pitchlytics.llm import lexical


def terms(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def brute_force(texts, queries, top):
    """Every query against every document."""
    counts = [Counter(terms(t)) for t in texts]
    sizes = [c.total() for c in counts]
    docs, words = sum(n > 0 for n in sizes), sum(sizes)
    df = Counter(t for c in counts for t in c)
    out = []
    for item, text in queries:
        scored = []
        for i, (c, n) in enumerate(zip(counts, sizes, strict=True)):
            m = 100 - 50 + 50 * n * docs // words if words else 0
            score = sum(math.floor(1000 * math.log((2 * docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m))
                        for t in set(terms(text)) if c[t])
            if score > 0:
                scored.append((-score, i))
        out += [(item, rank, i, -s) for rank, (s, i) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def found(spark, docs, queries, top):
    asked = spark.createDataFrame(queries, "item_id long, text string")
    return sorted(tuple(r) for r in lexical.search_all(docs, asked, top).select("item_id", "rank", "doc_id", "score").collect())


WORDS = ["the", "The", "éa", "Éa", "x1", "b", "C", "dd", "e_e", "—", "q"]


@pytest.mark.parametrize("top", [1, 7, 500])
def test_ranks_are_those_of_all_scores(spark, docs, top, monkeypatch):
    rng = random.Random(top)
    texts = [" ".join(rng.choices(WORDS, range(11, 0, -1), k=rng.randrange(30))) for _ in range(150)]
    texts += [None, "", "...", "the b"] + ["the dd b"] * 60 + ["q " * 5000 + "the"]
    queries = [(0, "the b dd"), (1, "Q éa"), (2, None), (3, "nothing here"), (4, "e the C x1 b — dd"), (5, "the"), (6, "the b dd"), (7, "")]
    got = found(spark, docs(texts, extra=("query", "score", "rank", "id")).repartition(5), queries, top)
    assert got == brute_force(texts, queries, top)


def test_small_segments_and_blocks_change_nothing(spark, docs, monkeypatch):
    rng = random.Random(5)
    texts = [" ".join(rng.choices(WORDS, k=rng.randrange(12))) for _ in range(80)]
    queries = [(i, " ".join(rng.choices(WORDS, k=4))) for i in range(6)] + [(9, "the")] * 1
    monkeypatch.setattr(lexical, "BLOCK", 20)
    monkeypatch.setattr(lexical, "LEAST_TASK_DOCS", 30)
    assert found(spark, docs(texts), queries, 5) == brute_force(texts, queries, 5)


def test_empty_tables_null_ids_and_repeated_rows(spark, docs):
    asked = [(1, "the b")]
    assert found(spark, docs([]), asked, 5) == []
    assert found(spark, docs([None, ""]), asked, 5) == []
    none = spark.createDataFrame([], "item_id long, text string")
    assert lexical.search_all(docs(["the"]), none, 5).collect() == []
    rows = spark.createDataFrame([(None, "b b"), (3, "b b"), (3, "b b"), (4, "c")], "doc_id long, text string")
    got = lexical.search_all(rows, spark.createDataFrame([(1, "b")], "item_id long, text string"), 5).collect()
    assert sorted((r["rank"], r["doc_id"]) for r in got) == [(1, 3), (2, 3), (3, None)]
    twice = spark.createDataFrame([(1, "b"), (1, "b")], "item_id long, text string")
    assert lexical.search_all(rows, twice, 1).count() == 2


def test_segments_end_at_a_bound_and_hold_each_document_once(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(lexical, "POSTINGS", 10)
    rng = random.Random(2)
    lists = [[t for t in range(12) if rng.random() < 0.4] for _ in range(70)]
    batches = [pa.RecordBatch.from_pydict({
        "id": pa.array(range(i, i + 35), pa.int64()), "n": pa.array([len(x) + 1 for x in lists[i:i + 35]], pa.int64()),
        "terms": pa.array(lists[i:i + 35], pa.list_(pa.int32())), "times": pa.array([[1] * len(x) for x in lists[i:i + 35]], pa.list_(pa.int64()))}) for i in (0, 35)]
    seen = Counter()
    for s in lexical._segments(iter(batches), 70, 300):
        assert len(s.doc) <= 10 or len(s.ids) == 1
        seen.update((int(s.ids[d]), int(k >> 32)) for d, k in zip(s.doc, s.key, strict=True))
    assert seen == Counter((i, t) for i, x in enumerate(lists) for t in x)


def test_range_maxima_and_a_search_that_leaves_most_documents_unscored():
    rng = np.random.default_rng(4)
    docs, n_terms = 5000, 3
    doc = np.tile(np.arange(docs), n_terms)
    term = np.repeat(np.arange(n_terms), docs)
    impact = rng.pareto(1.0, docs * n_terms).astype(np.int64) + 1
    segment = lexical.Segment(np.arange(docs), doc, term, impact)
    for lo, hi in ((0, 1), (0, docs), (17, 700), (5, 5), (4000, 4999)):
        _, most = segment.maxima(np.array([lo]), np.array([hi]))
        assert most[0] == (segment.impact[lo:hi].max() if hi > lo else 0)
    best, scored = lexical.Best(10), []
    add = best.add
    best.add = lambda s, i: (scored.append(len(s)), add(s, i))
    lexical.search(segment, np.arange(n_terms), np.ones(n_terms, np.int64), best)
    whole = impact.reshape(n_terms, docs).sum(axis=0)
    assert sorted(best.scores.tolist()) == sorted(whole.tolist())[-10:]
    assert sum(scored) < docs / 4
