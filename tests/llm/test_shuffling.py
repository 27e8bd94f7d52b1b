import zlib

import numpy as np
from pyspark.sql import functions as F

from pitchlytics.llm import shuffling as S
from pitchlytics.llm.helpers import mixed64
from pitchlytics.llm.workload import op2_shards


def slots(df, id_col="doc_id"):
    return {r["slot"]: r[id_col] for r in df.orderBy("shard", "slot").collect()}


def by_shard(df):
    out = {}
    for r in df.select("shard", "slot", "doc_id").collect():
        out.setdefault(r["shard"], []).append((r["slot"], r["doc_id"]))
    return {k: [d for _, d in sorted(v)] for k, v in out.items()}


def test_every_row_once_counts_equal_and_slots_gapless(docs):
    texts = [None, "", "same", "same"] + [f"text {i}" for i in range(333)]
    got = S.write_shards(docs(texts, extra=("shard", "slot", "bucket", "row")), 7, seed=3, bucket_bytes=700)
    rows = got.select("shard", "slot", "doc_id", "text").collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(len(texts)))
    assert all(r["text"] == texts[r["doc_id"]] for r in rows)
    sizes = {}
    for r in rows:
        sizes.setdefault(r["shard"], []).append(r["slot"])
    assert set(sizes) == set(range(7)) and max(map(len, sizes.values())) - min(map(len, sizes.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in sizes.values())
    assert set(got.columns) == {"doc_id", "text", "lang", "source", "n_chars", "shard", "slot", "bucket", "row"}


def test_reruns_agree_seeds_differ_and_order_is_mixed(docs):
    table = docs([f"t{i}" for i in range(400)])
    once, again = (by_shard(S.shuffle_rows(table.repartition(n), 4, seed=1, bucket_bytes=300)) for n in (3, 11))
    other = by_shard(S.shuffle_rows(table, 4, seed=2, bucket_bytes=300))
    assert once == again != other
    order = [d for s in sorted(once) for d in once[s]]
    inversions = sum(a > b for i, a in enumerate(order) for b in order[i + 1:]) / (400 * 399 / 2)
    assert 0.4 < inversions < 0.6


def test_null_and_repeated_ids(spark):
    table = spark.createDataFrame([(None, f"t{i}") for i in range(50)] + [(7, "x")] * 50, "doc_id long, text string")
    got = S.shuffle_rows(table, 16, bucket_bytes=64)
    assert got.count() == 100
    assert got.groupBy("shard").count().agg(F.max("count") - F.min("count")).first()[0] <= 1
    # Null ids with other texts lie in many buckets.
    assert got.where("doc_id IS NULL").select("shard").distinct().count() > 8


def test_fewer_rows_than_shards_and_none(docs):
    assert sorted(r["slot"] for r in S.write_shards(docs(["a", "b"]), 16).collect()) == [0, 0]
    empty = S.write_shards(docs([]), 16)
    assert empty.collect() == [] and "shard" in empty.columns


def test_query_digests(spark, docs, tmp_path):
    texts = ["é", None, "", "abc"]
    docs(texts).write.parquet(f"{tmp_path}/documents.parquet")
    for r in op2_shards(spark, str(tmp_path)).collect():
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "rows", None)


def brute(rows, ties, shards, seed, bucket_bytes):
    """Both passes as plain loops: (shard, slot) of the rows in their order, equal rows alike."""
    size = {i: len((t or "").encode()) + 1 for i, (_, t) in enumerate(rows)}
    n_buckets = max(1, -(-sum(size.values()) // bucket_bytes))
    alike = {}
    for i, tie in enumerate(ties):
        alike.setdefault(tie, []).append(i)
    buckets = [[] for _ in range(n_buckets)]
    for tie, members in alike.items():
        spread = len(members) > 1 and sum(size[i] for i in members) >= max(1, bucket_bytes // 4)
        for turn, i in enumerate(members):
            buckets[(tie + (turn if spread else 0)) % n_buckets].append(i)
    order = []
    for b, members in enumerate(buckets):
        if members:
            members.sort(key=lambda i: (rows[i][0] is None, rows[i][0] or 0, ties[i]))
            own = int(mixed64(np.array([b], np.uint64), seed)[0])
            order += [members[i] for i in np.random.Generator(np.random.PCG64(own)).permutation(len(members))]
    small, more = divmod(len(rows), shards)
    counts = [small + (s < more) for s in range(shards)]
    places = [(s, slot) for s, c in enumerate(counts) for slot in range(c)]
    return {place: rows[i] for place, i in zip(places, order, strict=True)}


def test_equals_the_two_passes_in_plain_loops(spark):
    rows = [(i, f"text {i}" * (i % 7)) for i in range(200)] + [(None, None)] * 3 + [(5, "hot")] * 150 + [(5, "warm")] * 2
    table = spark.createDataFrame(rows, "doc_id long, text string")
    ties = [r[0] for r in table.select(F.xxhash64(F.lit(9), "doc_id", "text", "doc_id", "text")).collect()]
    got = {(r["shard"], r["slot"]): (r["doc_id"], r["text"]) for r in S.shuffle_rows(table.repartition(3), 7, seed=9, bucket_bytes=400).collect()}
    assert got == brute(rows, ties, 7, 9, 400)


def test_copies_of_a_row_spread_over_buckets(spark):
    table = spark.range(20_000).select(F.when(F.col("id") < 15_000, -1).otherwise(F.col("id")).alias("doc_id"), F.lit("some text").alias("text"))
    got = S.shuffle_rows(table, 30, bucket_bytes=20_000 * 10 // 30)
    shares = got.groupBy("shard").agg(F.count_if(F.col("doc_id") == -1).alias("hot"), F.count(F.lit(1)).alias("n")).collect()
    assert sum(r["hot"] for r in shares) == 15_000 and sum(r["n"] for r in shares) == 20_000
    assert all(0.6 < r["hot"] / r["n"] < 0.9 for r in shares)
