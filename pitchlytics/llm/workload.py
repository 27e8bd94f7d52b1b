"""The registered queries of this subpackage over the driver tables, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchlytics.llm import (
    credentials, decontaminate, languages, lexical, licences, lineruns, merkle, mixing, nearcopies, orchard, shuffling, tokenfile, warc,
)
from pitchlytics.llm.helpers import read_table, whole_text


#: Weights of the sources in order, repeating.
MIX_WEIGHTS = (5, 2, 1)


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def held_out(id_col: str = "doc_id"):
    """A quarter of the documents by a checksum of their id; a null id counts as empty."""
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return F.crc32(F.encode(key, "UTF-8")) % 4 == 2


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed patterns and noise-like strings in all documents."""
    found = credentials.find_secrets(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_random")


def op2_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents shuffled, written in 16 shards and read back."""
    written = shuffling.write_shards(read_table(spark, sf_dir, "documents"), 16, seed=42)
    return written.select(
        "doc_id", shuffling.size_of().alias("size"), F.crc32(F.encode(whole_text(), "UTF-8")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents, written as patched frame-of-reference blocks and read back."""
    return tokenfile.read_tokens(tokenfile.write_tokens(read_table(spark, sf_dir, "documents"), vocabulary()))


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    mixed = mixing.mix(read_table(spark, sf_dir, "documents"), F.array("source"), MIX_WEIGHTS, share=1.5, passes=2, seed=42)
    return mixed.select(
        "doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"), (F.col("mix_size") * F.col("mix_times")).alias("taken"))


def op5_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of near copies of every document."""
    return nearcopies.classed(read_table(spark, sf_dir, "documents"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents, of their edited texts and how like their neighbours are."""
    return merkle.compare_with_next(read_table(spark, sf_dir, "documents"))


def op7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of all documents that hold a benchmark item."""
    return decontaminate.find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op8_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from three quarters of them."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out().alias("held_out"))
    judged = languages.predict(docs, languages.learn(docs.where("NOT held_out")))
    return judged.select("doc_id", "held_out", "lang_pred", "score")


def file_path(id_col: str = "doc_id"):
    """A place for each document in a tree of three levels by its id, a hundred to a folder.
    The first of ten thousand, of a thousand and of a hundred are their folder's licence files."""
    id_ = F.col(id_col)
    a, b, c = (F.concat(F.lit(x), F.floor(id_ / n).cast("string")) for x, n in (("a", 10_000), ("b", 1_000), ("c", 100)))
    file = F.concat(F.coalesce("source", F.lit("none")), F.lit("-"), id_.cast("string"), F.lit(".txt"))
    licence = F.lit("LICENSE")
    return (
        F.when(id_ % 10_000 == 0, F.concat_ws("/", a, licence)).when(id_ % 1_000 == 0, F.concat_ws("/", a, b, licence))
        .when(id_ % 100 == 0, F.concat_ws("/", a, b, c, licence)).when(id_.isNotNull(), F.concat_ws("/", a, b, c, file))
    )


def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Own and inherited licences of all documents, as files in a tree."""
    files = read_table(spark, sf_dir, "documents").select("doc_id", file_path().alias("path"), "text")
    return licences.scan_licences(files)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as WARC records, read back through the index."""
    index = warc.write_archives(read_table(spark, sf_dir, "pages"))
    return warc.read_records(index, with_payload=False).select(
        F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen clusters of all vectors of 64 components, after three rounds."""
    found = orchard.clustered(read_table(spark, sf_dir, "embeddings"), clusters=16, rounds=3, dim=64, scale=64, seed=1)
    return found.drop("centroid")


def op12_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that stand in ten documents or more."""
    kept = lineruns.without_common_lines(read_table(spark, sf_dir, "documents"), 10, min_chars=1)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty best of all documents for each benchmark item."""
    return lexical.search_all(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), 50)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secrets": op1_secrets,
    "op2_shards": op2_shards,
    "op3_token_ids": op3_token_ids,
    "op4_mix": op4_mix,
    "op5_near_copies": op5_near_copies,
    "op6_fingerprints": op6_fingerprints,
    "op7_leaks": op7_leaks,
    "op8_languages": op8_languages,
    "op9_licences": op9_licences,
    "op10_warc": op10_warc,
    "op11_clusters": op11_clusters,
    "op12_lines": op12_lines,
    "op13_search": op13_search,
}

_UPPER, _LOWER = lineruns.UPPER, lineruns.LOWER


def _clusters_sql(clusters: int, rounds: int, dim: int, scale: int, seed: int) -> str:
    """Distances to all centroids, round by round."""
    steps = [f"""
        v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dim} AND len(embedding) = {dim}),
        c0 AS (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v
            FROM (SELECT sha256('{seed}:' || vec_id) AS h, v FROM v ORDER BY h, v LIMIT {clusters}))"""]
    for i in range(rounds + 1):
        steps.append(f"""
        a{i} AS (SELECT r, vec_id, v, c, d FROM (
            SELECT v.r, v.vec_id, v.v, c.c, list_sum(list_transform(list_zip(v.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
            FROM v, c{i} AS c) QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)""")
        if i < rounds:
            steps.append(f"""
        m{i} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM (
            SELECT c, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, unnest(range({dim})) AS i FROM a{i}) GROUP BY c, i) GROUP BY c),
        c{i + 1} AS (SELECT c.c, coalesce(m.v, c.v) AS v FROM c{i} AS c LEFT JOIN m{i} AS m ON c.c = m.c)""")
    return f"""
        WITH {",".join(steps)}
        SELECT a.vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(a.d AS BIGINT) AS distance,
            CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia,
            sha256(array_to_string(c.v, ',')) AS centroid_sha256
        FROM a{rounds} AS a JOIN c{rounds} AS c ON a.c = c.c
    """


ORACLE: dict[str, str] = {
    "op11_clusters": _clusters_sql(16, 3, 64, 64, 1),
    "op12_lines": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        l AS (SELECT r, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM d),
        k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_LOWER}') AS key FROM l),
        c AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10)
        SELECT doc_id, count(*) AS n_lines, count(c.key) AS n_dropped,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE c.key IS NULL), '')) AS kept_sha256
        FROM k LEFT JOIN c ON k.key = c.key GROUP BY r, doc_id
    """,
    "op13_search": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id,
            regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
        s AS (SELECT count(*) AS docs, CAST(sum(len(terms)) AS BIGINT) AS words FROM d WHERE len(terms) > 0),
        tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM d) GROUP BY r, term),
        df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
        q AS (SELECT row_number() OVER () AS q, item_id,
            list_distinct(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS terms FROM benchmark),
        w AS (SELECT q, item_id, t.term, CAST(floor(1000 * ln((2 * s.docs + 2) / (2 * df.df + 1))) AS BIGINT) AS w
            FROM (SELECT q, item_id, unnest(terms) AS term FROM q) AS t JOIN df ON df.term = t.term, s),
        m AS (SELECT r, doc_id, 100 - 50 + (50 * len(terms) * s.docs) // s.words AS m FROM d, s),
        f AS (SELECT w.q, w.item_id, m.r, m.doc_id, CAST(sum(w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 20 * m.m))) AS BIGINT) AS score
            FROM w JOIN tf ON tf.term = w.term JOIN m ON m.r = tf.r GROUP BY w.q, w.item_id, m.r, m.doc_id)
        SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
            SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM f WHERE score > 0) WHERE rank <= 50
    """,
    # Base32 of SHA-1: four letters from every five hex digits.
    "op10_warc": """
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
        f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
        SELECT page_id, payload_bytes,
            array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                1 + ((CAST('0x' || substr(p.h, 1 + 5 * (i // 4), 5) AS INTEGER) >> (15 - 5 * (i % 4))) & 31)::INTEGER, 1)), '') AS payload_digest,
            CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
        FROM p JOIN f ON p.h = f.h
    """,
}
