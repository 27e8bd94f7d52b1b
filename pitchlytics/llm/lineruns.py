"""Line de-duplication over levelled sorted runs of line hashes.

A run is a table of line hashes and the number of documents that hold them, bucketed and sorted
by hash. Every batch of documents is merge-anti-joined with the runs: a line that a run already
knows to be common needs no more counting. What is left becomes a run of its own. When a level
has ``fan`` runs, they are merged into one run of the next level, so after n batches there are
about fan * log(n) runs. All runs share their buckets: joins read them as they lie, and only the
batch is shuffled.

A line's key is the line without white space at both ends, A to Z in lower case; its hash has
128 bits. Empty keys are never common. Lines whose key stands in at least ``min_docs`` documents
lose all their copies. A row is a document: repeated rows count each; a line that stands twice in
a document counts once. A null or empty text is one empty line. Very long texts are split whole,
the result of a document depends on its own text and on the common lines alone. An empty table
gives an empty result. Other columns are ignored, whatever their names.

At scale: lines are counted within tasks before any shuffle, so a line in a third of all
documents reaches its bucket as one row per task and batch. The common lines meet the hashes of
all lines in a plain join, which Spark broadcasts if they are few and else splits where keys are
skewed. Texts are shuffled once at most, by their hash, to meet the places of their dropped lines.
Everything is built-in functions.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchlytics.storage import new_folder, settle

#: Stripped at both ends of a line.
BLANKS = " \t\n\x0b\x0c\r"
HASH = ["h1", "h2"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """Without white space at both ends, A to Z in lower case. Other letters stay, so texts
    with any take a longer way."""
    bare = F.btrim(line, F.lit(BLANKS))
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def hashed(value: Column, names: list[str] = HASH) -> list[Column]:
    """128 bits in two numbers."""
    return [F.xxhash64(value).alias(names[0]), F.xxhash64(F.lit(names[1]), value).alias(names[1])]


def batch_counts(docs: DataFrame, text_col: str = "text", min_chars: int = 1, by: list[str] | None = None) -> DataFrame:
    """Number of documents per line hash, per value of ``by`` as well."""
    by = by or []
    keys = F.array_distinct(F.transform(lines_of(F.col(text_col)), line_key))
    lines = docs.select(*by, F.explode(keys).alias("key")).where(F.length("key") >= max(1, min_chars))
    return lines.select(*by, *hashed(F.col("key"))).groupBy(*by, *HASH).agg(F.count(F.lit(1)).alias("n"))


class LineRuns:
    """Runs of line hashes by level. They live in the shared folder and, by name, in the
    session's catalog, which keeps their buckets; ``drop`` forgets them."""

    def __init__(self, spark: SparkSession, min_docs: int, fan: int = 4, buckets: int | None = None):
        self.spark, self.min_docs, self.fan = spark, min_docs, fan
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]
        self.paths: dict[str, str] = {}

    def tables(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def _write(self, counts: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        self.paths[name] = new_folder(self.spark, name)
        sorted_run = counts.write.bucketBy(self.buckets, *HASH).sortBy(*HASH).format("parquet")
        sorted_run.option("path", self.paths[name]).saveAsTable(name)
        return name

    def _without(self, counts: DataFrame, least: int) -> DataFrame:
        """The batch's hashes that no run counts ``least`` times: a merge join with each run."""
        known = [t.where(F.col("n") >= least).hint("merge") for t in self.tables()]
        return reduce(lambda rest, run: rest.join(run, HASH, "left_anti"), known, counts)

    def unseen(self, counts: DataFrame) -> DataFrame:
        """Hashes of a batch that no earlier batch has."""
        return self._without(counts, 1)

    def add(self, counts: DataFrame) -> None:
        """Add a batch (``batch_counts``) as a run; merge the levels that are full."""
        self.levels[0].append(self._write(self._without(counts, self.min_docs)))
        for depth in range(len(self.levels)):
            if len(self.levels[depth]) >= self.fan:
                self._merge(depth)

    def _merge(self, depth: int) -> None:
        if depth + 1 == len(self.levels):
            self.levels.append([])
        full = self.levels[depth]
        self.levels[depth + 1].append(self._write(self._summed(full)))
        self.levels[depth] = []
        self._forget(full)

    def _summed(self, names: list[str]) -> DataFrame:
        """One row per hash. The files are read without their buckets: a union of bucketed
        tables passes for bucketed in the planner, but is read file by file."""
        runs = self.spark.read.schema("h1 long, h2 long, n long").parquet(*[self.paths[name] for name in names])
        return runs.groupBy(*HASH).agg(F.sum("n").alias("n"))

    def common(self) -> DataFrame:
        """Hashes of the lines that stand in at least ``min_docs`` documents of all batches."""
        names = [name for level in self.levels for name in level]
        return self._summed(names).where(F.col("n") >= self.min_docs).select(*HASH)

    def drop(self) -> None:
        self._forget([name for level in self.levels for name in level])
        self.levels = [[]]

    def _forget(self, names: list[str]) -> None:
        """Out of the catalog; the files are of no more use, and go."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            self.spark.sql(f"DROP TABLE {name}")
            path = jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
            path.getFileSystem(conf).delete(path, True)


def common_lines(docs: DataFrame, min_docs: int, *, text_col: str = "text", min_chars: int = 1, batches: int = 8, fan: int = 4) -> DataFrame:
    """Hashes of the common lines of ``docs``, taken in ``batches`` batches by the hash of the
    text, written."""
    spark = docs.sparkSession
    dealt = docs.select(F.pmod(F.xxhash64(F.col(text_col)), F.lit(batches)).cast("int").alias("batch"), F.col(text_col).alias("text"))
    path = new_folder(spark, "line-counts")
    batch_counts(dealt, "text", min_chars, ["batch"]).write.partitionBy("batch").parquet(path)
    counts = spark.read.schema("h1 long, h2 long, n long, batch int").parquet(path)
    runs = LineRuns(spark, min_docs, fan)
    for i in range(batches):
        runs.add(counts.where(F.col("batch") == i).drop("batch"))
    found = settle(runs.common(), "common-lines")
    runs.drop()
    return found


def without_common_lines(
    docs: DataFrame, min_docs: int, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 1, batches: int = 8, fan: int = 4,
) -> DataFrame:
    """Per document its id, ``n_lines``, ``n_dropped`` and ``kept``, the text of its other lines."""
    key = ["t1", "t2"]
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    common = common_lines(docs, min_docs, text_col=text_col, min_chars=min_chars, batches=batches, fan=fan)
    named = texts.select("id", "text", *hashed(F.col("text"), key))
    lines = named.select(*key, F.posexplode(F.transform(lines_of(F.col("text")), line_key)).alias("at", "key")).where(F.length("key") >= max(1, min_chars))
    hits = lines.select(*key, "at", *hashed(F.col("key"))).join(common, HASH, "left_semi")
    # A set: copies of a text have the same places.
    drops = settle(hits.groupBy(*key).agg(F.collect_set("at").alias("dropped")), "dropped-lines")
    met = named.join(drops, key, "left").withColumn("lines", lines_of(F.col("text")))
    others = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("dropped"))
    kept = F.array_join(F.transform(others, lambda i: F.get("lines", i)), "\n")
    return met.select(
        F.col("id").alias(id_col), F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("dropped").isNull(), F.col("text")).otherwise(kept).alias("kept"))
