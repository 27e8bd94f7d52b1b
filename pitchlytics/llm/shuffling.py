"""Two-pass external shuffle of a whole table into shards.

Pass one scatters rows uniformly into buckets by a seeded hash of all their columns; there are
as many buckets as make one fit in memory. Rows that agree in all columns and together fill a
quarter of a bucket or more are added up first, and their copies are dealt evenly over all
buckets, from one on that the hash chooses. Pass two sorts a bucket canonically, shuffles it by
Fisher-Yates (``Generator.permutation``) under a seed of its own and writes it. The buckets one
after the other are the shuffled order, which is cut into shards whose counts differ by at
most one. A bucket's rows cross the network once.

Nulls are hashed as such. Columns that hold maps are not hashed; many rows that agree in all but
them raise. A row of any length is moved whole, so one larger than a bucket makes a larger bucket. An empty table gives an empty result of the same
columns. The result has all input columns; input columns named like the added ones are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitchlytics.llm.helpers import hashable, mixed64
from pitchlytics.storage import new_folder, settle

#: Bytes of text of a bucket: what a task of pass two holds, a few times over.
BUCKET_BYTES = 32 << 20


def size_of(text: str = "text"):
    """Bytes of the text in UTF-8 and one for its end."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def shuffle_rows(docs: DataFrame, shards: int, seed: int = 0, *, id_col: str = "doc_id", text_col: str = "text",
                 bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``docs`` with ``shard`` and ``slot``, each shard's rows in slots from 0 without a gap."""
    rows = docs.drop("shard", "slot")
    row = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    hashed = [F.col(f"`{f.name}`") for f in rows.schema if hashable(f.dataType)]
    tie = F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col), *hashed)
    sized = settle(rows.groupBy(tie.alias("tie")).agg(F.count(F.lit(1)).alias("n"), F.sum(size_of(text_col)).alias("size")), "rows")
    total = sized.agg(F.sum("n").alias("n"), F.sum("size").alias("size")).first()
    n, buckets = total["n"] or 0, max(1, -(-(total["size"] or 0) // bucket_bytes))
    # At most four per bucket.
    hot = settle(sized.where((F.col("n") > 1) & (F.col("size") >= max(1, bucket_bytes // 4))).select("tie", "n"), "repeated")
    some_hot = not hot.isEmpty()

    def home(of: Column) -> Column:
        return F.pmod(of, F.lit(buckets))

    scattered = rows.select(F.col(id_col).alias("id"), tie.alias("tie"), home(tie).alias("bucket"), F.lit(1).cast("long").alias("times"), row.alias("row"))
    dealt = sized.select(home(F.col("tie")).alias("bucket"), "n")
    if some_hot:
        each = F.explode(F.expr(f"sequence(0L, least(n, {buckets}L) - 1)"))
        times = F.expr(f"n div {buckets}L") + F.when(F.col("turn") < F.col("n") % buckets, 1).otherwise(0)
        place = F.pmod(home(F.col("tie")) + F.col("turn"), F.lit(buckets))
        copies = (
            scattered.join(hot.select("tie"), "tie", "left_semi").groupBy("id", "tie", "row").agg(F.count(F.lit(1)).alias("n"))
            .withColumn("turn", each).select("id", "tie", place.alias("bucket"), times.alias("times"), "row"))
        scattered = scattered.join(hot.select("tie"), "tie", "left_anti").select("id", "tie", "bucket", "times", "row").unionByName(copies)
        dealt = sized.join(hot.select("tie"), "tie", "left_anti").select(home(F.col("tie")).alias("bucket"), "n").unionByName(
            hot.withColumn("turn", each).select(place.alias("bucket"), times.alias("n")))

    # One row per bucket: table size over bucket size, small beside the table.
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = settle(dealt.groupBy("bucket").agg(F.sum("n").alias("n")), "buckets")
    base = counts.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    schema = T.StructType([T.StructField("place", T.LongType()), T.StructField("row", scattered.schema["row"].dataType)])

    def shuffled(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("id", "ascending"), ("tie", "ascending")])
        table = table.take(pa.array(np.repeat(np.arange(table.num_rows), table.column("times").to_numpy())))
        own = mixed64(np.array([key[0].as_py()], np.uint64), seed)[0]
        order = np.random.Generator(np.random.PCG64(int(own))).permutation(table.num_rows)
        start = table.column("base")[0].as_py()
        place = pa.array(np.arange(start, start + table.num_rows), pa.int64())
        return pa.table([place, table.column("row").take(pa.array(order))], ["place", "row"])

    whole = scattered.join(base, "bucket").groupBy("bucket").applyInArrow(shuffled, schema)
    # The first n % shards shards have one row more.
    small, more = divmod(n, shards)
    edge = more * (small + 1)
    place = F.col("place")
    late = (place - edge) / F.lit(max(small, 1))
    shard = F.when(place < edge, F.floor(place / (small + 1))).otherwise(more + F.floor(late)).cast("int")
    first = shard.cast("long") * small + F.least(shard, F.lit(more))
    return whole.select("row.*", shard.alias("shard"), (place - first).alias("slot"))


def write_shards(docs: DataFrame, shards: int, seed: int = 0, folder: str | None = None, **kind) -> DataFrame:
    """Write the shuffled rows as Parquet, a folder per shard and rows by slot within a file,
    and return the written table."""
    folder = folder or new_folder(docs.sparkSession, "shards")
    shuffled = shuffle_rows(docs, shards, seed, **kind)
    shuffled.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(folder)
    return docs.sparkSession.read.schema(shuffled.schema).parquet(folder)
