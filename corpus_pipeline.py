"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns the
columns of ``documents``, whatever their names; the last returns the token files' rows. Null and
empty texts go in the first stage, rows that agree in id and text are one after the second, a
null source is a source of its own, null ids come last. An empty table gives an empty result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchlytics.llm import decontaminate, languages, mixing, nearcopies, tokenfile
from pitchlytics.llm.helpers import ROW, boxed, read_table, unboxed
from pitchlytics.llm.workload import MIX_WEIGHTS, held_out, vocabulary
from pitchlytics.storage import new_folder


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language: with a letter, and nearer to a learned language than noise is
    to the nearest of all."""
    learned = languages.learn(docs.where(~held_out()))
    judged = languages.predict(boxed(docs), learned, text_col=f"{ROW}.text")
    spoken = (F.col("lang_pred") != languages.UNKNOWN) & (F.col("score") > languages.noise_bound(len(learned)))
    return unboxed(judged.where(spoken), docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, that of the least id."""
    return nearcopies.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    clean = decontaminate.without_leaks(boxed(docs), read_table(spark, sf_dir, "benchmark"), text_col=f"{ROW}.text")
    return unboxed(clean, docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: not at all, once or twice."""
    mixed = mixing.mix(boxed(docs), F.array(f"{ROW}.source"), MIX_WEIGHTS, share=1.5, passes=2, seed=42,
                       id_col=f"{ROW}.doc_id", text_col=f"{ROW}.text")
    return unboxed(mixed.select(ROW, F.explode(F.array_repeat(F.lit(1), F.col("mix_times")))), docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row in binary files, read back."""
    return tokenfile.read_tokens(tokenfile.write_tokens(docs, vocabulary()))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
    ("token_ids", token_ids),
]

#: The stages' models and files have no SQL form; they are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``; each one's rows are a written table."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = new_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
