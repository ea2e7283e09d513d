"""The corpus pipeline: documents without toxic ones, copies and benchmark passages, mixed and encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and reread
as the next stage's docs. All but the last return the columns of `documents`.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latchflow.llm import decontaminate, jaccard_join, mixing, token_files, toxicity
from latchflow.llm.common import numbered
from latchflow.plans.session import fresh_dir


def _packed(docs: DataFrame, *own: str) -> DataFrame:
    """The columns that a stage works on, and the whole row as `_row`: other columns meet none of an operator's."""
    return docs.select(*own, F.struct(*docs.columns).alias("_row"))


def clean_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model, fitted on the labels, does not reject."""
    model = toxicity.fit(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    # other columns go by numbers meanwhile, so that none meets a result's name
    names = {c: c if c in ("doc_id", "text") else f"_c{i}" for i, c in enumerate(docs.columns)}
    graded = toxicity.grade(docs.select(*(F.col(c).alias(n) for c, n in names.items())), model, *names.values())
    return graded.where(~F.col("toxic")).select(*(F.col(n).alias(c) for c, n in names.items()))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity of 0.8 or more.

    Each distinct (doc_id, text) is a document of its own, whether its doc_id is null, shared or neither. Of a
    group, the one with the smallest doc_id stays (null last), and of these the one whose text sorts first; of rows
    alike in both, the smallest. Where every row has a doc_id of its own, these are the keys, and texts are not moved.
    """
    named = docs.select(F.col("doc_id").cast("long").alias("_id"))
    shared = named.groupBy("_id").count().where("_id IS NULL OR count > 1")
    if shared.isEmpty():
        groups = jaccard_join.join(docs.select("doc_id", "text"), words=5, percent=80)
        first = groups.where("doc_id = component_id").select(F.col("doc_id").alias("_key"))
        keyed = _packed(docs, F.col("doc_id").cast("long").alias("_key"))
    else:
        rows = docs.groupBy(F.col("doc_id").cast("long").alias("_id"), F.col("text").alias("_text")).agg(
            F.min(F.struct(*docs.columns)).alias("_row"))
        keyed, _ = numbered(rows, F.col("_id").asc_nulls_last(), F.col("_text").asc_nulls_last(), name="_key")
        groups = jaccard_join.join(keyed.select(F.col("_key").alias("doc_id"), F.col("_text").alias("text")), words=5, percent=80)
        first = groups.where("doc_id = component_id").select(F.col("doc_id").alias("_key"))
    return keyed.join(first, "_key", "left_semi").select("_row.*")


def unseen_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; each distinct (doc_id, text) is judged by itself."""
    key = F.concat_ws(":", F.col("doc_id").cast("string"), F.sha2("text", 256))
    keyed = _packed(docs, "text", key.alias("_key"))
    pairs = decontaminate.leaks(keyed.select("_key", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "_key")
    return keyed.join(pairs.select("_key").distinct(), "_key", "left_anti").select("_row.*")


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix draws them, 0 to 2 times, shuffled inside each shard."""
    return mixing.draws(docs).select("_row.*")


def encoded_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document of the mix, what the coded token files hold of it."""
    return token_files.encode(docs).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [
    ("clean_documents", clean_documents),
    ("distinct_documents", distinct_documents),
    ("unseen_documents", unseen_documents),
    ("mixed_documents", mixed_documents),
    ("encoded_documents", encoded_documents),
]

#: Training, drawing and coding have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents below sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_dir(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
