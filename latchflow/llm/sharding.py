"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Documents are numbered in the order of (doc_id, crc, size); the permuted number p of a row gives
its shard p % shards and its slot p // shards, so shard sizes are at most one apart, slots have no
gaps, and `shard_and_slot` computes the place of any row number without the table.

Nulls: a null text has no bytes (size 1, crc 0); a null doc_id sorts first. Repeated rows each get
their own slot. An empty table gives an empty result. Columns other than doc_id and text are ignored.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latchflow.llm.common import MULTIPLIER, crc_entry, feistel, numbered, round_keys

SHARDS = 16
KEY = 2024


def shard_and_slot(row_no: np.ndarray, rows: int, shards: int = SHARDS, key: int = KEY) -> tuple:
    """Place of the given global row numbers among `rows`."""
    p = feistel(np.asarray(row_no), rows, key)
    return p % shards, p // shards


def digests(docs: DataFrame) -> DataFrame:
    """What the law and the checks need of each document, without its text."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )


def shard(docs: DataFrame, shards: int = SHARDS, key: int = KEY) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, row_no, shard and slot."""
    rows, total = numbered(digests(docs), F.col("doc_id"), F.col("text_crc32"), F.col("size"))

    @F.pandas_udf("long")
    def permuted(row_no: pd.Series) -> pd.Series:
        return pd.Series(feistel(row_no.to_numpy(), total, key))

    return (
        rows.withColumn("_p", permuted("row_no"))
        .withColumn("shard", (F.col("_p") % shards).cast("int"))
        .withColumn("slot", F.expr(f"_p div {shards}"))
        .drop("_p")
    )


def query(spark, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def oracle() -> str:
    """The permutation as a recursive query, and the checksum byte by byte."""
    left, right = "(v // b)", "(v % b)"
    lines = []
    for i, k in enumerate(round_keys(KEY)):
        lines.append(
            f"r{i + 1} AS (SELECT row_no, v, b, n, r AS l, xor(l, ((xor(r, {k})::HUGEINT * {MULTIPLIER}) % "
            f"18446744073709551616 // (18446744073709551616 // b))::BIGINT) AS r FROM r{i})"
        )
    rounds = ", ".join(lines)
    last = len(lines)
    return f"""
    WITH RECURSIVE base AS (
      SELECT doc_id, coalesce(text, '') AS t FROM documents),
    steps AS (SELECT list({crc_entry("i")} ORDER BY i) AS tab FROM range(256) s(i)),
    sized AS (
      SELECT doc_id, strlen(t)::BIGINT + 1 AS size,
        xor(list_reduce(list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda x: ('0x' || x)::BIGINT),
          lambda a, x: xor(a // 256, tab[xor(a % 256, x) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS text_crc32
      FROM base, steps),
    rows_ AS (
      SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS row_no, count(*) OVER () AS n
      FROM sized),
    walk AS (
      SELECT row_no, row_no AS v, n, (2 ** greatest(1, ceil(ceil(log2(greatest(n, 2))) / 2)))::BIGINT AS b, true AS first
      FROM rows_
      UNION ALL
      (WITH r0 AS (SELECT row_no, v, b, n, {left} AS l, {right} AS r FROM walk WHERE first OR v >= n), {rounds}
      SELECT row_no, l * b + r, n, b, false FROM r{last})),
    placed AS (SELECT row_no, v FROM walk WHERE NOT first AND v < n)
    SELECT doc_id, size, text_crc32, 'rows' AS law, (v % {SHARDS})::INT AS shard, (v // {SHARDS})::BIGINT AS slot,
      NULL::INT AS grown_shard
    FROM rows_ JOIN placed USING (row_no)
    """
