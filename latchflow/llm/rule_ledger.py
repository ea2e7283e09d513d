"""Quality rules as a bitmask ledger.

Every rule is measured and evaluated once per document: `ledger` stores the measurements and one
failure bit per rule. A policy is a named, versioned set of bits; applying one is `fail_bits & mask`.
Ablations (how many documents a policy would get back without one of its rules) come from the counts
per failure mask, of which there are at most 2^rules whatever the number of documents.

Nulls: a null text has no words, and like any text below ten words fails the base; a null doc_id is
kept. Repeated rows are judged each. An empty table gives empty results. Other columns are ignored.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latchflow.llm.common import IN_WORD, mix, owners, slices, windows

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words")
WINDOW = 5

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_CONTINUED = np.zeros(256, dtype=bool)
_CONTINUED[0x80:0xC0] = True


def measured(text: pa.Array) -> dict[str, np.ndarray]:
    """The measurements of every text of a column."""
    out = {name: np.zeros(len(text), dtype=np.int64) for name in MEASURES}
    for part in slices(text):
        rows = np.s_[part.first : part.first + part.rows]
        starts, ends, borders = part.words()
        hashed = part.hashes(starts, ends)
        out["n_words"][rows] = np.diff(borders)
        out["word_chars"][rows] = part.count(IN_WORD[part.data] & ~_CONTINUED[part.data])
        out["n_symbols"][rows] = part.count(_SYMBOL[part.data])
        out["n_repeat_words"][rows] = _repeated(hashed, borders)
        out["n_lines"][rows], out["n_dup_lines"][rows] = _lines(part, starts)
    return out


def _repeated(hashed: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Words inside windows that occur twice or more in their row."""
    keys, first = windows(hashed, borders, WINDOW)
    keys = mix(keys ^ mix(owners(borders)[first].astype(np.uint64)))
    ordered = np.sort(keys)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    covered = np.zeros(len(hashed) + 1, dtype=np.int64)
    if len(twice):
        place = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
        found = first[twice[place] == keys]
        np.add.at(covered, found, 1)
        np.add.at(covered, found + WINDOW, -1)
    total = np.zeros(len(hashed) + 1, dtype=np.int64)
    np.cumsum(np.cumsum(covered)[:-1] > 0, out=total[1:])
    return np.diff(total[borders])


def _lines(part, word_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word per row, and those of them equal to an earlier one."""
    breaks = np.flatnonzero(part.data == 0x0A)
    starts = np.sort(np.concatenate([part.offsets[:-1], breaks + 1]), kind="stable")
    row = np.searchsorted(part.offsets, starts, side="right") - 1
    row[row >= part.rows] = part.rows - 1
    ends = np.minimum(np.append(starts[1:], len(part.data)), part.offsets[row + 1])
    at_break = np.zeros(len(part.data) + 1, dtype=bool)
    at_break[breaks + 1] = True
    following = np.append(starts[1:], len(part.data))
    cut = (following <= part.offsets[row + 1]) & at_break[following] & (following > starts)
    ends = ends - cut
    full = np.searchsorted(word_starts, starts) < np.searchsorted(word_starts, ends)
    starts, ends, row = starts[full], ends[full], row[full]
    keys = mix(part.hashes(starts, ends) ^ mix(row.astype(np.uint64)))
    firsts = np.unique(keys, return_index=True)[1]
    lines = np.bincount(row, minlength=part.rows)
    return lines, lines - np.bincount(row[firsts], minlength=part.rows)


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and the measurements, one row per document, in one pass without a shuffle."""

    def tasks(batches):
        for batch in batches:
            found = measured(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(found[m]) for m in MEASURES)], ["doc_id", *MEASURES]
            )

    schema = "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tasks, schema)


#: name -> failure, in the order of the bits. Rates are compared as whole products.
RULE_SQL = {
    "too_short": "n_words < 10",
    "repeated_windows": "100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > 3 * n_words",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 25 * n_words",
    "repeated_lines": "n_lines >= 4 AND 10 * n_dup_lines > 5 * n_lines",
    "very_long": "n_words > 1000000",
}
BIT = {name: 1 << i for i, name in enumerate(RULE_SQL)}


def mask(*names: str) -> int:
    return sum(BIT[n] for n in names)


BASE = mask("too_short", "repeated_windows")
#: version -> bits that reject a document. Later versions never change earlier ones.
POLICIES = {
    "v1": BASE,
    "v2": mask("too_short", "repeated_windows", "symbols", "short_words", "long_words", "repeated_lines"),
    "v3": mask(*RULE_SQL),
}
CURRENT = "v2"


def ledger(docs: DataFrame) -> DataFrame:
    """Measurements and `fail_bits`: bit i is set where rule i fails."""
    bits = [f"IF({sql}, {BIT[name]}, 0)" for name, sql in RULE_SQL.items()]
    return measure(docs).withColumn("fail_bits", F.expr(" | ".join(bits)).cast("int"))


def apply_policies(rows: DataFrame, policies: dict[str, int] = POLICIES) -> DataFrame:
    """One boolean column kept_<version> per policy, from the stored bits alone."""
    return rows.withColumns(
        {f"kept_{v}": F.col("fail_bits").bitwiseAND(F.lit(m)) == 0 for v, m in policies.items()}
    )


def ablations(rows: DataFrame, policies: dict[str, int] = POLICIES) -> DataFrame:
    """policy, rule, n_failed (documents failing the rule), n_rejected (by the policy), n_only.

    n_only counts the documents rejected for this rule alone: dropping it would keep them.
    """
    masks = rows.groupBy("fail_bits").agg(F.count("*").alias("n"))
    cells = [(v, name, m, BIT[name]) for v, m in policies.items() for name in BIT if m & BIT[name]]
    cells_df = rows.sparkSession.createDataFrame(cells, "policy string, rule string, mask int, bit int")
    hit = F.col("fail_bits").bitwiseAND(F.col("mask"))
    per_mask = masks.withColumn("cell", F.explode(F.array(*(
        F.struct(F.lit(v).alias("policy"), F.lit(name).alias("rule"), F.lit(m).alias("mask"), F.lit(b).alias("bit"))
        for v, name, m, b in cells
    )))).select("fail_bits", "n", "cell.*")
    counted = per_mask.groupBy("policy", "rule").agg(
        F.sum(F.when(F.col("fail_bits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(hit != 0, F.col("n")).otherwise(0)).alias("n_rejected"),
        F.sum(F.when(hit == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only"),
    )
    return cells_df.select("policy", "rule").join(F.broadcast(counted), ["policy", "rule"], "left").fillna(
        0, ["n_failed", "n_rejected", "n_only"]
    )


def query(spark, sf_dir: str) -> DataFrame:
    rows = apply_policies(ledger(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "fail_bits",
        (F.col("fail_bits").bitwiseAND(F.lit(BASE)) != 0).alias("base_failed"),
        *(F.col(f"kept_{v}") for v in POLICIES),
        F.col(f"kept_{CURRENT}").alias("kept"),
    )


def oracle() -> str:
    bits = " + ".join(f"CASE WHEN {sql} THEN {BIT[name]} ELSE 0 END" for name, sql in RULE_SQL.items())
    kept = ", ".join(f"fail_bits & {m} = 0 AS kept_{v}" for v, m in POLICIES.items())
    return rf"""
    WITH base AS (
      SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
    split AS (
      SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM base),
    runs AS (
      SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4] AS g
      FROM split, unnest(range(1, len(w) - 3)) u(i)),
    twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM runs) WHERE n > 1),
    covered AS (
      SELECT r, count(DISTINCT i + k) AS n FROM twice, range(5) s(k) GROUP BY r),
    measured AS (
      SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines)::BIGINT AS n_lines,
        coalesce(n, 0)::BIGINT AS n_repeat_words
      FROM split LEFT JOIN covered USING (r)),
    judged AS (SELECT *, ({bits})::INT AS fail_bits FROM measured)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits,
      fail_bits & {BASE} <> 0 AS base_failed, {kept}, fail_bits & {POLICIES[CURRENT]} = 0 AS kept
    FROM judged
    """
