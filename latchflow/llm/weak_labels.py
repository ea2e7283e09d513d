"""Quality classifier from weak labels: labellers, expectation maximisation, hashed linear scorer.

1. LABELLERS vote good (+1), bad (-1) or not at all (0) on measurements of a text.
2. Documents are counted per vote pattern (at most 3^labellers, whatever the corpus). Expectation
   maximisation over these counts estimates the share of good documents and, per class, how often each
   labeller casts each vote.
3. Posterior labels of at most SAMPLE documents train a linear scorer of hashed word shapes and endings,
   which then scores all documents. `kept` is a score of at least KEEP.

Nulls and empty texts have no words, and get the votes and the score of such texts; a null doc_id is kept.
Repeated rows count and are scored each. An empty table gives an empty result.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latchflow.llm.common import checkpointed, sampled, slices
from latchflow.llm.hashed_linear import fit_ordinal, gathered, scores, shape_parts
from latchflow.llm.rule_ledger import measured

SAMPLE = 4096
#: Posterior from which on a document trains as good, and score from which on it is kept: a drop must be sure.
GOOD, KEEP = 0.5, 0.5
ROUNDS = 100
#: Labellers accuse at most this share of good documents: without it, a frequent fault looks like a habit of good ones.
FALSE_ALARM = 0.01

#: name -> (bad if above, good if below), for a rate; (None, x) and (x, None) vote one way only.
LABELLERS = {
    "symbols": (0.2, 0.05),
    "capitals": (0.5, 0.2),
    "exclamations": (0.2, 0.05),
    "bars": (0.2, 0.05),
    "repeats": (0.4, 0.2),
    "doubled_lines": (0.5, 0.2),
    "short": (0.1, 0.02),
    "odd_length": (4.0, 2.5),
}


def rates(text: pa.Array) -> dict[str, np.ndarray]:
    """The labellers' rates of every text."""
    m = measured(text)
    words = np.maximum(m["n_words"], 1)
    big, letters, shouts, bars = (np.zeros(len(text), dtype=np.int64) for _ in range(4))
    for part in slices(text):
        rows = np.s_[part.first : part.first + part.rows]
        upper = (part.data >= 0x41) & (part.data <= 0x5A)
        big[rows] = part.count(upper)
        letters[rows] = part.count(upper | ((part.data >= 0x61) & (part.data <= 0x7A)))
        shouts[rows] = part.count(part.data == 0x21)
        bars[rows] = part.count(part.data == 0x7C)
    return {
        "symbols": m["n_symbols"] / words,
        "capitals": big / np.maximum(letters, 1),
        "exclamations": shouts / words,
        "bars": bars / words,
        "repeats": m["n_repeat_words"] / words,
        "doubled_lines": m["n_dup_lines"] / np.maximum(m["n_lines"], 1),
        "short": 1 / (1 + m["n_words"]),
        "odd_length": np.abs(m["word_chars"] / words - 5.5),
    }


def votes(docs: DataFrame) -> DataFrame:
    """doc_id and pattern: the votes as digits to base 3 (0 bad, 1 none, 2 good), the first lowest."""

    def tasks(batches):
        for batch in batches:
            rate = rates(batch.column("text"))
            code = np.zeros(batch.num_rows, dtype=np.int64)
            for k, (name, (bad, good)) in enumerate(LABELLERS.items()):
                code += (1 - (rate[name] > bad) + (rate[name] < good)) * 3**k
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(code)], ["doc_id", "pattern"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tasks, "doc_id long, pattern long")


def digits(pattern: np.ndarray) -> np.ndarray:
    return pattern[:, None] // 3 ** np.arange(len(LABELLERS)) % 3


def expectation_maximisation(pattern: np.ndarray, count: np.ndarray, rounds: int = ROUNDS) -> dict:
    """prior (share of good), table[class, labeller, vote], posterior (of good) per pattern, accuracy."""
    cast = digits(pattern)
    table = np.empty((2, len(LABELLERS), 3))
    table[0], table[1] = (0.25, 0.15, 0.6), (0.01, 0.14, 0.85)
    prior, good = 0.8, np.zeros(len(pattern))
    spots = np.arange(len(LABELLERS))
    for _ in range(rounds):
        like = np.log(table[:, spots, cast]).sum(axis=2) if len(cast) else np.zeros((2, 0))
        odds = np.log(prior / (1 - prior)) + like[1] - like[0]
        good = 1 / (1 + np.exp(-np.clip(odds, -40, 40)))
        for k, share in enumerate((1 - good, good)):
            hits = np.stack([(share * count) @ (cast == v) for v in range(3)], axis=1) + 1
            table[k] = hits / hits.sum(axis=1, keepdims=True)
        accuse = np.minimum(table[1, :, 0], FALSE_ALARM)
        table[1, :, 1:] *= ((1 - accuse) / (1 - table[1, :, 0]))[:, None]
        table[1, :, 0] = accuse
        prior = ((good * count).sum() + 8) / (count.sum() + 10)
    right = prior * table[1, :, 2] + (1 - prior) * table[0, :, 0]
    spoken = right + prior * table[1, :, 0] + (1 - prior) * table[0, :, 2]
    return {"prior": prior, "table": table, "posterior": good, "accuracy": dict(zip(LABELLERS, right / spoken, strict=True))}


def fit(docs: DataFrame, sample: int = SAMPLE) -> tuple[dict, np.ndarray, np.ndarray]:
    """Label model, and weights and threshold of the scorer."""
    cast = checkpointed(votes(docs))
    counts = cast.groupBy("pattern").agg(F.count("*").alias("n")).orderBy("pattern").toPandas()
    model = expectation_maximisation(counts["pattern"].to_numpy(np.int64), counts["n"].to_numpy(np.int64))
    spark = docs.sparkSession
    table = spark.createDataFrame(
        [(int(p), float(g)) for p, g in zip(counts["pattern"], model["posterior"], strict=True)], "pattern long, good double"
    )
    labels = cast.where("doc_id IS NOT NULL").join(F.broadcast(table), "pattern").groupBy("doc_id").agg(
        F.max("good").alias("good")
    ).withColumn("side", F.col("good") >= GOOD)
    rows = sampled(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), labels, sample // 2, "side")
    index, value, more = gathered(rows, shape_parts, False, "good")
    weights, limit = fit_ordinal(index, value, more["good"], 1, np.where(more["good"] >= GOOD, 3.0, 1.0))
    if not len(weights.nonzero()[0]):
        limit = np.full(1, -50.0)
    return model, weights, limit


def score(docs: DataFrame, weights: np.ndarray, limit: np.ndarray) -> DataFrame:
    """doc_id, score (probability of good) and kept."""
    slim = weights.astype(np.float32)

    def tasks(batches):
        for batch in batches:
            total = scores(batch.column("text"), slim, shape_parts, False)
            good = 1 / (1 + np.exp(np.clip(limit[0] - total, -40, 40)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(good), pa.array(good >= KEEP)], ["doc_id", "score", "kept"]
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        tasks, "doc_id long, score double, kept boolean"
    )


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    _, weights, limit = fit(docs)
    return score(docs, weights, limit)
