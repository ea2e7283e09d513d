"""Toxicity as severity grades by cumulative-link ordinal regression.

Labels say toxic or not. Grades come from a bounded sample of them: 0 for clean documents, 1 to 3 for
toxic ones, by thirds of the share of their features that stand mainly in toxic documents. The model
P(grade >= k) = sigmoid(w x - threshold_k) shares the weights w of hashed words and word beginnings among the
ordered thresholds. `expected_severity` is the sum of these probabilities; a document is toxic if grade 1
or more has a probability above SURE.

SAMPLE bounds the labelled documents per class used for fitting. Nulls and empty texts have no features,
grade 0, and are not toxic. Labels without a document, null labels, and repeated labels of one document
(the largest counts) do no harm; without labels nothing is toxic. Repeated rows are graded each; a null
doc_id is kept.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latchflow.llm.common import sampled
from latchflow.llm.hashed_linear import BITS, fit_ordinal, gathered, name_parts, scores

SAMPLE = 2048
GRADES = 3
#: Probability of grade 1 or more above which a document is toxic.
SURE = 0.5
#: Clean documents are far more frequent outside the sample, which holds as many of both.
CLEAN_WEIGHT = 8.0


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds from at most `sample` labelled documents of each class."""
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.col("toxic").cast("int")).alias("toxic")
    )
    rows = sampled(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), known, sample, "toxic")
    index, value, more = gathered(rows, name_parts, True, "toxic")
    toxic = more["toxic"] > 0
    grade = np.zeros(len(toxic))
    if toxic.any():
        seen = [np.bincount(np.concatenate([*(i for i, t in zip(index, toxic, strict=True) if t == side), np.zeros(0, np.int32)]),
                            minlength=1 << BITS) for side in (True, False)]
        share = (seen[0] + 0.1) / toxic.sum() / ((seen[1] + 0.1) / max(1, (~toxic).sum()))
        marks = (share > 5) & (seen[0] >= 4)
        density = np.array([v[marks[i]].sum() for i, v in zip(index, value, strict=True)])
        cuts = np.quantile(density[toxic], [1 / 3, 2 / 3])
        grade[toxic] = 1 + np.searchsorted(cuts, density[toxic], side="left")
    weight = np.where(toxic, 1.0, CLEAN_WEIGHT)
    return fit_ordinal(index, value, grade, GRADES, weight)


def grade(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], *keep: str) -> DataFrame:
    """doc_id, the named columns, expected_severity, severity (likeliest grade) and toxic."""
    weights, limits = model[0].astype(np.float32), model[1]

    def tasks(batches):
        for batch in batches:
            score = scores(batch.column("text"), weights, name_parts, True)
            above = 1 / (1 + np.exp(np.clip(limits - score[:, None], -40, 40)))
            each = -np.diff(np.concatenate([np.ones((len(score), 1)), above, np.zeros((len(score), 1))], axis=1), axis=1)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(above.sum(axis=1)),
                 pa.array(each.argmax(axis=1).astype(np.int32)), pa.array(above[:, 0] > SURE)],
                [*names, "expected_severity", "severity", "toxic"],
            )

    names = list(dict.fromkeys(["doc_id", *keep]))
    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", expected_severity double, severity int, toxic boolean"
    return docs.select(*dict.fromkeys([*names, "text"])).mapInArrow(tasks, schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return grade(docs, fit(docs, labels))
