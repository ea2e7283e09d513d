"""Hashed sparse features of texts and linear models over them.

A text's features are counts of hashed word parts per hundred words (plus DAMP). They are found and
scored for all texts of a slice at once; training sees a bounded sample as index and value arrays.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from latchflow.llm.common import IN_NAME, IN_WORD, U64, mix, slices

BITS = 18
DAMP = 20


def name_parts(part) -> tuple[list[np.ndarray], np.ndarray]:
    """Lower-case words and their first 4, 5 and 6 bytes."""
    starts, ends, borders = part.words(IN_NAME)
    hashes = [part.hashes(starts, ends)]
    for n in (4, 5, 6):
        hashes.append(mix(part.hashes(starts, np.minimum(starts + n, ends)) ^ U64(n)))
    return hashes, borders


def shape_parts(part) -> tuple[list[np.ndarray], np.ndarray]:
    """The last 2 and 3 bytes of words with what stands at them, and kinds of first and last bytes."""
    starts, ends, borders = part.words(IN_WORD)
    kind = np.zeros(256, dtype=np.uint64)
    kind[0x41:0x5B], kind[0x61:0x7B], kind[0x30:0x3A], kind[0x80:] = 1, 2, 3, 4
    length = np.minimum(ends - starts, 16).astype(np.uint64)
    shape = kind[part.data[starts]] * U64(64) + kind[part.data[ends - 1]] * U64(8) if len(starts) else length
    second = kind[part.data[np.minimum(starts + 1, ends - 1)]] if len(starts) else length
    return [
        mix(part.hashes(np.maximum(ends - 2, starts), ends) ^ U64(2)),
        mix(part.hashes(np.maximum(ends - 3, starts), ends) ^ U64(3)),
        mix((shape + second) * U64(32) + length),
    ], borders


Parts = Callable[..., tuple[list[np.ndarray], np.ndarray]]


def features(text: pa.Array, parts: Parts, lower: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per slice: each feature's index, its value, and the rows' borders."""
    for part in slices(text, lower):
        hashes, borders = parts(part)
        index = (np.stack(hashes, axis=1).reshape(-1) >> U64(64 - BITS)).astype(np.int64)
        words = np.diff(borders)
        yield index, np.repeat(100 / (words + DAMP), words * len(hashes)), borders * len(hashes)


def scores(text: pa.Array, weights: np.ndarray, parts: Parts, lower: bool) -> np.ndarray:
    """Weighted sum of each text's features."""
    out = [np.zeros(0)]
    for index, value, borders in features(text, parts, lower):
        total = np.concatenate([[0.0], np.cumsum(weights[index] * value)])
        out.append(np.diff(total[borders]))
    return np.concatenate(out)


def gathered(docs: DataFrame, parts: Parts, lower: bool, *more: str) -> tuple[list[np.ndarray], list[np.ndarray], dict]:
    """Distinct features of a bounded sample, row by row, on the driver, with the named number columns."""

    def tasks(batches):
        for batch in batches:
            rows = []
            for index, value, borders in features(batch.column("text"), parts, lower):
                for a, b in zip(borders, borders[1:], strict=False):
                    found, counts = np.unique(index[a:b], return_counts=True)
                    rows.append((found.astype(np.int32), (counts * (value[a] if b > a else 0)).astype(np.float32)))
            columns = [pa.array([r[i].tobytes() for r in rows], pa.binary()) for i in (0, 1)]
            numbers = [batch.column(m).cast(pa.float64()) for m in more]
            yield pa.RecordBatch.from_arrays([*columns, *numbers], ["i", "v", *more])

    schema = "i binary, v binary" + "".join(f", {m} double" for m in more)
    table = docs.select("text", *more).mapInArrow(tasks, schema).toPandas()
    index = [np.frombuffer(b, dtype=np.int32) for b in table["i"]]
    value = [np.frombuffer(b, dtype=np.float32) for b in table["v"]]
    return index, value, {m: table[m].to_numpy() for m in more}


def telling(index: list[np.ndarray], grade: np.ndarray, least: int, sigma: float) -> np.ndarray:
    """Features of `least` texts or more whose mean grade is `sigma` standard errors off the sample's.

    Hashed words are many and texts are few, so most features tell apart by chance only.
    """
    rows, col = np.repeat(grade, [len(i) for i in index]), np.concatenate([*index, np.zeros(0, np.int32)])
    seen = np.bincount(col, minlength=1 << BITS)
    total = np.bincount(col, rows, minlength=1 << BITS)
    off = np.abs(total - seen * grade.mean())
    return (seen >= least) & (off > sigma * np.sqrt(np.maximum(seen, 1) * max(grade.var(), 1e-9)))


def fit_ordinal(
    index: list[np.ndarray], value: list[np.ndarray], grade: np.ndarray, top: int, weight: np.ndarray,
    least: int = 4, sigma: float = 4.0, rounds: int = 300, penalty: float = 2e-3,
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds of P(grade >= k) = 1 / (1 + exp(threshold_k - w x)).

    All thresholds share the weights; grades may be fractions for two classes. Full batches with
    AdaGrad steps. Without rows, nothing is learnt and thresholds are far above any score.
    """
    w = np.zeros(1 << BITS)
    if not len(grade):
        return w, np.full(top, 50.0)
    keep = telling(index, np.minimum(grade, 1), least, sigma)
    row = np.repeat(np.arange(len(index)), [len(i) for i in index])
    col, val = np.concatenate(index), np.concatenate(value).astype(np.float64)
    row, col, val = row[keep[col]], col[keep[col]], val[keep[col]]
    names, col = np.unique(col, return_inverse=True)
    if not len(names):
        return w, np.full(top, 50.0)
    part, first, gaps = np.zeros(len(names)), 0.5, np.zeros(top - 1)
    target = np.clip(grade[:, None] - np.arange(top), 0, 1)
    sums = [np.full_like(part, 1e-8), 1e-8, np.full(top - 1, 1e-8)]
    for _ in range(rounds):
        score = np.bincount(row, part[col] * val, len(grade))
        limits = first + np.concatenate([[0], np.cumsum(np.exp(gaps))])
        wrong = (1 / (1 + np.exp(np.clip(limits - score[:, None], -40, 40))) - target) * weight[:, None] / weight.sum()
        grads = [np.bincount(col, wrong.sum(axis=1)[row] * val, len(part)) + penalty * part / len(grade),
                 -wrong.sum(), -np.array([wrong[:, k:].sum() for k in range(1, top)]) * np.exp(gaps)]
        for i, (g, step) in enumerate(zip(grads, (0.5, 0.3, 0.3), strict=True)):
            sums[i] = sums[i] + g * g
            move = step * g / np.sqrt(sums[i])
            if i == 0:
                part -= move
            elif i == 1:
                first -= move
            else:
                gaps -= move
    w[names] = part
    return w, first + np.concatenate([[0], np.cumsum(np.exp(gaps))])
