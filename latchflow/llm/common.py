"""Shared parts of the text operators: whole-batch text arithmetic and global row numbers.

Text arithmetic works on the UTF-8 bytes of an Arrow column with numpy: words, lines and n-grams of
all rows of a slice are found and hashed at once. Slices hold about `SLICE_BYTES`, or one text.
Hashes have 64 bits. Ranges of less than eight bytes never collide: their bytes and length are mixed one to one.
Longer ones take xxh3 of their bytes, no sum of powers, whose collisions could be written down.
"""

import gc
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from latchflow.plans.session import shared_dir

SLICE_BYTES = 1 << 20
WORD = r"[^\x20\x09-\x0D]+"

U64 = np.uint64
_ODD = U64(0x9E3779B97F4A7C15)
_M1, _M2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)

#: Bytes that belong to a word: all but space and 0x09 to 0x0D.
IN_WORD = np.ones(256, dtype=bool)
IN_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: A-Z become a-z, other bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Letters and digits, with all bytes of longer characters.
IN_NAME = np.zeros(256, dtype=bool)
IN_NAME[0x30:0x3A] = IN_NAME[0x41:0x5B] = IN_NAME[0x61:0x7B] = IN_NAME[0x80:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Spread each 64-bit number over all bits."""
    x = x + _ODD
    x = (x ^ (x >> U64(30))) * _M1
    x = (x ^ (x >> U64(27))) * _M2
    return x ^ (x >> U64(31))


_STEP = U64(0xD6E8FEB86659FD93)
#: Ranges below this many bytes are hashed by their bytes and length in one number.
SHORT = 8
#: Longer ranges that are listed at a time.
LONG_RANGES = 1 << 16
_KEPT = np.array([(1 << 8 * n) - 1 for n in range(SHORT)], dtype=np.uint64)


class Slice:
    """Some rows of a text column: `data` holds their bytes, `offsets` the rows' borders in it."""

    def __init__(self, first: int, data: np.ndarray, offsets: np.ndarray):
        self.first, self.data, self.offsets = first, data, offsets
        self.rows = len(offsets) - 1
        self._bytes: bytes | None = None

    def count(self, flags: np.ndarray) -> np.ndarray:
        """Number of set flags per row; one flag per byte."""
        total = np.zeros(len(flags) + 1, dtype=np.int64)
        np.cumsum(flags, out=total[1:])
        return np.diff(total[self.offsets])

    def words(self, table: np.ndarray = IN_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end byte of each word, and each row's first word (one more entry than rows)."""
        inside = table[self.data]
        before = np.zeros(len(inside), dtype=bool)
        before[1:] = inside[:-1]
        before[self.offsets[self.offsets < len(inside)]] = False
        after = np.zeros(len(inside), dtype=bool)
        after[:-1] = inside[1:]
        after[self.offsets[self.offsets > 0] - 1] = False
        starts = np.flatnonzero(inside & ~before)
        ends = np.flatnonzero(inside & ~after) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)

    def tobytes(self) -> bytes:
        """The slice's bytes, and some zeros behind them."""
        if self._bytes is None:
            self._bytes = self.data.tobytes() + bytes(SHORT)
        return self._bytes

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hash of each byte range; equal bytes give equal hashes."""
        data, size = self.tobytes(), ends - starts
        # the eight bytes from every place on, read where a range starts
        numbers = np.ndarray(len(self.data) + 1, dtype="<u8", buffer=data, strides=(1,))[starts]
        out = mix((numbers & _KEPT[np.minimum(size, SHORT - 1)]) | (size.astype(np.uint64) << U64(56)))
        long = np.flatnonzero(size >= SHORT)
        for first in range(0, len(long), LONG_RANGES):
            some = long[first : first + LONG_RANGES]
            pairs = zip(starts[some].tolist(), ends[some].tolist(), strict=True)
            out[some] = np.fromiter((xxhash.xxh3_64_intdigest(data[a:b]) for a, b in pairs), dtype=np.uint64, count=len(some))
        return out


def owners(borders: np.ndarray) -> np.ndarray:
    """Row of each item, given each row's first item."""
    return np.repeat(np.arange(len(borders) - 1), np.diff(borders))


def windows(hashes: np.ndarray, borders: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `width` items inside rows, and the index of each run's first item."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    total = np.zeros(n, dtype=np.uint64)
    step = U64(1)
    for i in range(width):
        total += hashes[i : i + n] * step
        step = U64((int(step) * int(_STEP)) & 0xFFFFFFFFFFFFFFFF)
    row = owners(borders)
    first = np.flatnonzero(row[:n] == row[width - 1 :])
    return mix(total[first]), first


def slices(column: pa.Array, lower: bool = False) -> Iterator[Slice]:
    """Cut a string column into slices of about SLICE_BYTES; nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES, side="right")) - 1
        end = min(max(end, row + 1), len(column))
        part = data[offsets[row] : offsets[end]]
        yield Slice(row, LOWER[part] if lower else part, offsets[row : end + 1] - offsets[row])
        row = end


def n_words(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the cluster's shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def released(spark: SparkSession) -> None:
    """Let Spark remove shuffle files and checkpoints that nothing refers to any more.

    It does so when the driver's garbage is collected, which a driver with little work hardly ever does by
    itself, while the files of one step after another pile up on the executors.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Rows of an Arrow batch that holds whole texts or sets.
BATCH_ROWS = 512


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Actions inside send tasks at most BATCH_ROWS rows at a time.

    With Spark's 10,000 rows a batch of texts takes tens of MB, which every task holds several times over: in
    the JVM's vectors, in the stream and in its Python worker.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    rows = int(before)
    spark.conf.set(name, str(min(rows, BATCH_ROWS) if rows > 0 else BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def arranged(df: DataFrame, *order: Column) -> DataFrame:
    """Rows in a global order, fixed in the shared folder, with `_part` and `_at`.

    `_part` numbers the pieces in order, `_at` the rows in order inside and across pieces.
    """
    fixed = checkpointed(df.repartitionByRange(*order).sortWithinPartitions(*order))
    return fixed.withColumn("_at", F.monotonically_increasing_id()).withColumn(
        "_part", F.shiftright("_at", 33)
    )


def numbered(df: DataFrame, *order: Column, name: str = "row_no") -> tuple[DataFrame, int]:
    """Add the global row number in the given order; also return the number of rows.

    The driver gets one count per piece, and broadcasts as many offsets: their number is that of
    the shuffle's partitions, not of rows.
    """
    rows = arranged(df, *order)
    spark: SparkSession = df.sparkSession
    counts = sorted((r["_part"], r["n"]) for r in rows.groupBy("_part").agg(F.count("*").alias("n")).collect())
    offsets, total = [], 0
    for part, n in counts:
        offsets.append((part, total - (part << 33)))
        total += n
    base = spark.createDataFrame(offsets, "_part long, _base long")
    return rows.join(F.broadcast(base), "_part").withColumn(name, F.col("_at") + F.col("_base")).drop(
        "_at", "_part", "_base"
    ), total


def running(df: DataFrame, key: str, order: list[Column], value: str, name: str, *more: tuple[str, str]) -> DataFrame:
    """Add, per key in the given order, the sum of `value` over all rows before this one.

    Keys of any size: rows are ordered over pieces, summed inside (piece, key), and each piece
    starts from the sums of the key's earlier pieces, of which there are few. `more` are further
    pairs (value, name), summed in the same order.
    """
    sums = [(value, name), *more]
    rows = arranged(df, F.col(key), *order)
    inside = Window.partitionBy("_part", key).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = (
        rows.groupBy("_part", key)
        .agg(*(F.sum(v).alias(f"_sum{i}") for i, (v, _) in enumerate(sums)))
        .select(
            F.col("_part").alias("_p"), F.col(key).alias("_k"),
            *(F.coalesce(F.sum(f"_sum{i}").over(before), F.lit(0)).alias(f"_base{i}") for i in range(len(sums))),
        )
    )
    rows = rows.withColumns({n: F.coalesce(F.sum(v).over(inside), F.lit(0)) for v, n in sums})
    joined = rows.join(pieces, (F.col("_part") == F.col("_p")) & F.col(key).eqNullSafe(F.col("_k")))
    return joined.withColumns({n: F.col(n) + F.col(f"_base{i}") for i, (_, n) in enumerate(sums)}).drop(
        "_part", "_at", "_p", "_k", *(f"_base{i}" for i in range(len(sums)))
    )


def feistel(index: np.ndarray, size: int, key: int) -> np.ndarray:
    """Permutation of 0 .. size - 1: a balanced Feistel network, walked until back inside.

    The network permutes 4^half numbers, fewer than four times `size`, so a walk takes four
    steps on average. See `ROUNDS` and `round_keys` for the constants.
    """
    half = max(1, ((max(size, 2) - 1).bit_length() + 1) // 2)
    mask, shift = U64((1 << half) - 1), U64(64 - half)
    out = index.astype(np.uint64)
    open_ = np.arange(len(out))
    while len(open_):
        x = out[open_]
        left, right = x >> U64(half), x & mask
        for k in round_keys(key):
            left, right = right, left ^ (((right ^ U64(k)) * _ODD) >> shift)
        out[open_] = x = (left << U64(half)) | right
        open_ = open_[x >= U64(size)]
    return out.astype(np.int64)


ROUNDS = 6
MULTIPLIER = int(_ODD)


def round_keys(key: int) -> list[int]:
    """62-bit round keys, the top bits of the mixed numbers key * ROUNDS + 1 .. + ROUNDS."""
    first = (key * ROUNDS) & 0xFFFFFFFFFFFF
    return [int(k) >> 2 for k in mix(np.arange(first + 1, first + 1 + ROUNDS, dtype=np.uint64))]


def sampled(docs: DataFrame, labels: DataFrame, most: int, *by: str) -> DataFrame:
    """Documents of at most `most` labelled ids per value of `by` (of all, without), by the ids' hashes.

    Only ids and labels are ordered and broadcast, at most `most` for each value.
    """
    values = labels.select(*by).distinct().collect() if by else [None]
    parts = []
    for value in values:
        own = labels
        for name in by:
            own = own.where(F.col(name) == value[name])
        parts.append(own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))
    ids = parts[0] if parts else labels.limit(0)
    for part in parts[1:]:
        ids = ids.unionByName(part)
    return docs.join(F.broadcast(ids.withColumnRenamed("doc_id", "_id")), F.col("doc_id") == F.col("_id")).drop("_id")


def crc_entry(name: str) -> str:
    """SQL of one entry of the checksum's table: eight halvings with the reversed polynomial."""
    entry = f"{name}::BIGINT"
    for _ in range(8):
        entry = f"list_transform([{entry}], lambda c: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)[1]"
    return entry
