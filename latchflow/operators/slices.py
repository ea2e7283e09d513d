"""Balanced time slices for keys that hold too many rows for one task.

Work that must follow a trap's time order is normally one window or one sorted group per trap.
A trap may hold a large share of all rows, so its time line is cut into slices of about equal
row count. A slice is a function of (key, time) alone: every table derived from the measured
one can use the same layout, and rows with equal time are never parted.

Keys below the limit are not sliced. Hot keys are those above ``total / (2 * tasks)`` rows, so
there are fewer than ``2 * tasks`` of them, with a number of cells of the same order: that bounds
all that is brought to the driver or broadcast, whatever the size of the data.
"""

from __future__ import annotations

import bisect
import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from latchflow.functions.numbers import whole_div

SLICE = "slice_no"
SLICE_ROWS = "spark.latchflow.sliceRows"
MIN_SLICE_ROWS = 1_000_000
TASK_ROWS = 10_000_000
MAX_TASKS = 100_000
BINS_PER_CUT = 8


@dataclass(frozen=True)
class Layout:
    """Cuts of the hot keys; ``hot`` is empty when every key fits a task."""

    keys: tuple[str, ...]
    time: str
    key_type: T.StructType | None = None
    hot: dict[tuple, list[int]] = field(default_factory=dict)
    spans: dict[tuple, tuple[int, int]] = field(default_factory=dict)
    total: int = 0

    def assign(self, df: DataFrame) -> DataFrame:
        """Add the slice number: NULL for keys that are not hot."""
        if not self.hot:
            return df.withColumn(SLICE, F.lit(None).cast("int"))
        table = F.broadcast(df.sparkSession.createDataFrame(self._lookup(), self._lookup_type()))
        t = F.col(self.time)
        width = F.col("_bin_us")
        at = F.greatest(F.lit(0), F.least(F.size("_first") - 1, whole_div(t - F.col("_start"), width)))
        first = F.get("_first", at.cast("int"))
        many = F.get("_many", at.cast("int"))
        near = F.slice("_cuts", first + 1, many)
        number = F.when(many == 0, first).otherwise(
            first + F.size(F.filter(near, lambda cut: cut <= t))
        )
        joined = df.join(table, list(self.keys), "left")
        return joined.withColumn(SLICE, F.when(F.col("_start").isNotNull(), number)).select(
            *df.columns, SLICE
        )

    def _lookup_type(self) -> T.StructType:
        longs = T.ArrayType(T.LongType())
        ints = T.ArrayType(T.IntegerType())
        return T.StructType(
            list(self.key_type.fields)
            + [
                T.StructField("_start", T.LongType()),
                T.StructField("_bin_us", T.LongType()),
                T.StructField("_cuts", longs),
                T.StructField("_first", ints),
                T.StructField("_many", ints),
            ]
        )

    def _lookup(self) -> list[tuple]:
        """Per hot key: equal-width bins that name the cuts at or before each bin and inside it."""
        rows = []
        for key, cuts in self.hot.items():
            start, end = self.spans[key]
            bins = max(1, BINS_PER_CUT * len(cuts))
            width = max(1, math.ceil((end - start + 1) / bins))
            edges = [start + i * width for i in range(bins + 1)]
            first = [bisect.bisect_right(cuts, e) for e in edges[:-1]]
            inside = [
                bisect.bisect_left(cuts, hi) - n for n, hi in zip(first, edges[1:])
            ]
            inside[-1] = len(cuts) - first[-1]
            rows.append((*key, start, width, cuts, first, [max(0, n) for n in inside]))
        return rows


def task_count(spark: SparkSession, total: int) -> int:
    """Tasks for a shuffle of ``total`` rows: the session's number, more when that is too few."""
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(partitions, min(MAX_TASKS, math.ceil(total / TASK_ROWS)))


def slice_limit(spark: SparkSession, total: int) -> int:
    """Rows one slice may hold; the setting overrides the share of the total."""
    set_rows = spark.conf.get(SLICE_ROWS, None)
    if set_rows is not None:
        return int(set_rows)
    return max(MIN_SLICE_ROWS, total // (2 * task_count(spark, total)))


def measure(df: DataFrame, keys: tuple[str, ...] = ("trap_id",), time: str = "t_us") -> Layout:
    """Find the hot keys of ``df`` and cut each into slices of about equal row count.

    A plain count settles small inputs. Otherwise one aggregation with map-side combine over the
    key and time columns looks for hot keys. Only if there are any, their time lines are counted
    in cells, and cells that still hold too many rows are split and counted again, until each
    fits a slice or is a single point in time.
    """
    spark = df.sparkSession
    total = df.count()
    plain = Layout(tuple(keys), time, total=total)
    limit = slice_limit(spark, total)
    if total <= limit:
        return plain
    stats = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.min(time).alias("_lo"), F.max(time).alias("_hi")
    )
    found = stats.where(F.col("_n") > limit).collect()
    if not found:
        return plain
    key_type = T.StructType([df.schema[k] for k in keys])
    spans, cells, cuts = {}, {}, {}
    for row in found:
        key = tuple(row[k] for k in keys)
        spans[key] = (row["_lo"], row["_hi"])
        cells[key] = [(row["_lo"], row["_n"])]
    while any(_splits(spans[k][1], cells[k], limit) for k in cells):
        cuts = {k: _split_starts(spans[k][1], cells[k], limit)[1:] for k in cells}
        layout = Layout(tuple(keys), time, key_type, cuts, spans)
        counted = layout.assign(df).where(F.col(SLICE).isNotNull()).groupBy(*keys, SLICE).count()
        sizes = {k: [0] * (len(c) + 1) for k, c in cuts.items()}
        for row in counted.collect():
            sizes[tuple(row[k] for k in keys)][row[SLICE]] = row["count"]
        cells = {k: list(zip([spans[k][0], *cuts[k]], sizes[k])) for k in cuts}
    packed = {k: _packed(c, limit) for k, c in cells.items()}
    return Layout(tuple(keys), time, key_type, packed, spans, total)


def _splits(end: int, cells: list[tuple[int, int]], limit: int) -> bool:
    return len(_split_starts(end, cells, limit)) > len(cells)


def _split_starts(end: int, cells: list[tuple[int, int]], limit: int) -> list[int]:
    """Starts of the cells after those above the limit are divided evenly in time."""
    starts = []
    for (start, n), stop in zip(cells, [*(s for s, _ in cells[1:]), end + 1]):
        pieces = min(stop - start, 8 + 4 * (n // limit)) if n > limit else 1
        starts += [start + (stop - start) * i // pieces for i in range(pieces)]
    return starts


def _packed(cells: list[tuple[int, int]], limit: int) -> list[int]:
    """Cuts between runs of neighbouring cells that together stay within the limit."""
    cuts, held = [], 0
    for start, n in cells:
        if held and held + n > limit:
            cuts.append(start)
            held = 0
        held += n
    return cuts
