"""Greedy thinning along a time line: minimum-gap throttles and the dead band."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from latchflow.operators.fold import Fold, fold_ordered
from latchflow.operators.metrics import rolling_fps
from latchflow.operators.slices import Layout
from latchflow.operators.timeline import last_before, numbered
from latchflow.schema import (
    BLOCK_LOG_S,
    DEADBAND,
    DETECTION_ORDER,
    FPS_LOG_FLOOR_S,
    FPS_LOG_S,
    FRAME_ORDER,
    MAX_FPS,
    MAX_FPS_FLOOR,
    MIN_WRITE_DIRECT_S,
    MIN_WRITE_SLEWED_S,
    micros,
)

KEPT = T.StructType([T.StructField("kept", T.BooleanType())])


class ThrottleFold(Fold):
    """Keep a row when ``(t - last kept) * rate >= unit``; whole numbers unless the rate is not one.

    With ``start_counts`` the first row only starts the clock. A slice's table names, for the rows that
    may be the first kept one, the last row kept from there on: each kept row has one successor, so
    these are found from the slice's end backwards, and neighbours that run together share an entry.
    """

    #: Entries of a slice's table; a slice with more rows within one gap is tried instead.
    TABLE = 20_000

    inputs = ("t_us",)
    outputs = KEPT

    def __init__(self, unit: int, rate: float = 1, start_counts: bool = False):
        self.unit, self.rate, self.start_counts = unit, rate, start_counts

    def fresh(self):
        return [None]

    def run(self, state, times):
        kept, last, rate, unit = [], state[0], self.rate, self.unit
        for t in times:
            if last is None:
                kept.append(not self.start_counts)
                last = t
            elif (t - last) * rate >= unit:
                kept.append(True)
                last = t
            else:
                kept.append(False)
        state[0] = last
        return (kept,)

    def gap(self) -> int:
        """The smallest difference of times that lets a row pass."""
        gap = max(0, int(self.unit / self.rate) - 1)
        while gap * self.rate < self.unit:
            gap += 1
        return gap

    def transfer(self, times):
        times, gap = np.array(times, dtype=np.int64), self.gap()
        following = np.searchsorted(times, times + gap).tolist()
        if gap == 0:
            following = list(range(1, len(times) + 1))
        last = times.tolist()
        for i in range(len(last) - 1, -1, -1):
            if following[i] < len(last):
                last[i] = last[following[i]]
        # the row before the slice is earlier than its first one
        many = min(len(last), int(np.searchsorted(times, times[0] + gap)) + 1)
        table = [(int(times[i]), last[i]) for i in range(many) if i + 1 == many or last[i] != last[i + 1]]
        return (last[0], table) if len(table) <= self.TABLE else None

    def follow(self, table, entry):
        from_first, firsts = table
        last = self.thaw(entry)[0]
        if last is None:
            return ("at", from_first)
        place = bisect_left(firsts, (last + self.gap(),))
        return ("at", firsts[place][1] if place < len(firsts) else last)

    def freeze(self, state, at):
        last = state[0]
        if last is None:
            return (None,)
        # Once the gap has passed, any earlier time gives the same rows.
        due = (at - last) * self.rate >= self.unit
        return ("due", at) if due else ("at", last)

    def idle(self, at):
        return ("due", at)

    def thaw(self, frozen):
        if frozen[0] is None:
            return [None]
        kind, time = frozen
        if kind == "at":
            return [time]
        return [time - int(self.unit / self.rate) - 1]


class DeadbandFold(Fold):
    """Keep the first row, changes of at least ``band``, and rows ``gap`` after the last kept one."""

    inputs = ("t_us", "value")
    outputs = KEPT

    def __init__(self, band: float, gap_us: int):
        self.band, self.gap_us = band, gap_us

    def fresh(self):
        return [None, None]

    def run(self, state, times, values):
        kept, band, gap = [], self.band, self.gap_us
        last_value, last_t = state
        for t, value in zip(times, values):
            keep = last_t is None or abs(value - last_value) >= band or t - last_t >= gap
            if keep:
                last_value, last_t = value, t
            kept.append(keep)
        state[:] = last_value, last_t
        return (kept,)

    def freeze(self, state, at):
        # Once the gap has passed the next row is kept whatever its value.
        if state[1] is not None and at - state[1] >= self.gap_us:
            return (0.0, at - self.gap_us)
        return tuple(state)

    def idle(self, at):
        return (0.0, at - self.gap_us)

    def thaw(self, frozen):
        return list(frozen)


def fps_cap(frames: DataFrame, layout: Layout, max_fps: float = MAX_FPS) -> DataFrame:
    """Frames that pass the rate cap, with the running index the frame sampler counts by."""
    rate = max(MAX_FPS_FLOOR, max_fps)
    fold = ThrottleFold(1_000_000, rate)
    marked = fold_ordered(frames, ["trap_id"], FRAME_ORDER, fold, layout)
    return marked.where("kept").drop("kept")


def every_nth(frames: DataFrame, n: int, layout: Layout) -> DataFrame:
    """Every n-th of the frames that passed the cap; the index starts at 1."""
    indexed = numbered(frames, ["trap_id"], FRAME_ORDER, "frame_idx", layout)
    return indexed.where(F.col("frame_idx") % max(1, n) == 0)


def block_log(blocked: DataFrame, layout: Layout, gap_s: float = BLOCK_LOG_S) -> DataFrame:
    """Blocked detections that are logged: at most one per gap and trap, whatever the label."""
    fold = ThrottleFold(micros(gap_s))
    marked = fold_ordered(blocked, ["trap_id"], DETECTION_ORDER, fold, layout)
    return marked.where("kept").drop("kept")


def fps_log(samples: DataFrame, layout: Layout, interval_s: float = FPS_LOG_S) -> DataFrame:
    """Frames at which the frame rate is reported; the first frame starts the clock."""
    fold = ThrottleFold(micros(max(FPS_LOG_FLOOR_S, interval_s)), start_counts=True)
    marked = fold_ordered(samples, ["trap_id"], FRAME_ORDER, fold, layout)
    return marked.where("kept").drop("kept")


def fps_report(frames: DataFrame, layout: Layout, interval_s: float = FPS_LOG_S) -> DataFrame:
    """Reported frames with the rolling rate as of each, NULL before the first sample.

    A frame without a sample of its own shows the rate of the latest one that has.
    """
    sampled = rolling_fps(frames, layout)
    silent = frames.where("dt_us <= 0 OR dt_us IS NULL")
    line = sampled.unionByName(silent, allowMissingColumns=True)
    current = last_before(
        line, ["trap_id"], FRAME_ORDER, {"fps_now": F.col("fps_avg")}, layout, inclusive=True
    )
    return fps_log(current, layout, interval_s)


def deadband(
    series: DataFrame,
    order: Sequence[str],
    layout: Layout,
    band: float = DEADBAND,
    gap_s: float | None = None,
    slewed: bool = True,
) -> DataFrame:
    """Telemetry rows that pass the write filter."""
    if gap_s is None:
        gap_s = MIN_WRITE_SLEWED_S if slewed else MIN_WRITE_DIRECT_S
    fold = DeadbandFold(band, micros(gap_s))
    marked = fold_ordered(series, ["trap_id"], order, fold, layout)
    return marked.where("kept").drop("kept")
