"""Door states in streams: when each hold really ends, frames inside a hold, the newest frame of each poll."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from latchflow.functions.numbers import whole_div
from latchflow.schema import DETECTION_ORDER, micros
from latchflow.streaming.ordered import DELAY, Ordered, in_order, received, with_beats

OUT = "trap_id long, trigger_us long, trigger_frame_id long, hold_until_us long, until_us long, late boolean"
SHAPE = T.StructType()
for part in OUT.split(", "):
    SHAPE.add(*part.split())


class HoldEnds(Ordered):
    """Emits every trigger once its hold is over: at its end, or when a later trigger takes over."""

    kinds = {"t_us": "long", "frame_id": "long", "det_idx": "long", "hold_until_us": "long"}
    order = DETECTION_ORDER
    keeps = {"hold": "trigger_us long, frame_id long, hold_until_us long"}
    names = SHAPE.names

    def apply(self, trap, rows, mark_us, own) -> Iterator[tuple]:
        pending = own["hold"]
        for t, frame, _, until, _ in rows:
            if pending is not None:
                yield (trap, *pending, min(pending[2], t), False)
            pending = (t, frame, until)
        if pending is not None and pending[2] <= mark_us:
            yield (trap, *pending, pending[2], False)
            pending = None
        own["hold"] = pending

    def wake(self, own) -> int | None:
        return own["hold"] and own["hold"][2]

    def too_late(self, rows) -> Iterator[tuple]:
        return ((trap, t, frame, until, t, True) for t, frame, _, until, trap in rows)


def hold_stream(fired: DataFrame, delay: str = DELAY, beats: DataFrame | None = None) -> DataFrame:
    """Triggers with the time until which their hold stood; a late one stood for no time."""
    columns = ["trap_id", *HoldEnds.kinds]
    timed = fired.select(*columns, F.timestamp_micros("t_us").alias("frame_ts"))
    return received(in_order(with_beats(timed, beats, delay), HoldEnds()), SHAPE)


def open_frame_stream(frames: DataFrame, holds: DataFrame, longest_s: float, delay: str = DELAY) -> DataFrame:
    """Frames inside a hold, as an interval join of two streams.

    Frames and holds wait for each other in state as long as their watermarks allow a match: a hold
    for ``longest_s`` and the delay, a frame for the delay. A hold that is longer than said is refused.
    """
    longest = micros(longest_s)
    shown = frames.select(
        F.col("trap_id").alias("_trap"), "frame_id", "t_us", F.timestamp_micros("t_us").alias("_frame_ts")
    ).withWatermark("_frame_ts", delay)
    checked = F.when(F.col("hold_until_us") - F.col("trigger_us") <= longest, F.col("hold_until_us")).otherwise(
        F.raise_error(F.lit(f"a hold is longer than {longest_s} s")).cast("long")
    )
    held = holds.withColumns({
        "hold_until_us": checked, "_trigger_ts": F.timestamp_micros("trigger_us"),
    }).withWatermark("_trigger_ts", delay)
    inside: Column = (
        (F.col("_trap") == F.col("trap_id"))
        & (F.col("_frame_ts") >= F.col("_trigger_ts"))
        & (F.col("_frame_ts") <= F.col("_trigger_ts") + F.expr(f"INTERVAL {longest} MICROSECOND"))
        & (F.col("t_us") < F.col("until_us"))
    )
    return shown.join(held, inside).select(
        "trap_id", "frame_id", "t_us", "trigger_us", "trigger_frame_id", "hold_until_us"
    )


def latest_frame_stream(frames: DataFrame, poll_s: float, delay: str = DELAY, beats: DataFrame | None = None) -> DataFrame:
    """Only the newest frame of each poll, sent when the watermark has passed the poll; its state ends there."""
    timed = frames.select("trap_id", "frame_id", "t_us", F.timestamp_micros("t_us").alias("frame_ts"))
    poll = F.window("frame_ts", f"{micros(poll_s)} microseconds")
    newest = with_beats(timed, beats, delay).groupBy("trap_id", poll).agg(F.max(F.struct("t_us", "frame_id")).alias("_f"))
    return newest.select(
        "trap_id", whole_div(F.unix_micros("window.start"), F.lit(micros(poll_s))).alias("poll"), "_f.frame_id", "_f.t_us"
    )
