"""Streaming form of the box cache: each frame sees the last non-empty set for a limited time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latchflow.schema import BOX_TTL_S, FRAME_ORDER, micros
from latchflow.streaming.ordered import DELAY, Ordered, in_order, with_beats

OUT = "trap_id long, frame_id long, t_us long, set_frame_id long, set_t_us long, boxes string, late boolean"
NAMES = [part.split()[0] for part in OUT.split(", ")]


class BoxCache(Ordered):
    """Keeps a trap's newest set and the newest one of an earlier time.

    A frame sees sets of strictly earlier times only, so at the time of the newest set it still
    sees the one before. The boxes travel as text and are opened outside. Sets that are too old for
    any frame to come leave the state. Frames behind the watermark come out marked late and show nothing.
    """

    kinds = {"t_us": "long", "frame_id": "long", "boxes": "string"}
    order = FRAME_ORDER
    keeps = dict.fromkeys(("latest", "before"), "t_us long, frame_id long, boxes string")

    def __init__(self, ttl_us: int):
        self.ttl_us = ttl_us

    def apply(self, trap, rows, mark_us, own) -> Iterator[tuple]:
        latest, before = own["latest"], own["before"]
        for t, frame, boxes, _ in rows:
            seen = latest if latest is not None and latest[0] < t else before
            if seen is not None and 0 < t - seen[0] <= self.ttl_us:
                yield (trap, frame, t, seen[1], seen[0], seen[2], False)
            if boxes is not None:
                if latest is not None and latest[0] < t:
                    before = latest
                latest = (t, frame, boxes)
        # frames to come are at the watermark or later
        for name, kept in (("latest", latest), ("before", before)):
            own[name] = kept if kept is not None and kept[0] + self.ttl_us >= mark_us else None

    def wake(self, own) -> int | None:
        return min((kept[0] + self.ttl_us + 1 for kept in own.values() if kept is not None), default=None)

    def too_late(self, rows) -> Iterator[tuple]:
        return ((trap, frame, t, None, None, None, True) for t, frame, _, trap in rows)

    def frame(self, rows) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=NAMES).astype({"set_frame_id": "Int64", "set_t_us": "Int64"})


def cached_box_stream(
    frames: DataFrame, ttl_s: float = BOX_TTL_S, delay: str = DELAY, beats: DataFrame | None = None
) -> DataFrame:
    """Cached boxes per frame from a stream of frames with a ``boxes`` array of structs each; late frames have none."""
    box_type = frames.schema["boxes"].dataType
    # Missing labels must come back as missing, so NULL members are written out.
    text = F.when(F.size("boxes") > 0, F.to_json("boxes", {"ignoreNullFields": "false"}))
    timed = frames.select("trap_id", "frame_id", "t_us", text.alias("boxes"), F.timestamp_micros("t_us").alias("frame_ts"))
    cached = in_order(with_beats(timed, beats, delay), BoxCache(micros(ttl_s)), OUT)
    one = F.when(F.col("late"), F.array(F.lit(None).cast(box_type.elementType))).otherwise(F.from_json("boxes", box_type))
    opened = cached.select(
        "trap_id", "frame_id", "t_us", "set_frame_id", "set_t_us", "late", F.explode(one).alias("_b"),
    )
    return opened.select("trap_id", "frame_id", "t_us", "set_frame_id", "set_t_us", "late", "_b.*")
