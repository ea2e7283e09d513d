"""Automatic closing as an event-time timer per trap."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from latchflow.schema import DETECTION_ORDER
from latchflow.streaming.ordered import DELAY, Ordered, in_order, received, with_beats

SHAPE = T.StructType().add("trap_id", "long").add("trigger_us", "long").add("hold_until_us", "long").add("late", "boolean")


class AutoClose(Ordered):
    """Emits one close per hold that runs out; a trigger inside a hold replaces it.

    The pending hold leaves the state when it is closed. A trigger behind the watermark comes out marked late.
    """

    kinds = {"t_us": "long", "frame_id": "long", "det_idx": "long", "hold_until_us": "long"}
    order = DETECTION_ORDER
    keeps = {"hold": "trigger_us long, hold_until_us long"}
    names = SHAPE.names

    def apply(self, trap, rows, mark_us, own) -> Iterator[tuple]:
        pending = own["hold"]
        for t, _, _, until, _ in rows:
            if pending is not None and t >= pending[1]:
                yield (trap, *pending, False)
            pending = (t, until)
        if pending is not None and pending[1] <= mark_us:
            yield (trap, *pending, False)
            pending = None
        own["hold"] = pending

    def wake(self, own) -> int | None:
        return own["hold"] and own["hold"][1]

    def too_late(self, rows) -> Iterator[tuple]:
        return ((trap, t, until, True) for t, _, _, until, trap in rows)


def auto_close_stream(fired: DataFrame, delay: str = DELAY, beats: DataFrame | None = None) -> DataFrame:
    """Close rows of a stream of triggers with an event time ``frame_ts``."""
    columns = ["trap_id", *AutoClose.kinds]
    marked = with_beats(fired.select("frame_ts", *columns), beats, delay)
    return received(in_order(marked, AutoClose()), SHAPE)
