"""The trigger gate as a stateful stream in event-time order, one state per trap."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from latchflow.operators.gate import VERDICT, GateFold, GateState, verdict
from latchflow.plans.session import folders
from latchflow.schema import DETECTION_ORDER, MIN_INTER_S, micros
from latchflow.streaming.ordered import DELAY, GROUPS, SENT, Ordered, chunks, in_order, opened, packed, received, with_beats

DEADLINES = "deadlines"
COOLDOWNS = "cooldowns"
#: Cooldowns of a trap in state: keys and their ends.
_PAIRS = "array<array<string>>"


class GateProcessor(Ordered):
    """The batch gate, fed in time order.

    Cooldowns that the watermark has passed leave the state, unless ``keep_passed``; of the deadlines one
    row per trap stays, for it tells a first trigger from later ones.
    """

    kinds = {
        "t_us": "long", "frame_id": "long", "det_idx": "long", "cooldown_key": "string", "open_us": "long", "cooldown_us": "long",
        "force": "boolean", "rest": "string",
    }
    order = DETECTION_ORDER
    keeps = {DEADLINES: "busy_until_us long, hold_until_us long, last_us long", COOLDOWNS: "soonest_us long, found string"}
    names = (*kinds, "trap_id", *GateFold.outputs.names, "late")

    def __init__(self, min_inter_us: int, keep_passed: bool):
        self.fold = GateFold(min_inter_us)
        self.keep_passed = keep_passed

    def apply(self, trap, rows, mark_us, own) -> Iterator[tuple]:
        busy, hold, last = own[DEADLINES] or (None, None, None)
        state, judged = GateState(busy, json.loads(own[COOLDOWNS][1]) if own[COOLDOWNS] else ()), False
        for chunk in chunks(rows):
            columns = dict(zip(self.kinds, map(list, zip(*chunk))))
            codes, lefts = self.fold.run(state, *(columns[c] for c in self.fold.inputs))
            fired = max((i for i, code in enumerate(codes) if code <= 1), default=None)
            if fired is not None:
                hold = columns["t_us"][fired] + columns["open_us"][fired]
            last, judged = columns["t_us"][-1], True
            yield from ((*row, code, left, False) for row, code, left in zip(chunk, codes, lefts))
        if judged:
            own[DEADLINES] = (state.busy, hold, last)
        kept = [(name, until) for name, until in state.cooling.items() if self.keep_passed or until > mark_us]
        own[COOLDOWNS] = (min(until for _, until in kept), json.dumps(kept)) if kept else None

    def wake(self, own) -> int | None:
        return own[COOLDOWNS][0] if own[COOLDOWNS] and not self.keep_passed else None

    def too_late(self, rows) -> Iterator[tuple]:
        return ((*row, None, None, True) for row in rows)


def gate_stream(
    candidates: DataFrame, min_inter_s: float = MIN_INTER_S, delay: str = DELAY, beats: DataFrame | None = None,
    keep_passed: bool = False, groups: int = GROUPS,
) -> DataFrame:
    """Stream of candidates with verdicts and a ``late`` mark, equal to the batch gate for rows within ``delay``.

    Candidates wait until the watermark has passed them. Rows that arrive behind it come out marked
    late, without a verdict. ``beats`` are clock rows (frame_ts) that move the watermark on when no trap sends.
    """
    pause = micros(min_inter_s)
    fixed = ["trap_id", *GateProcessor.kinds]
    extra = [c for c in candidates.columns if c not in fixed]
    timed = candidates.withColumns({"frame_ts": F.timestamp_micros("t_us"), "rest": packed(extra)})
    # the time column itself stays behind, or late rows would be dropped before anyone sees them
    marked = with_beats(timed, beats, delay).select(*fixed)
    schema = T.StructType(
        [T.StructField("trap_id", T.LongType())]
        + [T.StructField(n, {"long": T.LongType(), "boolean": T.BooleanType(), "string": T.StringType()}[k]) for n, k in GateProcessor.kinds.items()]
        + GateFold.outputs.fields + [T.StructField("late", T.BooleanType())]
    )
    judged = received(in_order(marked, GateProcessor(pause, keep_passed), SENT, groups), schema)
    shape = T.StructType([candidates.schema[c] for c in extra])
    if extra:
        judged = judged.withColumn("_rest", opened("rest", shape)).select("*", "_rest.*")
    return judged.withColumns(verdict(pause)).select(*candidates.columns, *VERDICT, "late")


def read_deadlines(spark: SparkSession, checkpoint: str, batch_id: int | None = None) -> DataFrame:
    """Deadlines per trap, read from a running or stopped gate's checkpoint, now or as a batch left them."""
    state = _state(spark, checkpoint, DEADLINES, batch_id)
    return state.selectExpr("user_map_key.trap_id AS trap_id", "user_map_value.*")


def read_cooldowns(spark: SparkSession, checkpoint: str, batch_id: int | None = None) -> DataFrame:
    """Cooldown ends per trap and species, read from the gate's checkpoint."""
    state = _state(spark, checkpoint, COOLDOWNS, batch_id)
    pairs = state.selectExpr("user_map_key.trap_id AS trap_id", f"explode(from_json(user_map_value.found, '{_PAIRS}')) AS pair")
    return pairs.selectExpr("trap_id", "pair[0] AS cooldown_key", "CAST(pair[1] AS long) AS until_us")


def committed(spark: SparkSession, checkpoint: str) -> list[int]:
    """Batches that the stream has finished and whose state is still kept."""
    return sorted(int(n) for n in folders(spark, f"{checkpoint}/commits") if n.isdigit())


def deadline_history(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Deadlines of every trap after each finished batch."""
    found = [read_deadlines(spark, checkpoint, b).withColumn("batch_id", F.lit(b).cast("long")) for b in committed(spark, checkpoint)]
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    return rows


def deadline_changes(spark: SparkSession, checkpoint: str, first: int = 0) -> DataFrame:
    """What each batch from ``first`` on wrote: batch_id, change_type, trap_id and the deadlines.

    The stream must have run with changelog checkpoints, as ``prepare_streaming`` asks for.
    """
    state = spark.read.format("statestore").option("stateVarName", DEADLINES).option("readChangeFeed", "true")
    return state.option("changeStartBatchId", first).load(checkpoint).selectExpr(
        "batch_id", "change_type", "user_map_key.trap_id AS trap_id", "user_map_value.*"
    )


def _state(spark: SparkSession, checkpoint: str, name: str, batch_id: int | None) -> DataFrame:
    reader = spark.read.format("statestore").option("stateVarName", name)
    return (reader if batch_id is None else reader.option("batchId", batch_id)).load(checkpoint)
