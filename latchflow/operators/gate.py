"""The trigger gate: which detections fire their trap and which are blocked, and by what.

Per trap there is one busy window (hold plus a global pause) and one cooldown per species. A
candidate is blocked while the trap is busy, else while its species cools down; otherwise it
fires and sets all deadlines from its own time. Equal times fire. A forced row skips both checks
and still overwrites the deadlines, even with earlier ones.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from latchflow.functions.labels import cooldown_key
from latchflow.functions.numbers import to_micros
from latchflow.operators.fold import Fold, fold_ordered
from latchflow.operators.slices import SLICE, Layout, measure
from latchflow.plans.session import shared_dir
from latchflow.schema import DETECTION_ORDER, MIN_INTER_S, micros

# Reasons in the order of the codes the state machine returns.
REASONS = FIRST, OK, BUSY, COOLING = "first_trigger", "ok", "global_busy", "species_cooldown"

VERDICT = ("ok", "reason", "species_left_us", "busy_left_us", "hold_until_us", "busy_until_us", "cooldown_until_us")


class GateState:
    """Deadlines of one trap; ``busy`` is None until the first trigger."""

    __slots__ = ("busy", "cooling")

    def __init__(self, busy=None, cooling=()):
        self.busy = busy
        self.cooling = dict(cooling)


class GateFold(Fold):
    inputs = ("t_us", "cooldown_key", "open_us", "cooldown_us", "force")
    outputs = T.StructType(
        [T.StructField("gate_code", T.IntegerType()), T.StructField("gate_left_us", T.LongType())]
    )

    def __init__(self, min_inter_us: int):
        self.min_inter_us = min_inter_us

    def fresh(self):
        return GateState()

    def run(self, state, times, keys, opens, cooldowns, forces):
        forced = any(forces)
        codes, lefts = [], []
        busy, cooling, pause = state.busy, state.cooling, self.min_inter_us
        i, n = 0, len(times)
        while i < n:
            t, key = times[i], keys[i]
            if busy is None:
                code = 0
            elif forced and forces[i]:
                code = 1
            elif t < busy:
                # Times are sorted: all rows up to the end of the busy window are blocked at once.
                end = i + 1 if forced else bisect_left(times, busy, i + 1)
                codes += [2] * (end - i)
                lefts += [busy - blocked for blocked in times[i:end]]
                i = end
                continue
            else:
                ready = cooling.get(key, t)
                if t < ready:
                    codes.append(3)
                    lefts.append(ready - t)
                    i += 1
                    continue
                code = 1
            codes.append(code)
            lefts.append(0)
            busy = t + opens[i] + pause
            cooling[key] = t + cooldowns[i]
            i += 1
        state.busy = busy
        return codes, lefts

    def freeze(self, state, at):
        if state.busy is None:
            return (None,)
        cooling = sorted((k, until) for k, until in state.cooling.items() if until > at)
        return (max(state.busy, at), *cooling)

    def idle(self, at):
        return (at,)

    def thaw(self, frozen):
        return GateState(frozen[0], frozen[1:])


def verdict(min_inter_us: int) -> dict[str, Column]:
    """Verdict columns from what the state machine returned and the row itself."""
    code, left, t = F.col("gate_code"), F.col("gate_left_us"), F.col("t_us")
    fired = code <= 1
    hold = t + F.col("open_us")
    none = F.lit(0).cast("long")
    values = (
        fired,
        F.get(F.array(*map(F.lit, REASONS)), code),
        F.when(code == 3, left).when(code.isNotNull(), none),
        F.when(code == 2, left).when(code.isNotNull(), none),
        F.when(fired, hold),
        F.when(fired, hold + min_inter_us),
        F.when(fired, t + F.col("cooldown_us")),
    )
    return dict(zip(VERDICT, values))


def candidates(resolved: DataFrame) -> DataFrame:
    """Rows that reach the gate: eligible or forced, with durations as whole microseconds."""
    return (
        resolved.where(F.col("eligible") | F.col("force"))
        .withColumn("cooldown_key", cooldown_key(F.col("label")))
        .withColumn("open_us", to_micros(F.col("open_s")))
        .withColumn("cooldown_us", to_micros(F.col("cooldown_s")))
    )


CHUNK = "quiet_us"
_FIRST = -(1 << 63)


class ChunkFold(GateFold):
    """The gate over chunks that start when nothing can be pending any more; keys end with the chunk."""

    def enter(self, key):
        return self.fresh() if key[-1] == _FIRST else self.thaw(self.idle(key[-1]))


def quiet_chunks(rows: DataFrame, layout: Layout, pause_us: int) -> DataFrame:
    """Rows of hot traps with the start of their chunk, and the others without one (NULL).

    A row starts a chunk if it is not before the end of anything that an earlier candidate could have
    set: the running maximum of ``t + max(open + pause, cooldown)``. What fired is among the
    candidates, so at such a row busy window and cooldowns have passed whatever was decided before.
    """
    staged = layout.assign(rows)
    reach = F.col("t_us") + F.greatest(F.col("open_us") + pause_us, F.col("cooldown_us"))
    hot = staged.where(F.col(SLICE).isNotNull()).withColumn("_reach", reach)
    across = Window.partitionBy("trap_id").orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("trap_id", SLICE).orderBy(*DETECTION_ORDER)
    # these tables have one row per hot slice
    reached = hot.groupBy("trap_id", SLICE).agg(F.max("_reach").alias("_max")).select(
        "trap_id", SLICE, F.max("_max").over(across).alias("_before")
    )
    pending = F.greatest(F.max("_reach").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.col("_before"))
    started = F.when(F.col("_pending").isNull(), F.lit(_FIRST)).when(F.col("t_us") >= F.col("_pending"), F.col("t_us"))
    marked = (
        hot.join(F.broadcast(reached), ["trap_id", SLICE])
        .withColumn("_pending", pending).withColumn("_start", started)
        .withColumn("_own", F.last("_start", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .select(*rows.columns, SLICE, "_own")
    )
    shared_dir(rows.sparkSession)
    marked = marked.checkpoint()
    begun = marked.groupBy("trap_id", SLICE).agg(F.max("_own").alias("_last")).select(
        "trap_id", SLICE, F.last("_last", ignorenulls=True).over(across).alias("_carried")
    )
    chunked = marked.join(F.broadcast(begun), ["trap_id", SLICE]).select(
        *rows.columns, F.coalesce("_own", "_carried").alias(CHUNK)
    )
    cold = staged.where(F.col(SLICE).isNull()).select(*rows.columns, F.lit(None).cast("long").alias(CHUNK))
    return chunked.unionByName(cold)


def gate(rows: DataFrame, layout: Layout, min_inter_s: float = MIN_INTER_S) -> DataFrame:
    """Append the gate's verdict to candidate rows.

    A hot trap is cut at its quiet points, where the state is known, so its chunks run side by side
    without any trial. Only a chunk that is too large for a task itself is sliced and tried.
    """
    pause = micros(min_inter_s)
    if not layout.hot:
        judged = fold_ordered(rows, ["trap_id"], DETECTION_ORDER, GateFold(pause), layout)
        return judged.withColumns(verdict(pause)).drop("gate_code", "gate_left_us")
    rows_of = quiet_chunks(rows, layout, pause)
    hot, cold = rows_of.where(F.col(CHUNK).isNotNull()), rows_of.where(F.col(CHUNK).isNull()).drop(CHUNK)
    keys = ["trap_id", CHUNK]
    dense = measure(hot, tuple(keys))
    parts = fold_ordered(hot, keys, DETECTION_ORDER, ChunkFold(pause), dense).drop(CHUNK)
    rest = fold_ordered(cold, ["trap_id"], DETECTION_ORDER, GateFold(pause), Layout(("trap_id",), "t_us", total=layout.total))
    return parts.unionByName(rest).withColumns(verdict(pause)).drop("gate_code", "gate_left_us")


def decisions(resolved: DataFrame, layout: Layout, min_inter_s: float = MIN_INTER_S) -> DataFrame:
    """Decision of every detection. Only candidates are shuffled to the gate."""
    judged = gate(candidates(resolved), layout, min_inter_s)
    fired = judged.withColumn(
        "decision", F.when(F.col("ok"), F.lit("triggered")).otherwise(F.col("reason"))
    ).select(*resolved.columns, "decision", "species_left_us", "busy_left_us")
    silent = resolved.where(~(F.col("eligible") | F.col("force"))).select(
        "*",
        F.when(~F.col("above_global"), "below_global_conf")
        .when(F.col("open_s") <= 0, "disabled")
        .otherwise("low_conf")
        .alias("decision"),
        F.lit(0).cast("long").alias("species_left_us"),
        F.lit(0).cast("long").alias("busy_left_us"),
    )
    return fired.unionByName(silent)
