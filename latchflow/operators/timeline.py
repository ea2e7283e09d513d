"""Ordered look-ups along a key's time line: last before, first after, running number.

Each is one shuffle and one linear window pass. For hot keys the window runs per time slice and
a small per-slice table carries what earlier slices left behind.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latchflow.operators.slices import SLICE, Layout


def _lookup(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: dict[str, Column],
    layout: Layout,
    forward: bool,
    inclusive: bool,
) -> DataFrame:
    direction = F.desc if forward else F.asc
    edge = 0 if inclusive else -1

    def span(extra: Sequence[str]):
        window = Window.partitionBy(*keys, *extra).orderBy(*(direction(c) for c in order))
        return window.rowsBetween(Window.unboundedPreceding, edge)

    kept = df.columns
    staged = df
    for name, value in values.items():
        staged = staged.withColumn(f"_v_{name}", value)
    if not layout.hot:
        w = span(())
        return staged.select(
            *kept, *(F.last(f"_v_{n}", ignorenulls=True).over(w).alias(n) for n in values)
        )
    staged = layout.assign(staged)
    position = F.struct(*order)
    pick = F.min_by if forward else F.max_by
    carried = (
        staged.where(F.col(SLICE).isNotNull())
        .groupBy(*keys, SLICE)
        .agg(
            *(
                pick(F.col(f"_v_{n}"), F.when(F.col(f"_v_{n}").isNotNull(), position)).alias(f"_c_{n}")
                for n in values
            )
        )
    )
    across = (
        Window.partitionBy(*keys)
        .orderBy(direction(SLICE))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = carried.select(
        *keys, SLICE, *(F.last(f"_c_{n}", ignorenulls=True).over(across).alias(f"_c_{n}") for n in values)
    )
    w = span((SLICE,))
    local = staged.select(
        *kept, SLICE, *(F.last(f"_v_{n}", ignorenulls=True).over(w).alias(f"_l_{n}") for n in values)
    )
    # One row per hot slice when the keys are the layout's own, and then bounded by it.
    if tuple(keys) == layout.keys:
        carried = F.broadcast(carried)
    return local.join(carried, [*keys, SLICE], "left").select(
        *kept, *(F.coalesce(f"_l_{n}", f"_c_{n}").alias(n) for n in values)
    )


def last_before(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: dict[str, Column],
    layout: Layout,
    inclusive: bool = False,
) -> DataFrame:
    """Backward as-of: per row, the last non-NULL of each value among the key's earlier rows."""
    return _lookup(df, keys, order, values, layout, forward=False, inclusive=inclusive)


def first_after(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: dict[str, Column],
    layout: Layout,
    inclusive: bool = False,
) -> DataFrame:
    """Forward as-of. The window runs over descending order, where its frame is linear."""
    return _lookup(df, keys, order, values, layout, forward=True, inclusive=inclusive)


def numbered(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, layout: Layout
) -> DataFrame:
    """Running row number per key, starting at 1."""
    if not layout.hot:
        w = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumn(name, F.row_number().over(w).cast("long"))
    kept = df.columns
    staged = layout.assign(df)
    across = (
        Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = (
        staged.where(F.col(SLICE).isNotNull())
        .groupBy(*keys, SLICE)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*keys, SLICE, F.sum("_n").over(across).alias("_before"))
    )
    w = Window.partitionBy(*keys, SLICE).orderBy(*order)
    local = staged.withColumn("_local", F.row_number().over(w).cast("long"))
    return local.join(carried, [*keys, SLICE], "left").select(
        *kept, (F.col("_local") + F.coalesce("_before", F.lit(0))).alias(name)
    )
