"""Overlap suppression: of boxes that overlap by more than a limit, the most confident stays."""

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latchflow.plans.session import shared_dir
from latchflow.schema import IOU_LIMIT

CORNERS = ["x1", "y1", "x2", "y2"]
IMAGE = ["trap_id", "frame_id", "class_id"]
#: Boxes of an image and class that are compared in one row; more are peeled over all tasks.
TOGETHER = 128
_CELL = ["_kx", "_ky", "_cx", "_cy"]


def _overlap(a: Column, b: Column, limit: Fraction) -> Column:
    """Whether two boxes (structs of corners) share more than the limit, in whole numbers."""

    def side(low: str, high: str) -> Column:
        shared = F.least(a[high], b[high]).cast("long") - F.greatest(a[low], b[low])
        return F.greatest(shared, F.lit(0).cast("long"))

    shared = side("x1", "x2") * side("y1", "y2")
    # shared / (a + b - shared) > limit
    return shared * F.lit(limit.denominator + limit.numerator) > (a["area"] + b["area"]) * F.lit(limit.numerator)


def suppress(boxes: DataFrame, limit: float = IOU_LIMIT, together: int = TOGETHER) -> DataFrame:
    """Greedy suppression per (trap, frame, class), by falling confidence and rising index.

    Copies of a box are merged before the shuffle. Images of up to ``together`` distinct boxes are
    folded in one row each; the boxes of more crowded ones are peeled round by round, spread over grid
    cells. A box without area overlaps nothing and always stays.
    """
    if not limit > 0:
        raise ValueError("the limit is a share of overlap above zero")
    share = Fraction(limit).limit_denominator(1_000_000)
    flat = (F.col("x2") <= F.col("x1")) | (F.col("y2") <= F.col("y1"))
    rest = [c for c in boxes.columns if c not in (*IMAGE, *CORNERS, "conf", "det_idx")]
    best = F.min(F.struct((-F.col("conf")).alias("rank"), "det_idx", "conf", *rest))
    distinct = boxes.where(~flat).groupBy(*IMAGE, *CORNERS).agg(best.alias("_b"))
    area = (F.col("x2").cast("long") - F.col("x1")) * (F.col("y2").cast("long") - F.col("y1"))
    # the order of boxes: best first, and no two alike
    ranked = distinct.select(
        *IMAGE, F.struct(F.col("_b.rank").alias("rank"), F.col("_b.det_idx").alias("det_idx"), *CORNERS, area.alias("area")).alias("_box"), "_b"
    )

    def above(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*IMAGE).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > together).select(*IMAGE)

    # copies only make an image look larger, and counting them along needs no shuffle of boxes
    crowded = above(ranked)
    if above(boxes.where(~flat)).isEmpty():
        kept = _folded(ranked, share)
    else:
        same = [F.col(f"b.{c}").eqNullSafe(F.col(f"c.{c}")) for c in IMAGE]
        few = ranked.alias("b").join(crowded.alias("c"), same, "left_anti")
        many = ranked.alias("b").join(crowded.alias("c"), same, "left_semi")
        kept = _folded(few, share).unionByName(_peeled(many, share))
    columns = [F.col(c) if c in IMAGE else F.col(f"_box.{c}") if c in CORNERS else F.col(f"_b.{c}") for c in boxes.columns]
    return kept.select(*columns).unionByName(boxes.where(flat))


def _folded(ranked: DataFrame, limit: Fraction) -> DataFrame:
    """Small images: all boxes of one in a row, best first, each against those kept before it."""
    whole = ranked.groupBy(*IMAGE).agg(F.sort_array(F.collect_list(F.struct("_box", "_b"))).alias("_all"))
    kind = whole.schema["_all"].dataType
    kept = F.aggregate(
        "_all", F.array().cast(kind),
        lambda held, one: F.when(F.exists(held, lambda other: _overlap(other["_box"], one["_box"], limit)), held).otherwise(
            F.concat(held, F.array(one))),
    )
    return whole.select(*IMAGE, F.explode(kept).alias("_one")).select(*IMAGE, "_one._box", "_one._b")


def _level(size: Column) -> Column:
    """Largest k with 2^k <= size."""
    return F.length(F.bin(size)) - 1


def _cells(ranked: DataFrame, limit: Fraction) -> DataFrame:
    """Each box in the grid cells it touches.

    Sides of boxes that overlap by more than the limit differ by less than 1 / limit times, so they
    meet on the grid of the longer side's level: a box stands in the grids of its own level and the next ones.
    """
    up = 0
    while limit * (1 << up) < 1:
        up += 1
    x1, y1, x2, y2 = (F.col(f"_box.{c}").cast("long") for c in CORNERS)
    levels = F.sequence(F.lit(0), F.lit(up))
    rows = ranked.select(*IMAGE, "_box", F.explode(levels).alias("_i")).select(*IMAGE, "_box", "_i", F.explode(levels).alias("_j"))
    rows = rows.withColumns({"_kx": _level(x2 - x1) + F.col("_i"), "_ky": _level(y2 - y1) + F.col("_j")})

    def span(low: Column, high: Column, k: str) -> Column:
        first, last = (F.call_function("shiftright", c, F.col(k)) for c in (low, high - 1))
        return F.explode(F.sequence(first, last))

    return rows.withColumn("_cx", span(x1, x2, "_kx")).withColumn("_cy", span(y1, y2, "_ky")).drop("_i", "_j")


def _peeled(ranked: DataFrame, limit: Fraction) -> DataFrame:
    """Crowded images: boxes that are the best of all their cells stay and strike out what they overlap, round by round.

    A better box that overlaps shares a cell, so no other box can strike these out. A cell keeps at most one
    box a round, so no pairs are listed; the image's best box stays in every round, so rounds end.
    """
    shared_dir(ranked.sparkSession)
    ranked = ranked.checkpoint()
    alive, kept = _cells(ranked, limit).checkpoint(), None
    cell = [*IMAGE, *_CELL]
    while not alive.isEmpty():
        best = alive.groupBy(*cell).agg(F.min("_box").alias("_best"))
        first = _same(alive, best, cell).withColumn("_first", F.col("_box") == F.col("_best"))
        now = first.groupBy(*IMAGE, "_box").agg(F.min("_first").alias("_all")).where("_all").select(*IMAGE, "_box").checkpoint()
        kept = now if kept is None else kept.unionByName(now)
        strong = _cells(now, limit).withColumnRenamed("_box", "_best")
        struck = _same(alive, strong, cell).where(
            (F.col("_box") == F.col("_best")) | _overlap(F.col("_box"), F.col("_best"), limit)
        ).select(*IMAGE, "_box").distinct()
        alive = _same(alive, struck, [*IMAGE, "_box"], "left_anti").checkpoint()
    return ranked if kept is None else _same(ranked, kept, [*IMAGE, "_box"], "left_semi")


def _same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, NULL being equal to NULL, with the columns of the left and the new ones of the right.

    Both sides hold boxes in all their cells, many times what their estimate, made from the input's files, says: never broadcast.
    """
    named = right.select(*(F.col(c).alias(f"_r_{c}" if c in keys else c) for c in right.columns))
    same = [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in keys]
    joined = left.join(named.hint("merge"), same, how)
    return joined.drop(*(f"_r_{c}" for c in keys)) if how == "inner" else joined
