"""Box arithmetic: truncation, crops, captions and overlap."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from latchflow.functions.numbers import fixed2
from latchflow.schema import BGR_IDLE, BGR_TRIGGERED


def crop(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> Column:
    """Crop of a box clamped to the frame; a box without area in the frame takes the whole frame."""
    zero = F.lit(0)
    left, top = F.greatest(zero, x1), F.greatest(zero, y1)
    right, bottom = F.least(width, x2), F.least(height, y2)
    whole = (right <= left) | (bottom <= top)
    return F.struct(
        F.when(whole, zero).otherwise(left).alias("crop_x1"),
        F.when(whole, zero).otherwise(top).alias("crop_y1"),
        F.when(whole, width).otherwise(right).alias("crop_x2"),
        F.when(whole, height).otherwise(bottom).alias("crop_y2"),
        whole.alias("whole_frame"),
    )


def annotation(label: Column, conf: Column, moved: Column, x1: Column, y1: Column) -> Column:
    """Caption, colour (blue, green, red) and text anchor of a drawn box."""
    b, g, r = (
        F.when(moved, F.lit(on)).otherwise(F.lit(off)) for on, off in zip(BGR_TRIGGERED, BGR_IDLE)
    )
    mark = F.when(moved, F.lit(" [TRIG]")).otherwise(F.lit(""))
    return F.struct(
        F.concat(label, F.lit(" "), fixed2(conf), mark).alias("caption"),
        b.alias("blue"),
        g.alias("green"),
        r.alias("red"),
        x1.alias("anchor_x"),
        F.greatest(F.lit(0), y1 - 6).alias("anchor_y"),
    )
