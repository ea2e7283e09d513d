"""Column contracts and the fixed default values of the trap controller."""

from pyspark.sql import types as T

# Defaults of the controller, needed for right results.
HOLD_S = 1.5
COOLDOWN_S = 8.0
GLOBAL_CONF = 0.45
MIN_INTER_S = 1.5
BOX_TTL_S = 2.0
MAX_FPS = 12.0
MAX_FPS_FLOOR = 1e-3
FPS_SAMPLES = 120
FPS_LOG_S = 20.0
FPS_LOG_FLOOR_S = 5.0
BLOCK_LOG_S = 1.5
IOU_LIMIT = 0.5
DEADBAND = 2.5
MIN_WRITE_SLEWED_S = 0.06
MIN_WRITE_DIRECT_S = 0.12
SESSION_KEY = "session_1"
BGR_TRIGGERED = (0, 255, 0)
BGR_IDLE = (0, 128, 255)

# The order in which a trap sees its detections. State is only ever applied in this order.
FRAME_ORDER = ("t_us", "frame_id")
DETECTION_ORDER = ("t_us", "frame_id", "det_idx")

DETECTION = T.StructType(
    [
        T.StructField("trap_id", T.LongType()),
        T.StructField("session_key", T.StringType()),
        T.StructField("frame_id", T.LongType()),
        T.StructField("frame_ts", T.TimestampType()),
        T.StructField("det_idx", T.LongType()),
        T.StructField("label", T.StringType()),
        T.StructField("conf", T.DoubleType()),
        T.StructField("x1", T.IntegerType()),
        T.StructField("y1", T.IntegerType()),
        T.StructField("x2", T.IntegerType()),
        T.StructField("y2", T.IntegerType()),
        T.StructField("force", T.BooleanType()),
    ]
)

FRAME = T.StructType(
    [
        T.StructField("trap_id", T.LongType()),
        T.StructField("frame_id", T.LongType()),
        T.StructField("frame_ts", T.TimestampType()),
        T.StructField("ok", T.BooleanType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("dt_us", T.LongType()),
    ]
)

RAW_RESULT = T.StructType(
    [
        T.StructField("trap_id", T.LongType()),
        T.StructField("frame_id", T.LongType()),
        T.StructField("frame_ts", T.TimestampType()),
        T.StructField("xyxy", T.ArrayType(T.ArrayType(T.DoubleType()))),
        T.StructField("conf", T.ArrayType(T.DoubleType())),
        T.StructField("cls", T.ArrayType(T.IntegerType())),
    ]
)


def micros(seconds: float) -> int:
    """Whole microseconds of a duration given in seconds."""
    return int(round(seconds * 1_000_000))
