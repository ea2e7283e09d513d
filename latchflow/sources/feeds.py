"""Detection, frame and image feeds, in batch and as streams."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from latchflow.functions.numbers import t_us
from latchflow.schema import DETECTION, FRAME, RAW_RESULT, SESSION_KEY

# A stateful stream sorts one trap's rows of a micro-batch in one task. The size of a micro-batch
# bounds that, also when a single trap sends most of the rows.
BATCH_BYTES = 512 << 20

IMAGE = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("modificationTime", T.TimestampType()),
        T.StructField("length", T.LongType()),
        T.StructField("content", T.BinaryType()),
    ]
)


def timed(rows: DataFrame) -> DataFrame:
    """Add event time in microseconds; rows without a time cannot be ordered and are dropped."""
    return rows.where(F.col("frame_ts").isNotNull()).withColumn("t_us", t_us(F.col("frame_ts")))


def read_frames(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Frames that were read without error."""
    return timed(spark.read.schema(FRAME).format(fmt).load(path).where("ok"))


def read_detections(
    spark: SparkSession, path: str, fmt: str = "parquet", session_key: str = SESSION_KEY
) -> DataFrame:
    rows = spark.read.schema(DETECTION).format(fmt).load(path)
    return _sessioned(timed(rows), session_key)


def read_results(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Raw detector results: parallel arrays per frame."""
    return timed(spark.read.schema(RAW_RESULT).format(fmt).load(path))


def stream_detections(
    spark: SparkSession,
    path: str,
    fmt: str = "parquet",
    bytes_per_batch: int = BATCH_BYTES,
    session_key: str = SESSION_KEY,
) -> DataFrame:
    source = spark.readStream.schema(DETECTION).option("maxBytesPerTrigger", bytes_per_batch)
    return _sessioned(timed(source.format(fmt).load(path)), session_key)


def _sessioned(rows: DataFrame, session_key: str) -> DataFrame:
    return rows.withColumns(
        {
            "session_key": F.coalesce("session_key", F.lit(session_key)),
            "force": F.coalesce("force", F.lit(False)),
        }
    )


#: File names of images, unless a caller names others.
IMAGES = "*.{jpg,jpeg,png,JPG,JPEG,PNG}"


def read_images(spark: SparkSession, path: str, glob: str = IMAGES) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)


def stream_images(spark: SparkSession, path: str, glob: str = IMAGES) -> DataFrame:
    return (
        spark.readStream.format("binaryFile").schema(IMAGE).option("pathGlobFilter", glob).load(path)
    )
