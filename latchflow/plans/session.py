"""Session settings the library relies on, and the shared folder for cut lineage."""

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach, as named by the cluster.

    Only a local session, where driver and executors share one disk, may fall back to a
    temporary folder.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named is None:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
        named = tempfile.mkdtemp(prefix="latchflow-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def prepare(spark: SparkSession) -> None:
    """Settings that results depend on: UTC event time."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def prepare_streaming(spark: SparkSession) -> None:
    """Stateful operators with several state variables need the RocksDB store; its changelogs tell what a batch changed."""
    prepare(spark)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names below a folder on any file system that Spark reaches; none if it is missing."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in files.listStatus(place)) if files.exists(place) else []


def remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
