"""Connected components of a link table, by alternating large and small stars.

Every step is a minimum per node (combined before the shuffle) and a join back, so a node with any
number of links is no single task's work. Steps are cut by checkpoints; the driver sees one count and
one checksum per round.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latchflow.llm.common import checkpointed, released


def _star(edges: DataFrame) -> DataFrame:
    """(u, v, m): each edge with the smallest node among u and its neighbours."""
    mins = edges.groupBy("u").agg(F.min("v").alias("_m")).select(
        F.col("u").alias("_u"), F.least("u", "_m").alias("m")
    )
    return edges.join(mins, F.col("u") == F.col("_u")).drop("_u")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1000003)).first())


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (u, v); component is its smallest node."""
    edges = checkpointed(
        links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both).where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _star(large)
        edges = checkpointed(
            small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(
                F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v").where("u <> v").distinct()
        )
        del both, large, small
        released(links.sparkSession)
        after = _state(edges)
        if after == state:
            break
        state = after
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
