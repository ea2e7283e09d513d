"""Centroid clustering by a bisector tournament over integer vectors.

Kept are vectors of exactly SIZE components, none null or non-finite; component x becomes floor(64 * x). Centroids start as
the K vectors whose ids have the smallest hashes. For each pair i < j of centroids the bisecting plane is computed
ahead: its normal 2 (c_j - c_i) and threshold |c_j|^2 - |c_i|^2, all integers. A vector passes k - 1 sign tests:
the winner so far meets the next centroid, which wins if it lies strictly on its side; zero
favours the smaller number. Distances are computed for final winners only.

Every round sends, per task and cluster, one count and the component sums, in limbs of LIMB bits, so sums of any length are
exact; the driver gets K x SIZE sums. Numbers too large for 64-bit arithmetic are computed with Python's integers.

Ties: equal distances go to the smaller number, vectors with equal ids stand in the order of their components. A null vec_id
starts as no centroid unless all others are taken. Repeated rows count each. Fewer vectors than K give as many centroids.
An empty table gives an empty result. A distance or sum beyond a long comes out as null. Other columns are ignored.
"""

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latchflow.llm.common import checkpointed

SIZE, SCALE, K, ROUNDS = 64, 64, 16, 3
LIMB = 40
#: Place of the number of vectors among a cluster's sums.
COUNT = -1
#: Below this, 64-bit sums hold: a normal's components are below 2^29, their products below 2^56, and SIZE of them below 2^62.
SMALL = 1 << 27
LONGEST = (1 << 63) - 1


def kept_vectors(table: DataFrame, size: int = SIZE) -> DataFrame:
    """vec_id and v, an array of doubles, of the vectors that take part."""
    whole = F.col("embedding").cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return table.select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v")).where((F.size("v") == size) & finite)


def integers(values: np.ndarray) -> np.ndarray:
    """floor(SCALE * x), in 64 bits where that is safe, else as Python's integers."""
    if not values.size or np.abs(values).max() < SMALL // SCALE:
        return np.floor(values * SCALE).astype(np.int64)
    exact = [math.floor(x) * SCALE if abs(x) >= 1 << 52 else math.floor(x * SCALE) for x in values.ravel().tolist()]
    return np.array(exact, dtype=object).reshape(values.shape)


def matrix(column: pa.Array, size: int = SIZE) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


class Planes:
    """Normals and thresholds of all pairs i < j of centroids."""

    def __init__(self, centroids: list[list[int]]):
        small = all(abs(x) < SMALL for c in centroids for x in c)
        self.points = np.array(centroids, dtype=np.int64 if small else object)
        norms = (self.points * self.points).sum(axis=1)
        self.normals = 2 * (self.points[None, :, :] - self.points[:, None, :])
        self.thresholds = norms[None, :] - norms[:, None]

    def nearest(self, vectors: np.ndarray) -> np.ndarray:
        """Number of the nearest centroid of each vector, by k - 1 sign tests."""
        winner = np.zeros(len(vectors), dtype=np.int64)
        for other in range(1, len(self.points)):
            side = (vectors * self.normals[winner, other]).sum(axis=1) - self.thresholds[winner, other]
            winner[np.asarray(side > 0, dtype=bool)] = other
        return winner

    def distances(self, vectors: np.ndarray, winner: np.ndarray) -> np.ndarray:
        away = vectors - self.points[winner]
        return (away * away).sum(axis=1)


def limbs(value: int) -> list[int]:
    """Limbs of LIMB bits, lowest first, each with the number's sign."""
    sign, value, out = (1 if value > 0 else -1), abs(value), []
    while value:
        out.append(sign * (value & ((1 << LIMB) - 1)))
        value >>= LIMB
    return out


def start(vectors: DataFrame, k: int = K) -> list[list[int]]:
    """The k vectors with the smallest sha256 of `1:<vec_id>`."""
    named = vectors.withColumn("_h", F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256))
    first = named.orderBy(F.col("_h").asc_nulls_last(), "v").limit(k).collect()
    return [[int(x) for x in integers(np.array(r["v"], dtype=np.float64))] for r in first]


def moved(vectors: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Centroids after one round: componentwise floor(sum / count), empty ones unchanged."""
    size = len(centroids[0])

    def tasks(batches):
        planes, counts, sums = Planes(centroids), {}, {}
        for batch in batches:
            found = integers(matrix(batch.column("v"), size))
            winner = planes.nearest(found)
            for cluster in np.unique(winner).tolist():
                own = found[winner == cluster]
                total = [int(x) for x in own.sum(axis=0)]
                counts[cluster] = counts.get(cluster, 0) + len(own)
                before = sums.get(cluster)
                sums[cluster] = total if before is None else [a + b for a, b in zip(before, total, strict=True)]
        parts = [(c, COUNT, 0, n) for c, n in counts.items()]
        parts += [(c, at, limb, x) for c, own in sums.items() for at, s in enumerate(own) for limb, x in enumerate(limbs(s))]
        if parts:
            yield pa.RecordBatch.from_arrays(
                [pa.array(a, pa.int64()) for a in zip(*parts, strict=True)], ["cluster", "at", "limb", "x"]
            )

    partial = vectors.select("v").mapInArrow(tasks, "cluster long, at long, limb long, x long")
    # some rows per cluster and component, whatever the number of vectors
    found = partial.groupBy("cluster", "at", "limb").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect()
    totals = {}
    for r in found:
        where = (r["cluster"], r["at"])
        totals[where] = totals.get(where, 0) + (int(r["x"]) << (LIMB * r["limb"]))
    return [
        [totals.get((c, at), 0) // totals[c, COUNT] for at in range(size)] if (c, COUNT) in totals else old
        for c, old in enumerate(centroids)
    ]


def assigned(vectors: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """vec_id, cluster and squared distance (null beyond a long)."""
    size = len(centroids[0])

    def tasks(batches):
        planes = Planes(centroids)
        for batch in batches:
            found = integers(matrix(batch.column("v"), size))
            winner = planes.nearest(found)
            far = [int(x) if x <= LONGEST else None for x in planes.distances(found, winner).tolist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(winner, pa.int32()), pa.array(far, pa.int64())], ["vec_id", "cluster", "distance"]
            )

    return vectors.mapInArrow(tasks, "vec_id long, cluster int, distance long")


def cluster(table: DataFrame, k: int = K, rounds: int = ROUNDS, size: int = SIZE) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every kept vector."""
    spark = table.sparkSession
    vectors = kept_vectors(table, size)
    centroids = start(vectors, k)
    if not centroids:
        empty = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        return spark.createDataFrame([], empty)
    for _ in range(rounds):
        centroids = moved(vectors, centroids)
    rows = checkpointed(assigned(vectors, centroids))
    exact = F.sum(F.col("distance").cast("decimal(38,0)"))
    sums = {r["cluster"]: int(r["s"]) if r["whole"] else None for r in rows.groupBy("cluster").agg(
        exact.alias("s"), (F.count("distance") == F.count("*")).alias("whole")).collect()}
    total = None if None in sums.values() else sum(sums.values())
    named = [
        (c, _long(sums[c]), _long(total), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c in sums
    ]
    of_cluster = spark.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(of_cluster), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def _long(value: int | None) -> int | None:
    return value if value is not None and value <= LONGEST else None


def query(spark, sf_dir: str) -> DataFrame:
    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def oracle() -> str:
    """All distances, in whole numbers, round by round."""
    steps = []
    for i in range(ROUNDS + 1):
        steps.append(f"""
    d{i} AS (
      SELECT r, cluster, (list_sum(list_transform(range(1, {SIZE + 1}), lambda p: (v[p] - c[p]) * (v[p] - c[p]))))::BIGINT AS d
      FROM kept, c{i}),
    a{i} AS (SELECT r, cluster, d FROM d{i} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, cluster) = 1)""")
        if i < ROUNDS:
            steps.append(f"""
    s{i} AS (
      SELECT cluster, p, sum(v[p])::BIGINT AS s, count(*) AS n FROM a{i} JOIN kept USING (r), unnest(range(1, {SIZE + 1})) u(p)
      GROUP BY cluster, p),
    m{i} AS (SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY p) AS c FROM s{i} GROUP BY cluster),
    c{i + 1} AS (SELECT c{i}.cluster, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} USING (cluster))""")
    last = ROUNDS
    return f"""
    WITH kept AS (
      SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
      WHERE len(embedding) = {SIZE} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {SIZE}),
    c0 AS (
      SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS cluster, v AS c FROM kept
      ORDER BY sha256('1:' || vec_id), v LIMIT {K}),
    {", ".join(s.strip() for s in steps)}
    SELECT vec_id, cluster::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia,
      (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
    FROM a{last} JOIN kept USING (r) JOIN c{last} USING (cluster)
    """
