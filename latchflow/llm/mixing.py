"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

1. Sources in code point order (null last) weigh 3, 1, 2, repeating, and share 150 % of all sizes. A
   target stops at twice its source's size; what is above goes to the others by weight, until none is.
2. A source's documents, in doc_id order, fall into blocks of about size / BLOCKS words (at most LARGEST).
   A Feistel permutation puts the blocks in random order; whole rounds over the source and then the
   blocks nearest to the rest of its target are drawn, so no document is drawn more than twice.
3. The exact numbers of drawn blocks per source are divided among the output shards by a binary tree: at
   each node the left half's numbers are a multivariate-hypergeometric draw. Sources are first taken
   together in GROUPS groups, whose numbers are split on the driver, and then each group's sources in a task.
   A shard takes the next blocks of each source's random order, so shards are disjoint, and orders its
   documents by a hash.

All draws come from SEED and the sources' names, so reruns agree. Nulls: a null text has size 0, a null
source is a source, a null doc_id comes first in its source. Repeated rows are documents of their own. Sources
without words get target 0 and are not taken. An empty table gives an empty result.
"""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latchflow.llm.common import checkpointed, feistel, n_words, numbered, running

WEIGHTS = (3, 1, 2)
PERCENT, CAP = 150, 2
BLOCKS, LARGEST = 2000, 1 << 20
SHARDS, GROUPS, SEED = 16, 64, 11
#: Blocks that numpy's generator no longer splits.
MANY = 10**9


def _source(source: Column) -> Column:
    """A key without nulls that sorts by code point, null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string")))


def targets(sizes: DataFrame) -> DataFrame:
    """Add weight and target to (key, source_size), one row per source.

    Shares are computed in rounds: sources above their cap stop there and the rest is shared anew.
    """
    rows, _ = numbered(sizes, F.col("key"), name="rank")
    weight = F.get(F.array(*map(F.lit, WEIGHTS)), (F.col("rank") % len(WEIGHTS)).cast("int"))
    rows = checkpointed(rows.withColumn("weight", F.when(F.col("source_size") > 0, weight).otherwise(0)))
    total = (rows.agg(F.sum("source_size")).first()[0] or 0) * PERCENT / 100
    cap, level = CAP * F.col("source_size"), 0.0
    while True:
        free = F.col("weight") * level < cap if level else F.lit(True)
        open_, stopped = rows.agg(
            F.sum(F.when(free, F.col("weight")).otherwise(0)), F.sum(F.when(free, 0).otherwise(cap))
        ).first()
        after = (total - stopped) / open_ if open_ else level
        if after <= level:
            break
        level = after
    return rows.withColumn(
        "target", F.least(F.col("weight") * F.lit(float(level)), cap.cast("double"))
    ).select("key", "rank", "weight", "source_size", "target")


def _drawn(quota: np.ndarray, want: int, rng: np.random.Generator) -> np.ndarray:
    """How many of each source's blocks are among `want` drawn ones.

    Of MANY blocks or more the shares are exact to one block and only the rest is drawn: the generator
    takes no more, and what chance would add to shares of that size is far below a hundredth of a percent.
    """
    total = int(quota.sum())
    if total < MANY:
        return rng.multivariate_hypergeometric(quota, want, method="marginals")
    parts = [divmod(int(q) * want, total) for q in quota]
    left = np.array([whole for whole, _ in parts], dtype=np.int64)
    open_ = rng.permutation(np.array([i for i, (_, rest) in enumerate(parts) if rest], dtype=np.int64))
    left[open_[: want - int(left.sum())]] += 1
    return left


def _split(quota: np.ndarray, totals: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Rows of shards: how many of each source's drawn blocks every shard gets; row sums are `totals`."""
    if len(totals) == 1:
        return quota[None, :]
    half = len(totals) // 2
    left = _drawn(quota, int(totals[:half].sum()), rng)
    return np.concatenate([_split(left, totals[:half], rng), _split(quota - left, totals[half:], rng)])


def quotas(drawn: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(key, upto): per source, the running number of its drawn blocks over the shards."""
    grouped = drawn.withColumn("_g", F.pmod(F.xxhash64("key"), F.lit(GROUPS)).cast("int"))
    sums = {r["_g"]: r["n"] for r in grouped.groupBy("_g").agg(F.sum("n_drawn").alias("n")).collect()}
    whole = np.array([sums.get(g, 0) for g in range(GROUPS)], dtype=np.int64)
    even = np.diff(np.arange(shards + 1) * int(whole.sum()) // shards)
    table = _split(whole, even, np.random.default_rng(SEED))

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key")
        group = int(pdf["_g"].iloc[0])
        got = _split(pdf["n_drawn"].to_numpy(np.int64), table[:, group], np.random.default_rng([SEED, group]))
        return pd.DataFrame({"key": pdf["key"].to_numpy(), "upto": list(np.cumsum(got, axis=0).T)})

    return grouped.select("_g", "key", "n_drawn").groupBy("_g").applyInPandas(each, "key string, upto array<long>")


def mix(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Add to docs: size, source_size, target, block, times (0 to 2) and shards (one per time drawn)."""
    sized = docs.withColumn("size", n_words(F.col("text"))).withColumn("key", _source(F.col("source")))
    slim = sized.select("key", F.col("doc_id").cast("long").alias("doc_id"), "size", F.xxhash64("text").alias("tx"))
    placed = running(slim, "key", [F.col("doc_id"), F.col("tx")], "size", "before")
    goals = checkpointed(targets(slim.groupBy("key").agg(F.sum("size").alias("source_size"))))
    unit = F.greatest(F.lit(1), F.least(F.expr(f"source_size div {BLOCKS}"), F.lit(LARGEST)))
    rows = checkpointed(
        placed.join(F.broadcast(goals) if goals.count() < 10_000 else goals, "key")
        .withColumn("block", F.floor(F.col("before") / unit))
        .select("key", "doc_id", "tx", "size", "block", "source_size", "target")
    )
    blocks = rows.where("size > 0").groupBy("key", "block").agg(F.sum("size").alias("words"))
    order, _ = numbered(blocks, F.col("key"), F.col("block"))
    firsts = order.groupBy("key").agg(F.min("row_no").alias("first"), F.count("*").alias("n_blocks"))

    @F.pandas_udf("long")
    def permuted(at: pd.Series, size: pd.Series, key: pd.Series) -> pd.Series:
        out = np.zeros(len(at), dtype=np.int64)
        for (n, k), where in pd.DataFrame({"n": size, "k": key}).groupby(["n", "k"]).indices.items():
            out[where] = feistel(at.to_numpy()[where], int(n), int(k))
        return pd.Series(out)

    shuffled = order.join(firsts, "key").withColumn(
        "place", permuted(F.col("row_no") - F.col("first"), F.col("n_blocks"), F.pmod(F.xxhash64("key"), F.lit(1 << 30)))
    ).select("key", "block", "words", "n_blocks", "place")
    summed = running(shuffled, "key", [F.col("place")], "words", "ahead").join(
        goals.select("key", "source_size", "target"), "key"
    )
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.col("target") - full * F.col("source_size")
    taken = checkpointed(summed.withColumn("times", (full + (F.col("ahead") + F.col("words") / 2 <= rest).cast("int")).cast("int")))
    drawn = taken.groupBy("key").agg(F.sum("times").cast("long").alias("n_drawn"))
    upto = quotas(drawn, shards)
    which = F.transform(
        F.sequence(F.lit(0), F.lit(CAP - 1)),
        lambda t: F.when(
            t < F.col("times"),
            F.size(F.filter("upto", lambda u: u <= F.col("place") + t * F.col("n_blocks"))),
        ),
    )
    chosen = taken.join(upto, "key").select("key", "block", "times", F.array_compact(which).alias("shards"))
    return rows.join(chosen, ["key", "block"], "left").select(
        "key", "doc_id", "tx", "size", "source_size", "target", "block",
        F.when(F.col("size") > 0, F.coalesce("times", F.lit(0))).otherwise(0).alias("times"),
        F.when(F.col("size") > 0, F.col("shards")).alias("shards"),
    )


def draws(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The mix itself, a row per draw: `_row` (docs' columns), shard and rank, shuffled by rank inside each shard."""
    plan = mix(docs, shards).where("times > 0").select(
        F.col("doc_id").alias("_d"), F.col("tx").alias("_t"), F.col("key").alias("_k"), F.posexplode("shards").alias("_time", "_shard")
    )
    # rows alike in (doc_id, source, text) are numbered on both sides, so each row meets its own draws
    # both sides are dealt by the same four columns without nulls, so texts move once for it
    by = [F.coalesce("_d", F.lit(0).cast("long")).alias("_i"), F.col("_d").isNull().alias("_n"), F.col("_t"), F.col("_k")]
    same = plan.groupBy(*by, "_d", "_time", "_shard").count().withColumnRenamed("count", "_copies")
    # of such rows the smallest one stands for all; the row travels packed, so its columns meet no others
    rows = docs.select(
        F.col("doc_id").cast("long").alias("_d"), F.xxhash64("text").alias("_t"), _source(F.col("source")).alias("_k"),
        F.struct(*docs.columns).alias("_row"),
    ).groupBy(*by).agg(F.min("_row").alias("_row"))
    joined = rows.join(same, ["_i", "_n", "_t", "_k"])
    repeated = joined.withColumn("_copy", F.explode(F.expr("sequence(1, int(_copies))")))
    rank = F.xxhash64(F.lit(SEED), "_shard", "_d", "_t", "_time", "_copy")
    placed = repeated.select("_row", F.col("_shard").alias("shard"), rank.alias("rank"))
    # the local shuffle: every shard lies in the order of its ranks, over as many tasks as it needs
    return placed.repartitionByRange("shard", "rank").sortWithinPartitions("shard", "rank")


def query(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"), "times", "shards"
    )
