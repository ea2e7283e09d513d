"""N-gram Jaccard join by signature trees.

A document's set holds the hashes of its distinct shingles (runs of `words` words, A-Z lowered). Two
documents link when 100 * |a & b| >= percent * |a | b|. The steps:

1. Equal sets become one class (two 64-bit sums and the size), its smallest doc_id the representative.
2. Classes are cut into islands that cannot link with each other. Sizes fall into levels; sets of one
   level that link differ in at most D shingles. The hash range is cut into D + 1 + spare buckets. A set and
   those it may link with at a level differ in fewer shingles if it is among the level's small ones; all buckets
   but as many are of equal content, and one of these must be shown. A set shows a hash of each bucket with
   three shingles or more, for these are hardly ever equal by chance or by a passage in common; if too many
   buckets hold less, also those of two, then of one shingle, and at last the empty ones.
   Sets show these hashes at the level of every size they may link with. Equal hashes tie sets to the
   smallest id with the same hash, never to each other. A few hashes of each set (AHEAD a level) are
   tied first: alike sets share most of their hashes, so this already gives them one label. Then all
   hashes meet under these labels, first inside a task's share and then over all, and only sets that
   are still apart become ties there; else a pair would be found anew in every task.
3. An island is one or more blocks of sets, ordered by size, with at most BLOCK shingles each (or
   one set). Each block becomes a signature tree, and trees are traversed in pairs; see
   `signature_trees`. Large islands first join each block with itself and the next one, then only
   those block pairs whose sizes can meet and which are not one component already.

Nulls and empty texts have no shingles and link with nothing; so do rows without doc_id, whose
component is null. Texts with fewer words than a shingle have their whole sequence as the only one.
Repeated rows are copies; rows that share a doc_id but not the text count as one document. An empty
table gives an empty result. Other columns are ignored.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latchflow.llm.common import U64, checkpointed, mix, released, running, slices, small_batches, windows
from latchflow.llm.components import components
from latchflow.llm.signature_trees import link

WORDS, PERCENT = 4, 85
#: Shingles of a block: two blocks are what a task holds.
BLOCK = 1_000_000
#: Bucket hashes that a task gathers before it sends them on, and that one later group may hold.
GATHER = 1_000_000
#: Bucket hashes of a level that are tied ahead of the others. Any number gives the same islands.
AHEAD = 4


def shingle_sets(text: pa.Array, words: int):
    """The sorted distinct shingle hashes of each text, in order."""
    for part in slices(text, lower=True):
        starts, ends, borders = part.words()
        hashed = part.hashes(starts, ends)
        keys, first = windows(hashed, borders, words)
        cut = np.searchsorted(first, borders)
        for row in range(part.rows):
            lo, hi = borders[row], borders[row + 1]
            if hi - lo >= words:
                yield np.unique(keys[cut[row] : cut[row + 1]])
            elif hi > lo:
                sum_ = U64(hi - lo)
                for h in hashed[lo:hi]:
                    sum_ = mix(np.array([sum_ ^ h], dtype=np.uint64))[0]
                yield np.array([sum_], dtype=np.uint64)
            else:
                yield np.zeros(0, dtype=np.uint64)


def _digest(found: np.ndarray) -> tuple[int, int]:
    """Two sums over a set that tell different sets apart."""
    return tuple(int(mix(found ^ U64(k)).sum(dtype=np.uint64).view(np.int64)) for k in (1, 2))


def _digests(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, n, two sums over the set and the hashes that are tied ahead."""

    def tasks(batches):
        for batch in batches:
            n, sums, ahead, borders = [], [], [np.zeros(0, dtype=np.uint64)], [0]
            for found in shingle_sets(batch.column("text"), words):
                n.append(len(found))
                sums.append(_digest(found))
                few = [h[:AHEAD] for h in level_hashes(found, percent)]
                ahead += few
                borders.append(borders[-1] + sum(map(len, few)))
            d = np.array(sums, dtype=np.int64).reshape(-1, 2)
            shown = pa.ListArray.from_arrays(pa.array(borders, pa.int32()), pa.array(np.concatenate(ahead).view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(d[:, 0]), pa.array(d[:, 1]), shown],
                ["doc_id", "n", "d1", "d2", "ahead"],
            )

    return docs.mapInArrow(tasks, "doc_id long, n long, d1 long, d2 long, ahead array<long>")


def level(size: int) -> int:
    """Smallest j with size <= 2^(j / 4)."""
    j = max(0, 4 * (size - 1).bit_length() - 4)
    while size**4 > 1 << j:
        j += 1
    return j


def buckets(j: int, percent: int) -> tuple[int, int]:
    """Number of buckets at a level, and how many more than the largest difference they are."""
    top = math.isqrt(math.isqrt(1 << j))
    most = 2 * top * (100 - percent) // (100 + percent)
    spare = 3 + most * (100 - percent) // 80
    return most + 1 + spare, spare


def differ(size: int, j: int, percent: int) -> int:
    """Most shingles in which a set of this size differs from one of at most level j's size that it links with."""
    top = math.isqrt(math.isqrt(1 << j))
    return (size + min(top, size * 100 // percent)) * (100 - percent) // (100 + percent)


def level_hashes(found: np.ndarray, percent: int) -> list[np.ndarray]:
    """The hashes by which a set meets those it may link with, level by level."""
    if not len(found):
        return []
    total = np.zeros(len(found) + 1, dtype=np.uint64)
    np.cumsum(mix(found), out=total[1:])
    out = []
    for j in range(level(len(found)), level(len(found) * 100 // percent) + 1):
        count, _ = buckets(j, percent)
        cuts = np.searchsorted(((found >> U64(32)) * U64(count)) >> U64(32), np.arange(count + 1))
        names = mix(np.arange(count, dtype=np.uint64) + U64(j << 40))
        hashes = mix((total[cuts[1:]] - total[cuts[:-1]]) ^ names)
        filled = cuts[1:] - cuts[:-1]
        hidden = count - 1 - differ(len(found), j, percent)
        least = next((few for few in (3, 2, 1) if np.count_nonzero(filled < few) <= hidden), 0)
        out.append(hashes[filled >= least])
    return out


def bucket_hashes(found: np.ndarray, percent: int) -> np.ndarray:
    """The hashes of all levels."""
    return np.concatenate([np.zeros(0, dtype=np.uint64), *level_hashes(found, percent)])


def _planes(values: np.ndarray, width: int) -> bytes:
    """Little-endian bytes of the values, all first bytes, then all second ones: these compress."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _unplanes(data: bytes, width: int) -> np.ndarray:
    parts = np.frombuffer(data, dtype=np.uint8).reshape(width, -1)
    out = np.zeros((parts.shape[1], 8), dtype=np.uint8)
    out[:, :width] = parts.T
    return out.reshape(-1).view(np.uint64)


def _tie(hashes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place of the smallest id of each hash, and the ties (id, smallest id) of the others."""
    order = np.lexsort((ids, hashes))
    hashes, ids = hashes[order], ids[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = hashes[1:] != hashes[:-1]
    lead = ids[new][np.cumsum(new) - 1]
    tied = np.flatnonzero(ids != lead)
    return order[new], *_distinct([ids[tied]], [lead[tied]])


def _distinct(u: list[np.ndarray], v: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Each pair of the given pieces once."""
    a, b = np.concatenate(u), np.concatenate(v)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[new], b[new]


def _ties_ahead(rows: DataFrame) -> DataFrame:
    """Ties (u, v) of the documents (doc_id, ahead) to the smallest one with the same hash."""
    shown = rows.select("doc_id", F.explode("ahead").alias("_h"))
    leads = shown.groupBy("_h").agg(F.min("doc_id").alias("v"), F.max("doc_id").alias("_last")).where("v < _last")
    return shown.join(leads, "_h").select(F.col("doc_id").alias("u"), "v")


def _ties(docs: DataFrame, words: int, percent: int, total: int) -> DataFrame:
    """Ties (u, v) of labels (doc_id) whose texts share a bucket's hash; `total` is the number of shingles.

    Tasks send hashes packed by their top bits; 40 further bits are compared, and an equal pair by
    chance only makes an island larger. A pair meets in many packed groups; a task passes it on once.
    """
    bits = max(0, (total // GATHER).bit_length())

    def gathered(hashes, ids):
        hashes, ids = np.concatenate(hashes), np.concatenate(ids)
        kept, u, v = _tie(hashes, ids)
        hashes, ids = hashes[kept], ids[kept]
        group = (hashes >> U64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)
        edges = np.flatnonzero(np.diff(group, prepend=-1))
        low = (hashes >> U64(24 - bits)) & U64((1 << 40) - 1)
        cuts = [*edges.tolist(), len(hashes)]
        names = [*group[edges].tolist(), -1]
        blobs = [_planes(low[a:b], 5) for a, b in zip(cuts, cuts[1:], strict=False)]
        whose = [_planes(ids[a:b], 8) for a, b in zip(cuts, cuts[1:], strict=False)]
        return pa.RecordBatch.from_arrays(
            [pa.array(names, pa.int64()), pa.array([*blobs, u.tobytes()], pa.binary()), pa.array([*whose, v.tobytes()], pa.binary())],
            ["part", "hashes", "ids"],
        )

    def show(batches):
        hashes, ids, size = [], [], 0
        for batch in batches:
            names = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for row, found in enumerate(shingle_sets(batch.column("text"), words)):
                hashes.append(bucket_hashes(found, percent))
                ids.append(np.full(len(hashes[-1]), names[row], dtype=np.int64))
                size += len(hashes[-1])
                if size >= GATHER:
                    yield gathered(hashes, ids)
                    hashes, ids, size = [], [], 0
        if hashes:
            yield gathered(hashes, ids)

    def meet(batches):
        part, hashes, ids = None, [], []
        u, v, size = [], [], 0

        def sent_on(u, v):
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

        for batch in batches:
            for row in range(batch.num_rows):
                now, a, b = (batch.column(i)[row].as_py() for i in range(3))
                if now == -1:
                    u.append(np.frombuffer(a, dtype=np.int64))
                    v.append(np.frombuffer(b, dtype=np.int64))
                    size += len(u[-1])
                else:
                    if now != part and hashes:
                        _, more_u, more_v = _tie(np.concatenate(hashes), np.concatenate(ids))
                        u.append(more_u)
                        v.append(more_v)
                        size += len(more_u)
                        hashes, ids = [], []
                    part = now
                    hashes.append(_unplanes(a, 5))
                    ids.append(_unplanes(b, 8).view(np.int64))
                if size >= GATHER:
                    one_u, one_v = _distinct(u, v)
                    if len(one_u) > GATHER // 2:
                        yield sent_on(one_u, one_v)
                        one_u, one_v = one_u[:0], one_v[:0]
                    u, v, size = [one_u], [one_v], len(one_u)
        if hashes:
            _, more_u, more_v = _tie(np.concatenate(hashes), np.concatenate(ids))
            u.append(more_u)
            v.append(more_v)
        if u:
            yield sent_on(*_distinct(u, v))

    sent = docs.mapInArrow(show, "part long, hashes binary, ids binary")
    spread = F.when(F.col("part") >= 0, F.col("part")).otherwise(-1 - F.abs(F.xxhash64("ids") % 4096))
    return (
        sent.withColumn("_to", spread).repartition("_to").sortWithinPartitions("part").drop("_to")
        .mapInArrow(meet, "u long, v long")
    )


def _sets(docs: DataFrame, members: DataFrame, words: int) -> DataFrame:
    """members (class_id, n, d1, d2, ...) with their sets, made anew from the texts."""
    kept = [c for c in members.columns if c not in ("d1", "d2")]
    rows = docs.join(members, docs["doc_id"] == members["class_id"]).select("text", *members.columns)

    def tasks(batches):
        for batch in batches:
            right, out = [], []
            for row, found in enumerate(shingle_sets(batch.column("text"), words)):
                if _digest(found) == (batch.column("d1")[row].as_py(), batch.column("d2")[row].as_py()):
                    right.append(row)
                    out.append(found.tobytes())
            part = batch.select(kept).take(pa.array(right, pa.int64()))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], [*kept, "shingles"])

    schema = ", ".join(f"{c} {dict(members.dtypes)[c]}" for c in kept) + ", shingles binary"
    return rows.mapInArrow(tasks, schema)


def _joined(sets: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) of sets (island, i, j, block, class_id, label, shingles), a task's group each.

    Rows of one (island, i, j) are the sets of one or two blocks; groups stream by in order.
    """

    def close(group, labels, ids, first):
        sets_ = [np.frombuffer(s, dtype=np.uint64) for s in group]
        if len(sets_) < 2:
            return [], []
        names, start = np.unique(labels, return_inverse=True)
        found = link(sets_, start.astype(np.int64), percent, first or None)
        ids = np.array(ids, dtype=np.int64)
        smallest = np.full(len(names), np.iinfo(np.int64).max)
        np.minimum.at(smallest, found, ids)
        target = smallest[found]
        return ids[ids != target].tolist(), target[ids != target].tolist()

    def tasks(batches):
        key, group, labels, ids, first = None, [], [], [], 0
        for batch in batches:
            u, v = [], []
            columns = (batch.column(c).to_pylist() for c in ("island", "i", "j", "block", "class_id", "label"))
            for at, (*now, in_block, class_id, label) in enumerate(zip(*columns, strict=True)):
                if now != key:
                    if key is not None:
                        a, b = close(group, labels, ids, first)
                        u += a
                        v += b
                    key, group, labels, ids, first = now, [], [], [], 0
                group.append(batch.column("shingles")[at].as_py())
                labels.append(label)
                ids.append(class_id)
                first += now[1] != now[2] and in_block == now[1]
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])
        if key is not None:
            a, b = close(group, labels, ids, first)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["u", "v"])

    group = ["island", "i", "j"]
    return (
        sets.select(*group, "block", "class_id", "label", "shingles")
        .repartition(*group).sortWithinPartitions(*group, "block", "class_id")
        .mapInArrow(tasks, "u long, v long")
    )


def join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable)."""
    with small_batches(docs.sparkSession):
        return _join(docs, words, percent, block)


def _join(docs: DataFrame, words: int, percent: int, block: int) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    digests = checkpointed(_digests(docs, words, percent))
    own = ["d1", "d2", "n"]
    full = digests.where("n > 0 AND doc_id IS NOT NULL")
    classes = full.groupBy(*own).agg(F.min("doc_id").alias("class_id"))
    firsts = classes.select("class_id").distinct()
    early = components(_ties_ahead(full.join(firsts, F.col("doc_id") == F.col("class_id"), "left_semi")))
    labelled = checkpointed(
        classes.join(early, F.col("class_id") == F.col("node"), "left")
        .select("class_id", *own, F.coalesce("component", "class_id").alias("label"))
    )
    del early, firsts
    released(docs.sparkSession)
    total = labelled.agg(F.sum("n")).first()[0] or 0
    labels = labelled.select("class_id", "label").distinct()
    shown = docs.join(labels, F.col("doc_id") == F.col("class_id")).select(F.col("label").alias("doc_id"), "text")
    islands = components(_ties(shown, words, percent, total))
    members = labelled.join(islands, F.col("label") == F.col("node"), "left").select(
        "class_id", *own, F.coalesce("component", "label").alias("island")
    )
    several = members.groupBy("island").agg(F.count("*").alias("_c")).where("_c > 1").select("island")
    members = members.join(several, "island")
    placed = checkpointed(
        running(members, "island", [F.col("n"), F.col("class_id")], "n", "_before")
        .withColumn("block", F.expr(f"_before div {block}")).withColumn("label", F.col("class_id")).drop("_before")
    )
    del islands, shown, members
    released(docs.sparkSession)
    links = _links(docs, placed, words, percent)
    released(docs.sparkSession)
    linked = components(links).select(F.col("node").alias("class_id"), F.col("component").alias("component_id"))
    named = classes.join(linked, "class_id", "left").select(
        *own, F.coalesce("component_id", "class_id").alias("component_id")
    )
    none = F.col("doc_id").isNull()
    return digests.join(named, own, "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(~none, F.coalesce("component_id", "doc_id")).alias("component_id"),
    )


def _links(docs: DataFrame, placed: DataFrame, words: int, percent: int) -> DataFrame:
    """Links inside islands: first blocks and their neighbours, then what may still be open."""
    blocks = placed.groupBy("island", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    follows = blocks.select("island", (F.col("block") - 1).alias("block"), F.lit(True).alias("follows"))
    tasks = placed.join(follows, ["island", "block"], "left").select(
        placed["*"],
        F.explode(F.array_compact(F.array(
            F.struct(F.col("block").alias("i"), F.col("block").alias("j")),
            F.when(F.col("follows"), F.struct(F.col("block").alias("i"), (F.col("block") + 1).alias("j"))),
            F.when(F.col("block") > 0, F.struct((F.col("block") - 1).alias("i"), F.col("block").alias("j"))),
        ))).alias("t"),
    ).select(placed["*"], "t.i", "t.j")
    links = checkpointed(_joined(_sets(docs, tasks, words), percent))
    if placed.where("block > 1").isEmpty():
        return links
    labels = components(links).select(F.col("node").alias("class_id"), F.col("component").alias("_c"))
    released(docs.sparkSession)
    now = checkpointed(
        placed.join(labels, "class_id", "left").withColumn("label", F.coalesce("_c", "label")).drop("_c")
    )
    state = now.groupBy("island", "block").agg(
        F.min("n").alias("low"), F.max("n").alias("high"), F.min("label").alias("l1"), F.max("label").alias("l2")
    )
    left = state.select("island", F.col("block").alias("i"), F.col("high").alias("h"), F.col("l1").alias("a1"), F.col("l2").alias("a2"))
    pairs = left.join(state.withColumnRenamed("block", "j"), "island").where(
        (F.col("j") > F.col("i") + 1) & (F.col("h") * 100 >= F.col("low") * percent)
        & ~((F.col("a1") == F.col("a2")) & (F.col("l1") == F.col("l2")) & (F.col("a1") == F.col("l1")))
    ).select("island", "i", "j")
    sides = pairs.select("island", "i", "j", F.explode(F.array("i", "j")).alias("block"))
    more = _joined(_sets(docs, now.join(sides, ["island", "block"]), words), percent)
    return links.unionByName(checkpointed(more))


def query(spark, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def oracle() -> str:
    """All pairs that share a shingle, counted, and their components."""
    return rf"""
    WITH RECURSIVE base AS (
      SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'),
        lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS w FROM documents),
    sets AS (
      SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {WORDS} THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - {WORDS - 2}), lambda i: array_to_string(w[i:i + {WORDS - 1}], ' '))) END AS s
      FROM base),
    classes AS (SELECT min(doc_id) AS id, list_sort(s) AS s FROM sets WHERE len(s) > 0 GROUP BY list_sort(s)),
    items AS (SELECT id, len(s) AS n, unnest(s) AS g FROM classes),
    pairs AS (
      SELECT a.id AS a, b.id AS b FROM items a JOIN items b ON a.g = b.g AND a.id < b.id
        AND a.n * 100 >= {PERCENT} * b.n AND b.n * 100 >= {PERCENT} * a.n
      GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= {PERCENT} * (a.n + b.n - count(*))),
    edges AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs UNION SELECT id, id FROM classes),
    reach(id, c) AS (
      SELECT id, id FROM classes UNION SELECT e.a, r.c FROM reach r JOIN edges e ON e.b = r.id),
    parts AS (SELECT id, min(c) AS c FROM reach GROUP BY id)
    SELECT sets.doc_id, len(sets.s)::BIGINT AS n_shingles, coalesce(c, sets.doc_id) AS component_id
    FROM sets LEFT JOIN classes ON list_sort(sets.s) = classes.s LEFT JOIN parts USING (id)
    """
