"""Prefix trie of conversations, by adaptive radix trees over fixed-width turn ids.

A turn's id is the first WIDTH bytes of the SHA-256 of its role and text, so equal turns have one id without any
shared table. A conversation's key is its ids in a row, big-endian bytes as they are. Equal keys become one
row with their number and smallest conv_id. The rows are range-partitioned by key; each task grows a radix tree
(see `radix_tree`) of its range and emits a node at every byte depth that is a multiple of WIDTH, inside
compressed paths too. Only the beginnings that a range shares with its neighbour ranges are in several trees: how
long these are is known from the ranges' borders, so a shared node is emitted in parts under (first range, depth)
and the parts are added up. Numbers that would count twice (a shared node itself, its word count, a key that looks
childless at its range's end) are left to the first range or dropped, so sums need no correction.

Hot first turns, texts and copies: ranges follow the keys, however few first turns there are; copies are counted before
the shuffle. Conversations longer than SEGMENT turns are cut into segments, so no row holds more. A later
segment's key begins with the hash of all before it; its trees are grown first and their
totals hang on the rows of the segment before. The members that end at a node are hashed in order: ranges of (key,
conv_id) pack ids into texts, and one stream per node hashes these with one text in memory.

Rebuilding: conversation c takes the first h = crc32(c) % 4 turns of conversation c - c % 20, then its own after its
first h. Nulls: a null role or text is empty, a null turn comes first, rows without conv_id belong to no
conversation. Turns alike in number are ordered by role and id. Repeated rows are turns of their own. Conversations
without turns after rebuilding end at the root. An empty table gives an empty result. Other columns are ignored.
"""

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from latchflow.llm.common import arranged, checkpointed, crc_entry, n_words, running
from latchflow.llm.radix_tree import common, grown, preorder

WIDTH = 16
#: Turns of one key.
SEGMENT = 1 << 16
#: Parents that are sent to every task; beyond, the join is shuffled.
FEW = 100_000
#: Turns of a range, and characters of one packed text of conv_ids.
RANGE, PACK = 400_000, 1 << 12
#: Turns that a later segment's entry takes.
ENTRY = 32 // WIDTH
NOTHING = hashlib.sha256(b"").hexdigest()


def rebuilt(turns: DataFrame, stride: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame, int, int]:
    """All conversations (conv_id), their turns (conv_id, position, id, words), a bound on a conversation's and on all turns."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    named = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"),
        F.substring(named, 1, 2 * WIDTH).alias("id"), n_words(text).alias("words"), F.lit(1).cast("long").alias("_one"),
    )
    ranked = checkpointed(
        running(rows, "conv_id", [F.col("turn"), F.col("role"), F.col("id")], "_one", "rank").select("conv_id", "rank", "id", "words")
    )
    convs = ranked.select("conv_id").distinct().withColumn(
        "h", F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(heads)).cast("long")
    ).withColumn("_base", F.col("conv_id") - F.col("conv_id") % stride)
    # at most heads - 1 turns of every conversation that others begin with
    begin = ranked.where((F.col("rank") < heads - 1) & (F.col("conv_id") % stride == 0)).groupBy(F.col("conv_id").alias("_base")).agg(
        F.sort_array(F.collect_list(F.struct("rank", "id", "words"))).alias("_begin")
    )
    convs = checkpointed(
        convs.join(begin, "_base", "left").select(
            "conv_id", "h", F.coalesce(F.slice("_begin", 1, F.col("h").cast("int")), F.array()).alias("begin")
        )
    )
    lent = convs.select("conv_id", F.explode("begin").alias("t")).select("conv_id", F.col("t.rank").alias("position"), "t.id", "t.words")
    own = ranked.join(convs.select("conv_id", "h", F.size("begin").alias("m")), "conv_id").where("rank >= h").select(
        "conv_id", (F.col("rank") - F.col("h") + F.col("m")).alias("position"), "id", "words"
    )
    size = ranked.agg(F.max("rank"), F.count("*")).first()
    return convs.select("conv_id"), lent.unionByName(own), (size[0] or 0) + heads, size[1] * heads


def keyed(convs: DataFrame, turns: DataFrame, segment: int | None) -> DataFrame:
    """conv_id, seg, key, words, entry (hash of all before), stop (hash up to here) and ends (no segment follows).

    Without `segment` every conversation is one.
    """
    seg = F.floor(F.col("position") / segment) if segment else F.lit(0).cast("long")
    parts = (
        turns.groupBy("conv_id", seg.alias("seg"))
        .agg(F.sort_array(F.collect_list(F.struct("position", "id", "words"))).alias("t"))
        .select("conv_id", "seg", F.unhex(F.array_join("t.id", "")).alias("key"), F.col("t.words").alias("words"))
    )
    empty = convs.join(turns.select("conv_id").distinct(), "conv_id", "left_anti").select(
        "conv_id", F.lit(0).cast("long").alias("seg"), F.unhex(F.lit("")).alias("key"), F.array().cast("array<long>").alias("words")
    )
    rows = parts.unionByName(empty).withColumn("own", F.sha2("key", 256))
    if not segment:
        return rows.select(
            "conv_id", "seg", "key", "words", F.lit("").alias("entry"), F.col("own").alias("stop"), F.lit(True).alias("ends")
        )
    line = Window.partitionBy("conv_id").orderBy("seg")
    before = F.collect_list("own").over(line.rowsBetween(Window.unboundedPreceding, -1))
    follows = F.lead("seg").over(line).isNotNull()
    return rows.withColumns({"_before": before, "ends": ~follows}).select(
        "conv_id", "seg", "key", "words",
        F.when(F.col("seg") > 0, F.sha2(F.array_join("_before", ","), 256)).otherwise("").alias("entry"),
        F.sha2(F.array_join(F.concat("_before", F.array("own")), ","), 256).alias("stop"), "ends",
    )


def _borders(rows: DataFrame) -> dict[int, tuple[int, int]]:
    """Per range: whole turns that its first key shares with the last key before it (-1 if none is), and with its own last key."""

    def shared(batches):
        for batch in batches:
            before, first, last = (batch.column(c).to_pylist() for c in ("_before", "_first", "_last"))
            same = [-1 if a is None else common(a, b) // WIDTH for a, b in zip(before, first, strict=True)]
            inner = [common(a, b) // WIDTH for a, b in zip(first, last, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_part"), pa.array(same, pa.int64()), pa.array(inner, pa.int64())], ["_part", "same", "inner"]
            )

    ends = rows.groupBy("_part").agg(F.min("key").alias("_first"), F.max("key").alias("_last"))
    # one row per range
    line = ends.withColumn("_before", F.lag("_last").over(Window.orderBy("_part")))
    found = line.mapInArrow(shared, "_part long, same long, inner long").collect()
    return {r["_part"]: (r["same"], r["inner"]) for r in found}


def first_ranges(borders: list[tuple[int, int]], place: int) -> list[int]:
    """For each depth up to the border before this range, the first of the ranges that share the node there."""
    top = borders[place][0]
    starts = [place] * (top + 1)
    while top >= 0:
        place -= 1
        starts[: top + 1] = [place] * (top + 1)
        top = min(top, *borders[place])
    return starts


NODES = {
    "at": "long", "depth": "long", "shared": "boolean", "above": "long", "first": "long", "n": "long", "children": "long",
    "leaves": "long", "by_members": "long", "by_nodes": "long", "parent": "long", "stop": "string", "entry": "string",
}
_KINDS = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}
#: Rows of a batch that a task sends.
ROWS = 20_000


def _nodes(table: dict, place: int, borders: list[tuple[int, int]], skip: int):
    """Trie nodes of one range, as tuples in the order of NODES.

    `table` holds the columns of the range's distinct keys in order. Nodes down to the depth `left` on the first key's
    path are shared with the range before, those down to `right` on the last key's with the next one. Nodes above
    `skip` belong to the segment before.
    """
    keys, words = table["key"], table["words"]
    left, right = borders[place][0], borders[place + 1][0] if place + 1 < len(borders) else -1
    starts, end = first_ranges(borders, place), len(keys) - 1
    tree = preorder(grown(keys))
    n, first = [0] * len(tree), [None] * len(tree)
    # of all below: topmost trie nodes, childless ones, words by members, words by nodes
    below = [[0, 0, 0, 0] for _ in tree]
    edges = [None] * len(tree)
    for i in range(len(tree) - 1, -1, -1):
        node, above = tree[i]
        sums = below[i]
        low, high = (node.start // WIDTH + 1 if above >= 0 else 0), node.end // WIDTH
        if node.last >= 0:
            n[i] += table["n"][node.last]
            smallest = table["first"][node.last]
            first[i] = smallest if first[i] is None else min(first[i], smallest)
            if table["b_leaves"][node.last] is not None:
                for k, name in enumerate(("b_children", "b_leaves", "b_members", "b_nodes")):
                    sums[k] += table[name][node.last]
            elif not node.slots and not (node.last == end and right >= high):
                sums[1] += 1
        if high >= low:
            # depths that the ranges before and after have too
            again = min(left, common(keys[0], keys[node.row]) // WIDTH) if left >= low else -1
            after = min(right, common(keys[end], keys[node.row]) // WIDTH) if right >= low - 1 else -1
            own, edge = words[node.row], []
            children = sums[0]
            for depth in range(high, low - 1, -1):
                size = own[depth - 1] if depth > skip else 0
                sums[2] += n[i] * size
                if depth > again:
                    sums[3] += size
                edge.append((depth, children, sums[1], sums[2], sums[3]))
                children = int(depth > again)
            sums[0] = children
            edges[i] = (edge, again, after)
        if above >= 0:
            n[above] += n[i]
            first[above] = first[i] if first[above] is None else min(first[above], first[i])
            for k in range(4):
                below[above][k] += sums[k]
    parents = [None] * len(tree)
    for i, (node, above) in enumerate(tree):
        parent = parents[above] if above >= 0 else None
        if edges[i] is None:
            parents[i] = parent
            continue
        edge, again, after = edges[i]
        # the parent of the topmost one lies on the same path, one turn higher
        high_again = min(left, common(keys[0], keys[node.row]) // WIDTH) if left >= 0 else -1
        for depth, children, leaves, by_members, by_nodes in reversed(edge):
            if depth >= skip:
                ended = node.last >= 0 and depth * WIDTH == node.end
                inherited = depth - 1 <= high_again
                shared_above = depth > skip and (inherited or depth - 1 <= after)
                yield (
                    starts[depth] if depth <= again else place, depth, depth <= max(again, after),
                    (starts[depth - 1] if inherited else place) if shared_above else None,
                    first[i], n[i], children, leaves, by_members, by_nodes, None if shared_above or depth == skip else parent,
                    table["stop"][node.last] if ended else None, table["entry"][node.row],
                )
            parent = first[i]
        parents[i] = parent


def _level(seqs: DataFrame, skip: int, turns: int) -> DataFrame:
    """All nodes of one segment: NODES without at, shared and above; parent is null at the top."""
    spark = seqs.sparkSession
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), turns // RANGE + 1)
    placed = checkpointed(seqs.repartitionByRange(ranges, "key").sortWithinPartitions("key")).withColumn(
        "_part", F.shiftright(F.monotonically_increasing_id(), 33)
    )
    found = _borders(placed)
    number = {part: i for i, part in enumerate(sorted(found))}
    borders = [found[part] for part in sorted(found)]

    def tasks(batches):
        table, part = {}, None
        for batch in batches:
            for name in batch.schema.names:
                table.setdefault(name, []).extend(batch.column(name).to_pylist())
        if not table or not table["key"]:
            return
        part = table["_part"][0]
        held = []
        for row in _nodes(table, number[part], borders, skip):
            held.append(row)
            if len(held) == ROWS:
                yield _batch(held)
                held = []
        if held:
            yield _batch(held)

    nodes = checkpointed(placed.mapInArrow(tasks, ", ".join(f"{k} {v}" for k, v in NODES.items())))
    shared = checkpointed(
        nodes.where("shared").groupBy("at", "depth").agg(
            F.max("above").alias("above"), F.min("first").alias("first"),
            *(F.sum(c).alias(c) for c in ("n", "children", "leaves", "by_members", "by_nodes")),
            F.max("parent").alias("parent"), F.max("stop").alias("stop"), F.max("entry").alias("entry"),
        )
    )
    parents = shared.select(F.col("at").alias("_at"), (F.col("depth") + 1).alias("_depth"), F.col("first").alias("_first"))
    if shared.count() <= FEW:
        parents = F.broadcast(parents)
    every = nodes.where("NOT shared").drop("shared").unionByName(shared)
    under = every.where("above IS NOT NULL").join(parents, (F.col("above") == F.col("_at")) & (F.col("depth") == F.col("_depth")))
    return every.where("above IS NULL").drop("at", "above").unionByName(
        under.withColumn("parent", F.col("_first")).drop("at", "above", "_at", "_depth", "_first")
    )


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, k in zip(columns, NODES.values(), strict=True)], list(NODES))


def _packed(members: DataFrame) -> DataFrame:
    """stop, _part, at and ids: the members' ids in order, comma-joined, in pieces."""

    def tasks(batches):
        at, stop, ids, size, out = 0, None, [], 0, []

        def close():
            nonlocal at, ids, size
            if ids:
                out.append((stop, part, at, ",".join(ids)))
                at, ids, size = at + 1, [], 0

        def sent():
            nonlocal out
            columns, out = list(zip(*out, strict=True)), []
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)],
                ["stop", "_part", "at", "ids"],
            )

        for batch in batches:
            for now, conv, part_ in zip(*(batch.column(c).to_pylist() for c in ("stop", "conv_id", "_part")), strict=True):
                if now != stop or size > PACK:
                    close()
                stop, part = now, part_
                ids.append(str(conv))
                size += len(ids[-1]) + 1
            if out:
                yield sent()
        close()
        if out:
            yield sent()

    rows = arranged(members, F.col("stop"), F.col("conv_id")).drop("_at")
    return rows.mapInArrow(tasks, "stop string, _part long, at long, ids string")


def ends_hashes(members: DataFrame) -> DataFrame:
    """stop and ends_sha256 of the members (conv_id, stop)."""

    def tasks(batches):
        stop, running_ = None, None
        for batch in batches:
            out = []
            for now, ids in zip(batch.column("stop").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if now == stop:
                    running_.update(b",")
                else:
                    if stop is not None:
                        out.append((stop, running_.hexdigest()))
                    stop, running_ = now, hashlib.sha256()
                running_.update(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out, strict=True)], ["stop", "ends_sha256"])
        if stop is not None:
            yield pa.RecordBatch.from_arrays([pa.array([stop]), pa.array([running_.hexdigest()])], ["stop", "ends_sha256"])

    pieces = _packed(members).repartition("stop").sortWithinPartitions("stop", "_part", "at")
    return pieces.mapInArrow(tasks, "stop string, ends_sha256 string")


def trie(turns: DataFrame, segment: int = SEGMENT, stride: int = 20, heads: int = 4) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    convs, own, longest, total = rebuilt(turns, stride, heads)
    segments = -(-max(longest, 1) // segment)
    rows = checkpointed(keyed(convs, own, segment if segments > 1 else None))
    seqs = checkpointed(
        rows.groupBy("seg", "entry", "stop").agg(
            F.first("key").alias("key"), F.first("words").alias("words"), F.count("*").alias("n"), F.min("conv_id").alias("first")
        )
    )
    below, levels = None, []
    for seg in range(segments - 1, -1, -1):
        skip = ENTRY if seg else 0
        level = seqs.where(F.col("seg") == seg).withColumns({
            "key": F.concat(F.unhex("entry"), F.col("key")),
            "words": F.concat(F.array_repeat(F.lit(0).cast("long"), skip), F.col("words")),
        })
        if below is None:
            none = {c: F.lit(None).cast("long") for c in ("b_children", "b_leaves", "b_members", "b_nodes")}
            level = level.withColumns(none)
        else:
            level = level.join(below, "stop", "left")
        nodes = checkpointed(_level(level.drop("seg"), skip, total))
        if seg:
            below = nodes.where(F.col("depth") == skip).select(
                F.col("entry").alias("stop"), F.col("children").alias("b_children"), F.col("leaves").alias("b_leaves"),
                F.col("by_members").alias("b_members"), F.col("by_nodes").alias("b_nodes"),
            )
            nodes = nodes.where(F.col("depth") > skip)
        levels.append((seg, skip, nodes))
    levels.reverse()
    every = None
    for i, (seg, skip, nodes) in enumerate(levels):
        if i:  # the first turns of a segment hang on the node where the segment before ended
            tops = levels[i - 1][2].where("stop IS NOT NULL").select(F.col("stop").alias("entry"), F.col("first").alias("_first"))
            first = nodes.where(F.col("depth") == skip + 1).join(tops, "entry").withColumn("parent", F.col("_first")).drop("_first")
            nodes = nodes.where(F.col("depth") > skip + 1).unionByName(first)
        moved = nodes.withColumn("depth", F.col("depth") + (seg * segment - skip)).drop("entry")
        every = moved if every is None else every.unionByName(moved)
    hashes = ends_hashes(rows.where("ends").select("conv_id", "stop"))
    with_end = every.where("stop IS NOT NULL").join(hashes, "stop", "left")
    inner = every.where("stop IS NULL").withColumn("ends_sha256", F.lit(None).cast("string"))
    return with_end.unionByName(inner).select(
        F.col("first").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"),
        (F.col("by_members") - F.col("by_nodes")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def oracle() -> str:
    """Every beginning of every rebuilt conversation as a list of turns; each node tells all its beginnings."""
    return rf"""
    WITH steps AS (SELECT list({crc_entry("i")} ORDER BY i) AS tab FROM range(256) s(i)),
    said AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
    named AS (
      SELECT conv_id, turn, role, substr(sha256(length(role) || ':' || role || text), 1, {2 * WIDTH}) AS id,
        len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w FROM said),
    turns AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, id) - 1 AS k FROM named),
    convs AS (
      SELECT conv_id, conv_id - conv_id % 20 AS base,
        xor(list_reduce(list_transform(regexp_extract_all(hex(encode(conv_id::VARCHAR)), '..'), lambda x: ('0x' || x)::BIGINT),
          lambda a, x: xor(a // 256, tab[xor(a % 256, x) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) % 4 AS h
      FROM (SELECT DISTINCT conv_id FROM said), steps),
    parts AS (
      SELECT c.conv_id, k, id, w FROM convs c JOIN turns t ON t.conv_id = base AND k < h
      UNION ALL SELECT c.conv_id, k + 4, id, w FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND k >= h),
    lists AS (SELECT conv_id, list(id ORDER BY k) AS ids, list(w ORDER BY k) AS ws FROM parts GROUP BY conv_id),
    seqs AS (SELECT conv_id, coalesce(ids, []) AS ids, coalesce(ws, []) AS ws FROM convs LEFT JOIN lists USING (conv_id)),
    nodes AS (
      SELECT ids[1:d] AS p, d, min(conv_id) AS first, count(*) AS n, coalesce(any_value(ws[d]), 0) AS w,
        coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(ids) = d), '') AS ends
      FROM seqs, unnest(range(0, len(ids) + 1)) u(d) GROUP BY 1, 2),
    below AS (SELECT p[1:d - 1] AS p, d - 1 AS d, count(*) AS c FROM nodes WHERE d > 0 GROUP BY 1, 2),
    full_ AS (SELECT nodes.*, coalesce(c, 0) AS c FROM nodes LEFT JOIN below USING (p, d)),
    sums AS (
      SELECT p[1:k] AS p, k AS d, count(*) FILTER (c = 0) AS leaves, sum((n - 1) * w)::BIGINT AS saved
      FROM full_, unnest(range(0, d + 1)) u(k) GROUP BY 1, 2)
    SELECT f.first AS conv_id, f.d AS depth, a.first AS parent_conv_id, f.n AS n_convs, f.c AS n_children, leaves AS n_leaves,
      saved AS saved_tokens, sha256(f.ends) AS ends_sha256
    FROM full_ f JOIN sums s ON f.p = s.p AND f.d = s.d LEFT JOIN nodes a ON a.d = f.d - 1 AND a.p = f.p[1:f.d - 1]
    """
