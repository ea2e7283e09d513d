"""Benchmark decontamination by spaced seeds, in DataFrame operations only.

Texts become lower-cased runs of letters and digits, and single characters in scripts without spaces. A mask names the token positions of a seed that
count; the others are ignored, so a seed survives substitutions there. Seeds of documents are
hashed and joined with those of the benchmark. Around each hit, all windows of WINDOW tokens (or the item's
length, if less) that hold the seed are compared position by position in both texts; positions
beyond either text count as substitutions. A pair (doc_id, item_id) leaks if SHARE percent of some
window agree. The masks hit every such window, wherever its substitutions are (tests try all places).

Items of 4 to 7 tokens leak where all their tokens stand in a row; shorter ones leak nowhere. Null and
empty texts leak nowhere; a null doc_id or item_id stays null. Repeated rows fall into the same pair. Empty
tables give an empty result. Other columns are ignored.

The benchmark is the query set: its seeds' hashes are broadcast, and the tokens around hits are held against
blocks of about BLOCK token positions, which are broadcast too. A larger benchmark takes several of both, one after
another, and hits wait in the shared folder, so no broadcast grows with the benchmark. Documents are scanned in pieces
of PIECE positions, so the rows that a task holds don't grow with the hits in a document.
"""

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latchflow.llm.common import checkpointed, released

MASKS = ("110111", "11101", "1110011")
WINDOW, SHARE = 13, 80
SHORT = range(4, 8)
BLOCK = 50_000
#: Hashes that documents are scanned for at a time, for each position of a block.
HASHES = 10
#: Positions of a piece, and the tokens before and after a seed that its windows reach.
PIECE = 256
BEFORE, AFTER = WINDOW - min(len(m) for m in MASKS), WINDOW - 1


#: Scripts without spaces between words: every character is a token.
UNSPACED = ("Han", "Hiragana", "Katakana", "Thai", "Lao", "Khmer", "Myanmar")


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits; one empty token if there is none, null for null."""
    single = "([" + "".join(rf"\p{{Is{x}}}" for x in UNSPACED) + "])"
    spread = F.when(text.rlike(single), F.regexp_replace(F.lower(text), single, " $1 ")).otherwise(F.lower(text))
    return F.split(F.trim(F.regexp_replace(spread, r"[^\p{L}\p{N}]+", " ")), " ")


def masks() -> list[tuple[str, int, int]]:
    """Mask, and the smallest and largest number of tokens of the items it is for."""
    return [(m, SHORT.stop, 1 << 30) for m in MASKS] + [("1" * n, n, n) for n in SHORT]


def _seed(words: Column, at: Column, number: int, mask: str) -> Column:
    """Hash of one seed; null beyond the text."""
    picked = [F.get(words, at + i) for i, c in enumerate(mask) if c == "1"]
    return F.when(F.get(words, at + len(mask) - 1).isNotNull(), F.xxhash64(F.lit(number), *picked))


def _need(size: Column) -> Column:
    """Agreeing positions that a window of this size needs."""
    return F.when(size < SHORT.stop, size).otherwise(F.ceil(size * SHARE / 100)).cast("int")


def seeds(benchmark: DataFrame) -> DataFrame:
    """h, item_id, span, size (of windows), need, the tokens around each seed of the benchmark, and a hash of its place."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), tokens(F.col("text")).alias("w")).where(
        F.size("w") >= SHORT.start
    )
    placed = items.select("item_id", "w", F.size("w").alias("n"), F.posexplode_outer("w").alias("at", "_")).drop("_")
    every = F.array_compact(F.array(*(
        F.when(
            F.col("n").between(low, high) & (F.col("at") + len(m) <= F.col("n")),
            F.struct(_seed(F.col("w"), F.col("at"), i, m).alias("h"), F.lit(len(m)).alias("span")),
        )
        for i, (m, low, high) in enumerate(masks())
    )))
    size = F.least(F.lit(WINDOW), F.col("n"))
    around = F.transform(F.sequence(F.col("span") - F.col("size"), F.col("size") - 1), lambda k: F.get("w", F.col("at") + k))
    return (
        placed.select("item_id", "w", "n", "at", F.xxhash64("item_id", "at", "w").alias("place"), F.explode(every).alias("s"))
        .select("item_id", "w", "at", "place", "s.h", "s.span", size.alias("size"))
        .select("h", "item_id", "span", "size", _need(F.col("size")).alias("need"), around.alias("around"), "place")
    )


def leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """doc_id, item_id, n_agreeing (windows by seed that agree) and agreement (best share of a window)."""
    wanted = seeds(benchmark)
    count, different = wanted.agg(F.count("*"), F.count_distinct("h")).first()
    short = {r["span"] for r in wanted.where(F.col("size") < SHORT.stop).select("span").distinct().collect()}
    hashes = wanted.select("h").distinct()
    parts, scans = (-(-n // m) or 1 for n, m in ((count, len(MASKS) * block), (different, HASHES * block)))
    if parts == 1:
        return _pairs(_hits(docs, hashes, key, short), wanted, key)
    hits = _joined(_hits(docs, hashes.where(F.pmod("h", F.lit(scans)) == i), key, short) for i in range(scans))
    found = _joined(_pairs(hits, wanted.where(F.pmod("place", F.lit(parts)) == i), key) for i in range(parts))
    return found.groupBy(key, "item_id").agg(
        F.sum("n_agreeing").alias("n_agreeing"), F.max("agreement").alias("agreement")
    )


def _joined(steps: Iterator[DataFrame]) -> DataFrame:
    """All rows of the steps, which run one after another; what each has broadcast is let go."""
    found = []
    for step in steps:
        found.append(checkpointed(step))
        released(step.sparkSession)
    return reduce(DataFrame.unionByName, found)


def _hits(docs: DataFrame, hashes: DataFrame, key: str, short: set[int]) -> DataFrame:
    """h and the tokens around each seed of a document that has one of the hashes."""
    used = [(i, m) for i, (m, low, high) in enumerate(masks()) if low != high or low in short]
    # A compiled stage keeps all rows that it makes of one input row until they are read, so no stage may turn a whole
    # text into its hits. Pieces, `near` and `same` are lambdas, which Spark doesn't compile: there a stage ends.
    texts = docs.select(key, tokens(F.col("text")).alias("w"))
    starts = F.sequence(F.lit(0), F.array_size("w") - 1, F.lit(PIECE))
    cut = F.transform(starts, lambda s: F.struct(
        F.slice("w", F.greatest(s - BEFORE, F.lit(0)) + 1, F.least(s, F.lit(BEFORE)) + PIECE + AFTER).alias("w"),
        F.least(s, F.lit(BEFORE)).alias("first"),
    ))
    pieces = texts.select(key, F.explode_outer(cut).alias("piece")).select(key, "piece.w", "piece.first")
    own = F.sequence(F.col("first"), F.least(F.col("first") + PIECE, F.array_size("w")) - 1)
    words, at = F.col("w"), F.col("p")
    shown = (
        pieces.select(key, "w", F.explode_outer(own).alias("p"))
        .select(key, "w", "p", F.explode_outer(F.array(*(_seed(words, at, i, m) for i, m in used))).alias("h"))
    )
    near = F.transform(F.sequence(F.lit(-BEFORE), F.lit(AFTER)), lambda k: F.get(words, at + k))
    return shown.join(F.broadcast(hashes), "h", "left_semi").select(key, "h", near.alias("near"))


def _pairs(hits: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """What leaks() returns, of these hits and seeds of the benchmark."""
    met = hits.join(F.broadcast(wanted.drop("place")), "h")
    same = F.zip_with(
        F.transform(F.sequence(F.col("span") - F.col("size"), F.col("size") - 1), lambda k: F.get("near", k + BEFORE)),
        F.col("around"),
        lambda a, b: F.when(a == b, 1).otherwise(0),
    )
    sums = F.transform(
        F.sequence(F.lit(1), F.col("size") - F.col("span") + 1),
        lambda s: F.aggregate(F.slice("same", s, F.col("size")), F.lit(0), lambda a, x: a + x),
    )
    # Exploding the windows keeps the comparison out of the join's condition, so the join is compiled.
    agreeing = (
        met.select(key, "item_id", "size", "need", "span", same.alias("same"))
        .select(key, "item_id", "size", "need", F.explode_outer(sums).alias("equal"))
        .where("equal >= need")
        .select(key, "item_id", (F.col("equal") * 100 / F.col("size")).alias("share"))
    )
    return agreeing.groupBy(key, "item_id").agg(F.count("*").alias("n_agreeing"), F.max("share").alias("agreement"))


def query(spark, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return leaks(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), items)


def oracle() -> str:
    """The same windows around hits, with seeds as texts."""

    def seed(words: str, at: str, number: int, mask: str) -> str:
        picked = " || ' ' || ".join(f"{words}[{at} + {i + 1}]" for i, c in enumerate(mask) if c == "1")
        return f"'{number} ' || {picked}"

    bench = " UNION ALL ".join(
        f"SELECT item_id, w, n, q, {len(m)} AS span, {seed('w', 'q', i, m)} AS h FROM items, "
        f"unnest(range(0, n - {len(m) - 1})) u(q) WHERE n BETWEEN {low} AND {high}"
        for i, (m, low, high) in enumerate(masks())
    )
    shown = " UNION ALL ".join(
        f"SELECT r, p, {seed('w', 'p', i, m)} AS h FROM docs, unnest(range(0, len(w) - {len(m) - 1})) u(p)"
        for i, (m, _, _) in enumerate(masks())
    )
    single = "([" + "".join(rf"\p{{{x}}}" for x in UNSPACED) + "])"
    clean = (
        rf"string_split(trim(regexp_replace(regexp_replace(lower(text), '{single}', ' \1 ', 'g'), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ')"
    )
    return f"""
    WITH items AS (SELECT *, len(w) AS n FROM (SELECT item_id, {clean} AS w FROM benchmark WHERE text IS NOT NULL)),
    docs AS (SELECT row_number() OVER () AS r, doc_id, {clean} AS w FROM documents WHERE text IS NOT NULL),
    wanted AS (SELECT *, least(n, {WINDOW}) AS size FROM ({bench})),
    shown AS ({shown}),
    hits AS (
      SELECT doc_id, item_id, size, span, p, q, d.w AS dw, i.w AS iw
      FROM shown JOIN wanted i USING (h) JOIN docs d USING (r)),
    judged AS (
      SELECT doc_id, item_id, size, unnest(list_transform(range(0, size - span + 1), lambda s: list_sum(
          list_transform(range(0, size), lambda k: CASE WHEN p + span - size + s + k >= 0 AND q + span - size + s + k >= 0
            AND dw[p + span - size + s + k + 1] = iw[q + span - size + s + k + 1] THEN 1 ELSE 0 END)))) AS best
      FROM hits)
    SELECT doc_id, item_id, count(*) AS n_agreeing, max(best * 100 / size) AS agreement FROM judged
    WHERE best >= CASE WHEN size < {SHORT.stop} THEN size ELSE ceil(size * {SHARE} / 100) END
    GROUP BY doc_id, item_id
    """
