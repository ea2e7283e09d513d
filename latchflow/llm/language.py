"""Language identification by fusing evidence with Bayes' rule.

For each text and language, log odds of these independent observations are added:

- text: byte-trigram likelihoods, trained on at most SAMPLE documents per declared language, or pages if no
  document with an id declares it; a text speaks with the weight of at most SPEAKS trigrams, so it can be overruled;
- markup: the language that the page declares, with P(declared | language) counted over all pages;
- address: the suffix of the host, with P(suffix | language) counted over all pages;
- host: a prior from the other pages of the same host, smoothed towards its domain, that towards its
  suffix, and that towards all pages, each with the weight of STRENGTH pages.

Counts are sums of the texts' own posteriors, grouped by host, domain, suffix and declared language, so a host of any
size is pre-aggregated; a page's own share is taken out of its host's.

Every language that a document or a page's markup declares is a class. Classes are scored in blocks of BLOCK:
each row's normaliser, and at the end its likeliest language, are put together from all blocks, so results do
not depend on BLOCK. The driver and the tasks hold the dense likelihoods of one block.

Documents take part with their source as host, without markup or address. Nulls: missing evidence says nothing;
texts without letters are judged by the rest. Repeated rows are judged each. An empty table gives
an empty result; without declared languages the language is null.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latchflow.llm.common import U64, checkpointed, mix, owners, sampled, slices

SAMPLE, SPEAKS, STRENGTH, BITS = 200, 60, 5.0, 16
#: Languages that are scored at once.
BLOCK = 32
#: Trigrams whose likelihoods are looked up at a time.
GRAMS = 1 << 16


def _trigrams(part) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte trigrams of lower-case texts (signs and digits as blanks), and the rows' borders."""
    data = part.data.copy()
    data[(data < 0x61) | ((data > 0x7A) & (data < 0x80))] = 0x20
    n = max(0, len(data) - 2)
    code = data[:n].astype(np.uint64) * U64(65536) + data[1 : n + 1].astype(np.uint64) * U64(256) + data[2:].astype(np.uint64)[:n]
    index = (mix(code) >> U64(64 - BITS)).astype(np.int64)
    inside = np.ones(n, dtype=bool)
    for back in (1, 2):
        at = part.offsets[1:-1] - back
        inside[at[(at >= 0) & (at < n)]] = False
    blank = (data[:n] == 0x20) & (data[1 : n + 1] == 0x20)
    inside &= ~blank
    total = np.concatenate([[0], np.cumsum(inside)])
    return index[inside], total[np.minimum(part.offsets, n)]


def _examples(known: DataFrame, own: list[str], sample: int) -> DataFrame:
    """label and text of at most `sample` ids per language of `own`, from (doc_id, text, lang)."""
    labels = known.where(F.col("lang").isin(own)).select("doc_id", F.col("lang").alias("label")).distinct()
    return sampled(known, labels, sample, "label").where("lang = label").select("label", "text")


def train(docs: DataFrame, sample: int = SAMPLE, pages: DataFrame | None = None) -> tuple[list[str], list[tuple[np.ndarray, np.ndarray]]]:
    """Languages of docs and of page_rows(), and each one's hashed trigrams with their numbers."""
    known = docs.where("lang IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    more = known.where("doc_id IS NULL").select("text", "lang")
    if pages is not None:
        more = more.unionByName(pages.where("declared IS NOT NULL").select("text", F.col("declared").alias("lang")))
    known = known.where("doc_id IS NOT NULL")
    main = {r["lang"] for r in known.select("lang").distinct().toLocalIterator()}
    names = sorted(main | {r["lang"] for r in more.select("lang").distinct().toLocalIterator()})
    # the others have no id to be drawn by, but their texts
    more = more.withColumn("doc_id", F.xxhash64("text"))
    table = []
    for first in range(0, len(names), BLOCK):
        own = names[first : first + BLOCK]
        parts = [
            _examples(rows, part, sample)
            for rows, part in (
                (known, [x for x in own if x in main]),
                (more.where(F.col("lang").isin([x for x in own if x not in main])).dropDuplicates(["doc_id", "lang"]),
                 [x for x in own if x not in main]),
            )
            if part
        ]
        table += _counted(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]), own)
    return names, table


def _counted(rows: DataFrame, names: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per name, the hashed trigrams of its texts and how often they occur."""
    place = {x: i for i, x in enumerate(names)}

    def tasks(batches):
        for batch in batches:
            label = np.array([place[x] for x in batch.column("label").to_pylist()])
            held = {}
            for part in slices(batch.column("text"), lower=True):
                index, borders = _trigrams(part)
                for k in range(part.rows):
                    lang = int(label[part.first + k])
                    held.setdefault(lang, np.zeros(1 << BITS, np.int32))
                    np.add.at(held[lang], index[borders[k] : borders[k + 1]], 1)
            for lang, counts in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([counts.tobytes()], pa.binary())], ["l", "c"])

    counts = np.zeros((len(names), 1 << BITS), np.int64)
    for r in rows.mapInArrow(tasks, "l long, c binary").toLocalIterator():
        counts[r["l"]] += np.frombuffer(r["c"], dtype=np.int32)
    seen = [np.flatnonzero(c).astype(np.int32) for c in counts]
    return [(at, c[at]) for at, c in zip(seen, counts, strict=True)]


def _likelihoods(table: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Log likelihood of each hashed trigram in each language (one column per language)."""
    counts = np.full((1 << BITS, len(table)), 0.5)
    for k, (at, n) in enumerate(table):
        counts[at, k] += n
    return np.log(counts / counts.sum(axis=0)).astype(np.float32)


def _row_sums(table: np.ndarray, index: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Sums of the table's rows at `index`, per text; some trigrams at a time, however long a text is."""
    out = np.zeros((len(borders) - 1, table.shape[1]))
    row = owners(borders)
    for first in range(0, len(index), GRAMS):
        part = row[first : first + GRAMS]
        starts = np.flatnonzero(np.diff(part, prepend=-1))
        out[part[starts]] += np.add.reduceat(table[index[first : first + GRAMS]], starts, axis=0, dtype=np.float64)
    return out


def _text_scores(rows: DataFrame, table: np.ndarray, first: int) -> DataFrame:
    """Replace text by t: the log likelihoods, at the weight the text may have.

    _m is the largest of t, _z the sum of exp(t - _m) and _a the place of _m, counted from `first`.
    """
    kept, k = [c for c in rows.columns if c != "text"], table.shape[1]

    def tasks(batches):
        for batch in batches:
            out = []
            for part in slices(batch.column("text"), lower=True):
                index, borders = _trigrams(part)
                n = np.diff(borders)
                out.append(_row_sums(table, index, borders) * np.minimum(1, SPEAKS / np.maximum(n, 1))[:, None])
            flat = np.concatenate([*out, np.zeros((0, k))])
            most = flat.max(axis=1)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(flat.reshape(-1)), k).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), lists, pa.array(most), pa.array(np.exp(flat - most[:, None]).sum(axis=1)),
                 pa.array((first + flat.argmax(axis=1)).astype(np.int32))],
                [*kept, "t", "_m", "_z", "_a"],
            )

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(tasks, ", ".join(f"{c} {kinds[c]}" for c in kept) + ", t array<double>, _m double, _z double, _a int")


def _whole(parts: list[DataFrame]) -> DataFrame:
    """Per _row, _m, _z and _a of all blocks, from those of each; of equal languages the first."""
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    found = rows.groupBy("_row").agg(F.collect_list(F.struct("_m", "_z", "_a")).alias("_b"))
    best = F.array_max(F.transform("_b", lambda x: F.struct(x["_m"].alias("_m"), (-x["_a"]).alias("_n"))))
    found = found.withColumn("_best", best)
    terms = F.transform(F.array_sort("_b"), lambda x: x["_z"] * F.exp(x["_m"] - F.col("_best")["_m"]))
    return found.select(
        "_row", F.col("_best")["_m"].alias("_m"), F.aggregate(terms, F.lit(0.0), lambda a, x: a + x).alias("_z"),
        (-F.col("_best")["_n"]).alias("_a"),
    )


def page_rows(pages: DataFrame) -> DataFrame:
    """page_id, text, declared, host, domain and suffix of raw pages."""
    markup = r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->|<[^>]+>|&\w+;"
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))
    declared = F.lower(F.regexp_extract("html", r"(?i)<html[^>]*?\slang\s*=\s*[\"']?([A-Za-z]{2,3})", 1))
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.regexp_replace("html", markup, " ").alias("text"),
        F.when(declared != "", declared).alias("declared"), F.when(host != "", host).alias("host"),
    ).withColumns({
        "domain": F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1), "suffix": F.regexp_extract("host", r"([^.]+)$", 1),
    })


def _sums(rows: DataFrame, by: str, k: int) -> DataFrame:
    """Per value of `by`: the summed posteriors n, as an array, and the number of rows."""
    named = rows.where(F.col(by).isNotNull()).groupBy(by).agg(
        F.count("*").alias(f"rows_{by}"), *(F.sum(F.col("p")[i]).alias(f"_{i}") for i in range(k))
    )
    return named.select(F.col(by), f"rows_{by}", F.array(*(F.col(f"_{i}") for i in range(k))).alias(f"n_{by}"))


def _zip(a: Column, b: Column, f) -> Column:
    return F.zip_with(a, b, f)


def _fused(scored: DataFrame, totals: list[float], sizes: float, first: int) -> DataFrame:
    """Add to rows with t and p of one block the fused _m, _z and _a of its languages, for `sizes` rows in all."""
    k = len(totals)
    none = F.array_repeat(F.lit(0.0), k)
    out = scored
    for by in ("suffix", "domain", "host", "declared"):
        out = out.join(_sums(scored, by, k), by, "left")
    prior = F.array(*(F.lit(x / sizes) for x in totals))
    own = F.col("p")
    for by in ("suffix", "domain", "host"):
        others = _zip(F.coalesce(f"n_{by}", none), own, lambda n, p: F.greatest(n - p, F.lit(0.0)))
        others = F.when(F.col(f"n_{by}").isNotNull(), others).otherwise(none)
        # each row's posteriors add up to 1 over all blocks
        size = F.coalesce(F.col(f"rows_{by}") - 1, F.lit(0)).cast("double")
        out = out.withColumn("_o", others).withColumn("_s", size)
        out = out.withColumn(f"prior_{by}", _zip(F.col("_o"), prior, lambda n, q: (n + STRENGTH * q) / (F.col("_s") + STRENGTH)))
        prior = F.col(f"prior_{by}")
    # P(observation | language), up to a factor: its summed posteriors over those of all
    whole = F.array(*(F.lit(x) for x in totals))
    for by in ("declared", "suffix"):
        ratio = _zip(F.coalesce(f"n_{by}", none), whole, lambda n, t: F.log((n + 0.5) / t))
        out = out.withColumn(f"says_{by}", F.when(F.col(f"n_{by}").isNotNull(), ratio).otherwise(none))
    fused = _zip(F.col("t"), prior, lambda a, q: a + F.log(q))
    for by in ("declared", "suffix"):
        fused = _zip(fused, F.col(f"says_{by}"), lambda a, x: a + x)
    out = out.withColumn("_f", fused).withColumn("_m", F.array_max("_f"))
    return out.withColumns({
        "_z": F.aggregate("_f", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("_m"))),
        "_a": (F.array_position("_f", F.col("_m")) - 1 + first).cast("int"),
    })


def identify(rows: DataFrame, names: list[str], table: list[tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Add lang, probability and text_lang to rows (text, declared, host, domain, suffix, ...)."""
    kept = [c for c in rows.columns if c != "text"]
    if not names:
        return rows.drop("text").withColumns(
            {"lang": F.lit(None).cast("string"), "probability": F.lit(None).cast("double"), "text_lang": F.lit(None).cast("string")}
        )
    firsts = range(0, len(names), BLOCK)
    posteriors = F.transform("t", lambda x: F.exp(x) / F.col("_z"))

    def relative(part: DataFrame) -> DataFrame:
        """t less the row's largest, p and the row's text language."""
        part = part.withColumn("t", F.transform("t", lambda x: x - F.col("_m"))).withColumn("p", posteriors)
        return checkpointed(part.withColumnRenamed("_a", "_text").drop("_m", "_z"))

    if len(firsts) == 1:
        parts = [relative(_text_scores(rows, _likelihoods(table), 0))]
    else:
        # every block reads the rows anew, so their numbers are fixed
        rows = checkpointed(rows.withColumn("_row", F.monotonically_increasing_id()))
        slim = rows.select("_row", "text", "declared", "host", "domain", "suffix")
        parts = [checkpointed(_text_scores(slim, _likelihoods(table[i : i + BLOCK]), i)) for i in firsts]
        norms = checkpointed(_whole([part.select("_row", "_m", "_z", "_a") for part in parts]))
        parts = [relative(part.drop("_m", "_z", "_a").join(norms, "_row")) for part in parts]
    totals = []
    for i, part in zip(firsts, parts, strict=True):
        whole = part.agg(*(F.sum(F.col("p")[j]) for j in range(len(names[i : i + BLOCK])))).first()
        totals.append([float(x or 0) + 1 for x in whole])
    sizes = sum(map(sum, totals))
    fused = [_fused(part, own, sizes, i) for i, part, own in zip(firsts, parts, totals, strict=True)]
    if len(fused) == 1:
        out = fused[0]
    else:
        best = _whole([checkpointed(part.select("_row", "_m", "_z", "_a")) for part in fused])
        out = rows.drop("text").join(best, "_row").join(parts[0].select("_row", "_text"), "_row")
    label = F.array(*map(F.lit, names))
    return out.select(*kept, F.get(label, F.col("_a")).alias("lang"), (1 / F.col("_z")).alias("probability"),
                      F.get(label, F.col("_text")).alias("text_lang"))


def query(spark, sf_dir: str) -> DataFrame:
    """Documents under their doc_id, pages under -1 - page_id, so that ids stay apart."""
    docs, pages = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "pages"))
    pages = page_rows(pages)
    names, table = train(docs, pages=pages)
    null = F.lit(None).cast("string")
    plain = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("long").alias("page_id"), "text", null.alias("declared"),
        F.concat(F.lit("source:"), F.col("source")).alias("host"), null.alias("domain"), null.alias("suffix"),
    )
    web = pages.select((-1 - F.col("page_id")).alias("doc_id"), "page_id", "text", "declared", "host", "domain", "suffix")
    return identify(plain.unionByName(web), names, table).select("doc_id", "page_id", "lang", "probability", "text_lang", "declared")
