"""URL filter by a sorted digest array.

Rules (host, path, verdict) fit their host and all its subdomains where the url's path starts with the rule's; the
longest rule wins (by host and path together, then by host). A url without a rule is blocked if a word of its host,
between dots and hyphens, is in the word list, else allowed.

All keys (rule hosts with the lengths of their paths, rules, words) form one array sorted by their 64-bit xxhash, with
the full strings beside it. It is written once to the shared folder and handed to the executors by Spark's file
distribution; tasks memory-map it, find the keys of a whole batch by vectorised binary search and compare the stored
strings of every digest found, so digests that collide change nothing. A url's keys are its host and each parent domain,
then, for the domains with rules, the path's beginnings of the lengths that these rules have, and its words.

The array goes to every executor only up to MAP_BYTES, which are counted first. Larger lists are joined
with the distinct (host, path) by digest and string instead.

Nulls and urls without `://` have empty host and path, hence no rule and no word. Rules without host or verdict are left
out, a null path is empty; of two verdicts for one rule block wins. Repeated rows are judged alike, each for
itself. An empty table gives an empty result, empty lists allow everything. Other columns are ignored.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from latchflow.plans.session import fresh_dir

# The rules of the query.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: Words of hosts that serve advertisements, gambling, adult content or spam.
WORDS = (
    "ad", "ads", "adult", "advert", "adverts", "bet", "bets", "betting", "casino", "casinos", "escort", "escorts", "gamble",
    "gambling", "jackpot", "lottery", "pharma", "pill", "pills", "poker", "porn", "porno", "roulette", "sex", "slots", "spam",
    "tracker", "viagra", "xxx",
)
#: Largest array that is copied to every executor.
MAP_BYTES = 64 << 20

HOST, RULE, WORD = b"h", b"r", b"w"
ALLOW, BLOCK = "allow", "block"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(key: bytes) -> int:
    return xxhash.xxh64_intdigest(key)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty for null and for urls without ://."""
    at = F.locate("://", url)
    rest = F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def word_table(spark: SparkSession, words=WORDS) -> DataFrame:
    return spark.createDataFrame([(w,) for w in words], "word string")


def _cleaned(rules: DataFrame) -> DataFrame:
    """Each rule once, with a verdict of its own."""
    path = F.coalesce("path", F.lit(""))
    return rules.where(F.col("host").isNotNull() & F.col("verdict").isNotNull()).groupBy(
        F.translate("host", _UPPER, _LOWER).alias("host"), path.alias("path")
    ).agg(F.max(F.col("verdict") == BLOCK).alias("blocks"))


class DigestArray:
    """Sorted digests, two numbers for each, and the strings; one buffer, laid out to be memory-mapped.

    The numbers of a host are the borders of its path lengths in `lengths`; the first one of a rule or
    word is 1 if it blocks.
    """

    def __init__(self, buffer, hashed=digest):
        whole = np.asarray(buffer)
        n, m, self.longest_host, self.longest_word = whole[:32].view(np.int64).tolist()
        cuts = np.cumsum([32, 8 * n, 16 * n, 8 * (n + 1), 8 * m]).tolist()
        self.keys = whole[cuts[0] : cuts[1]].view(np.uint64)
        self.numbers = whole[cuts[1] : cuts[2]].view(np.int64).reshape(n, 2)
        self.offsets = whole[cuts[2] : cuts[3]].view(np.int64)
        self.lengths = whole[cuts[3] : cuts[4]].view(np.int64)
        self.text = whole[cuts[4] :]
        self.hashed = hashed

    @staticmethod
    def build(rules: list[tuple[str, str, bool]], words: list[str], hashed=digest) -> bytes:
        """Layout of (host, path, blocks) and words."""
        entries, sizes, lengths = [], {}, []
        for host, path, blocks in rules:
            entries.append((_rule(host, path), int(blocks), 0))
            sizes.setdefault(host, set()).add(len(path))
        for host, found in sizes.items():
            entries.append((HOST + host.encode(), len(lengths), len(lengths) + len(found)))
            lengths += sorted(found)
        entries += [(WORD + w.encode(), 1, 0) for w in set(words)]
        longest = max(map(len, sizes), default=0), max(map(len, words), default=0)
        placed = sorted((hashed(key), key, a, b) for key, a, b in entries)
        offsets = np.cumsum([0, *(len(key) for _, key, _, _ in placed)])
        return b"".join((
            np.array([len(placed), len(lengths), *longest], dtype=np.int64).tobytes(),
            np.array([d for d, *_ in placed], dtype=np.uint64).tobytes(),
            np.array([(a, b) for _, _, a, b in placed], dtype=np.int64).tobytes(),
            offsets.astype(np.int64).tobytes(),
            np.array(lengths, dtype=np.int64).tobytes(),
            *(key for _, key, _, _ in placed),
        ))

    def find(self, keys: list[bytes]) -> np.ndarray:
        """Place of each key, -1 where the array doesn't hold it."""
        wanted = np.fromiter(map(self.hashed, keys), dtype=np.uint64, count=len(keys))
        place = np.searchsorted(self.keys, wanted)
        out = np.full(len(keys), -1, dtype=np.int64)
        open_ = np.arange(len(keys))
        while True:
            open_ = open_[place[open_] < len(self.keys)]
            open_ = open_[self.keys[place[open_]] == wanted[open_]]
            if not len(open_):
                return out
            # equal digests stand side by side: go on from those whose string is another one
            same = [
                self.text[self.offsets[p] : self.offsets[p + 1]].tobytes() == keys[i]
                for i, p in zip(open_.tolist(), place[open_].tolist(), strict=True)
            ]
            out[open_[same]] = place[open_[same]]
            open_ = open_[np.logical_not(same)]
            place[open_] += 1

    def judge(self, hosts: list[str], paths: list[str]) -> tuple[list, list]:
        """Rule (or None) and verdict of each url."""
        names = list(dict.fromkeys(hosts))
        probes, owner, texts = [], [], []
        for i, host in enumerate(names):
            for domain in domains(host, self.longest_host):
                probes.append(HOST + domain.encode())
                owner.append((i, domain))
        words = [
            (i, w) for i, host in enumerate(names) for w in set(host.replace("-", ".").split(".")) if len(w) <= self.longest_word
        ]
        found = self.find(probes + [WORD + w.encode() for _, w in words]).tolist()
        ruled = [[] for _ in names]
        for (i, domain), place in zip(owner, found, strict=False):
            if place >= 0:
                ruled[i].append((domain, self.lengths[slice(*self.numbers[place].tolist())].tolist()))
        bad = {names[i] for (i, _), place in zip(words, found[len(probes) :], strict=True) if place >= 0}
        number = {host: i for i, host in enumerate(names)}
        urls = {url: [] for url in zip(hosts, paths, strict=True)}
        probes = []
        for (host, path), own in urls.items():
            for domain, lengths in ruled[number[host]]:
                for size in lengths:
                    if size <= len(path):
                        own.append((len(domain) + size, len(domain), len(probes)))
                        texts.append(domain + path[:size])
                        probes.append(_rule(domain, path[:size]))
        found = self.find(probes).tolist()
        verdicts = {}
        for (host, path), own in urls.items():
            best = max((x for x in own if found[x[2]] >= 0), default=None)
            if best is None:
                verdicts[host, path] = (None, BLOCK if host in bad else ALLOW)
            else:
                blocks = self.numbers[found[best[2]], 0]
                verdicts[host, path] = (texts[best[2]], BLOCK if blocks else ALLOW)
        got = [verdicts[url] for url in zip(hosts, paths, strict=True)]
        return [rule for rule, _ in got], [verdict for _, verdict in got]


def _rule(host: str, path: str) -> bytes:
    return RULE + f"{host}\0{path}".encode()


def domains(host: str, longest: int) -> list[str]:
    """The host and its parent domains of at most `longest` characters; none for an empty host."""
    end = host[max(0, len(host) - longest - 1) :]
    starts = [i + 1 for i, c in enumerate(end) if c == "."]
    if host and len(host) <= longest:
        starts = [0, *starts]
    return [end[i:] for i in starts]


def _stored(spark: SparkSession, data: bytes) -> str:
    """Write to the shared folder and name it to the executors, which fetch a copy when they need it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(fresh_dir(spark, "urls") + ".array")
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    out = files.create(place)
    try:
        out.write(data)
    finally:
        out.close()
    spark.sparkContext.addFile(files.makeQualified(place).toString())
    return place.getName()


def judge(pages: DataFrame, rules: DataFrame, words: DataFrame, most: int = MAP_BYTES) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of pages (page_id, url)."""
    spark = pages.sparkSession
    host, path = host_and_path(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    rules = _cleaned(rules)
    words = words.where("word IS NOT NULL").select(F.translate("word", _UPPER, _LOWER).alias("word")).distinct()
    size = rules.agg(F.sum(F.octet_length("host") * 2 + F.octet_length("path") + 96)).first()[0] or 0
    size += words.agg(F.sum(F.octet_length("word") + 48)).first()[0] or 0
    if size > most:
        return _joined(urls, rules, words)
    listed = [tuple(r) for r in rules.select("host", "path", "blocks").collect()]
    name = _stored(spark, DigestArray.build(listed, [r["word"] for r in words.collect()]))

    def tasks(batches):
        array = DigestArray(np.memmap(SparkFiles.get(name), dtype=np.uint8, mode="r"))
        for batch in batches:
            found, verdicts = array.judge(batch.column("host").to_pylist(), batch.column("path").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found, pa.string()), pa.array(verdicts, pa.string())],
                [*batch.schema.names, "rule", "verdict"],
            )

    kind = dict(pages.dtypes)["page_id"]
    return urls.mapInArrow(tasks, f"page_id {kind}, host string, path string, rule string, verdict string")


def _joined(urls: DataFrame, rules: DataFrame, words: DataFrame) -> DataFrame:
    """The same by joins of digest and string, for lists of any size.

    Each (host, path) is judged once, however many rows have it.
    """
    seen = urls.select("host", "path").distinct()
    hosts = seen.select("host").distinct()
    longest = rules.agg(F.max(F.length("host"))).first()[0] or 0
    # a long host's end, of which the piece before the first dot is no domain
    cut = F.length("host") > longest
    parts = F.split(F.when(cut, F.right("host", F.lit(longest + 1))).otherwise(F.col("host")), r"\.")
    every = F.filter(
        F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.when(~cut | (i > 1), F.array_join(F.slice(parts, i, F.size(parts)), "."))),
        lambda d: d.isNotNull(),
    )
    above = hosts.where("host <> ''").select("host", F.explode(every).alias("domain"))
    sizes = rules.groupBy(F.col("host").alias("domain")).agg(F.collect_set(F.length("path")).alias("sizes"))
    ruled = _met(above, sizes, "domain").select("host", "domain", F.explode("sizes").alias("size"))
    keys = seen.join(ruled, "host").where(F.length("path") >= F.col("size")).select(
        "host", "path", "domain", F.expr("substring(path, 1, size)").alias("begin")
    )
    wanted = rules.select(F.struct(F.col("host").alias("domain"), F.col("path").alias("begin")).alias("key"), "blocks")
    fitting = _met(keys.select("host", "path", F.struct("domain", "begin").alias("key")), wanted, "key").select(
        "host", "path", "blocks", F.concat("key.domain", "key.begin").alias("rule"),
        F.struct(F.length("key.domain") + F.length("key.begin"), F.length("key.domain")).alias("size"),
    )
    best = fitting.groupBy("host", "path").agg(F.max_by(F.struct("rule", "blocks"), "size").alias("best"))
    spoken = hosts.select("host", F.explode(F.array_distinct(F.split("host", r"[.\-]"))).alias("word"))
    bad = _met(spoken, words, "word").select("host").distinct().withColumn("bad", F.lit(True))
    verdicts = seen.join(best, ["host", "path"], "left").join(bad, "host", "left").select(
        "host", "path", F.col("best.rule").alias("rule"),
        F.when(F.coalesce("best.blocks", "bad", F.lit(False)), BLOCK).otherwise(ALLOW).alias("verdict"),
    )
    return urls.join(verdicts, ["host", "path"]).select("page_id", "host", "path", "rule", "verdict")


def _met(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Join by digest, confirmed by the key itself."""
    named = right.withColumnRenamed(key, "_key").withColumn("_digest", F.xxhash64("_key"))
    tagged = left.withColumn("_digest", F.xxhash64(key))
    return tagged.join(named, "_digest").where(F.col(key) == F.col("_key")).drop("_key", "_digest")


def query(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), rule_table(spark), word_table(spark))


def oracle() -> str:
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    words = ", ".join(f"'{w}'" for w in WORDS)
    return rf"""
    WITH rules(h, p, v) AS (VALUES {rules}),
    cut AS (SELECT row_number() OVER () AS r, page_id, coalesce(regexp_extract(url, '(?s)^.*?://(.*)$', 1), '') AS rest FROM pages),
    urls AS (
      SELECT r, page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), '{_UPPER}', '{_LOWER}') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
    best AS (
      SELECT r, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS verdict
      FROM urls JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY r)
    SELECT page_id, host, path, rule, coalesce(verdict,
      CASE WHEN list_has_any(string_split(replace(host, '-', '.'), '.'), [{words}]) THEN '{BLOCK}' ELSE '{ALLOW}' END) AS verdict
    FROM urls LEFT JOIN best USING (r)
    """
