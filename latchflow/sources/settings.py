"""Per-species settings: a JSON object of policies, read strictly through VARIANT."""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from latchflow.schema import COOLDOWN_S, GLOBAL_CONF, HOLD_S

FIELDS = ("open_duration", "cooldown_duration", "confidence_threshold")
DEFAULT_KEY = "_default"
# Keys with a fallback rule of their own, in the order in which they are tried.
FALLBACK_KEYS = ("bird", "squirrel", "critter", DEFAULT_KEY)
LITERAL_KEYS = 64
BROADCAST_ROWS = 100_000


@contextmanager
def _last_key_counts(spark: SparkSession) -> Iterator[None]:
    """Expressions built inside take the last of equal keys; the caller's setting comes back."""
    name = "spark.sql.variant.allowDuplicateKeys"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def _as(value: Column, kind: str) -> Column:
    return F.try_variant_get(value, "$", kind)


def _strict(text: Column) -> Column:
    """The text as a VARIANT, NULL unless it is one JSON value and nothing else.

    The parser stops behind the first value. Standing inside an object in front of a key that the text
    cannot hold, its own digest, a text with anything behind its value breaks the object or hides that key.
    """
    mark = F.sha2(text, 256)
    whole = F.try_parse_json(F.concat(F.lit('{"value":'), text, F.lit(',"'), mark, F.lit('":0}')))
    members = _as(whole, "map<string,variant>")
    return F.when((F.size(members) == 2) & F.map_contains_key(members, mark), F.try_element_at(members, F.lit("value")))


def _kind(value: Column) -> Column:
    """OBJECT, ARRAY, STRING, BOOLEAN, VOID or a numeric type; NULL for no value."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def _truthy(value: Column) -> Column:
    """Whether the value counts as filled: not null, zero, false or empty."""
    kind = _kind(value)
    return (
        F.when(kind == "VOID", F.lit(False))
        .when(kind == "BOOLEAN", _as(value, "boolean"))
        .when(kind == "STRING", _as(value, "string") != "")
        .when(kind == "ARRAY", F.size(_as(value, "array<variant>")) > 0)
        .when(kind == "OBJECT", F.size(_as(value, "map<string,variant>")) > 0)
        .otherwise(_as(value, "double") != 0)
    )


def parse_settings(
    docs: DataFrame,
    text: str = "settings_text",
    hold_s: float = HOLD_S,
    cooldown_s: float = COOLDOWN_S,
    conf: float = GLOBAL_CONF,
) -> DataFrame:
    """One row per policy of each settings text.

    A text that is no JSON object, strictly and as a whole, gives the single fallback policy. Values keep
    their kinds, so ``null`` and ``"null"`` differ. ``is_object`` tells whether
    the value can be a policy at all; ``bad_field`` whether one of its fields is not a number,
    which the loader refuses.
    """
    kept = [c for c in docs.columns if c != text]
    with _last_key_counts(docs.sparkSession):
        parsed = docs.select(*kept, _strict(F.col(text)).alias("_doc")).select(
            *kept, F.when(_kind(F.col("_doc")) == "OBJECT", _as(F.col("_doc"), "map<string,variant>")).alias("_cfg")
        )
    fallback = F.array(
        F.struct(F.lit(DEFAULT_KEY).alias("key"), F.lit(None).cast("variant").alias("value"))
    )
    rows = parsed.select(
        *kept,
        F.col("_cfg").isNull().alias("from_fallback"),
        F.explode(F.coalesce(F.map_entries("_cfg"), fallback)).alias("_entry"),
    ).select(*kept, "from_fallback", F.col("_entry.key").alias("key"), F.col("_entry.value").alias("_value"))
    value = F.col("_value")
    is_object = F.coalesce(_kind(value) == "OBJECT", F.lit(False))
    members = rows.select(
        *kept,
        "from_fallback",
        "key",
        (is_object | F.col("from_fallback")).alias("is_object"),
        F.when(is_object, _as(value, "map<string,variant>")).alias("_members"),
        (~F.col("from_fallback") & ~is_object & F.coalesce(_truthy(value), F.lit(False))).alias("_truthy_scalar"),
    )
    fields = {n: _as(F.try_element_at("_members", F.lit(n)), "double") for n in FIELDS}
    broken = F.lit(False)
    for name, number in fields.items():
        broken = broken | (F.coalesce(F.map_contains_key("_members", name), F.lit(False)) & number.isNull())
    defaults = dict(zip(FIELDS, (hold_s, cooldown_s, conf)))
    return members.select(
        *kept,
        "from_fallback",
        "key",
        "is_object",
        *(F.when(F.col("from_fallback"), F.lit(defaults[n])).otherwise(fields[n]).alias(n) for n in FIELDS),
        F.coalesce(F.size("_members"), F.lit(0)).alias("n_fields"),
        broken.alias("bad_field"),
        # Only an empty default may stand for the literal defaults; other fallbacks are used as they are.
        F.when(F.col("key") == DEFAULT_KEY, F.col("_truthy_scalar"))
        .otherwise(F.col("key").isin(*FALLBACK_KEYS) & ~F.col("is_object"))
        .alias("bad_fallback"),
    )


@dataclass(frozen=True)
class Settings:
    """Policies as a dimension, and which fallback rules they offer.

    A settings file normally names a few species: up to ``LITERAL_KEYS`` policies are also held
    as plain values, whose keys are written into the plan. Above that keys are joined, and
    broadcast only up to ``BROADCAST_ROWS``.
    """

    policies: DataFrame
    fallbacks: tuple[str, ...]
    literal: dict[str, tuple] | None = None
    small: bool = False

    def dimension(self) -> DataFrame:
        return F.broadcast(self.policies) if self.small else self.policies


def _offers_fallback() -> Column:
    usable = (F.col("key") != DEFAULT_KEY) | (F.col("n_fields") > 0) | F.col("from_fallback")
    return F.col("is_object") & F.col("key").isin(*FALLBACK_KEYS) & usable


def checked(rows: DataFrame, literal_keys: int = LITERAL_KEYS) -> Settings:
    """Refuse settings the controller would stop on; look once at size and fallback keys."""
    bad = F.col("bad_field") | F.col("bad_fallback")
    looked = rows.select("key", "is_object", *FIELDS, bad.alias("bad"), _offers_fallback().alias("offers"))
    first = looked.limit(literal_keys + 1).collect()
    policies = rows.where("is_object").select("key", *FIELDS)
    if len(first) <= literal_keys:
        refused = [r["key"] for r in first if r["bad"]]
        offered = {r["key"] for r in first if r["offers"]}
        literal = {r["key"]: tuple(r[f] for f in FIELDS) for r in first if r["is_object"]}
        small = True
    else:
        facts = looked.agg(
            F.count(F.lit(1)).alias("n"),
            F.min(F.when(F.col("bad"), F.col("key"))).alias("bad"),
            F.collect_set(F.when(F.col("offers"), F.col("key"))).alias("offers"),
        ).first()
        refused = [facts["bad"]] if facts["bad"] is not None else []
        offered, literal, small = set(facts["offers"]), None, facts["n"] <= BROADCAST_ROWS
    if refused:
        raise ValueError(f"settings with missing or non-numeric values: {sorted(refused)}")
    fallbacks = tuple(k for k in FALLBACK_KEYS if k in offered)
    return Settings(policies, fallbacks, literal, small)


def settings_from_text(spark: SparkSession, text: str | None, conf: float = GLOBAL_CONF) -> Settings:
    docs = spark.range(1, numPartitions=1).select(F.lit(text).cast("string").alias("settings_text"))
    return checked(parse_settings(docs, conf=conf))


def load_settings(spark: SparkSession, path: str, conf: float = GLOBAL_CONF) -> Settings:
    """Settings of a JSON file; a missing or malformed file warns and gives the fallback policy."""
    try:
        docs = spark.read.text(path, wholetext=True).withColumnRenamed("value", "settings_text")
        rows = parse_settings(docs, conf=conf)
        if rows.isEmpty():
            warnings.warn(f"settings in {path} are empty; using defaults", stacklevel=2)
            return settings_from_text(spark, None, conf)
        if rows.where("from_fallback").limit(1).count():
            warnings.warn(f"settings in {path} are not a JSON object; using defaults", stacklevel=2)
        return checked(rows)
    except AnalysisException as problem:
        if "PATH_NOT_FOUND" not in str(problem):
            raise
        warnings.warn(f"no settings at {path}; using defaults", stacklevel=2)
        return settings_from_text(spark, None, conf)
