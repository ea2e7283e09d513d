"""Policy of each label: cascade look-up, per-field defaults, eligibility."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latchflow.functions.labels import label_slug, stripped
from latchflow.schema import COOLDOWN_S, GLOBAL_CONF, HOLD_S
from latchflow.sources.settings import DEFAULT_KEY, FIELDS, Settings


# Forms of a label that are looked up as keys, in order.
PROBES = ("_raw", "_slug", "_dash")


def _fallback_key(slug: Column, offered: tuple[str, ...]) -> Column:
    """Key of the first fallback rule that applies; NULL when the literals are all that is left."""
    key = F.lit(None).cast("string")
    for name in reversed(offered):
        if name in ("bird", "squirrel"):
            key = F.when(F.contains(slug, F.lit(name)), F.lit(name)).otherwise(key)
        else:
            key = F.lit(name)
    return key


def resolve(rows: DataFrame, settings: Settings, label: str = "label") -> DataFrame:
    """Add ``policy_key``, ``matched_rule`` and the policy's own fields (NULL where it has none).

    Rules, first hit wins: the stripped label as it is, its slug, the slug with hyphens, then
    'bird' or 'squirrel' contained in the slug, 'critter' for anything, the default policy, and
    last the literal defaults. Settings keys are compared as written.
    """
    slug = label_slug(F.col(label))
    named = rows.withColumns({"_raw": stripped(F.col(label)), "_slug": slug})
    named = named.withColumns(
        {
            "_dash": F.translate("_slug", "_", "-"),
            "_fall": _fallback_key(F.col("_slug"), settings.fallbacks),
        }
    )
    if settings.literal is not None:
        return _resolve_literal(named, rows.columns, settings)
    return _resolve_joined(named, rows.columns, settings)


def _rule(hits: dict[str, Column]) -> Column:
    fall = F.col("_fall")
    return (
        F.when(hits["_raw"], "raw")
        .when(hits["_slug"], "slug")
        .when(hits["_dash"], "hyphen")
        .when(fall.isin("bird", "squirrel"), F.concat(F.lit("contains_"), fall))
        .when(fall == "critter", "critter")
        .when(fall == DEFAULT_KEY, "default")
        .otherwise("literal")
    )


def _resolve_literal(named: DataFrame, kept: list[str], settings: Settings) -> DataFrame:
    """Few policies: the key by set membership, then one look-up of its fields.

    The look-up is a broadcast join of a handful of rows. It also keeps later filters on the
    fields above this point; otherwise they would repeat the label work for every use.
    """
    names = list(settings.literal)
    hits = {p: F.col(p).isin(*names) if names else F.lit(False) for p in PROBES}
    key = F.coalesce(*(F.when(hits[p], F.col(p)) for p in PROBES), F.col("_fall"))
    chosen = named.select(*kept, key.alias("policy_key"), _rule(hits).alias("matched_rule"))
    return _with_fields_of(chosen, kept, F.broadcast(settings.policies))


def _with_fields_of(chosen: DataFrame, kept: list[str], policies: DataFrame) -> DataFrame:
    fields = policies.select(F.col("key").alias("policy_key"), *FIELDS)
    return chosen.join(fields, "policy_key", "left").select(*kept, "policy_key", "matched_rule", *FIELDS)


def _resolve_joined(named: DataFrame, kept: list[str], settings: Settings) -> DataFrame:
    """Many policies: an equi-join per probe and one for the fields."""
    keys = settings.dimension().select(F.col("key").alias("_key"))
    for probe in PROBES:
        hit = keys.withColumnRenamed("_key", f"_hit{probe}")
        named = named.join(hit, F.col(probe) == F.col(f"_hit{probe}"), "left")
    hits = {probe: F.col(f"_hit{probe}").isNotNull() for probe in PROBES}
    chosen = named.select(
        *kept,
        F.coalesce(*(f"_hit{p}" for p in PROBES), "_fall").alias("policy_key"),
        _rule(hits).alias("matched_rule"),
    )
    return _with_fields_of(chosen, kept, settings.dimension())


def with_fields(rows: DataFrame, conf: float = GLOBAL_CONF) -> DataFrame:
    """Each missing field takes its literal default, never the default policy's value."""
    names = ("open_s", "cooldown_s", "min_conf")
    literals = (HOLD_S, COOLDOWN_S, conf)
    filled = {n: F.coalesce(f, F.lit(v)) for n, f, v in zip(names, FIELDS, literals)}
    return rows.withColumns(filled).drop(*FIELDS)


def with_eligibility(rows: DataFrame, conf: float = GLOBAL_CONF) -> DataFrame:
    """A policy can only raise the bar above the global confidence."""
    above = F.col("conf") >= conf
    eligible = above & (F.col("open_s") > 0) & (F.col("conf") >= F.col("min_conf"))
    return rows.withColumns({"above_global": above, "eligible": eligible})


def with_policy(rows: DataFrame, settings: Settings, conf: float = GLOBAL_CONF) -> DataFrame:
    """Resolved policy, filled fields and eligibility in one step."""
    return with_eligibility(with_fields(resolve(rows, settings), conf), conf)
