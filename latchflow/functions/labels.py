"""Label normalisation: the policy slug and the cooldown key."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space when labels are stripped.
WHITE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def stripped(label: Column) -> Column:
    """NULL-safe strip of all Unicode white space; without a list Spark trims blanks only."""
    return F.btrim(F.coalesce(label, F.lit("")), F.lit(WHITE))


def label_slug(label: Column) -> Column:
    """Key under which a policy is looked up; NULL gives the empty slug."""
    return F.translate(F.lower(stripped(label)), " -", "__")


def cooldown_key(label: Column) -> Column:
    """Key of the per-species cooldown. Only NULL and '' are 'unknown'; blanks strip to ''."""
    return F.when(label.isNull() | (label == ""), F.lit("unknown")).otherwise(label_slug(label))
