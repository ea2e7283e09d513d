"""Time units and number texts that agree with C-style formatting of doubles."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def t_us(ts: Column) -> Column:
    """Event time as microseconds; a timestamp without a zone counts as UTC, whatever the session's zone.

    The type is known when the plan is made, so only one of the branches is left in it.
    """
    since = ts.cast("timestamp_ntz") - F.lit("1970-01-01").cast("timestamp_ntz")
    seconds = since.cast("interval second").cast("decimal(20,6)")
    wall = (seconds * F.lit(1_000_000)).cast("long")
    return F.when(F.typeof(ts) == "timestamp_ntz", wall).otherwise(F.unix_micros(ts.cast("timestamp")))


def whole_div(a: Column, b: Column) -> Column:
    """Floor division of longs; only the exact multiple is divided, so no digit is lost."""
    return ((a - F.pmod(a, b)) / b).cast("long")


def to_micros(seconds: Column) -> Column:
    return F.round(seconds * F.lit(1_000_000.0)).cast("long")


def to_seconds(us: Column) -> Column:
    return us / F.lit(1_000_000.0)


def _scaled_hundredths(part: Column, bits: int) -> Column:
    scaled = (part * F.lit(float(1 << bits))).cast("long") * F.lit(100).cast("long")
    down = F.shiftright(scaled, bits)
    rest = scaled.bitwiseAND(F.lit((1 << bits) - 1))
    half = F.lit(1 << (bits - 1))
    up = (rest > half) | ((rest == half) & (down.bitwiseAND(F.lit(1)) == 1))
    return down + up.cast("long")


def hundredths(x: Column) -> Column:
    """Hundredths of a non-negative double, rounded on its exact binary value, ties to even.

    The fraction is scaled by a power of two that makes it a whole number (below 2^-8 bits are
    lost, but there the result is zero), so the comparison with one half is exact and stays
    inside generated code. Two scales keep the product with 100 within a long.
    """
    whole = F.floor(x)
    part = x - whole
    small = part < F.lit(1 / 16)
    fine = F.when(small, _scaled_hundredths(F.when(small, part), 60))
    return whole.cast("long") * 100 + F.coalesce(fine, _scaled_hundredths(part, 56))


def fixed2(x: Column) -> Column:
    """Text of a non-negative double with two decimals."""
    h = hundredths(x)
    return F.concat(
        F.floor(h / 100).cast("string"), F.lit("."), F.lpad((h % 100).cast("string"), 2, "0")
    )


def shortest(x: Column) -> Column:
    """Shortest decimal text of a double without an exponent, as in '8.0' or '0.0005'."""
    plain = x.cast("string")
    digits = F.regexp_replace(x.cast("decimal(38,18)").cast("string"), r"0+$", "")
    digits = F.when(F.endswith(digits, F.lit(".")), F.concat(digits, F.lit("0"))).otherwise(digits)
    return F.when(F.contains(plain, F.lit("E")), digits).otherwise(plain)
