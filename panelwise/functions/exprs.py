"""Column expressions with the NULL, cast and rounding rules of the data model.

Everything here is a composition of built-in functions, so it stays inside
whole-stage code generation.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def any_null(*cols) -> Column:
    return reduce(lambda a, b: a | b, [as_col(c).isNull() for c in cols])


def sql_least(*cols) -> Column:
    """LEAST that is NULL when any argument is NULL (Spark's skips NULLs)."""
    cols = [as_col(c) for c in cols]
    return F.when(~any_null(*cols), F.least(*cols))


def sql_greatest(*cols) -> Column:
    """GREATEST that is NULL when any argument is NULL."""
    cols = [as_col(c) for c in cols]
    return F.when(~any_null(*cols), F.greatest(*cols))


def clamp(col, low: float, high: float) -> Column:
    """Keep a value inside [low, high]; NULL stays NULL."""
    col = as_col(col)
    return F.when(col.isNotNull(), F.least(F.greatest(col, F.lit(low)), F.lit(high)))


def ratio(num, den) -> Column:
    """num / den as a double, NULL when the denominator is 0 or NULL."""
    return as_col(num).cast("double") / F.nullif(as_col(den).cast("double"), F.lit(0.0))


def round_half_away(col, digits: int) -> Column:
    """Round to `digits` decimals, halves away from zero, in plain IEEE steps.

    `F.round` on doubles goes through a decimal string; this form gives the
    same bits on any engine that follows IEEE arithmetic.
    """
    col = as_col(col).cast("double")
    scale = float(10**digits)
    return F.signum(col) * F.floor(F.abs(col) * scale + F.lit(0.5)) / F.lit(scale) + F.lit(0.0)


def exact_mean(col, digits: int = 4) -> Column:
    """Mean of a column that holds at most `digits` decimals.

    Summed in whole units of 10^-digits, so the result does not depend on
    the order in which partitions are merged or on retried tasks.
    """
    col = as_col(col)
    scale = float(10**digits)
    units = F.sum(F.rint(col * F.lit(scale)).cast("long")).cast("double")
    return units / F.lit(scale) / F.nullif(F.count(col), F.lit(0))


def schools(keyed: bool = False) -> Column:
    """Number of schools of rows of one year. With a checked key every row is another one."""
    return F.count("school_id") if keyed else F.countDistinct("school_id")


def count_if(cond) -> Column:
    """How many rows satisfy a condition, 0 for none."""
    return F.count(F.when(cond, F.lit(1)))


def pct(part, whole, digits: int) -> Column:
    """100 * part / whole, rounded; NULL when whole is 0."""
    return round_half_away(ratio(as_col(part) * F.lit(100.0), whole), digits)


# --- lenient casts for text sources -------------------------------------


NUMBER = r"(?i)^[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity|nan)$"


def number(col) -> Column:
    """Double or NULL; only decimal notation counts, so `1d` and `2f` are text."""
    text = F.trim(as_col(col).cast("string"))
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def safe_float(col) -> Column:
    """Number or NULL; NaN counts as missing."""
    value = number(col)
    return F.when(~F.isnan(value), value)


def safe_int(col) -> Column:
    """Integer part of a number written in any form, else NULL ('3.7' -> 3)."""
    return safe_float(col).try_cast("int")


def safe_str(col, max_len: int = 255) -> Column:
    """Trimmed text cut to max_len; blank becomes NULL."""
    return F.nullif(F.substring(F.trim(as_col(col).cast("string")), 1, max_len), F.lit(""))


def flag_to_bool(col, yes_value: float = 1.0) -> Column:
    """Survey code: the yes value -> true, any other number -> false, missing -> NULL."""
    return safe_float(col) == F.lit(float(yes_value))


# --- academic-year labels -------------------------------------------------


def start_year(label) -> Column:
    return F.substring_index(as_col(label), "-", 1).cast("int")


def shifted_year(label, ahead, truncate: bool = True) -> Column:
    """Add `ahead` to both halves of a `YYYY-YY` label.

    With `truncate` the second half is cut to two characters, so 100 shows as
    `10`; without it the full number is kept.
    """
    label, ahead = as_col(label), as_col(ahead)
    first = (F.substring_index(label, "-", 1).cast("int") + ahead).cast("string")
    second = (F.substring_index(label, "-", -1).cast("int") + ahead).cast("string")
    padded = F.lpad(second, 2, "0")
    if not truncate:
        padded = F.when(F.length(second) > 2, second).otherwise(padded)
    return F.concat(first, F.lit("-"), padded)


# --- hashes -----------------------------------------------------------------


def hash_number(method: str, *parts) -> Column:
    """Non-negative number from the concatenated parts.

    `crc32` is the default of the request generator; `md5` (first eight hex
    digits) can be reproduced on engines that have no CRC function.
    """
    text = F.concat(*[as_col(p) for p in parts])
    if method == "crc32":
        return F.crc32(text)
    if method == "md5":
        return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")
    raise ValueError(f"unknown hash method {method!r}")
