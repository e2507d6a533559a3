"""Numbers written as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkclean.functions.text import strip_ws

# --- fixed values -------------------------------------------------------------
_DIGITS = r"\d(?:_?\d)*"
# A float literal; underscores between digits are allowed, Java suffixes ("12d") are not.
FLOAT_PATTERN = (
    rf"(?i)^[+-]?(?:(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:e[+-]?{_DIGITS})?|inf(?:inity)?|nan)$"
)
# what Unicode calls white space
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
MONEY_PATTERN = r"^\s*[-+]?\$?\s*(\d{1,3}(,\d{3})+|\d+)?(\.\d+)?\s*$"
# --- end of fixed values ---------------------------------------------------------


def to_float(c: Column) -> Column:
    """Float literal -> double, anything else -> NULL. No trimming, no error."""
    return F.when(c.rlike(FLOAT_PATTERN), F.translate(c, "_", "").try_cast("double"))


def is_trimmed_number(t: Column) -> Column:
    """Of a text without white space around it; a blank after a dollar sign is fine."""
    return F.translate(t, "$,", "").rlike(FLOAT_PATTERN.replace("^", r"^\s*").replace("$", r"\s*$"))


def is_numeric_text(c: Column) -> Column:
    return is_trimmed_number(strip_ws(c))


def parse_money(c: Column) -> Column:
    """``"$1,234.50"`` -> 1234.5: dollar signs, commas and white space are ignored."""
    return to_float(F.translate(c, "$," + BLANKS, ""))


def is_money_text(c: Column) -> Column:
    return (strip_ws(c) != "") & c.rlike("(?U)" + MONEY_PATTERN)


def is_cents(x: Column) -> Column:
    return F.abs(x - F.round(x, 2)) < 1e-6


def divide(a: Column, b: Column) -> Column:
    """IEEE division: x/0 is +-Infinity, 0/0 is NaN; Spark alone would raise or give NULL.

    The sign of a zero divisor is read from its text form because 0.0 = -0.0."""
    inf = F.when(a > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    by_zero = (
        F.when((a == 0) | F.isnan(a), F.lit(float("nan")))
        .when(b.cast("string").startswith("-"), -inf)
        .otherwise(inf)
    )
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(b == 0, by_zero).otherwise(
        F.try_divide(a, b)
    )
