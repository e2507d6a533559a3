"""Lenient dates: many spellings of one day, month first when the order is unclear."""

from __future__ import annotations

import datetime as dt

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DateType

from sparkclean.functions.text import strip_ws

# --- fixed values -------------------------------------------------------------
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
MONTH_WORD = (
    "(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|"
    "sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
)
WEEKDAY = "(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\\.?,? +)?"
CLOCK = (
    "(?:(?:[t ]|, ?| at ) *\\d{1,2}:\\d{2}(?::\\d{2}(?:[.,]\\d+)?)?(?: ?[ap]\\.?m\\.?)?"
    " ?(?:z|utc|gmt|[+-]\\d{2}:?\\d{2})?)?"
)
# Two-digit years up to the pivot belong to this century.
PIVOT = 75
# --- end of fixed values ---------------------------------------------------------

# All families in one pattern, so that a cell is matched once. Groups: year-month-day 1-4,
# numbers with the year last 5-8, day month-name year 9-11, month-name day year 12-14,
# year month-name day 15-17, eight digits 18-20.
_ANY = (
    f"(?i)^(?:{WEEKDAY}(?:(\\d{{4}})([-/.])(\\d{{1,2}})\\2(\\d{{1,2}})"
    f"|(\\d{{1,2}})([-/.])(\\d{{1,2}})\\6(\\d{{4}}|\\d{{2}})"
    f"|(\\d{{1,2}})(?:st|nd|rd|th)?(?: of)?[- /.,]*{MONTH_WORD}[- /.,]+(\\d{{4}}|\\d{{2}})"
    f"|{MONTH_WORD}[- /.]*(\\d{{1,2}})(?:st|nd|rd|th)?[- /.,]+(\\d{{4}}|\\d{{2}})"
    f"|(\\d{{4}})[- /.]{MONTH_WORD}[- /.](\\d{{1,2}})){CLOCK}"
    f"|(\\d{{4}})(\\d{{2}})(\\d{{2}})(?:t?\\d{{4}}(?:\\d{{2}})?)?)$"
)
# separator of the ambiguous family | year | month | day
_MARK = "\x01"
_PARTS = _MARK + "$6|$1$8$11$14$15$18|$3$5$10$12$16$19|$4$7$9$13$17$20"
_MONTH_AT = "  " + "".join(MONTHS)
MIN_CHARS = 6


def _assemble(parts: Column) -> Column:
    unsure, y, m, d = (parts[i] for i in range(4))
    year = F.when(F.length(y) == 4, y).when(y <= str(PIVOT), F.concat(F.lit("20"), y)).otherwise(F.concat(F.lit("19"), y))
    named = F.instr(F.lit(_MONTH_AT), F.lower(F.substring(m, 1, 3)))
    month = F.when(named > 0, (named / 3).cast("int").cast("string")).otherwise(m)
    month_first = F.concat_ws("-", year, month, d).try_cast("date")
    return F.when(
        month_first.isNull() & (unsure != _MARK), F.concat_ws("-", year, d, month).try_cast("date")
    ).otherwise(month_first)


# The two spellings most files use; both stay in generated code.
_PLAIN_ISO = r"^\d{4}-\d{1,2}-\d{1,2}$"
_PLAIN_SLASH = r"^(\d{1,2})([-/.])(\d{1,2})\2(\d{4})$"
_FIRST_CHARS = sorted("0123456789" + "".join({w[0] for w in MONTHS} | set("mtwfs")) + "".join({w[0] for w in MONTHS} | set("mtwfs")).upper())


def trimmed_date(t: Column) -> Column:
    """:func:`lenient_date` of a text that has no white space around it."""
    found = F.regexp_replace(t, _ANY, _PARTS)
    # the one-element list binds the parts, so the pattern runs once per cell
    bound = F.transform(F.array(found), lambda f: F.when(f.startswith(_MARK), _assemble(F.split(f, "\\|"))))
    return (
        F.when(
            (F.length(t) < MIN_CHARS) | ~F.substring(t, 1, 1).isin(_FIRST_CHARS),
            F.lit(None).cast("date"),
        )
        .when(t.rlike(_PLAIN_ISO), t.try_cast("date"))
        .when(
            t.rlike(_PLAIN_SLASH),
            F.coalesce(
                F.regexp_replace(t, _PLAIN_SLASH, "$4-$1-$3").try_cast("date"),
                F.regexp_replace(t, _PLAIN_SLASH, "$4-$3-$1").try_cast("date"),
            ),
        )
        .when(t.rlike(_ANY), F.get(bound, F.lit(0)))
    )


def lenient_date(c: Column) -> Column:
    """Text -> date, NULL when the text does not name a full calendar day."""
    return trimmed_date(strip_ws(c))


@F.pandas_udf(DateType())
def _dateutil_date(texts: pd.Series) -> pd.Series:
    from dateutil import parser

    # A text that names the whole day parses the same whatever fills the gaps.
    fill_a, fill_b = dt.datetime(2001, 2, 3), dt.datetime(2004, 7, 19)

    def one(t):
        if t is None:
            return None
        try:
            a, b = parser.parse(t, default=fill_a).date(), parser.parse(t, default=fill_b).date()
        except (ValueError, TypeError, OverflowError):
            return None
        return a if a == b else None

    return texts.map(one)


def lenient_date_full(c: Column) -> Column:
    """:func:`lenient_date`, then a free-form parse of what it left over (opt-in: the
    left-over rows pass through Python)."""
    native = lenient_date(c)
    rest = F.when(native.isNull() & strip_ws(c).rlike("\\d"), strip_ws(c))
    return F.coalesce(native, _dateutil_date(rest))


def is_trimmed_date(t: Column) -> Column:
    return trimmed_date(t).isNotNull()


def iso_date(c: Column) -> Column:
    return F.date_format(lenient_date(c), "yyyy-MM-dd")
