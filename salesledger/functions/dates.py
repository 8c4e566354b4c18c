"""Date parsing and formatting expressions.

A date text is a date part and, maybe, a time part; each has its own few
layouts, and any date layout goes with any time layout. A time part is
checked and cut off, the text's own clock counts, and what is left must be a
date as a whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from salesledger.functions._col import as_col
from salesledger.functions.text import strip_ws

# What may follow a date: a clock of 24 hours, a clock of 12 hours
# with AM or PM, or (after T) six digits; then a zone or offset.
_CLOCK_24 = r"(?:[01]?[0-9]|2[0-3])(?::[0-5]?[0-9]){1,2}(?:\.[0-9]{1,9})?"
_CLOCK_12 = r"(?:0?[1-9]|1[0-2])(?::[0-5]?[0-9]){1,2}(?:\.[0-9]{1,9})? ?[AP]M"
_DIGITS = r"(?:[01][0-9]|2[0-3])[0-5][0-9][0-5][0-9]"
TIME_PART = rf"(?i)(?<=[0-9])(?:(?:T|,? +)(?:{_CLOCK_24}|{_CLOCK_12})|T{_DIGITS})(?: ?(?:Z|UTC|GMT|[+-][0-9]{{2}}:?[0-9]{{2}}))?$"
# Shapes of date parts; '/' and '.' are taken for '-'.
_PLAIN = r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"
_YEAR_FIRST = r"^[0-9]{4}-[0-9]{1,2}(-[0-9]{1,2})?$"
_YEAR_LAST = r"^[0-9]{1,2}-[0-9]{1,2}-([0-9]{4}|[0-9]{2})$"
_EIGHT_DIGITS = r"^[0-9]{8}$"
# Names of months, and of weekdays that may come first.
_MONTHS = "january february march april may june july august september october november december".split()
MONTH_NUMBERS = {name: str(k) for k, month in enumerate(_MONTHS, 1) for name in (month, month[:3])} | {"sept": "9"}
_WEEKDAY = r"^(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*[, ]+"
# Fixed value: two-digit years from here on are of the last century.
CENTURY = "69"

DateFormat = str | tuple[str, str]


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def coerce_timestamp(c: Column | str, formats: Sequence[DateFormat]) -> Column:
    """Parse text with the first of several layouts that fits; null when none does.

    A layout is a datetime pattern, or ``(pattern, shape_regex)`` to skip
    the parser on text that cannot match.
    """
    s = strip_ws(as_col(c).cast("string"))
    attempts = []
    for f in formats:
        pattern, shape = (f, None) if isinstance(f, str) else f
        parsed = F.try_to_timestamp(s, F.lit(pattern))
        attempts.append(F.when(s.rlike(shape), parsed) if shape else parsed)
    return F.coalesce(*attempts)


def date_part(c: Column | str) -> Column:
    """The text without a valid time part, '/' and '.' between digits as '-'."""
    s = strip_ws(as_col(c).cast("string"))
    return F.when(F.length(s) > 10, F.regexp_replace(s, TIME_PART, "")).otherwise(s)


def year_last_parts(part: Column) -> Column:
    """[first, second, year] of a date part that ends with its year, else null."""
    dashed = F.translate(part, "/.", "--")
    return F.when(dashed.rlike(_YEAR_LAST), F.split(dashed, "-"))


def _full_year(year: Column) -> Column:
    return F.when(F.length(year) == 2, F.concat(F.when(year >= CENTURY, F.lit("19")).otherwise(F.lit("20")), year)).otherwise(year)


def _date(year: Column, month: Column, day: Column) -> Column:
    return F.concat(_full_year(year), F.lit("-"), month, F.lit("-"), day).try_cast("date")


def _year_last(parts: Column, day_first: Column) -> Column:
    a, b, year = (F.element_at(parts, k) for k in (1, 2, 3))
    is_day = F.when(a.cast("int") > 12, True).when(b.cast("int") > 12, False).otherwise(day_first)
    return F.when(is_day, _date(year, b, a)).otherwise(_date(year, a, b))


def _named(part: Column) -> Column:
    """``5 January, 2026``, ``Jan 5 2026``, ``2026-Jan-5`` and the like."""
    months = F.create_map(*[F.lit(x) for pair in MONTH_NUMBERS.items() for x in pair])

    def parse(words: Column) -> Column:
        first, second, third = (F.element_at(words, k) for k in (1, 2, 3))
        in_front, between = F.try_element_at(months, first), F.try_element_at(months, second)
        turned = F.length(first) == 4
        day = F.when(in_front.isNotNull(), second).when(turned, third).otherwise(first)
        year = F.when(turned & in_front.isNull(), first).otherwise(third)
        return F.when(year.rlike(r"^([0-9]{4}|[0-9]{2})$"), _date(year, F.coalesce(in_front, between), F.regexp_replace(day, "(?<=[0-9])(st|nd|rd|th)$", "")))

    plain = F.regexp_replace(F.regexp_replace(F.lower(part), _WEEKDAY, ""), "[-, ]+", " ")
    return _let(F.split(plain, " "), lambda words: F.when(F.size(words) == 3, parse(words)))


def _any_layout(s: Column, day_first: Column) -> Column:
    def parse(part: Column) -> Column:
        dashed = F.translate(part, "/.", "--")
        digits = F.concat_ws("-", F.substring(part, 1, 4), F.substring(part, 5, 2), F.substring(part, 7, 2))
        return (
            F.when(dashed.rlike(_YEAR_FIRST), dashed.try_cast("date"))
            .when(dashed.rlike(_YEAR_LAST), _year_last(F.split(dashed, "-"), day_first))
            .when(part.rlike(_EIGHT_DIGITS), digits.try_cast("date"))
            .when(part.rlike("[A-Za-z]"), _named(part))
        )

    return F.when(s.rlike(_PLAIN), s.try_cast("date")).otherwise(_let(date_part(s), parse))


def coerce_date(
    c: Column | str, formats: Sequence[DateFormat] | None = None, typed_input: bool = False, day_first: Column | bool = False
) -> Column:
    """Text as a calendar date; null when it is none. Typed (date/timestamp) input
    is cast directly.

    Without ``formats`` any layout counts: the year first (``2026-1-5``,
    ``2026/01/05``, ``20260105``, ``2026-01``), the year last (``1/5/2026``, ``05.01.26``) or
    the month by name, in any order; then a time of day. Where a text with the year
    last could be read both ways, the month comes first, or the day with
    ``day_first`` (see ``operators.date_order``). With ``formats`` only those
    layouts count, the first that fits."""
    if typed_input:
        return as_col(c).cast("date")
    if formats is not None:
        return coerce_timestamp(c, formats).cast("date")
    return _any_layout(strip_ws(as_col(c).cast("string")), day_first if isinstance(day_first, Column) else F.lit(day_first))


def month_key(c: Column | str) -> Column:
    """Monthly period label ``yyyy-MM``."""
    return F.date_format(as_col(c), "yyyy-MM")


def day_str(c: Column | str) -> Column:
    """``yyyy-MM-dd`` text."""
    return F.date_format(as_col(c), "yyyy-MM-dd")
