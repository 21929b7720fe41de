"""Dates in text: a full parser to parts, keys for comparison, writing, and day numbers."""

from __future__ import annotations

from functools import reduce
from operator import add, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablemill.functions.errors import on_failure
from tablemill.functions.text import col, constant_map, let, normal, trimmed

#: Month names in Swedish and English with their abbreviations. Fixed values.
MONTHS = {
    "januari": 1, "jan": 1, "februari": 2, "feb": 2, "febr": 2, "mars": 3, "mar": 3, "april": 4, "apr": 4, "maj": 5,
    "juni": 6, "jun": 6, "juli": 7, "jul": 7, "augusti": 8, "aug": 8, "september": 9, "sep": 9, "sept": 9,
    "oktober": 10, "okt": 10, "november": 11, "nov": 11, "december": 12, "dec": 12,
    "january": 1, "february": 2, "march": 3, "may": 5, "june": 6, "july": 7, "august": 8, "october": 10,
}
#: The grammars. Fixed values.
ISO = r"^(\d{4})-(\d{1,2})-(\d{1,2})$"
ISO_TIME = r"(?U)^([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})[T ]([0-9]{1,2}):([0-9]{2})(?::([0-9]{2}))?(?:[.,][0-9]+)?\s*(Z|[+-][0-9]{2}:?[0-9]{2})?$"
COMPACT = r"^((?:19|20)\d{2})(\d{2})(\d{2})$"
NUMERIC = r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{2,4})(?:[T ](\d{1,2}):(\d{2})(?::(\d{2}))?)?$"
DAY_MONTH = r"(?iuU)^(?:den\s+)?([0-9]{1,2})[.\s]+([a-zåäö]+)\.?[\s,]+([0-9]{4})$"
MONTH_DAY = r"(?iuU)^([a-zåäö]+)\.?\s+([0-9]{1,2})(?:st|nd|rd|th)?,?\s+([0-9]{4})$"
DIGITS = r"^\d+(?:[.,]\d+)?$"
#: Spreadsheet day numbers that count as dates, from 1954 to 2119.
SERIAL_MIN, SERIAL_MAX = 20_000, 80_000
#: The coarse grammar that only names a column's type.
COARSE = (
    r"(?U)^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}(?:[T ][0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?(?:[.,][0-9]+)?(?:Z|[+-][0-9]{2}:?[0-9]{2})?)?$",
    r"^\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4}(?:[T ]\d{1,2}:\d{2}(?::\d{2})?)?$",
    r"^(19|20)\d{6}$",
    r"(?iuU)^(?:den\s+)?([0-9]{1,2})[.\s]+([a-zåäö]+)\.?[\s]+([0-9]{4})$",
    r"(?iuU)^([a-zåäö]+)\.?\s+([0-9]{1,2}),?\s+([0-9]{4})$",
)
FORMATS = ("iso_time", "iso", "compact", "numeric", "day_month", "month_day", "serial", "unknown")
PARTS = "struct<year:int,month:int,day:int,hour:int,minute:int,second:int,has_time:boolean>"


def looks_like_date(c: Column | str) -> Column:
    return let(trimmed(normal(c)), lambda v: reduce(or_, [v.rlike(p) for p in COARSE]))


def valid_date(y: Column, m: Column, d: Column) -> Column:
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    days = F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)
    return m.between(1, 12) & (d >= 1) & (d <= days)


def _parts(y, m, d, h=None, mi=None, s=None, timed=None) -> Column:
    zero = F.lit(0)
    return F.struct(
        y.alias("year"), m.alias("month"), d.alias("day"), (zero if h is None else h).alias("hour"), (zero if mi is None else mi).alias("minute"),
        (zero if s is None else s).alias("second"), (F.lit(False) if timed is None else timed).alias("has_time"),
    )


def parse_date(c: Column | str, day_first: bool = True, serial: bool = False) -> Column:
    """struct(format, date, ambiguous); date is null where no calendar date is read.

    Zone suffixes are ignored: the date is the one that is written. Where both numbers of a numeric
    date can be a month, day_first decides, and the value counts as ambiguous.
    """
    return let(trimmed(normal(c)), lambda v: _read(v, day_first, serial))


def _read(v: Column, day_first: bool, serial: bool) -> Column:
    n = lambda p, k: F.regexp_extract(v, p, k).try_cast("int")
    z = lambda p, k: F.coalesce(n(p, k), F.lit(0))
    month = lambda p, k: F.try_element_at(constant_map(MONTHS), F.lower(F.regexp_extract(v, p, k))).cast("int")
    out = lambda name, date, doubt=None: F.struct(F.lit(name).alias("format"), date.alias("date"), (F.lit(False) if doubt is None else doubt).alias("ambiguous"))
    first, second = n(NUMERIC, 1), n(NUMERIC, 2)
    long_year = F.length(F.regexp_extract(v, NUMERIC, 3)) > 2
    year = n(NUMERIC, 3) + F.when(long_year, 0).when(n(NUMERIC, 3) <= 69, 2000).otherwise(1900)
    lead = F.when(first > 12, True).when(second > 12, False).otherwise(day_first)
    day, mon = F.when(lead, first).otherwise(second), F.when(lead, second).otherwise(first)
    ok = lambda p, a, b, d: v.rlike(p) & valid_date(a, b, d)
    none = out("unknown", F.lit(None).cast(PARTS))
    found = (
        F.when(v.rlike(ISO_TIME) & ~valid_date(n(ISO_TIME, 1), n(ISO_TIME, 2), n(ISO_TIME, 3)), none)
        .when(v.rlike(ISO) & ~valid_date(n(ISO, 1), n(ISO, 2), n(ISO, 3)), none)
        .when(v.rlike(ISO_TIME), out("iso_time", _parts(n(ISO_TIME, 1), n(ISO_TIME, 2), n(ISO_TIME, 3), n(ISO_TIME, 4), n(ISO_TIME, 5), z(ISO_TIME, 6), F.lit(True))))
        .when(v.rlike(ISO), out("iso", _parts(n(ISO, 1), n(ISO, 2), n(ISO, 3))))
        .when(ok(COMPACT, n(COMPACT, 1), n(COMPACT, 2), n(COMPACT, 3)), out("compact", _parts(n(COMPACT, 1), n(COMPACT, 2), n(COMPACT, 3))))
        .when(
            ok(NUMERIC, year, mon, day),
            out("numeric", _parts(year, mon, day, z(NUMERIC, 4), z(NUMERIC, 5), z(NUMERIC, 6), F.regexp_extract(v, NUMERIC, 4) != ""), (first <= 12) & (second <= 12)),
        )
        .when(ok(DAY_MONTH, n(DAY_MONTH, 3), month(DAY_MONTH, 2), n(DAY_MONTH, 1)), out("day_month", _parts(n(DAY_MONTH, 3), month(DAY_MONTH, 2), n(DAY_MONTH, 1))))
        .when(ok(MONTH_DAY, n(MONTH_DAY, 3), month(MONTH_DAY, 1), n(MONTH_DAY, 2)), out("month_day", _parts(n(MONTH_DAY, 3), month(MONTH_DAY, 1), n(MONTH_DAY, 2))))
    )
    if serial:
        number = F.replace(v, F.lit(","), F.lit(".")).try_cast("double")
        date = F.date_add(F.lit("1899-12-30").cast("date"), F.floor(number).cast("int"))
        rest = number - F.floor(number)
        seconds = F.floor(rest * 86400 + 0.5).cast("int")
        parts = _parts(F.year(date), F.month(date), F.day(date), F.floor(seconds / 3600).cast("int"), F.floor(seconds % 3600 / 60).cast("int"), seconds % 60, rest > 0)
        found = found.when(v.rlike(DIGITS) & number.between(SERIAL_MIN, SERIAL_MAX), out("serial", parts))
    return found.otherwise(none)


def date_key(c: Column | str, day_first: bool = True) -> Column:
    """YYYYMMDDhhmmss as a long, null where no date is read: for sorting and filtering."""
    by = {"year": 10**10, "month": 10**8, "day": 10**6, "hour": 10**4, "minute": 100, "second": 1}
    total = lambda d: reduce(add, [d[k].cast("long") * F.lit(n).cast("long") for k, n in by.items()])
    return let(parse_date(c, day_first)["date"], total)


def write_date(d: Column, form: str = "date") -> Column:
    """Parts as date, datetime, month or year text."""
    return let(d, lambda x: _written(x, form))


def _written(d: Column, form: str) -> Column:
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    year = F.lpad(d["year"].cast("string"), 4, "0")
    month = F.concat_ws("-", year, two(d["month"]))
    day = F.concat_ws("-", month, two(d["day"]))
    forms = {"year": year, "month": month, "date": day, "datetime": F.concat(day, F.lit(" "), two(d["hour"]), F.lit(":"), two(d["minute"]))}
    return F.when(d.isNotNull(), forms[form])


def rewrite_date(c: Column | str, form: str = "date", day_first: bool = True, serial: bool = False, on_error: str = "keep") -> Column:
    """The date tool: empty cells stay, what can't be read is kept, emptied or marked."""
    c = col(c)
    return F.when(c == "", c).otherwise(F.coalesce(write_date(parse_date(c, day_first, serial)["date"], form), on_failure(c, on_error)))


def day_number(d: Column) -> Column:
    """Days since 1970-01-01 of parts, by the civil calendar."""
    return let(d, _civil)


def _civil(d: Column) -> Column:
    y = d["year"] - F.when(d["month"] <= 2, 1).otherwise(0)
    era = F.floor(y / 400)
    of_era = y - era * 400
    of_year = F.floor((153 * (d["month"] + F.when(d["month"] > 2, -3).otherwise(9)) + 2) / 5) + d["day"] - 1
    return (era * 146097 + of_era * 365 + F.floor(of_era / 4) - F.floor(of_era / 100) + of_year - 719468).cast("long")
