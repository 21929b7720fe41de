"""Phone numbers: reading with a default country, writing in international or national form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablemill.functions.errors import on_failure
from tablemill.functions.text import col, let, normal, trimmed

MIN_DIGITS, MAX_DIGITS = 8, 15


def parse_phone(c: Column | str, country: int = 46) -> Column:
    """struct(digits, had_code, foreign); digits with the country code, null where no number is read."""
    return let(trimmed(normal(c)), lambda v: _read(v, country))


def _read(v: Column, country: int) -> Column:
    bare = F.regexp_replace(v, r"(?U)[\s()./-]", "")
    plus, zeros = bare.startswith("+"), bare.startswith("00")
    rest = F.when(plus, bare.substr(F.lit(2), F.length(bare))).when(zeros, bare.substr(F.lit(3), F.length(bare))).otherwise(bare)
    digits = F.when(plus | zeros, rest).when(rest.startswith("0"), F.concat(F.lit(str(country)), rest.substr(F.lit(2), F.length(rest))))
    ok = v.rlike(r"(?U)^[0-9\s+()./-]+$") & rest.rlike(r"^\d+$") & F.length(digits).between(MIN_DIGITS, MAX_DIGITS)
    return F.struct(
        F.when(ok, digits).alias("digits"), F.coalesce(ok & (plus | zeros), F.lit(False)).alias("had_code"), F.coalesce(ok & ~digits.startswith(str(country)), F.lit(False)).alias("foreign")
    )


def write_phone(p: Column, form: str = "e164", country: int = 46) -> Column:
    """e164, or national for numbers of the own country."""
    return let(p, lambda x: _written(x, form, country))


def _written(p: Column, form: str, country: int) -> Column:
    world = F.concat(F.lit("+"), p["digits"])
    if form == "e164":
        return world
    own = F.concat(F.lit("0"), p["digits"].substr(F.lit(len(str(country)) + 1), F.length(p["digits"])))
    return F.when(p["foreign"], world).otherwise(own)


def rewrite_phone(c: Column | str, form: str = "e164", country: int = 46, on_error: str = "keep") -> Column:
    c = col(c)
    return F.when(c == "", c).otherwise(F.coalesce(write_phone(parse_phone(c, country), form, country), on_failure(c, on_error)))
