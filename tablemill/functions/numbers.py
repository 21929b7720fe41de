"""Numbers in text: the strict grammar of typed columns, the lenient one of the cleaning tool, and writing."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tablemill.functions.text import col, let, normal, trimmed

#: The strict grammar. Fixed values.
GROUPED = r"^[+-]?\d{1,3}(?: \d{3})*(?:,\d+)?$"
PLAIN = r"^[+-]?\d+(?:[.,]\d+)?$"
SCIENTIFIC = r"^[+-]?\d+(?:\.\d+)?[eE][+-]?\d+$"
LONGEST = 15


def _identifier(v: Column) -> Column:
    digits = F.regexp_replace(v, r"\D", "")
    return v.rlike(r"^[+\-()\d ]+$") & v.rlike(r"\d") & ((F.length(digits) > LONGEST) | v.rlike(r"^[+-]?0\d"))


def _numeric(v: Column) -> Column:
    return (v.rlike(GROUPED) | v.rlike(PLAIN) | v.rlike(SCIENTIFIC)) & ~_identifier(v)


def is_identifier(c: Column | str) -> Column:
    """Digits that must not be read as a number: too many of them, or a leading zero before another."""
    return let(trimmed(normal(c)), _identifier)


def looks_numeric(c: Column | str) -> Column:
    return let(trimmed(normal(c)), _numeric)


def parse_strict(c: Column | str) -> Column:
    """Double of a numeric text, else null: what sorting, filtering and aggregates use."""
    value = lambda v: F.replace(F.replace(v, F.lit(" "), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")
    return let(trimmed(normal(c)), lambda v: F.when(_numeric(v), value(v)))


def parse_lenient(c: Column | str, dot_groups: bool = False) -> Column:
    """struct(value, unit, negative_form) of a number with currency, grouping and bookkeeping signs.

    dot_groups: a bare 1.234 is 1234 and a bare 1,234 is 1.234; otherwise the other way round.
    """
    no = lambda x, what: F.replace(x, F.lit(what), F.lit(""))
    dot = lambda x: F.regexp_replace(x, r"^([^,]*),", "$1.")
    tail = lambda x, cut: x.substr(F.lit(2), F.length(x) - cut)

    def without_brackets(v):
        round_ = v.startswith("(") & v.endswith(")") & (F.length(v) > 1)
        return F.struct(F.when(round_, trimmed(tail(v, 2))).otherwise(v).alias("v"), round_.alias("form"))

    def without_trailing(x):
        behind = x["v"].endswith("-") & x["v"].rlike(r"\d")
        v = F.when(behind, trimmed(x["v"].substr(F.lit(1), F.length(x["v"]) - 1))).otherwise(x["v"])
        return F.struct(v.alias("v"), (x["form"] | behind).alias("form"))

    def without_sign(x):
        minus = x["v"].startswith("-")
        v = F.when(minus | x["v"].startswith("+"), trimmed(tail(x["v"], 1))).otherwise(x["v"])
        return F.struct(v.alias("v"), x["form"].alias("form"), (x["form"] != minus).alias("negative"))

    def decided(body):
        return (
            F.when(body.rlike(r"^\d{1,3}(,\d{3})+\.\d+$"), no(body, ","))
            .when(body.rlike(r"^\d{1,3}(\.\d{3})+,\d+$"), dot(no(body, ".")))
            .when(body.rlike(r"^\d{1,3}(,\d{3})+$"), dot(body) if dot_groups else no(body, ","))
            .when(body.rlike(r"^\d{1,3}(\.\d{3})+$"), no(body, ".") if dot_groups else body)
            .otherwise(dot(body))
        )

    def read(x):
        number = let(decided(F.regexp_replace(x["v"], r"[^0-9.,]", "")), lambda n: F.when(n.rlike(r"^(\d+\.?\d*|\.\d+)$"), n.try_cast("double")))
        return F.struct(
            (number * F.when(x["negative"], -1.0).otherwise(1.0)).alias("value"),
            trimmed(F.regexp_replace(x["v"], r"(?U)[0-9.,\s']", "")).alias("unit"),
            x["form"].alias("negative_form"),
        )

    return let(let(let(let(trimmed(normal(c)), without_brackets), without_trailing), without_sign), read)


def shortest(c: Column | str) -> Column:
    """The shortest text of a double, without exponent from 1e-6 up to 1e21."""
    x = col(c).cast("double")

    def parts(text):
        return F.struct(
            text.alias("text"),
            F.rtrim(F.replace(F.split(text, "E")[0], F.lit("."), F.lit("")), F.lit("0")).alias("digits"),
            F.try_element_at(F.split(text, "E"), F.lit(2)).try_cast("int").alias("power"),
        )

    def plain(p):
        digits, power, size = p["digits"], p["power"], F.length(p["digits"])
        large = F.when(size <= power + 1, F.rpad(digits, power + 1, F.lit("0"))).otherwise(
            F.concat(digits.substr(F.lit(1), power + 1), F.lit("."), digits.substr(power + 2, size))
        )
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
        mantissa = F.when(size > 1, F.concat(F.substring(digits, 1, 1), F.lit("."), digits.substr(F.lit(2), size))).otherwise(digits)
        far = F.concat(mantissa, F.lit("e"), F.when(power > 0, F.lit("+")).otherwise(F.lit("")), power.cast("string"))
        return (
            F.when(power.isNull(), F.regexp_replace(p["text"], r"\.0$", ""))
            .when((power >= 0) & (power < 21), large)
            .when((power < 0) & (power >= -6), small)
            .otherwise(far)
        )

    return F.concat(F.when(x < 0, F.lit("-")).otherwise(F.lit("")), let(let(F.abs(x).cast("string"), parts), plain))


def to_fixed(x: float, decimals: int) -> str:
    """Decimals of the exact binary value, halves away from zero."""
    text = str(abs(Decimal(x)).quantize(Decimal(1).scaleb(-decimals), ROUND_HALF_UP))
    return ("-" if x < 0 else "") + text


def write_number(c: Column | str, comma: bool = True, decimals: int | None = None) -> Column:
    """A number without grouping; decimals None: as many as it has."""
    if decimals is None:
        text = shortest(c)
    else:

        @F.pandas_udf("string")
        def fixed(s: pd.Series) -> pd.Series:
            return s.map(lambda x: None if pd.isna(x) else to_fixed(x, decimals))

        text = fixed(col(c).cast("double"))
    return F.replace(text, F.lit("."), F.lit(",")) if comma else text


def rewrite_number(c: Column | str, comma: bool = True, decimals: int | None = None, dot_groups: bool = False, on_error: str = "keep") -> Column:
    """The number tool: each cell written anew; empty cells stay, what can't be read is kept, emptied or marked."""
    from tablemill.functions.errors import on_failure

    c = col(c)
    return F.when(c == "", c).otherwise(F.coalesce(write_number(parse_lenient(c, dot_groups)["value"], comma, decimals), on_failure(c, on_error)))
