"""Order keys: natural Swedish text order, and the order of typed columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablemill.functions.dates import date_key
from tablemill.functions.numbers import parse_strict
from tablemill.functions.text import col, let, normal, trimmed

TRUE_WORDS = ("ja", "sant", "true", "yes", "y", "x", "1")
FALSE_WORDS = ("nej", "falskt", "false", "no", "n", "0")


def natural(c: Column | str) -> Column:
    """Text order with digit runs as numbers and the alphabet's own letters last (å, ä, ö)."""
    c = col(c)
    parts = F.regexp_extract_all(c, F.lit("[0-9]+|[^0-9]+"), F.lit(0))
    # A number is led by its count of digits, so numbers of any length compare by value.
    number = lambda p: let(F.regexp_replace(p, "^0+(?=[0-9])", ""), lambda d: F.concat(F.lpad(F.length(d).cast("string"), 10, "0"), d))
    led = F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), number(p)).otherwise(p)), "")
    return F.collate(F.when(c.rlike("[0-9]"), led).otherwise(c), "sv")


def typed_value(c: Column | str, kind: str) -> Column:
    """A double that orders a column of this type; null for what can't be read."""
    c = col(c)
    if kind == "number":
        return parse_strict(c)
    if kind == "date":
        return date_key(c).cast("double")
    if kind == "bool":
        return let(F.lower(trimmed(normal(c))), lambda w: F.when(w.isin(*FALSE_WORDS), 0.0).when(w.isin(*TRUE_WORDS), 1.0))
    return F.lit(None).cast("double")


def rank_struct(c: Column | str, kind: str = "text", custom: list[str] | None = None) -> Column:
    """A comparable struct: listed values first, then readable ones by value, then the rest as text."""
    c = col(c)
    if custom:
        value = F.nullif(F.array_position(F.array(*map(F.lit, custom)), c).cast("double"), F.lit(0.0))
    else:
        value = typed_value(c, kind)
    return let(value, lambda v: F.struct(v.isNull().cast("int").alias("bad"), F.coalesce(v, F.lit(0.0)).alias("value"), natural(c).alias("text"), c.alias("raw")))


def sort_keys(c: Column | str, kind: str = "text", ascending: bool = True, custom: list[str] | None = None) -> list[tuple[Column, str]]:
    """Keys to sort by, each with its way: empties last both ways; descending turns the ranks, so unreadable values lead."""
    return [(F.when(col(c) == "", 1).otherwise(0), "asc"), (rank_struct(c, kind, custom), "asc" if ascending else "desc")]


def sort_columns(c: Column | str, kind: str = "text", ascending: bool = True, custom: list[str] | None = None) -> list[Column]:
    """sort_keys() as columns to sort by; for many rows make the keys columns first, see operators.sorting."""
    return [getattr(key, way)() for key, way in sort_keys(c, kind, ascending, custom)]
