"""Filter rules, free-text search, value lists and views."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemill.functions.dates import parse_date
from tablemill.functions.infer import violates
from tablemill.functions.order import natural, typed_value
from tablemill.functions.patterns import regex_error
from tablemill.functions.text import col, let, normal, search_key, trimmed

#: Operators by kind. Sizes are for number and date columns only.
TEXT_OPS = ("is", "is_not", "contains", "contains_not", "starts", "ends", "in_list", "regex", "empty", "filled", "invalid", "longer", "shorter")
SIZE_OPS = ("more", "at_least", "less", "at_most", "between")
OPS = TEXT_OPS + SIZE_OPS


@dataclass
class Rule:
    column: str
    op: str
    value: object = None
    upper: object = None
    case: bool = False
    kind: str = "text"
    active: bool = True


@dataclass
class Filter:
    rules: list[Rule] = field(default_factory=list)
    any: bool = False
    inverted: bool = False


def ops_for(kind: str) -> tuple[str, ...]:
    return OPS if kind in ("number", "date") else TEXT_OPS


def _key(c: Column, case: bool) -> Column:
    return normal(c) if case else F.lower(normal(c))


def _bound(value, kind: str) -> Column:
    """A bound as the column's type reads it; a date without time is midnight."""
    if isinstance(value, (int, float)):
        return F.lit(float(value))
    if kind == "number":
        from tablemill.functions.numbers import parse_lenient

        return parse_lenient(F.lit(str(value)))["value"]
    return typed_value(F.lit(str(value)), kind)


def complete(rule: Rule) -> bool:
    """A rule counts if it is active, known, has a column and the values that it needs."""
    if not rule.active or not rule.column or rule.op not in ops_for(rule.kind):
        return False
    if rule.op in ("empty", "filled", "invalid"):
        return True
    if rule.op == "in_list":
        return bool(rule.value)
    if rule.op == "between":
        return rule.value not in (None, "") and rule.upper not in (None, "")
    return rule.value not in (None, "")


def _typed_bound(value, kind: str, dtype: str) -> Column | None:
    """A bound as a literal for a column that Spark has typed itself, read once on the driver; None if it can't be."""
    if isinstance(value, (int, float)):
        return F.lit(float(value))
    one = SparkSession.active().sql("SELECT 1 AS one")
    if kind == "number":
        x = one.select(_bound(value, kind)).first()[0]
        return None if x is None else F.lit(x)
    d = one.select(parse_date(F.lit(str(value)))["date"]).first()[0]
    if d is None:
        return None
    text = f"{d.year:04}-{d.month:02}-{d.day:02} {d.hour:02}:{d.minute:02}:{d.second:02}"
    return F.lit(text).cast("timestamp" if dtype == "date" else dtype)


def _sized(op: str, x: Column, low: Column, high: Column | None) -> Column:
    if op == "between":
        return x.between(F.least(low, high), F.greatest(low, high))
    return {"more": x > low, "at_least": x >= low, "less": x < low, "at_most": x <= low}[op]


def condition(rule: Rule, dtype: str = "string") -> Column:
    """The rule as a boolean that is never null. Empty cells match only empty, or a list with a blank.

    Sizes of columns that aren't text compare as they are, so they reach the scan as pushed filters.
    """
    if rule.op in SIZE_OPS and dtype != "string":
        bounds = [_typed_bound(x, rule.kind, dtype) for x in ((rule.value, rule.upper) if rule.op == "between" else (rule.value,))]
        if any(b is None for b in bounds):
            return F.lit(False)
        own = F.col(f"`{rule.column}`")
        return own.isNotNull() & _sized(rule.op, own, bounds[0], bounds[-1])
    c = F.coalesce(F.col(f"`{rule.column}`").cast("string"), F.lit(""))
    filled = c != ""
    op, value = rule.op, rule.value
    if op == "empty":
        return ~filled
    if op == "filled":
        return filled
    if op == "invalid":
        return filled & violates(c, rule.kind)
    if op == "in_list":
        own = _key(c, rule.case)
        wanted = [str(x) for x in value]
        hit = own.isin(*[_key(F.lit(x), rule.case) for x in wanted if x != ""]) if any(wanted) else F.lit(False)
        return (filled & hit) | (~filled & F.lit("" in wanted))
    if op == "regex":
        return filled & c.rlike(("(?U)" if rule.case else "(?iuU)") + str(value))
    if op in ("longer", "shorter"):
        size = F.length(trimmed(normal(c)))
        return filled & (size > int(value) if op == "longer" else size < int(value))
    if op in SIZE_OPS:
        low, high = _bound(value, rule.kind), _bound(rule.upper, rule.kind) if op == "between" else None
        return F.coalesce(let(typed_value(c, rule.kind), lambda x: _sized(op, x, low, high)), F.lit(False))
    want = _key(F.lit(str(value)), rule.case)
    tests = {
        "is": lambda k: k == want, "is_not": lambda k: k != want, "contains": lambda k: k.contains(want), "contains_not": lambda k: ~k.contains(want),
        "starts": lambda k: k.startswith(want), "ends": lambda k: k.endswith(want),
    }
    return filled & let(_key(c, rule.case), tests[op])


def rule_error(rule: Rule) -> str | None:
    """Why a rule can't be used, if so; such a rule is reported and skipped."""
    if rule.op == "regex" and (e := regex_error(str(rule.value))):
        return f"{rule.column}: {e}"
    if rule.op in ("longer", "shorter") and not re.fullmatch(r"\s*\d+\s*", str(rule.value)):
        return f"{rule.column}: {rule.value!r} is no length"
    return None


def predicate(spec: Filter, types: dict[str, str] | None = None) -> tuple[Column | None, list[str]]:
    """The filter as one boolean (None: everything passes) and the errors of broken rules."""
    types = types or {}
    rules = [r for r in spec.rules if complete(r)]
    errors = [e for r in rules if (e := rule_error(r))]
    good = [condition(r, types.get(r.column, "string")) for r in rules if not rule_error(r)]
    if not good:
        return None, errors
    whole = reduce(or_ if spec.any else and_, good)
    return (~whole if spec.inverted else whole), errors


def apply_filter(df: DataFrame, spec: Filter) -> DataFrame:
    """Rows that pass; without a usable rule all do, inverted or not."""
    p, _ = predicate(spec, dict(df.dtypes))
    return df if p is None else df.filter(p)


def search(df: DataFrame, query: str, columns: list[str] | None = None) -> DataFrame:
    """Rows in which any column contains the query, whatever its case and accents."""
    if not query:
        return df
    want = search_key(F.lit(query))
    return df.filter(reduce(or_, [search_key(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))).contains(want) for c in columns or df.columns]))


def search_hits(df: DataFrame, query: str, columns: list[str] | None = None) -> DataFrame:
    """(column_name, hits): how many rows of each column contain the query."""
    columns, want = columns or df.columns, search_key(F.lit(query))
    hits = df.agg(*[F.count_if(search_key(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))).contains(want)).alias(c) for c in columns])
    return hits.unpivot([], columns, "column_name", "hits")


def value_list(df: DataFrame, column: str, spec: Filter | None = None, limit: int | None = 200) -> DataFrame:
    """(value, n) by falling count, then text; the column's own rules are left out of the filter."""
    if spec is not None:
        df = apply_filter(df, Filter([r for r in spec.rules if r.column != column], spec.any, spec.inverted))
    out = df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("")).alias("value")).agg(F.count("*").alias("n"))
    out = out.orderBy(F.desc("n"), natural("value"), "value")
    return out.limit(limit) if limit else out


def restrict_changed(df: DataFrame, before: str, after: str) -> DataFrame:
    """Rows that a preview changes."""
    return df.filter(~F.col(before).eqNullSafe(F.col(after)))


def view(df: DataFrame, query: str = "", spec: Filter | None = None, order: list[Column] | None = None, duplicates_of: list[str] | None = None) -> DataFrame:
    """Search, filter, duplicates and order, as one plan."""
    out = search(df, query)
    out = apply_filter(out, spec) if spec else out
    if duplicates_of:
        from tablemill.operators.duplicates import duplicate_rows

        out = duplicate_rows(out, duplicates_of)
    return out.orderBy(*order) if order else out


def as_text(c: Column | str) -> Column:
    return F.coalesce(col(c).cast("string"), F.lit(""))
