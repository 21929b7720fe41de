"""New columns from old ones: splitting, patterns, templates, formulas, find and replace."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemill.functions.dates import day_number, parse_date
from tablemill.functions.numbers import parse_strict
from tablemill.functions.patterns import regex_error
from tablemill.functions.text import col, normaliser, trimmed


def text(c: str) -> Column:
    return F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))


# Splitting


def split_each(c: Column | str, delimiter: str, parts: int, trim: bool = True) -> list[Column]:
    """`parts` columns; what is left over stays joined in the last; a blank value gives empty parts."""
    c = col(c)
    all_ = F.split(c, re.escape(delimiter), -1)
    get = lambda k: F.coalesce(F.get(all_, F.lit(k)), F.lit(""))
    last = F.when(F.size(all_) > parts, F.array_join(F.slice(all_, parts, F.greatest(F.size(all_) - parts + 1, F.lit(0))), delimiter)).otherwise(get(parts - 1))
    out = [*(get(k) for k in range(parts - 1)), last]
    blank = trimmed(c) == ""
    return [F.when(blank, "").otherwise(trimmed(x) if trim else x) for x in out]


def split_first(c: Column | str, delimiter: str, trim: bool = True) -> list[Column]:
    """Before and behind the first delimiter."""
    return split_each(c, delimiter, 2, trim)


def split_last(c: Column | str, delimiter: str, trim: bool = True) -> list[Column]:
    """Before and behind the last delimiter; without one everything is the first part."""
    c = col(c)
    tail = F.substring_index(c, delimiter, -1)
    has = c.contains(delimiter)
    head = F.when(has, c.substr(F.lit(1), F.length(c) - F.length(tail) - len(delimiter))).otherwise(c)
    out = [head, F.when(has, tail).otherwise("")]
    return [F.when(trimmed(c) == "", "").otherwise(trimmed(x) if trim else x) for x in out]


def split_positions(c: Column | str, positions: list[int], trim: bool = True) -> list[Column]:
    """Cuts after the given numbers of characters."""
    c = col(c)
    cuts = [0, *positions]
    out = [c.substr(F.lit(a + 1), F.lit(b - a)) for a, b in zip(cuts, positions, strict=False)] + [c.substr(F.lit(cuts[-1] + 1), F.length(c))]
    return [F.when(trimmed(c) == "", "").otherwise(trimmed(x) if trim else x) for x in out]


def pattern_error(pattern: str) -> str | None:
    """Why a pattern of {names} and literals can't be used, if so."""
    names = re.findall(r"\{([^{}]*)\}", pattern)
    if not names:
        return "no braces"
    if any(not x.strip() for x in names):
        return "unnamed part"
    return "adjacent braces" if re.search(r"\}\{", pattern) else None


def pattern_regex(pattern: str) -> tuple[str, list[str]]:
    """An anchored regex with lazy groups: literals delimit, the first must start and the last must end the value."""
    if e := pattern_error(pattern):
        raise ValueError(e)
    pieces = re.split(r"\{([^{}]*)\}", pattern)
    out = "(?s)^"
    for k, x in enumerate(pieces):
        out += ("(.*?)" if k < len(pieces) - 2 or pieces[-1] else "(.*)") if k % 2 else (r"\Q" + x.replace(r"\E", r"\E\\E\Q") + r"\E" if x else "")
    return out + "$", [x.strip() for x in pieces[1::2]]


def extract_pattern(c: Column | str, pattern: str, trim: bool = True) -> dict[str, Column]:
    """A column for each name; null throughout if the value doesn't have the form."""
    regex, names = pattern_regex(pattern)
    c = col(c)
    part = lambda k: F.regexp_extract(c, regex, k)
    return {n: F.when(c.rlike(regex), trimmed(part(k)) if trim else part(k)) for k, n in enumerate(names, 1)}


def split_inventory(df: DataFrame, column: str, delimiter: str) -> DataFrame:
    """(max_parts, undelimited, example) over the filled cells."""
    c = text(column)
    n = F.size(F.split(c, re.escape(delimiter), -1))
    return df.filter(c != "").agg(F.max(n).alias("max_parts"), F.count_if(n == 1).alias("undelimited"), F.max_by(c, F.struct(n, c)).alias("example"))


def split_to_rows(df: DataFrame, column: str, delimiter: str, order: str, trim: bool = True, skip_empty: bool = True) -> DataFrame:
    """A row for each part, never none for a row; `part` numbers them from 0 inside `order`."""
    parts = F.split(text(column), re.escape(delimiter), -1)
    parts = F.transform(parts, trimmed) if trim else parts
    parts = F.filter(parts, lambda p: p != "") if skip_empty else parts
    safe = F.when(F.size(parts) == 0, F.array(F.lit(""))).otherwise(parts)
    rest = [c for c in df.columns if c != column]
    out = df.select(*rest, F.posexplode(safe).alias("part", "_value"))
    return out.select(*[F.col("_value").alias(column) if c == column else F.col(f"`{c}`") for c in df.columns], "part")


# Templates


def template_names(template: str) -> list[str]:
    return [x.strip() for x in re.findall(r"\{([^{}]*)\}", template)]


def template(df: DataFrame, pattern: str, clean: bool = True) -> Column:
    """{Column} replaced by the row's text; unknown names are an error; gaps of empty cells close."""
    names = {c.lower(): c for c in df.columns}
    if unknown := [x for x in template_names(pattern) if x.lower() not in names]:
        raise ValueError(f"unknown columns: {', '.join(unknown)}")
    pieces = re.split(r"\{([^{}]*)\}", pattern)
    parts = [text(names[x.strip().lower()]) if k % 2 else F.lit(x) for k, x in enumerate(pieces) if k % 2 or x]
    out = F.concat(*parts) if parts else F.lit("")
    return trimmed(F.regexp_replace(out, r"(?U)\s{2,}", " ")) if clean else out


def template_with_ends(df: DataFrame, name: str, pattern: str, order: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """df with a template column whose first and last row by `order` have their own; a single row takes the last."""
    ends = df.agg(F.min(order).alias("_first"), F.max(order).alias("_last"))
    out = template(df, pattern)
    cases = F
    if last is not None:
        cases = cases.when(F.col(order) == F.col("_last"), template(df, last))
    if first is not None:
        cases = cases.when(F.col(order) == F.col("_first"), template(df, first))
    value = out if cases is F else cases.otherwise(out)
    return df.join(F.broadcast(ends)).withColumn(name, value).drop("_first", "_last")


@dataclass
class ColumnRule:
    """How a column was made, and the fingerprint of its sources when it was."""

    name: str
    pattern: str
    fingerprint: int | None = None


def sources_fingerprint(df: DataFrame, columns: list[str], order: str) -> DataFrame:
    """(fingerprint): order-free hash of row keys and source cells."""
    return df.agg(F.expr(f"bit_xor(xxhash64(`{order}`, {', '.join(f'`{c}`' for c in columns)}))").alias("fingerprint"))


def rule_state(df: DataFrame, rule: ColumnRule, order: str) -> str:
    """'fresh', 'stale' or 'missing' (a source is gone)."""
    names = template_names(rule.pattern)
    if any(x not in df.columns for x in names):
        return "missing"
    return "fresh" if sources_fingerprint(df, names, order).first()[0] == rule.fingerprint else "stale"


# Formulas


class FormulaError(ValueError):
    pass


_TOKEN = re.compile(r"\s*(?:(\d{1,3}(?: \d{3})+(?:[.,]\d+)?|\d+(?:[.,]\d+)?)|\{([^{}]*)\}|([A-Za-zÅÄÖåäö]+)|([-+*/();]))")
#: Functions by name with their numbers of arguments. Fixed values.
FUNCTIONS = {"RUNDA": 2, "ABS": 1, "MIN": 2, "MAX": 2}


def _tokens(source: str) -> list[tuple[str, str]]:
    out, at = [], 0
    source = source.rstrip()
    while at < len(source):
        m = _TOKEN.match(source, at)
        if not m:
            raise FormulaError(f"unexpected {source[at:].strip()[:1]!r}")
        kind = next(k for k, v in zip(("number", "name", "word", "sign"), m.groups(), strict=True) if v is not None)
        out.append((kind, m.group(m.lastindex)))
        at = m.end()
    return out


class Formula:
    """expr := term (+|- term)*; term := factor (*|/ factor)*; factor := sign factor, number, {Column}, FUNC(a;b) or (expr)."""

    def __init__(self, df: DataFrame, source: str, kinds: dict[str, str] | None = None):
        self.df, self.kinds, self.at = df, kinds or {}, 0
        self.tokens = _tokens(source)
        self.names = {c.lower(): c for c in df.columns}
        self.column = self._expr()
        if self.at < len(self.tokens):
            raise FormulaError(f"unexpected {self.tokens[self.at][1]!r}")

    def _peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def _take(self, sign: str) -> None:
        if self._peek() != ("sign", sign):
            raise FormulaError(f"expected {sign!r}")
        self.at += 1

    def _next(self) -> tuple[str, str]:
        out = self._peek()
        self.at += 1
        return out

    def _expr(self) -> Column:
        out = self._term()
        while self._peek() in (("sign", "+"), ("sign", "-")):
            plus = self._next()[1] == "+"
            other = self._term()
            out = out + other if plus else out - other
        return out

    def _term(self) -> Column:
        out = self._factor()
        while self._peek() in (("sign", "*"), ("sign", "/")):
            times = self._next()[1] == "*"
            other = self._factor()
            out = out * other if times else F.try_divide(out, other)
        return out

    def _factor(self) -> Column:
        kind, value = self._next()
        if kind == "sign" and value in "+-":
            inner = self._factor()
            return -inner if value == "-" else inner
        if kind == "sign" and value == "(":
            out = self._expr()
            self._take(")")
            return out
        if kind == "number":
            return F.lit(float(value.replace(" ", "").replace(",", ".")))
        if kind == "name":
            return self._value(value.strip())
        if kind == "word":
            return self._call(value.upper())
        raise FormulaError(f"unexpected {value or 'end'!r}")

    def _value(self, name: str) -> Column:
        if name.lower() not in self.names:
            raise FormulaError(f"unknown column {name!r}")
        c = self.names[name.lower()]
        kind = dict(self.df.dtypes)[c]
        if self.kinds.get(c) == "date":
            return day_number(parse_date(text(c))["date"]).cast("double")
        if kind in ("date", "timestamp", "timestamp_ntz"):
            return F.datediff(F.col(f"`{c}`"), F.lit("1970-01-01").cast("date")).cast("double")
        return F.col(f"`{c}`").cast("double") if kind != "string" else parse_strict(f"`{c}`")

    def _call(self, name: str) -> Column:
        if name not in FUNCTIONS:
            raise FormulaError(f"unknown function {name!r}")
        self._take("(")
        args = [self._expr()]
        while self._peek() == ("sign", ";"):
            self.at += 1
            args.append(self._expr())
        self._take(")")
        if len(args) != FUNCTIONS[name]:
            raise FormulaError(f"{name} takes {FUNCTIONS[name]} values")
        if name == "ABS":
            return F.abs(args[0])
        if name == "RUNDA":
            by = F.pow(F.lit(10.0), F.greatest(F.lit(0.0), F.least(F.lit(10.0), F.floor(args[1]))))
            return F.floor(args[0] * by + 0.5) / by
        both = args[0].isNotNull() & args[1].isNotNull()
        return F.when(both, (F.least if name == "MIN" else F.greatest)(*args))


def formula(df: DataFrame, source: str, kinds: dict[str, str] | None = None) -> Column:
    """A formula as a double: unknown stays unknown, division by zero is empty, date columns count days."""
    return Formula(df, source, kinds).column


# Find and replace


def replace_error(find: str, regex: bool) -> str | None:
    return regex_error(find) if regex else None


def find_replace(c: Column | str, find: str, new: str, regex: bool = False, case: bool = False, whole: bool = False, accents: bool = False) -> Column:
    """Literal or regex replacement; whole cells compare as a whole, there optionally without accents."""
    c = col(c)
    if find == "":
        return c
    if whole and not regex:
        key = normaliser(False, accents, not case)
        return F.when((c != "") & (trimmed(key(c)) == trimmed(key(F.lit(find)))), F.lit(new)).otherwise(c)
    source = find if regex else r"\Q" + find.replace(r"\E", r"\E\\E\Q") + r"\E"
    source = ("" if case else "(?iu)") + (f"^(?:{source})$" if whole else source)
    to = re.sub(r"\$&", "\\$0", new) if regex else new.replace("\\", "\\\\").replace("$", "\\$")
    return F.regexp_replace(c, source, to)


def replace_hits(df: DataFrame, column: str, find: str, new: str, **options) -> DataFrame:
    """(changed): cells that a replacement changes."""
    c = text(column)
    return df.agg(F.count_if(find_replace(c, find, new, **options) != c).alias("changed"))


