"""Grouping with measures that tell unknown from zero."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemill.functions.numbers import parse_strict, write_number
from tablemill.functions.order import rank_struct
from tablemill.functions.text import normaliser

MEASURES = ("count", "sum", "mean", "min", "max", "filled", "distinct", "first", "last", "list")
#: Values that a list shows. Fixed value.
LIST_CAP = 50


@dataclass
class Measure:
    how: str
    column: str | None = None
    alias: str | None = None
    kind: str = "text"

    @property
    def name(self) -> str:
        return self.alias or (f"{self.how}_{self.column}" if self.column else self.how)


def text_of(df: DataFrame, c: str) -> Column:
    return F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))


def number_of(df: DataFrame, c: str) -> Column:
    """A typed number column as it is, a text column by the strict grammar."""
    kind = dict(df.dtypes)[c]
    return F.col(f"`{c}`").cast("double") if kind != "string" else parse_strict(f"`{c}`")


def aggregate(df: DataFrame, m: Measure, order: str) -> Column:
    """A measure as an aggregate; null where nothing is known, but counts are zero."""
    if m.how == "count":
        return F.count(F.lit(1)).alias(m.name)
    text = text_of(df, m.column)
    filled = text != ""
    typed = dict(df.dtypes)[m.column] != "string"
    known = F.when(filled, F.col(f"`{m.column}`") if typed else text)
    rank = known if typed else F.when(filled, rank_struct(text, m.kind))
    return {
        "sum": lambda: F.sum(number_of(df, m.column)),
        "mean": lambda: F.avg(number_of(df, m.column)),
        "min": lambda: F.min(known) if typed else F.min_by(text, rank),
        "max": lambda: F.max(known) if typed else F.max_by(text, rank),
        "filled": lambda: F.count(known),
        "distinct": lambda: F.count_distinct(known),
        "first": lambda: F.min_by(known, F.when(filled, F.col(order))),
        "last": lambda: F.max_by(known, F.when(filled, F.col(order))),
    }[m.how]().alias(m.name)


def capped_list(df: DataFrame, keys: list[str], column: str, order: str, name: str) -> DataFrame:
    """Distinct filled values by first appearance, the first LIST_CAP joined, the rest counted.

    Distinct values meet first (partial aggregates), and only their first positions are ranked, so
    a group's rows are never gathered.
    """
    from pyspark.sql import Window

    text = text_of(df, column)
    values = df.filter(text != "").groupBy(*keys, text.alias("_v")).agg(F.min(order).alias("_p"))
    by = Window.partitionBy(*keys)
    ranked = values.withColumn("_r", F.row_number().over(by.orderBy("_p", "_v")))
    top = ranked.filter(F.col("_r") <= LIST_CAP).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_r", "_v"))).alias("_l"))
    sizes = values.groupBy(*keys).agg(F.count("*").alias("_n"))
    more = F.when(F.col("_n") > LIST_CAP, F.concat(F.lit(" … (+"), (F.col("_n") - LIST_CAP).cast("string"), F.lit(" till)"))).otherwise("")
    joined = top.join(sizes, keys) if keys else top.crossJoin(F.broadcast(sizes))
    return joined.select(*keys, F.concat(F.array_join("_l._v", ", "), more).alias(name))


def group(df: DataFrame, by: list[str], measures: list[Measure], order: str, space: bool = True, marks: bool = False, case: bool = True, empties: bool = False) -> DataFrame:
    """One row a group: labels (the raw values of its first row by `order`), first_row and the measures.

    Keys are compared normalised. Rows whose keys are all empty are left out unless empties is set.
    Without keys there is one group. Every aggregate combines before the shuffle.
    """
    norm = normaliser(space, marks, case)
    keys = [f"_g{i}" for i in range(len(by))]
    keyed = df.withColumns({k: norm(text_of(df, c)) for k, c in zip(keys, by, strict=True)}) if by else df
    if by and not empties:
        keyed = keyed.filter(F.concat(*keys) != "")
    plain = [m for m in measures if m.how != "list"]
    labels = F.min(F.struct(F.col(order).alias("_o"), *[F.col(f"`{c}`").alias(f"_l{i}") for i, c in enumerate(by)])).alias("_first")
    out = keyed.groupBy(*keys).agg(labels, *[aggregate(df, m, order) for m in plain])
    for m in measures:
        if m.how == "list":
            found = capped_list(keyed, keys, m.column, order, m.name)
            out = out.join(found, keys, "left") if keys else out.crossJoin(found)
    return out.select(*[F.col(f"_first._l{i}").alias(c) for i, c in enumerate(by)], F.col("_first._o").alias("first_row"), *[m.name for m in measures])


def left_out(df: DataFrame, by: list[str], space: bool = True) -> DataFrame:
    """How many rows group() leaves out: those whose keys are all empty."""
    norm = normaliser(space, False, True)
    return df.agg(F.count_if(F.concat(*[norm(text_of(df, c)) for c in by]) == "").alias("n_left_out"))


def readability(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, readable, filled): how many filled cells of each column are numbers."""
    parts = [F.struct(F.lit(c).alias("column_name"), F.count(number_of(df, c)).alias("readable"), F.count_if(text_of(df, c) != "").alias("filled")) for c in columns]
    return df.agg(F.array(*parts).alias("x")).select(F.inline("x"))


def result_text(c: str, comma: bool = True) -> Column:
    """A number of a result as text: empty where nothing is known."""
    return F.coalesce(write_number(c, comma), F.lit(""))
