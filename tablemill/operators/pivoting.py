"""Pivot tables whose subtotals and totals are computed from source rows."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablemill.functions.order import natural, rank_struct
from tablemill.functions.text import normaliser
from tablemill.operators.filters import Filter, apply_filter
from tablemill.operators.groups import Measure, aggregate, text_of

#: Values that a dimension shows, and leaves of nested columns. Fixed values.
ROW_VALUES, COLUMN_VALUES, LEAVES, ROW_CAP = 200, 25, 40, 2000
OTHERS, TOTAL, BLANK = "Övriga", "Totalt", "(tomt)"
#: Measures whose cells add up to their totals.
ADDITIVE = ("count", "sum", "filled")


@dataclass
class Plan:
    rows: list[str]
    columns: list[str] = field(default_factory=list)
    measures: list[Measure] = field(default_factory=lambda: [Measure("count")])
    filter: Filter | None = None
    space: bool = True
    marks: bool = False
    case: bool = False
    blanks: bool = False
    row_values: int = ROW_VALUES
    column_values: int = COLUMN_VALUES
    leaves: int = LEAVES


def dimension(df: DataFrame, column: str, order: str, cap: int, norm, blanks: bool, name: str) -> DataFrame:
    """df with a bucket column: the label (first raw value by `order`) of the `cap` most frequent values, else OTHERS.

    Null marks rows without a value, which the pivot leaves out. The kept values number `cap` at
    most, so their table is safe to broadcast.
    """
    key = norm(text_of(df, column))
    keyed = df.withColumn("_key", F.when(key != "", key))
    counts = keyed.filter(F.col("_key").isNotNull()).groupBy("_key").agg(F.count("*").alias("_n"), F.min(order).alias("_p"), F.min_by(text_of(df, column), order).alias("_label"))
    top = counts.orderBy(F.desc("_n"), "_p").limit(cap).select("_key", "_label")
    out = keyed.join(F.broadcast(top), "_key", "left")
    blank = F.lit(BLANK) if blanks else F.lit(None).cast("string")
    return out.withColumn(name, F.when(F.col("_key").isNull(), blank).otherwise(F.coalesce("_label", F.lit(OTHERS)))).drop("_key", "_label")


def bucketed(df: DataFrame, plan: Plan, order: str) -> tuple[DataFrame, list[str], list[str]]:
    """Filtered source rows with their bucket columns; rows without a value in any dimension are left out."""
    norm = normaliser(plan.space, plan.marks, plan.case)
    out = apply_filter(df, plan.filter) if plan.filter else df
    rows, cols = [f"row_{i + 1}" for i in range(len(plan.rows))], [f"col_{i + 1}" for i in range(len(plan.columns))]
    for name, c in zip(rows, plan.rows, strict=True):
        out = dimension(out, c, order, plan.row_values, norm, plan.blanks, name)
    for name, c in zip(cols, plan.columns, strict=True):
        out = dimension(out, c, order, plan.column_values, norm, plan.blanks, name)
    out = out.dropna(subset=rows + cols)
    if len(cols) >= 2:
        combos = out.groupBy(*cols).agg(F.count("*").alias("_n"))
        top = combos.orderBy(F.desc("_n"), *cols).limit(plan.leaves).drop("_n").withColumn("_leaf", F.lit(True))
        out = out.join(F.broadcast(top), cols, "left")
        out = out.withColumns({c: F.when(F.col("_leaf"), F.col(c)).otherwise(OTHERS) for c in cols}).drop("_leaf")
    return out, rows, cols


def left_out(df: DataFrame, plan: Plan, order: str) -> DataFrame:
    """(n_left_out): rows that lack a value in some dimension."""
    norm = normaliser(plan.space, plan.marks, plan.case)
    out = apply_filter(df, plan.filter) if plan.filter else df
    empty = F.lit(False)
    for c in plan.rows + plan.columns:
        empty = empty | (norm(text_of(df, c)) == "")
    return out.agg(F.count_if(empty & F.lit(not plan.blanks)).alias("n_left_out"))


def pivot(df: DataFrame, plan: Plan, order: str) -> DataFrame:
    """Long form: row and column paths (null above their level), row_level, total_column and the measures.

    One GROUPING SETS pass over the source rows gives leaves, every subtotal and all totals, so a
    mean or a distinct count is never made from cells.
    """
    src, rows, cols = bucketed(df, plan, order)
    sets = []
    for k in range(len(rows), -1, -1):
        for c in ([cols, []] if cols else [[]]):
            sets.append([F.col(x) for x in rows[:k] + c])
    ids = F.grouping_id()
    out = src.groupingSets(sets, *[F.col(x) for x in rows + cols]).agg(ids.alias("_g"), *[aggregate(df, m, order) for m in plan.measures])
    # A bit of grouping_id is 1 where the column is totalled away, the first column is the highest bit.
    n = len(rows) + len(cols)
    shown = lambda i: F.shiftright("_g", n - 1 - i).bitwiseAND(F.lit(1)) == 0
    level = sum((F.when(shown(i), 1).otherwise(0) for i in range(len(rows))), F.lit(0))
    total = ~shown(len(rows)) if cols else F.lit(True)
    return out.select(*rows, *cols, level.alias("row_level"), total.alias("total_column"), *[m.name for m in plan.measures])


def shares(long: DataFrame, plan: Plan, measure: str, of: str = "row") -> DataFrame:
    """Leaf cells of an additive measure with their share of the row's or the column's total."""
    rows, cols = [f"row_{i + 1}" for i in range(len(plan.rows))], [f"col_{i + 1}" for i in range(len(plan.columns))]
    leaf = long.filter((F.col("row_level") == len(rows)) & ~F.col("total_column"))
    if of == "row":
        totals, on = long.filter((F.col("row_level") == len(rows)) & F.col("total_column")), rows
    else:
        totals, on = long.filter((F.col("row_level") == 0) & ~F.col("total_column")), cols
    totals = totals.select(*on, F.col(measure).alias("_total"))
    return leaf.join(totals, on).select(*rows, *cols, measure, F.try_divide(F.col(measure).cast("double"), F.col("_total").cast("double")).alias("share"))


def drill_through(df: DataFrame, plan: Plan, order: str, cell: dict[str, str]) -> DataFrame:
    """The source rows behind a cell, named by its buckets (row_1=..., col_1=...): exactly those it counts."""
    src, rows, cols = bucketed(df, plan, order)
    for name, value in cell.items():
        src = src.filter(F.col(name) == value)
    return src.select(*df.columns)


def capped_rows(long: DataFrame, plan: Plan, cap: int = ROW_CAP) -> DataFrame:
    """Pivot rows in table order up to the cap, which is the tool's own limit."""
    rows = [f"row_{i + 1}" for i in range(len(plan.rows))]
    return long.orderBy(*[c for x in rows for c in (F.col(x).isNull().asc(), natural(x).asc())]).limit(cap)


def sorted_pivot(long: DataFrame, plan: Plan, measure: str, ascending: bool = False) -> DataFrame:
    """The total column's rows with `place`: siblings by a cell inside their parent, empties last both ways."""
    rows = [f"row_{i + 1}" for i in range(len(plan.rows))]
    out = long.filter(F.col("total_column") & (F.col("row_level") > 0))
    own = F.col(measure).asc_nulls_last() if ascending else F.col(measure).desc_nulls_last()
    w = Window.partitionBy("row_level", *[F.when(F.col("row_level") > i + 1, F.col(c)) for i, c in enumerate(rows[:-1])])
    return out.withColumn("place", F.row_number().over(w.orderBy(own, *rows)))


def leaf_order(src: DataFrame, cols: list[str]) -> list[tuple[str, ...]]:
    """Column leaves in display order: the one thing that a wide table's schema needs to know; LEAVES at most or one dimension's cap."""
    rows = src.select(*cols).distinct().orderBy(*[x for c in cols for x in ((F.col(c) == OTHERS).asc(), natural(c).asc())]).collect()
    return [tuple(r) for r in rows]


def pivot_table(df: DataFrame, plan: Plan, order: str) -> DataFrame:
    """Wide form: leaf rows only, a column for each leaf and measure, and the total column."""
    src, rows, cols = bucketed(df, plan, order)
    cells: list[Column] = []
    for leaf in leaf_order(src, cols) if cols else []:
        here = F.lit(True)
        for c, v in zip(cols, leaf, strict=True):
            here = here & (F.col(c) == v)
        for m in plan.measures:
            label = " · ".join([*leaf, *([m.name] if len(plan.measures) > 1 else [])])
            cells.append(_only(df, m, order, here).alias(label))
    for m in plan.measures:
        cells.append(aggregate(df, m, order).alias(" · ".join([TOTAL, *([m.name] if len(plan.measures) > 1 else [])]) if cols else m.name))
    wide = src.groupBy(*rows).agg(*cells)
    return wide.toDF(*plan.rows, *wide.columns[len(rows) :])


def _only(df: DataFrame, m: Measure, order: str, here: Column) -> Column:
    """The measure over the rows of one leaf; a leaf without rows is empty, not zero."""
    if m.how == "count":
        return F.nullif(F.count_if(here), F.lit(0))
    text, typed = text_of(df, m.column), dict(df.dtypes)[m.column] != "string"
    from tablemill.operators.groups import number_of

    own = F.when(here & (text != ""), F.col(f"`{m.column}`") if typed else text)
    number = F.when(here, number_of(df, m.column))
    rank = own if typed else F.when(here & (text != ""), rank_struct(text, m.kind))
    return {
        "sum": lambda: F.sum(number), "mean": lambda: F.avg(number), "min": lambda: F.min_by(own, rank), "max": lambda: F.max_by(own, rank), "filled": lambda: F.count(own),
        "distinct": lambda: F.count_distinct(own), "first": lambda: F.min_by(own, F.when(own.isNotNull(), F.col(order))), "last": lambda: F.max_by(own, F.when(own.isNotNull(), F.col(order))),
    }[m.how]()


#: Categories, series and pie slices that a chart shows. Fixed values.
CATEGORIES, SERIES, SLICES = 30, 8, 6


def chart_data(long: DataFrame, plan: Plan, measure: str) -> DataFrame:
    """(category, series, value): the first categories in table order and the largest series by absolute total."""
    rows, cols = [f"row_{i + 1}" for i in range(len(plan.rows))], [f"col_{i + 1}" for i in range(len(plan.columns))]
    leaf = long.filter((F.col("row_level") == len(rows)) & (~F.col("total_column") if cols else F.lit(True)))
    cells = leaf.select(F.concat_ws(" · ", *rows).alias("category"), (F.concat_ws(" · ", *cols) if cols else F.lit(measure)).alias("series"), F.col(measure).cast("double").alias("value"))
    shown = cells.select("category").distinct().orderBy((F.col("category") == OTHERS).asc(), natural("category"), "category").limit(CATEGORIES)
    largest = cells.groupBy("series").agg(F.sum(F.abs("value")).alias("_t")).orderBy(F.desc("_t"), "series").limit(SERIES).select("series")
    return cells.join(F.broadcast(shown), "category").join(F.broadcast(largest), "series").select("category", "series", "value")


def pie_refusal(measure: str, n_series: int, n_slices: int) -> str | None:
    """Why a pie would mislead, if so."""
    if measure not in ADDITIVE:
        return "not additive"
    if n_series > 1:
        return "several series"
    return "too many slices" if n_slices > SLICES else "too few slices" if n_slices < 2 else None


def line_suits(kind: str) -> bool:
    """A line chart needs an ordered first row field."""
    return kind in ("number", "date")
