"""Comparing columns row by row, or by whether a value exists anywhere on the other side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemill.functions.text import normaliser
from tablemill.operators.sorting import numbered

#: Outcomes in their sort order. Fixed values.
SAME, BOTH_EMPTY, DIFFERS, MISSING, EMPTY = "lika", "båda tomma", "skiljer sig", "saknas", "tom"
OUTCOMES = (SAME, BOTH_EMPTY, DIFFERS, MISSING, EMPTY)


def outcome(a: Column, b: Column, here_a: Column, here_b: Column, norm) -> Column:
    """Outcome of two cells, of which one may belong to the longer side."""
    x, y = norm(F.coalesce(a, F.lit(""))), norm(F.coalesce(b, F.lit("")))
    return (
        F.when(~here_a | ~here_b, MISSING).when((x == "") & (y == ""), BOTH_EMPTY).when((x == "") | (y == ""), MISSING).when(x == y, SAME).otherwise(DIFFERS)
    )


def compare_rows(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]], left_place: str, right_place: str, space: bool = True, marks: bool = False, case: bool = True) -> DataFrame:
    """(place, outcome_1, ...): the i-th row against the i-th; each pair of columns is judged alone."""
    norm = normaliser(space, marks, case)
    a = left.select(F.col(left_place).alias("place"), F.lit(True).alias("_a"), *[F.col(f"`{x}`").cast("string").alias(f"_a{i}") for i, (x, _) in enumerate(pairs)])
    b = right.select(F.col(right_place).alias("place"), F.lit(True).alias("_b"), *[F.col(f"`{y}`").cast("string").alias(f"_b{i}") for i, (_, y) in enumerate(pairs)])
    both = a.join(b, "place", "full")
    has = lambda c: F.coalesce(F.col(c), F.lit(False))
    return both.select("place", *[outcome(F.col(f"_a{i}"), F.col(f"_b{i}"), has("_a"), has("_b"), norm).alias(f"outcome_{i + 1}") for i in range(len(pairs))])


def compare_anywhere(left: DataFrame, right: DataFrame, left_column: str, right_column: str, space: bool = True, marks: bool = False, case: bool = True, counts: bool = False) -> DataFrame:
    """left with `outcome` (same, missing or empty) and `n`, how often the other column holds the value."""
    norm = normaliser(space, marks, case)
    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    there = right.select(norm(text(right_column)).alias("_k")).filter("_k <> ''").groupBy("_k").agg(F.count("*").alias("n"))
    own = left.withColumn("_k", norm(text(left_column)))
    label = F.when(F.col("_k") == "", EMPTY).when(F.col("n").isNull(), MISSING).otherwise(
        F.when((F.col("n") > 1) & F.lit(counts), F.concat(F.lit(f"{SAME} ("), F.col("n").cast("string"), F.lit(")"))).otherwise(SAME)
    )
    return own.join(there, "_k", "left").select(*left.columns, label.alias("outcome"), F.coalesce("n", F.lit(0)).alias("n"))


def record_diff(left: DataFrame, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, field, left_value, right_value, outcome) of rows with equal keys, a row a field."""
    a = left.select(key, *[F.col(f"`{c}`").cast("string").alias(f"a{i}") for i, c in enumerate(columns)])
    b = right.select(key, *[F.col(f"`{c}`").cast("string").alias(f"b{i}") for i, c in enumerate(columns)])
    yes, norm = F.lit(True), normaliser(True, False, True)
    cells = [F.struct(F.lit(c).alias("field"), F.col(f"a{i}").alias("left_value"), F.col(f"b{i}").alias("right_value"), outcome(F.col(f"a{i}"), F.col(f"b{i}"), yes, yes, norm).alias("outcome")) for i, c in enumerate(columns)]
    return a.join(b, key).select(key, F.inline(F.array(*cells)))


def frames_identical(a: DataFrame, b: DataFrame, order: str | None = None) -> DataFrame:
    """One row `identical`: equal column names and equal rows, counted with their repeats.

    With `order`, a column of both that says where a row stands, the rows also have to come in the
    same order: the i-th equals the i-th in every other column. A null is not an empty text. Rows are compared by
    sums of two hashes, in one partial aggregate a side.
    """
    if a.columns != b.columns:
        return a.sparkSession.createDataFrame([(False,)], "identical boolean")

    def mark(df: DataFrame) -> DataFrame:
        cells = [x for c in df.columns if c != order for x in (F.col(f"`{c}`").cast("string"), F.col(f"`{c}`").isNull())]
        if order is not None:
            df = numbered(df, [F.col(f"`{order}`").asc()], "_place")
            cells.append(F.col("_place"))
        total = lambda seed: F.coalesce(F.sum(F.xxhash64(F.lit(seed), *cells).cast("decimal(38,0)")), F.lit(0))
        return df.agg(F.count("*").alias("n"), F.struct(total(1), total(2)).alias("h"))

    x, y = mark(a), mark(b)
    return x.crossJoin(y.select(F.col("n").alias("m"), F.col("h").alias("g"))).select(((F.col("n") == F.col("m")) & (F.col("h") == F.col("g"))).alias("identical"))
