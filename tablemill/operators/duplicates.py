"""Duplicate groups and their removal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemill.functions.text import normaliser
from tablemill.operators.sorting import numbered


def _text(c: str) -> Column:
    return F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))


def keys_of(df: DataFrame, columns: list[str] | None, space: bool, marks: bool, case: bool, empties: bool) -> tuple[DataFrame, list[str]]:
    """df with two hashes of the normalised key, and whether it counts: an all-empty key doesn't unless empties is set.

    The 128 bits stand for the key wherever rows meet, so long texts are neither sorted nor dealt as keys.
    """
    norm = normaliser(space, marks, case)
    out = df.withColumn("_key", F.array(*[norm(_text(c)) for c in columns or df.columns]))
    names = ["_key_1", "_key_2"]
    out = out.withColumns({n: F.xxhash64(F.lit(n), "_key") for n in names} | {"_usable": F.lit(True) if empties else F.array_join("_key", "") != ""})
    return out.drop("_key"), names


def duplicate_groups(
    df: DataFrame, order: str, columns: list[str] | None = None, space: bool = True, marks: bool = False, case: bool = True, empties: bool = False
) -> DataFrame:
    """df's rows in groups of two or more, with group_size, first_row (least `order`) and identical.

    identical: the rows of the group agree in every column but `order`. Sizes come from a partial
    aggregate by key, so one huge group costs one row a task; its rows join that one row.
    """
    keyed, names = keys_of(df, columns, space, marks, case, empties)
    own = F.xxhash64(*[_text(c) for c in df.columns if c != order])
    keyed = keyed.filter("_usable").withColumn("_h", own)
    groups = keyed.groupBy(*names).agg(
        F.count("*").alias("group_size"), F.min(order).alias("first_row"), F.max(order).alias("last_row"), (F.min("_h") == F.max("_h")).alias("identical")
    ).filter("group_size > 1")
    return keyed.join(groups, names).select(*df.columns, "group_size", "first_row", "last_row", "identical")


def duplicate_rows(df: DataFrame, columns: list[str] | None = None, **options) -> DataFrame:
    """Only the rows that share their key with another."""
    keyed, names = keys_of(df, columns, *(options.get(k, d) for k, d in (("space", True), ("marks", False), ("case", True), ("empties", False))))
    groups = keyed.filter("_usable").groupBy(*names).agg(F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    return keyed.filter("_usable").join(groups, names, "left_semi").select(*df.columns)


def duplicate_stats(df: DataFrame, columns: list[str] | None = None, space: bool = True, marks: bool = False, case: bool = True, empties: bool = False) -> DataFrame:
    """(groups, rows, surplus, largest) of the duplicates."""
    keyed, names = keys_of(df, columns, space, marks, case, empties)
    sizes = keyed.filter("_usable").groupBy(*names).agg(F.count("*").alias("n")).filter("n > 1")
    return sizes.agg(
        F.count("*").alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("surplus"), F.coalesce(F.max("n"), F.lit(0)).alias("largest")
    )


def remove_surplus(
    df: DataFrame, order: str, columns: list[str] | None = None, keep: str = "first", chosen: list | None = None, space: bool = True, marks: bool = False, case: bool = True, empties: bool = False
) -> DataFrame:
    """One row of each group stays: the first or last by `order`, or a chosen row while it is in its group.

    Each task keeps one row a key before the shuffle, so a key with a third of all rows costs one row a task.
    """
    keyed, names = keys_of(df, columns, space, marks, case, empties)
    row = F.col(f"`{order}`")
    rank = [row.isNull() if keep == "first" else row.isNotNull(), row]
    if chosen:
        rank = [row.isin(chosen) != F.lit(keep == "first"), *rank]
    own = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    alone = F.when(~F.col("_usable"), F.monotonically_increasing_id())
    return keyed.withColumn("_alone", alone).groupBy(*names, "_alone").agg((F.min_by if keep == "first" else F.max_by)(own, F.struct(*rank)).alias("_best")).select("_best.*")


def group_order(df: DataFrame, order: str, columns: list[str], **options) -> DataFrame:
    """Duplicates with groups side by side: group_number counts groups by their first row, by ranges of it."""
    found = duplicate_groups(df, order, columns, **options)
    return found.join(numbered(found.select("first_row").distinct(), [F.col("first_row").asc()], "group_number"), "first_row")
