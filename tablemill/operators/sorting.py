"""Sorting by levels, with ranks that put what a column can't read behind what it can."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablemill.functions.order import sort_keys

#: Palette order of cell colours; 0 is none.
COLOURS = range(1, 8)


@dataclass
class Level:
    column: str
    ascending: bool = True
    kind: str = "text"
    custom: list[str] | None = None
    colour: bool = False


def keys_of(df: DataFrame, levels: list[Level], tie: str | None = None) -> list[tuple[Column, str]]:
    """Keys to sort by, each with its way; levels of missing columns are skipped, ties keep the order of `tie`."""
    out: list[tuple[Column, str]] = []
    types = dict(df.dtypes)
    for x in levels:
        if x.column not in types:
            continue
        c = F.col(f"`{x.column}`")
        if x.colour:
            none = F.when(F.coalesce(c, F.lit(0)) == 0, 1).otherwise(0)
            out += [(none, "asc"), (c, "asc" if x.ascending else "desc")]
        elif types[x.column] != "string" and not x.custom:
            out.append((c, "asc_nulls_last" if x.ascending else "desc_nulls_last"))
        else:
            out += sort_keys(F.coalesce(c.cast("string"), F.lit("")), x.kind, x.ascending, x.custom)
    return out + ([(F.col(tie), "asc")] if tie else [])


def order_of(df: DataFrame, levels: list[Level], tie: str | None = None) -> list[Column]:
    """keys_of() as columns to sort by."""
    return [getattr(key, way)() for key, way in keys_of(df, levels, tie)]


def keyed(df: DataFrame, keys: list[tuple[Column, str]]) -> tuple[DataFrame, list[Column], list[str]]:
    """df with the keys as columns, so that a sort compares them and doesn't work them out at each comparison."""
    names = [f"_sort_{i}" for i in range(len(keys))]
    return df.withColumns({n: key for n, (key, _) in zip(names, keys, strict=True)}), [getattr(F.col(n), way)() for n, (_, way) in zip(names, keys, strict=True)], names


def sort(df: DataFrame, levels: list[Level], tie: str | None = None) -> DataFrame:
    out, order, names = keyed(df, keys_of(df, levels, tie))
    return out.orderBy(*order).drop(*names)


def ranked(df: DataFrame, levels: list[Level], tie: str, name: str = "rank") -> DataFrame:
    """df with its place from 1 in the sorted order.

    Rows are sorted by ranges; each range numbers its own rows and adds the rows of the ranges
    before it, so no task sees more than its range.
    """
    out, order, names = keyed(df, keys_of(df, levels, tie))
    return numbered(out, order, name).drop(*names)


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Consecutive numbers from 1 in an order, without one task for all rows."""
    from pyspark import StorageLevel

    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()).persist(StorageLevel.DISK_ONLY)
    part, place = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = ranged.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return (
        ranged.withColumn("_part", part).join(F.broadcast(before), "_part")
        .withColumn(name, F.col("_before") + place + 1).drop("_id", "_part", "_before")
    )


def top_k(df: DataFrame, levels: list[Level], k: int, tie: str | None = None) -> DataFrame:
    """The first k rows: each task keeps k of its own."""
    out, order, names = keyed(df, keys_of(df, levels, tie))
    return out.orderBy(*order).limit(k).drop(*names)


def top_k_per(df: DataFrame, by: list[str], levels: list[Level], k: int, tie: str | None = None) -> DataFrame:
    """The first k rows of each group; the limit is applied before the shuffle as well."""
    out, order, names = keyed(df, keys_of(df, levels, tie))
    return out.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("place") <= k).drop(*names)


def signature(df: DataFrame, columns: list[str], row: str) -> DataFrame:
    """(rows, hash) of the key columns by row id, whatever the order of rows, to see whether a frozen order is stale.

    Each cell is hashed with its row's id and column, and nulls apart from empty texts, so equal rows don't cancel and
    swapped cells show. One partial aggregate.
    """
    own = F.xxhash64(F.col(f"`{row}`"), *[x for c in columns for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())])
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(own.cast("decimal(38,0)")), F.lit(0)).alias("hash"))


def stale(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row `stale`: whether two signatures differ, so that a frozen order has to be made again."""
    a, b = before.select(F.struct("rows", "hash").alias("a")), after.select(F.struct("rows", "hash").alias("b"))
    return a.crossJoin(F.broadcast(b)).select((F.col("a") != F.col("b")).alias("stale"))
