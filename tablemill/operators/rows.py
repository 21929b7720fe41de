"""Rows and columns as such: numbering, empty ones, edits by key, header names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemill.operators.matching import unique_name
from tablemill.operators.sorting import numbered


def _text(c: str) -> Column:
    return F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))


def insert_column(df: DataFrame, name: str, value: str = "", at: int | None = None) -> DataFrame:
    name = unique_name(name, {c.lower() for c in df.columns})
    order = list(df.columns)
    order.insert(len(order) if at is None else at, name)
    return df.withColumn(name, F.lit(value)).select(*[F.col(f"`{c}`") for c in order])


def remove_columns(df: DataFrame, names: list[str]) -> DataFrame:
    return df.drop(*names)


def rename_column(df: DataFrame, old: str, new: str) -> DataFrame:
    return df.withColumnRenamed(old, unique_name(new, {c.lower() for c in df.columns if c != old}))


def duplicate_column(df: DataFrame, name: str) -> DataFrame:
    """A copy right behind the original, named `name (kopia)`."""
    copy = unique_name(f"{name} (kopia)", {c.lower() for c in df.columns})
    out = []
    for c in df.columns:
        out.append(F.col(f"`{c}`"))
        if c == name:
            out.append(F.col(f"`{c}`").alias(copy))
    return df.select(*out)


def move_column(df: DataFrame, name: str, at: int) -> DataFrame:
    order = [c for c in df.columns if c != name]
    order.insert(at, name)
    return df.select(*[F.col(f"`{c}`") for c in order])


def set_type(df: DataFrame, name: str, kind: str, locked: bool = True) -> DataFrame:
    """The interpretation of a column, kept as metadata: values are never rewritten."""
    return df.withMetadata(name, {"kind": kind, "locked": locked})


def type_of(df: DataFrame, name: str) -> tuple[str, bool]:
    m = df.schema[name].metadata
    return m.get("kind", "text"), m.get("locked", False)


def hide_column(df: DataFrame, name: str, hidden: bool = True) -> DataFrame:
    return df.withMetadata(name, {**df.schema[name].metadata, "hidden": hidden})


def visible(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{f.name}`") for f in df.schema if not f.metadata.get("hidden", False)])


def drop_empty_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return df.filter(F.concat(*[_text(c) for c in columns or df.columns]) != "")


def empty_columns(df: DataFrame) -> list[str]:
    """Columns without a filled cell: one aggregate, and only its names reach the driver."""
    row = df.agg(*[F.max(_text(c) != "").alias(f"c{i}") for i, c in enumerate(df.columns)]).first()
    return [c for i, c in enumerate(df.columns) if not row[f"c{i}"]]


def drop_empty_columns(df: DataFrame) -> DataFrame:
    return df.drop(*empty_columns(df))


def running_number(df: DataFrame, order: list[str], name: str = "Nr") -> DataFrame:
    """A first column 1..n in file order."""
    name = unique_name(name, {c.lower() for c in df.columns})
    return numbered(df, [F.col(c) for c in order], name).select(name, *[F.col(f"`{c}`") for c in df.columns])


def delete_rows(df: DataFrame, row: str, ids: list) -> DataFrame:
    return df.filter(~F.col(row).isin(ids))


def duplicate_rows_by_id(df: DataFrame, row: str, ids: list) -> DataFrame:
    """Copies follow their originals: `copy` is 0 for the original and 1 for the copy."""
    n = F.when(F.col(row).isin(ids), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return df.select("*", F.explode(n).alias("copy"))


def set_cells(df: DataFrame, row: str, ids: list, column: str, value: str) -> DataFrame:
    """A range of one column overwritten by a value."""
    return df.withColumn(column, F.when(F.col(row).isin(ids), F.lit(value)).otherwise(F.col(f"`{column}`").cast("string")))


def fill_down(df: DataFrame, row: str, ids: list, column: str) -> DataFrame:
    """The first selected row's value copied to the rest of the selection (not a forward fill)."""
    if not ids:
        return df
    first = df.filter(F.col(row) == min(ids)).agg(F.first(_text(column)).alias("_value"))
    return df.join(F.broadcast(first)).withColumn(column, F.when(F.col(row).isin(ids), F.col("_value")).otherwise(_text(column))).drop("_value")


def header_names(names: list[str]) -> list[str]:
    """Trimmed headers: blank ones are numbered, repeated ones get (2), (3) ..."""
    taken: set[str] = set()
    return [unique_name(n.strip() or f"Kolumn {k}", taken) for k, n in enumerate(names, 1)]
