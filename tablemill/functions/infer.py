"""Column types by inference over distinct values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemill.functions.dates import looks_like_date
from tablemill.functions.email import is_email
from tablemill.functions.numbers import is_identifier, looks_numeric
from tablemill.functions.text import col, normal, trimmed

#: Error strings of spreadsheets. Fixed values.
SHEET_ERRORS = ("#SAKNAS!", "#N/A", "#VÄRDEFEL!", "#VALUE!", "#DIVISION/0!", "#DIV/0!", "#REFERENS!", "#REF!", "#NAMN?", "#NAME?", "#OGILTIGT!", "#NUM!", "#TOM!", "#NULL!")
BOOL_WORDS = ("ja", "nej", "sant", "falskt", "true", "false", "yes", "no", "x", "1", "0")
#: Distinct values that are looked at, and the share that must fit.
DISTINCT, SHARE, PARTS = 2000, 0.85, 64
#: Ties fall to the earlier type.
CANDIDATES = ("email", "date", "number", "bool")


def is_sheet_error(c: Column | str) -> Column:
    return F.upper(trimmed(col(c))).isin(*SHEET_ERRORS)


def is_bool(c: Column | str) -> Column:
    return F.lower(trimmed(normal(c))).isin(*BOOL_WORDS)


def fits(c: Column | str, kind: str) -> Column:
    return {"email": is_email, "date": looks_like_date, "number": looks_numeric, "bool": is_bool}[kind](c)


def violates(c: Column | str, kind: str) -> Column:
    """A filled cell that its column's type can't read."""
    c = col(c)
    if kind in ("text", "empty"):
        return F.lit(False)
    return (trimmed(c) != "") & ~fits(c, kind)


def type_shares(df: DataFrame, columns: list[str], order: str | None = None) -> DataFrame:
    """(column_name, n_distinct, share by candidate, identifiers, type), one aggregate for all columns.

    Looks at the first DISTINCT distinct filled values of each column in order of first appearance
    (by `order`, else by text), which is the rule's own limit.
    """
    pos = F.col(order) if order else F.lit(0)
    long = df.select(pos.alias("_pos"), F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("v")) for c in columns])).alias("x"))
    values = long.select("x.column_name", "x.v", "_pos").filter((trimmed("v") != "") & ~is_sheet_error("v"))
    from pyspark.sql import Window

    first = values.groupBy("column_name", "v").agg(F.min("_pos").alias("p"))
    # Ranked in PARTS parts of each column first, so that no task ranks more than PARTS * DISTINCT values.
    for part in ([F.pmod(F.xxhash64("v"), F.lit(PARTS))], []):
        first = first.withColumn("k", F.row_number().over(Window.partitionBy("column_name", *part).orderBy("p", "v"))).filter(F.col("k") <= DISTINCT)
    kept = first
    shares = kept.groupBy("column_name").agg(
        F.count("*").alias("n_distinct"), *[F.avg(fits("v", k).cast("double")).alias(k) for k in CANDIDATES], F.sum(is_identifier("v").cast("long")).alias("identifiers")
    )
    number = F.when(F.col("identifiers") > 0, 0.0).otherwise(F.col("number"))
    best = F.greatest("email", "date", number, "bool")
    kind = F.when(best < SHARE, "text")
    for k in CANDIDATES:
        kind = kind.when((number if k == "number" else F.col(k)) == best, k)
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "column_name string")
    return names.join(shares.withColumn("type", kind), "column_name", "left").withColumn("type", F.coalesce("type", F.lit("empty")))
