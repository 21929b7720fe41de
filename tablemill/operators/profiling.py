"""Column statistics, content profiles, inventories and selection aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablemill.functions import dates, email, infer, numbers, phone
from tablemill.functions.order import natural
from tablemill.functions.text import trimmed

TOP = 8
#: Share of filled cells that makes a tool worth suggesting; ties go to the more specific.
SUGGEST, TOOLS = 0.5, ("email", "phone", "date", "number", "split")


def _text(c: str) -> Column:
    return F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))


def column_statistics(df: DataFrame, columns: list[str], kinds: dict[str, str] | None = None) -> DataFrame:
    """(column_name, total, filled, empty, invalid, distinct), one aggregate for all columns."""
    kinds = kinds or {}
    stats = [
        F.struct(
            F.lit(c).alias("column_name"), F.count("*").alias("total"), F.count_if(_text(c) != "").alias("filled"), F.count_if(_text(c) == "").alias("empty"),
            F.count_if(infer.violates(_text(c), kinds.get(c, "text"))).alias("invalid"), F.count_distinct(F.when(_text(c) != "", _text(c))).alias("distinct"),
        )
        for c in columns
    ]
    return df.agg(F.array(*stats).alias("x")).select(F.inline("x"))


def top_values(df: DataFrame, column: str, k: int = TOP) -> DataFrame:
    """The k most frequent filled values."""
    return df.filter(_text(column) != "").groupBy(_text(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), natural("value"), "value").limit(k)


def splittable(c: Column) -> Column:
    return c.rlike(r"[^;,|/]+[;,|/]\s*[^;,|/]+") | trimmed(c).rlike(r"^\S+ \S+$")


def content_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, shares by tool, tool): what the filled cells of each column look like."""
    def share(c: str, tool: str) -> Column:
        v = _text(c)
        test = {
            "email": lambda: email.is_email(v), "phone": lambda: phone.parse_phone(v)["digits"].isNotNull(), "date": lambda: dates.parse_date(v)["date"].isNotNull(),
            "number": lambda: numbers.parse_lenient(v)["value"].isNotNull() & ~numbers.is_identifier(v), "split": lambda: splittable(v),
        }[tool]()
        return F.coalesce(F.avg(F.when(v != "", test.cast("double"))), F.lit(0.0)).alias(tool)

    rows = df.agg(F.array(*[F.struct(F.lit(c).alias("column_name"), *[share(c, t) for t in TOOLS]) for c in columns]).alias("x")).select(F.inline("x"))
    best = F.greatest(*TOOLS)
    tool = F.when(best < SUGGEST, F.lit(None).cast("string"))
    for t in TOOLS:
        tool = tool.when(F.col(t) == best, t)
    return rows.withColumn("tool", tool)


def date_inventory(df: DataFrame, column: str, day_first: bool = True, serial: bool = False) -> DataFrame:
    """(format, cells, ambiguous, examples) over the filled cells; up to three examples in text order."""
    counted = df.filter(_text(column) != "").groupBy(_text(column).alias("v")).agg(F.count("*").alias("n"))
    read = counted.withColumn("p", dates.parse_date("v", day_first, serial))
    ranked = read.select("v", "n", F.col("p.format").alias("format"), F.col("p.ambiguous").alias("doubt")).withColumn("r", F.row_number().over(Window.partitionBy("format").orderBy("v")))
    return ranked.groupBy("format").agg(
        F.sum("n").alias("cells"), F.sum(F.when(F.col("doubt"), F.col("n")).otherwise(0)).alias("ambiguous"),
        F.array_join(F.sort_array(F.collect_list(F.when(F.col("r") <= 3, F.col("v")))), " | ").alias("examples"),
    )


def number_inventory(df: DataFrame, column: str) -> DataFrame:
    """(readable, unreadable, negative_forms, units, most_decimals)."""
    p = numbers.parse_lenient(_text(column))
    seen = df.filter(_text(column) != "").select(p.alias("p"), _text(column).alias("v"))
    return seen.agg(
        F.count_if(F.col("p.value").isNotNull()).alias("readable"), F.count_if(F.col("p.value").isNull()).alias("unreadable"), F.count_if("p.negative_form").alias("negative_forms"),
        F.count_distinct(F.when(F.col("p.unit") != "", F.col("p.unit"))).alias("units"), F.max(F.length(F.regexp_extract(numbers.shortest("p.value"), r"\.(\d+)$", 1))).alias("most_decimals"),
    )


def phone_inventory(df: DataFrame, column: str, country: int = 46) -> DataFrame:
    """(readable, unreadable, with_code, foreign_numbers)."""
    seen = df.filter(_text(column) != "").select(phone.parse_phone(_text(column), country).alias("p"))
    return seen.agg(
        F.count_if(F.col("p.digits").isNotNull()).alias("readable"), F.count_if(F.col("p.digits").isNull()).alias("unreadable"),
        F.count_if("p.had_code").alias("with_code"), F.count_if("p.foreign").alias("foreign_numbers"),
    )


def email_inventory(df: DataFrame, column: str) -> DataFrame:
    """(readable, unreadable, roles, private, named, domains)."""
    seen = df.filter(_text(column) != "").select(email.parse_email(_text(column)).alias("p"))
    return seen.agg(
        F.count_if(F.col("p").isNotNull()).alias("readable"), F.count_if(F.col("p").isNull()).alias("unreadable"), F.count_if("p.role").alias("roles"),
        F.count_if("p.private").alias("private"), F.count_if(F.col("p.last") != "").alias("named"), F.count_distinct("p.domain").alias("domains"),
    )


def selection_aggregate(df: DataFrame, columns: list[str]) -> DataFrame:
    """(cells, filled, distinct, numbers, total, mean) over a selection of columns."""
    cells = df.select(F.explode(F.array(*[_text(c) for c in columns])).alias("v")).withColumn("n", numbers.parse_strict("v"))
    return cells.agg(
        F.count("*").alias("cells"), F.count_if(F.col("v") != "").alias("filled"), F.count_distinct(F.when(F.col("v") != "", F.col("v"))).alias("distinct"),
        F.count("n").alias("numbers"), F.sum("n").alias("total"), F.avg("n").alias("mean"),
    )


def preview_counts(df: DataFrame, before: str, after: Column) -> DataFrame:
    """(changed, problems, filled) cells of a rewriting; a null is a problem."""
    own = _text(before)
    return df.agg(F.count_if((own != "") & (after != own)).alias("changed"), F.count_if((own != "") & after.isNull()).alias("problems"), F.count_if(own != "").alias("filled"))
