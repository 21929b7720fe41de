"""Delimited output: line expressions for distributed text, bytes for single files, frames on disk."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemill.functions.text import trimmed


@dataclass
class Format:
    delimiter: str = ";"
    newline: str = "\r\n"
    encoding: str = "utf-8"
    mark: bool = True
    quote_all: bool = False
    header: bool = True
    guard: bool = True


#: Presets: what spreadsheets open by a double click, and the plain standard.
SHEET = Format()
STANDARD = Format(",", "\n", mark=False, guard=False)
_NUMBER = r"(?U)^\s*(?=.*[0-9])[+-]?([0-9][0-9\s.]*)?(?:[.,][0-9]+)?(?:[eE][+-]?[0-9]+)?\s*$"


def guarded(c: Column) -> Column:
    """An apostrophe before what a spreadsheet would run as a formula, unless it is a number."""
    return F.when(c.rlike(r"^[=+\-@\t\r]") & ~c.rlike(_NUMBER), F.concat(F.lit("'"), c)).otherwise(c)


def field(c: Column, f: Format) -> Column:
    c = guarded(c) if f.guard else c
    inside = c.rlike('["\\n\\r]|' + re.escape(f.delimiter)) | (c != trimmed(c))
    quoted = F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    return quoted if f.quote_all else F.when(inside, quoted).otherwise(c)


def lines(df: DataFrame, f: Format = SHEET, columns: list[str] | None = None) -> DataFrame:
    """df as one `value` column of delimited lines, without the header."""
    cells = [field(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), f) for c in columns or df.columns]
    return df.select(F.concat_ws(f.delimiter, *cells).alias("value"))


def header_line(names: list[str], f: Format = SHEET) -> str:
    quote = lambda v: '"' + v.replace('"', '""') + '"'
    return f.delimiter.join(quote(n) if f.quote_all or re.search('["\\n\\r]|' + re.escape(f.delimiter), n) or n != n.strip() else n for n in names)


def write_lines(df: DataFrame, path: str, f: Format = SHEET, columns: list[str] | None = None) -> None:
    """A folder of text parts in UTF-8, written by all tasks; the header is a part of its own in front."""
    own = columns or df.columns
    out = lines(df, f, own)
    if f.header:
        out = df.sparkSession.createDataFrame([(header_line(own, f),)], "value string").coalesce(1).union(out)
    out.write.mode("overwrite").option("lineSep", f.newline).text(path)


def to_bytes(df: DataFrame, f: Format = SHEET, columns: list[str] | None = None, order: list[Column] | None = None) -> tuple[bytes, list[str]]:
    """One file's bytes and the characters that its encoding loses; rows stream to the driver part by part.

    For files that a person downloads. Larger results go through write_lines.
    """
    own = columns or df.columns
    rows = lines(df.orderBy(*order) if order else df, f, own)
    parts = [header_line(own, f)] if f.header else []
    parts += [r.value for r in rows.toLocalIterator()]
    text = f.newline.join(parts) + f.newline
    lost = sorted({c for c in text if not c.encode(f.encoding, "ignore")}) if f.encoding == "cp1252" else []
    marks = {"utf-8": b"\xef\xbb\xbf", "utf-16-le": b"\xff\xfe", "utf-16-be": b"\xfe\xff"}
    return (marks.get(f.encoding, b"") if f.mark else b"") + text.encode(f.encoding, "replace"), lost


def save_bytes(spark: SparkSession, data: bytes, path: str) -> None:
    """One file's bytes to any store that the session can write."""
    sc = spark.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(sc._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def strict_number(value: str) -> float | None:
    """The strict number grammar on one value, for typed spreadsheet cells."""
    v = value.strip()
    if re.match(r"[+-]?0\d", v) or len(re.sub(r"\D", "", v)) > 15:
        return None
    if not re.fullmatch(r"[+-]?\d{1,3}(?: \d{3})*(?:,\d+)?|[+-]?\d+(?:[.,]\d+)?|[+-]?\d+(?:\.\d+)?[eE][+-]?\d+", v):
        return None
    x = float(v.replace(" ", "").replace(",", "."))
    return int(x) if x.is_integer() and abs(x) < 1e15 else x


def save_frame(df: DataFrame, path: str, meta: dict | None = None) -> None:
    """A frame as Parquet with its column metadata, and a note beside it."""
    df.write.mode("overwrite").parquet(f"{path}/data")
    note = json.dumps({"columns": df.columns, "meta": meta or {}}, ensure_ascii=False)
    df.sparkSession.createDataFrame([(note,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/note")


def load_frame(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    note = json.loads(spark.read.text(f"{path}/note").first().value)
    return spark.read.parquet(f"{path}/data").select(*[F.col(f"`{c}`") for c in note["columns"]]), note["meta"]
