"""Delimited files read with fidelity: ragged rows, ghost rows, preambles and encodings are kept account of.

Files come through Spark's own reader, a row a file, so any store works; each is parsed whole by
one task. `read_large` is the way for files too large for that: Spark splits them, at the price of
a fixed encoding and no line breaks inside fields.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemill.operators.rows import header_names
from tablemill.sources.decode import Decoded, decode_bytes
from tablemill.sources.sniff import HEAD_BYTES, Sniffed, sniff

csv.field_size_limit(1 << 30)
#: Rows that go back to Spark at once.
ROWS_AT_ONCE = 10_000
#: The characters that Latin-1 and Windows-1252 give to the same bytes.
_OWN = bytes(b for b in range(0x80, 0xA0) if bytes([b]).decode("cp1252", "ignore"))
CP1252 = (_OWN.decode("latin-1"), _OWN.decode("cp1252"))
SUFFIXES = (".csv", ".txt", ".tsv", ".xlsx")


@dataclass
class Options:
    delimiter: str | None = None
    encoding: str | None = None
    header_row: int | None = -1
    skip_rows: int = 0
    trim: bool = True
    skip_empty: bool = True


@dataclass
class Parsed:
    names: list[str]
    rows: list[tuple[int, int, list[str]]]
    warnings: list[tuple[str, int]] = field(default_factory=list)


def records(text: str, delimiter: str) -> Iterator[list[str]]:
    yield from csv.reader(io.StringIO(text, newline=""), delimiter=delimiter, quotechar='"', doublequote=True)


def parse_text(text: str, o: Options | None = None, decoded: Decoded | None = None) -> Parsed:
    """Rows as (row in the source, own fields, values); header_row -1: found, None: no header.

    Short rows are padded, long ones add columns, rows of delimiters only are dropped and counted.
    """
    o = o or Options()
    found = sniff(text)
    header = found.header_row if o.header_row == -1 else o.header_row
    start = o.skip_rows if header is None else header
    names: list[str] | None = None
    rows, short, long, ghosts = [], 0, 0, 0
    warnings: list[tuple[str, int]] = []
    for k, values in enumerate(records(text[found.directive :], o.delimiter or found.delimiter)):
        values = values or [""]
        if k < start:
            continue
        if names is None and header is not None:
            names = header_names(values)
            blank = sum(not v.strip() for v in values)
            twice = sum(bool(v.strip()) and v.strip() != n for v, n in zip(values, names, strict=True))
            warnings += [w for w in (("empty-header", blank), ("duplicate-header", twice)) if w[1]]
            continue
        if not any(v.strip() for v in values):
            ghosts += len(values) > 1
            if o.skip_empty:
                continue
        if names is None:
            names = [f"Kolumn {i}" for i in range(1, len(values) + 1)]
        long += len(values) > len(names)
        while len(names) < len(values):
            names.append(header_names([*names, f"Extra {len(names) + 1}"])[-1])
        short += len(values) < len(names)
        rows.append((k + 1, len(values), [v.strip() for v in values] if o.trim else values))
    counted = (("ragged-row", short), ("ragged-row", long), ("ghost-rows", ghosts if o.skip_empty else 0))
    warnings += [w for w in counted if w[1]]
    if names and rows:
        empty = sum(all(len(r[2]) <= i or r[2][i] == "" for r in rows) for i in range(len(names)))
        warnings += [("empty-column", empty)] * bool(empty)
    if decoded is not None:
        warnings += [("mojibake", len(decoded.samples))] * (decoded.state == "mojibake") + [("encoding-uncertain", max(1, decoded.bad))] * (decoded.state == "unknown" or decoded.bad > 0)
    return Parsed(names or [], rows, warnings)


def parse_bytes(data: bytes, o: Options | None = None) -> tuple[Parsed, Decoded]:
    decoded = decode_bytes(data, (o or Options()).encoding)
    return parse_text(decoded.text, o, decoded), decoded


def parse_file(name: str, content: bytes, o: Options) -> Parsed:
    """A file by its suffix; one that none of SUFFIXES fits is refused."""
    from tablemill.sources.xlsx import parse_xlsx

    if not name.lower().endswith(SUFFIXES):
        raise ValueError(f"{name}: not one of {', '.join(SUFFIXES)}")
    return parse_xlsx(content, o) if name.lower().endswith(".xlsx") else parse_bytes(content, o)[0]


def parse_clipboard(text: str) -> list[list[str]]:
    """Pasted text to rows, without a header."""
    text = text.replace("\r\n", "\n").replace("\r", "\n").rstrip("\n")
    return [list(r) for r in records(text, sniff(text).delimiter)] if text else []


def _files(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    for b in batches:
        yield from zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)


def _batch(columns: list[pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(columns, [f"c{i}" for i in range(len(columns))])


def _head(spark: SparkSession, path: str) -> bytes:
    """The head of the first file that isn't empty; only names and lengths are read of the others."""
    files = spark.read.format("binaryFile").load(path)
    first = files.filter("length > 0").select("path").orderBy("path").first()
    if first is None:
        return b""
    return bytes(files.filter(F.col("path") == first.path).select(F.substring("content", 1, HEAD_BYTES).alias("c")).first().c)


def preview(spark: SparkSession, path: str, rows: int = 50, o: Options | None = None) -> tuple[Parsed, Sniffed]:
    """The first rows of a file, from its head cut at a line end."""
    decoded = decode_bytes(_head(spark, path))
    text = decoded.text if len(decoded.text) < HEAD_BYTES // 2 else decoded.text[: decoded.text.rfind("\n") + 1]
    parsed = parse_text(text, o, decoded)
    return Parsed(parsed.names, parsed.rows[:rows], parsed.warnings), sniff(text)


def read_delimited(spark: SparkSession, path: str, o: Options | None = None) -> DataFrame:
    """All columns as text, with _file, _src (row in the file) and _fields (own fields; fewer than columns: padded).

    Columns are those of the widest file by header; a file that lacks one has empty cells.
    """
    o = o or Options()
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def names_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, content in _files(batches):
            names = parse_file(name, bytes(content), o).names
            yield _batch([pa.array([name] * len(names), pa.string()), pa.array(range(len(names)), pa.int32()), pa.array(names, pa.string())])

    seen = files.mapInArrow(names_in, "path string, k int, name string")
    order = seen.groupBy("name").agg(F.min(F.struct("path", "k")).alias("p")).orderBy("p").collect()
    names = [r.name for r in order]
    schema = "_file string, _src long, _fields int" + "".join(f", `{n.replace('`', '``')}` string" for n in names)

    def rows_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path_, content in _files(batches):
            p = parse_file(path_, bytes(content), o)
            place = {n: k for k, n in enumerate(p.names)}
            for at in range(0, len(p.rows), ROWS_AT_ONCE):
                some = p.rows[at : at + ROWS_AT_ONCE]
                cells = [[r[2][place[n]] if n in place and place[n] < len(r[2]) else "" for r in some] for n in names]
                own = [pa.array([path_] * len(some), pa.string()), pa.array([r[0] for r in some], pa.int64()), pa.array([r[1] for r in some], pa.int32())]
                yield _batch(own + [pa.array(c, pa.string()) for c in cells])

    return files.mapInArrow(rows_in, schema)


def import_warnings(spark: SparkSession, path: str, o: Options | None = None) -> DataFrame:
    """(file, kind, n) of every file, and duplicate-file for files of equal content."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    o = o or Options()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, content in _files(batches):
            w = parse_file(name, bytes(content), o).warnings
            yield _batch([pa.array([name] * len(w), pa.string()), pa.array([x[0] for x in w], pa.string()), pa.array([x[1] for x in w], pa.int64())])

    twice = files.groupBy(F.sha2("content", 256).alias("h")).agg(F.count("*").alias("c"), F.max("path").alias("file")).filter("c > 1")
    return files.mapInArrow(run, "file string, kind string, n long").union(twice.select("file", F.lit("duplicate-file"), F.col("c").cast("long")))


def read_large(spark: SparkSession, path: str, o: Options | None = None) -> DataFrame:
    """A splittable read of large UTF-8 or Windows-1252 files, all as text: with a header in the first line, or with header_row None.

    The parts of a folder that many tasks wrote have no header (Format.header False). UTF-16 can't be split at line ends by its bytes and is refused; read_delimited reads it.
    """
    o = o or Options()
    head = decode_bytes(_head(spark, path))
    encoding = {"utf-8": "UTF-8", "cp1252": "ISO-8859-1"}.get(o.encoding or head.encoding)
    if encoding is None:
        raise ValueError(f"{path}: {o.encoding or head.encoding} can't be split; use read_delimited")
    out = (
        spark.read.option("sep", o.delimiter or sniff(head.text).delimiter).option("header", o.header_row is not None).option("quote", '"').option("escape", '"')
        .option("encoding", encoding).option("ignoreLeadingWhiteSpace", o.trim).option("ignoreTrailingWhiteSpace", o.trim).option("nullValue", "\0").option("emptyValue", "").csv(path).na.fill("")
    )
    if encoding == "ISO-8859-1":
        # Spark's reader has Latin-1, which differs in 27 characters only.
        out = out.select(*[F.translate(f"`{c}`", *CP1252).alias(c.translate(str.maketrans(*CP1252))) for c in out.columns])
    return out if o.header_row is not None else out.toDF(*[f"Kolumn {k}" for k in range(1, len(out.columns) + 1)])
