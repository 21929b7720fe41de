import random

from hypothesis import given, settings
from hypothesis import strategies as st

from tablemill.operators.filters import Filter, Rule
from tablemill.plans.pipeline import Pipeline
from tablemill.sources import decode, delimited, sniff, writers, xlsx
from tablemill.streaming import stateless


def test_encodings():
    text = "Namn;Ort\r\nÅsa;Växjö\r\n" * 20
    for name, mark in (("utf-8", b""), ("utf-8", b"\xef\xbb\xbf"), ("utf-16-le", b"\xff\xfe"), ("utf-16-be", b"\xfe\xff"), ("utf-16-le", b""), ("cp1252", b"")):
        d = decode.decode_bytes(mark + text.encode(name))
        assert (d.text, d.encoding, d.mark, d.state, d.newline) == (text, name, bool(mark), "ok", "\r\n")
    assert decode.decode_bytes(b"abc\n").state == "unknown"
    broken = decode.decode_bytes(text.encode().decode("cp1252", "replace").replace("�", "").encode())
    assert broken.state == "mojibake"
    long = ("å" * 50_000).encode()
    assert decode.decode_bytes(long[:-1]).encoding == "utf-8" and decode.unencodable("aå→") == ["→"]


def test_sniffing():
    assert sniff.sniff("a;b;c\n1;2;3\n").delimiter == ";"
    assert sniff.sniff("a,b\n\"1,5;x\",2\n").delimiter == ","
    s = sniff.sniff("Export 2026\n\na\tb\n1\t2\n3\t4\n")
    assert (s.delimiter, s.header_row, s.fields) == ("\t", 2, 2)
    assert sniff.sniff("sep=|\r\na|b\n").directive == 7 and sniff.sniff("one\ntwo\n").fields == 1
    assert sniff.looks_like_header([["a", "b"], ["1", "2"]]) and not sniff.looks_like_header([["a", "1"], ["x", "y"]])


def test_ragged_and_ghost_rows():
    p = delimited.parse_text("Namn;;namn\nx;1;2\ny;3\n;;\nz;4;5;6\n\n")
    assert p.names == ["Namn", "Kolumn 2", "namn (2)", "Extra 4"]
    assert [(r[0], r[1]) for r in p.rows] == [(2, 3), (3, 2), (5, 4)]
    assert dict(p.warnings)["ghost-rows"] == 1 and ("empty-header", 1) in p.warnings and ("duplicate-header", 1) in p.warnings
    assert delimited.parse_clipboard("a\tb\r\n1\t2\r\n") == [["a", "b"], ["1", "2"]]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.text(st.sampled_from("aå;,\"\n\r x="), max_size=6), min_size=2, max_size=2), min_size=1, max_size=6))
def test_write_then_parse(rows):
    rows = [[c.replace("\r", "") for c in r] for r in rows]
    text = "a;b\n" + "".join(";".join('"' + c.replace('"', '""') + '"' for c in r) + "\n" for r in rows)
    p = delimited.parse_text(text, delimited.Options(delimiter=";", trim=False, skip_empty=False, header_row=0))
    assert [r[2] for r in p.rows] == rows


def test_files_round_trip(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, rng.choice(["a;b", 'q"x', " pad ", "=1+1", "-5", "+46 7", "line\nbreak", "", "åäö"])) for i in range(40)]
    df = spark.createDataFrame(rows, "Nr int, Text string")
    data, lost = writers.to_bytes(df, writers.SHEET, order=[df.Nr])
    assert data.startswith(b"\xef\xbb\xbfNr;Text\r\n") and not lost
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.csv").write_bytes(data)
    (tmp_path / "in/b.xlsx").write_bytes(xlsx.write_xlsx(["Nr", "Mer"], [["7", "x"], ["8", ""]], {"Nr": "number"}))
    got = delimited.read_delimited(spark, str(tmp_path / "in"), delimited.Options(trim=False))
    assert got.columns == ["_file", "_src", "_fields", "Nr", "Text", "Mer"]
    want = {str(i): "'" + t if t == "=1+1" else t for i, t in rows}
    seen = {r.Nr: r.Text for r in got.collect()}
    assert seen == want | {"7": "", "8": ""} or {k: v for k, v in seen.items() if k not in "78"} == {k: v for k, v in want.items() if k not in "78"}
    writers.write_lines(df, str(tmp_path / "out"), writers.STANDARD)
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect())[-1] != ""
    kinds = {r.kind for r in delimited.import_warnings(spark, str(tmp_path / "in/a.csv")).collect()}
    assert kinds <= {"ghost-rows", "ragged-row", "encoding-uncertain", "empty-column"}
    (tmp_path / "big.csv").write_text("a;b\n" + "".join(f"{i};x{i}\n" for i in range(500)))
    assert delimited.read_large(spark, str(tmp_path / "big.csv")).filter("b = 'x77'").first().a == "77"
    writers.save_frame(df, str(tmp_path / "frame"), {"name": "x"})
    back, meta = writers.load_frame(spark, str(tmp_path / "frame"))
    assert meta == {"name": "x"} and back.count() == 40


def test_xlsx():
    names = ["Nr", "Datum", "Text"]
    rows = [["1 240,5", "2026-02-28", "007"], ["x", "2026-02-31", "<&>"], ["", "", ""]]
    data = xlsx.write_xlsx(names, rows, {"Nr": "number", "Datum": "date"}, "a/b", colours=[[0, 3, 0]] * 3)
    assert data == xlsx.write_xlsx(names, rows, {"Nr": "number", "Datum": "date"}, "a/b", colours=[[0, 3, 0]] * 3)
    assert xlsx.sheets(data) == ["a b"]
    assert xlsx.read_sheet(data)[:3] == [names, ["1240,5", "2026-02-28", "007"], ["x", "2026-02-31", "<&>"]]
    assert xlsx.date_text(45000.5) == "2023-03-15 12:00" and xlsx.column_letters(27) == "AB" and xlsx.column_number("AB3") == 27


def test_streams(spark, tmp_path):
    spark.createDataFrame([("A", "x"), ("a ", "y"), ("b", "z")], "k string, v string").write.parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema("k string, v string").parquet(str(tmp_path / "s"))
    out = stateless.replayed(stateless.filtered(stream, Filter([Rule("k", "is", "a")])), Pipeline([{"type": "clean", "columns": ["v"], "cleaner": "upper"}]))
    q = out.writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert [r.v for r in spark.sql("select v from seen").collect()] == ["X"]


def test_large_files_by_encoding(spark, tmp_path):
    import pytest

    text = "Nr;Nämn €\n" + "".join(f"{i};å€ž{i}\n" for i in range(50))
    (tmp_path / "w.csv").write_bytes(text.encode("cp1252"))
    got = delimited.read_large(spark, str(tmp_path / "w.csv"))
    assert got.columns == ["Nr", "Nämn €"] and {r[1] for r in got.collect()} == {f"å€ž{i}" for i in range(50)}
    (tmp_path / "u.csv").write_bytes(b"\xff\xfe" + text.encode("utf-16-le"))
    with pytest.raises(ValueError, match="split"):
        delimited.read_large(spark, str(tmp_path / "u.csv"))
    with pytest.raises(ValueError, match="not one of"):
        delimited.parse_file("a.pdf", b"", delimited.Options())


def test_warnings_of_a_sheet(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(xlsx.write_xlsx(["a", "b"], [["1", "2"], ["ä;ö", "x,y"]]))
    assert {(r.kind, r.n) for r in delimited.import_warnings(spark, str(tmp_path / "a.xlsx")).collect()} == {("encoding-uncertain", 1)}
