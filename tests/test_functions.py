import math


from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablemill.functions import dates, email, infer, numbers, order, phone, text


def one(spark, values, f):
    df = spark.createDataFrame(list(enumerate(values)), "i int, x string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("x"))).collect()]


def test_text(spark):
    assert one(spark, ["Ångström", "x y​", "é"], text.normal) == ["Ångström", "x y", "é"]
    assert one(spark, ["Ångström é", "Ö̈"], text.without_marks) == ["Angstrom e", "O"]
    assert one(spark, ["anna-lena o'brien", "ÅSA", "", "x  y"], text.CLEANERS["title"]) == ["Anna-Lena O'Brien", "Åsa", "", "X  Y"]
    assert one(spark, ["fÃ¶r", "ok", "Â£", "Ã"], text.mojibake_repaired) == ["för", "ok", "£", "Ã"]


def test_strict_numbers(spark):
    cases = {"1 240,50": 1240.5, "01234": None, "12.5": 12.5, "1e3": 1000.0, "1234567890123456": None, "-5": -5.0, "abc": None, "": None, "0,5": 0.5, "0": 0.0, "+7": 7.0, "1 24": None}
    assert one(spark, list(cases), numbers.parse_strict) == list(cases.values())


def test_lenient_numbers(spark):
    cases = {"1,234.50": 1234.5, "1.234,50": 1234.5, "1,234": 1234.0, "1.234": 1.234, "5-": -5.0, "(1 234,50)": -1234.5, "$ 12": 12.0, "-(5)": -5.0, "1,2,3": None, "kr": None, "": None, "12 kr": 12.0}
    assert one(spark, list(cases), lambda c: numbers.parse_lenient(c)["value"]) == list(cases.values())
    assert one(spark, ["1.234", "1,234"], lambda c: numbers.parse_lenient(c, True)["value"]) == [1234.0, 1.234]


def test_written_numbers(spark):
    cases = {12000.0: "12000", 1e21: "1e+21", 0.1: "0.1", 123456789.25: "123456789.25", 1e-5: "0.00001", 1e-6: "0.000001", 1e-7: "1e-7", -0.5: "-0.5", 1.5e10: "15000000000", 0.0: "0"}
    df = spark.createDataFrame([(i, x) for i, x in enumerate(cases)], "i int, d double")
    assert [r[0] for r in df.orderBy("i").select(numbers.shortest("d")).collect()] == list(cases.values())
    assert [numbers.to_fixed(x, n) for x, n in ((1.005, 2), (2.675, 2), (0.5, 0), (-1.5, 0))] == ["1.00", "2.67", "1", "-2"]


def test_dates(spark):
    cases = {
        "2026-08-27T23:30:00Z": "2026-08-27 23:30", "2026-02-31": None, "27/8-26": "2026-08-27 00:00", "13/2/2026": "2026-02-13 00:00", "2/13/2026": "2026-02-13 00:00", "3/4/1999": "1999-04-03 00:00",
        "den 27 augusti 2026": "2026-08-27 00:00", "August 27th, 2026": "2026-08-27 00:00", "20260827": "2026-08-27 00:00", "45000,5": "2023-03-15 12:00", "27.8.2026 10:05": "2026-08-27 10:05", "nej": None, "1.1.70": "1970-01-01 00:00",
    }
    assert one(spark, list(cases), lambda c: dates.write_date(dates.parse_date(c, serial=True)["date"], "datetime")) == list(cases.values())
    assert one(spark, ["3/4/1999"], lambda c: dates.write_date(dates.parse_date(c, False)["date"])) == ["1999-03-04"]
    assert one(spark, ["1970-01-01", "2000-02-29", "1969-12-31"], lambda c: dates.day_number(dates.parse_date(c)["date"])) == [0, 11016, -1]


def test_phone(spark):
    cases = {"070-123 45 67": "0701234567", "+46 70 1234567": "0701234567", "0046701234567": "0701234567", "Ring 070": None, "1234": None, "+4791234567": "+4791234567"}
    assert one(spark, list(cases), lambda c: phone.write_phone(phone.parse_phone(c), "national")) == list(cases.values())


def test_email(spark):
    got = one(spark, ["Anna.Karlsson12@nordbygg.co.uk", "info@x.se", "c-j.nilsson@gmail.com", "anna-lena@x.se", "bad"], email.parse_email)
    assert tuple(got[0]) == ("anna.karlsson12", "nordbygg.co.uk", "nordbygg", "co.uk", "Anna", "Karlsson", False, False)
    assert got[1].role and got[1].first == "" and (got[2].first, got[2].last, got[2].private) == ("C-J", "Nilsson", True)
    assert (got[3].first, got[3].last) == ("Anna", "Lena") and got[4] is None


def test_order(spark):
    df = spark.createDataFrame([(x,) for x in ["Kund 10", "Kund 2", "Öberg", "Zeta", "Åberg", "", "apa"]], "x string")
    assert [r.x for r in df.orderBy(*order.sort_columns("x")).collect()] == ["apa", "Kund 2", "Kund 10", "Zeta", "Åberg", "Öberg", ""]
    df = spark.createDataFrame([(x,) for x in ["10", "9", "junk", "", "1 000"]], "x string")
    assert [r.x for r in df.orderBy(*order.sort_columns("x", "number", False)).collect()] == ["junk", "1 000", "10", "9", ""]


def test_inference(spark):
    df = spark.createDataFrame([("20260827", "1", "a@b.se", "x"), ("20260828", "0", "b@c.se", ""), ("20260829", "05", "c@d.com", "#N/A")], "a string, b string, c string, d string")
    got = {r.column_name: r.type for r in infer.type_shares(df, list("abcd")).collect()}
    assert got == {"a": "date", "b": "text", "c": "email", "d": "bool"}


@settings(max_examples=5, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6, allow_nan=False), min_size=1, max_size=30))
def test_write_then_read_is_the_same(spark, values):
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(values)], "i int, d double")
    back = [r[0] for r in df.orderBy("i").select(numbers.shortest("d").cast("double")).collect()]
    assert all(math.isclose(a, b, rel_tol=1e-15, abs_tol=0) or a == b for a, b in zip(values, back, strict=True))


