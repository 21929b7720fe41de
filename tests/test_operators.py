import sys
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))

from tablemill.functions import text
from tablemill.operators import columns, comparing, duplicates, filters, fuzzy, groups, matching, pivoting, rows, sorting, stacking
from tablemill.operators.filters import Filter, Rule
from tablemill.operators.groups import Measure
from tablemill.operators.matching import Pair
from tablemill.plans.pipeline import Pipeline

few = settings(max_examples=6, deadline=None)
cell = st.sampled_from(["", "a", "A ", "b", "å", "12", " "])


def frame(spark, values, schema):
    return spark.createDataFrame([(i, *v) for i, v in enumerate(values)], f"i long, {schema}")


@few
@given(st.lists(st.tuples(cell, cell), min_size=1, max_size=25))
def test_filters_are_subsets(spark, values):
    df = frame(spark, values, "x string, y string")
    ids = lambda spec: {r.i for r in filters.apply_filter(df, spec).collect()}
    a, b = Rule("x", "is", "a"), Rule("y", "contains", "1")
    every, one, other, some = ids(Filter([a, b])), ids(Filter([a])), ids(Filter([b])), ids(Filter([a, b], any=True))
    assert every == one & other and some == one | other
    assert ids(Filter([a, b], any=True, inverted=True)) == set(range(len(values))) - some
    assert one == {i for i, v in enumerate(values) if v[0] == "a" or v[0].lower() == "a"}


@few
@given(st.lists(st.tuples(cell), max_size=20), st.lists(st.tuples(cell), max_size=20))
def test_matched_and_rest_are_all_rows(spark, left, right):
    a, b = frame(spark, left, "x string"), frame(spark, right, "y string")
    pairs = [Pair("x", "y", "loose")]
    found = {tuple(r) for r in matching.match(a, b, pairs, "i", "i").collect()}
    key = lambda v: " ".join(v.split()).lower()
    assert found == {(i, j) for i, v in enumerate(left) for j, w in enumerate(right) if key(v[0]) and key(v[0]) == key(w[0])}
    assert {r.i for r in matching.rest(a, b, pairs, "i", "i").collect()} == set(range(len(left))) - {i for i, _ in found}
    assert {r.i for r in matching.rest(b, a, pairs, "i", "i", 1).collect()} == set(range(len(right))) - {j for _, j in found}
    stats = matching.match_stats(a, b, pairs, "i", "i").first()
    assert (stats.n_pairs, stats.matched_left, stats.matched_right) == (len(found), len({i for i, _ in found}), len({j for _, j in found}))


def test_match_kinds(spark):
    a = frame(spark, [("Anna  Öberg",), ("Berg, Carl",), ("",)], "x string").withColumn("mail", F.lit("carl.berg@x.se"))
    b = frame(spark, [("öberg", "anna"), ("Berg", "Carl"), ("Berg", "")], "last string, first string")
    hits = lambda p: sorted(tuple(r) for r in matching.match(a, b, [p], "i", "i").collect())
    assert hits(Pair("x", "first", "name_parts", "last")) == [(0, 0), (1, 1)]
    c = frame(spark, [("Berg Carl",), ("carl bérg",)], "full string")
    assert len(matching.match(a, c, [Pair("mail", "full", "email_name")], "i", "i").collect()) == 6
    assert matching.find_alias("E-post", ["Namn", "mail"]) == "mail" and matching.find_alias("Namn", ["Kundnamn", "NAMN"]) == "NAMN"
    assert matching.difference_span("abXcd", "abYYcd") == (2, 3, 2, 4)
    score = lambda l, r, k, s: {"left_column": l, "right_column": r, "kind": k, "score": s}  # noqa: E731, E741
    assert matching.suggest_pair([score("Namn", "Name", "loose", 9.8), score("Ort", "Stad2", "exact", 10.0)])[1] == "name"
    assert matching.suggest_pair([]) == (None, "no_hit")
    extra = spark.createDataFrame([(0, 0), (7, 7)], "_l long, _r long")
    assert matching.add_pairs(matching.match(a, b, [Pair("x", "first", "name_parts", "last")], "i", "i"), extra).count() == 3
    rounds = matching.match_rounds(a, b.withColumn("z", F.lit("anna öberg")), [[Pair("x", "z", "exact")], [Pair("x", "z", "loose")]], "i", "i")
    assert {(r._l, r.round) for r in rounds.collect()} == {(0, 1)}


def test_groups_tell_unknown_from_zero(spark):
    df = frame(spark, [("A", "1"), ("a ", "x"), ("b", ""), ("", "5"), ("b", "")], "g string, v string")
    m = [Measure("count", alias="n"), Measure("sum", "v"), Measure("mean", "v"), Measure("min", "v", kind="number"), Measure("max", "v", kind="number"), Measure("filled", "v"), Measure("distinct", "v"), Measure("first", "v"), Measure("last", "v"), Measure("list", "v")]
    got = {r.g: tuple(r)[2:] for r in groups.group(df, ["g"], m, "i").collect()}
    assert got == {"A": (2, 1.0, 1.0, "1", "x", 2, 2, "1", "x", "1, x"), "b": (2, None, None, None, None, 0, 0, None, None, None)}
    assert groups.left_out(df, ["g"]).first()[0] == 1 and groups.group(df, [], [Measure("count", alias="n"), Measure("list", "g")], "i").first().n == 5


def test_pivot_totals_come_from_rows(spark):
    df = frame(spark, [("x", "p", 1.0), ("x", "q", 3.0), ("y", "p", 5.0), ("y", "", 7.0), ("x", "p", 1.0)], "r string, c string, v double")
    plan = pivoting.Plan(["r"], ["c"], [Measure("count", alias="n"), Measure("mean", "v", "m"), Measure("distinct", "v", "d")])
    got = {(r.row_1, r.col_1): (r.n, r.m, r.d) for r in pivoting.pivot(df, plan, "i").collect()}
    assert got[("x", None)] == (3, 5 / 3, 2) and got[(None, None)] == (4, 2.5, 3) and got[(None, "p")] == (3, 7 / 3, 2) and ("y", "q") not in got
    for (r, c), (n, _, _) in got.items():
        if r and c:
            assert pivoting.drill_through(df, plan, "i", {"row_1": r, "col_1": c}).count() == n
    wide = {r.r: r for r in pivoting.pivot_table(df, pivoting.Plan(["r"], ["c"], [Measure("count", alias="n")]), "i").collect()}
    assert (wide["x"]["p"], wide["x"]["q"], wide["y"]["q"], wide["y"]["Totalt"]) == (2, 1, None, 1)
    assert pivoting.pie_refusal("mean", 1, 3) and not pivoting.pie_refusal("sum", 1, 3) and pivoting.line_suits("date")
    nested = pivoting.pivot(df, pivoting.Plan(["r"], ["c", "v"], leaves=1), "i")
    assert {r.col_1 for r in nested.collect()} == {None, "p", pivoting.OTHERS}


@few
@given(st.lists(st.tuples(st.sampled_from(["10", "9", "x", "", "1 000", "01"])), min_size=1, max_size=20))
def test_ranks_equal_a_plain_sort(spark, values):
    df = frame(spark, values, "x string")
    got = [r.i for r in sorting.ranked(df, [sorting.Level("x", False, "number")], "i").orderBy("rank").collect()]
    number = {"10": 10, "9": 9, "1 000": 1000}
    key = lambda i: (values[i][0] == "", values[i][0] in number, *((-number[values[i][0]],) if values[i][0] in number else (0,)))
    text = {"x": 0, "01": 1, "": 2}
    assert got == sorted(range(len(values)), key=lambda i: (key(i), text.get(values[i][0], 0), i))


def test_compare(spark):
    a, b = frame(spark, [("A",), ("b",), ("",), ("d",)], "x string"), frame(spark, [("a ",), ("c",), ("",)], "y string")
    assert [r.outcome_1 for r in comparing.compare_rows(a, b, [("x", "y")], "i", "i").orderBy("place").collect()] == ["lika", "skiljer sig", "båda tomma", "saknas"]
    assert [r.outcome for r in comparing.compare_anywhere(a, b, "x", "y").orderBy("i").collect()] == ["lika", "saknas", "tom", "saknas"]
    assert comparing.frames_identical(a, a.orderBy(F.desc("i"))).first()[0] and not comparing.frames_identical(a, a.limit(2)).first()[0]


def test_fuzzy(spark):
    a, b = frame(spark, [("Svenson Bygg",), ("abc",), ("Lind & Co",)], "x string"), frame(spark, [("Svensson Bygg AB",), ("Lind o Co",), ("Öst",)], "y string")
    got = fuzzy.suggest(a, b, "x", "y").collect()
    assert {(r.left_value, r.right_value) for r in got} == {("Svenson Bygg", "Svensson Bygg AB"), ("Lind & Co", "Lind o Co")} and all(0.65 <= r.score <= 1 and r.mutual for r in got)
    same = spark.createDataFrame([("abcd", "abcd")], "x string, y string").select(fuzzy.similarity(F.col("x"), F.col("y"))).first()[0]
    assert same == 1 and fuzzy.capped(fuzzy.suggest(a, b, "x", "y")).count() == 2 and not fuzzy.too_large(a)


def test_stack(spark):
    a, b = frame(spark, [("x", "1")], "Namn string, Ort string"), frame(spark, [("y", "2")], "Name string, Summa string")
    targets = stacking.targets_from_sources([["Namn", "Ort"], ["Name", "Summa"]])
    assert [(t.name, t.included) for t in targets] == [("Namn", True), ("Ort", None), ("Summa", None)]
    keep, rest = stacking.merge_targets(targets[1], targets[2])
    assert keep.sources == {0: "Ort", 1: "Summa"} and rest is None
    targets = stacking.carry_decisions([stacking.Target("Ort", {}, True, "-")], targets)
    got = stacking.stack([a, b], targets, ["f", "f"], ["i", "i"]).orderBy("row_source").collect()
    assert [(r.Namn, r.Ort, r["Källa"]) for r in got] == [("x", "1", "f"), ("y", "-", "f (2)")]
    assert stacking.empty_targets([a, b], [stacking.Target("Z", {}, True)]) == ["Z"]


def test_columns(spark):
    df = frame(spark, [("a; b;c",), ("  ",), ("x",)], "v string")
    get = lambda cols: [tuple(r) for r in df.orderBy("i").select(*cols).collect()]
    assert get(columns.split_each("v", ";", 2)) == [("a", "b;c"), ("", ""), ("x", "")]
    assert get(columns.split_last("v", ";")) == [("a; b", "c"), ("", ""), ("x", "")]
    assert get(columns.extract_pattern("v", "{a};{b};{c}").values()) == [("a", "b", "c"), (None,) * 3, (None,) * 3]
    assert columns.pattern_error("{a}{b}") and columns.pattern_error("x") and not columns.pattern_error("{a}-{b}")
    assert [(r.v, r.part) for r in columns.split_to_rows(df, "v", ";", "i").orderBy("i", "part").collect()] == [("a", 0), ("b", 1), ("c", 2), ("", 0), ("x", 0)]
    one = frame(spark, [("a",)], "v string")
    assert columns.template_with_ends(one, "t", "{v}", "i", "first {v}", "last {v}").first().t == "last a"
    with pytest.raises(ValueError):
        columns.template(df, "{nothing}")
    rule = columns.ColumnRule("t", "{v}", columns.sources_fingerprint(df, ["v"], "i").first()[0])
    assert columns.rule_state(df, rule, "i") == "fresh" and columns.rule_state(df.limit(1), rule, "i") == "stale" and columns.rule_state(df.drop("v"), rule, "i") == "missing"


def test_formulas(spark):
    df = spark.createDataFrame([("1 240,5", "0", "2020-03-01", "")], "a string, b string, d string, e string")
    value = lambda s: df.select(columns.formula(df, s, {"d": "date"})).first()[0]
    assert value("{a} * 2 + 1") == 2482.0 and value("{a} / {b}") is None and value("{e} + 1") is None and value("RUNDA(-2,5; 0)") == -2.0
    assert value("MIN({a}; 10) - -ABS(-3)") == 13.0 and value("{d} - 1") == 18321.0 and value("1 000 + 1") == 1001.0 and value("MAX({e}; 1)") is None
    for bad in ("2 3", "{a} +", "FOO(1)", "MIN(1)", "(1", "{x}", "1,5,2"):
        with pytest.raises(columns.FormulaError):
            columns.formula(df, bad)


def test_rows_and_duplicates(spark):
    df = frame(spark, [("a", ""), ("A ", ""), ("", ""), ("b", "")], "x string, y string")
    assert rows.empty_columns(df) == ["y"] and rows.drop_empty_rows(df, ["x", "y"]).count() == 3
    assert [r.Nr for r in rows.running_number(df, ["i"]).orderBy("i").collect()] == [1, 2, 3, 4]
    assert rows.header_names(["", "a", "A", "a "]) == ["Kolumn 1", "a", "A (2)", "a (3)"]
    assert rows.type_of(rows.set_type(df, "x", "number"), "x") == ("number", True) and rows.visible(rows.hide_column(df, "x")).columns == ["i", "y"]
    assert rows.move_column(df, "y", 0).columns == ["y", "i", "x"] and rows.delete_rows(df, "i", [0, 1]).count() == 2
    assert rows.set_cells(df, "i", [2], "x", "z").filter("x = 'z'").count() == 1
    found = duplicates.duplicate_groups(df, "i", ["x"]).collect()
    assert {(r.i, r.group_size, r.identical) for r in found} == {(0, 2, False), (1, 2, False)}
    assert {r.i for r in duplicates.remove_surplus(df, "i", ["x"], chosen=[1]).collect()} == {1, 2, 3}
    assert duplicates.duplicate_stats(df, ["x"], empties=True).first().groups == 1 and {r.i for r in duplicates.duplicate_rows(df, ["x"]).collect()} == {0, 1}


def test_workflows(spark):
    df = frame(spark, [("Anna.Berg@x.se", "070-1234567", "1 240,50 kr")], "`E-post` string, tel string, summa string")
    flow = Pipeline([
        {"type": "email", "columns": ["epost"], "field": "full", "name": "Namn"}, {"type": "phone", "columns": ["tel"]}, {"type": "number", "columns": ["summa"]},
        {"type": "split", "columns": ["Namn"], "how": "first", "delimiter": " "}, {"type": "formula", "name": "f", "source": "{nope}"}, {"type": "rename", "columns": ["tel"], "name": "Telefon"},
        {"type": "set_type", "columns": ["summa"], "kind": "number"}, {"type": "drop_empty_columns"}, {"type": "drop_empty_rows"}, {"type": "hide_column", "columns": ["gone"]}, {"type": "running_number", "order": ["i"]},
    ])
    out, reports = Pipeline.from_json(flow.to_json()).replay(df)
    r = out.first()
    assert (r.Namn, r.Telefon, r.summa, r["Namn 2"], r.Nr) == ("Anna Berg", "+46701234567", "1240,5", "Berg", 1)
    assert [x.outcome for x in reports].count("refused") == 1 and [x.outcome for x in reports].count("column missing") == 1
    assert dict(flow.counts(df))["phone"] == 1
    with pytest.raises(ValueError):
        Pipeline.from_json('{"version": 2, "steps": []}')


def test_answers_that_were_wrong(spark):
    # Leaf extremes of text columns are by value, like the totals.
    df = frame(spark, [("a", "x", "9"), ("a", "x", "10"), ("a", "y", "7"), ("b", "y", "")], "g string, h string, v string")
    plan = pivoting.Plan(["g"], ["h"], [Measure("max", "v", "most", "number"), Measure("min", "v", "least", "number")])
    got = {r.g: r.asDict() for r in pivoting.pivot_table(df, plan, "i").collect()}
    assert got["a"]["x · most"] == got["a"]["Totalt · most"] == "10" and got["a"]["x · least"] == "9" and got["a"]["Totalt · least"] == "7" and got["b"]["y · most"] is None
    # Equal rows don't cancel in a signature, swaps and nulls show, the order of rows doesn't.
    sign = lambda values: sorting.signature(frame(spark, values, "x string"), ["x"], "i").first()
    seen = [tuple(sign([(x,) for x in v])) for v in (["a", "a"], ["b", "b"], ["a", "b"], ["b", "a"], ["", "a"], [None, "a"])]
    assert len(set(seen)) == 6
    a = frame(spark, [("a",), ("b",), ("c",)], "x string")
    assert tuple(sorting.signature(a, ["x"], "i").first()) == tuple(sorting.signature(a.orderBy(F.desc("i")), ["x"], "i").first())
    assert not sorting.stale(sorting.signature(a, ["x"], "i"), sorting.signature(a.repartition(3), ["x"], "i")).first()[0]
    assert sorting.stale(sorting.signature(a, ["x"], "i"), sorting.signature(a.withColumn("x", F.upper("x")), ["x"], "i")).first()[0]
    # Identity in an order, and nulls apart from empty texts.
    b = frame(spark, [("b",), ("a",), ("c",)], "x string")
    same = lambda *x: comparing.frames_identical(*x).first()[0]
    assert same(a.drop("i"), b.drop("i")) and not same(a, b, "i") and same(a, a.withColumn("i", F.col("i") * 10), "i") and same(a, a.orderBy(F.desc("i")), "i")
    assert not same(frame(spark, [(None,)], "x string"), frame(spark, [("",)], "x string"))
    # Numbers of any length.
    n = frame(spark, [("x9" + "0" * 20,), ("x10" + "0" * 20,), ("x0009",), ("x10",), ("x",)], "x string")
    assert [r.x[:4] for r in sorting.sort(n, [sorting.Level("x")], "i").collect()] == ["x", "x000", "x10", "x900", "x100"]
    # The JVM judges a pattern.
    assert filters.rule_error(Rule("x", "regex", r"\p{javaUpperCase}++a")) is None and filters.rule_error(Rule("x", "regex", "(?P<x>a)"))
    assert columns.replace_error("(?P<x>a)", True) and columns.replace_error(r"\h+", True) is None and columns.replace_error("(", False) is None
    # Orders that aren't numbers.
    d = spark.createDataFrame([("a", "k"), ("c", "k"), ("b", "k"), ("d", "l")], "o string, x string")
    assert {r.o for r in duplicates.remove_surplus(d, "o", ["x"], "last").collect()} == {"c", "d"}
    assert {r.o for r in duplicates.remove_surplus(d, "o", ["x"], "last", chosen=["b"]).collect()} == {"b", "d"}


def test_normaliser_short_cut(spark):
    import unicodedata

    values = ["Plain text", " lead", "trail ", "two  spaces", "tab\there", "Å ä", "é", "a b", "x​", "", "~!@", "A" * 30_000 + " b" * 5000]
    df = frame(spark, [(v,) for v in values], "x string")
    for space in (True, False):
        for marks in (True, False):
            got = [r.k for r in df.select("i", text.normaliser(space, marks, True)("x").alias("k")).orderBy("i").collect()]
            for v, k in zip(values, got):
                want = unicodedata.normalize("NFC", v).replace(" ", " ").replace("​", "")
                want = " ".join(want.split()) if space else want
                want = "".join(c for c in unicodedata.normalize("NFD", want) if not unicodedata.combining(c)) if marks else want
                assert k == want.lower(), (v[:20], space, marks)
