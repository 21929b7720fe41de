"""Registered queries over files, and those whose conditions meet rows of the driver's tables; see catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablemill.operators import comparing, duplicates, filters, matching, pivoting, rows, sorting, stacking
from tablemill.operators.filters import Filter, Rule
from tablemill.operators.groups import Measure
from tablemill.operators.matching import Pair
from tablemill.operators.sorting import Level
from tablemill.plans.catalogue import part_cells, register, table
from tablemill.plans.scratch import folder
from tablemill.sources import decode, delimited, sniff, writers, xlsx

# Files: written from a table to the shared folder and read again


def odd_suppliers(spark, sf):
    """Cells that need quotes, that a spreadsheet would run, in letters beyond ASCII, negative numbers, and empty ones."""
    made = """CASE s_suppkey % 5 WHEN 0 THEN concat(s_name, '; "quoted" z') WHEN 1 THEN concat('=1+', s_suppkey) WHEN 2 THEN 'åäö €' WHEN 3 THEN concat('-', s_suppkey) ELSE '' END"""
    return table(spark, sf, "supplier").select("s_suppkey", F.expr(made).alias("cell"))


@register("csv_round_trip", """
SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN s_name || '; "quoted" z' WHEN 1 THEN chr(39) || '=1+' || CAST(s_suppkey AS VARCHAR) WHEN 2 THEN 'åäö €' WHEN 3 THEN '-' || CAST(s_suppkey AS VARCHAR) ELSE '' END AS cell, 2 AS _fields FROM supplier""")
def csv_round_trip(spark, sf):
    data, _ = writers.to_bytes(odd_suppliers(spark, sf), writers.SHEET)
    path = f"{folder(spark)}/a.csv"
    writers.save_bytes(spark, data, path)
    return delimited.read_delimited(spark, path).select("s_suppkey", "cell", "_fields")


@register("csv_lines", """
SELECT CAST(s_suppkey AS VARCHAR) || ';' || CASE s_suppkey % 5 WHEN 0 THEN '"' || s_name || '; ""quoted"" z"' WHEN 1 THEN chr(39) || '=1+' || CAST(s_suppkey AS VARCHAR) WHEN 2 THEN 'åäö €' WHEN 3 THEN '-' || CAST(s_suppkey AS VARCHAR) ELSE '' END AS value FROM supplier""")
def csv_lines(spark, sf):
    return writers.lines(odd_suppliers(spark, sf))


@register("csv_large_round_trip", """
SELECT CAST(l_orderkey AS VARCHAR) AS l_orderkey, CAST(l_partkey AS VARCHAR) AS l_partkey, CAST(l_suppkey AS VARCHAR) AS l_suppkey, CAST(l_linenumber AS VARCHAR) AS l_linenumber, l_returnflag || '; "' || l_linestatus AS flags FROM lineitem""")
def csv_large_round_trip(spark, sf):
    own = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    li = table(spark, sf, "lineitem").select(*own, F.concat("l_returnflag", F.lit('; "'), "l_linestatus").alias("flags"))
    path = folder(spark)
    writers.write_lines(li, path, writers.Format(newline="\n", header=False))
    return delimited.read_large(spark, path, delimited.Options(header_row=None)).toDF(*own, "flags")


ENCODINGS = ("utf-8", "cp1252", "utf-16-le", "utf-16-be")


@register("read_encodings", """
SELECT e AS encoding, CAST(n_nationkey AS VARCHAR) AS nr, n_name || ' åé€' AS name FROM nation, (VALUES ('utf-8'), ('cp1252'), ('utf-16-le'), ('utf-16-be')) t(e)""")
def read_encodings(spark, sf):
    out, n = None, table(spark, sf, "nation").select(F.col("n_nationkey").alias("nr"), F.concat("n_name", F.lit(" åé€")).alias("name"))
    for e in ENCODINGS:
        path = f"{folder(spark)}/{e}.txt"
        writers.save_bytes(spark, writers.to_bytes(n, writers.Format(encoding=e))[0], path)
        own = delimited.read_delimited(spark, path).select(F.lit(e).alias("encoding"), "nr", "name")
        out = own if out is None else out.union(own)
    return out


@register("read_large_cp1252", "SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name || ' å€' AS name FROM supplier")
def read_large_cp1252(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", F.concat("s_name", F.lit(" å€")).alias("name"))
    path = f"{folder(spark)}/a.csv"
    writers.save_bytes(spark, writers.to_bytes(s, writers.Format(encoding="cp1252"))[0], path)
    return delimited.read_large(spark, path)


@register("xlsx_round_trip", """
SELECT CAST(s_suppkey AS VARCHAR) AS nr, s_name AS name, CAST(s_suppkey // 4 AS VARCHAR) || CASE s_suppkey % 4 WHEN 0 THEN '' WHEN 1 THEN ',25' WHEN 2 THEN ',5' ELSE ',75' END AS quarter, '2024-02-' || lpad(CAST(s_suppkey % 29 + 1 AS VARCHAR), 2, '0') AS day FROM supplier""")
def xlsx_round_trip(spark, sf):
    quarter = "concat(s_suppkey div 4, CASE s_suppkey % 4 WHEN 0 THEN '' WHEN 1 THEN ',25' WHEN 2 THEN ',5' ELSE ',75' END)"
    s = table(spark, sf, "supplier").selectExpr("s_suppkey", "s_name", quarter, "concat('2024-02-', lpad(s_suppkey % 29 + 1, 2, '0'))").orderBy("s_suppkey")
    cells = [list(map(str, r)) for r in s.toLocalIterator()]
    path = f"{folder(spark)}/a.xlsx"
    writers.save_bytes(spark, xlsx.write_xlsx(["nr", "name", "quarter", "day"], cells, {"nr": "number", "quarter": "number", "day": "date"}), path)
    return delimited.read_delimited(spark, path).select("nr", "name", "quarter", "day")


@register("import_warnings", """
SELECT * FROM (VALUES ('a.csv', 'ragged-row', CAST(1 AS BIGINT)), ('a.csv', 'ragged-row', 1), ('a.csv', 'ghost-rows', 1), ('a.csv', 'encoding-uncertain', 1), ('a.csv', 'duplicate-header', 1), ('b.xlsx', 'encoding-uncertain', 1), ('c.csv', 'mojibake', 1)) t(file, kind, n)""")
def import_warnings(spark, sf):
    path = folder(spark)
    files = {"a.csv": b"a;b;A\n1;2;3\n1;2\n;;\n1;2;3;4\n1;2;3;4\n", "b.xlsx": xlsx.write_xlsx(["x"], [["åäö, 1; 2"]]), "c.csv": "a;b\nfÃ¶r;2\n".encode()}
    for name, data in files.items():
        writers.save_bytes(spark, data, f"{path}/{name}")
    return delimited.import_warnings(spark, path).withColumn("file", F.regexp_extract("file", "[^/]*$", 0))


@register("preview_file", "SELECT CAST(n_nationkey AS VARCHAR) AS nr, n_name AS name, ';' AS delimiter, CAST(2 AS BIGINT) AS header_row FROM nation ORDER BY n_nationkey LIMIT 5")
def preview_file(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("nr"), F.col("n_name").alias("name"))
    data, _ = writers.to_bytes(n, writers.Format(mark=False), order=[F.col("nr")])
    path = f"{folder(spark)}/a.csv"
    writers.save_bytes(spark, b"Export of nations\r\n\r\n" + data, path)
    parsed, found = delimited.preview(spark, path, 5)
    return spark.createDataFrame([(*r[2], found.delimiter, found.header_row) for r in parsed.rows], "nr string, name string, delimiter string, header_row long")


@register("sniff_files", "SELECT * FROM (VALUES ('a;b', ';', 2, true), ('sep', '|', 2, true), ('quoted', ',', 2, true), ('tabs', chr(9), 3, true)) t(name, delimiter, fields, confident)")
def sniff_files(spark, sf):
    texts = {"a;b": "a;b\n1;2,5\n3;4\n", "sep": "sep=|\na|b\n1|2\n", "quoted": 'a,b\n"1;x",2\n"3;y",4\n', "tabs": "a\tb\tc\n1\t2\t3\n"}
    found = [(n, s.delimiter, s.fields, s.confident) for n, s in ((n, sniff.sniff(t)) for n, t in texts.items())]
    return spark.createDataFrame(found, "name string, delimiter string, fields int, confident boolean")


@register("decode_files", "SELECT * FROM (VALUES ('utf-8', 'utf-8', 'ok'), ('cp1252', 'cp1252', 'ok'), ('utf-16-le', 'utf-16-le', 'ok'), ('ascii', 'utf-8', 'unknown'), ('twice', 'utf-8', 'mojibake')) t(name, encoding, state)")
def decode_files(spark, sf):
    own = "Namn;Ort\r\nÅsa;Växjö\r\n" * 9
    data = {e: own.encode(e) for e in ("utf-8", "cp1252", "utf-16-le")} | {"ascii": b"a;b\r\n" * 9, "twice": ("för;Växjö\r\n" * 9).encode().decode("cp1252").encode()}
    found = [(n, d.encoding, d.state) for n, d in ((n, decode.decode_bytes(b)) for n, b in data.items())]
    return spark.createDataFrame(found, "name string, encoding string, state string")


@register("clipboard", "SELECT CAST(n_nationkey AS VARCHAR) AS nr, n_name AS name FROM nation")
def clipboard(spark, sf):
    n = table(spark, sf, "nation").select("n_nationkey", "n_name").orderBy("n_nationkey").collect()
    return spark.createDataFrame([tuple(r) for r in delimited.parse_clipboard("".join(f"{r[0]}\t{r[1]}\r\n" for r in n))], "nr string, name string")


@register("frame_on_disk", 'SELECT p_partkey, p_name AS "Namn; 1", p_size FROM part')
def frame_on_disk(spark, sf):
    path = folder(spark)
    writers.save_frame(table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("Namn; 1"), "p_size"), path, {"source": "part"})
    return writers.load_frame(spark, path)[0]


# Filters and views that meet rows

for _name, _rule, _where in (
    ("contains_hit", Rule("p_name", "contains", "ED W"), "contains(lower(p_name), 'ed w')"),
    ("contains_not_hit", Rule("p_name", "contains_not", "red"), "NOT contains(lower(p_name), 'red')"),
    ("starts_hit", Rule("p_name", "starts", "Sm"), "starts_with(lower(p_name), 'sm')"),
    ("java_regex", Rule("p_name", "regex", r"^\p{javaLowerCase}++ (?:bolt|ring)$", case=True), "regexp_matches(p_name, '^[a-z]+ (bolt|ring)$')"),
    ("case_sensitive", Rule("p_type", "is", "economy", case=True), "p_type = 'economy'"),
    ("case_sensitive_hit", Rule("p_type", "is", "ECONOMY", case=True), "p_type = 'ECONOMY'"),
):
    register(f"filter_{_name}", f"SELECT p_partkey FROM part WHERE {_where}")(lambda spark, sf, r=_rule: filters.apply_filter(part_cells(spark, sf), Filter([r])).select("p_partkey"))


@register("filter_all_hit", "SELECT p_partkey FROM part WHERE p_size > 25 AND contains(lower(p_type), 'econ') AND NOT contains(lower(p_name), 'red')")
def filter_all_hit(spark, sf):
    spec = Filter([Rule("p_size", "more", "25", kind="number"), Rule("p_type", "contains", "econ"), Rule("p_name", "contains_not", "RED")])
    return filters.apply_filter(part_cells(spark, sf), spec).select("p_partkey")


@register("view_whole_chain", """
WITH v AS (SELECT p_partkey, p_name, p_size, count(*) OVER (PARTITION BY lower(p_name), p_size) AS n FROM part WHERE (contains(lower(p_name), 'ed') OR contains(lower(p_type), 'ed')) AND p_size > 10)
SELECT p_partkey, row_number() OVER (ORDER BY p_size DESC, p_partkey) AS place FROM v WHERE n > 1""")
def view_whole_chain(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_name", "p_type", "p_size")
    found = filters.search(p, "ÉD", ["p_name", "p_type"])
    seen = filters.view(found, "", Filter([Rule("p_size", "more", 10, kind="number")]), duplicates_of=["p_name", "p_size"])
    return sorting.ranked(seen, [Level("p_size", False)], "p_partkey", "place").select("p_partkey", "place")


@register("view_query", "SELECT s_suppkey FROM supplier WHERE contains(s_name, '#00000000') OR contains(CAST(s_suppkey AS VARCHAR), '#00000000') OR contains(CAST(s_nationkey AS VARCHAR), '#00000000')")
def view_query(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    return filters.view(s, "#00000000", Filter([Rule("s_suppkey", "filled")]), [F.col("s_name").desc()]).select("s_suppkey")


@register("restrict_changed", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'")
def restrict_changed(spark, sf):
    c = table(spark, sf, "customer").withColumn("after", F.when(F.col("c_mktsegment") == "BUILDING", "Bygg").otherwise(F.col("c_mktsegment")))
    return filters.restrict_changed(c, "c_mktsegment", "after").select("c_custkey")


# Sorting, identity and duplicates


@register("sort_long_numbers", "SELECT p_partkey, row_number() OVER (ORDER BY p_size % 7, p_partkey) AS rank FROM part")
def sort_long_numbers(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.expr("concat('nr ', p_size % 7 * 3 + 1, repeat('0', 24))").alias("v"))
    return sorting.ranked(p, [Level("v")], "p_partkey").select("p_partkey", "rank")


@register("sort_colour", "SELECT p_partkey, row_number() OVER (ORDER BY CASE WHEN p_size % 4 = 0 THEN 1 ELSE 0 END, p_size % 4, p_partkey) AS rank FROM part")
def sort_colour(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", (F.col("p_size") % 4).alias("colour"))
    return sorting.ranked(p, [Level("colour", colour=True)], "p_partkey").select("p_partkey", "rank")


@register("frozen_order", "SELECT 'swapped' AS change, true AS stale UNION ALL SELECT 'same', false")
def frozen_order(spark, sf):
    p = table(spark, sf, "part")
    before, swapped = sorting.signature(p, ["p_name"], "p_partkey"), p.withColumn("p_partkey", F.expr("CASE p_partkey WHEN 0 THEN 1 WHEN 1 THEN 0 ELSE p_partkey END"))
    changed = lambda df, name: sorting.stale(before, sorting.signature(df, ["p_name"], "p_partkey")).select(F.lit(name).alias("change"), "stale")
    return changed(swapped, "swapped").union(changed(p.repartition(5), "same"))


@register("frames_differ", "SELECT 'order' AS change, false AS identical UNION ALL SELECT 'rows', true UNION ALL SELECT 'cell', false")
def frames_differ(spark, sf):
    n = table(spark, sf, "nation").select("n_name", F.col("n_nationkey").alias("row"))
    turned = n.withColumn("row", -F.col("row"))
    tests = {"order": (n, turned, "row"), "rows": (n.drop("row"), turned.drop("row"), None), "cell": (n, n.withColumn("n_name", F.when(F.col("row") != 3, F.col("n_name"))), "row")}
    out = [comparing.frames_identical(*x).select(F.lit(name).alias("change"), "identical") for name, x in tests.items()]
    return out[0].union(out[1]).union(out[2])


@register("dedup_identical", """
WITH g AS (SELECT p_name, count(*) AS n, count(DISTINCT p_type || '/' || p_brand) AS kinds FROM part GROUP BY 1 HAVING count(*) > 1)
SELECT p_partkey, n AS group_size, kinds = 1 AS identical FROM part JOIN g USING (p_name) UNION ALL SELECT -1 - n_nationkey, 2, true FROM nation UNION ALL SELECT -101 - n_nationkey, 2, true FROM nation""")
def dedup_identical(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_name", "p_type", "p_brand")
    key = F.col("n_nationkey").cast("long")
    twice = table(spark, sf, "nation").select(F.explode(F.array(-1 - key, -101 - key)).alias("p_partkey"), F.col("n_name").alias("p_name"), F.lit("x").alias("p_type"), F.lit("y").alias("p_brand"))
    return duplicates.duplicate_groups(p.union(twice), "p_partkey", ["p_name"]).select("p_partkey", "group_size", "identical")


@register("dedup_keep_last_by_time", """
WITH a AS (SELECT user_id, event_type, ts FROM events GROUP BY 1, 2, 3) SELECT user_id, event_type, max(ts) AS ts FROM a GROUP BY 1, 2""")
def dedup_keep_last_by_time(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_type", "ts").distinct()
    return duplicates.remove_surplus(e, "ts", ["user_id", "event_type"], "last").select("user_id", "event_type", "ts")


# Pivots


@register("pivot_table_extremes", """
SELECT p_brand, CAST(max(p_size) FILTER (WHERE p_type = 'ECONOMY') AS VARCHAR) AS "ECONOMY · most", CAST(min(p_size) FILTER (WHERE p_type = 'ECONOMY') AS VARCHAR) AS "ECONOMY · least",
CAST(max(p_size) AS VARCHAR) AS "Totalt · most", CAST(min(p_size) AS VARCHAR) AS "Totalt · least" FROM part GROUP BY 1""")
def pivot_table_extremes(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_brand", "p_type", F.col("p_size").cast("string").alias("v"))
    plan = pivoting.Plan(["p_brand"], ["p_type"], [Measure("max", "v", "most", "number"), Measure("min", "v", "least", "number")])
    wide = pivoting.pivot_table(p, plan, "p_partkey")
    return wide.select("p_brand", *[F.col(f"`{a} · {b}`") for a in ("ECONOMY", "Totalt") for b in ("most", "least")])


@register("pivot_two_columns", """
WITH o AS (SELECT o_orderstatus, o_orderpriority, CAST(year(o_orderdate) AS VARCHAR) AS y FROM orders), t AS (SELECT o_orderpriority, y FROM o GROUP BY 1, 2 ORDER BY count(*) DESC, 1, 2 LIMIT 4),
b AS (SELECT o_orderstatus, CASE WHEN t.y IS NULL THEN 'Övriga' ELSE o.o_orderpriority END AS p, coalesce(t.y, 'Övriga') AS y FROM o LEFT JOIN t ON o.o_orderpriority = t.o_orderpriority AND o.y = t.y)
SELECT o_orderstatus AS row_1, p AS col_1, y AS col_2, count(*) AS n FROM b GROUP BY 1, 2, 3""")
def pivot_two_columns(spark, sf):
    o = table(spark, sf, "orders").withColumn("y", F.year("o_orderdate").cast("string"))
    plan = pivoting.Plan(["o_orderstatus"], ["o_orderpriority", "y"], [Measure("count", alias="n")], leaves=4)
    return pivoting.pivot(o, plan, "o_orderkey").filter("row_level = 1 and not total_column").select("row_1", "col_1", "col_2", "n")


@register("pivot_row_cap", "SELECT p_name AS row_1, count(*) AS n FROM part GROUP BY 1 ORDER BY 1 LIMIT 10")
def pivot_row_cap(spark, sf):
    plan = pivoting.Plan(["p_name"], measures=[Measure("count", alias="n")])
    long = pivoting.pivot(table(spark, sf, "part"), plan, "p_partkey").filter("row_level = 1")
    return pivoting.capped_rows(long, plan, 10).select("row_1", "n")


# Matching


@register("match_rounds", """
WITH l AS (SELECT c_custkey, CASE WHEN c_custkey % 10 <> 0 THEN c_custkey END AS a FROM customer), r AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 13 <> 0 THEN o_custkey END AS a FROM orders),
one AS (SELECT c_custkey, o_orderkey FROM l JOIN r USING (a))
SELECT c_custkey AS _l, o_orderkey AS _r, 0 AS round FROM one UNION ALL
SELECT c_custkey, o_orderkey, 1 FROM l JOIN r ON c_custkey = o_custkey WHERE c_custkey NOT IN (SELECT c_custkey FROM one) AND o_orderkey NOT IN (SELECT o_orderkey FROM one)""")
def match_rounds(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.expr("if(c_custkey % 10 = 0, '', cast(c_custkey as string))").alias("a"), F.expr("concat('nr ', c_custkey)").alias("b"))
    o = table(spark, sf, "orders").select("o_orderkey", F.expr("if(o_orderkey % 13 = 0, '', cast(o_custkey as string))").alias("a"), F.expr("concat('NR ', o_custkey)").alias("b"))
    return matching.match_rounds(c, o, [[Pair("a", "a", "exact")], [Pair("b", "b", "loose")]], "c_custkey", "o_orderkey")


@register("match_by_hand", "SELECT s_suppkey AS _l, s_nationkey AS _r FROM supplier UNION SELECT n_nationkey, 0 FROM nation")
def match_by_hand(spark, sf):
    s, n = table(spark, sf, "supplier").withColumn("k", F.col("s_nationkey").cast("string")), table(spark, sf, "nation").withColumn("k", F.col("n_nationkey").cast("string"))
    found = matching.match(s, n, [Pair("k", "k", "exact")], "s_suppkey", "n_nationkey")
    return matching.add_pairs(found, n.select(F.col("n_nationkey").cast("long").alias("_l"), F.lit(0).alias("_r")))


@register("rest_written_off", "SELECT s_suppkey FROM supplier WHERE s_nationkey >= 20 AND s_suppkey NOT IN (0, 1, 2)")
def rest_written_off(spark, sf):
    s = table(spark, sf, "supplier").withColumn("k", F.expr("if(s_nationkey >= 20, 'none', cast(s_nationkey as string))"))
    n = table(spark, sf, "nation").withColumn("k", F.col("n_nationkey").cast("string"))
    return matching.rest(s, n, [Pair("k", "k", "exact")], "s_suppkey", "n_nationkey", written_off=[0, 1, 2]).select("s_suppkey")


@register("merge_sample", """
WITH s AS (SELECT CASE WHEN p_partkey = 0 THEN 'a' WHEN p_partkey % 2 = 1 THEN 'b' ELSE 'c' END AS status FROM part)
SELECT status, CAST(greatest(1, floor(count(*) * 20 / (SELECT count(*) FROM part))) AS BIGINT) AS n FROM s GROUP BY 1""")
def merge_sample(spark, sf):
    p = table(spark, sf, "part").withColumn("status", F.expr("CASE WHEN p_partkey = 0 THEN 'a' WHEN p_partkey % 2 = 1 THEN 'b' ELSE 'c' END"))
    return matching.preview_sample(p, "status", "p_partkey", 20).groupBy("status").agg(F.count("*").alias("n"))


@register("suggest_pair", "SELECT 'n_nationkey' AS left_column, 's_nationkey' AS right_column")
def suggest_pair(spark, sf):
    scores = matching.pair_scores(table(spark, sf, "nation").select("n_name", "n_nationkey"), table(spark, sf, "supplier").select("s_name", "s_nationkey"))
    best, _ = matching.suggest_pair([r.asDict() for r in scores.collect()])
    return spark.createDataFrame([(best["left_column"], best["right_column"])], "left_column string, right_column string")


@register("compare_whole_sides", """
WITH r AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN lower(p_name) ELSE 'annan ' || lower(p_name) END AS k, count(*) AS n FROM part GROUP BY 1)
SELECT p_partkey, CASE WHEN n IS NULL THEN 'saknas' WHEN n > 1 THEN 'lika (' || CAST(n AS VARCHAR) || ')' ELSE 'lika' END AS outcome, coalesce(n, 0) AS n FROM part LEFT JOIN r ON lower(p_name) = k""")
def compare_whole_sides(spark, sf):
    p = table(spark, sf, "part")
    other = p.withColumn("p_name", F.expr("if(p_partkey % 2 = 0, upper(p_name), concat('annan ', p_name))"))
    return comparing.compare_anywhere(p, other, "p_name", "p_name", counts=True).select("p_partkey", "outcome", "n")


# Rows and columns


@register("rows_edited", "SELECT n_nationkey, CASE WHEN n_nationkey IN (4, 5) THEN 'ny' ELSE n_name END AS n_name FROM nation WHERE n_nationkey NOT IN (1, 2)")
def rows_edited(spark, sf):
    return rows.set_cells(rows.delete_rows(table(spark, sf, "nation"), "n_nationkey", [1, 2]), "n_nationkey", [4, 5], "n_name", "ny").select("n_nationkey", "n_name")


@register("columns_moved", "SELECT n_regionkey, n_nationkey FROM nation")
def columns_moved(spark, sf):
    return rows.visible(rows.hide_column(rows.move_column(table(spark, sf, "nation"), "n_regionkey", 0), "n_name"))


@register("stack_merged_targets", 'SELECT c_name AS "Namn", c_mktsegment AS "Summa" FROM customer UNION ALL SELECT s_name, CAST(s_nationkey AS VARCHAR) FROM supplier')
def stack_merged_targets(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_name").alias("Namn"), F.col("c_mktsegment").alias("Grupp"))
    s = table(spark, sf, "supplier").select(F.col("s_name").alias("Name"), F.col("s_nationkey").cast("string").alias("Summa"))
    targets = {t.name: t for t in stacking.targets_from_sources([c.columns, s.columns])}
    keep, _ = stacking.merge_targets(targets["Summa"], targets["Grupp"])
    keep.included = targets["Namn"].included = True
    return stacking.stack([c, s], [targets["Namn"], keep])
