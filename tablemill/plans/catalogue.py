"""The registered queries over the driver's tables, each with its DuckDB oracle.

The tables hold no empty or noisy cells, so queries make them by rule from keys, and the oracles
make the same ones. Row order is shown as a rank column, sums are rounded alike on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemill.functions import dates, email, infer, numbers, phone, text
from tablemill.functions.order import rank_struct
from tablemill.operators import columns, comparing, duplicates, filters, fuzzy, groups, matching, pivoting, profiling, rows, sorting, stacking
from tablemill.operators.filters import Filter, Rule
from tablemill.operators.groups import Measure
from tablemill.operators.matching import Pair
from tablemill.operators.sorting import Level
from tablemill.plans.pipeline import Pipeline

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return keep


def two(c: str):
    return F.round(c, 2).alias(c)


# Groups

MEASURED = """
SELECT o_orderstatus, count(*) AS n, count(o_totalprice) AS filled, count(DISTINCT o_custkey) AS customers, round(sum(o_totalprice), 2) AS total,
       round(avg(o_totalprice), 2) AS mean, min(o_totalprice) AS least, max(o_totalprice) AS most
FROM orders GROUP BY 1"""


@register("group_measures", MEASURED)
def group_measures(spark, sf):
    m = [Measure("count", alias="n"), Measure("filled", "o_totalprice", "filled"), Measure("distinct", "o_custkey", "customers"), Measure("sum", "o_totalprice", "total"),
         Measure("mean", "o_totalprice", "mean"), Measure("min", "o_totalprice", "least"), Measure("max", "o_totalprice", "most")]
    out = groups.group(table(spark, sf, "orders"), ["o_orderstatus"], m, "o_orderkey")
    return out.select("o_orderstatus", "n", "filled", "customers", two("total"), two("mean"), "least", "most")


@register("group_first_last", "SELECT o_orderstatus, arg_min(o_orderpriority, o_orderkey) AS first_priority, arg_max(o_orderpriority, o_orderkey) AS last_priority FROM orders GROUP BY 1")
def group_first_last(spark, sf):
    m = [Measure("first", "o_orderpriority", "first_priority"), Measure("last", "o_orderpriority", "last_priority")]
    return groups.group(table(spark, sf, "orders"), ["o_orderstatus"], m, "o_orderkey").drop("first_row")


@register("group_list_capped", """
WITH d AS (SELECT o_orderstatus AS s, CAST(o_custkey AS VARCHAR) AS v, min(o_orderkey) AS p FROM orders GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY p, v) AS k, count(*) OVER (PARTITION BY s) AS n FROM d)
SELECT s AS o_orderstatus, string_agg(v, ', ' ORDER BY k) FILTER (WHERE k <= 50) || CASE WHEN max(n) > 50 THEN ' … (+' || CAST(max(n) - 50 AS VARCHAR) || ' till)' ELSE '' END AS customers
FROM r GROUP BY 1""")
def group_list_capped(spark, sf):
    return groups.group(table(spark, sf, "orders"), ["o_orderstatus"], [Measure("list", "o_custkey", "customers")], "o_orderkey").drop("first_row")


NOISY = "CASE WHEN doc_id % 5 = 0 THEN '  ' || upper(source) WHEN doc_id % 11 = 0 THEN '' ELSE source || ' ' END"


def noisy_source(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source")
    return d.select("doc_id", F.expr("CASE WHEN doc_id % 5 = 0 THEN concat('  ', upper(source)) WHEN doc_id % 11 = 0 THEN '' ELSE concat(source, ' ') END").alias("src"))


@register("group_normalised_key", f"WITH d AS (SELECT doc_id, {NOISY} AS src FROM documents) SELECT arg_min(src, doc_id) AS src, count(*) AS n, min(doc_id) AS first_row FROM d WHERE trim(src) <> '' GROUP BY lower(trim(src))")
def group_normalised_key(spark, sf):
    return groups.group(noisy_source(spark, sf), ["src"], [Measure("count", alias="n")], "doc_id")


@register("group_keep_empty", f"WITH d AS (SELECT doc_id, {NOISY} AS src FROM documents) SELECT arg_min(src, doc_id) AS src, count(*) AS n FROM d GROUP BY lower(trim(src))")
def group_keep_empty(spark, sf):
    return groups.group(noisy_source(spark, sf), ["src"], [Measure("count", alias="n")], "doc_id", empties=True).drop("first_row")


@register("group_left_out", f"WITH d AS (SELECT {NOISY} AS src FROM documents) SELECT count(*) AS n_left_out FROM d WHERE trim(src) = ''")
def group_left_out(spark, sf):
    return groups.left_out(noisy_source(spark, sf), ["src"])


@register("group_readability", "SELECT 'o_orderpriority' AS column_name, CAST(0 AS BIGINT) AS readable, count(*) AS filled FROM orders UNION ALL SELECT 'o_custkey', count(*), count(*) FROM orders")
def group_readability(spark, sf):
    return groups.readability(table(spark, sf, "orders"), ["o_orderpriority", "o_custkey"])


@register("lineitem_group_bench", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity, round(avg(l_extendedprice), 2) AS price, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1, 2")
def lineitem_group_bench(spark, sf):
    m = [Measure("count", alias="n"), Measure("sum", "l_quantity", "quantity"), Measure("mean", "l_extendedprice", "price"), Measure("distinct", "l_partkey", "parts")]
    out = groups.group(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], m, "l_orderkey")
    return out.select("l_returnflag", "l_linestatus", "n", two("quantity"), two("price"), "parts")


# Duplicates

BY_TEXT = "lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))"


@register("dedup_groups", "WITH k AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY 1, 2 HAVING count(*) > 1) SELECT e.event_id, k.n AS group_size, k.f AS first_row FROM events e JOIN k USING (user_id, event_type)")
def dedup_groups(spark, sf):
    return duplicates.duplicate_groups(table(spark, sf, "events"), "event_id", ["user_id", "event_type"]).select("event_id", "group_size", "first_row")


@register("dedup_stats", "WITH k AS (SELECT count(*) AS n FROM events GROUP BY user_id, event_type HAVING count(*) > 1) SELECT count(*) AS groups, CAST(sum(n) AS BIGINT) AS rows, CAST(sum(n - 1) AS BIGINT) AS surplus, max(n) AS largest FROM k")
def dedup_stats(spark, sf):
    return duplicates.duplicate_stats(table(spark, sf, "events"), ["user_id", "event_type"])


@register("dedup_keep_first", "SELECT min(event_id) AS event_id FROM events GROUP BY user_id, event_type")
def dedup_keep_first(spark, sf):
    return duplicates.remove_surplus(table(spark, sf, "events"), "event_id", ["user_id", "event_type"]).select("event_id")


@register("dedup_keep_last", "SELECT max(event_id) AS event_id FROM events GROUP BY user_id, event_type")
def dedup_keep_last(spark, sf):
    return duplicates.remove_surplus(table(spark, sf, "events"), "event_id", ["user_id", "event_type"], "last").select("event_id")


@register("dedup_identical_flag", "WITH d AS (SELECT nation.*, n_nationkey % 10 AS k FROM nation), r AS (SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1) SELECT n_nationkey, n AS group_size, false AS identical FROM nation JOIN r USING (n_regionkey)")
def dedup_identical_flag(spark, sf):
    return duplicates.duplicate_groups(table(spark, sf, "nation"), "n_nationkey", ["n_regionkey"]).select("n_nationkey", "group_size", "identical")


@register("dedup_view_order", "WITH k AS (SELECT n_regionkey, min(n_nationkey) AS f FROM nation GROUP BY 1), g AS (SELECT *, row_number() OVER (ORDER BY f) AS group_number FROM k) SELECT n_nationkey, group_number FROM nation JOIN g USING (n_regionkey)")
def dedup_view_order(spark, sf):
    return duplicates.group_order(table(spark, sf, "nation"), "n_nationkey", ["n_regionkey"]).select("n_nationkey", F.col("group_number").cast("long"))


@register("dedup_bench", f"SELECT min(doc_id) AS doc_id FROM documents GROUP BY {BY_TEXT}")
def dedup_bench(spark, sf):
    return duplicates.remove_surplus(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", ["text"]).select("doc_id")


# Filters and search

PART = "p_partkey"
FILTERS = {
    "is": ([Rule("p_brand", "is", "brand#11")], "lower(p_brand) = 'brand#11'"),
    "is_not": ([Rule("p_brand", "is_not", "Brand#11")], "lower(p_brand) <> 'brand#11'"),
    "contains": ([Rule("p_type", "contains", "STEEL")], "contains(lower(p_type), 'steel')"),
    "contains_not": ([Rule("p_type", "contains_not", "steel")], "NOT contains(lower(p_type), 'steel')"),
    "starts": ([Rule("p_name", "starts", "a", case=False)], "starts_with(lower(p_name), 'a')"),
    "ends": ([Rule("p_name", "ends", "e")], "ends_with(lower(p_name), 'e')"),
    "in_list": ([Rule("p_brand", "in_list", ["Brand#11", "BRAND#12", ""])], "lower(p_brand) IN ('brand#11', 'brand#12')"),
    "regex": ([Rule("p_name", "regex", "^[a-m].*[aeiou]$")], "regexp_matches(p_name, '(?i)^[a-m].*[aeiou]$')"),
    "empty": ([Rule("blank", "empty")], "p_partkey % 7 = 0"),
    "filled": ([Rule("blank", "filled")], "p_partkey % 7 <> 0"),
    "invalid": ([Rule("mixed", "invalid", kind="number")], "p_partkey % 3 = 0"),
    "longer": ([Rule("p_name", "longer", 9)], "length(trim(p_name)) > 9"),
    "shorter": ([Rule("p_name", "shorter", 9)], "length(trim(p_name)) < 9"),
    "more": ([Rule("p_size", "more", "25", kind="number")], "p_size > 25"),
    "at_least": ([Rule("p_size", "at_least", "25", kind="number")], "p_size >= 25"),
    "less": ([Rule("p_size", "less", "25", kind="number")], "p_size < 25"),
    "at_most": ([Rule("p_size", "at_most", "25", kind="number")], "p_size <= 25"),
    "between": ([Rule("p_size", "between", "30", "10", kind="number")], "p_size BETWEEN 10 AND 30"),
    "all": ([Rule("p_size", "more", "25", kind="number"), Rule("p_type", "contains", "steel")], "p_size > 25 AND contains(lower(p_type), 'steel')"),
}


def part_cells(spark, sf):
    p = table(spark, sf, "part")
    return p.withColumn("blank", F.expr("if(p_partkey % 7 = 0, '', 'x')")).withColumn("mixed", F.expr("if(p_partkey % 3 = 0, 'n/a', cast(p_size as string))"))


def _filter_query(spec: Filter):
    return lambda spark, sf: filters.apply_filter(part_cells(spark, sf), spec).select(PART)


for _name, (_rules, _where) in FILTERS.items():
    register(f"filter_{_name}", f"SELECT p_partkey FROM part WHERE {_where}")(_filter_query(Filter(_rules)))
_pair = [Rule("p_size", "more", "45", kind="number"), Rule("p_brand", "is", "Brand#11")]
register("filter_any", "SELECT p_partkey FROM part WHERE p_size > 45 OR lower(p_brand) = 'brand#11'")(_filter_query(Filter(_pair, any=True)))
register("filter_inverted", "SELECT p_partkey FROM part WHERE NOT (p_size > 45 OR lower(p_brand) = 'brand#11')")(_filter_query(Filter(_pair, any=True, inverted=True)))
register("filter_broken_rules", "SELECT p_partkey FROM part")(_filter_query(Filter([Rule("p_name", "regex", "["), Rule("", "is", "x")], inverted=True)))


@register("filter_date_between", "SELECT o_orderkey FROM orders WHERE strftime(o_orderdate, '%Y-%m-%d') BETWEEN '1995-01-01' AND '1996-06-30'")
def filter_date_between(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", "d/M/yyyy").alias("day"))
    return filters.apply_filter(o, Filter([Rule("day", "between", "1995-01-01", "1996-06-30", kind="date")])).select("o_orderkey")


@register("search_accent", "SELECT doc_id FROM documents WHERE contains(lower(strip_accents(text)), 'ete') OR contains(lower(source), 'ete')")
def search_accent(spark, sf):
    return filters.search(table(spark, sf, "documents").select("doc_id", "text", "source"), "ÉTÉ", ["text", "source"]).select("doc_id")


@register("search_hits", "SELECT 'lang' AS column_name, count(*) FILTER (WHERE contains(lower(lang), 'e')) AS hits FROM documents UNION ALL SELECT 'source', count(*) FILTER (WHERE contains(lower(source), 'e')) FROM documents")
def search_hits(spark, sf):
    return filters.search_hits(table(spark, sf, "documents").select("lang", "source"), "E")


@register("value_list", "SELECT p_brand AS value, count(*) AS n FROM part WHERE p_size > 10 GROUP BY 1 ORDER BY n DESC, value LIMIT 200")
def value_list(spark, sf):
    spec = Filter([Rule("p_size", "more", "10", kind="number"), Rule("p_brand", "is", "x")])
    return filters.value_list(table(spark, sf, "part"), "p_brand", spec)


@register("view_chain", "SELECT c_custkey FROM customer WHERE contains(lower(c_name), '1') AND lower(c_mktsegment) = 'building' AND c_acctbal > 0")
def view_chain(spark, sf):
    spec = Filter([Rule("c_mktsegment", "is", "building"), Rule("c_acctbal", "more", 0, kind="number")])
    c = table(spark, sf, "customer").withColumn("c_acctbal", F.col("c_acctbal").cast("decimal(12,2)").cast("string"))
    return filters.view(c.select("c_custkey", "c_name", "c_mktsegment", "c_acctbal"), "", spec).filter("contains(lower(c_name), '1')").select("c_custkey")


# Sorting


@register("sort_multi", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey) AS rank FROM orders")
def sort_multi(spark, sf):
    return sorting.ranked(table(spark, sf, "orders"), [Level("o_orderpriority"), Level("o_totalprice", False)], "o_orderkey").select("o_orderkey", "rank")


@register("sort_desc_empty_last", """
WITH d AS (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN '' WHEN p_partkey % 5 = 0 THEN 'junk' || CAST(p_size AS VARCHAR) ELSE CAST(p_size AS VARCHAR) END AS v FROM part)
SELECT p_partkey, row_number() OVER (ORDER BY v = '', NOT starts_with(v, 'junk'), CASE WHEN starts_with(v, 'junk') THEN CAST(substr(v, 5) AS INT) END DESC, try_cast(v AS INT) DESC, p_partkey) AS rank FROM d""")
def sort_desc_empty_last(spark, sf):
    d = table(spark, sf, "part").select("p_partkey", F.expr("CASE WHEN p_partkey % 7 = 0 THEN '' WHEN p_partkey % 5 = 0 THEN concat('junk', p_size) ELSE cast(p_size AS string) END").alias("v"))
    return sorting.ranked(d, [Level("v", False, "number")], "p_partkey").select("p_partkey", "rank")


@register("sort_custom_order", """
SELECT o_orderkey, row_number() OVER (ORDER BY CASE o_orderpriority WHEN '5-LOW' THEN 1 WHEN '1-URGENT' THEN 2 ELSE 3 END, CASE WHEN o_orderpriority IN ('5-LOW', '1-URGENT') THEN '' ELSE o_orderpriority END, o_orderkey) AS rank FROM orders""")
def sort_custom_order(spark, sf):
    return sorting.ranked(table(spark, sf, "orders"), [Level("o_orderpriority", custom=["5-LOW", "1-URGENT"])], "o_orderkey").select("o_orderkey", "rank")


@register("sort_natural", "SELECT c_custkey, row_number() OVER (ORDER BY c_custkey % 97, c_custkey) AS rank FROM customer")
def sort_natural(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("Kund "), (F.col("c_custkey") % 97).cast("string")).alias("v"))
    return sorting.ranked(c, [Level("v")], "c_custkey").select("c_custkey", "rank")


@register("top_k", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 10")
def top_k(spark, sf):
    levels = [Level("l_extendedprice", False), *map(Level, ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))]
    return sorting.top_k(table(spark, sf, "lineitem"), levels, 10).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


@register("top_k_per_group", "SELECT o_custkey, o_orderkey, CAST(place AS BIGINT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders) WHERE place <= 3")
def top_k_per_group(spark, sf):
    return sorting.top_k_per(table(spark, sf, "orders"), ["o_custkey"], [Level("o_totalprice", False)], 3, "o_orderkey").select("o_custkey", "o_orderkey", F.col("place").cast("long"))


# Profiling


@register("infer_types", "SELECT * FROM (VALUES ('o_orderkey', 'number'), ('o_orderstatus', 'text'), ('day', 'date'), ('flag', 'number'), ('padded', 'text'), ('nothing', 'empty')) t(column_name, type)")
def infer_types(spark, sf):
    o = table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("o_orderkey"), "o_orderstatus", F.date_format("o_orderdate", "yyyyMMdd").alias("day"), (F.col("o_orderkey") % 2).cast("string").alias("flag"),
        F.lpad(F.col("o_orderkey").cast("string"), 9, "0").alias("padded"), F.lit("").alias("nothing"), F.col("o_orderkey").alias("_row"),
    )
    return infer.type_shares(o, ["o_orderkey", "o_orderstatus", "day", "flag", "padded", "nothing"], "_row").select("column_name", "type")


@register("column_stats", """
SELECT 'blank' AS column_name, count(*) AS total, count(*) FILTER (WHERE p_partkey % 7 <> 0) AS filled, count(*) FILTER (WHERE p_partkey % 7 = 0) AS empty, CAST(0 AS BIGINT) AS invalid, CAST(1 AS BIGINT) AS "distinct" FROM part
UNION ALL SELECT 'mixed', count(*), count(*), 0, count(*) FILTER (WHERE p_partkey % 3 = 0), count(DISTINCT CASE WHEN p_partkey % 3 = 0 THEN 'n/a' ELSE CAST(p_size AS VARCHAR) END) FROM part""")
def column_stats(spark, sf):
    return profiling.column_statistics(part_cells(spark, sf), ["blank", "mixed"], {"mixed": "number"})


@register("top_values", "SELECT c_mktsegment AS value, count(*) AS n FROM customer GROUP BY 1 ORDER BY n DESC, value LIMIT 8")
def top_values(spark, sf):
    return profiling.top_values(table(spark, sf, "customer"), "c_mktsegment")


@register("content_profile", "SELECT * FROM (VALUES ('mail', 'email'), ('day', 'date'), ('sum', 'number'), ('tel', 'phone'), ('c_mktsegment', NULL)) t(column_name, tool)")
def content_profile(spark, sf):
    c = table(spark, sf, "customer").select(
        F.expr("concat('a', c_custkey, '@x.se')").alias("mail"), F.lit("2024-05-17").alias("day"), F.expr("concat(c_custkey, ',50 kr')").alias("sum"), F.expr("concat('070-', lpad(c_custkey, 7, '1'))").alias("tel"), "c_mktsegment",
    )
    return profiling.content_profile(c, ["mail", "day", "sum", "tel", "c_mktsegment"]).select("column_name", "tool")


@register("selection_aggregate", "SELECT 2 * count(*) AS cells, 2 * count(*) AS filled, (SELECT count(DISTINCT v) FROM (SELECT CAST(p_size AS VARCHAR) AS v FROM part UNION ALL SELECT p_brand FROM part)) AS \"distinct\", count(*) AS numbers, CAST(sum(p_size) AS DOUBLE) AS total, round(avg(p_size), 6) AS mean FROM part")
def selection_aggregate(spark, sf):
    return profiling.selection_aggregate(table(spark, sf, "part"), ["p_size", "p_brand"]).withColumn("mean", F.round("mean", 6))


# Matching


def customers_and_orders(spark, sf):
    c = table(spark, sf, "customer").withColumn("kundnr", F.expr("if(c_custkey % 10 = 0, '', concat(' Kund-', c_custkey, ' '))"))
    o = table(spark, sf, "orders").filter("o_custkey % 7 <> 0").withColumn("customer", F.expr("if(o_orderkey % 13 = 0, '', upper(concat('kund-', o_custkey)))"))
    return c, o


LEFT = "(SELECT *, CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_custkey END AS k FROM customer)"
RIGHT = "(SELECT *, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_custkey END AS k FROM orders WHERE o_custkey % 7 <> 0)"
KEY = [Pair("kundnr", "customer", "loose")]


@register("match_pairs", f"SELECT l.c_custkey AS _l, r.o_orderkey AS _r FROM {LEFT} l JOIN {RIGHT} r USING (k)")
def match_pairs(spark, sf):
    return matching.match(*customers_and_orders(spark, sf), KEY, "c_custkey", "o_orderkey")


@register("match_stats", f"""
WITH l AS {LEFT}, r AS {RIGHT}, lc AS (SELECT k, count(*) AS n FROM l WHERE k IS NOT NULL GROUP BY 1), rc AS (SELECT k, count(*) AS n FROM r WHERE k IS NOT NULL GROUP BY 1), b AS (SELECT lc.n AS a, rc.n AS b FROM lc JOIN rc USING (k))
SELECT CAST(sum(a * b) AS BIGINT) AS n_pairs, CAST(sum(a) AS BIGINT) AS matched_left, CAST(sum(b) AS BIGINT) AS matched_right, CAST((SELECT count(*) FROM l) - sum(a) AS BIGINT) AS unmatched_left, CAST((SELECT count(*) FROM r) - sum(b) AS BIGINT) AS unmatched_right,
 CAST(sum(a) FILTER (WHERE b > 1) AS BIGINT) AS several_left, CAST(coalesce(sum(b) FILTER (WHERE a > 1), 0) AS BIGINT) AS several_right, (SELECT count(*) FROM l WHERE k IS NULL) AS empty_left, (SELECT count(*) FROM r WHERE k IS NULL) AS empty_right, max(b) AS largest_fan_out FROM b""")
def match_stats(spark, sf):
    return matching.match_stats(*customers_and_orders(spark, sf), KEY, "c_custkey", "o_orderkey")


def _merged(several: str, both: bool = False):
    def run(spark, sf):
        out = matching.merge(*customers_and_orders(spark, sf), KEY, "c_custkey", "o_orderkey", ["o_orderkey"], several, both, status="status")
        return out.select("c_custkey", "o_orderkey", "status")

    return run


STATUS = "CASE WHEN n IS NULL THEN 'ingen träff' WHEN n > 1 THEN 'flera träffar' ELSE 'träff' END AS status"
COUNTS = f"WITH l AS {LEFT}, r AS {RIGHT}, c AS (SELECT k, count(*) AS n, min(o_orderkey) AS first FROM r WHERE k IS NOT NULL GROUP BY 1)"
FIRST = f"{COUNTS} SELECT c_custkey, first AS o_orderkey, {STATUS} FROM l LEFT JOIN c USING (k)"
register("merge_first", FIRST)(_merged("first"))
register("merge_duplicate", f"{COUNTS} SELECT c_custkey, o_orderkey, {STATUS} FROM l LEFT JOIN c USING (k) LEFT JOIN r USING (k)")(_merged("duplicate"))
register("merge_leave", f"{COUNTS} SELECT c_custkey, CASE WHEN n = 1 THEN first END AS o_orderkey, {STATUS} FROM l LEFT JOIN c USING (k)")(_merged("leave"))
register("merge_both", f"{FIRST} UNION ALL SELECT NULL, o_orderkey, 'bara i den andra filen' FROM r WHERE k IS NULL OR k NOT IN (SELECT k FROM l WHERE k IS NOT NULL)")(_merged("first", True))
register("merge_bench", FIRST)(_merged("first"))


@register("rest_left", f"SELECT c_custkey FROM {LEFT} l WHERE k IS NULL OR k NOT IN (SELECT k FROM {RIGHT} r WHERE k IS NOT NULL)")
def rest_left(spark, sf):
    return matching.rest(*customers_and_orders(spark, sf), KEY, "c_custkey", "o_orderkey").select("c_custkey")


@register("rest_right", f"SELECT o_orderkey FROM {RIGHT} r WHERE k IS NULL OR k NOT IN (SELECT k FROM {LEFT} l WHERE k IS NOT NULL)")
def rest_right(spark, sf):
    c, o = customers_and_orders(spark, sf)
    return matching.rest(o, c, KEY, "o_orderkey", "c_custkey", 1).select("o_orderkey")


@register("rest_ambiguous", f"SELECT c_custkey FROM {LEFT} l WHERE k IN (SELECT k FROM {RIGHT} r GROUP BY k HAVING count(*) > 1)")
def rest_ambiguous(spark, sf):
    return matching.ambiguous(*customers_and_orders(spark, sf), KEY, "c_custkey", "o_orderkey").select("c_custkey")


@register("match_composite", "SELECT a.n_nationkey AS _l, b.n_nationkey AS _r FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND lower(a.n_name) = lower(b.n_name)")
def match_composite(spark, sf):
    n = table(spark, sf, "nation")
    return matching.match(n, n.withColumn("n_name", F.lower("n_name")), [Pair("n_name", "n_name", "loose"), Pair("n_regionkey", "n_regionkey", "digits")], "n_nationkey", "n_nationkey")


@register("pair_scores", """
WITH a AS (SELECT 'n_name' AS left_column, lower(n_name) AS k FROM nation UNION ALL SELECT 'n_regionkey', CAST(n_regionkey AS VARCHAR) FROM nation), b AS (SELECT 's_name' AS right_column, lower(s_name) AS k FROM supplier UNION ALL SELECT 's_nationkey', CAST(s_nationkey AS VARCHAR) FROM supplier),
x AS (SELECT left_column, k, count(*) AS n FROM a GROUP BY 1, 2), y AS (SELECT right_column, k, count(*) AS m FROM b GROUP BY 1, 2)
SELECT left_column, right_column, CAST(sum(n) AS BIGINT) AS hits, CAST(coalesce(sum(n) FILTER (WHERE m > 1), 0) AS BIGINT) AS several, round(sum(n / m), 6) AS score FROM x JOIN y USING (k) GROUP BY 1, 2""")
def pair_scores(spark, sf):
    out = matching.pair_scores(table(spark, sf, "nation").select("n_name", "n_regionkey"), table(spark, sf, "supplier").select("s_name", "s_nationkey"), ("loose",))
    return out.select("left_column", "right_column", "hits", "several", F.round("score", 6).alias("score"))


@register("compare_rowwise", "SELECT p_partkey AS place, CASE WHEN p_partkey % 7 = 0 THEN 'saknas' WHEN p_partkey % 5 = 0 THEN 'skiljer sig' ELSE 'lika' END AS outcome_1 FROM part")
def compare_rowwise(spark, sf):
    p = table(spark, sf, "part")
    return comparing.compare_rows(p, p.withColumn("other", F.expr("CASE WHEN p_partkey % 7 = 0 THEN '' WHEN p_partkey % 5 = 0 THEN concat(p_name, '!') ELSE concat(' ', upper(p_name)) END")), [("p_name", "other")], "p_partkey", "p_partkey")


@register("compare_anywhere", """
WITH r AS (SELECT lower(p_name) AS k, count(*) AS n FROM part WHERE p_partkey % 2 = 0 GROUP BY 1)
SELECT p_partkey, CASE WHEN n IS NULL THEN 'saknas' WHEN n > 1 THEN 'lika (' || CAST(n AS VARCHAR) || ')' ELSE 'lika' END AS outcome, coalesce(n, 0) AS n FROM part LEFT JOIN r ON lower(p_name) = k""")
def compare_anywhere(spark, sf):
    p = table(spark, sf, "part")
    return comparing.compare_anywhere(p, p.filter("p_partkey % 2 = 0"), "p_name", "p_name", counts=True).select("p_partkey", "outcome", "n")


@register("record_diff", "SELECT p_partkey, 'p_size' AS field, CAST(p_size AS VARCHAR) AS left_value, CAST(p_size + p_partkey % 2 AS VARCHAR) AS right_value, CASE WHEN p_partkey % 2 = 0 THEN 'lika' ELSE 'skiljer sig' END AS outcome FROM part")
def record_diff(spark, sf):
    p = table(spark, sf, "part")
    return comparing.record_diff(p, p.withColumn("p_size", (F.col("p_size") + F.col("p_partkey") % 2)), "p_partkey", ["p_size"])


@register("frames_identical", "SELECT true AS identical")
def frames_identical(spark, sf):
    n = table(spark, sf, "nation")
    return comparing.frames_identical(n, n.repartition(3))


#: Trigrams and words of both sides, candidates over grams that aren't too frequent, the better of two Dice scores, three a value.
FUZZY = """
WITH a AS (SELECT trim(lower(v)) AS k, min(v) AS v FROM ({left}) WHERE length(trim(lower(v))) >= 4 GROUP BY 1), b AS (SELECT trim(lower(v)) AS k, min(v) AS v FROM ({right}) WHERE length(trim(lower(v))) >= 4 GROUP BY 1),
ta AS (SELECT k, v, list_distinct(list_transform(range(1, length(k) + 2), lambda i: substr('  ' || k || ' ', i, 3))) AS t, list_distinct(list_filter(string_split_regex(k, '\\s+'), lambda w: w <> '')) AS w FROM a),
tb AS (SELECT k, v, list_distinct(list_transform(range(1, length(k) + 2), lambda i: substr('  ' || k || ' ', i, 3))) AS t, list_distinct(list_filter(string_split_regex(k, '\\s+'), lambda w: w <> '')) AS w FROM b),
grams AS (SELECT k, unnest(t) AS g FROM tb), spread AS (SELECT g, count(*) AS n, (SELECT count(*) FROM b) AS size FROM grams GROUP BY 1),
asked AS (SELECT k, g, n, size >= 20 AND n > 0.1 * size AS stop, bool_or(NOT (size >= 20 AND n > 0.1 * size)) OVER (PARTITION BY k) AS rare, min(n) OVER (PARTITION BY k) AS rarest FROM (SELECT k, unnest(t) AS g FROM ta) JOIN spread USING (g)),
met AS (SELECT DISTINCT asked.k AS lk, grams.k AS rk FROM asked JOIN grams USING (g) WHERE NOT stop OR (NOT rare AND n = rarest)),
scored AS (SELECT lk, rk, ta.v AS left_value, tb.v AS right_value, greatest(2.0 * len(list_intersect(ta.t, tb.t)) / (len(ta.t) + len(tb.t)), 0.95 * (2.0 * len(list_intersect(ta.w, tb.w)) / (len(ta.w) + len(tb.w)))) AS score FROM met JOIN ta ON lk = ta.k JOIN tb ON rk = tb.k),
placed AS (SELECT *, row_number() OVER (PARTITION BY lk ORDER BY score DESC, rk) AS place, row_number() OVER (PARTITION BY rk ORDER BY score DESC, lk) AS back FROM scored WHERE score >= 0.65)
SELECT left_value, right_value, round(score, 6) AS score, CAST(place AS INT) AS place, place = 1 AND back = 1 AS mutual FROM placed WHERE place <= 3"""


@register("fuzzy_pairs", FUZZY.format(left="SELECT substr(s_name, 1, 3) || 'x' || substr(s_name, 4) AS v FROM supplier", right="SELECT s_name AS v FROM supplier"))
def fuzzy_pairs(spark, sf):
    s = table(spark, sf, "supplier")
    typo = s.select(F.expr("concat(substring(s_name, 1, 3), 'x', substring(s_name, 4, 100))").alias("name"))
    return fuzzy.suggest(typo, s, "name", "s_name").withColumn("score", F.round("score", 6))


@register("fuzzy_bench", FUZZY.format(left="SELECT reverse(p_name) AS v FROM part UNION ALL SELECT p_name || 's' FROM part", right="SELECT p_name AS v FROM part"))
def fuzzy_bench(spark, sf):
    p = table(spark, sf, "part").select("p_name").distinct()
    return fuzzy.suggest(p.select(F.reverse("p_name").alias("name")).union(p.select(F.expr("concat(p_name, 's')").alias("name"))), p, "name", "p_name").withColumn("score", F.round("score", 6))


# Stacking


def stacked(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_name").alias("Namn"), F.col("c_nationkey").alias("Land"))
    s = table(spark, sf, "supplier").select(F.col("s_name").alias("Name"), F.col("s_suppkey").alias("Nummer"))
    return [c, s]


@register("stack_alias", "SELECT c_name AS Namn FROM customer UNION ALL SELECT s_name FROM supplier")
def stack_alias(spark, sf):
    frames = stacked(spark, sf)
    return stacking.stack(frames, stacking.targets_from_sources([f.columns for f in frames]))


@register("stack_default", "SELECT c_name AS Namn, CAST(c_nationkey AS VARCHAR) AS Land FROM customer UNION ALL SELECT s_name, 'okänt' FROM supplier")
def stack_default(spark, sf):
    frames = stacked(spark, sf)
    targets = stacking.targets_from_sources([f.columns for f in frames])
    for t in targets:
        if t.name == "Land":
            t.included, t.default = True, "okänt"
    return stacking.stack(frames, targets)


@register("stack_source_col", "SELECT c_name AS Namn, CAST(c_nationkey AS VARCHAR) AS Land, 'fil' AS \"Källa\" FROM customer UNION ALL SELECT s_name, '', 'fil (2)' FROM supplier")
def stack_source_col(spark, sf):
    frames = stacked(spark, sf)
    return stacking.stack(frames, stacking.targets_from_template(["Namn", "Land"], [f.columns for f in frames]), ["fil", "fil"])


@register("stack_report", "SELECT 'a' AS source, (SELECT count(*) FROM customer) AS rows, '' AS unfilled UNION ALL SELECT 'b', (SELECT count(*) FROM supplier), 'Land'")
def stack_report(spark, sf):
    frames = stacked(spark, sf)
    return stacking.stack_report(frames, stacking.targets_from_template(["Namn", "Land"], [f.columns for f in frames]), ["a", "b"])


# Pivots

YEAR = "CAST(year(o_orderdate) AS VARCHAR)"


def dated_orders(spark, sf):
    return table(spark, sf, "orders").withColumn("y", F.year("o_orderdate").cast("string"))


CROSS = pivoting.Plan(["o_orderstatus"], ["o_orderpriority"], [Measure("count", alias="n"), Measure("sum", "o_totalprice", "total"), Measure("distinct", "o_custkey", "customers")])
SETS = pivoting.Plan(["o_orderstatus", "o_orderpriority"], ["y"], [Measure("count", alias="n"), Measure("mean", "o_totalprice", "mean")])


@register("pivot_cross", """
SELECT o_orderstatus AS row_1, o_orderpriority AS col_1, CASE WHEN grouping(o_orderstatus) = 0 THEN 1 ELSE 0 END AS row_level, grouping(o_orderpriority) = 1 AS total_column, count(*) AS n, round(sum(o_totalprice), 2) AS total, count(DISTINCT o_custkey) AS customers
FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), (o_orderpriority), ())""")
def pivot_cross(spark, sf):
    return pivoting.pivot(table(spark, sf, "orders"), CROSS, "o_orderkey").select("row_1", "col_1", "row_level", "total_column", "n", two("total"), "customers")


@register("pivot_subtotals", f"""
WITH o AS (SELECT *, {YEAR} AS y FROM orders)
SELECT o_orderstatus AS row_1, o_orderpriority AS row_2, y AS col_1, 2 - grouping(o_orderstatus) - grouping(o_orderpriority) AS row_level, grouping(y) = 1 AS total_column, count(*) AS n, round(avg(o_totalprice), 2) AS mean
FROM o GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority, y), (o_orderstatus, o_orderpriority), (o_orderstatus, y), (o_orderstatus), (y), ())""")
def pivot_subtotals(spark, sf):
    return pivoting.pivot(dated_orders(spark, sf), SETS, "o_orderkey").select("row_1", "row_2", "col_1", "row_level", "total_column", "n", two("mean"))


@register("pivot_others", """
WITH c AS (SELECT s_nationkey AS k, count(*) AS n, min(s_suppkey) AS p FROM supplier GROUP BY 1 ORDER BY n DESC, p LIMIT 5), b AS (SELECT coalesce(CAST(c.k AS VARCHAR), 'Övriga') AS r FROM supplier LEFT JOIN c ON s_nationkey = c.k)
SELECT r AS row_1, CASE WHEN grouping(r) = 0 THEN 1 ELSE 0 END AS row_level, count(*) AS n FROM b GROUP BY GROUPING SETS ((r), ())""")
def pivot_others(spark, sf):
    return pivoting.pivot(table(spark, sf, "supplier"), pivoting.Plan(["s_nationkey"], measures=[Measure("count", alias="n")], row_values=5), "s_suppkey").select("row_1", "row_level", "n")


def _share(of: str):
    def run(spark, sf):
        long = pivoting.pivot(table(spark, sf, "orders"), pivoting.Plan(["o_orderstatus"], ["o_orderpriority"], [Measure("count", alias="n")]), "o_orderkey")
        return pivoting.shares(long, CROSS, "n", of).select("row_1", "col_1", "n", F.round("share", 9).alias("share"))

    return run


SHARE = "SELECT o_orderstatus AS row_1, o_orderpriority AS col_1, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY {}), 9) AS share FROM orders GROUP BY 1, 2"
register("pivot_share_row", SHARE.format("o_orderstatus"))(_share("row"))
register("pivot_share_col", SHARE.format("o_orderpriority"))(_share("column"))


@register("pivot_drill", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '2-HIGH'")
def pivot_drill(spark, sf):
    return pivoting.drill_through(table(spark, sf, "orders"), CROSS, "o_orderkey", {"row_1": "F", "col_1": "2-HIGH"}).select("o_orderkey")


@register("pivot_table", """SELECT o_orderstatus, nullif(count(*) FILTER (WHERE o_orderpriority = '1-URGENT'), 0) AS "1-URGENT", nullif(count(*) FILTER (WHERE o_orderpriority = '2-HIGH'), 0) AS "2-HIGH", nullif(count(*) FILTER (WHERE o_orderpriority = '3-MEDIUM'), 0) AS "3-MEDIUM",
nullif(count(*) FILTER (WHERE o_orderpriority = '4-NOT SPECIFIED'), 0) AS "4-NOT SPECIFIED", nullif(count(*) FILTER (WHERE o_orderpriority = '5-LOW'), 0) AS "5-LOW", count(*) AS "Totalt" FROM orders GROUP BY 1""")
def pivot_table(spark, sf):
    return pivoting.pivot_table(table(spark, sf, "orders"), pivoting.Plan(["o_orderstatus"], ["o_orderpriority"], [Measure("count", alias="n")]), "o_orderkey")


@register("pivot_sort", "SELECT o_orderpriority AS row_1, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, o_orderpriority) AS place FROM orders GROUP BY 1")
def pivot_sort(spark, sf):
    plan = pivoting.Plan(["o_orderpriority"], measures=[Measure("count", alias="n")])
    return pivoting.sorted_pivot(pivoting.pivot(table(spark, sf, "orders"), plan, "o_orderkey"), plan, "n").select("row_1", "n", F.col("place").cast("long"))


@register("chart_data", f"SELECT o_orderstatus AS category, {YEAR} AS series, CAST(count(*) AS DOUBLE) AS value FROM orders GROUP BY 1, 2")
def chart_data(spark, sf):
    plan = pivoting.Plan(["o_orderstatus"], ["y"], [Measure("count", alias="n")])
    return pivoting.chart_data(pivoting.pivot(dated_orders(spark, sf), plan, "o_orderkey"), plan, "n")


@register("pivot_left_out", "SELECT count(*) AS n_left_out FROM part WHERE p_partkey % 7 = 0")
def pivot_left_out(spark, sf):
    return pivoting.left_out(part_cells(spark, sf), pivoting.Plan(["p_brand"], ["blank"]), "p_partkey")


@register("lineitem_pivot_bench", """
SELECT l_returnflag AS row_1, l_linestatus AS col_1, CASE WHEN grouping(l_returnflag) = 0 THEN 1 ELSE 0 END AS row_level, grouping(l_linestatus) = 1 AS total_column, count(*) AS n, round(sum(l_extendedprice), 2) AS total
FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), (l_linestatus), ())""")
def lineitem_pivot_bench(spark, sf):
    plan = pivoting.Plan(["l_returnflag"], ["l_linestatus"], [Measure("count", alias="n"), Measure("sum", "l_extendedprice", "total")])
    return pivoting.pivot(table(spark, sf, "lineitem"), plan, "l_orderkey").select("row_1", "col_1", "row_level", "total_column", "n", two("total"))


# Cells

CLEANED = {
    "trim": ("concat('  ', c_name, ' ')", "c_name"), "collapse": ("concat(c_name, '   x')", "c_name || ' x'"), "upper": ("c_name", "upper(c_name)"), "lower": ("c_name", "lower(c_name)"),
    "title": ("concat(c_mktsegment, '-och ', lower(c_mktsegment))", "upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) || '-Och ' || upper(c_mktsegment[1]) || lower(c_mktsegment[2:])"),
    "invisible": ("concat(c_name, '\\u200b\\u00a0x')", "c_name || ' x'"),
}


def _clean(name: str, made: str):
    return lambda spark, sf: table(spark, sf, "customer").select("c_custkey", F.expr(made).alias("v")).select("c_custkey", text.CLEANERS[name]("v").alias("v"))


for _name, (_made, _want) in CLEANED.items():
    register(f"clean_{_name}", f"SELECT c_custkey, {_want} AS v FROM customer")(_clean(_name, _made))

MIXED_DATE = """CASE o_orderkey % 5 WHEN 0 THEN date_format(o_orderdate, 'yyyy-MM-dd') WHEN 1 THEN date_format(o_orderdate, 'd/M/yyyy') WHEN 2 THEN date_format(o_orderdate, 'yyyyMMdd') WHEN 3 THEN date_format(o_orderdate, 'yyyy-MM-dd HH:mm') ELSE 'nej' END"""


def mixed_dates(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.expr(MIXED_DATE).alias("v"))


@register("date_parse", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 4 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day, CASE WHEN o_orderkey % 5 < 4 THEN datediff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) END AS number FROM orders")
def date_parse(spark, sf):
    d = mixed_dates(spark, sf).withColumn("d", dates.parse_date("v")["date"])
    return d.select("o_orderkey", dates.write_date(F.col("d")).alias("day"), dates.day_number(F.col("d")).alias("number"))


@register("date_format", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN 'OGILTIGT' ELSE strftime(o_orderdate, '%Y-%m') END AS v FROM orders")
def date_format(spark, sf):
    return mixed_dates(spark, sf).select("o_orderkey", dates.rewrite_date("v", "month", on_error="mark").alias("v"))


@register("date_inventory", """
SELECT CASE o_orderkey % 5 WHEN 0 THEN 'iso' WHEN 1 THEN 'numeric' WHEN 2 THEN 'compact' WHEN 3 THEN 'iso_time' ELSE 'unknown' END AS format, count(*) AS cells,
count(*) FILTER (WHERE o_orderkey % 5 = 1 AND day(o_orderdate) <= 12) AS ambiguous FROM orders GROUP BY 1""")
def date_inventory(spark, sf):
    return profiling.date_inventory(mixed_dates(spark, sf), "v").select("format", "cells", "ambiguous")


@register("excel_serial", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS v FROM orders")
def excel_serial(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.datediff("o_orderdate", F.lit("1899-12-30").cast("date")).cast("string").alias("v"))
    return o.select("o_orderkey", dates.rewrite_date("v", serial=True).alias("v"))


CENTS = "CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR)"


def mixed_numbers(spark, sf):
    o = table(spark, sf, "orders").withColumn("cents", F.round(F.col("o_totalprice") * 100).cast("long"))
    return o.select("o_orderkey", "cents", F.expr("""CASE o_orderkey % 4 WHEN 0 THEN concat(cents div 100, ',', lpad(cents % 100, 2, '0'), ' kr') WHEN 1 THEN concat('(', cents div 100, '.', lpad(cents % 100, 2, '0'), ')')
        WHEN 2 THEN concat(format_number(cents div 100, 0), '.', lpad(cents % 100, 2, '0')) ELSE 'okänt' END""").alias("v"))


@register("number_parse", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 3 THEN NULL WHEN 1 THEN -round(round(o_totalprice * 100) / 100, 2) ELSE round(round(o_totalprice * 100) / 100, 2) END AS value, CASE o_orderkey % 4 WHEN 0 THEN 'kr' WHEN 3 THEN 'okänt' ELSE '' END AS unit FROM orders")
def number_parse(spark, sf):
    return mixed_numbers(spark, sf).withColumn("p", numbers.parse_lenient("v")).select("o_orderkey", F.round("p.value", 2).alias("value"), "p.unit")


@register("number_format", "SELECT p_partkey, replace(CAST(p_size / 4 AS VARCHAR), '.0', '') AS v FROM part WHERE p_size % 4 = 0 UNION ALL SELECT p_partkey, replace(CAST(p_size / 4 AS VARCHAR), '.', ',') FROM part WHERE p_size % 4 <> 0")
def number_format(spark, sf):
    return table(spark, sf, "part").select("p_partkey", numbers.write_number(F.col("p_size") / 4).alias("v"))


@register("number_inventory", "SELECT count(*) FILTER (WHERE o_orderkey % 4 < 3) AS readable, count(*) FILTER (WHERE o_orderkey % 4 = 3) AS unreadable, count(*) FILTER (WHERE o_orderkey % 4 = 1) AS negative_forms FROM orders")
def number_inventory(spark, sf):
    return profiling.number_inventory(mixed_numbers(spark, sf), "v").select("readable", "unreadable", "negative_forms")


@register("phone", "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '+46' WHEN 1 THEN '+47' WHEN 2 THEN '+46' ELSE 'ring ' END || CASE WHEN c_custkey % 4 = 3 THEN '' ELSE '70' END || lpad(CAST(c_custkey AS VARCHAR), 7, '3') AS v FROM customer")
def phone_(spark, sf):
    made = "concat(CASE c_custkey % 4 WHEN 0 THEN '070-' WHEN 1 THEN '+47 (70) ' WHEN 2 THEN '004670' ELSE 'ring ' END, lpad(c_custkey, 7, '3'))"
    return table(spark, sf, "customer").select("c_custkey", F.expr(made).alias("v")).select("c_custkey", phone.rewrite_phone("v").alias("v"))


@register("email_parts", "SELECT c_custkey, 'kund' AS main, CASE WHEN c_custkey % 3 = 0 THEN 'co.uk' ELSE 'se' END AS top, CASE WHEN c_custkey % 2 = 0 THEN '' ELSE 'Anna-Lena' END AS first, CASE WHEN c_custkey % 2 = 0 THEN '' ELSE 'Berg' END AS last, c_custkey % 2 = 0 AS role FROM customer")
def email_parts(spark, sf):
    made = "concat(CASE WHEN c_custkey % 2 = 0 THEN 'Info' ELSE 'anna-lena.BERG' END, c_custkey, '@mail.kund.', CASE WHEN c_custkey % 3 = 0 THEN 'co.uk' ELSE 'se' END)"
    return table(spark, sf, "customer").select("c_custkey", email.parse_email(F.expr(made)).alias("p")).select("c_custkey", "p.main", "p.top", "p.first", "p.last", "p.role")


@register("email_fields", "SELECT c_custkey, 'Eva Lind' AS full, 'x.se' AS domain FROM customer")
def email_fields(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.lit("lind.eva@x.se").alias("v"))
    return c.select("c_custkey", email.email_field("v", "full", True).alias("full"), email.email_field("v", "domain").alias("domain"))


@register("mojibake", "SELECT doc_id, lang FROM documents")
def mojibake(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang")
    broken = d.select("doc_id", F.concat(F.lit("fÃ¶r "), "lang").alias("v"))
    return broken.select("doc_id", F.replace(text.mojibake_repaired("v"), F.lit("för "), F.lit("")).alias("lang"))


# Columns


def names_query(name: str, sql: str, parts):
    def run(spark, sf):
        c = table(spark, sf, "customer").select("c_custkey", F.concat_ws("; ", "c_name", "c_mktsegment", "c_nationkey").alias("v"))
        return c.select("c_custkey", *[p.alias(f"part_{i}") for i, p in enumerate(parts(F.col("v")), 1)])

    register(name, sql)(run)


names_query("split_first", "SELECT c_custkey, c_name AS part_1, c_mktsegment || '; ' || CAST(c_nationkey AS VARCHAR) AS part_2 FROM customer", lambda v: columns.split_first(v, ";"))
names_query("split_last", "SELECT c_custkey, c_name || '; ' || c_mktsegment AS part_1, CAST(c_nationkey AS VARCHAR) AS part_2 FROM customer", lambda v: columns.split_last(v, ";"))
names_query("split_each", "SELECT c_custkey, c_name AS part_1, c_mktsegment AS part_2, CAST(c_nationkey AS VARCHAR) AS part_3, '' AS part_4 FROM customer", lambda v: columns.split_each(v, ";", 4))
names_query("split_position", "SELECT c_custkey, c_name[1:8] AS part_1, c_name[9:12] AS part_2, trim(substr(c_name || '; ' || c_mktsegment || '; ' || CAST(c_nationkey AS VARCHAR), 13)) AS part_3 FROM customer", lambda v: columns.split_positions(v, [8, 12]))


@register("split_pattern", "SELECT c_custkey, c_name AS name, c_mktsegment AS segment FROM customer")
def split_pattern(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.expr("concat(c_name, ' <', c_mktsegment, '>')").alias("v"))
    return c.select("c_custkey", *[x.alias(n) for n, x in columns.extract_pattern("v", "{name} <{segment}>").items()])


@register("split_inventory", "SELECT 2 AS max_parts, count(*) FILTER (WHERE p_partkey % 2 = 0) AS undelimited FROM part")
def split_inventory(spark, sf):
    p = table(spark, sf, "part").select(F.expr("if(p_partkey % 2 = 0, p_name, concat(p_name, '|', p_brand))").alias("v"))
    return columns.split_inventory(p, "v", "|").select("max_parts", "undelimited")


@register("split_rows", "SELECT p_partkey, p_brand AS v FROM part WHERE p_partkey % 3 <> 0 UNION ALL SELECT p_partkey, p_type FROM part WHERE p_partkey % 3 <> 0 UNION ALL SELECT p_partkey, '' FROM part WHERE p_partkey % 3 = 0")
def split_rows(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.expr("if(p_partkey % 3 = 0, '', concat(p_brand, ';; ', p_type))").alias("v"))
    return columns.split_to_rows(p, "v", ";", "p_partkey").select("p_partkey", "v")


@register("template", "SELECT n_nationkey, n_name || ' (' || CAST(n_regionkey AS VARCHAR) || ')' AS v FROM nation")
def template(spark, sf):
    n = table(spark, sf, "nation")
    return n.select("n_nationkey", columns.template(n, "{n_name}  ({n_regionkey}) ").alias("v"))


@register("template_ends", "SELECT n_nationkey, CASE n_nationkey WHEN 0 THEN 'INSERT ' || n_name WHEN (SELECT max(n_nationkey) FROM nation) THEN n_name || ';' ELSE n_name || ',' END AS v FROM nation")
def template_ends(spark, sf):
    return columns.template_with_ends(table(spark, sf, "nation"), "v", "{n_name},", "n_nationkey", "INSERT {n_name}", "{n_name};").select("n_nationkey", "v")


@register("formula", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, floor(l_extendedprice * (1 - l_discount) * 100 + 0.5) / 100 AS net, CASE WHEN l_discount = 0 THEN NULL ELSE round(l_tax / l_discount, 9) END AS ratio, least(l_quantity, 10) AS capped FROM lineitem")
def formula(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", columns.formula(li, "RUNDA({l_extendedprice} * (1 - {l_discount}); 2)").alias("net"),
        F.round(columns.formula(li, "{l_tax} / {l_discount}"), 9).alias("ratio"), columns.formula(li, "MIN({l_quantity}; 10)").alias("capped"),
    )


@register("formula_dates", "SELECT o_orderkey, CAST(datediff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) + 30 AS DOUBLE) AS due FROM orders")
def formula_dates(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    return o.select("o_orderkey", columns.formula(o, "{day} + 30", {"day": "date"}).alias("due"))


@register("replace_literal", "SELECT c_custkey, replace(c_name, '#', '$1 ') AS v FROM customer")
def replace_literal(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", columns.find_replace("c_name", "#", "$1 ").alias("v"))


@register("replace_regex", "SELECT c_custkey, regexp_replace(c_name, '#0*([0-9]+)$', ' nr \\1') AS v FROM customer")
def replace_regex(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", columns.find_replace("c_name", "#0*([0-9]+)$", " nr $1", regex=True).alias("v"))


@register("replace_cell", "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'Bygg' ELSE c_mktsegment END AS v FROM customer")
def replace_cell(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", columns.find_replace("c_mktsegment", "büilding", "Bygg", whole=True, accents=True).alias("v"))


@register("replace_hits", "SELECT count(*) AS changed FROM customer WHERE contains(c_mktsegment, 'IN')")
def replace_hits(spark, sf):
    return columns.replace_hits(table(spark, sf, "customer"), "c_mktsegment", "in", "on")


@register("preview_counts", "SELECT count(*) AS changed, CAST(0 AS BIGINT) AS problems, count(*) AS filled FROM customer")
def preview_counts(spark, sf):
    return profiling.preview_counts(table(spark, sf, "customer"), "c_name", text.CLEANERS["upper"]("c_name"))


# Rows


@register("running_number", "SELECT row_number() OVER (ORDER BY n_nationkey) AS \"Nr\", n_nationkey FROM nation")
def running_number(spark, sf):
    return rows.running_number(table(spark, sf, "nation"), ["n_nationkey"]).select("Nr", "n_nationkey")


@register("drop_empty_rows", "SELECT p_partkey FROM part WHERE p_partkey % 7 <> 0")
def drop_empty_rows(spark, sf):
    return rows.drop_empty_rows(part_cells(spark, sf), ["blank"]).select("p_partkey")


@register("drop_empty_columns", "SELECT n_nationkey, n_name FROM nation")
def drop_empty_columns(spark, sf):
    return rows.drop_empty_columns(table(spark, sf, "nation").select("n_nationkey", "n_name", F.lit("").alias("nothing"), F.lit(None).cast("string").alias("gone")))


@register("fill_range", "SELECT n_nationkey, CASE WHEN n_nationkey IN (3, 4, 5) THEN (SELECT n_name FROM nation WHERE n_nationkey = 3) ELSE n_name END AS n_name FROM nation")
def fill_range(spark, sf):
    return rows.fill_down(table(spark, sf, "nation"), "n_nationkey", [5, 3, 4], "n_name").select("n_nationkey", "n_name")


@register("duplicate_rows", "SELECT n_nationkey, 0 AS copy FROM nation UNION ALL SELECT n_nationkey, 1 FROM nation WHERE n_nationkey < 3")
def duplicate_rows(spark, sf):
    return rows.duplicate_rows_by_id(table(spark, sf, "nation"), "n_nationkey", [0, 1, 2]).select("n_nationkey", "copy")


@register("columns_edit", "SELECT n_nationkey, n_name AS \"Namn\", n_name AS \"Namn (kopia)\", 'x' AS extra FROM nation")
def columns_edit(spark, sf):
    n = rows.remove_columns(table(spark, sf, "nation"), ["n_regionkey"])
    n = rows.insert_column(rows.duplicate_column(rows.rename_column(n, "n_name", "Namn"), "Namn"), "extra", "x")
    return n.select("n_nationkey", "Namn", "Namn (kopia)", "extra")


PROFILE = """{"version": 1, "steps": [
 {"type": "clean", "columns": ["o_orderpriority"], "cleaner": "lower"},
 {"type": "date", "columns": ["day"], "form": "month"},
 {"type": "replace", "columns": ["o_orderpriority"], "find": "1-urgent", "new": "nu"},
 {"type": "template", "name": "label", "pattern": "{o_orderpriority} {day}"},
 {"type": "formula", "name": "twice", "source": "{o_orderkey} * 2"},
 {"type": "drop_column", "columns": ["day"]},
 {"type": "clean", "columns": ["missing"], "cleaner": "trim"}]}"""


@register("pipeline_replay", "SELECT o_orderkey, replace(lower(o_orderpriority), '1-urgent', 'nu') AS o_orderpriority, replace(lower(o_orderpriority), '1-urgent', 'nu') || ' ' || strftime(o_orderdate, '%Y-%m') AS label, CAST(o_orderkey * 2 AS VARCHAR) AS twice FROM orders")
def pipeline_replay(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", F.date_format("o_orderdate", "d/M/yyyy").alias("day"))
    return Pipeline.from_json(PROFILE).run(o)


@register("rank_minmax", "SELECT p_brand, arg_min(CAST(p_size AS VARCHAR), p_size) AS least, arg_max(CAST(p_size AS VARCHAR), p_size) AS most FROM part GROUP BY 1")
def rank_minmax(spark, sf):
    p = table(spark, sf, "part").select("p_brand", F.col("p_size").cast("string").alias("v"))
    key = rank_struct("v", "number")
    return p.groupBy("p_brand").agg(F.min_by("v", key).alias("least"), F.max_by("v", key).alias("most"))


from tablemill.plans import more_queries  # noqa: E402, F401  (it registers into the tables above)
