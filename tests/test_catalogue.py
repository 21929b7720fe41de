import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
import oracle

from tablemill.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", list(catalogue.ORACLE_SQL))
def test_query_equals_its_sql(spark, con, name):
    assert oracle.ours(catalogue.QUERIES[name](spark, SF)) == oracle.theirs(con, catalogue.ORACLE_SQL[name])


@pytest.mark.parametrize("name", [n for n in catalogue.QUERIES if n not in catalogue.ORACLE_SQL])
def test_query_without_sql_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() >= 0


def test_entry_point_without_llm(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 3
    assert set(e.oracle_sql()) <= set(e.queries())


def test_fuzzy_pairs_takes_all_suppliers(spark, tmp_path):
    names = {k: f"{word} trading company" for k, word in zip((1, 4999, 5001, 290_000), ("northwind", "blueberry", "cascade", "evergreen"))}
    spark.createDataFrame(list(names.items()), "s_suppkey long, s_name string").write.parquet(f"{tmp_path}/supplier.parquet")
    got = {r.right_value for r in catalogue.fuzzy_pairs(spark, str(tmp_path)).filter("place = 1").collect()}
    assert got == set(names.values())
