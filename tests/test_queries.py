"""Every registered relational query against DuckDB on the smallest tables."""

import os

import pytest

from lakeloom.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else f"{v:.12g}"
    return str(v)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in sorted(os.listdir(SF)):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    rel = duck.sql(registry.oracle_sql()[name])
    cols = sorted(df.columns)
    assert sorted(rel.columns) == cols
    order = [rel.columns.index(c) for c in cols]
    want = sorted(tuple(plain(r[i]) for i in order) for r in rel.fetchall())
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    assert got == want


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize(("name", "word"), [("filter_range", "In(l_returnflag, [A,R])"), ("top_k_per_group", "WindowGroupLimit"), ("semi_join", "LeftSemi"), ("anti_join", "LeftAnti"), ("top_orders", "TakeOrderedAndProject")])
def test_plans(spark, name, word):
    plan = registry.queries()[name](spark, SF)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert word in plan


def test_no_query_needs_one_task_or_a_product(spark):
    for name, q in registry.queries().items():
        if name.startswith("stream_"):
            continue
        plan = q(spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
        assert "Python" not in plan or q.__module__.endswith(".user_functions") or name in ("inequality_join", "nearest_vectors"), name


def plan_of(spark, df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_stored_tables_are_pruned_and_joined_in_place(spark):
    queries = registry.queries()
    static, dynamic = plan_of(spark, queries["static_pruning"](spark, SF)), plan_of(spark, queries["dynamic_pruning"](spark, SF))
    assert "(y" in static[static.index("PartitionFilters") :][:60] and "1997" in static[static.index("PartitionFilters") :][:80]
    assert "dynamicpruning" in dynamic
    bucketed = plan_of(spark, queries["bucketed_join"](spark, SF))
    assert "SortMergeJoin" in bucketed and "Exchange" not in bucketed


def test_two_inequalities_need_no_nested_loop(spark):
    plan = plan_of(spark, registry.queries()["inequality_join"](spark, SF))
    assert "NestedLoop" not in plan and "Cartesian" not in plan
