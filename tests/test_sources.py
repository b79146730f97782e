import os

import pytest

from lakeloom.sources import scratch, tables

SCHEMA = "id long, name string, v double"


@pytest.mark.parametrize("fmt", ["parquet", "orc", "csv", "json", "xml"])
def test_round_trip(spark, tmp_path, fmt):
    df = spark.createDataFrame([(1, "a,b", 0.5), (2, None, None), (3, "é\"q", -1.0)], SCHEMA)
    tables.write(df, str(tmp_path / fmt), fmt)
    back = tables.read(spark, str(tmp_path / fmt), fmt, SCHEMA)
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))


def test_text_binary_and_errors(spark, tmp_path):
    df = spark.createDataFrame([("one",), ("two",)], "value string").coalesce(1)
    tables.write(df, str(tmp_path / "t"), "text")
    assert {r.value for r in tables.read(spark, str(tmp_path / "t"), "text").collect()} == {"one", "two"}
    assert tables.read(spark, str(tmp_path / "t"), "binaryFile").where("length > 0").count() == 1
    for bad in (lambda: tables.read(spark, "x", "csv"), lambda: tables.read(spark, "x", "nope", SCHEMA), lambda: tables.write(df, "x", "binaryFile")):
        with pytest.raises(ValueError):
            bad()


def test_partitions_are_pruned(spark, tmp_path):
    tables.write(spark.range(100).selectExpr("id", "id % 5 as p"), str(tmp_path / "p"), partition_by=("p",))
    out = tables.read(spark, str(tmp_path / "p"), "parquet").where("p = 3")
    assert out.count() == 20
    assert "PartitionFilters: [isnotnull(p" in out._jdf.queryExecution().executedPlan().toString()


def test_bucketed_join_needs_no_shuffle(spark, tmp_path):
    for name in ("left_b", "right_b"):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        tables.write_bucketed(spark.range(1000).selectExpr("id as k", f"id as {name}_v"), name, ("k",), 4, mode="overwrite")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        j = spark.table("left_b").join(spark.table("right_b"), "k")
        assert "Exchange" not in j._jdf.queryExecution().executedPlan().toString() and j.count() == 1000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        for name in ("left_b", "right_b"):
            spark.sql(f"DROP TABLE {name}")


def test_scratch(spark):
    df = scratch.materialize(spark.range(5).toDF("n"))
    assert df.count() == 5 and df.dtypes == [("n", "bigint")]
    file = df.inputFiles()[0].removeprefix("file://")
    assert os.path.exists(file)
    scratch.clear(spark)
    assert not os.path.exists(file)


def test_scratch_release_and_shuffle_files(spark):
    kept, gone = (scratch.materialize(spark.range(100).groupBy("id").count()) for _ in range(2))
    scratch.release(gone, kept.where("id > 3"))  # only tables that were written here are deleted
    assert kept.count() == 100 and not os.path.exists(gone.scratch_path) and os.path.exists(kept.scratch_path)
    assert spark.conf.get(scratch.CLEAN_UP, None) in (None, "false")


def test_no_local_folder_on_a_cluster():
    class Cluster:
        class conf:  # noqa: N801
            get = staticmethod(lambda *a: None)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(RuntimeError, match=r"spark\.checkpoint\.dir"):
        scratch.shared_dir(Cluster)


def test_scopes_delete_what_is_written_inside(spark):
    import os

    from lakeloom.sources import scratch

    with scratch.scope() as tables:
        a, b = (scratch.materialize(spark.range(n)) for n in (3, 5))
        with scratch.scope():
            c = scratch.materialize(a)
        assert not os.path.exists(c.scratch_path) and a.count() == 3
        tables[:] = [t for t in tables if t is not b]
    assert not os.path.exists(a.scratch_path) and b.count() == 5
    scratch.release(b)
    assert not os.path.exists(b.scratch_path)


def test_threads_share_the_setting(spark):
    """Of several writers at once the last one puts the session's setting back."""
    from concurrent.futures import ThreadPoolExecutor

    from lakeloom.sources import scratch

    for before in (None, "false"):
        spark.conf.unset(scratch.CLEAN_UP) if before is None else spark.conf.set(scratch.CLEAN_UP, before)
        with ThreadPoolExecutor(4) as pool:
            assert [t.count() for t in pool.map(lambda n: scratch.materialize(spark.range(n)), range(8))] == list(range(8))
        assert spark.conf.get(scratch.CLEAN_UP, None) == before
    spark.conf.unset(scratch.CLEAN_UP)


@pytest.mark.parametrize("query", ["format_xml", "format_binary"])
def test_files_that_are_read_whole_are_bounded(spark, tmp_path, monkeypatch, query):
    from lakeloom.plans import registry, stored

    monkeypatch.setattr(tables, "WHOLE_ROWS", 40)
    spark.range(100).selectExpr("id AS c_custkey", "concat('n', id) AS c_name", "1 AS c_nationkey", "0.5D AS c_acctbal", "'m' AS c_mktsegment").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    paths = []
    monkeypatch.setattr(stored, "new_path", lambda s: paths.append(scratch.new_path(s)) or paths[-1])
    out = registry.queries()[query](spark, str(tmp_path))
    assert out.count() == 100 if query == "format_xml" else out.first().bytes == 390
    assert len([f for f in os.listdir(paths[0]) if f.startswith("part-")]) == 3
