import pytest

from rowquarry.session import scratch_path, threads
from rowquarry.workload import group_median, relabelled, sampled_table


def test_threads_return_the_previous_value(spark):
    before = threads(spark)
    try:
        assert threads(spark, 3) == before and threads(spark) == 3
        assert threads(spark, 0) == 3 and threads(spark) == spark.sparkContext.defaultParallelism
        assert threads(spark, reset_after_fork=True) == spark.sparkContext.defaultParallelism
        with pytest.raises(TypeError, match="reset_after_fork"):
            threads(spark, reset_after_fork="yes")
        for bad in (-1, 1.5, "2", True):
            with pytest.raises(ValueError):
                threads(spark, bad)
    finally:
        threads(spark, before)


def test_scratch_paths_differ(spark):
    assert scratch_path(spark, "a") != scratch_path(spark, "a")


def test_group_median(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 10.0), (None, 4.0), (None, 5.0), ("b", None)], "k string, v double")
    got = {r.k: (r.m, r.n) for r in group_median(df, ["k"], {"m": "v"}).collect()}
    assert got == {"a": (2.0, 3), None: (4.5, 2), "b": (None, 1)}


def test_relabelled(spark):
    df = spark.createDataFrame([("x",), ("y",), (None,)], "k string")
    assert [r.k for r in relabelled(df, "k", {"x": "1"}).collect()] == ["1", "y", None]
    assert [r.k for r in relabelled(df, "k", {"x": "1"}, "else").collect()] == ["1", "else", "else"]


def test_sampled_table(spark):
    df = sampled_table(spark, 20_000)
    share = {r.Logical: r["count"] / 20_000 for r in df.groupBy("Logical").count().collect()}
    assert abs(share[True] - 0.85) < 0.02 and abs(share[False] - 0.10) < 0.02 and abs(share[None] - 0.05) < 0.02
    low, high, values = df.selectExpr("min(Integer)", "max(Integer)", "count(distinct Real)").first()
    assert (low, high, values) == (1, 100, 20)
