"""Exports in order, partition pruning, a ledger that clears."""

from __future__ import annotations

from florilege.sources import tables as files


def test_files_are_in_order_one_after_the_other(spark, tmp_path):
    df = spark.range(500).selectExpr("(id * 7919) % 500 as k", "case when id % 5 = 0 then null else concat('a\"b,', char(10), id) end as v").repartition(4)
    files.export_ordered(df, f"{tmp_path}/x", ["k"], rows_per_file=60)
    seen = []
    for path in sorted((tmp_path / "x").glob("part-*.csv")):
        own = [r["k"] for r in files.import_csv(spark, str(path), "k long, v string").collect()]
        assert own == sorted(own) and len(own) <= 60
        seen += own
    assert seen == list(range(500))
    assert sorted(map(tuple, files.import_csv(spark, f"{tmp_path}/x", "k long, v string").collect()), key=repr) == sorted(map(tuple, df.collect()), key=repr)


def test_only_the_asked_partition_is_read(spark, tmp_path):
    files.write_by(spark.range(40).selectExpr("id", "id % 4 as a", "id % 2 as b"), f"{tmp_path}/p", ["a", "b"])
    got = files.partitioned(spark, f"{tmp_path}/p", a=2)
    assert got.count() == 10 and "PartitionFilters: [isnotnull(a" in got._jdf.queryExecution().toString()


def test_successes_clear_failures_before_them(spark):
    failed = spark.createDataFrame([(1, "x", 1), (1, "x", 5), (2, "x", 3), (3, "fatal", 9)], "k long, why string, at long")
    ok = spark.createDataFrame([(1, 2), (2, 4), (3, 1)], "k long, at long")
    got = sorted(map(tuple, files.failure_ledger(failed, "k", "why", ("fatal",), succeeded=ok).collect()))
    assert got == [(1, 1, "x", False), (3, 1, "fatal", True)]
