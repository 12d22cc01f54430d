"""Versioned tables: what a reader sees before, during and after a new version, and after a failed one."""

import os

import pytest
from pyspark.sql import functions as F

from panelwise.sources import store

COLUMNS = "k string, y string, v int"


def rows(df):
    return sorted(map(tuple, df.select("k", "y", "v").collect()))


@pytest.fixture
def first(spark):
    return spark.createDataFrame([("a", "2020-21", 1), ("b", "2020-21", 2), ("a", "2021-22", 3)], COLUMNS)


def test_readers_stay_with_their_version(spark, first, tmp_path):
    path = str(tmp_path / "t")
    old = store.republish(first, path, ["y"])
    new = store.republish(first.withColumn("v", F.col("v") * 10), path, ["y"], {"y": "2021-22"})
    assert rows(new) == [("a", "2020-21", 1), ("a", "2021-22", 30), ("b", "2020-21", 2)] == rows(store.read_version(spark, path))
    assert rows(old) == rows(first) == rows(store.read_version(spark, path, version=1))
    assert store.versions(spark, path) == [2, 1]
    none = store.republish(first.where("v > 9"), path, ["y"], {"y": "2021-22"})
    assert rows(none) == [("a", "2020-21", 1), ("b", "2020-21", 2)] == rows(store.read_version(spark, path))
    empty = store.republish(first.where("v > 9"), path, ["y"])
    assert rows(empty) == [] and empty.schema == none.select(empty.columns).schema


def test_a_run_that_fails_in_mid_write_leaves_the_old_version(spark, first, tmp_path):
    path = str(tmp_path / "t")
    store.republish(first, path, ["y"])
    failing = spark.range(0, 2000, 1, 8).select(
        F.col("id").cast("string").alias("k"),
        F.lit("2021-22").alias("y"),
        F.when(F.col("id") == 1999, F.raise_error(F.lit("lost in mid-write"))).otherwise(F.col("id")).cast("int").alias("v"),
    )
    with pytest.raises(Exception, match="lost in mid-write"):
        store.republish(failing, path, ["y"], {"y": "2021-22"})
    assert rows(store.read_version(spark, path)) == rows(first)
    # killed after the data and before the list, and in the middle of the list
    store._laid_out(first.withColumn("v", F.lit(7)), ["y"], [], "000000000002-dead").parquet(path)
    with open(f"{path}/_versions/000000000002", "w") as f:
        f.write("y=2020-21/version=000000000002-dead")
    assert rows(store.read_version(spark, path)) == rows(first)
    after = store.republish(first.withColumn("v", F.lit(5)), path, ["y"], {"y": "2020-21"})
    assert rows(after) == [("a", "2020-21", 5), ("a", "2021-22", 3), ("b", "2020-21", 5)]
    assert store.versions(spark, path) == [3, 1]


def test_two_writers_cannot_make_the_same_version(spark, first, tmp_path):
    path = str(tmp_path / "t")
    store.republish(first, path)
    real = store._laid_out

    def overtaken(*args):
        if not os.path.exists(f"{path}/_versions/000000000002"):
            store._laid_out = real
            store.republish(first.withColumn("v", F.lit(8)), path)
        return real(*args)

    store._laid_out = overtaken
    try:
        with pytest.raises(Exception, match="already exists|FileAlreadyExists"):
            store.republish(first.withColumn("v", F.lit(9)), path)
    finally:
        store._laid_out = real
    assert {r.v for r in store.read_version(spark, path).collect()} == {8}


def test_tables_that_are_not_there(spark, first, tmp_path):
    with pytest.raises(FileNotFoundError):
        store.read_version(spark, str(tmp_path / "none"))
    path = str(tmp_path / "once")
    store.publish(first, path, ["y"])
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        store.publish(first, path, ["y"])


def test_one_value_opens_few_row_groups(spark, tmp_path):
    """Range-clustered files with Bloom filters: one school's rows come from a few row groups of a year."""
    spark.conf.set("parquet.block.size", str(1 << 16))
    try:
        df = spark.range(120_000).select(
            F.concat(F.lit("s"), F.xxhash64("id")).alias("school_id"), F.lit("2020-21").alias("y"), *[F.rand(i).alias(f"c{i}") for i in range(4)]
        )
        table = store.publish(df, str(tmp_path / "t"), ["y"], ["school_id"])
        plain = store.publish(df, str(tmp_path / "p"), ["y"])
    finally:
        spark.conf.unset("parquet.block.size")
    one = df.first().school_id

    def read(frame):
        got = frame.where(F.col("school_id") == one)
        assert got.count() == 1
        got = frame.where(F.col("school_id") == one)
        got.collect()
        node = got._jdf.queryExecution().executedPlan()
        while node.children().size():
            node = node.children().apply(0)
        return node.metrics().apply("numOutputRows").value()

    assert read(plain) > 100_000 and 0 < read(table) < 12_000
    spark.conf.set("parquet.block.size", str(1 << 16))
    try:
        versioned = store.republish(df, str(tmp_path / "v"), ["y"], cluster_by=["school_id"])
    finally:
        spark.conf.unset("parquet.block.size")
    assert 0 < read(versioned) < 12_000
