import pytest
from pyspark.sql import functions as F

from lexiquarry import workspace


def test_tables_lie_in_the_shared_folder(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    assert workspace.shared_root(spark).startswith(root)
    df = spark.range(5).withColumn("s", F.lit("x"))
    again = workspace.materialize(df, "t")
    assert again.dtypes == df.dtypes and sorted(again.collect()) == sorted(df.collect()) and root in again.inputFiles()[0]


def test_small_files(spark):
    where = workspace.new_path(spark, "f")
    assert workspace.names_in(spark, where) == []
    for i, text in enumerate(("one", "zwei ü", "")):
        assert workspace.read_text(spark, f"{where}/{i}") is None
        workspace.write_new(spark, f"{where}/{i}", text)
        assert workspace.read_text(spark, f"{where}/{i}") == text
    with pytest.raises(FileExistsError):
        workspace.write_new(spark, f"{where}/0", "other")
    assert workspace.read_text(spark, f"{where}/0") == "one" and workspace.names_in(spark, where) == ["0", "1", "2"]
    workspace.drop(spark, where)
    assert workspace.names_in(spark, where) == []


def test_proof_of_size(spark):
    small = spark.range(10).withColumn("s", F.lit("x" * 100))
    assert workspace.fits_broadcast(small, 10_000) and not workspace.fits_broadcast(small, 1000) and workspace.fits_broadcast(small.limit(0), 0)


@pytest.mark.parametrize("before", [None, "3"])
def test_setting_comes_back(spark, before):
    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    if before:
        spark.conf.set(key, before)
    with pytest.raises(RuntimeError), workspace.initial_partitions(spark, 50):
        assert spark.conf.get(key) == "50"
        raise RuntimeError
    assert spark.conf.get(key, None) == before
    spark.conf.unset(key)


def test_scope(spark):
    outside = workspace.materialize(spark.range(3), "t")
    with workspace.scope(spark):
        inside = workspace.materialize(spark.range(3), "t")
        with workspace.scope(spark):
            assert workspace.materialize(spark.range(4), "t").count() == 4
        assert inside.count() == 3
        folder = inside.inputFiles()[0].rpartition("/")[0]
    assert workspace.names_in(spark, folder) == [] and outside.count() == 3
