"""Hot keys: adaptive execution must be able to cut the joins that return rows."""

import pytest
from pyspark.sql import functions as F

from stayspark.operators import joins


@pytest.fixture
def eager(spark):
    """Small partitions count as skewed, and nothing is broadcast."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.shuffle.partitions": "20",
    }
    old = {key: spark.conf.get(key) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key, value in old.items():
        spark.conf.set(key, value)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_hot_and_missing_keys_are_cut(spark, eager, how):
    key = F.when(F.col("id") % 3 == 0, 1).when(F.col("id") % 3 == 1, None).otherwise(F.col("id"))
    left = spark.range(0, 60_000, 1, 8).select(key.cast("bigint").alias("k"), F.xxhash64("id").alias("v"))
    # A wanted key for the semi join, an unwanted one for the anti join.
    right = spark.range(1 if how != "left_anti" else 2, 50).select(F.col("id").alias("k"), F.lit(1).alias("w"))
    joined = left.join(right, "k", how)
    rows = [r.p for r in joined.select("v", F.spark_partition_id().alias("p")).collect()]
    assert max(rows.count(p) for p in set(rows)) < 15_000


def test_small_batches_do_not_shuffle_the_table(spark, tmp_path):
    """Few wanted keys against a large table: the table's own scan feeds a broadcast join."""
    spark.range(200_000).withColumnRenamed("id", "k").write.parquet(str(tmp_path / "big"))
    spark.range(3).withColumnRenamed("id", "k").write.parquet(str(tmp_path / "few"))
    keys, few = spark.read.parquet(str(tmp_path / "big")), spark.read.parquet(str(tmp_path / "few"))
    plan = joins.keys_among(keys, few)._jdf.queryExecution().optimizedPlan().toString()
    # Aggregate on top, semi join below it.
    assert plan.index("Aggregate") < plan.index("LeftSemi")
    assert joins.keys_among(keys, few).count() == 3
