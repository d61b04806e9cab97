from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from menuspark.operators import skew


@pytest.mark.parametrize("broadcast_rows", [100_000, 1])
def test_hot_keys_join_as_usual(spark, monkeypatch, broadcast_rows):
    monkeypatch.setattr(skew, "broadcastable", lambda df: False)
    left = spark.range(6_000).select("id", F.when(F.col("id") % 2 == 0, "popular").when(F.col("id") % 97 == 0, None).otherwise(F.col("id").cast("string")).alias("menu"), (F.col("id") % 3).alias("city"))
    right = spark.range(5).select(F.lit("popular").alias("menu"), (F.col("id") % 3).alias("city"), F.col("id").alias("dish")).union(spark.range(3_000).select(F.col("id").cast("string"), F.col("id") % 3, -F.col("id")))
    got = skew.join_spread(left, right, ["menu", "city"], share=10, broadcast_rows=broadcast_rows, salts=7)
    want = left.join(right, ["menu", "city"])
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert skew.join_spread(left.limit(0), right, ["menu", "city"], broadcast_rows=broadcast_rows).count() == 0


def test_a_hot_key_is_spread_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(skew, "broadcastable", lambda df: False)
    left = spark.range(20_000).select("id", F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).cast("long").alias("k"))
    right = spark.range(20_000).select(F.col("id").alias("k"), F.lit(1).alias("one"))
    for broadcast_rows in (0, 100):
        sizes = skew.join_spread(left, right, ["k"], share=100, broadcast_rows=broadcast_rows, salts=16).groupBy(F.spark_partition_id()).count()
        assert sizes.agg(F.max("count")).first()[0] < 0.45 * 20_000
    plain = left.hint("shuffle_hash").join(right.hint("merge"), "k").groupBy(F.spark_partition_id()).count()
    assert plain.agg(F.max("count")).first()[0] > 0.5 * 20_000


def test_small_blocks_share_partitions(spark):
    """Blocks rise with the order, hold successive rows and are no partitions of their own."""
    rows = 40_000
    own = spark.range(rows).select((F.col("id") * 7919 % rows).alias("id"), (F.col("id") % 3).alias("line"))
    out = skew.in_blocks(own, rows, 50, "id")
    assert out.rdd.getNumPartitions() <= 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = sorted(map(tuple, out.groupBy("_block").agg(F.min("id"), F.max("id"), F.count("*")).collect()))
    assert sum(n for *_, n in found) == rows and all(hi - lo + 1 == n <= 50 for _, lo, hi, n in found) and len(found) <= rows // 50 + 16
    assert [lo for _, lo, _, _ in found] == sorted(lo for _, lo, _, _ in found)
    assert skew.in_blocks(own, rows, 10**6, "id").select("_block").distinct().count() == 1
