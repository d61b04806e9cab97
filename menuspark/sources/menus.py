"""Parsed menus as Parquet: items, categories and statistics, each partitioned by a hash of the menu."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans.parse import Parsed


def write_menu(parsed: Parsed, path: str, *, buckets: int = 64, mode: str = "overwrite") -> None:
    for name in ("items", "categories", "stats"):
        table: DataFrame = getattr(parsed, name)
        table.withColumn("bucket", F.pmod(F.xxhash64("menu_id"), F.lit(buckets))).repartition(buckets, "bucket").write.mode(mode).partitionBy("bucket").parquet(f"{path}/{name}")


def read_menu(spark: SparkSession, path: str) -> Parsed:
    return Parsed(*(spark.read.parquet(f"{path}/{name}").drop("bucket") for name in ("items", "categories", "stats")))
