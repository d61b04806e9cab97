"""Tables written in the folder that the cluster shares, to cut long lineages so that lost executors cost little.

Staged tables outlive the call that wrote them, as results are read from them. Whoever has used the results drops them all with
``release``; else they go with the shared folder.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which driver and executors share, as a URI. Where it is unset a local session (tests) makes a temporary
    folder once; on a cluster that is an error, as executors wouldn't see each other's files."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("menuspark.shared.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("menuspark.shared.dir", found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """The path of a folder of one's own in the shared one."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read again: cuts the lineage, and is there after the loss of any
    executor."""
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Delete all folders this application has made so far; results that weren't read yet are lost. Returns how many there were."""
    paths = _made.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        own = spark._jvm.org.apache.hadoop.fs.Path(path)
        own.getFileSystem(spark._jsc.hadoopConfiguration()).delete(own, True)
    return len(paths)
