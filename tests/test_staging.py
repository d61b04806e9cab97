from __future__ import annotations

import os
from types import SimpleNamespace

import pytest

from menuspark.sources import staging


def test_a_cluster_needs_a_shared_folder():
    conf = SimpleNamespace(get=lambda key, default: default, set=lambda key, value: None)
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://x"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            staging.shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master)))
    given = SimpleNamespace(get=lambda key, default: "hdfs://x/y/" if key == "spark.checkpoint.dir" else default)
    assert staging.shared_dir(SimpleNamespace(conf=given)) == "hdfs://x/y"


def test_release(spark):
    df = staging.staged(spark.range(10), "numbers")
    path = df.inputFiles()[0].removeprefix("file://").rpartition("/")[0]
    assert df.count() == 10 and os.path.isdir(path)
    assert staging.release(spark) >= 1 and not os.path.exists(path) and staging.release(spark) == 0
