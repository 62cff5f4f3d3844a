"""The shared folder of intermediate tables, and ranking of tied scores."""

import pytest
from pyspark.sql import functions as F

from docketry.operators.ranking import with_rank
from docketry.session import materialize, shared_folder


class Session:
    """A session with a master and settings only."""

    def __init__(self, master, folder=None):
        self.sparkContext = type("Context", (), {"master": master})
        self.conf = type("Conf", (), {"get": lambda *_: folder, "set": lambda *_: None})()


def test_shared_folder():
    for master in ("spark://host:7077", "yarn", "k8s://x", "local-cluster[3,2,1024]"):
        with pytest.raises(ValueError, match="checkpoint"):
            shared_folder(Session(master))
        assert shared_folder(Session(master, "hdfs://x/y/")) == "hdfs://x/y"
    for master in ("local", "local[8]", "local[*]"):
        assert "docketry-" in shared_folder(Session(master))


def test_materialize(spark):
    df = spark.range(10).withColumn("x", F.when(F.col("id") > 4, "a"))
    assert sorted(map(tuple, materialize(df, "t").collect())) == sorted(map(tuple, df.collect()))


def test_rank_of_one_hot_score(spark):
    """One score holds most rows, over many blocks; nulls come last."""
    n = 300_000
    df = spark.range(n).select(F.col("id").alias("ord"), F.when(F.col("id") % 10 == 0, F.col("id") % 7 * 1.5).when(F.col("id") % 10 != 1, 50.0).alias("relevance_score"))
    ranks = with_rank(df).orderBy("rank").select("rank", "ord").collect()
    assert [r.rank for r in ranks] == list(range(1, n + 1))
    score = lambda i: i % 7 * 1.5 if i % 10 == 0 else 50.0 if i % 10 != 1 else -1
    assert [r.ord for r in ranks] == sorted(range(n), key=lambda i: (-score(i), i))
    assert with_rank(df.limit(0)).count() == 0
