from __future__ import annotations

from pathlib import Path
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from scorecast.errors import NoSharedFolderError
from scorecast.session import shared_folder
from scorecast.sources.store import release, save, save_split


class Context:
    def __init__(self, master, folder=None):
        self.master, self.folder = master, folder

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


def session(master, setting=None, folder=None):
    return SimpleNamespace(
        sparkContext=Context(master, folder), conf=SimpleNamespace(get=lambda key, default: setting or default)
    )


def test_the_cluster_setting_is_used():
    spark = session("yarn", "hdfs://shared/checkpoints/")
    assert shared_folder(spark) == "hdfs://shared/checkpoints"
    assert spark.sparkContext.folder == "hdfs://shared/checkpoints/"


def test_a_cluster_without_the_setting_is_refused():
    with pytest.raises(NoSharedFolderError):
        shared_folder(session("spark://host:7077"))


def test_only_a_local_session_gets_its_own_folder():
    spark = session("local[4]")
    assert "scorecast-" in shared_folder(spark) and shared_folder(spark) == shared_folder(spark)


def test_a_checkpoint_folder_set_by_code_is_used():
    assert shared_folder(session("yarn", folder="hdfs://set/by/code")) == "hdfs://set/by/code"


def test_stored_tables(spark):
    df = spark.createDataFrame([(1, True, "x"), (2, False, "y"), (3, True, None)], "a int, flag boolean, t string")
    assert sorted(tuple(r) for r in save(df, "t").collect()) == sorted(tuple(r) for r in df.collect())
    by_flag = save(df, "t", partition_by="flag", rebalance=True)
    assert sorted((r.a, r.flag) for r in by_flag.collect()) == [(1, True), (2, False), (3, True)]
    yes, no = save_split(df, "t", "flag")
    assert sorted(r.a for r in yes.collect()) == [1, 3] and [r.a for r in no.collect()] == [2]
    _, none = save_split(df.where("flag"), "t", "flag")
    assert none.count() == 0 and none.columns == ["a", "t"]


def test_the_cleanup_setting_comes_back(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    saved = save(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "cleanup")
    assert saved.count() == 7 and spark.conf.get(key) == before


def test_released_tables_are_gone(spark):
    first, second = save(spark.range(5).toDF("x"), "first"), save(spark.range(9).toDF("x"), "second")
    folder = first.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    release(first)
    assert not Path(folder).exists() and second.count() == 9
