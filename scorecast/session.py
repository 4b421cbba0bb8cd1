"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterable
from multiprocessing.pool import ThreadPool
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

from scorecast.errors import NoSharedFolderError

RECOMMENDED = {
    "spark.sql.session.timeZone": "UTC",
    # Runtime re-planning: small shuffle partitions are merged, skewed join
    # partitions are split, joins turn into broadcasts when a side proves small.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join partition even if a later step has to shuffle again.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Write a few partitions per task side by side instead of sorting the rows by partition first.
    "spark.sql.maxConcurrentOutputFileWriters": "32",
}


def build_session(app_name: str = "scorecast", **conf: str) -> SparkSession:
    """A session with the recommended settings; master and resources come from spark-submit."""
    builder = SparkSession.builder.appName(app_name)
    for key, value in {**RECOMMENDED, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors can reach, set as the checkpoint folder as well.

    It is read from spark.checkpoint.dir. Only a local session, whose
    executors share the driver's disk, gets a temporary folder of its own.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if not folder and not context.master.startswith("local"):
            raise NoSharedFolderError("set spark.checkpoint.dir to a folder that every executor can reach")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="scorecast-"))
    return (folder or context.getCheckpointDir()).rstrip("/")


def side_by_side(spark: SparkSession, work: Callable[[Any], Any], items: Iterable[Any], threads: int = 4) -> list[Any]:
    """``work`` on every item, results in order; the Spark jobs of a few items run at the same time.

    The driver threads only submit jobs. What one job leaves idle, such as the
    end of a stage or the next small tree, another one uses.
    """
    with ThreadPool(threads) as pool:
        return pool.map(inheritable_thread_target(spark)(work), items, chunksize=1)
