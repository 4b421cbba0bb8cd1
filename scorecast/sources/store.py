"""Intermediate tables in the shared folder.

Writing a table once cuts the lineage, survives lost executors and gives the
optimiser the true file size, so that it broadcasts the table in later joins
only while it stays under spark.sql.autoBroadcastJoinThreshold. The tables of
an application lie in one folder named after it, to be removed after the run.

What a job shuffled is of no use once its table is written, so Spark is told
to remove these files as soon as the job ends.
"""

from __future__ import annotations

import threading
from collections.abc import Iterator, Mapping, Sequence
from contextlib import AbstractContextManager, contextmanager
from uuid import uuid4

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql.types import StructType

from scorecast.session import shared_folder, side_by_side


def _new_path(df: DataFrame, name: str) -> str:
    spark = df.sparkSession
    return f"{shared_folder(spark)}/scorecast/{spark.sparkContext.applicationId}/{name}-{uuid4().hex}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_SPLIT = "spark.sql.files.maxPartitionBytes"
_MERGED = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
_lock = threading.Lock()
_held: dict[tuple[int, str], tuple[int, str]] = {}  # by session and setting: how many hold it, and its value before them

# A task keeps much more in memory than the file it reads: sums by key, or the points of a fit. These bound the rows of
# a task whatever the input: a file of a stored table has so many rows at most, and a task reads about so many bytes.
FILE_ROWS = 500_000
SPLIT_BYTES = 16 << 20


@contextmanager
def _setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """The session's setting while any thread is inside; its own value comes back afterwards."""
    key = (id(spark), name)
    with _lock:
        count, before = _held.get(key, (0, ""))
        before = before or spark.conf.get(name)
        _held[key] = (count + 1, before)
        spark.conf.set(name, value)
    try:
        yield
    finally:
        with _lock:
            count, before = _held.pop(key)
            if count > 1:
                _held[key] = (count - 1, before)
            else:
                spark.conf.set(name, before)


def _at_most(spark: SparkSession, name: str, size: int) -> AbstractContextManager[None]:
    own = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
    return _setting(spark, name, str(min(own, size)))


def small_splits(spark: SparkSession) -> AbstractContextManager[None]:
    """Jobs inside read files in splits of ``SPLIT_BYTES``, or of the session's own size if that is smaller."""
    return _at_most(spark, _SPLIT, SPLIT_BYTES)


def _write(writer: DataFrameWriter, spark: SparkSession, path: str) -> None:
    """Shuffle files of the job are removed when it ends; its tasks read small splits, and shuffle partitions merged to that size."""
    with _setting(spark, _CLEANUP, "true"), small_splits(spark), _at_most(spark, _MERGED, SPLIT_BYTES):
        writer.option("maxRecordsPerFile", FILE_ROWS).parquet(path)


def save(df: DataFrame, name: str, partition_by: str | None = None, rebalance: bool = False) -> DataFrame:
    """Write ``df`` and read it back.

    ``rebalance`` shuffles the rows once to even out the files of each
    partition: a value that holds much of the data is split over several, and
    rare values do not leave one small file per task. It pays for tables that
    are read many times, not for the largest ones.
    """
    path = _new_path(df, name)
    if partition_by and rebalance:
        df = df.hint("rebalance", partition_by)
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    _write(writer, df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Remove tables that ``save`` returned; nothing may read them any more."""
    for table in tables:
        spark = table.sparkSession
        for file in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(file)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def save_together(tables: Mapping[str, DataFrame]) -> list[DataFrame]:
    """``save`` for tables that do not build on each other; their jobs run side by side and fill each other's gaps."""
    spark = next(iter(tables.values())).sparkSession
    return side_by_side(spark, lambda item: save(item[1], item[0]), tables.items(), threads=len(tables))


def save_parts(df: DataFrame, name: str, by: str, values: Sequence[str]) -> dict[str, DataFrame]:
    """Write ``df`` in one job and read back its rows by the value of one column.

    Each part is read from its own folder, so each has its own size estimate.
    """
    path = _new_path(df, name)
    _write(df.write.partitionBy(by), df.sparkSession, path)
    schema = StructType([field for field in df.schema.fields if field.name != by])
    spark = df.sparkSession

    def part(value: str) -> DataFrame:
        try:
            return spark.read.schema(schema).parquet(f"{path}/{by}={value}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], schema)

    return {value: part(value) for value in values}


def save_split(df: DataFrame, name: str, flag: str) -> tuple[DataFrame, DataFrame]:
    """``save_parts`` for a flag: the rows with it and those without."""
    halves = save_parts(df, name, flag, ["true", "false"])
    return halves["true"], halves["false"]
