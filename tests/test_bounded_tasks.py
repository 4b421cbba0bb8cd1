"""What a task reads and keeps does not grow with the input."""

from __future__ import annotations

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from scorecast.operators.models import VECTOR, Learner, assemble
from scorecast.operators.play_sums import play_sums
from scorecast.sources import store
from scorecast.sources.store import save, save_parts, small_splits
from tests.test_plays import SCHEMA, play

SPLIT = "spark.sql.files.maxPartitionBytes"
MERGED = "spark.sql.adaptive.advisoryPartitionSizeInBytes"


@pytest.fixture
def tiny(monkeypatch):
    monkeypatch.setattr(store, "FILE_ROWS", 100)
    monkeypatch.setattr(store, "SPLIT_BYTES", 4096)


def file_rows(df):
    return [r["count"] for r in df.groupBy(F.input_file_name()).count().collect()]


def test_files_of_stored_tables_have_a_bounded_number_of_rows(spark, tiny):
    rows = spark.range(0, 1_000, 1, 1).withColumn("kind", (F.col("id") % 2).cast("string"))
    tables = [save(rows, "rows"), save(rows, "even", partition_by="kind", rebalance=True)]
    tables += save_parts(rows, "parts", "kind", ["0", "1"]).values()
    assert [t.count() for t in tables] == [1_000, 1_000, 500, 500]
    assert all(max(file_rows(t)) <= 100 for t in tables)


def test_the_setting_comes_back_and_a_smaller_one_stays(spark):
    before = spark.conf.get(SPLIT)
    with small_splits(spark):
        with small_splits(spark):
            assert int(spark.conf.get(SPLIT)) == store.SPLIT_BYTES
        assert int(spark.conf.get(SPLIT)) == store.SPLIT_BYTES
    assert spark.conf.get(SPLIT) == before
    spark.conf.set(SPLIT, "1m")
    try:
        with small_splits(spark):
            assert int(spark.conf.get(SPLIT)) == 1 << 20
        assert spark.conf.get(SPLIT) == "1m"
    finally:
        spark.conf.set(SPLIT, before)


class Counting:
    """In place of an estimator: the rows of each partition that a fit would keep."""

    def __init__(self, **params):
        pass

    def fit(self, df):
        return df.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()


def test_a_fit_keeps_a_bounded_number_of_rows_per_task(spark, tiny):
    rows = spark.range(0, 2_000, 1, 1).select((F.col("id") % 2).alias("y"), F.rand(1).alias("a"), F.rand(2).alias("b"))
    stored = save(assemble(rows, ["a", "b"]).select(VECTOR, "y"), "fit-rows")
    kept = Learner("counting", Counting, "balanced", {}).fit(stored, "y", {})
    assert sum(kept) == 2_000 and max(kept) <= 200


def test_sums_of_plays_are_combined_in_small_tasks(spark, tiny, monkeypatch):
    plays = [play("A", "B", 1 + i % 4, 1.0, float(i % 30), f"r{i}", None) for i in range(1_000)]
    stored = save(spark.createDataFrame(plays, SCHEMA).coalesce(1), "plays")
    asked = []
    write = DataFrameWriter.parquet
    monkeypatch.setattr(
        DataFrameWriter,
        "parquet",
        lambda self, path: (asked.append([spark.conf.get(s) for s in (SPLIT, MERGED)]), write(self, path))[1],
    )
    shares = play_sums(stored).usage_share()
    assert shares.count() == sum(1 for i in range(1_000) if i % 30 <= 20)
    assert asked == [["4096", "4096"]]
    with small_splits(spark):
        assert stored.select("*").rdd.getNumPartitions() >= 5
