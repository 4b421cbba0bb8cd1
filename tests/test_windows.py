from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from scorecast.operators.windows import (
    cut_by_size,
    lagged_means,
    lagged_means_in_blocks,
    latest_present,
    latest_rows,
    recent_means,
    stretches,
)
from scorecast.sources.store import save
from tests.conftest import records

MEANS = {"avg_a": ("a", 3), "avg_b": ("b", 5)}


def history(seed=7, keys=6, weeks=30, hot=True):
    """Rows of several keys; one of them holds a third of all rows. Some values are missing."""
    rng = random.Random(seed)
    rows, row_id = [], 0
    for key in range(keys):
        per_week = (keys - 1) // 2 + 1 if hot and key == 0 else 1
        for season in (2022, 2023):
            for week in range(1, weeks + 1):
                if key and rng.random() < 0.2:
                    continue
                for _ in range(per_week):
                    row_id += 1
                    a = None if rng.random() < 0.1 else float(rng.randint(0, 20))
                    rows.append((f"k{key}", season, week, row_id, a, float(rng.randint(0, 9))))
    rng.shuffle(rows)
    return rows


def expected(rows):
    by_key = defaultdict(list)
    for row in rows:
        by_key[row[0]].append(row)
    found = {}
    for group in by_key.values():
        group.sort(key=lambda r: (r[1], r[2], r[3]))
        for i, row in enumerate(group):

            def mean(column, n, i=i, group=group):
                values = [r[column] for r in group[max(0, i - n) : i] if r[column] is not None]
                return sum(values) / len(values) if values else None

            found[row[3]] = (mean(4, 3), mean(5, 5))
    return found


def assert_means(df, rows):
    got = records(df, "id")
    want = expected(rows)
    assert set(got) == set(want)
    for row_id, (a, b) in want.items():
        assert got[row_id]["avg_a"] == (a if a is None else pytest.approx(a))
        assert got[row_id]["avg_b"] == (b if b is None else pytest.approx(b))


SCHEMA = "k string, season int, week int, id int, a double, b double"


def test_lagged_means_match_brute_force(spark):
    rows = history()
    df = spark.createDataFrame(rows, SCHEMA)
    assert_means(lagged_means(df, ["k"], ["season", "week", "id"], MEANS), rows)


@pytest.mark.parametrize("block", [["season"], ["season", "week"], ["season", "week", "part"]])
def test_blocks_give_the_same_means(spark, block):
    rows = history()
    df = spark.createDataFrame(rows, SCHEMA)
    df = save(df.withColumn("part", stretches(df, "id", 7)), "history")
    assert_means(lagged_means_in_blocks(df, ["k"], block, ["season", "week", "id"], MEANS), rows)


@pytest.mark.parametrize("rows_each", [10**6, 25])
def test_blocks_by_size_spread_a_key_with_half_of_all_rows(spark, rows_each):
    rows = history() + [("hot", 2022, i % 30 + 1, 10_000 + i, float(i % 21), float(i % 10)) for i in range(1_200)]
    rows += [(None, 2023, i % 30 + 1, 20_000 + i, 1.0, 1.0) for i in range(800)]
    order = ["season", "week", "id"]
    df = cut_by_size(save(spark.createDataFrame(rows, SCHEMA), "history"), ["k"], order, rows_each)
    sizes = sorted(r["count"] for r in df.groupBy("k", "block").count().collect())
    share = max(len(rows) / int(spark.conf.get("spark.sql.shuffle.partitions")) if rows_each > len(rows) else rows_each, 1)
    assert sizes[-1] <= 2 * share + 1
    assert df.where("k = 'hot'").select("block").distinct().count() >= 3
    assert df.where("k IS NULL").select("block").distinct().count() >= 2
    means = lagged_means_in_blocks(df, ["k"], ["block"], order, MEANS)
    assert means.where("k IS NULL AND avg_a IS NULL").count() == 800
    assert_means(means.where("k IS NOT NULL"), [r for r in rows if r[0] is not None])


def test_blocks_of_an_empty_table(spark):
    df = cut_by_size(spark.createDataFrame([], SCHEMA), ["k"], ["id"])
    assert lagged_means_in_blocks(df, ["k"], ["block"], ["id"], MEANS).count() == 0


def test_blocks_keep_rows_without_values(spark):
    df = save(spark.createDataFrame([("k", 1, 1, 1, None, 1.0), ("k", 1, 2, 2, None, 2.0)], SCHEMA), "history")
    got = records(lagged_means_in_blocks(df, ["k"], ["season", "week"], ["id"], MEANS), "id")
    assert (got[1]["avg_a"], got[1]["avg_b"]) == (None, None)
    assert (got[2]["avg_a"], got[2]["avg_b"]) == (None, 1.0)


def test_a_row_never_enters_its_own_mean(spark):
    rows = history(keys=2, weeks=6)
    changed = [(*r[:4], 1000.0, 1000.0) if r[3] == 5 else r for r in rows]
    order = ["season", "week", "id"]
    before = records(lagged_means(spark.createDataFrame(rows, SCHEMA), ["k"], order, MEANS), "id")
    after = records(lagged_means(spark.createDataFrame(changed, SCHEMA), ["k"], order, MEANS), "id")
    assert before[5]["avg_a"] == after[5]["avg_a"] and before[5]["avg_b"] == after[5]["avg_b"]
    assert any(before[i]["avg_b"] != after[i]["avg_b"] for i in before)


def test_stretches_keep_order_and_split_evenly(spark):
    df = spark.range(1000).withColumn("part", stretches(spark.range(1000), "id", 8))
    sizes = df.groupBy("part").agg(F.count("*").alias("n"), F.min("id").alias("low"), F.max("id").alias("high"))
    found = sorted(tuple(r) for r in sizes.collect())
    assert len(found) == 8 and max(n for _, n, _, _ in found) <= 160
    assert all(a[3] < b[2] for a, b in zip(found, found[1:], strict=False))


def test_recent_means_equal_the_next_lagged_mean(spark):
    rows = history()
    df = spark.createDataFrame(rows, SCHEMA)
    coming = spark.createDataFrame([(f"k{i}", 2024, 1, 10**6 + i, 0.0, 0.0) for i in range(6)], SCHEMA)
    order = ["season", "week", "id"]
    lagged = records(lagged_means(df.union(coming), ["k"], order, MEANS).where("season = 2024"), "k")
    recent = records(recent_means(df, ["k"], order, MEANS), "k")
    for key, row in recent.items():
        assert row["avg_a"] == pytest.approx(lagged[key]["avg_a"])
        assert row["avg_b"] == pytest.approx(lagged[key]["avg_b"])


def test_latest_rows_and_latest_present(spark):
    df = spark.createDataFrame(
        [("x", 1, 9, 1.0, "old"), ("x", 2, 1, None, None), ("x", 1, 2, 5.0, "older"), ("y", 1, 1, None, "only")],
        "k string, season int, week int, a double, t string",
    )
    last = records(latest_rows(df, ["k"], ["season", "week"]), "k")
    assert (last["x"]["season"], last["x"]["a"], last["x"]["t"]) == (2, None, None)
    present = records(latest_present(df, ["k"], ["season", "week"], ["a", "t"]), "k")
    assert (present["x"]["a"], present["x"]["t"]) == (1.0, "old")
    assert (present["y"]["a"], present["y"]["t"]) == (None, "only")


def test_rows_without_a_key_form_no_group(spark):
    rows = [(None, 1, week, week, float(week), 1.0) for week in range(1, 5)] + [("k", 1, 1, 9, 2.0, 1.0)]
    df = save(spark.createDataFrame(rows, SCHEMA), "history")
    order = ["season", "week", "id"]
    for got in (lagged_means(df, ["k"], order, MEANS), lagged_means_in_blocks(df, ["k"], ["season"], order, MEANS)):
        assert got.count() == 5 and got.where("avg_a IS NOT NULL").count() == 0
    assert [r.k for r in recent_means(df, ["k"], order, MEANS).collect()] == ["k"]
    assert [r.k for r in latest_rows(df, ["k"], order).collect()] == ["k"]
    assert [r.k for r in latest_present(df, ["k"], order, ["a"]).collect()] == ["k"]


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([("k", 1, 1.0, 1.0), ("k", 2, float("nan"), 3.0), ("k", 3, 5.0, 0.0)], "key string, week int, a double, b double")
    got = {r.week: r.avg_a for r in lagged_means(df, ["key"], ["week"], MEANS).collect()}
    assert got == {1: None, 2: 1.0, 3: 1.0}
    assert recent_means(df, ["key"], ["week"], MEANS).first().avg_a == 3.0


def test_nan_is_no_score_and_no_usage(spark):
    from scorecast.functions.columns import scored
    from scorecast.operators.asof import minimum_usage

    nan = float("nan")
    df = spark.createDataFrame([(nan, None, nan), (nan, 1.0, 2.0), (0.0, nan, 0.0)], "avg_carries double, avg_receptions double, c double")
    assert [r.s for r in df.select(scored(F.col("avg_carries"), F.col("avg_receptions")).alias("s")).collect()] == [0, 1, 0]
    assert [r.avg_receptions for r in minimum_usage(df).collect()] == [1.0]
