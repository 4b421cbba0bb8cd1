from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from scorecast.operators.tails import merge_tails, tail_means, tails
from scorecast.operators.windows import recent_means
from tests.conftest import records
from tests.test_windows import MEANS, SCHEMA, history

KEYS, ORDER, SOURCES = ["k"], ["season", "week", "id"], ["a", "b"]


def of(df):
    return tails(df, KEYS, ORDER, SOURCES, 5)


def merged(parts):
    kept = of(parts[0])
    for part in parts[1:]:
        kept = merge_tails(kept, of(part), KEYS, ORDER, 5)
    return kept


def assert_same(kept, df):
    got, want = (records(x, "k") for x in (tail_means(kept, KEYS, MEANS), recent_means(df, KEYS, ORDER, MEANS)))
    assert set(got) == set(want)
    for key, row in want.items():
        for name in MEANS:
            assert got[key][name] == (row[name] if row[name] is None else pytest.approx(row[name]))


@pytest.mark.parametrize("cut", ["week % 4", "season", "pmod(xxhash64(id), 3)"])
def test_merged_parts_equal_the_whole_history(spark, cut):
    df = spark.createDataFrame(history(), SCHEMA)
    parts = [df.where(f"{cut} = {i}") for i in sorted(r[0] for r in df.select(F.expr(cut)).distinct().collect())]
    random.Random(1).shuffle(parts)
    assert_same(merged(parts), df)


def test_a_corrected_row_replaces_the_old_one(spark):
    old = spark.createDataFrame([("k", 1, w, w, float(w), 1.0) for w in range(1, 8)], SCHEMA)
    new = spark.createDataFrame([("k", 1, 7, 7, 100.0, None), ("k", 1, 8, 8, 8.0, 2.0)], SCHEMA)
    kept = merged([old, new])
    assert [(r["week"], r["a"]) for r in kept.first()["tail"]] == [(4, 4.0), (5, 5.0), (6, 6.0), (7, 100.0), (8, 8.0)]
    assert merged([old, old]).collect() == of(old).collect()


def test_missing_keys_values_and_empty_sides(spark):
    df = spark.createDataFrame([(None, 1, 1, 1, 1.0, 1.0), ("k", 1, 1, 2, None, float("nan")), ("n", None, None, 3, 4.0, 2.0)], SCHEMA)
    got = records(tail_means(of(df), KEYS, MEANS), "k")
    assert set(got) == {"k", "n"} and got["k"] == {"k": "k", "avg_a": None, "avg_b": None} and got["n"]["avg_a"] == 4.0
    empty = of(df.limit(0))
    for one, other in ((empty, of(df)), (of(df), empty)):
        assert records(tail_means(merge_tails(one, other, KEYS, ORDER, 5), KEYS, MEANS), "k") == got
    assert merge_tails(empty, empty, KEYS, ORDER, 5).collect() == []


def test_means_need_no_shuffle(spark):
    kept = of(spark.createDataFrame(history(), SCHEMA))
    before = kept._jdf.queryExecution().optimizedPlan().toString().count("Window")
    plan = tail_means(kept, KEYS, MEANS)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") == before and plan.count("Aggregate") == kept._jdf.queryExecution().optimizedPlan().toString().count("Aggregate")
