from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from checks.registry import shown
from scorecast.functions import columns as fn
from scorecast.sources.store import save


def values(spark, schema, data, *expressions):
    df = spark.createDataFrame(data, schema)
    return [tuple(row) for row in df.select(*expressions).collect()]


def test_numbers_from_text(spark):
    data = [("1.0",), ("Wildcard",), (None,), ("",), (" 7 ",), ("NaN",), ("-3.5",)]
    got = values(spark, "t string", data, fn.try_number(F.col("t")), fn.try_whole(F.col("t")))
    assert got == [(1.0, 1), (None, None), (None, None), (None, None), (7.0, 7), (None, None), (-3.5, -3)]


def test_share_of_nothing_is_zero(spark):
    data = [(1.0, 4.0), (0.0, 0.0), (2.0, 0.0), (None, 3.0), (1.0, None)]
    got = values(spark, "a double, b double", data, fn.share(F.col("a"), F.col("b")))
    assert [g[0] for g in got] == [0.25, 0.0, 0.0, 0.0, 0.0]


def test_total_skips_missing_and_is_zero_without_values(spark):
    nan = float("nan")
    df = spark.createDataFrame([("a", 1.0), ("a", nan), ("a", None), ("b", nan), ("b", None)], "k string, v double")
    got = {r.k: r.t for r in df.groupBy("k").agg(fn.total(F.col("v")).alias("t")).collect()}
    assert got == {"a": 1.0, "b": 0.0}


def test_home_spread_and_implied_totals(spark):
    data = [("A", "A", -3.5, 47.0), ("B", "A", -3.5, 47.0), (None, "A", -3.5, 47.0), ("A", None, -3.5, 47.0)]
    spread = fn.home_spread(F.col("fav"), F.col("home"), F.col("s"))
    got = values(
        spark,
        "fav string, home string, s double, t double",
        data,
        spread,
        fn.implied_total(F.col("t"), spread) + fn.implied_total(F.col("t"), -spread),
    )
    assert [g[0] for g in got] == [-3.5, 3.5, 3.5, 3.5]
    assert all(g[1] == pytest.approx(47.0) for g in got)


def test_label(spark):
    nan = float("nan")
    data = [(0.0, 1.0), (1.0, None), (None, None), (0.0, 0.0), (None, 2.0)]
    got = values(spark, "a double, b double", data, fn.scored(F.col("a"), F.col("b")))
    assert [g[0] for g in got] == [1, 1, 0, 0, 1]
    cleaned = fn.scored(fn.nan_to_null(F.col("a")), fn.nan_to_null(F.col("b")))
    assert values(spark, "a double, b double", [(nan, nan), (nan, 1.0)], cleaned) == [(0,), (1,)]


def test_american_prices(spark):
    data = [(-190,), (100,), (-100,), (0,), (250,), (None,), (4000,)]
    got = [g[0] for g in values(spark, "p int", data, fn.american_to_probability(F.col("p")))]
    assert got[:5] == pytest.approx([0.655172, 0.5, 0.5, 0.0, 0.285714], abs=1e-6)
    assert got[5] is None
    assert got[6] == pytest.approx(100 / 4100)


def test_name_keys(spark):
    names = {
        "Marvin Harrison Jr.": "marvin harrison",
        "Ja'Marr Chase": "jamarr chase",
        "Michael Woods II": "michael woods",
        "A.J. Brown ": "aj brown",
        "Kenneth Walker III": "kenneth walker",
        "Iv Iverson": "iv iverson",
        "Sr": "sr",
        "Philadelphia Eagles D/ST": "philadelphia eagles dst",
    }
    got = values(spark, "n string", [(n,) for n in names], "n", fn.name_key(F.col("n")))
    assert dict(got) == names


def test_steps_reached_counts_thresholds(spark):
    steps = [i / 100 for i in range(20, 70)]
    data = [(x / 1000,) for x in range(0, 1001)] + [(s,) for s in steps] + [(None,)]
    got = values(spark, "p double", data, "p", fn.steps_reached(F.col("p"), steps))
    for p, reached in got:
        assert reached == (0 if p is None else sum(p >= s for s in steps))


def test_fill_leaves_text_and_keys(spark):
    df = spark.createDataFrame([(None, None, None, None)], "k int, a double, b int, t string")
    assert tuple(fn.fill_missing(df, keys=["k"]).first()) == (None, 0.0, 0, None)
    assert tuple(fn.fill_missing(df, ["a"]).first()) == (None, 0.0, None, None)


def test_ensure_columns(spark):
    df = spark.createDataFrame([(1,)], "a int")
    assert fn.ensure_columns(df, ["a", "b"]).first().asDict() == {"a": 1, "b": 0.0}


def test_name_keys_agree_with_plain_regular_expressions(spark):
    rng = random.Random(5)
    pieces = ["De'Von", "A.J.", "St. Brown", "Smith-Njigba", "Jr", "jr.", "Sr.", "II", "III", "IV", "V"]
    pieces += ["  ", "O’Neal", "X2", "é", "\t"]
    names = sorted({" ".join(rng.choice(pieces) for _ in range(rng.randint(1, 4))) for _ in range(500)})
    for name, key in values(spark, "n string", [(n,) for n in names], "n", fn.name_key(F.col("n"))):
        kept = re.sub(r"[^a-z0-9\s]", "", name.lower())
        assert key == re.sub(r"\s(jr|sr|ii|iii|iv)$", "", kept).strip(), name


def test_probabilities_of_all_prices(spark):
    got = values(spark, "p int", [(p,) for p in range(-2000, 2001)], "p", fn.american_to_probability(F.col("p")))
    for price, probability in got:
        want = 0.0 if price == 0 else 100 / (price + 100) if price > 0 else -price / (100 - price)
        assert probability == pytest.approx(want) and 0.0 <= probability < 1.0


def test_rounded_is_sparks_rounding(spark):
    edges = [None, float("nan"), float("inf"), -float("inf"), 0.0, -0.0, 5e-7, -5e-7, 4.9999e-7, -1e-7, 5e-324]
    edges += [0.0000015, 1.0000025, -2.6750005, 1.005, 1 / 3, 999_999.9999995, 1e6, 123_456_789.123_456_5, -1.7e308]
    ties = [(2 * i + 1) / 2e6 * side for i in range(0, 3_000_000, 1_009) for side in (1, 1 + 1e-15, -1, 1 - 1e-15)]
    rows = spark.createDataFrame([(x,) for x in edges + ties + [i / 7 for i in range(-5_000, 5_000)]], "x double")
    for digits in (0, 4, 6):
        # As text, where -0.0 is not 0.0.
        got, wanted = fn.rounded(F.col("x"), digits), F.round("x", digits) + F.lit(0.0)
        assert rows.where(~got.cast("string").eqNullSafe(wanted.cast("string"))).count() == 0


def test_rounding_of_many_columns_stays_short_enough_to_be_compiled(spark):
    numbers = spark.range(100).select(*[F.rand(i).alias(f"c{i}") for i in range(60)])
    asked = shown(save(numbers, "numbers"))
    code = spark._jvm.PythonSQLUtils.explainString(asked._jdf.queryExecution(), "codegen")
    rounding = re.findall(r"private void \w*subExpr_\d+\(", code)
    assert len(set(rounding)) >= 60  # a method for each column; HotSpot leaves methods above 8,000 bytes uncompiled
