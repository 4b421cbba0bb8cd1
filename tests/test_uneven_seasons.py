from __future__ import annotations

import pytest
from py4j.protocol import Py4JError
from pyspark.errors import PySparkException

from scorecast.errors import EmptySourceError
from scorecast.sources.schemas import columns
from scorecast.sources.tables import read_parquet_table, read_season_folders, season_folders

SCHEMA = columns(text="player", int="season week", double="carries wopr")


@pytest.fixture()
def folders(spark, tmp_path):
    path = str(tmp_path / "weekly")

    def write(season, rows, schema, mode="append"):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode(mode).parquet(f"{path}/season={season}")

    write(2020, [("a", 1, 3.0, 0.5), ("b", 2, float("nan"), None)], "player string, week int, carries double, wopr double")
    write(2021, [("a", 1, 4)], "player string, week int, carries int")
    write(2022, [(7, 1.5, "c", "9")], "carries long, wopr double, player string, week string")
    write(2023, [("d", 1, 3.0, 0.25)], "player string, week int, carries double, wopr double")
    write(2023, [("e", 2, 1.0)], "player string, week int, carries double")
    (tmp_path / "weekly" / "_notes").mkdir()
    return path


def found(df):
    return sorted(tuple(r) for r in df.collect())


WANT = [
    ("a", 2020, 1, 3.0, 0.5),
    ("a", 2021, 1, 4.0, None),
    ("b", 2020, 2, None, None),
    ("c", 2022, 9, 7.0, 1.5),
    ("d", 2023, 1, 3.0, 0.25),
    ("e", 2023, 2, 1.0, None),
]


def test_absent_columns_are_null_and_types_are_those_asked_for(spark, folders):
    df = read_season_folders(spark, folders, SCHEMA)
    assert df.schema.simpleString() == SCHEMA.simpleString() and found(df) == WANT
    assert list(season_folders(spark, folders)) == [2020, 2021, 2022, 2023]


def test_the_plain_reader_cannot_read_them(spark, folders):
    with pytest.raises((PySparkException, Py4JError)):
        read_parquet_table(spark, folders, SCHEMA).collect()


def test_only_wanted_seasons_are_opened(spark, folders):
    df = read_parquet_table(spark, folders, SCHEMA, [2021, 2020, 1900], uneven=True)
    assert found(df) == [row for row in WANT if row[1] in (2020, 2021)]
    assert {f.split("season=")[1][:4] for f in df.inputFiles()} == {"2020", "2021"}


def test_seasons_with_equal_columns_share_a_scan_and_filters_reach_it(spark, folders):
    spark.createDataFrame([("f", 3, 1.0, 0.75)], "player string, week int, carries double, wopr double").write.parquet(f"{folders}/season=2024")
    plan = read_season_folders(spark, folders, SCHEMA, [2020, 2023, 2024]).where("week > 1")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "GreaterThan(week,1)" in plan


def test_no_folder_is_an_error(spark, folders):
    with pytest.raises(EmptySourceError):
        read_season_folders(spark, folders, SCHEMA, [1900])
