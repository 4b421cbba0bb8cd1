"""Parquet and CSV readers, the CSV sink and source guards."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, FloatType, IntegerType, StringType, StructField, StructType

from scorecast.errors import DuplicateKeyError, EmptySourceError
from scorecast.functions.columns import nan_to_null, try_number
from scorecast.sources import schemas


def _quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def _typed(table: DataFrame, schema: StructType, raw: Sequence[str], absent: bool = False) -> DataFrame:
    """The columns of ``schema``; with ``absent``, those the table lacks are NULL."""
    columns = []
    for field in schema.fields:
        if absent and field.name not in table.columns:
            columns.append(F.lit(None).cast(field.dataType).alias(field.name))
            continue
        column = _quoted(field.name).cast(field.dataType)
        if isinstance(field.dataType, (DoubleType, FloatType)) and field.name not in raw:
            column = nan_to_null(column)
        columns.append(column.alias(field.name))
    return table.select(*columns)


def season_folders(spark: SparkSession, path: str) -> dict[int, str]:
    """The folders ``season=...`` in ``path`` by season, in order."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = root.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(root)
    names = [(status.getPath().getName(), status.getPath().toString()) for status in found if status.isDirectory()]
    seasons = {name.removeprefix("season="): folder for name, folder in names if name.startswith("season=")}
    return {int(season): folder for season, folder in sorted(seasons.items()) if season.isdecimal()}


def read_season_folders(
    spark: SparkSession,
    path: str,
    schema: StructType,
    seasons: Sequence[int] | None = None,
    raw: Sequence[str] = (),
) -> DataFrame:
    """``read_parquet_table`` where seasons differ in their columns and types.

    Every folder is read with the columns and types of its own files, so a
    number may be whole in one season and not in the next; a column that a
    season lacks is NULL there. Seasons with equal columns share a scan. Only
    the folders of ``seasons`` are opened, and filters reach each scan.
    """
    folders = {s: f for s, f in season_folders(spark, path).items() if seasons is None or s in set(seasons)}
    if not folders:
        raise EmptySourceError(f"no season folders in {path}")
    alike: dict[str, tuple[StructType, list[str]]] = {}
    for folder in folders.values():
        # Files of one season may lack columns too; the union of theirs counts.
        found = spark.read.option("mergeSchema", True).parquet(folder).schema
        alike.setdefault(StructType(sorted(found, key=lambda f: f.name)).simpleString(), (found, []))[1].append(folder)
    parts = []
    for found, group in alike.values():
        whole = StructType([*[f for f in found if f.name != "season"], StructField("season", IntegerType())])
        table = spark.read.schema(whole).option("basePath", path).parquet(*group)
        parts.append(_typed(table, schema, raw, absent=True))
    return reduce(DataFrame.unionByName, parts)


def read_parquet_table(
    spark: SparkSession,
    path: str,
    schema: StructType,
    seasons: Sequence[int] | None = None,
    raw: Sequence[str] = (),
    uneven: bool = False,
) -> DataFrame:
    """The columns of ``schema``, limited to ``seasons``; NaN becomes NULL.

    Columns in ``raw`` keep their NaN so that a filter on them reaches the
    Parquet reader. Where season is a partition column its filter prunes
    folders. ``uneven`` is for season folders with columns or types of their own.
    """
    if uneven:
        return read_season_folders(spark, path, schema, seasons, raw)
    table = spark.read.parquet(path)
    if seasons is not None:
        table = table.where(F.col("season").isin(list(seasons)))
    return _typed(table, schema, raw)


def read_weekly(spark: SparkSession, path: str, seasons: Sequence[int] | None = None, uneven: bool = False) -> DataFrame:
    return read_parquet_table(spark, path, schemas.WEEKLY, seasons, uneven=uneven)


def read_plays(
    spark: SparkSession, path: str, seasons: Sequence[int] | None = None, last_week: int = 18, uneven: bool = False
) -> DataFrame:
    """Plays up to ``last_week``. A NaN yard line lies outside every zone as it is."""
    plays = read_parquet_table(spark, path, schemas.PLAYS, seasons, raw=["yardline_100"], uneven=uneven)
    return plays.where(F.col("week") <= last_week)


def read_rosters(spark: SparkSession, path: str, seasons: Sequence[int] | None = None, uneven: bool = False) -> DataFrame:
    return read_parquet_table(spark, path, schemas.ROSTERS, seasons, uneven=uneven)


def read_schedule(spark: SparkSession, path: str, seasons: Sequence[int] | None = None, uneven: bool = False) -> DataFrame:
    return read_parquet_table(spark, path, schemas.SCHEDULE, seasons, uneven=uneven)


def _parsed(field: StructField) -> Column:
    column = _quoted(field.name)
    if isinstance(field.dataType, StringType):
        return column
    if isinstance(field.dataType, BooleanType):
        return column.try_cast("boolean")
    return try_number(column).try_cast(field.dataType)


def read_csv_table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The columns of ``schema`` by header name, whatever else the file holds.

    A schema handed to the CSV reader would bind by position, so the file is
    read as text; a field that does not parse becomes NULL.
    """
    table = spark.read.option("header", True).csv(path)
    return table.select(*[_parsed(field).alias(field.name) for field in schema.fields])


def read_historical_odds(spark: SparkSession, path: str) -> DataFrame:
    return read_csv_table(spark, path, schemas.HISTORICAL_ODDS)


def read_teams(spark: SparkSession, path: str) -> DataFrame:
    return read_csv_table(spark, path, schemas.TEAMS)


def read_upcoming_lines(spark: SparkSession, path: str) -> DataFrame:
    return read_csv_table(spark, path, schemas.UPCOMING_LINES)


def read_prices(spark: SparkSession, path: str) -> DataFrame:
    return read_csv_table(spark, path, schemas.PRICES)


def predictions_path(folder: str, season: int, week: int) -> str:
    return f"{folder.rstrip('/')}/final_predictions_{season}_week_{week}"


def write_csv(df: DataFrame, path: str) -> str:
    """Overwrite ``path`` with CSV part files that carry a header."""
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def write_predictions(df: DataFrame, folder: str, season: int, week: int) -> str:
    return write_csv(df, predictions_path(folder, season, week))


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """``df`` itself, or an error if it is empty; stops at the first row found."""
    if df.isEmpty():
        raise EmptySourceError(f"no rows in {what}")
    return df


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every key with more than one row, and how many it has."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def require_unique(df: DataFrame, keys: Sequence[str], what: str) -> DataFrame:
    """``df`` itself, or an error naming a few of the keys that repeat."""
    repeated = duplicate_keys(df, keys).limit(5).collect()
    if repeated:
        shown = ", ".join(str(tuple(row)[:-1]) for row in repeated)
        raise DuplicateKeyError(f"{what} is not unique by {', '.join(keys)}; for example {shown}")
    return df
