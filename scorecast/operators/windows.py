"""Means over the rows before each row, and over the last rows of a history."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from scorecast.functions.columns import known, present, steps_reached
from scorecast.sources.store import save

# Result column -> (source column, how many earlier rows).
Means = Mapping[str, tuple[str, int]]


def _mean_columns(means: Means, window: WindowSpec, keys: Sequence[str]) -> list[Column]:
    """The means; rows with a missing key belong to no group and get none."""
    return [
        F.when(present(*keys), F.avg(known(F.col(source))).over(window.rowsBetween(-n, -1))).alias(name)
        for name, (source, n) in means.items()
    ]


def lagged_means(df: DataFrame, keys: Sequence[str], order: Sequence[str], means: Means) -> DataFrame:
    """Mean of up to n rows before each row; the row itself never counts, nor does a missing number or NaN.

    All columns share one shuffle and one sort. A key's rows go to one task,
    so use it at a grain that bounds them: a player or team has one row per
    team and week, whatever the number of plays behind it. ``order`` must be
    total within a key. Where a key's rows are unbounded, use
    ``lagged_means_in_blocks``. Rows with a missing key are spread by a hash
    of their order, so that they do not meet in one task.
    """
    apart = F.when(~present(*keys), F.xxhash64(*order))
    window = Window.partitionBy(*keys, apart).orderBy(*order)
    return df.select("*", *_mean_columns(means, window, keys))


def lagged_means_in_blocks(
    df: DataFrame, keys: Sequence[str], block: Sequence[str], order: Sequence[str], means: Means
) -> DataFrame:
    """``lagged_means`` for keys with any number of rows.

    ``block`` names columns that cut a key's rows into consecutive stretches
    of its order: every row of a lower block comes before every row of a
    higher one. A task then sorts one block instead of a whole key. Each block
    borrows the last rows before it, at most n, from the blocks before, so the
    result is exact. ``df`` is read twice; pass a stored table.
    """
    longest = max(n for _, n in means.values())
    sources = sorted({source for source, _ in means.values()})
    part = [*keys, *block]

    # The last rows of each block, oldest first. Spark applies the row limit
    # before the shuffle too, so few rows move however many a block has.
    from_end = Window.partitionBy(*part).orderBy(*[F.desc(c) for c in order])
    tails = (
        df.where(present(*keys))
        .select(*part, *sources, F.row_number().over(from_end).alias("_from_end"))
        .where(F.col("_from_end") <= longest)
        .groupBy(*part)
        .agg(F.sort_array(F.collect_list(F.struct((-F.col("_from_end")).alias("_place"), *sources))).alias("_tail"))
    )
    # One row per block from here on: the n blocks before hold n rows, or all there are.
    before = Window.partitionBy(*keys).orderBy(*block).rowsBetween(-longest, -1)
    earlier = tails.select(*part, F.flatten(F.collect_list("_tail").over(before)).alias("_earlier"))
    start = F.greatest(F.size("_earlier") - longest, F.lit(0)) + 1
    borrowed = earlier.select(
        *part, F.posexplode(F.slice("_earlier", start, F.lit(longest))).alias("_rank", "_row")
    ).select(*part, "_rank", *[F.col(f"_row.{c}").alias(c) for c in sources])

    together = df.withColumn("_rank", F.lit(longest)).unionByName(borrowed, allowMissingColumns=True)
    window = Window.partitionBy(*part).orderBy("_rank", *order)
    return together.select("*", *_mean_columns(means, window, keys)).where(F.col("_rank") == longest).drop("_rank")


def stretches(df: DataFrame, column: str, n: int) -> Column:
    """Up to n consecutive ranges of a numeric column with about equally many rows each, for use as a block.

    The driver reads the n - 1 cut points, nothing else.
    """
    found = df.agg(F.percentile_approx(column, [i / n for i in range(1, n)], F.lit(100 * n)).alias("cuts")).first()
    return steps_reached(F.col(column), sorted(set(found["cuts"] or [])))


BLOCK_ROWS = 1_000_000


def cut_by_size(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], rows: int = BLOCK_ROWS, column: str = "block"
) -> DataFrame:
    """``df``, stored, with a ``column`` of consecutive blocks of about ``rows`` rows each, for ``lagged_means_in_blocks``.

    Rows are range-partitioned by keys and order, and the partition is the
    block: a key with few rows lies in one, a key with half of all rows fills
    half of them, and rows with a missing key are cut like any other. Cuts
    come from Spark's sample of the ranges, so sizes are about equal. There are
    never fewer blocks than shuffle partitions. Equal rows of a key stay
    together, so ``order`` should be total within a key.
    """
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // rows))
    return save(df.repartitionByRange(parts, *keys, *order).withColumn(column, F.spark_partition_id()), "blocks")


def recent_means(df: DataFrame, keys: Sequence[str], order: Sequence[str], means: Means) -> DataFrame:
    """Mean of the last n rows of each key: the lagged mean its next row would get."""
    longest = max(n for _, n in means.values())
    sources = sorted({source for source, _ in means.values()})
    from_end = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    ranked = df.where(present(*keys)).select(*keys, *sources, F.row_number().over(from_end).alias("_from_end"))
    recent = ranked.where(F.col("_from_end") <= longest)
    return recent.groupBy(*keys).agg(
        *[F.avg(F.when(F.col("_from_end") <= n, known(F.col(source)))).alias(name) for name, (source, n) in means.items()]
    )


def latest_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key; rows are discarded before the shuffle as well."""
    from_end = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    ranked = df.where(present(*keys)).withColumn("_from_end", F.row_number().over(from_end))
    return ranked.where(F.col("_from_end") == 1).drop("_from_end")


def latest_present(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The last value of each column that is not missing, per key."""
    place = F.struct(*order)
    return df.where(present(*keys)).groupBy(*keys).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), place)).alias(c) for c in columns]
    )
