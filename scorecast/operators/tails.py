"""The last rows of each key as a stored table that new rows are merged into.

A coming week needs the last few rows of each history. Kept as one array a
key, they are brought up to date from the new rows alone, and old seasons need
not be read again. Merging is exact in any order of arrival: the last rows of
two sets lie among the last rows of each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorecast.functions.columns import known, present
from scorecast.operators.windows import Means

TAIL = "tail"


def _last(rows: Column, n: int) -> Column:
    return F.slice(rows, F.greatest(F.size(rows) - n, F.lit(0)) + 1, F.lit(n))


def tails(df: DataFrame, keys: Sequence[str], order: Sequence[str], sources: Sequence[str], longest: int) -> DataFrame:
    """(keys, tail): the last ``longest`` rows of each key, oldest first; rows with a missing key are left out.

    ``order`` must be total within a key. Spark discards rows before the
    shuffle too, so few move however long a history is.
    """
    row = F.struct(*dict.fromkeys([*order, *sources]))
    from_end = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    ranked = df.where(present(*keys)).select(*keys, row.alias("_row"), F.row_number().over(from_end).alias("_from_end"))
    recent = ranked.where(F.col("_from_end") <= longest)
    return recent.groupBy(*keys).agg(F.sort_array(F.collect_list("_row")).alias(TAIL))


def merge_tails(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str], longest: int) -> DataFrame:
    """One table of two from ``tails`` with the same arguments; of rows in the same place the new one counts.

    So a week that arrives again, corrected, replaces its rows as far as they
    are still in the tail.
    """
    both = old.select(*keys, F.col(TAIL).alias("_old")).join(new.select(*keys, F.col(TAIL).alias("_new")), list(keys), "full")

    def place(row: Column) -> Column:
        return F.struct(*[row[c].alias(c) for c in order])

    def none_of(rows: str) -> Column:
        return F.filter(rows, lambda row: F.lit(False))

    filled = both.select(*keys, F.coalesce("_old", none_of("_new")).alias("_old"), F.coalesce("_new", none_of("_old")).alias("_new"))
    kept = F.filter("_old", lambda row: ~F.array_contains(F.transform("_new", place), place(row)))
    merged = filled.select(*keys, F.sort_array(F.concat(kept, F.col("_new"))).alias(TAIL))
    return merged.select(*keys, _last(F.col(TAIL), longest).alias(TAIL))


def tail_means(kept: DataFrame, keys: Sequence[str], means: Means) -> DataFrame:
    """``recent_means`` of the histories behind the tails, computed in each row without a shuffle."""

    def mean(source: str, n: int) -> Column:
        values = F.filter(F.transform(_last(F.col(TAIL), n), lambda row: known(row[source])), lambda v: v.isNotNull())
        return F.try_divide(F.aggregate(values, F.lit(0.0), lambda total, v: total + v.cast("double")), F.size(values))

    return kept.select(*keys, *[mean(source, n).alias(name) for name, (source, n) in means.items()])
