"""Column expressions; all of them stay inside whole-stage codegen."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType


def nan_to_null(column: Column) -> Column:
    return F.nanvl(column, F.lit(None).cast("double"))


def try_number(column: Column) -> Column:
    """Text to double; text that is no number becomes NULL."""
    return nan_to_null(column.try_cast("double"))


def try_whole(column: Column) -> Column:
    """Text to bigint by way of double, since '1.0' is no integer literal."""
    return try_number(column).try_cast("bigint")


def amount(column: Column) -> Column:
    """A summable double: NaN and NULL count as nothing."""
    return F.coalesce(nan_to_null(column.cast("double")), F.lit(0.0))


def total(column: Column) -> Column:
    """Sum that is 0 when every value is missing."""
    return F.coalesce(F.sum(nan_to_null(column.cast("double"))), F.lit(0.0))


def is_one(column: Column) -> Column:
    """Flag test that takes a missing flag as not set."""
    return F.coalesce(column == F.lit(1), F.lit(False))


def share(part: Column, whole: Column) -> Column:
    """part/whole, or 0 when either is missing or the whole is 0."""
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def rate(successes: Column, trials: Column) -> Column:
    return F.try_divide(successes, trials)


def implied_total(total_line: Column, spread_line: Column) -> Column:
    """Points a team is expected to score; a favourite has a negative spread."""
    return total_line / F.lit(2.0) - spread_line / F.lit(2.0)


def home_spread(favourite: Column, home: Column, spread: Column) -> Column:
    """The favourite's spread seen from the home side; without a favourite the sign flips."""
    return F.when(favourite == home, spread).otherwise(-spread)


def known(number: Column) -> Column:
    """The number, or null for NaN, which would sort above every number."""
    return F.when(~F.isnan(number), number)


def rounded(number: Column, digits: int) -> Column:
    """``round(number, digits) + 0.0`` for a double, without a decimal number where the result is certain.

    Away from a tie the nearest whole number of units is the result whatever
    the rounding of the product; near one, for large numbers and for NaN and
    infinities Spark's own rounding decides. The two halves are one common
    expression, which Spark compiles as a method of its own: written out for
    dozens of columns in one method, it would be too long for the JIT.
    """
    units = number * F.lit(float(10**digits))
    whole = F.rint(units)
    certain = (F.abs(units - whole) < F.lit(0.499)) & (F.abs(units) < F.lit(1e12))
    half = (F.when(certain, whole / F.lit(float(10**digits))).otherwise(F.round(number, digits)) + F.lit(0.0)) * F.lit(0.5)
    return half + half


def scored(rushing_tds: Column, receiving_tds: Column) -> Column:
    """1 if either count is above 0, else 0; NaN counts as missing."""
    return F.coalesce(F.greatest(known(rushing_tds), known(receiving_tds)) > 0, F.lit(False)).cast("int")


def american_to_probability(price: Column) -> Column:
    """Implied probability of an American price; a price of 0 gives 0."""
    p = price.cast("double")
    return (
        F.when(p > 0, F.lit(100.0) / (p + F.lit(100.0)))
        .when(p < 0, F.abs(p) / (F.abs(p) + F.lit(100.0)))
        .when(p == 0, F.lit(0.0))
    )


def edge(model_probability: Column, market_probability: Column) -> Column:
    return model_probability - market_probability


def name_key(name: Column) -> Column:
    """Names in a form that two providers agree on."""
    # The characters kept and the generational suffixes removed.
    kept = F.regexp_replace(F.lower(name), r"[^a-z0-9\s]", "")
    unsuffixed = F.regexp_replace(kept, r"\s(jr|sr|ii|iii|iv)$", "")
    return F.regexp_replace(unsuffixed, r"^\s+|\s+$", "")


def steps_reached(value: Column, steps: Sequence[float]) -> Column:
    """How many of the ascending ``steps`` are <= value, by a balanced tree of comparisons."""

    def between(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(value >= F.lit(float(steps[middle])), between(middle + 1, high)).otherwise(between(low, middle))

    return between(0, len(steps))


def present(*names: str) -> Column:
    """True where none of the columns is missing."""
    condition = F.lit(True)
    for name in names:
        condition = condition & F.col(name).isNotNull()
    return condition


def fill_missing(df: DataFrame, columns: Sequence[str] | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """0 for missing numbers, in ``columns`` or everywhere but in ``keys``; text is left alone.

    Keys stay as they are: a missing key is no key 0, and a rewritten key
    column would lose the partitioning that a later join could use.
    """
    numeric = [
        field.name
        for field in df.schema.fields
        if isinstance(field.dataType, NumericType)
        and field.name not in keys
        and (columns is None or field.name in columns)
    ]
    return df.na.fill(0, subset=numeric) if numeric else df


def ensure_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``df`` with each absent column added as 0."""
    absent = [name for name in columns if name not in df.columns]
    return df.select("*", *[F.lit(0.0).alias(name) for name in absent])
