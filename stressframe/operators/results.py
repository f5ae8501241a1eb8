"""Operations on result tables: statistics, aggregation by element, histories, extremes.

A result table has element_id, part_id, state_idx, time and a column for each quantity.
Ties go to the first state, then to the least element.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _first_largest(what: str, c: str, sign: int = 1) -> Column:
    return F.max_by(what, F.when(F.col(c).isNotNull(), F.struct(F.col(c) * sign, -F.col("state_idx"), -F.col("element_id"))))


def sample_sd(c: str) -> Column:
    """Sample deviation; 0 of a single value."""
    return F.when(F.count(c) > 0, F.when(F.count(c) > 1, F.stddev_samp(c)).otherwise(0.0))


def statistics(df: DataFrame, c: str, by: tuple[str, ...] = ()) -> DataFrame:
    """min, max, mean, sd, sum, range, median, count, and where the extremes are."""
    return df.groupBy(*by).agg(
        F.min(c).alias("min"), F.max(c).alias("max"), F.avg(c).alias("mean"), sample_sd(c).alias("sd"), F.sum(c).alias("sum"),
        (F.max(c) - F.min(c)).alias("range"), F.percentile(c, 0.5).alias("median"), F.count(c).alias("count"),
        _first_largest("element_id", c).alias("max_element"), _first_largest("state_idx", c).alias("max_state"), _first_largest("time", c).alias("max_time"),
        _first_largest("element_id", c, -1).alias("min_element"), _first_largest("state_idx", c, -1).alias("min_state"), _first_largest("time", c, -1).alias("min_time"),
    )


def melt(df: DataFrame, quantities: list[str]) -> DataFrame:
    """Long form: quantity, value."""
    keys = [c for c in df.columns if c not in quantities]
    return df.unpivot(keys, quantities, "quantity", "value")


def all_statistics(df: DataFrame, quantities: list[str]) -> DataFrame:
    return statistics(melt(df, quantities), "value", ("quantity",))


AGGREGATES = ("max", "min", "mean", "sd", "sum", "count", "range", "median", "last")


def aggregate(c: str, kind: str) -> Column:
    """One of AGGREGATES; 'last' is the value of the latest time."""
    return {
        "max": lambda: F.max(c), "min": lambda: F.min(c), "mean": lambda: F.avg(c), "sd": lambda: sample_sd(c), "sum": lambda: F.sum(c), "count": lambda: F.count(c),
        "range": lambda: F.max(c) - F.min(c), "median": lambda: F.percentile(c, 0.5), "last": lambda: F.max_by(c, F.struct("time", "state_idx")),
    }[kind]()


def by_element(df: DataFrame, c: str, kinds: tuple[str, ...] = AGGREGATES) -> DataFrame:
    times = (_first_largest("time", c).alias("time_of_max"), _first_largest("time", c, -1).alias("time_of_min"))
    return df.groupBy("element_id").agg(*(aggregate(c, k).alias(k) for k in kinds), *times)


def custom(df: DataFrame, c: str, fold: Callable[[Column], Column], by: tuple[str, ...] = ("element_id",)) -> DataFrame:
    """An aggregate of one's own: ``fold`` makes it from the column by built-in aggregates, so it merges in tasks like they do."""
    out = fold(F.col(c)).alias("value")
    return df.groupBy(*by).agg(out) if by else df.agg(out)


def custom_pandas(df: DataFrame, c: str, fold: Callable[[pd.Series], float], by: tuple[str, ...] = ("element_id",)) -> DataFrame:
    """An aggregate that built-in ones can't make: ``fold`` gets all values of a group, as long as a series of states, at once."""

    @F.pandas_udf("double")
    def whole(v: pd.Series) -> float:
        return float(fold(v))

    return df.where(F.col(c).isNotNull()).groupBy(*by).agg(whole(F.col(c).cast("double")).alias("value"))


def scalar(df: DataFrame, c: str, kind: str) -> DataFrame:
    """One value; 0 where there is none."""
    return df.agg(F.coalesce(aggregate(c, kind).cast("double"), F.lit(0.0)).alias("value"))


def distinct(df: DataFrame, c: str) -> DataFrame:
    return df.select(c).distinct()


def spatial_max(df: DataFrame, c: str) -> DataFrame:
    """Largest value of each state."""
    return df.groupBy("state_idx").agg(F.max(c).alias("max"), _first_largest("element_id", c).alias("element_id"))


def find_extreme(df: DataFrame, c: str, largest: bool = True) -> DataFrame:
    """The row of the extreme value (ties: first state, least element)."""
    return df.where(F.col(c).isNotNull()).orderBy(F.desc(c) if largest else F.asc(c), "state_idx", "element_id").limit(1)


def top_n(df: DataFrame, c: str, n: int, largest: bool = True) -> DataFrame:
    """Exactly n rows at most, by a bounded sort in every task."""
    return df.where(F.col(c).isNotNull()).orderBy(F.desc(c) if largest else F.asc(c), "state_idx", "element_id").limit(n)


def history(df: DataFrame, c: str) -> DataFrame:
    """A sorted series for each element; its length is bounded by the number of states."""
    return df.groupBy("element_id").agg(F.sort_array(F.collect_list(F.struct("time", "state_idx", F.col(c).alias("value")))).alias("series"))


def sort_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.orderBy(*keys)
