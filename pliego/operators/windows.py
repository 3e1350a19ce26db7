"""Neighbourhoods in time: moving sums, buckets from a group's first day, and changes between neighbours.

All of them count rows by day first. A group then has as many rows as it has days, however many events fall on them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def around(df: DataFrame, keys: Sequence[str], date: str, days: int, amount: str, count_name: str, sum_name: str) -> DataFrame:
    """df with the number of rows and the sum of `amount` of the same keys from `days` before to `days` after each row's date."""
    daily = df.groupBy(*keys, date).agg(F.count("*").alias("_n"), F.sum(amount).alias("_sum"))
    near = Window.partitionBy(*keys).orderBy(F.unix_date(date)).rangeBetween(-days, days)
    moving = daily.select(*keys, date, F.sum("_n").over(near).alias(count_name), F.sum("_sum").over(near).alias(sum_name))
    return df.join(moving, [*keys, date])


def buckets(df: DataFrame, keys: Sequence[str], date: str, days: int, name: str = "bucket", first: DataFrame | None = None) -> DataFrame:
    """df with the number, from 0, of the stretch of `days` from its group's first day in which each row lies.

    first: keys and first, where the groups' first days are known already.
    """
    first = df.groupBy(*keys).agg(F.min(date).alias("first")) if first is None else first
    own = first.withColumnRenamed("first", "_begin")
    return df.join(own, list(keys)).withColumn(name, F.floor(F.datediff(date, "_begin") / days).cast("int")).drop("_begin")


def switches_within_days(df: DataFrame, keys: Sequence[str], who: str, date: str, tie: str) -> DataFrame:
    """keys, date, _n, _inside, _first, _last: each day's rows, its changes by `tie`, and who comes first and last."""
    day = Window.partitionBy(*keys, date).orderBy(tie, who)
    inside = df.select(*keys, date, tie, who, (F.col(who) != F.lag(who).over(day)).alias("_changed"))
    order = F.struct(tie, who)
    return inside.groupBy(*keys, date).agg(F.count("*").alias("_n"), F.count_if("_changed").alias("_inside"), F.min_by(who, order).alias("_first"), F.max_by(who, order).alias("_last"))


def switches_between_days(daily: DataFrame, keys: Sequence[str], date: str) -> DataFrame:
    """keys, n and n_switches from the days' own counts, which may have been given further keys meanwhile."""
    between = F.col("_first") != F.lag("_last").over(Window.partitionBy(*keys).orderBy(date))
    return daily.withColumn("_between", between).groupBy(*keys).agg(F.sum("_n").alias("n"), (F.sum("_inside") + F.count_if("_between")).alias("n_switches"))


def switches(df: DataFrame, keys: Sequence[str], who: str, date: str, tie: str) -> DataFrame:
    """keys, n and n_switches: how often `who` differs from the row before it, by date and `tie`.

    Changes within a day are counted day by day; between days only each day's first and last row count.
    """
    return switches_between_days(switches_within_days(df, keys, who, date, tie), keys, date)
