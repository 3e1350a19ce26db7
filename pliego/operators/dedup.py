"""One row per key, by a stated order.

Each is a row number with a limit of one, which Spark limits per task before it shuffles: a key that holds a third of all rows
sends one row per task, not a third of the table to one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key by order. Rows that the order can't tell apart must be alike in what is used later."""
    own = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(own)).where("_rn = 1").drop("_rn")


def keep_latest(df: DataFrame, keys: Sequence[str], *newest: str) -> DataFrame:
    """The row of each non-null key with the largest values of `newest`, nulls last."""
    some = df.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
    return keep_first(some, keys, [F.col(f"`{c}`").desc_nulls_last() for c in newest])


def top_per_group(df: DataFrame, groups: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The n first rows of each group with their position, from 1."""
    return df.withColumn("position", F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).where(F.col("position") <= n)


def mode_per_key(df: DataFrame, keys: Sequence[str], col: str, nulls: bool = False) -> DataFrame:
    """keys and the most frequent value of col; ties go to the smaller value, null after all others."""
    used = df if nulls else df.where(F.col(col).isNotNull())
    counted = used.groupBy(*keys, col).agg(F.count("*").alias("_n"))
    return keep_first(counted, keys, [F.col("_n").desc(), F.col(col).asc_nulls_last()]).drop("_n")
