"""Quantiles from sketches that are kept and merged: one for each group, from which those of larger groups follow without the rows. And keys of many rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size of a sketch. Its rank error is 2.3 / K ** 0.9 with a certainty of 99 %, merged or not, under half of RANK_ERROR.
K = 2048
#: An estimated quantile's rank is off by this share of the rows at most, but for chances beyond 1 in 10^6.
RANK_ERROR = 0.006


#: So many keys of many rows are looked for, by a sketch that tracks so many keys.
OFTEN, TRACKED = 100, 10_000


def repeated(df: DataFrame, key: Column, least: int) -> list:
    """The keys that may have `least` rows or more: OFTEN at most. It may name others too, so that no result may hang on it."""
    rows = df.select(key.alias("_key")).where("_key IS NOT NULL")
    top = rows.agg(F.expr(f"approx_top_k(_key, {OFTEN}, {TRACKED})").alias("top")).first()["top"]
    return [x["item"] for x in top or () if x["count"] >= least]


def quantile_sketches(df: DataFrame, value: Column, by: Sequence[str | Column], k: int = K) -> DataFrame:
    """(by, n, sketch): one sketch a group, of the values that are not null or NaN; a group without any has none and is left out.

    Tasks sketch what they have and send sketches of some 20 kB, so a group that holds most rows costs what any other does.
    """
    own = value.cast("double")
    rows = df.withColumn("_value", own).where(F.col("_value").isNotNull() & ~F.isnan("_value"))
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.kll_sketch_agg_double("_value", k).alias("sketch"))


def merged(sketches: DataFrame, by: Sequence[str], k: int = K) -> DataFrame:
    """The sketches of larger groups, or of everything where `by` is empty."""
    return sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", k).alias("sketch")).where("n > 0")


def quantiles(sketches: DataFrame, shares: Sequence[float]) -> DataFrame:
    """Columns of sketches but the sketch, with share and value: the estimated quantile at each share. Shares 0 and 1 are the exact ends."""
    values = F.kll_sketch_get_quantile_double("sketch", F.array(*[F.lit(float(s)) for s in shares]))
    items = F.arrays_zip(F.array(*[F.lit(float(s)) for s in shares]).alias("share"), values.alias("value"))
    kept = [c for c in sketches.columns if c != "sketch"]
    return sketches.select(*kept, F.explode(items).alias("_item")).select(*kept, F.col("_item.share").alias("share"), F.col("_item.value").alias("value"))
