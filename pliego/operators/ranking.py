"""Positions and running sums over a whole table without one task that sees it all, and what is derived from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pliego.session import cut


def running_total(df: DataFrame, value: Column, order: Sequence[Column], name: str = "total") -> DataFrame:
    """df with the sum of value over all rows up to and including each, by order, which has to tell all rows apart.

    The table is sorted across the cluster and written; each range's own running sum then starts from the sum of the ranges
    before it. Only one sum per range meets in one task.
    """
    ranged = cut(df.withColumn("_value", value).orderBy(*order).withColumn("_row", F.monotonically_increasing_id()))
    ranged = ranged.withColumn("_range", F.shiftrightunsigned("_row", 33))
    sums = ranged.groupBy("_range").agg(F.sum("_value").alias("_sum"))
    before = sums.select("_range", F.coalesce(F.sum("_sum").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.sum("_value").over(Window.partitionBy("_range").orderBy("_row").rowsBetween(Window.unboundedPreceding, 0))
    joined = ranged.join(F.broadcast(before), "_range")  # a row for each range of the sort
    return joined.withColumn(name, own + F.col("_before")).select(*df.columns, name)


def numbered(df: DataFrame, *order: Column, name: str = "position") -> DataFrame:
    """df with each row's place, from 1, in a total order."""
    return running_total(df, F.lit(1).cast("long"), order, name)


def auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row: auc, n, n_pos, n_neg. Ties count half; null if a class is empty. Null scores are left out, null labels are no.

    Rows are first counted by score; from there on it is a running sum over distinct scores.
    """
    by_score = df.where(F.col(score).isNotNull()).groupBy(score).agg(F.count("*").alias("_n"), F.count_if(F.col(label)).alias("_pos"))
    up_to = running_total(by_score, F.col("_n"), [F.col(score)], "_up_to")
    rank = F.col("_up_to") - (F.col("_n") - 1) / 2.0
    sums = up_to.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n"), F.coalesce(F.sum("_pos"), F.lit(0)).alias("n_pos"), F.sum(F.col("_pos") * rank).alias("_ranks"))
    sums = sums.withColumn("n_neg", F.col("n") - F.col("n_pos"))
    pairs = F.nullif(F.col("n_pos").cast("double") * F.col("n_neg"), F.lit(0.0))
    return sums.select(((F.col("_ranks") - F.col("n_pos").cast("double") * (F.col("n_pos") + 1) / 2) / pairs).alias("auc"), "n", "n_pos", "n_neg")


def precision_at(df: DataFrame, score: str, label: str, tie: str, at: Sequence[int] = (50, 100, 500), shares: Sequence[float] = (0.01, 0.05, 0.1)) -> DataFrame:
    """(name, k, precision, lift): share of positives among the k best by score, ties to the smaller `tie`, which is unique.

    A fixed k larger than the table is left out; a share's k is its product with the rows, halves to even, at least 1.
    lift divides by the share of positives among all rows.
    """
    rows = df.where(F.col(score).isNotNull()).select(F.col(score).alias("_s"), F.coalesce(F.col(label), F.lit(False)).cast("int").alias("_y"), F.col(tie).alias("_t"))
    spark = df.sparkSession
    wanted = spark.createDataFrame([(f"top_{k}", float(k), False) for k in at] + [(f"top_{s:.0%}", float(s), True) for s in shares], "name string, size double, share boolean")
    totals = rows.agg(F.count("*").alias("n"), F.sum("_y").alias("pos"))
    ks = wanted.crossJoin(F.broadcast(totals)).withColumn("k", F.when(F.col("share"), F.greatest(F.lit(1.0), F.rint(F.col("size") * F.col("n")))).otherwise(F.col("size")).cast("long"))
    ks = ks.where((F.col("n") > 0) & (F.col("share") | (F.col("k") <= F.col("n"))))
    places = numbered(rows, F.col("_s").desc(), F.col("_t"))
    hits = places.join(F.broadcast(ks), F.col("position") <= F.col("k"))  # a row for each wanted k
    found = hits.groupBy("name", "k", "n", "pos").agg((F.sum("_y") / F.col("k")).alias("precision"))
    return found.select("name", "k", "precision", F.try_divide(F.col("precision"), F.col("pos") / F.col("n")).alias("lift"))


def percent_ranks(df: DataFrame, group: str, score: str, name: str = "percentile") -> DataFrame:
    """(group, score, name): the percent rank, within its group, of the rows of each distinct score; no null groups and scores.

    Rows are counted by (group, score) before anything is ordered, so a large group is as many rows as it has distinct scores.
    """
    used = df.where(F.col(group).isNotNull() & F.col(score).isNotNull())
    counts = used.groupBy(group, score).agg(F.count("*").alias("_n"))
    by = Window.partitionBy(group)
    before = F.coalesce(F.sum("_n").over(by.orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = counts.withColumn("_before", before).withColumn("_all", F.sum("_n").over(by))
    return ranks.select(group, score, F.coalesce(F.try_divide("_before", F.col("_all") - 1), F.lit(0.0)).alias(name))


def percent_rank(df: DataFrame, group: str, score: str, name: str = "percentile") -> DataFrame:
    """df, without null groups and scores, with each row's percent rank within its group."""
    return df.where(F.col(group).isNotNull() & F.col(score).isNotNull()).join(percent_ranks(df, group, score, name), [group, score])


def ordinal_rank(df: DataFrame, *order: Column) -> DataFrame:
    """df with position (1 for the last in order) and percentile (i of n - 1, a half for a single row)."""
    n = df.agg(F.count("*").alias("_all"))
    placed = numbered(df, *order, name="_i").crossJoin(F.broadcast(n))  # one row
    percentile = F.coalesce(F.try_divide(F.col("_i") - 1, F.col("_all") - 1), F.lit(0.5))
    return placed.withColumns({"position": F.col("_all") - F.col("_i") + 1, "percentile": percentile}).drop("_i", "_all")


def percentiles(df: DataFrame, col: str, shares: Sequence[float]) -> DataFrame:
    """(share, value): exact percentiles, interpolated between the two nearest rows. An empty column has none.

    Rows are counted by value, and a running count over the distinct values finds the rows on both sides.
    """
    counts = df.where(F.col(col).isNotNull()).groupBy(F.col(col).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    placed = running_total(counts, F.col("_n"), [F.col("_v")], "_up_to")
    total = counts.agg(F.sum("_n").alias("_all"))
    wanted = df.sparkSession.createDataFrame([(float(s),) for s in shares], "share double")
    wanted = wanted.crossJoin(F.broadcast(total)).withColumn("_at", F.col("share") * (F.col("_all") - 1))
    sides = wanted.withColumn("_side", F.explode(F.array(F.floor("_at"), F.ceil("_at"))))
    hit = placed.join(F.broadcast(sides), (F.col("_side") >= F.col("_up_to") - F.col("_n")) & (F.col("_side") < F.col("_up_to")))  # two rows a share
    found = hit.groupBy("share", "_at").agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    return found.select("share", (F.col("_low") + (F.col("_high") - F.col("_low")) * (F.col("_at") - F.floor("_at"))).alias("value"))
