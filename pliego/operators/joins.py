"""Joins with the semantics that the plans need; which side is sent where is left to Spark's own size checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pliego.operators.ranking import running_total

#: Reference tables with at most so many rows are sent to every task.
SMALL_ROWS = 100_000


def small(df: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """df with a broadcast hint if it is proven to have `most` rows at most; otherwise df itself, and Spark chooses."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def lookup(df: DataFrame, table: DataFrame, on: Mapping[str, str], defaults: Mapping[str, object]) -> DataFrame:
    """df with the columns named in `defaults` from a table unique in its keys; the default where there is no match.

    on: column of df -> column of table.
    """
    right = table.select(*[F.col(k).alias(f"_key_{k}") for k in on.values()], *[F.col(c).alias(f"_new_{c}") for c in defaults])
    match = reduce(Column.__and__, [F.col(a) == F.col(f"_key_{b}") for a, b in on.items()])
    joined = df.join(right, match, "left")
    return joined.select(*df.columns, *[F.coalesce(F.col(f"_new_{c}"), F.lit(d)).alias(c) if d is not None else F.col(f"_new_{c}").alias(c) for c, d in defaults.items()])


def in_range(df: DataFrame, col: str, ranges: DataFrame, low: str, high: str) -> DataFrame:
    """Left join of each row with the range that holds its value, both ends inclusive.

    ranges has to be small and free of overlaps; it is expanded to days, so that the join is one of equal keys.
    """
    days = ranges.withColumn("_day", F.explode(F.sequence(F.col(low), F.col(high))))
    return df.join(small(days), F.col(col) == F.col("_day"), "left").drop("_day")


def whole_number(col: Column, kind: str) -> Column:
    """A date, timestamp or integer as a long that orders as it does."""
    if kind == "date":
        return F.unix_date(col).cast("long")
    if kind == "timestamp":
        return F.unix_micros(col)
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return col.cast("long")
    raise TypeError(f"ranges of {kind} can't be joined: dates, timestamps and integers can")


def dyadic(low: Column, high: Column) -> Column:
    """Longs from low to high, ends included, as disjoint bins: an array of (level, bin), where a bin of level l holds 2^l numbers n of equal n >> l.

    There are two of each level at most. Empty where low is above high, null where one is null.
    """
    one, shift = F.lit(1).cast("long"), F.shiftright
    state = F.struct(low.alias("a"), F.coalesce(high, low).alias("b"), F.array().cast("array<struct<level: int, bin: bigint>>").alias("bins"))

    def step(s: Column, level: Column) -> Column:
        a, b = s["a"], s["b"]
        own = lambda x: F.array(F.struct(level.cast("int").alias("level"), x.alias("bin")))
        none = F.array().cast("array<struct<level: int, bin: bigint>>")
        first = F.when((a <= b) & (a.bitwiseAND(one) == 1), own(a)).otherwise(none)
        last = F.when((a <= b) & (b.bitwiseAND(one) == 0), own(b)).otherwise(none)
        # what is left between the two ends is whole pairs; a range that is used up stays crossed
        after = F.when(a > b, F.struct(one.alias("a"), (one - one).alias("b"))).otherwise(F.struct((shift(a, 1) + a.bitwiseAND(one)).alias("a"), (shift(b, 1) - one + b.bitwiseAND(one)).alias("b")))
        return F.struct(after["a"].alias("a"), after["b"].alias("b"), F.concat(s["bins"], first, last).alias("bins"))

    folded = F.aggregate(F.sequence(F.lit(0), F.lit(63)), state, step, lambda s: s["bins"])
    return F.when(low.isNotNull() & high.isNotNull(), folded)


def range_join(df: DataFrame, col: str, ranges: DataFrame, low: str, high: str, how: str = "left") -> DataFrame:
    """df with every range that holds its value, both ends included, a row each; how: inner, or left, where a row in no range stays once.

    Ranges may be long, many and overlapping. Each is cut into bins of powers of two, some two dozen at most for dates, and a value lies in one bin of each
    width, so the join is one of equal bins and no pair comes twice or in vain. Each distinct value is looked up once. A range with a null end
    holds nothing, nor does any hold a null. Values and ends are dates, timestamps or integers. Names of the two tables must differ.
    The result has a row for each pair; where only totals are wanted, `range_totals` forms no pairs.
    """
    kinds = dict(df.dtypes)
    binned = ranges.where(F.col(low).isNotNull() & F.col(high).isNotNull()).withColumn("_bin", F.explode(dyadic(whole_number(F.col(low), dict(ranges.dtypes)[low]), whole_number(F.col(high), dict(ranges.dtypes)[high]))))
    levels = sorted(r[0] for r in binned.select("_bin.level").distinct().collect())  # 64 at most
    values = df.select(F.col(col).alias("_value")).where("_value IS NOT NULL").distinct()
    number = whole_number(F.col("_value"), kinds[col])
    cells = F.array(*[F.struct(F.lit(n).alias("level"), F.shiftright(number, n).alias("bin")) for n in levels]).cast("array<struct<level: int, bin: bigint>>")
    placed = values.withColumn("_bin", F.explode(cells))
    found = placed.join(binned, "_bin").drop("_bin")
    return df.join(found, F.col(col) == F.col("_value"), how).drop("_value")


def range_totals(df: DataFrame, col: str, ranges: DataFrame, low: str, high: str, count: str, sums: Mapping[str, str]) -> DataFrame:
    """df with the number of ranges that hold its value, both ends included, and the sums of their columns (new name -> column), 0 where there are none.

    What range_join and a grouping give, without a row for each pair: what holds a value is what begins up to it less what ends before it. Ranges are added
    up by each end, so what is sorted are distinct ends and values, however many ranges hold a value. Columns have to be whole numbers or decimals,
    of which sums are exact; values and ends are as in `range_join`.
    """
    kinds, values = dict(ranges.dtypes), dict(df.dtypes)
    if odd := [c for c in sums.values() if not kinds[c].startswith(("tinyint", "smallint", "int", "bigint", "decimal"))]:
        raise TypeError(f"columns {odd} are neither whole numbers nor decimals")
    names = [f"_sum_{i}" for i in range(len(sums))]
    begin, end = whole_number(F.col(low), kinds[low]), whole_number(F.col(high), kinds[high])
    held = ranges.where(begin <= end)
    # at one number, ranges begin before values are met, and end after
    at = lambda number, kind, sign: held.groupBy(number.alias("_at"), F.lit(kind).alias("_kind")).agg((F.count("*") * sign).alias("_n"), *[(F.coalesce(F.sum(c), F.lit(0)) * sign).alias(n) for n, c in zip(names, sums.values(), strict=True)])
    met = df.select(whole_number(F.col(col), values[col]).alias("_at")).where("_at IS NOT NULL").distinct().withColumn("_kind", F.lit(1))
    every = at(begin, 0, 1).unionByName(at(end, 2, -1)).unionByName(met, allowMissingColumns=True).fillna(0)
    for n in ("_n", *names):
        every = running_total(every, F.col(n), [F.col("_at"), F.col("_kind")], f"{n}_total")
    found = every.where("_kind = 1").select(F.col("_at").alias("_value"), F.col("_n_total").alias("_n"), *[F.col(f"{n}_total").alias(n) for n in names])
    joined = df.join(found, whole_number(F.col(col), values[col]) == F.col("_value"), "left")
    return joined.select(*df.columns, *[F.coalesce(n, F.lit(0)).alias(name) for n, name in zip(("_n", *names), (count, *sums), strict=True)])


def excluding(df: DataFrame, key: str, banned: DataFrame, banned_key: str) -> DataFrame:
    """Rows whose key is in no row of `banned`, as NOT IN has it: a null on either side keeps nothing back but drops the row.

    So rows with a null key go unless `banned` is empty, and a null among the banned keys empties the result.
    """
    keys = banned.select(F.col(banned_key).alias("_banned")).distinct()
    state = keys.agg(F.count("*").alias("_n"), F.count_if(F.col("_banned").isNull()).alias("_nulls"))
    left = df.join(keys, F.col(key) == F.col("_banned"), "left_anti")
    return left.crossJoin(F.broadcast(state)).where((F.col("_n") == 0) | ((F.col("_nulls") == 0) & F.col(key).isNotNull())).drop("_n", "_nulls")  # state: one row


def exists_marker(df: DataFrame, other: DataFrame, on: Sequence[str], name: str) -> DataFrame:
    """df with a boolean: whether `other` has a row of the same key. Rows are never multiplied; null keys match nothing."""
    keys = other.select(*on).where(" AND ".join(f"`{c}` IS NOT NULL" for c in on)).distinct().withColumn("_exists", F.lit(True))
    return df.join(keys, list(on), "left").withColumn(name, F.coalesce("_exists", F.lit(False))).drop("_exists")


def earliest_of(left: DataFrame, right: DataFrame, key: str, col: str, names: tuple[str, str]) -> DataFrame:
    """Full outer join of two sources: each one's value, the smaller non-null one, whether they differ, how many have one."""
    a, b = (f"{col}_{n}" for n in names)
    joined = left.withColumnRenamed(col, a).join(right.withColumnRenamed(col, b), key, "full_outer")
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    return joined.withColumns(
        {
            col: F.least(a, b),
            "is_conflict": F.coalesce(both & (F.col(a) != F.col(b)), F.lit(False)),
            "n_sources_matched": F.col(a).isNotNull().cast("int") + F.col(b).isNotNull().cast("int"),
        }
    )


def like_any(text: Column, patterns: Sequence[str]) -> Column:
    """Whether the text is like one of the patterns; null without patterns."""
    return reduce(Column.__or__, [text.like(p) for p in patterns]) if patterns else F.lit(None).cast("boolean")


def threshold(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """df with the columns of a global aggregate, which has one row."""
    return df.crossJoin(F.broadcast(one_row.limit(1)))
