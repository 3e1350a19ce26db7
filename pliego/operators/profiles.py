"""What a table's columns hold: nulls, distinct values, examples, rates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pliego.functions.numbers import rate
from pliego.operators.dedup import top_per_group


#: Columns of so many distinct values, and bytes of them, by estimate, are gathered as sets by tasks; the others' cells are shuffled.
FEW_VALUES = 1000
FEW_BYTES = 4_000_000


def sketched(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[int, int, int, int]]:
    """Of each column, in one pass and without a shuffle of cells: rows, nulls, distinct values as a sketch estimates them, bytes of the longest as text."""
    own = [F.col(f"`{c}`").cast("string") for c in columns]
    each = [[F.count(c), F.coalesce(F.hll_sketch_estimate(F.hll_sketch_agg(c)), F.lit(0)), F.coalesce(F.max(F.octet_length(c)), F.lit(0))] for c in own]
    n, *rest = df.agg(F.count("*"), *[x for e in each for x in e]).first()
    return {c: (n, n - rest[3 * i], rest[3 * i + 1], rest[3 * i + 2]) for i, c in enumerate(columns)}


def profile(df: DataFrame, columns: Sequence[str] | None = None, examples: int = 3) -> DataFrame:
    """(col, type, n_rows, null_pct, n_distinct, examples) of every column; examples are the smallest values as text, sorted. All of it exact.

    Sketches tell first which columns have few values. Those are gathered as sets, by tasks and then once, with no cell shuffled. The others' cells are
    counted by (column, value), so that no task holds a column's distinct values. An empty table has no rows.
    """
    names = list(columns or df.columns)
    kinds = dict(df.dtypes)
    known = sketched(df, names)
    if not names or not known[names[0]][0]:
        return df.sparkSession.createDataFrame([], "col string, type string, n_rows long, null_pct double, n_distinct long, examples array<string>")
    small = [c for c in names if known[c][2] <= FEW_VALUES and known[c][2] * known[c][3] <= FEW_BYTES]
    parts = []
    if small:
        sets = df.agg(*[F.collect_set(F.col(f"`{c}`").cast("string")).alias(f"{i}") for i, c in enumerate(small)])
        items = F.array(*[F.struct(F.lit(c).alias("col"), F.col(f"`{i}`").alias("v")) for i, c in enumerate(small)])
        own = sets.select(F.explode(items).alias("x")).select("x.*")
        parts.append(own.select("col", F.size("v").cast("long").alias("n_distinct"), F.slice(F.array_sort("v"), 1, examples).alias("examples")))
    if large := [c for c in names if c not in small]:
        cells = F.array(*[F.struct(F.lit(c).alias("col"), F.col(f"`{c}`").cast("string").alias("v")) for c in large])
        distinct = df.select(F.explode(cells).alias("x")).select("x.*").where("v IS NOT NULL").distinct()
        few = top_per_group(distinct, ["col"], [F.col("v")], examples)
        shown = few.groupBy("col").agg(F.array_sort(F.collect_list("v")).alias("examples"))  # `examples` values a column
        parts.append(distinct.groupBy("col").agg(F.count("*").alias("n_distinct")).join(F.broadcast(shown), "col"))  # a row for each column
    found = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    rows = [(c, kinds[c], n, nulls) for c, (n, nulls, _, _) in known.items()]
    base = df.sparkSession.createDataFrame(rows, "col string, type string, n_rows long, _null long")
    joined = base.join(F.broadcast(found), "col", "left")  # a row for each column
    null_pct = F.round(F.col("_null") * 100.0 / F.col("n_rows"), 1).alias("null_pct")
    return joined.select("col", "type", "n_rows", null_pct, F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"), F.coalesce("examples", F.array().cast("array<string>")).alias("examples"))


def null_rates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(col, null_pct) in one pass; blank texts are not null."""
    row = df.agg(*[rate(F.col(f"`{c}`").isNull()).alias(f"{i}") for i, c in enumerate(columns)])
    items = F.array(*[F.struct(F.lit(c).alias("col"), F.col(f"`{i}`").alias("null_pct")) for i, c in enumerate(columns)])
    return row.select(F.explode(items).alias("x")).select("x.*")


def quarantine(df: DataFrame, rules: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that fail a rule, with the first failed rule's name in `reason`; and the rows that fail none. null fails no rule."""
    reason = F.lit(None).cast("string")
    for name, failed in reversed(rules.items()):
        reason = F.when(failed, F.lit(name)).otherwise(reason)
    marked = df.withColumn("reason", reason)
    return marked.where(F.col("reason").isNotNull()), marked.where(F.col("reason").isNull()).drop("reason")


def sampled(df: DataFrame, key: str, n: int, seed: int = 7) -> DataFrame:
    """n rows, the same ones on every run and in any engine: those whose key and seed have the lowest MD5."""
    return df.orderBy(F.md5(F.concat_ws(":", key, F.lit(seed)).cast("binary")), key).limit(n)
