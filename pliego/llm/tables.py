"""What the operators of this subpackage share: reading, cutting lineage, held-out folds, bounded samples."""

from __future__ import annotations

import re
from collections.abc import Sequence

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pliego.operators.joins import small
from pliego.session import cut as written
from pliego.session import spread

__all__ = ["comparable", "drawn", "fold", "free", "sample", "share_below", "small", "table", "tokenizer_path", "written"]


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer's file."""
    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def share_below(by: str, share: Column | float) -> Column:
    """Whether the id's hash is among the lowest `share` (0 to 1) of all hashes."""
    return F.shiftrightunsigned(F.xxhash64(F.col(by), F.lit(7)), 1) / F.lit(2.0**63) < share


def sample(df: DataFrame, by: str, size: int) -> DataFrame:
    """At most size rows, the same ones whatever the partitioning: those whose id hashes lowest.

    df has an id once, or nearly so. Rows whose hash can't be among the lowest are left out before any are ordered, so that what
    tasks send on does not grow with their number.
    """
    n = df.count()
    few = df.where(share_below(by, 4 * size / n)) if n > 4 * size else df
    return few.orderBy(F.xxhash64(F.col(by), F.lit(7)), by).limit(size)


def drawn(df: DataFrame, keys: DataFrame, by: str, size: int) -> DataFrame:
    """The rows of df whose `by` is among keys, one row for each: that whose other columns hash lowest. At most `size` rows.

    keys: distinct values, `size` at most. However often an id is repeated, it gives one row.
    """
    rest = [c for c in df.columns if c != by]
    found = df.join(F.broadcast(keys.select(by)), by)  # size rows at most
    one = found.groupBy(by).agg(F.min_by(F.struct(*rest), F.xxhash64(*rest)).alias("_row"))
    return one.select(by, "_row.*").limit(size)



def free(name: str, columns: Sequence[str]) -> str:
    """name, or name with marks behind it, so that no column is called so, whatever its case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def comparable(col: Column, kind: T.DataType) -> Column:
    """col in a form that hashes and orders: maps as their entries sorted by key, variants as JSON, within arrays and structs too. Equal values stay equal."""
    if not re.search("map<|variant", kind.simpleString()):
        return col
    if isinstance(kind, T.MapType):
        entries = F.transform(F.map_entries(col), lambda e: F.struct(comparable(e["key"], kind.keyType).alias("key"), comparable(e["value"], kind.valueType).alias("value")))
        return F.array_sort(entries)
    if isinstance(kind, T.ArrayType):
        return F.transform(col, lambda x: comparable(x, kind.elementType))
    if isinstance(kind, T.StructType):
        return F.when(col.isNotNull(), F.struct(*[comparable(col[f.name], f.dataType).alias(f"_{i}") for i, f in enumerate(kind.fields)]))
    return F.to_json(col)
