"""Part files and reference files as DataFrames."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pliego.schemas import SCHEMAS


def parts(spark: SparkSession, path: str, with_file: bool = False) -> DataFrame:
    """All part files of a dataset, columns joined by name; with_file adds file_name, by which later parts sort after earlier ones."""
    df = spark.read.option("mergeSchema", "true").parquet(path)
    return df.select("*", F.col("_metadata.file_name").alias("file_name")) if with_file else df


def reference(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A reference CSV file with a header, read with the mart's schema; further columns are left out."""
    wanted = spark.createDataFrame([], SCHEMAS[table]).schema
    found = spark.read.option("header", True).csv(path)
    return found.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in wanted])


def text_csv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """A CSV file, cells over several lines included, with every column as text."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def first_present(df: DataFrame, candidates: Sequence[str]) -> Column:
    """The first non-null of those candidate columns that df has; null text if it has none."""
    there = [F.col(f"`{c}`").cast("string") for c in candidates if c in df.columns]
    return F.coalesce(*there) if there else F.lit(None).cast("string")


def aligned(frames: Sequence[DataFrame], shape: Mapping[str, Sequence[str]]) -> DataFrame:
    """Frames of different schemas as one of the given shape: new column -> columns that may hold it, best first."""
    return reduce(DataFrame.unionByName, [df.select(*[first_present(df, c).alias(name) for name, c in shape.items()]) for df in frames])


def datasets(spark: SparkSession, root: str, pattern: str = "*/*") -> list[DataFrame]:
    """One frame for each folder below root that matches and holds rows; folders without readable part files are passed over."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{pattern}")
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    found = sorted(str(s.getPath()) for s in (fs.globStatus(hadoop) or []) if s.isDirectory())
    frames = []
    for folder in found:
        files = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/part-*.parquet"))
        if files:
            df = parts(spark, f"{folder}/part-*.parquet")
            if not df.isEmpty():
                frames.append(df)
    return frames


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where))


def columns_like(columns: Sequence[str], wanted: str, prefix: int = 12) -> str | None:
    """The column of that name, else the first that shares its first `prefix` characters."""
    return wanted if wanted in columns else next((c for c in columns if c[:prefix] == wanted[:prefix]), None)


def column_for(columns: Sequence[str], hints: Sequence[str]) -> str | None:
    """The first column equal to a hint whatever its case, else the first that contains one."""
    low = {c.lower(): c for c in reversed(columns)}
    return next((low[h.lower()] for h in hints if h.lower() in low), None) or next((c for h in hints for c in columns if h.lower() in c.lower()), None)


def projected(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """df with only the wanted columns, found by name or by prefix; all of df if one of them can't be found."""
    names = [columns_like(df.columns, w) for w in wanted]
    return df if None in names else df.select(*[F.col(f"`{n}`").alias(w) for n, w in zip(names, wanted, strict=True)])


def in_period(col: Column, kind: str, first: int, last: int) -> Column:
    """Whether a year, or a date or time text, lies in the years first to last."""
    return col.try_cast("int").between(first, last) if kind == "number" else (col >= f"{first}-01-01") & (col < f"{last + 1}-01-01")
