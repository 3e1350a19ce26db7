"""Vector tables as blocks, for the two searches: validity, blocks of rows, and the merge of each block's best."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of both sides in one task: each row is sent once for every block of the other side, so the two are of one size.
QUERY_BLOCK = 8192
ROW_BLOCK = 8192


def is_valid(vec: Column) -> Column:
    """Not null, not empty, and every component a finite number."""
    ok = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vec.isNotNull() & (F.size(vec) > 0) & ok


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, vec, dim) of the rows that take part; a null id takes none. Floats stay floats, half as wide to shuffle."""
    kind = df.schema[vec_col].dataType
    floats = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    vec = F.col(vec_col) if floats else F.col(vec_col).cast("array<double>")
    kept = df.select(F.col(id_col).cast("long").alias("vec_id"), vec.alias("vec"))
    kept = kept.where(F.col("vec_id").isNotNull() & is_valid(F.col("vec")))
    return kept.withColumn("dim", F.size("vec"))


def of_type(df: DataFrame, *more: str) -> str:
    """The schema of (vec_id, vec, dim), as `df` has it, and of more columns."""
    return ", ".join(["vec_id long", f"vec {df.schema['vec'].dataType.simpleString()}", "dim int", *more])


def blocks(rows: int, partitions: int, largest: int = ROW_BLOCK) -> int:
    """How many blocks to cut rows into: enough for every partition, none much larger than `largest`."""
    return max(1, -(-rows // min(largest, max(512, -(-rows // (4 * partitions))))))


def matrix(t: pa.Table, name: str = "vec") -> np.ndarray:
    """A list column, all lists of one length, as a float64 matrix."""
    col = t.column(name).combine_chunks()
    col = col.chunk(0) if isinstance(col, pa.ChunkedArray) else col
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1)


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best: largest score, ties to the smaller id, one row for each id."""
    if len(scores) > 4 * k + 64:
        kth = np.partition(scores, -4 * k)[-4 * k]
        near = np.flatnonzero(scores >= kth)
        order = near[np.lexsort((ids[near], -scores[near]))]
        first = order[np.sort(np.unique(ids[order], return_index=True)[1])]
        if len(first) >= k:
            return first[:k]
    order = np.lexsort((ids, -scores))
    return order[np.sort(np.unique(ids[order], return_index=True)[1])][:k]


def merged(found: DataFrame, k: int) -> DataFrame:
    """Each query's k best of what its blocks found: query_id, rank, vec_id, score."""
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
