"""Exact top-k search by inner product, pruned with segment statistics from coarse to fine.

Every vector is cut into segments. With segment means m and deviation norms s (root of the summed squared deviations),
Cauchy-Schwarz bounds the inner product of two vectors from above by the sum over segments of  len * m1 * m2 + s1 * s2,
which is the same statement as the lower bound of their distance, |a|^2 + |b|^2 - 2 * bound. One segment is the coarsest
level; each finer level is tighter and costs more. A candidate goes on to the next level only while its bound reaches the
k-th best exact product known so far, and what survives all levels is multiplied out exactly.

Every query starts, in all blocks of rows alike, from the k-th best product among START rows drawn from the whole table. A level
of s segments costs 2 s products for each candidate and the exact product as many as there are dimensions, so finer levels than
half of these can't pay; of the others a block leaves out those that discard less than they cost, which it learns from its first
queries. Leaving a level out changes no result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pliego.llm import tables, vectors

LEVELS = (1, 4, 16, 32, 64, 128, 256)
START = 4096
SEEDS = 64
TRIED = 32
SLICE = 256
LONG = 2**63 - 1


def quantised(x: np.ndarray) -> np.ndarray:
    """floor(256 x) in double precision."""
    return np.floor(256.0 * x)


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """[sqrt(len) * mean of each segment, deviation norm of each segment]: the bound is then a plain inner product."""
    parts = np.array_split(x, min(segments, x.shape[1]), axis=1)
    means = np.stack([np.sqrt(p.shape[1]) * p.mean(axis=1) for p in parts], axis=1)
    norms = np.stack([np.sqrt(np.square(p - p.mean(axis=1, keepdims=True)).sum(axis=1)) for p in parts], axis=1)
    return np.concatenate([means, norms], axis=1)


def products(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact integer inner products as int64: in floats while those are exact, else in Python integers, held to the range of a long."""
    if (np.abs(rows).max(initial=0) * np.abs(query).max(initial=0)) * len(query) < 2**53:
        return (rows @ query).astype(np.int64)
    q = [int(v) for v in query]
    return np.array([min(LONG, max(-LONG - 1, sum(int(a) * b for a, b in zip(r, q, strict=True)))) for r in rows], dtype=np.int64)


def survivors(q: np.ndarray, x: np.ndarray, least: np.ndarray) -> list[tuple[int, float]]:
    """(segments, share of all pairs whose bounds up to this level reach their query's `least`), for each level that may pay."""
    alive, out = np.ones((len(q), len(x)), bool), []
    for segments in LEVELS:
        if 2 * segments < x.shape[1]:
            alive &= statistics(q, segments) @ statistics(x, segments).T >= least[:, None]
            out.append((segments, float(alive.mean())))
    return out


def paying(shares: list[tuple[int, float]], dim: int) -> list[int]:
    """The levels that discard more of what the last one used has left than they cost, in shares of an exact product."""
    used, left = [], 1.0
    for segments, share in shares:
        if left - share > left * 2 * segments / dim:
            used, left = [*used, segments], share
    return used


def search_block(queries: pa.Table, rows: pa.Table, k: int) -> pa.Table:
    """The k best rows of one block of rows for each query of one block of queries, of those that reach the query's `least`."""
    out: tuple[list, list, list] = ([], [], [])
    if queries.num_rows and rows.num_rows:
        q_ids, ids = (t.column("vec_id").to_numpy() for t in (queries, rows))
        q, x = quantised(vectors.matrix(queries)), quantised(vectors.matrix(rows))
        size = np.abs(x).max() * np.abs(q).max() * x.shape[1]
        floats, least = size < 2**53, queries.column("least").to_numpy() - 1e-9 * (1 + size)
        used = paying(survivors(q[:TRIED], x, least[:TRIED]), x.shape[1])
        levels, q_levels = ([statistics(m, s) for s in used] for m in (x, q))
        for at in range(0, len(q), SLICE):
            part = slice(at, at + SLICE)
            reached = q_levels[0][part] @ levels[0].T if used else q[part] @ x.T if floats else None
            for i, q_id in enumerate(q_ids[part]):
                own, low = q[at + i], least[at + i]
                alive = np.flatnonzero(ids != q_id)
                if used:
                    bound = reached[i, alive]
                    first = alive[np.argpartition(-bound, SEEDS)[:SEEDS]] if len(bound) > SEEDS else alive
                    known = products(x[first], own)
                    kept = vectors.best_of(known, ids[first], k)
                    low = max(low, known[kept[-1]] - 1e-9 * (1 + size)) if len(kept) == k else low
                    alive = alive[bound >= low]
                    for stats, mine in zip(levels[1:], q_levels[1:], strict=True):
                        alive = alive[stats[alive] @ mine[at + i] >= low]
                elif floats:
                    alive = alive[reached[i, alive] >= low]
                score = products(x[alive], own) if used or not floats else reached[i, alive].astype(np.int64)
                best = vectors.best_of(score, ids[alive], k)
                out[0].append(np.full(len(best), q_id))
                out[1].append(ids[alive][best])
                out[2].append(score[best])
    cols = [np.concatenate(o) if o else np.empty(0, np.int64) for o in out]
    return pa.table({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.int64())})


def started(q: DataFrame, x: DataFrame, k: int) -> DataFrame:
    """q with least: its k-th best product among START rows of x, minus infinity if these hold fewer than k that may be found."""
    few = tables.sample(x, "vec_id", START).toArrow()
    lengths = few.column("dim").to_numpy()
    own = {int(d): (few.filter(pa.array(lengths == d)).column("vec_id").to_numpy(), quantised(vectors.matrix(few.filter(pa.array(lengths == d))))) for d in np.unique(lengths)}
    shared = q.sparkSession.sparkContext.broadcast(own)  # START rows at most

    def run(batches):
        for b in batches:
            low = np.full(b.num_rows, -np.inf)
            for i, (vec_id, vec, dim) in enumerate(zip(b.column("vec_id").to_pylist(), b.column("vec"), b.column("dim").to_pylist(), strict=True)):
                if dim in shared.value:
                    ids, rows = shared.value[dim]
                    others = ids != vec_id
                    score = products(rows[others], quantised(vec.values.to_numpy().astype(np.float64)))
                    kept = vectors.best_of(score, ids[others], k)
                    low[i] = score[kept[-1]] if len(kept) == k else -np.inf
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(low)], [*b.schema.names, "least"])

    return q.mapInArrow(run, vectors.of_type(q, "least double"))


def top_k(queries: DataFrame, rows: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Each query's k rows of largest integer inner product of floor(256 x): query_id, rank, vec_id, score.

    Blocks of queries meet blocks of rows, both by id and vector, one pair of blocks a group, so no task holds more than two blocks whatever the
    tables' sizes. A row with a null id, a null vector or a vector with null or non-finite components takes no part; vectors
    are compared only with vectors of the same length; rows with the query's own id are not its candidates; repeated rows of
    one id count once, by their best product; ties go to the smaller id; products beyond a long are held to its range.
    Other columns are ignored. Empty tables give no rows.
    """
    spark = rows.sparkSession
    q, x = vectors.usable(queries, id_col, vec_col), vectors.usable(rows, id_col, vec_col)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_q, n_x = vectors.blocks(q.count(), 1, vectors.QUERY_BLOCK), vectors.blocks(x.count(), parts)
    seq = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = started(q, x, k).withColumn("q_block", F.pmod(F.xxhash64("vec_id", "vec"), F.lit(n_q)).cast("int")).withColumn("x_block", seq(n_x))
    x = x.withColumn("x_block", F.pmod(F.xxhash64("vec_id", "vec"), F.lit(n_x)).cast("int")).withColumn("q_block", seq(n_q))
    keys = ["dim", "q_block", "x_block"]
    found = q.groupBy(*keys).cogroup(x.groupBy(*keys)).applyInArrow(lambda a, b: search_block(a, b, k), "query_id long, vec_id long, score long")
    return vectors.merged(found, k)
