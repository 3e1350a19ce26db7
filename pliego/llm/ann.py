"""Approximate nearest neighbours by cosine: inverted lists, scanned with an adaptive number of dimensions.

Vectors are normalised and turned by one random rotation, after which any leading block of columns is a fair sample of the
whole. Each row belongs to the list of its nearest centroid and each query probes its nearest lists: as many as the sample's
neighbours ask for, and on until the lists read hold more rows than are wanted. Within a probed list the columns are read block
by block: after d of D columns the partial squared distance, scaled by D / d, estimates the whole one, and a row is abandoned as
soon as the hypothesis that it is nearer than the k-th best so far is rejected at the chosen significance, that is when
partial * D / d > (1 + eps / sqrt(d))^2 * best_k.  Survivors get their exact cosine on the original vectors.

Centroids and the number of lists to probe are fitted on a bounded sample (SAMPLE rows for each indexed length); every row is
indexed. Vectors meet only vectors of their own length. The LENGTHS most frequent lengths get an index each, the rows of any
other length are one list. A query that still has fewer rows than are wanted is searched again, through all rows of its length.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pliego.llm import tables, vectors

SAMPLE = 8192
LISTS = 1024
LENGTHS = 8
INDEX_FROM = 64
COLUMNS = 16
EPS = 2.1
TARGET = 0.98
SEEDS = 64
TINY = 1e-12
RESULT = "query_id long, rank int, vec_id long, score double"


@dataclass
class Lists:
    """The index of one length: centroids, how many lists a query reads at least, and how many rows each list has."""

    centre: np.ndarray
    probes: int
    sizes: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))


def rotation(dim: int, seed: int = 11) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))[0]


def scaled(x: np.ndarray) -> np.ndarray:
    """Each row times the power of two that brings its largest component to about one: exact, and squares stay in range."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.sqrt(np.square(x).sum(axis=1, keepdims=True))


def fit_lists(x: np.ndarray, lists: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Spherical k-means on unit vectors."""
    rng = np.random.default_rng(seed)
    centre = x[rng.choice(len(x), min(lists, len(x)), replace=False)]
    for _ in range(rounds):
        near = (x @ centre.T).argmax(axis=1)
        total = np.zeros_like(centre)
        np.add.at(total, near, x)
        size = np.sqrt(np.square(total).sum(axis=1, keepdims=True))
        centre = np.where(size > 0, total / np.where(size > 0, size, 1), centre)
    return centre


def fit_probes(x: np.ndarray, centre: np.ndarray, k: int, target: float = TARGET, tries: int = 512) -> int:
    """The fewest lists that hold `target` of the sample's own true neighbours.

    Neighbours within a sample are farther off than those in the whole table, so the number errs on the large side.
    """
    q = x[: min(tries, len(x))]
    near = q @ x.T
    near[np.arange(len(q)), np.arange(len(q))] = -2
    top = np.argpartition(-near, min(k, len(x) - 1), axis=1)[:, :k]
    place = np.argsort(np.argsort(-(q @ centre.T), axis=1), axis=1)
    home = (x @ centre.T).argmax(axis=1)
    ranks = np.sort(place[np.arange(len(q))[:, None], home[top]].ravel())
    return int(min(len(centre), ranks[min(len(ranks) - 1, int(np.ceil(target * len(ranks))))] + 1))


def fit(x: DataFrame, k: int, sample_rows: int, lists: int | None, probes: int | None) -> dict[int, Lists]:
    """An index for each of the most frequent lengths that has at least INDEX_FROM rows."""
    often = x.groupBy("dim").count().orderBy(F.col("count").desc(), "dim").limit(LENGTHS).collect()
    index = {}
    for dim, rows in ((r["dim"], r["count"]) for r in often if r["count"] >= INDEX_FROM):
        own = x.where(F.col("dim") == dim)
        ids = tables.sample(own.select("vec_id").distinct(), "vec_id", sample_rows)
        got = unit(vectors.matrix(tables.drawn(own.select("vec_id", "vec"), ids, "vec_id", sample_rows).orderBy("vec_id").toArrow()))
        centre = fit_lists(got, lists or min(LISTS, max(8, round(rows**0.5 / 4))))
        index[dim] = Lists(centre, probes or fit_probes(got, centre, k))
    return index


def _in_lists(df: DataFrame, index: dict[int, Lists], depth) -> DataFrame:
    """df with list, one row for each list that depth(own index, nearness of a block of vectors) names."""
    shared = df.sparkSession.sparkContext.broadcast(index)  # LENGTHS * LISTS centroids at most

    def assign(batches):
        for b in batches:
            t = pa.Table.from_batches([b])
            for dim in np.unique(t.column("dim").to_numpy()):
                same = t.filter(pa.compute.equal(t.column("dim"), int(dim)))
                own = shared.value.get(int(dim))
                if own is None:
                    row, which = np.arange(same.num_rows), np.zeros(same.num_rows)
                else:
                    row, which = depth(own, unit(vectors.matrix(same)) @ own.centre.T)
                yield from same.take(row).append_column("list", pa.array(which.astype(np.int32))).to_batches(max_chunksize=4096)

    return df.mapInArrow(assign, vectors.of_type(df, "list int"))


def nearest_list(own: Lists, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.arange(len(near)), near.argmax(axis=1)


def probed_lists(k: int):
    """Each query's nearest lists: `probes` of them, and on until they hold k rows beside one of the query's own."""

    def depth(own: Lists, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(-near, axis=1, kind="stable")
        held = np.cumsum(own.sizes[order], axis=1)
        enough = (held <= k).sum(axis=1) + 1
        n = np.minimum(np.maximum(enough, own.probes), near.shape[1])
        return np.repeat(np.arange(len(near)), n), order[np.arange(near.shape[1]) < n[:, None]]

    return depth


def scan_list(queries: pa.Table, rows: pa.Table, k: int, eps: float = EPS, columns: int = COLUMNS) -> pa.Table:
    """The k nearest rows found in one block of one list, for each query that probes it."""
    out: tuple[list, list, list] = ([], [], [])
    if queries.num_rows and rows.num_rows:
        q_ids, ids = (t.column("vec_id").to_numpy() for t in (queries, rows))
        q, x = scaled(vectors.matrix(queries)), scaled(vectors.matrix(rows))
        dim, norm = x.shape[1], np.sqrt(np.square(x).sum(axis=1))
        turn = rotation(dim)
        q_turned, x_turned = unit(q) @ turn, unit(x) @ turn
        steps = [slice(i, min(i + columns, dim)) for i in range(0, dim, columns)]
        blocks = [np.ascontiguousarray(x_turned[:, s]) for s in steps]
        for i, q_id in enumerate(q_ids):
            others = np.flatnonzero(ids != q_id)
            part = np.square(blocks[0][others] - q_turned[i, steps[0]]).sum(axis=1)
            seeds = others[np.argpartition(part, SEEDS)[:SEEDS]] if len(part) > SEEDS else others
            whole = np.square(x_turned[seeds] - q_turned[i]).sum(axis=1)
            kept = vectors.best_of(-whole, ids[seeds], k)
            limit = whole[kept].max() if len(kept) == k else np.inf
            alive = others
            for s, block in zip(steps, [None, *blocks[1:]], strict=True):
                if block is not None:
                    part = part + np.square(block[alive] - q_turned[i, s]).sum(axis=1)
                d = s.stop
                grace = (1 + eps / np.sqrt(d)) ** 2 if d < dim else 1
                stay = part * (dim / d) <= limit * grace + TINY  # equal rows differ in rounding by their place in a block
                alive, part = alive[stay], part[stay]
            alive = np.union1d(alive, seeds[kept])
            # sums row by row, so that equal rows score equal to the last bit wherever they lie
            score = (x[alive] * q[i]).sum(axis=1) / (norm[alive] * np.sqrt(np.square(q[i]).sum()))
            best = vectors.best_of(score, ids[alive], k)
            out[0].append(np.full(len(best), q_id))
            out[1].append(ids[alive][best])
            out[2].append(score[best])
    cols = [np.concatenate(o) if o else np.empty(0) for o in out]
    return pa.table({"query_id": pa.array(cols[0].astype(np.int64)), "vec_id": pa.array(cols[1].astype(np.int64)), "score": pa.array(cols[2], pa.float64())})


def scanned(q: DataFrame, x: DataFrame, k: int) -> DataFrame:
    """Each query's k best of the lists it reads. Both have list; a list of any size is scanned in blocks of rows and of queries."""
    counts = x.groupBy("dim", "list").agg(F.count("*").alias("x_rows")).join(q.groupBy("dim", "list").agg(F.count("*").alias("q_rows")), ["dim", "list"])
    counts = tables.small(tables.written(counts))  # a row for each list that is read
    cut = lambda c, most: F.ceil(F.col(c) / most).cast("int")
    block = lambda n: F.pmod(F.xxhash64("vec_id", "vec"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    n_x, n_q = cut("x_rows", vectors.ROW_BLOCK), cut("q_rows", vectors.QUERY_BLOCK)
    columns = ["dim", "list", "vec_id", "vec"]
    x = x.join(counts, ["dim", "list"]).select(*columns, block(n_x).alias("x_block"), every(n_q).alias("q_block"))
    q = q.join(counts, ["dim", "list"]).select(*columns, block(n_q).alias("q_block"), every(n_x).alias("x_block"))
    keys = ["dim", "list", "x_block", "q_block"]
    found = q.groupBy(*keys).cogroup(x.groupBy(*keys)).applyInArrow(lambda a, b: scan_list(a, b, k), "query_id long, vec_id long, score double")
    return vectors.merged(found, k)


def nearest(queries: DataFrame, rows: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", lists: int | None = None, probes: int | None = None, sample_rows: int = SAMPLE) -> DataFrame:
    """Each query's k nearest rows found, by cosine, or all if there are fewer: query_id, rank, vec_id, score.

    lists: how many inverted lists a length has, by default about a quarter of the square root of its rows, LISTS at most.
    probes: how many of them a query reads at least, by default the fewest that hold TARGET of the sample's true neighbours.

    Rows with a null id, or a vector that is null, empty, all zero, or holds null or non-finite components, take no part. Vectors
    are compared only with vectors of the same length; rows with the query's own id are not its candidates; repeated rows of one
    id count once, by their best score; ties go to the smaller id. Other columns are ignored, and empty tables give no rows.
    """
    q, x = (vectors.usable(d, id_col, vec_col).where(F.exists("vec", lambda c: c != 0)) for d in (queries, rows))
    index = fit(x, k, sample_rows, lists, probes)
    x = tables.written(_in_lists(x, index, nearest_list))
    sizes = x.where(F.col("dim").isin(*index)).groupBy("dim", "list").count().collect() if index else []  # LENGTHS * LISTS at most
    for dim, own in index.items():
        own.sizes = np.zeros(len(own.centre), np.int64)
        for r in sizes:
            if r["dim"] == dim:
                own.sizes[r["list"]] = r["count"]
    best = tables.written(scanned(_in_lists(q, index, probed_lists(k)), x, k))
    # what repeated ids, or lists of the query's own rows only, have left short
    done = best.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"))
    short = tables.written(q.join(done, "vec_id", "left_anti"))
    if short.isEmpty():
        return best
    again = scanned(short.withColumn("list", F.lit(0)), x.withColumn("list", F.lit(0)), k)
    return best.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").select(best.columns).unionByName(again)
