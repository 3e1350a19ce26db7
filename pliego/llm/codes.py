"""Vector codes: each part of a vector as the number of its nearest codebook entry, found in a vantage-point tree.

A codebook belongs to one part position. Its tree takes one entry as vantage point and halves the others by their distance to it; each half
keeps the smallest and the largest such distance. By the triangle inequality a part at distance d of the vantage point is at least
d - largest and smallest - d away from all of the half. All is integers: squared distances are exact, radii are rounded outwards,
so that a bound is never above the true distance, and a half is visited also where its bound equals the best distance so far, for
the tie may go to a smaller index. What a visit finds is compared by exact squared distance, then index.

Training is a fixed number of rounds over all rows: tasks add up components and counts by (length, part, entry), and only these sums meet on the driver.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pliego.llm import tables, vectors

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256.0
LEAF = 6
#: Most entry components of all codebooks together; they are sent to every task.
LARGEST = 1 << 23
LEAF_KEY = np.iinfo(np.int64).max


@dataclass
class Half:
    """Entries at distances of low to high from the vantage point above, low rounded down and high up."""

    low: int
    high: int
    node: Node


@dataclass
class Node:
    """Entries to compare with, and the halves of the rest by distance from the first of these."""

    entries: np.ndarray
    halves: list[Half]


def roots(squares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Integers not above and not below the square roots, at most one further off than the nearest."""
    r = np.floor(np.sqrt(squares.astype(np.float64))).astype(np.int64)
    return np.maximum(r - 1, 0), r + 1 + (squares > 0)


def squares(parts: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of all parts to all entries."""
    gap = parts[:, None, :] - entries[None, :, :]
    return np.einsum("ijk,ijk->ij", gap, gap)


def tree_of(book: np.ndarray, own: np.ndarray | None = None) -> Node:
    """The tree over the entries `own` of a codebook, all by default. The vantage point is the entry farthest from the first one."""
    own = np.arange(len(book)) if own is None else own
    if len(own) <= LEAF:
        return Node(own, [])
    at = int(np.argmax(squares(book[own[:1]], book[own])[0]))
    rest = np.delete(own, at)
    away = squares(book[own[at]][None], book[rest])[0]
    order = np.argsort(away, kind="stable")
    rest, (low, high) = rest[order], roots(away[order])
    cut = len(rest) // 2
    halves = [Half(int(low[a]), int(high[b - 1]), tree_of(book, np.sort(rest[a:b]))) for a, b in ((0, cut), (cut, len(rest)))]
    return Node(own[at : at + 1], halves)


def nearest(parts: np.ndarray, book: np.ndarray, tree: Node) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of each part, ties to the lower one, and the squared distance.

    All parts go through the tree together; at each node those remain whose bound does not exceed their best distance.
    """
    size = len(book)
    best = np.full(len(parts), LEAF_KEY)  # squared distance * size + index, so that one minimum decides both

    def visit(node: Node, which: np.ndarray) -> None:
        away = squares(parts[which], book[node.entries])
        best[which] = np.minimum(best[which], (away * size + node.entries).min(axis=1))
        if not node.halves:
            return
        low, high = roots(away[:, 0])
        bounds = [np.maximum(np.maximum(h.low - high, low - h.high), 0) for h in node.halves]
        first = bounds[0] <= bounds[1]
        for half, turn in ((0, first), (1, ~first), (1, first), (0, ~first)):  # each part its nearer half first
            mine = np.flatnonzero(turn)
            near = mine[bounds[half][mine] ** 2 <= best[which[mine]] // size]
            if len(near):
                visit(node.halves[half].node, which[near])

    if len(parts) and size:
        visit(tree, np.arange(len(parts)))
    return best % max(size, 1), best // max(size, 1)


Books = dict[int, list[np.ndarray]]


def assigned(rows: np.ndarray, books: list[np.ndarray], trees: list[Node]) -> tuple[np.ndarray, np.ndarray]:
    """(rows x parts) indexes and squared distances."""
    width = rows.shape[1] // len(books)
    found = [nearest(np.ascontiguousarray(rows[:, p * width : (p + 1) * width]), books[p], trees[p]) for p in range(len(books))]
    return np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


def whole(vecs: np.ndarray, entries: int) -> np.ndarray:
    """floor(256 x) as integers. Components for which a squared distance would not fit a long are an error, not a wrong code."""
    scaled = np.floor(SCALE * vecs)
    most = np.abs(scaled).max(initial=0.0)
    if 4.0 * vecs.shape[1] * (most + 1) ** 2 * entries >= 2.0**62:
        raise ValueError(f"a component of {most:.3g} after scaling is too large for {entries} entries in exact integers")
    return scaled.astype(np.int64)


def by_length(batch: pa.RecordBatch) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places in the batch, matrix) of each length of vectors."""
    dims = batch.column("dim").to_numpy()
    t = pa.Table.from_batches([batch])
    return [(int(d), np.flatnonzero(dims == d), vectors.matrix(t.filter(pa.array(dims == d)))) for d in np.unique(dims)]


@dataclass
class Model:
    """Codebooks by length of vector: for each part its entries, in order."""

    books: Books
    parts: int

    def sha256(self, length: int) -> str:
        """Of all components as decimal numbers, joined by commas, by part, entry and place within the part."""
        return hashlib.sha256(",".join(str(x) for book in self.books[length] for x in book.ravel().tolist()).encode()).hexdigest()

    def trees(self) -> dict[int, list[Node]]:
        return {d: [tree_of(b) for b in books] for d, books in self.books.items()}


def usable(df: DataFrame, vec_col: str) -> DataFrame:
    """df's rows whose vector is not null and holds neither null nor non-finite components, with vec and dim."""
    vec = F.col(f"`{vec_col}`").cast("array<double>")
    kept = df.withColumn("vec", vec).where(vectors.is_valid(F.col("vec")) | (F.size("vec") == 0))
    return kept.withColumn("dim", F.size("vec"))


def first_entries(rows: DataFrame, id_col: str, parts: int, entries: int) -> Model:
    """The parts of the `entries` smallest ids of each length; rows of one id by their vectors, null ids last."""
    order = [F.col(id_col).asc_nulls_last(), F.col("vec")]
    own = rows.select(id_col, "vec", "dim").withColumn("_rn", F.row_number().over(Window.partitionBy("dim").orderBy(*order))).where(F.col("_rn") <= entries)
    lengths = [r["dim"] for r in rows.select("dim").distinct().limit(LARGEST // entries + 1).collect()]
    if sum(lengths) * entries > LARGEST:
        raise ValueError(f"codebooks of {len(lengths)} lengths would hold more than {LARGEST} numbers")
    if wrong := [d for d in lengths if d % parts]:
        raise ValueError(f"vectors of {sorted(wrong)[:5]} components can't be cut into {parts} equal parts")
    t = own.orderBy("dim", "_rn").select("dim", "vec").toArrow()  # `entries` rows a length, LARGEST numbers at most
    books: Books = {}
    for d in sorted(lengths):
        m = whole(vectors.matrix(t.filter(pa.array(t.column("dim").to_numpy() == d))), entries) if d else np.zeros((min(entries, t.column("dim").to_pylist().count(0)), 0), np.int64)
        books[d] = [np.ascontiguousarray(p) for p in (np.split(m, parts, axis=1) if d else [m] * parts)]
    return Model(books, parts)


def sums(rows: DataFrame, model: Model, entries: int) -> DataFrame:
    """(dim, part, entry, place, n, total): how many parts are nearest to each entry, and the sum of their components.

    A task sends one row for each component of an entry that it has used, whatever the rows it has read.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model)  # LARGEST numbers at most

    def run(batches):
        trees, total, count = shared.value.trees(), {}, {}
        for b in batches:
            for d, _, vecs in by_length(b) if b.num_rows else []:
                if not d:
                    continue
                books, m = shared.value.books[d], whole(vecs, entries)
                index, _ = assigned(m, books, trees[d])
                sums = total.setdefault(d, np.zeros((len(books), entries, d // len(books)), np.int64))
                n = count.setdefault(d, np.zeros((len(books), entries), np.int64))
                for p, part in enumerate(np.split(m, len(books), axis=1)):
                    np.add.at(sums[p], index[:, p], part)
                    n[p] += np.bincount(index[:, p], minlength=entries)
        for d, s in total.items():
            p, e, w = (x.ravel() for x in np.indices(s.shape))
            used = count[d][p, e] > 0
            cols = [np.full(used.sum(), d), p[used], e[used], w[used], count[d][p, e][used], s.ravel()[used]]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], ["dim", "part", "entry", "place", "n", "total"])

    made = rows.select("vec", "dim").mapInArrow(run, "dim long, part long, entry long, place long, n long, total long")
    return made.groupBy("dim", "part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def learn(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Model:
    """Codebooks, one for each part position, from all rows.

    A codebook starts as that part of the `entries` smallest ids' vectors and has fewer entries if there are fewer rows. Each round
    replaces every used entry by its parts' componentwise floor(sum / count). Rows whose vector is null or holds null or non-finite
    components take no part; vectors of each length have codebooks of their own. Lengths that `parts` does not divide, and components beyond exact
    integers, are errors. An empty table gives a model without codebooks.
    """
    rows = usable(df, vec_col)
    model = first_entries(rows, id_col, parts, entries)
    for _ in range(rounds):
        for r in sums(rows, model, entries).toArrow().to_pylist():  # a row for each entry component
            model.books[r["dim"]][r["part"]][r["entry"], r["place"]] = r["total"] // r["n"]
    return model


def encode(df: DataFrame, model: Model, vec_col: str = "embedding") -> DataFrame:
    """df's rows that take part, with code (array of entry indexes, one for each part), error (squared distances in sum) and length.

    Columns of df of these names are replaced. Repeated rows stay. A vector of a length that the model has not seen is an error.
    """
    kept = [c for c in df.columns if c not in ("code", "error", "length")]
    ids = df.select(*[F.col(f"`{c}`") for c in kept])
    rows = usable(
        ids.select(F.struct(*[F.col(f"`{c}`") for c in kept if c != vec_col]).alias("row"), F.col(f"`{vec_col}`").alias("given")) if len(kept) > 1 else ids.select(F.lit(None).cast("int").alias("row"), F.col(f"`{vec_col}`").alias("given")),
        "given"
    )
    shared = df.sparkSession.sparkContext.broadcast(model)  # LARGEST numbers at most
    entries = max((len(b) for books in model.books.values() for b in books), default=1)

    def run(batches):
        trees = shared.value.trees()
        for b in batches:
            code, error = [None] * b.num_rows, np.zeros(b.num_rows, np.int64)
            for d, places, vecs in by_length(b) if b.num_rows else []:
                index, away = assigned(whole(vecs, entries), shared.value.books[d], trees[d]) if d else (np.zeros((len(places), shared.value.parts), np.int64),) * 2
                error[places] = away.sum(axis=1)
                for k, c in zip(places.tolist(), index.tolist(), strict=True):
                    code[k] = c
            cols = [b.column("row"), b.column("given"), pa.array(code, pa.list_(pa.int32())), pa.array(error), pa.array(b.column("dim").to_numpy().astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, ["row", "given", "code", "error", "length"])

    schema = f"row {rows.schema['row'].dataType.simpleString()}, given {rows.schema['given'].dataType.simpleString()}, code array<int>, error long, length int"
    made = rows.select("row", "given", "vec", "dim").mapInArrow(run, schema)
    return made.select(*[(F.col("given") if c == vec_col else F.col("row")[c]).alias(c) for c in kept], "code", "error", "length")


def with_sum_by(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """df with the sum of value over all rows of the same key, nulls together, as column name. One row a key is joined, sent to every task only if these are few."""
    per_key = df.groupBy(F.col(f"`{key}`").alias("_key")).agg(F.sum(value).alias(name))
    return df.join(tables.small(per_key), F.col(f"`{key}`").eqNullSafe(F.col("_key"))).drop("_key")


def hexed(codes: str) -> F.Column:
    """Two hex digits for each index, in order."""
    return F.array_join(F.transform(codes, lambda x: F.lpad(F.lower(F.hex(x)), 2, "0")), "")
