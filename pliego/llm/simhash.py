"""SimHash near-duplicates: tiled exact comparison of fingerprints.

Equal fingerprints are one node. The nodes are sorted into cells by their bit counts: the whole count, or those of halves, quarters
or bytes, the finer the more nodes there are, so that cells hold hundreds of nodes. Two fingerprints whose counts differ by more
than the radius in sum differ in more bits than the radius, so such pairs of cells are skipped. Cells are cut into tiles of
bounded size, and each remaining pair of tiles is compared whole, with numpy exclusive-or and bit counts. A pair of tiles returns a star for each group that it links, never all pairs of the group; the stars of all
tiles give the components by rounds of alternating large and small stars.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pliego.llm import tables

RADIUS = 3
WORDS = 3
SEED = 42
TILE = 2048
STRIP = 32
ROUNDS = 200
#: From so many nodes on they are sorted by so many pieces' bit counts; the groups are the same with any of them.
PIECES = ((20_000_000, 8), (400_000, 4), (20_000, 2), (0, 1))
NODES_PER_TASK = 25_000


# Fingerprints


def fingerprint(text: str, words: int = WORDS, seed: int = SEED) -> int:
    """64 bits, as a signed integer: each set if it is set in more than half of the hashes of the text's shingles."""
    w = text.encode().lower().split()
    if not w:
        return 0
    if len(w) <= words:
        hashes = [xxhash.xxh64_intdigest(b" ".join(w), seed)]
    else:
        joined = b" ".join(w)
        sizes = np.fromiter(map(len, w), np.int64, len(w))
        ends = np.cumsum(sizes + 1) - 1
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], seed) for a, b in zip((ends - sizes)[: len(w) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)]
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return int(np.packbits(bits.sum(axis=0, dtype=np.int64) * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, seed: int = SEED) -> DataFrame:
    """(id_col, fingerprint long) of every whole text, one row for each row of docs.

    Only A-Z are lower-cased and only the six ASCII white-space characters part words. A null text is an empty one; a text with
    no word has fingerprint zero.
    """
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([fingerprint(t, words, seed) for t in b.column("text").to_pylist()], pa.int64())], ["id", "fingerprint"])

    schema = T.StructType([T.StructField("id", base.schema["id"].dataType), T.StructField("fingerprint", T.LongType())])
    return base.mapInArrow(run, schema).withColumnRenamed("id", id_col)


# Tiles


def cell(col: str, pieces: int) -> Column:
    """The bit counts of a fingerprint's pieces as one number, a digit each."""
    width = 64 // pieces
    out = F.lit(0)
    if pieces == 1:
        return F.bit_count(F.col(col)).cast("int")
    for i in range(pieces):
        out = out * (width + 1) + F.bit_count(F.shiftrightunsigned(F.col(col), width * i).bitwiseAND(F.lit((1 << width) - 1)))
    return out.cast("int")


def shifts(radius: int, pieces: int) -> list[int]:
    """Cell number differences to every cell, itself included, whose counts differ by `radius` in sum at most; one of each two ways."""
    near = [()]
    for _ in range(pieces):
        near = [(*v, d) for v in near for d in range(-radius, radius + 1) if sum(map(abs, v)) + abs(d) <= radius]
    base = 64 // pieces + 1
    return [sum(d * base ** (pieces - 1 - i) for i, d in enumerate(v)) for v in near if v >= (0,) * pieces]


def near_pairs(left: np.ndarray, right: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (in left, in right) of the pairs that differ in `radius` bits at most, a strip of left at a time so that it stays in cache."""
    found = [np.nonzero(np.bitwise_count(left[at : at + STRIP, None] ^ right[None, :]) <= radius) for at in range(0, len(left), STRIP)]
    i = np.concatenate([f[0] + at * STRIP for at, f in enumerate(found)]) if found else np.empty(0, np.int64)
    return i, np.concatenate([f[1] for f in found]) if found else i


def stars(left: np.ndarray, right: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For the fingerprints of two tiles: (member, centre) of each group that links of at most `radius` bits make among them."""
    i, j = near_pairs(left, right, radius)
    values, place = np.unique(np.concatenate([left[i], right[j]]).view(np.int64), return_inverse=True)
    a, b = place[: len(i)], place[len(i) :]
    centre = np.arange(len(values))
    while True:
        low = np.minimum(centre[a], centre[b])
        new = centre.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, centre, new.copy())
        new = new[new]
        if (new == centre).all():
            break
        centre = new
    moved = np.flatnonzero(centre != np.arange(len(values)))
    return values[moved], values[centre[moved]]


def links(nodes: DataFrame, radius: int = RADIUS, tile: int = TILE, pieces: int | None = None) -> DataFrame:
    """(u, v): edges that join the same groups as all pairs of distinct fingerprints within the radius would, and few more.

    nodes: column fingerprint, distinct. pieces: 1, 2, 4 or 8, by default by the number of nodes; the groups are the same.
    """
    n = nodes.count()
    pieces = pieces or next(p for least, p in PIECES if n >= least)
    tasks = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(50_000, n // NODES_PER_TASK))
    marked = nodes.select("fingerprint", cell("fingerprint", pieces).alias("cell"))
    per_cell = marked.groupBy("cell").count()
    parts = F.ceil(F.col("count") / tile).cast("int")
    sized = marked.join(F.broadcast(per_cell) if pieces <= 4 else per_cell, "cell")  # 17 ** 4 cells at most; cells of bytes are not sent
    tiles = sized.withColumn("part", F.pmod(F.xxhash64("fingerprint"), parts).cast("int")).groupBy("cell", "part").agg(F.collect_list("fingerprint").alias("tile"))
    tiles = tables.written(tiles)
    near = F.explode(F.array(*[F.lit(s) for s in shifts(radius, pieces)]))
    left = tiles.select(F.col("cell").alias("own"), F.col("part").alias("own_part"), F.col("tile").alias("left"), near.alias("shift"))
    right = tiles.select("cell", "part", F.col("tile").alias("right"))
    # tiles are small and their comparison is not, so tasks are counted by nodes, not by bytes
    pairs = left.withColumn("cell", F.col("own") + F.col("shift")).repartition(tasks, "cell").join(right.repartition(tasks, "cell"), "cell")
    pairs = pairs.where((F.col("shift") != 0) | (F.col("part") >= F.col("own_part"))).select("left", "right")

    def compare(batches):
        for b in batches:
            u, v = [], []
            for k in range(b.num_rows):
                x, y = (b.column(c)[k].values.to_numpy().view(np.uint64) for c in ("left", "right"))
                member, centre = stars(x, y, radius)
                u.append(member)
                v.append(centre)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else np.empty(0, np.int64), pa.int64()) for c in (u, v)], ["u", "v"])

    return pairs.mapInArrow(compare, "u long, v long").distinct()


# Components


def is_stars(edges: DataFrame) -> bool:
    """Whether every node is either a centre or has one edge, to a centre."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("out")), F.struct(F.col("v").alias("node"), F.lit(0).alias("out")))).alias("e")).select("e.*")
    per_node = ends.groupBy("node").agg(F.sum("out").alias("n"), F.min("out").alias("least"))
    return per_node.where("n > 1 OR (n = 1 AND least = 0)").isEmpty()


def components(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(node, root): the smallest node that can be reached, for every node that has an edge.

    Large stars join each node's larger neighbours to its smallest one, small stars its smaller neighbours; both keep components
    whole and together end in stars. Each round is written, so a lost executor costs one round at most. Rounds grow with the
    logarithm of the nodes; if `rounds` are not enough that is an error, never a result with links left out.
    """
    edges = tables.written(edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    done = 0
    while not is_stars(edges):
        if done == rounds:
            raise RuntimeError(f"components are not settled after {rounds} rounds")
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).distinct()
        large = tables.written(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select("v", "m").where(F.col("v") != F.col("m")).toDF("u", "v")
        edges = tables.written(small.unionByName(low.toDF("u", "v")).distinct())
        done += 1
    # in a star every member is larger than its centre
    return edges.toDF("node", "root").unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """Every row's id_col, fingerprint (16 hex digits) and component_id, the smallest id that links reach from it.

    Fingerprints that differ in `radius` bits at most are linked, equal ones and those of empty texts like any other. Null texts are
    empty ones. Rows with a null id are linked too and stay; where no row of a component has an id, component_id is null.
    Repeated ids stay, a row each. Other columns are left out; an empty table gives an empty one.
    """
    prints = tables.written(fingerprints(docs, id_col, text_col, words))
    named = named_components(prints, radius, id_col)
    hexed = F.lpad(F.lower(F.hex("fingerprint")), 16, "0")
    return prints.join(named, "fingerprint").select(id_col, hexed.alias("fingerprint"), "component_id")


def named_components(prints: DataFrame, radius: int, id_col: str) -> DataFrame:
    """(fingerprint, component_id) of every distinct fingerprint of prints; nulls are no smallest id."""
    nodes = tables.written(prints.groupBy("fingerprint").agg(F.min(id_col).alias("low")))
    found = components(links(nodes, radius)).withColumnRenamed("node", "fingerprint")
    rooted = nodes.join(found, "fingerprint").select("fingerprint", "low", "root")
    lows = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    linked = rooted.join(lows, "root").select("fingerprint", "component_id")
    return nodes.join(linked, "fingerprint", "left").select("fingerprint", F.coalesce("component_id", "low").alias("component_id"))


def first_of_each(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of near-duplicates: that of its smallest id, null ids last.

    Rows with null ids are linked like any other. Among rows of a group's smallest id, that whose columns hash lowest stays, and of
    rows equal in all columns any one. Null and empty texts are one group. All columns stay as they are, whatever their names and types, maps
    and variants included. Very long texts count whole; an empty table gives an empty one. docs is read more than once and has to be the same
    each time (a written table).
    """
    every = [tables.comparable(F.col(f"`{f.name}`"), f.dataType) for f in docs.schema.fields]
    a, b, n, copy_of = (tables.free(f"_near_{k}", docs.columns) for k in ("a", "b", "n", "copy"))
    keys = {a: F.xxhash64(*every), b: F.hash(*every)}  # 96 bits that tell rows apart
    own = docs.select(F.struct(F.col(id_col).alias("id"), *[k.alias(name) for name, k in keys.items()]).alias("row"), F.col(text_col).alias("text"))
    prints = tables.written(fingerprints(own, "row", "text"))
    order = F.struct(F.col("row.id").isNull(), "row")
    nodes = tables.written(prints.groupBy("fingerprint").agg(F.min(order).alias("low")))
    found = components(links(nodes, radius)).withColumnRenamed("node", "fingerprint")
    # one row for each group: a group is named by its root, a fingerprint without a link by itself
    kept = nodes.join(found, "fingerprint", "left").groupBy(F.coalesce("root", "fingerprint").alias("group")).agg(F.min("low").alias("low"))
    equal = prints.groupBy(f"row.{a}", f"row.{b}").agg(F.count("*").alias(n)).where(F.col(n) > 1)
    kept = tables.written(kept.select(f"low.row.{a}", f"low.row.{b}").join(equal, [*keys], "left"))
    rows = docs.withColumns(keys).join(kept, [*keys])
    copy = Window.partitionBy(*keys).orderBy(F.lit(0))  # rows equal in all columns
    some = rows.where(F.col(n).isNotNull()).withColumn(copy_of, F.row_number().over(copy)).where(F.col(copy_of) == 1)
    names = [F.col(f"`{c}`") for c in docs.columns]
    return rows.where(F.col(n).isNull()).select(names).unionByName(some.select(names))
