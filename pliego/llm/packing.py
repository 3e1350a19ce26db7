"""Packing token sequences of a fixed size as full as possible, by linear grouping.

Lengths are integers up to the sequence size, so the whole problem is a histogram with at most `size` bars however many
documents there are. That histogram alone goes to the driver:

1. large lengths are sorted and cut into groups of equal cardinality, each rounded up to its group's longest;
2. for these few sizes the configurations (which sizes share a sequence, and how often) are optimised as a linear program by
   column generation, and rounded down;
3. actual lengths take the places of the rounded ones, which leaves room in the sequences;
4. the rest, large ones left over by rounding and all small ones, is put where it fits best, longest first.

The plan is again a table whose size depends on the number of lengths, not of documents. Documents find their places by
joining their rank among those of equal length with it.
"""

from __future__ import annotations

import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
import tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pliego.llm import bpe, tables

SIZE = 1024
GROUPS = 48
SMALL = (1 / 2, 1 / 3, 1 / 5)
SHARE = 250_000
MEMO = 300_000

PLAIN = re.compile("[\\n\\t -~\u00a1-\u024f]*\\Z")


# Configurations


def best_configuration(sizes: np.ndarray, worth: np.ndarray, size: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes that fits: unbounded knapsack."""
    value, choice = np.zeros(size + 1), np.full(size + 1, -1)
    for room in range(int(sizes.min()), size + 1):
        fits = sizes <= room
        got = np.where(fits, worth + value[np.maximum(room - sizes, 0)], -1)
        i = int(got.argmax())
        value[room], choice[room] = (got[i], i) if got[i] > value[room - 1] + 1e-15 else (value[room - 1], -1)
    column, room = np.zeros(len(sizes)), size
    while room > 0:
        if choice[room] < 0:
            room -= 1
        else:
            column[choice[room]] += 1
            room -= int(sizes[choice[room]])
    return float(value[size]), column


def configurations(sizes: np.ndarray, demand: np.ndarray, size: int, rounds: int = 400) -> list[tuple[np.ndarray, int]]:
    """Configurations with whole multiplicities that together need no more of any size than is there."""
    basis = np.diag((size // sizes).astype(float))
    inverse = np.linalg.inv(basis)
    for turn in range(rounds):
        if turn % 25 == 24:
            inverse = np.linalg.inv(basis)
        value, column = best_configuration(sizes, np.maximum(inverse.sum(axis=0), 0), size)
        if value <= 1 + 1e-7:
            break
        level, step = inverse @ demand, inverse @ column
        up = np.flatnonzero(step > 1e-9)
        if not len(up):
            break
        leaves = up[(np.maximum(level[up], 0) / step[up]).argmin()]
        basis[:, leaves] = column
        pivot = inverse[leaves] / step[leaves]
        inverse = inverse - np.outer(step, pivot)
        inverse[leaves] = pivot
    often = np.floor(np.linalg.solve(basis, demand) + 1e-9).astype(int)
    return [(basis[:, i].astype(int), n) for i, n in enumerate(often.tolist()) if n > 0]


# The plan


Runs = list[tuple[tuple[int, ...], int]]


def plan(lengths: dict[int, int], size: int = SIZE, groups: int = GROUPS, small: tuple[float, ...] = SMALL) -> Runs:
    """Runs of equal sequences: the lengths in each, and how many such sequences. lengths: how many documents of each length.

    small: which shares of `size` to try as the border of large and small lengths; the plan of fewest sequences is returned.
    """
    return min((grouped(lengths, size, groups, s) for s in small), key=lambda runs: sum(n for _, n in runs))


def grouped(lengths: dict[int, int], size: int, groups: int, small: float) -> Runs:
    left = Counter({n: c for n, c in lengths.items() if c > 0})
    room: dict[int, Runs] = defaultdict(list)
    large = sorted((n for n in left if n > small * size), reverse=True)
    total = sum(left[n] for n in large)
    if total:
        counts = np.array([left[n] for n in large])
        ends = np.cumsum(counts)
        cuts = [int(c) for c in np.unique(np.ceil(np.arange(1, groups + 1) * total / groups))]
        queues: list[list[list[int]]] = []
        at = 0
        for end in cuts:
            own = []
            for i in range(int(np.searchsorted(ends, at, side="right")), len(large)):
                take = int(min(ends[i], end) - max(ends[i] - counts[i], at))
                if take <= 0:
                    break
                own.append([int(large[i]), take])
            queues.append(own)
            at = end
        tops, demand = np.array([q[0][0] for q in queues]), np.array([sum(c for _, c in q) for q in queues])
        sizes, which = np.unique(tops, return_inverse=True)
        need = np.bincount(which, weights=demand)
        merged: list[list[list[int]]] = [[] for _ in sizes]
        for q, w in zip(queues, which, strict=True):
            merged[w] += q
        for column, often in configurations(sizes, need, size):
            slots = [int(g) for g in np.repeat(np.arange(len(sizes)), column)]
            while often:
                wants = Counter(slots)
                fill, n = [], often
                for g, times in wants.items():  # a run ends where a queue goes on to its next length
                    here, rest = [], times
                    head = merged[g][0]
                    if head[1] >= times:
                        n = min(n, head[1] // times)
                        here = [(head[0], times)]
                    else:
                        n = 1
                        for length, count in merged[g]:
                            here.append((length, min(count, rest)))
                            rest -= here[-1][1]
                            if not rest:
                                break
                    fill.append((g, here))
                for g, here in fill:
                    for length, times in here:
                        merged[g][0][1] -= times * n
                        left[length] -= times * n
                        if not merged[g][0][1]:
                            merged[g].pop(0)
                lengths_in = tuple(length for _, here in fill for length, times in here for _ in range(times))
                room[size - sum(lengths_in)].append((lengths_in, n))
                often -= n
    return best_fit(+left, room, size)


def best_fit(left: Counter, room: dict[int, Runs], size: int) -> Runs:
    """Longest first, each to the fullest sequence that still takes it; runs of equal sequences are handled as one."""
    free = sorted(room)
    for length in sorted(left, reverse=True):
        count = left[length]
        while count:
            i = bisect_left(free, length)
            slack = free[i] if i < len(free) else size
            if i < len(free):
                lengths_in, n = room[slack].pop()
                if not room[slack]:
                    free.pop(i)
                    del room[slack]
            else:
                lengths_in, n = (), -(-count // (size // length))
            each = min(slack // length, count)
            use = min(n, count // each)
            for more, m in (((length,) * each, use), ((), n - use if slack < size else 0)):
                if m:
                    at = slack - sum(more)
                    if at not in room:
                        insort(free, at)
                        room[at] = []
                    room[at].append((lengths_in + more, m))
            count -= each * use
    return [run for slack in sorted(room) for run in room[slack]]


def places(runs: Runs) -> list[tuple[int, int, int, int, int, list[int]]]:
    """The plan by length: (length, first rank, end rank, first sequence, places in a sequence, their offsets)."""
    seen: Counter = Counter()
    out, sequence = [], 0
    for lengths_in, n in runs:
        offsets, at = defaultdict(list), 0
        for length in lengths_in:
            offsets[length].append(at)
            at += length
        for length, own in offsets.items():
            out.append((length, seen[length], seen[length] + n * len(own), sequence, len(own), own))
            seen[length] += n * len(own)
        sequence += n
    return out


# Spark


def pack(pieces: DataFrame, size: int = SIZE, length_col: str = "length", groups: int = GROUPS, order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """pieces with sequence_id and offset: every piece in a sequence of at most `size` tokens, gapless from 0.

    pieces has to be the same whenever it is read (a written table). Lengths are 1 to `size`; pieces of exactly `size` fill a
    sequence alone. `order` names columns that tell equal pieces apart as far as they can be told; repeated rows take one place
    each. A column of pieces called sequence_id or offset, or beginning with _pack, is an error. An empty table gives an empty one.

    Pieces of one length are numbered in shares of about SHARE rows, as many as their count asks for, so that no task orders more
    however many pieces have that length.
    """
    spark = pieces.sparkSession
    if taken := [c for c in pieces.columns if c.lower() in ("sequence_id", "offset") or c.lower().startswith("_pack")]:
        raise ValueError(f"pieces already has columns {taken}")
    full = pieces.where(F.col(length_col) == size)
    full = full.withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    rest = pieces.where(F.col(length_col) < size)
    per_length = {r[0]: r[1] for r in rest.groupBy(length_col).count().collect()}  # size rows at most
    if not per_length:
        return full
    shares = F.array(*[F.lit(-(-per_length.get(n, 1) // SHARE)) for n in range(size)])
    rest = rest.withColumn("_pack_share", F.pmod(F.xxhash64(*order), F.get(shares, F.col(length_col).cast("int"))).cast("int"))
    counts = tables.written(rest.groupBy(length_col, "_pack_share").count())  # size rows, and one more for every SHARE pieces
    by_length = Window.partitionBy(length_col).orderBy("_pack_share").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(length_col, "_pack_share", F.coalesce(F.sum("count").over(by_length), F.lit(0)).alias("_pack_before"))
    own = Window.partitionBy(length_col, "_pack_share").orderBy(*order)
    ranked = rest.withColumn("_pack_own", F.row_number().over(own) - 1).join(tables.small(before), [length_col, "_pack_share"])
    ranked = ranked.withColumn("_pack_rank", F.col("_pack_own") + F.col("_pack_before"))
    table = places(plan(per_length, size, groups))
    spots = spark.createDataFrame(table, "_pack_length long, _pack_lo long, _pack_hi long, _pack_first long, _pack_times int, _pack_offsets array<long>")
    at = (F.col(length_col) == F.col("_pack_length")) & (F.col("_pack_rank") >= F.col("_pack_lo")) & (F.col("_pack_rank") < F.col("_pack_hi"))
    j = F.col("_pack_rank") - F.col("_pack_lo")
    placed = ranked.join(F.broadcast(spots), at)  # the plan's size hangs on the number of lengths only
    placed = placed.withColumn("sequence_id", F.col("_pack_first") + F.floor(j / F.col("_pack_times")).cast("long")).withColumn("offset", F.get("_pack_offsets", (j % F.col("_pack_times")).cast("int")))
    names = [*pieces.columns, "sequence_id", "offset"]
    return full.select(names).unionByName(placed.select(names))


class Ids:
    """Ids of a tokenizer file of the byte-level kind, as the library for it gives them.

    Words after a space are remembered. What lies wholly in Latin letters, digits and marks is merged by a second library from the
    same vocabulary, which cuts those alike and is faster; everything else, and texts that hold the special token's string, go
    to the file's own library.
    """

    def __init__(self, path: str):
        self.library = tokenizers.Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        vocabulary = {t: i for t, i in self.library.get_vocab(with_added_tokens=False).items() if t not in self.special}
        chars = byte_characters()
        ranks = {bytes(chars[c] for c in token): i for token, i in vocabulary.items()}
        self.fast = tiktoken.Encoding("vocabulary", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.codec = bpe.Codec(self.part, MEMO)

    def part(self, text: str) -> list[int]:
        if PLAIN.match(text):
            return self.fast.encode_ordinary(text)
        return self.library.encode(text, add_special_tokens=False).ids

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()
        return self.codec.encode(text)


def byte_characters() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: itself if printable Latin-1, else from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@lru_cache(maxsize=2)
def ids_of(path: str) -> Ids:
    return Ids(path)


def pieces(docs: DataFrame, path: str, end_id: int = 2, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Every document's ids and end_id, cut into pieces of `size`, the first of which may be shorter.

    Returns id_col, piece, start, length, ids_crc32 (of little-endian unsigned 32-bit ids) and, if asked for, ids. A null text is
    an empty one: one piece, end_id alone. Null and repeated ids stay; other columns are left out.
    """
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    fields = [T.StructField("id", base.schema["id"].dataType), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    fields += [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids
    end = array("I", [end_id]).tobytes()

    def run(batches):
        encode = ids_of(path).encode
        for b in batches:
            of, out, own = [], [], []
            for row, text in enumerate(b.column("text").to_pylist()):
                raw = encode(text) + end
                first = (len(raw) // 4 - 1) % size + 1
                starts = [0, *range(first, len(raw) // 4, size)]
                for piece, (at, stop) in enumerate(zip(starts, [*starts[1:], len(raw) // 4], strict=True)):
                    data = raw[at * 4 : stop * 4]
                    of.append(row)
                    out.append((piece, at, stop - at, zlib.crc32(data)))
                    if with_ids:
                        own.append(data)
            cols = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)] if out else [pa.array([], t) for t in (pa.int32(), pa.int64(), pa.int64(), pa.int64())]
            if with_ids:
                cols.append(bpe.list_array(np.frombuffer(b"".join(own), np.uint32), [len(d) // 4 for d in own]))
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(of, pa.int64())), *cols], [f.name for f in fields])

    return base.mapInArrow(run, T.StructType(fields)).withColumnRenamed("id", id_col)


def pack_documents(docs: DataFrame, path: str, end_id: int = 2, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All documents tokenised, cut and packed: id_col, piece, start, length, ids_crc32, sequence_id, offset."""
    cut = tables.written(pieces(docs, path, end_id, size, id_col, text_col))
    return pack(cut, size, order=(id_col, "piece", "start", "ids_crc32"))
