"""Byte-level BPE: encoding by overlapping chunks, and decoding.

A text longer than CHUNK characters is cut into chunks that overlap. The chunks are pre-tokenised in parallel, each from its
own first character, which may lie inside a pre-token. Within an overlap the two chunks' boundaries soon fall together, and
as the pattern looks only forward they agree from the first common one on: there the chunks are stitched. The pieces between
stitches are then encoded in parallel. Where an overlap holds no common boundary (one pre-token longer than the overlap), the
rest of that text is encoded as one piece, so the ids are always those of the whole text. Decoding concatenates raw bytes.
"""

from __future__ import annotations

import base64
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK = 32_000
OVERLAP = 2_000
MEMO = 100_000
SLICE = 500
MEMO_CHARS = 64

#: The pattern that cuts texts into pre-tokens for the public 50k vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_LOOSE_SPACE = re.compile(r" (?:\s|\Z)")
_CUT = re.compile(r" (?=\S)")


def cut(text: str) -> list[str]:
    """text cut before every space that a non-space follows, that space left out; no pre-token of PATTERN crosses such a cut."""
    return _CUT.split(text) if _LOOSE_SPACE.search(text) else text.split(" ")


class Memo(dict):
    """key -> make(key), remembered for `most` short keys at most."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= MEMO_CHARS:
            if len(self) >= self.most:
                self.clear()
            self[key] = value
        return value


class Codec:
    """Ids of a text as little-endian uint32 bytes."""

    def __init__(self, encode, most: int = MEMO):
        self.encode_part = encode
        self.after_space = Memo(lambda part: array("I", encode(" " + part)).tobytes(), most)

    def encode(self, text: str) -> bytes:
        first, *rest = cut(text)
        return b"".join([array("I", self.encode_part(first)).tobytes(), *map(self.after_space.__getitem__, rest)])


@lru_cache(maxsize=4)
def rank_codec(path: str, pattern: str = PATTERN) -> Codec:
    """From a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    library = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return Codec(library.encode_ordinary)


def list_array(flat: np.ndarray, lengths: list[int]) -> pa.ListArray:
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32)))


def boundaries(text: str, start: int, lo: int, hi: int, pattern) -> list[int]:
    """Absolute places in [lo, hi) where a pre-token starts right after a non-space, for a chunk that starts at `start`.

    The last two characters of the chunk are left out, as what follows them is not seen.
    """
    last = start + len(text) - 2
    return [p for m in pattern.finditer(text) if lo <= (p := start + m.start()) < min(hi, last) and m.start() and not text[m.start() - 1].isspace()]


def encode_rows(path: str, pattern: str, keep: list[str], text: str = "text"):
    """For mapInArrow: the columns of `keep`, and ids of the text."""

    def run(batches):
        codec = rank_codec(path, pattern)
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                b = whole.slice(at, SLICE)
                raw = [codec.encode(t or "") for t in b.column(text).to_pylist()]
                ids = list_array(np.frombuffer(b"".join(raw), np.uint32), [len(r) // 4 for r in raw])
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), ids], [*keep, "ids"])

    return run


def stitched(long: DataFrame, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """Pieces of long texts that can be encoded apart: row, id, run (their order) and text."""
    n = F.ceil(F.length("text") / F.lit(chunk)).cast("int")
    chunks = long.select("row", "id", F.length("text").alias("size"), "text", F.explode(F.sequence(F.lit(0), n - 1)).alias("k"))
    chunks = chunks.select("row", "id", "size", "k", F.expr(f"substring(text, k * {chunk} + 1, {chunk + overlap})").alias("text"))
    chunks = chunks.repartition(F.col("row"), F.col("k"))
    kind = long.schema["id"].dataType
    schema = T.StructType([
        T.StructField("row", T.LongType()), T.StructField("id", kind), T.StructField("size", T.IntegerType()), T.StructField("k", T.IntegerType()),
        T.StructField("text", T.StringType()), T.StructField("head", T.ArrayType(T.IntegerType())), T.StructField("tail", T.ArrayType(T.IntegerType()))
    ])

    def pre_tokenise(batches):
        compiled = regex.compile(pattern)
        for b in batches:
            heads, tails = [], []
            for k, text in zip(b.column("k").to_pylist(), b.column("text").to_pylist(), strict=True):
                at, end = k * chunk, (k + 1) * chunk
                found = boundaries(text, at, at, end + overlap, compiled)
                heads.append([p for p in found if p < at + overlap])
                tails.append([p for p in found if p >= end])
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(x, pa.list_(pa.int32())) for x in (heads, tails))], [*b.schema.names, "head", "tail"])

    marked = chunks.mapInArrow(pre_tokenise, schema)
    by_row = Window.partitionBy("row")
    order = by_row.orderBy("k")
    start = F.when(F.col("k") == 0, 0).otherwise(F.get(F.array_intersect(F.lag("tail").over(order), F.col("head")), F.lit(0)))
    met = marked.withColumn("start", start).drop("head", "tail")
    lost = F.min(F.when(F.col("start").isNull(), F.col("k"))).over(by_row)
    met = met.withColumn("run", F.coalesce(F.least(F.col("k"), lost - 1), F.col("k")))
    stop = F.lead("start").over(order)
    met = met.withColumn("stop", F.coalesce(stop, F.col("size")))
    piece = F.struct("k", "start", "stop", "text")
    runs = met.groupBy("row", "id", "run").agg(F.sort_array(F.collect_list(piece)).alias("parts"))
    whole = F.when(F.size("parts") == 1, F.col("parts")[0]["text"]).otherwise(F.concat(F.array_join(F.transform(F.slice("parts", 1, F.size("parts") - 1), lambda p: F.substring(p["text"], 1, chunk)), ""), F.element_at("parts", -1)["text"]))
    begin = F.col("parts")[0]["start"]
    size = F.element_at("parts", -1)["stop"] - begin
    return runs.select("row", "id", "run", F.substring(whole, begin - F.col("parts")[0]["k"] * chunk + 1, size).alias("text"))


def encode(docs: DataFrame, path: str, pattern: str = PATTERN, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(id_col, ids array<int>) of every whole text, one row for each row of docs.

    A null text is an empty one and has no ids; null and repeated ids stay, a row each; other columns are left out. Texts of
    up to `chunk` characters are encoded where they lie, longer ones by overlapping chunks spread over the cluster.
    """
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = base.schema["id"].dataType
    ids = T.StructField("ids", T.ArrayType(T.IntegerType()))
    one = T.StructType([T.StructField("id", kind), ids])
    short = base.where(F.length("text") <= chunk).mapInArrow(encode_rows(path, pattern, ["id"]), one)
    long = base.where(F.length("text") > chunk).withColumn("row", F.monotonically_increasing_id())
    part = T.StructType([T.StructField("row", T.LongType()), T.StructField("id", kind), T.StructField("run", T.IntegerType()), ids])
    pieces = stitched(long, pattern, chunk, overlap).mapInArrow(encode_rows(path, pattern, ["row", "id", "run"]), part)
    joined = pieces.groupBy("row", "id").agg(F.sort_array(F.collect_list(F.struct("run", "ids"))).alias("runs"))
    joined = joined.select("id", F.flatten(F.col("runs")["ids"]).alias("ids"))
    return short.unionByName(joined).withColumnRenamed("id", id_col)


@lru_cache(maxsize=4)
def token_bytes(path: str) -> pa.Array:
    """Every token's bytes by id; ids that the file lacks are null."""
    with open(path, "rb") as f:
        tokens = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, f)}
    return pa.array([tokens.get(i) for i in range(max(tokens, default=-1) + 1)], pa.large_binary())


def joined_bytes(ids: pa.ListArray, tokens: pa.Array) -> pa.Array:
    """The bytes of each list's tokens, one after the other: taking them in order lays them out so already."""
    taken = tokens.take(ids.flatten())
    if taken.null_count:
        raise ValueError("ids without a token")
    ends = np.zeros(len(ids) + 1, np.int64)
    np.cumsum(ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), out=ends[1:])
    starts = np.frombuffer(taken.buffers()[1], np.int64)[taken.offset : taken.offset + len(taken) + 1] if len(taken) else np.zeros(1, np.int64)
    valid = pa.array(ids.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8)).cast(pa.bool_()).buffers()[1] if ids.null_count else None
    return pa.Array.from_buffers(pa.large_binary(), len(ids), [valid, pa.py_buffer(starts[ends].tobytes()), taken.buffers()[2]]).cast(pa.binary())


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", slice_rows: int = SLICE) -> DataFrame:
    """encoded with bytes, the concatenated raw bytes of the ids; null ids give null, no ids give no bytes. A column bytes that is there already is replaced."""
    encoded = encoded.select(*[F.col(f"`{c}`") for c in encoded.columns if c.lower() != "bytes"])
    schema = T.StructType([*encoded.schema.fields, T.StructField("bytes", T.BinaryType())])

    def run(batches):
        tokens = token_bytes(path)
        for whole in batches:
            for at in range(0, whole.num_rows, slice_rows):
                b = whole.slice(at, slice_rows)
                yield pa.RecordBatch.from_arrays([*b.columns, joined_bytes(b.column(ids_col), tokens)], [*b.schema.names, "bytes"])

    return encoded.mapInArrow(run, schema)
