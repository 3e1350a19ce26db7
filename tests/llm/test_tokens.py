"""Encoding, decoding, counting and packing against the public libraries."""

from __future__ import annotations

import base64
import hashlib
import zlib
from array import array
from collections import Counter, defaultdict

import pytest
import regex
import sentencepiece
import tiktoken
import tokenizers
from helpers_llm import odd_documents
from pyspark.sql import functions as F

from pliego.llm import bpe, packing, queries, token_counts
from pliego.llm.tables import tokenizer_path

RANKS, JSON, PIECES = (tokenizer_path(n) for n in ("byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_encoding_equals_library(spark, library):
    docs = odd_documents(spark)
    wanted = sorted(((r["doc_id"], library.encode_ordinary(r["text"] or "")) for r in docs.collect()), key=repr)
    assert rows_of(bpe.encode(docs, RANKS), "doc_id", "ids") == wanted
    small = bpe.encode(docs, RANKS, chunk=50, overlap=12)
    assert rows_of(small, "doc_id", "ids") == wanted


def test_decoding_is_the_inverse(spark):
    docs = odd_documents(spark)
    back = bpe.decode(bpe.encode(docs, RANKS), RANKS)
    assert rows_of(back, "doc_id", "bytes") == sorted(((r["doc_id"], bytearray((r["text"] or "").encode())) for r in docs.collect()), key=repr)
    odd = spark.createDataFrame([(1, None), (2, []), (3, [0, 255])], "i int, ids array<int>").coalesce(1)
    assert [r["bytes"] for r in bpe.decode(odd, RANKS).orderBy("i").collect()][:2] == [None, b""]
    assert bpe.encode(docs.limit(0), RANKS).count() == 0


def test_pattern_is_the_public_one(library):
    public = pytest.importorskip("public_tokenizers")
    assert public.PATTERN == bpe.PATTERN
    text = "one  two\n three' don't  "
    assert [m for part in bpe.cut(text) for m in regex.findall(bpe.PATTERN, part)]


def test_encoding_query(spark, sf, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op4_byte_bpe(spark, sf).collect():
        ids = library.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest())


def test_counts_equal_library(spark, sf):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    docs = odd_documents(spark)
    wanted = sorted(((r["doc_id"], len((r["text"] or "").encode()), len(model.encode(r["text"] or ""))) for r in docs.collect()), key=repr)
    assert rows_of(token_counts.count_tokens(docs, PIECES), "doc_id", "n_bytes", "n_tokens") == wanted
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op3_token_counts(spark, sf).collect()
    assert len(got) == len(texts)
    assert all((r["n_tokens"], r["over_limit"]) == (n := len(model.encode(texts[r["doc_id"]])), n > 4096) for r in got)
    assert token_counts.count_tokens(docs.limit(0), PIECES).count() == 0


def test_shortcut_is_proven():
    counter = token_counts.Counter(PIECES)
    some = [w for w in counter.whole if w][:3000]
    assert all(len(ids) == 1 for ids in counter.model.encode(some, num_threads=1)) and len(counter.whole) > 1000


def check_packing(rows, size=packing.SIZE):
    """Every sequence is gapless from 0 and no longer than size; returns how many there are."""
    per = defaultdict(list)
    for r in rows:
        per[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in per.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= size
    return len(per)


def test_pieces_and_packing_of_odd_texts(spark):
    docs = odd_documents(spark)
    tok = tokenizers.Tokenizer.from_file(JSON)
    rows = packing.pack_documents(docs, JSON).collect()
    check_packing(rows)
    wanted, got = Counter(), Counter()
    for r in docs.collect():
        ids = [*tok.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        wanted[r["doc_id"], len(ids), zlib.crc32(array("I", ids[-1024:]).tobytes())] += 1
    for r in rows:
        got[r["doc_id"]] += r["length"]
        assert 1 <= r["length"] <= 1024 and (r["length"] == 1024 or r["start"] == 0)
    last = Counter((r["doc_id"], r["start"] + r["length"], r["ids_crc32"]) for r in rows if (r["start"] + r["length"]) in {n for i, n, _ in wanted if i == r["doc_id"]})
    assert last == wanted and sum(got.values()) == sum(n * c for (_, n, _), c in wanted.items())
    assert packing.pack_documents(docs.limit(0), JSON).count() == 0


def test_packing_query_is_near_the_bound(spark, sf):
    rows = queries.op2_best_fit_packing(spark, sf).collect()
    n = check_packing(rows)
    assert n <= 1.01 * -(-sum(r["length"] for r in rows) // 1024) + 1
    assert len({(r["doc_id"], r["piece"]) for r in rows}) == len(rows)


def best_possible(lengths, size):
    """The fewest sequences, by trying everything."""
    best = [len(lengths)]
    order = sorted(lengths, reverse=True)

    def place(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(order):
            best[0] = len(rooms)
            return
        for j in {rooms.index(r) for r in set(rooms) if r >= order[i]}:
            place(i + 1, [*rooms[:j], rooms[j] - order[i], *rooms[j + 1 :]])
        place(i + 1, [*rooms, size - order[i]])

    place(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(6))
def test_plan_against_brute_force(seed):
    import random

    rng = random.Random(seed)
    lengths = [rng.choice([rng.randint(1, 20), rng.randint(20, 60), rng.randint(40, 99)]) for _ in range(11)]
    runs = packing.plan(Counter(lengths), size=100)
    assert Counter(x for own, n in runs for x in own * n) == Counter(lengths) and all(sum(own) <= 100 for own, _ in runs)
    assert sum(n for _, n in runs) <= best_possible(lengths, 100) + 1


def test_plan_of_one_hot_length():
    runs = packing.plan({342: 999, 341: 1, 1: 5}, size=1024)
    assert sum(n for _, n in runs) <= 501 and packing.plan({}) == [] and packing.plan({1024: 0}) == []


def test_packing_pieces_of_one_length(spark):
    df = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.lit(512).cast("long").alias("length"))
    assert check_packing(packing.pack(df, order=("doc_id", "piece")).collect()) == 500


def test_counts_of_random_texts():
    """Odd spaces, the model's own space mark, accents, special strings."""
    import random

    rng = random.Random(12)
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    alphabet = [" ", "  ", "▁", "▁", "\t", "\n", " ", "　", "a", "b", "the", "word", "é", "é", "日", "🎉", "<s>", "</s>", "<unk>", "1", ".", "​", "ﬁ", "①"]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(1, 8))) for _ in range(10_000)] + ["▁ ", "a▁ ", "word ▁ ", "x▁  y"]
    counts = token_counts.Counter(PIECES).counts(texts)
    assert [t for t, n, ids in zip(texts, counts, model.encode(texts), strict=True) if n != len(ids)] == []


def test_packing_query_equals_library(spark, sf):
    """Ids, pieces and checksums of every document of the query's own table."""
    tok = tokenizers.Tokenizer.from_file(JSON)
    wanted = set()
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = [*tok.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        starts = [0, *range((len(ids) - 1) % 1024 + 1, len(ids), 1024)]
        for piece, (at, end) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
            wanted.add((r["doc_id"], piece, at, end - at, zlib.crc32(array("I", ids[at:end]).tobytes())))
    got = rows_of(queries.op2_best_fit_packing(spark, sf), "doc_id", "piece", "start", "length", "ids_crc32")
    assert len(got) == len(wanted) and set(got) == wanted


def test_plan_does_not_grow_with_documents():
    import random

    rng = random.Random(3)
    share = {n: (rng.random() + 0.01) / n for n in range(1, 1024)}  # mostly short ones, as documents are
    total = sum(share.values())
    sizes = []
    for pieces in (10**4, 10**7, 10**10):
        lengths = {n: int(s / total * pieces) for n, s in share.items()}
        runs = packing.plan(lengths)
        assert sum(n for _, n in runs) <= 1.002 * -(-sum(n * c for n, c in lengths.items()) // 1024) + 1
        sizes.append(len(packing.places(runs)))
    assert max(sizes) < 12 * 1024


def test_shares_of_one_length(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARE", 70)
    df = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.when(F.col("id") < 900, 512).otherwise(100).cast("long").alias("length"), F.lit("x").alias("_salt"))
    rows = packing.pack(df, order=("doc_id", "piece")).collect()
    assert len(rows) == 1000 and check_packing(rows) == 460


def test_names_that_are_taken(spark):
    pieces = spark.createDataFrame([(1, 0, 5)], "doc_id long, piece int, length long")
    for name in ("sequence_id", "Offset", "_pack_own"):
        with pytest.raises(ValueError, match=name):
            packing.pack(pieces.withColumn(name, F.lit(1)))
    path = tokenizer_path("byte_bpe_50k.tiktoken")
    coded = bpe.encode(spark.createDataFrame([(1, "some words")], "doc_id long, text string"), path).withColumn("bytes", F.lit("old"))
    got = bpe.decode(coded, path)
    assert got.columns == ["doc_id", "ids", "bytes"] and bytes(got.first()["bytes"]) == b"some words"
