"""SimHash fingerprints, links and components against brute force."""

from __future__ import annotations

import random

import numpy as np
import xxhash
from helpers_llm import odd_documents

from pliego.llm import queries, simhash


def slow_fingerprint(text):
    words, own = [], ""
    for ch in text or "":
        if ch in " \t\n\x0b\x0c\r":
            words, own = [*words, own] if own else words, ""
        else:
            own += chr(ord(ch) + 32) if "A" <= ch <= "Z" else ch
    words = [*words, own] if own else words
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def slow_components(prints):
    """prints: (id, fingerprint) rows -> smallest id reachable, for each row."""
    values = sorted({p for _, p in prints})
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    low = {}
    for i, p in prints:
        if i is not None:
            low[find(p)] = min(i, low.get(find(p), i))
    return [(i, f"{p:016x}", low.get(find(p))) for i, p in prints]


def test_query_equals_brute_force(spark, sf):
    prints = [(r["doc_id"], slow_fingerprint(r["text"])) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = queries.op5_simhash(spark, sf)
    assert dict(got.dtypes) == {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"}
    assert sorted(map(tuple, got.collect())) == sorted(slow_components(prints))


def test_odd_documents(spark):
    docs = odd_documents(spark)
    prints = [(r["doc_id"], slow_fingerprint(r["text"])) for r in docs.collect()]
    assert sorted(map(tuple, simhash.near_duplicates(docs).collect()), key=repr) == sorted(slow_components(prints), key=repr)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_kept_documents(spark):
    """One row of each group, that of its smallest id, null ids last; other columns stay."""
    docs = odd_documents(spark)
    kept = simhash.first_of_each(docs)
    assert kept.columns == docs.columns
    prints = [slow_fingerprint(r["text"]) for r in docs.collect()]
    groups = {}
    for r, (_, _, root) in zip(docs.collect(), slow_components(list(enumerate(prints))), strict=True):
        groups.setdefault(root, []).append(r["doc_id"])
    wanted = [min((i for i in own if i is not None), default=None) for own in groups.values()]
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted(wanted, key=repr)
    assert simhash.first_of_each(docs.limit(0)).count() == 0


def test_kept_rows_of_one_id(spark):
    """Rows of one id with different texts are rows of different groups; equal rows leave one."""
    rows = [(1, "alpha beta gamma delta", 1), (1, "one two three four five", 2), (1, "one two three four five", 2), (None, "alpha beta gamma delta", 3), (None, "six seven eight nine", 4), (None, "six seven eight nine", 4), (5, "six seven eight nine", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row int").repartition(3)
    assert sorted(map(tuple, simhash.first_of_each(docs).collect()), key=repr) == [(1, "alpha beta gamma delta", 1), (1, "one two three four five", 2), (5, "six seven eight nine", 5)]


def chain(rng, length):
    """Fingerprints, each three bits from the one before it."""
    out = [rng.getrandbits(64)]
    for _ in range(length - 1):
        flip = 0
        for b in rng.sample(range(64), 3):
            flip |= 1 << b
        out.append(out[-1] ^ flip)
    return out


def signed(v):
    return v - (1 << 64) if v >> 63 else v


def test_links_of_chains_and_crowds(spark):
    rng = random.Random(9)
    centre = rng.getrandbits(64)
    crowd = [centre ^ (1 << a) ^ (1 << b) for a in range(0, 40) for b in range(a)]  # hundreds within four bits of each other
    values = sorted({*(v for _ in range(20) for v in chain(rng, 12)), *crowd, *(rng.getrandbits(64) for _ in range(400)), 0, (1 << 64) - 1})
    nodes = spark.createDataFrame([(signed(v),) for v in values], "fingerprint long").repartition(4)
    got, *others = ({n: r for n, r in simhash.components(simhash.links(nodes, tile=64, pieces=p)).collect()} for p in (1, 2, 4, 8))
    assert all(got == other for other in others)
    wanted = slow_components([(i, v) for i, v in enumerate(values)])
    groups = {}
    for (i, _, c), v in zip(wanted, values, strict=True):
        groups.setdefault(c, set()).add(signed(v))
    for own in groups.values():
        assert {got.get(v, v) for v in own} == {min(own)}


def test_cells_skip_only_far_pairs():
    rng = np.random.default_rng(4)
    for _ in range(2000):
        a = int(rng.integers(0, 2**63))
        b = a
        for bit in rng.choice(64, 3, replace=False):
            b ^= 1 << int(bit)
        for width in (64, 32, 16, 8):
            counts = [[(v >> width * i & (1 << width) - 1).bit_count() for i in range(64 // width)] for v in (a, b)]
            assert sum(abs(x - y) for x, y in zip(*counts, strict=True)) <= simhash.RADIUS
    assert (len(simhash.shifts(3, 4)), len(simhash.shifts(3, 8))) == (65, 417)


def test_unsettled_components_are_an_error(spark):
    import pytest

    edges = spark.createDataFrame([(i + 1, i) for i in range(40)], "u long, v long")
    assert {r["root"] for r in simhash.components(edges).collect()} == {0}
    with pytest.raises(RuntimeError):
        simhash.components(edges, rounds=1)


def test_tiles_hold_hundreds():
    rng = np.random.default_rng(8)
    for nodes, pieces in ((10_000, 1), (200_000, 2)):
        bits = np.unpackbits(rng.integers(0, 2**63, nodes, dtype=np.int64).view(np.uint8).reshape(-1, 8), axis=1).reshape(nodes, pieces, -1).sum(axis=2)
        _, counts = np.unique(bits, axis=0, return_counts=True)
        assert next(p for least, p in simhash.PIECES if nodes >= least) == pieces and (counts @ counts) / nodes > 300  # of a node's own cell


def test_kept_rows_of_any_columns(spark):
    """Columns that are called as those inside, and maps, arrays of maps and variants, stay as they are."""
    from pyspark.sql import functions as F

    rows = [(1, "alpha beta gamma delta", 0.0, {"k": 1, "l": 2}, 5), (1, "alpha beta gamma delta", 0.0, {"l": 2, "k": 1}, 5), (2, "alpha beta gamma delta", 1.5, {"k": 1}, 6), (3, "other words than these", 2.5, None, 7), (3, "other words than these", 2.5, {}, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _near_a double, tags map<string,int>, _NEAR_N int")
    docs = docs.withColumn("deep", F.array(F.struct(F.col("tags").alias("m")))).withColumn("v", F.parse_json(F.lit('{"a": 1}'))).repartition(3)
    kept = simhash.first_of_each(docs)
    assert kept.schema == docs.schema
    found = sorted((r["doc_id"], r["_near_a"], r["_NEAR_N"]) for r in kept.collect())
    assert found == [(1, 0.0, 5), (3, 2.5, 7)]
    assert next(r for r in kept.collect() if r["doc_id"] == 1)["deep"][0]["m"] == {"k": 1, "l": 2}
