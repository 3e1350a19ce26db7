"""Vector codes, periodic runs and the Jaccard join against brute force."""

from __future__ import annotations

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
from helpers_llm import ODD, odd_documents
from pyspark.sql import functions as F

from pliego.llm import codes, jaccard, queries, runs

# Vector codes


def test_tree_search_equals_all_distances():
    rng = np.random.default_rng(3)
    for _ in range(150):
        width, high = int(rng.integers(1, 6)), int(rng.choice([2, 20, 5000]))
        book, parts = (rng.integers(-high, high, (n, width)) for n in (int(rng.integers(1, 70)), 150))
        index, away = codes.nearest(parts, book, codes.tree_of(book))
        every = codes.squares(parts, book)
        assert (index == every.argmin(1)).all() and (away == every.min(1)).all()


def test_tree_leaves_entries_out():
    """Parts near one of many far groups of entries compare with few of them."""
    rng = np.random.default_rng(5)
    book = np.concatenate([rng.integers(-5, 5, (8, 4)) + 1000 * k for k in range(8)])
    parts = rng.integers(-5, 5, (500, 4)) + 3000
    seen, plain = [], codes.squares

    def counted(a, b):
        seen.append(len(a) * len(b))
        return plain(a, b)

    tree = codes.tree_of(book)
    codes.squares = counted
    try:
        codes.nearest(parts, book, tree)
    finally:
        codes.squares = plain
    assert sum(seen) < 0.5 * len(parts) * len(book)


def test_radii_are_conservative():
    rng = np.random.default_rng(6)
    x = np.concatenate([np.arange(200), rng.integers(0, 1 << 60, 2000), np.arange(1 << 26, (1 << 26) + 50) ** 2])
    low, high = codes.roots(x)
    assert all(a * a <= v <= b * b for v, a, b in zip(x.tolist(), low.tolist(), high.tolist(), strict=True))


def slow_codes(rows, parts=16, entries=64, rounds=2):
    """rows: (id, vector, label) -> (id, code, error, label error, sha), and the codebooks."""
    kept = [(i, [int(np.floor(256.0 * x)) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    w = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * w : (p + 1) * w]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[cut(v, p) for _, v, _ in first] for p in range(parts)]
    best = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            own = {}
            for _, v, _ in kept:
                own.setdefault(best(cut(v, p), books[p])[1], []).append(cut(v, p))
            for k, members in own.items():
                books[p][k] = [sum(c) // len(members) for c in zip(*members, strict=True)]
    found = [[best(cut(v, p), books[p]) for p in range(parts)] for _, v, _ in kept]
    errors = {}
    for (_, _, label), f in zip(kept, found, strict=True):
        errors[label] = errors.get(label, 0) + sum(d for d, _ in f)
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(i, "".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f), errors[label], sha) for (i, _, label), f in zip(kept, found, strict=True)]


def test_codes_query_equals_brute_force(spark, sf):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = queries.op11_vector_codes(spark, sf)
    assert dict(got.dtypes) == {"vec_id": "bigint", "code": "string", "error": "bigint", "label_error": "bigint", "codebooks_sha256": "string"}
    assert sorted(map(tuple, got.collect())) == sorted(slow_codes(rows))


def odd_vectors(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice([-1.5, -0.25, 0.0, 0.5, 1e-9, -1e-9]) for _ in range(32)], rng.choice([1, 2, None]), "a", 1) for i in range(90)]
    rows += [(90, None, 1, "a", 1), (91, [None] * 32, 1, "a", 1), (92, [float("nan")] * 32, 1, "a", 1), (93, [float("inf")] * 32, None, "a", 1), rows[3], rows[3], (3, [9.0] * 32, 1, "a", 1), (None, [0.5] * 32, 2, "b", 2)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, code string, row int").repartition(4)


def test_odd_vectors(spark):
    df = odd_vectors(spark)
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in df.collect()]
    model = codes.learn(df)
    got = codes.with_sum_by(codes.encode(df, model), "label", "error", "label_error")
    assert got.columns == ["vec_id", "embedding", "label", "row", "code", "error", "length", "label_error"]
    found = [(r["vec_id"], "".join(f"{k:02x}" for k in r["code"]), r["error"], r["label_error"], model.sha256(32)) for r in got.collect()]
    assert sorted(found, key=repr) == sorted(slow_codes(rows), key=repr)


def test_codes_of_empty_tables_and_lengths(spark):
    df = odd_vectors(spark)
    assert codes.learn(df.limit(0)).books == {} and codes.encode(df.limit(0), codes.learn(df.limit(0))).count() == 0
    mixed = df.select("vec_id", F.when(F.col("vec_id") % 2 == 0, F.slice("embedding", 1, 16)).when(F.col("vec_id") % 7 == 0, F.array().cast("array<double>")).otherwise(F.col("embedding")).alias("embedding"))
    found = codes.encode(mixed, codes.learn(mixed)).collect()
    by = {n: [r for r in found if r["length"] == n] for n in (0, 16, 32)}
    assert all(by.values()) and all(r["error"] == 0 and r["code"] == [0] * 16 for r in by[0])
    wanted = slow_codes([(r["vec_id"], r["embedding"], None) for r in by[16]])
    assert sorted((r["vec_id"], "".join(f"{k:02x}" for k in r["code"])) for r in by[16]) == sorted(w[:2] for w in wanted)
    with pytest.raises(ValueError):
        codes.learn(spark.createDataFrame([(1, [0.5] * 17)], "vec_id long, embedding array<double>"))
    with pytest.raises(ValueError):
        codes.learn(spark.createDataFrame([(1, [1e300] * 16)], "vec_id long, embedding array<double>")).books


# Periodic runs


def slow_runs(words, least=6, times=4):
    n, found = len(words), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, times * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, length, q) for (s, length), q in found.items()), key=lambda r: (r[0], r[2]))


def some_words(rng, n, kinds):
    words = [rng.randrange(kinds) for _ in range(n)]
    for _ in range(rng.randrange(3)):
        a = rng.randrange(n)
        p = 1 + rng.randrange(max(1, (n - a) // 3))
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


@pytest.mark.parametrize(("short", "top", "grid"), [(4096, 16, 1 << 20), (8, 2, 40), (0, 3, 10)])
def test_runs_equal_brute_force(monkeypatch, short, top, grid):
    for name, value in (("SHORT", short), ("TOP", top), ("GRID", grid)):
        monkeypatch.setattr(runs, name, value)
    rng = random.Random(short + top)
    for _ in range(400):
        words = some_words(rng, rng.randrange(1, 130), rng.choice([1, 2, 3, 6]))
        for times, least in ((4, 6), (2, 4), (3, 9)):
            assert list(map(tuple, runs.runs_of(runs.named(words), least, times).tolist())) == slow_runs(words, least, times)


def test_long_runs():
    n = 300_000
    for q in (1, 7, 40_000):
        assert runs.runs_of(np.arange(n) % q).tolist() == [[0, n, q]]
    two = np.concatenate([np.arange(9000) % 3, np.arange(9000) % 2 + 10])
    assert runs.runs_of(two).tolist() == [[0, 9000, 3], [9000, 9000, 2]]


def slow_planted(doc_id, text):
    words = (text or "").encode().split()
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def slow_digests(doc_id, text, plant=True):
    words = slow_planted(doc_id, text) if plant else (text or "").encode().split()
    found = slow_runs(words)
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    sha = lambda x: hashlib.sha256(x).hexdigest()
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{s},{length},{q}\n" for s, length, q in found).encode()), sha(kept))


def test_runs_query_equals_brute_force(spark, sf):
    wanted = [slow_digests(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = queries.op12_periodic_runs(spark, sf)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(wanted, key=repr)
    assert sum(w[1] > 0 for w in wanted) > 10


def test_runs_of_odd_documents(spark):
    docs = odd_documents(spark)
    found = runs.periodic_runs(docs)
    assert found.columns == ["doc_id", "runs", "strongest", "collapsed"]
    texts = [(i, t) for i, t in ODD]
    assert sorted(map(tuple, runs.digests(found).collect()), key=repr) == sorted((slow_digests(i, t, False) for i, t in texts), key=repr)
    planted = {(r["doc_id"], tuple((r["text"] or "").encode().split())) for r in runs.planted(docs).collect()}
    assert planted == {(i, tuple(slow_planted(i, t))) for i, t in texts}
    assert runs.periodic_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        runs.periodic_runs(docs, least=2, times=3)


# Jaccard join


def slow_set(text, words=4):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset()


def slow_classes(rows, share=85):
    """rows: (id, text) -> (id, size, smallest id that links reach)."""
    sets = [(i, slow_set(t)) for i, t in rows]
    values = sorted({s for _, s in sets if s}, key=sorted)
    root = list(range(len(values)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(values)):
        for b in range(a):
            common = len(values[a] & values[b])
            if 100 * common >= share * len(values[a] | values[b]):
                root[find(a)] = find(b)
    place, low = {v: k for k, v in enumerate(values)}, {}
    for i, s in sets:
        if s and i is not None:
            low[find(place[s])] = min(i, low.get(find(place[s]), i))
    return [(i, len(s), low.get(find(place[s])) if s else i) for i, s in sets]


def changed(rng, words, times, vocabulary=5000):
    out = list(words)
    for _ in range(times):
        out[rng.randrange(len(out))] = rng.randrange(vocabulary)
    return out


def family_documents(rng):
    """Texts of which many share passages, some are copies, chains of near copies and crowds around a centre."""
    prose = lambda n: [rng.randrange(5000) for _ in range(n)]
    passages = [prose(60) for _ in range(4)]
    texts = [prose(rng.randrange(1, 300)) for _ in range(60)]
    texts += [[*prose(40), *rng.choice(passages), *prose(20)] for _ in range(40)]
    texts += [[*rng.choice(passages), *rng.choice(passages), *prose(rng.randrange(6))] for _ in range(60)]
    for size in (30, 100, 400):
        centre = prose(size)
        texts += [changed(rng, centre, rng.randrange(1, 2 + size // 60)) for _ in range(50)]
        link = centre
        for _ in range(15):
            link = changed(rng, link, max(1, size // 90))
            texts.append(link)
    texts += [t for t in rng.sample(texts, 30)] * 2
    rng.shuffle(texts)
    return [(i, " ".join(map(str, t))) for i, t in enumerate(texts)]


def test_join_query_equals_brute_force(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = queries.op13_jaccard_join(spark, sf)
    assert dict(got.dtypes) == {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"}
    assert sorted(map(tuple, got.collect())) == sorted(slow_classes(rows))


@pytest.mark.parametrize(("group", "tile", "block", "rounds", "share"), [(256, 2048, 32, 12, 85), (4, 8, 2, 1, 85), (16, 5, 3, 12, 70)])
def test_families(spark, monkeypatch, group, tile, block, rounds, share):
    """Whatever clusters were found first, and however the lists are cut, the components are those of all pairs."""
    for name, value in (("GROUP", group), ("TILE", tile), ("BLOCK", block), ("ROUNDS", rounds)):
        monkeypatch.setattr(jaccard, name, value)
    rows = family_documents(random.Random(group))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = jaccard.similar_documents(docs, share)
    assert sorted(map(tuple, got.collect())) == sorted(slow_classes(rows, share))


def test_join_of_odd_documents(spark):
    docs = odd_documents(spark)
    got = jaccard.similar_documents(docs)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(slow_classes(ODD), key=repr)
    assert jaccard.similar_documents(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        jaccard.similar_documents(docs, 0)


def test_members_are_judged_by_their_differences():
    rng = np.random.default_rng(11)
    for _ in range(400):
        base = np.unique(rng.integers(0, 400, 120))
        sides = []
        for _ in range(2):
            lead = np.unique(np.concatenate([rng.choice(base, int(0.9 * len(base)), replace=False), rng.integers(0, 400, 8)]))
            plus, minus = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for _ in range(int(rng.integers(0, 6))):
                minus.append(np.sort(rng.choice(lead, int(rng.integers(0, 12)), replace=False)))
                plus.append(np.setdiff1d(rng.integers(0, 400, int(rng.integers(0, 12))), lead))
            sides.append({"lead": lead, "plus": plus, "minus": minus})
        whole = [[np.union1d(np.setdiff1d(s["lead"], m), p) for p, m in zip(s["plus"], s["minus"], strict=True)] for s in sides]
        wanted = any(185 * len(np.intersect1d(x, y)) >= 85 * (len(x) + len(y)) for x in whole[0] for y in whole[1])
        assert jaccard.members_link(*sides, 85) == wanted


def test_blocks_of_a_list_lose_no_pair():
    rng = np.random.default_rng(12)
    for _ in range(60):
        sides = []
        for _ in range(2):
            n = int(rng.integers(1, 150))
            low = rng.integers(1, 300, n)
            high = low + rng.integers(0, 30, n)
            side = {"cluster": rng.integers(0, 1000, n), "comp": rng.integers(0, 5, n), "low": low, "high": high, "left": np.minimum(high, rng.integers(1, 300, n))}
            order = np.argsort(-side["left"])
            sides.append({k: v[order] for k, v in side.items()})
        got = set(zip(*(x.tolist() for x in jaccard.near_blocks(*sides, 85)), strict=True))
        a, b = sides
        wanted = set()
        for i in range(len(a["low"])):
            for j in range(len(b["low"])):
                common = min(a["left"][i], b["left"][j])
                if a["comp"][i] != b["comp"][j] and 185 * common >= 85 * (a["low"][i] + b["low"][j]) and 100 * a["high"][i] >= 85 * b["low"][j] and 100 * b["high"][j] >= 85 * a["low"][i]:
                    wanted.add((int(min(a["cluster"][i], b["cluster"][j])), int(max(a["cluster"][i], b["cluster"][j]))))
        assert got == wanted


def test_sql_of_the_planted_hash():
    """The checksum that the SQL computes bit by bit is zlib's."""
    sql = queries.ORACLE_SQL["op12_periodic_runs"]
    crc = sql[sql.index("xor(list_reduce") : sql.index(" AS h FROM documents")]
    got = duckdb.sql(f"SELECT doc_id, {crc} FROM (SELECT unnest([0, 7, 10, 99, 123456, 9876543210]) AS doc_id)").fetchall()
    assert got == [(i, zlib.crc32(str(i).encode())) for i, _ in got]
