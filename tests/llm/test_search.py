"""Exact top-k and approximate neighbours against brute force."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from pliego.llm import ann, queries, topk


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, vec string, score double").repartition(3)


def vectors(spark, path):
    rows = spark.read.parquet(f"{path}/embeddings.parquet").collect()
    return [(r["vec_id"], r["embedding"], 1, "x", 0.5) for r in rows]


def odd(dim):
    return [(900, None, 1, "", 0.0), (901, [], 1, "", 0.0), (902, [None] + [1.0] * (dim - 1), 1, "", 0.0), (904, [float("nan")] * dim, 1, "", 0.0), (950, [float("inf")] * dim, 1, "", 0.0), (905, [0.0] * dim, 1, "", 0.0), (906, [1.0] * (dim + 1), 1, "", 0.0), (None, [1.0] * dim, 1, "", 0.0)]


def brute(rows, score, k=5):
    ok = {}
    for i, v, *_ in rows:
        if i is not None and v and None not in v and np.isfinite(v).all():
            ok.setdefault(i, []).append(np.array(v, np.float64))
    out = {}
    for q, own in ok.items():
        if q % 50 == 0:
            found = sorted(((max(s), -c) for c, vs in ok.items() if c != q and (s := [score(a, b) for a in own for b in vs if len(a) == len(b) and score(a, b) is not None])), reverse=True)
            if found:
                out[q] = [(-c, s) for s, c in found[:k]]
    return out


def inner(a, b):
    return int(sum(int(x) * int(y) for x, y in zip(np.floor(256 * a), np.floor(256 * b), strict=True)))


def cosine(a, b):
    n = np.sqrt((a @ a) * (b @ b))
    return a @ b / n if n else None


def answers(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


def test_top_k_equals_brute_force(spark, sf):
    rows = vectors(spark, sf)
    copies = [(10_000 + i, rows[i][1], 1, "", 0.0) for i in range(40)] + [rows[3], rows[3]]
    rows = rows + copies + odd(len(rows[0][1]))
    df = table(spark, rows)
    assert answers(topk.top_k(df.where("vec_id % 50 = 0"), df)) == brute(rows, inner)


def test_top_k_of_few_rows_and_large_numbers(spark):
    rows = [(0, [3e8, -2e8], 1, "", 0.0), (50, [1e8, 1e8], 1, "", 0.0), (1, [3e8, -2e8], 1, "", 0.0)]
    df = table(spark, rows)
    got = answers(topk.top_k(df.where("vec_id % 50 = 0"), df))
    clamp = lambda x: max(-(2**63), min(2**63 - 1, x))
    assert got == {q: [(i, clamp(s)) for i, s in own] for q, own in brute(rows, inner).items()}
    assert topk.top_k(df.limit(0), df).count() == 0 and topk.top_k(df, df.limit(0)).count() == 0


def test_bounds_prune_nothing_that_counts():
    rng = np.random.default_rng(1)
    x, q = topk.quantised(rng.standard_normal((200, 37))), topk.quantised(rng.standard_normal((5, 37)))
    for segments in topk.LEVELS:
        bound = topk.statistics(q, segments) @ topk.statistics(x, segments).T
        assert (bound >= q @ x.T - 1e-6).all()


def test_neighbours_recall_and_scores(spark):
    rows = vectors(spark, "/root/testdata/sf0.01")
    rows += odd(len(rows[0][1]))
    df = table(spark, rows)
    got, wanted = answers(ann.nearest(df.where("vec_id % 50 = 0"), df)), brute(rows, cosine)
    assert got.keys() == wanted.keys()
    exact = {i: np.array(v, np.float64) for i, v, *_ in rows if i is not None and v and None not in v}
    hits = 0
    for q, own in got.items():
        assert len(own) == 5 and own == sorted(own, key=lambda p: (-p[1], p[0]))
        assert all(s == pytest.approx(cosine(exact[q], exact[i]), abs=1e-12) for i, s in own)
        hits += len({i for i, _ in own} & {i for i, _ in wanted[q]})
    assert hits >= 0.9 * sum(map(len, wanted.values()))


def test_neighbours_of_a_large_list(spark):
    """A third of the rows are one vector: many blocks of one list, ties to smaller ids."""
    rng = np.random.default_rng(2)
    near = rng.standard_normal(16).astype(float).tolist()
    rows = [(i, near if i % 3 == 0 else rng.standard_normal(16).tolist(), 1, "", 0.0) for i in range(1200)]
    df = table(spark, rows)
    got = answers(ann.nearest(df.where("vec_id % 50 = 0"), df))
    assert [i for i, _ in got[150]] == [0, 3, 6, 9, 12] and len(got) == 24


def test_neighbours_of_nothing(spark):
    df = table(spark, odd(4)[:2])
    assert ann.nearest(df, df).count() == 0 and ann.nearest(df.limit(0), df.limit(0)).columns == ["query_id", "rank", "vec_id", "score"]
    two = table(spark, [(0, [1.0, 0.0], 1, "", 0.0), (50, [0.0, 1.0], 1, "", 0.0)])
    assert answers(ann.nearest(two, two)) == {0: [(50, 0.0)], 50: [(0, 0.0)]}


def test_queries_columns(spark, sf):
    for name in ("op1_exact_topk", "op10_adaptive_ann"):
        df = queries.QUERIES[name](spark, sf)
        assert dict(df.dtypes) | {"score": "x"} == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "x"}
        assert df.where(F.col("query_id") % 50 != 0).count() == 0


def test_every_query_gets_all_that_it_may(spark):
    """Two tight groups, and scattered rows as queries: their nearest lists hold next to nothing."""
    rng = np.random.default_rng(3)
    a, b = rng.standard_normal((2, 16))
    vecs = [a + rng.standard_normal(16) * 0.01 for _ in range(490)] + [b + rng.standard_normal(16) * 0.01 for _ in range(490)]
    ids = [i for i in range(1001) if i % 50][:980]
    rows = [(i, v.tolist(), 1, "", 0.0) for i, v in zip(ids, vecs, strict=True)] + [(50 * i, (rng.standard_normal(16) * 3).tolist(), 1, "", 0.0) for i in range(20)]
    df = table(spark, rows)
    got = answers(ann.nearest(df.where("vec_id % 50 = 0"), df))
    assert len(got) == 20 and all(len(own) == 5 for own in got.values())


def test_every_length_is_searched(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(int(n)).tolist(), 1, "", 0.0) for i, n in enumerate(rng.choice([4, 8, 8, 12, 16, 3], 1200))]
    rows += [(5000, [1.0], 1, "", 0.0), (5001, [2.0], 1, "", 0.0), (5050, [1.0, 2.0], 1, "", 0.0)]
    df = table(spark, rows)
    got, wanted = answers(ann.nearest(df.where("vec_id % 50 = 0"), df)), brute(rows, cosine)
    assert got.keys() == wanted.keys() and all(len(got[q]) == len(wanted[q]) for q in got)
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in own}) for q, own in wanted.items()) >= 0.95 * sum(map(len, wanted.values()))


def test_repeated_ids_do_not_use_up_the_lists(spark):
    """Most rows have one id: lists that look full hold one candidate."""
    rng = np.random.default_rng(5)
    near = rng.standard_normal(8)
    rows = [(7, (near + rng.standard_normal(8) * 0.001).tolist(), 1, "", 0.0) for _ in range(600)] + [(50 * i, (near * (i == 0) + rng.standard_normal(8)).tolist(), 1, "", 0.0) for i in range(9)]
    df = table(spark, rows)
    got = answers(ann.nearest(df.where("vec_id % 50 = 0"), df, lists=16, probes=1))
    assert len(got) == 9 and all(len(own) == 5 and len({i for i, _ in own}) == 5 for own in got.values())


def test_levels_discard_clustered_candidates(spark):
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((40, 8)).repeat(8, axis=1)
    rows = centres[rng.integers(0, 40, 4000)] + rng.standard_normal((4000, 64)) * 0.1
    x = topk.quantised(rows)
    q = x[:50]
    exact = q @ x.T
    shares = topk.survivors(q, x, np.sort(exact, axis=1)[:, -6])
    assert shares[-1][1] < 0.1 and topk.paying(shares, 64)
    table_rows = [(i, v.tolist(), 1, "", 0.0) for i, v in enumerate(rows[:1500])]
    df = table(spark, table_rows)
    rounded = [(r["vec_id"], list(r["embedding"])) for r in df.collect()]
    assert answers(topk.top_k(df.where("vec_id % 50 = 0"), df)) == brute(rounded, inner)


def test_levels_that_do_not_pay_are_left_out():
    rng = np.random.default_rng(7)
    x = topk.quantised(rng.standard_normal((2000, 64)))
    q = x[:20]
    assert topk.paying(topk.survivors(q, x, np.sort(q @ x.T, axis=1)[:, -6]), 64) == []
    assert topk.paying([(1, 0.99), (4, 0.5), (16, 0.45), (32, 0.0)], 128) == [4, 32]


def test_rows_of_one_id_are_spread(spark, monkeypatch):
    """An id that most rows have fills no block: its rows are dealt out by their vectors, and the results are those of each id's best row."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(21)
    rows = [(7 if i < 5000 else 100 + i, rng.normal(size=8).tolist()) for i in range(5400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    monkeypatch.setattr(topk.vectors, "ROW_BLOCK", 512)
    seen = spark.sparkContext.accumulator(0)
    search = topk.search_block

    def counted(queries, block, k):
        seen.add(1 if block.num_rows > 900 else 0)
        return search(queries, block, k)

    monkeypatch.setattr(topk, "search_block", counted)
    queries = df.where(F.col("vec_id") % 50 == 0)
    got = topk.top_k(queries, df).collect()
    assert seen.value == 0
    best = {}
    whole = {i: [np.floor(256 * np.array(v)) for j, v in rows if j == i] for i in {i for i, _ in rows}}
    for q in (i for i in whole if i % 50 == 0):
        scores = sorted((-max(int(whole[q][0] @ v) for v in vs), i) for i, vs in whole.items() if i != q)[:5]
        best[q] = [(i, -s) for s, i in scores]
    found = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert found == best
