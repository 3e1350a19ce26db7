"""Patterns by index, ranges by bins, sketches and profiles, against plain versions."""

from __future__ import annotations

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from pliego.operators import joins, patterns, profiles, sketches
from pliego.plans import scoring


def like(text, pattern):
    """LIKE, character by character."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            out += re.escape(pattern[i + 1])
            i += 1
        else:
            out += ".*" if c == "%" else "." if c == "_" else re.escape(c)
        i += 1
    return re.fullmatch(out, text, re.S) is not None


def test_like_join(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("AB %_É\\") for _ in range(rng.randrange(9)))
    texts = [word() for _ in range(150)] + ["HOSPITAL SAN JUAN", "ALCALDÍA DE SAN JUAN", "", None, "A\nB", "A"]
    wanted = ["%", "_", "", "%%", "A%", "%SAN JUAN%", "HOSP_TAL%", "%\\%%", "%\\_A%", "\\\\%", "%\\\\%", "%AB%BA%", "__", "%A\nB%", None, "NADA%DE%NADA"] + ["%" + word().replace("\\", "") + "%" for _ in range(80)]
    got = patterns.like_join(spark.createDataFrame([(t,) for t in texts], "t string"), "t", spark.createDataFrame([(p,) for p in wanted], "p string"), "p")
    expected = {(t, p) for t in texts for p in wanted if t is not None and p is not None and like(t, p)}
    found = [tuple(r) for r in got.collect()]
    assert set(found) == expected and len(found) == len(set(found)) and len(expected) > 500
    none = spark.createDataFrame([], "p string")
    assert patterns.like_join(spark.createDataFrame([("a",)], "t string"), "t", none, "p").count() == 0


def test_like_join_has_no_nested_loop(spark):
    """Ten thousand patterns meet ten thousand names by equality, each with few candidates."""
    names = spark.range(10_000).select(F.concat(F.lit("ENTIDAD NUMERO "), F.col("id").cast("string")).alias("t"))
    wanted = spark.range(10_000).select(F.concat(F.lit("%NUMERO "), F.col("id").cast("string")).alias("p"))
    found = patterns.like_join(names, "t", wanted, "p")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert found.count() == 10_000


def test_range_join(spark):
    rng = random.Random(6)
    day = lambda n: dt.date(2020, 1, 1) + dt.timedelta(n)
    spans = [(i, day(a), day(a + rng.choice([0, 1, 5, 400, -2]))) for i, a in enumerate(rng.randrange(-700, 700) for _ in range(120))] + [(500, None, day(3)), (501, day(3), None), (502, day(-30_000), day(30_000))]
    values = [(i, day(rng.randrange(-800, 1200))) for i in range(300)] + [(900, None), (901, day(0)), (902, day(0))]
    df, ranges = spark.createDataFrame(values, "v int, d date"), spark.createDataFrame(spans, "r int, low date, high date")
    pairs = {(v, r) for v, d in values for r, a, b in spans if d and a and b and a <= d <= b}
    got = [(x["v"], x["r"]) for x in joins.range_join(df, "d", ranges, "low", "high", "inner").collect()]
    assert set(got) == pairs and len(got) == len(pairs)
    left = [(x["v"], x["r"]) for x in joins.range_join(df, "d", ranges, "low", "high").collect()]
    assert set(left) == pairs | {(v, None) for v, _ in values if v not in {p[0] for p in pairs}} and (900, None) in left
    assert joins.range_join(df, "d", ranges.limit(0), "low", "high").count() == len(values)
    with pytest.raises(TypeError):
        joins.range_join(df.withColumn("x", F.lit(1.5)), "x", ranges, "low", "high")


def test_range_totals_without_pairs(spark, monkeypatch):
    """The totals of all ranges that hold a value, from the ends alone: 20,000 ranges that hold 400 values are never 8 million rows."""
    day = lambda n: dt.date(2020, 1, 1) + dt.timedelta(n)
    rng = random.Random(8)
    spans = [(i, day(a), day(a + rng.choice([0, 1, 5, 400, -2]))) for i, a in enumerate(rng.randrange(-700, 700) for _ in range(120))] + [(500, None, day(3)), (501, day(3), None), (None, day(-30_000), day(30_000))]
    values = [(i, day(rng.randrange(-800, 1200))) for i in range(300)] + [(900, None), (901, day(0)), (902, day(0))]
    df, ranges = spark.createDataFrame(values, "v int, d date"), spark.createDataFrame(spans, "r int, low date, high date")
    hit = lambda d: [r or 0 for r, a, b in spans if d and a and b and a <= d <= b]
    got = joins.range_totals(df, "d", ranges, "low", "high", "n", {"total": "r"}).collect()
    assert {tuple(r) for r in got} == {(v, d, len(hit(d)), sum(hit(d))) for v, d in values} and len(got) == len(values)
    assert [tuple(r) for r in joins.range_totals(df.where("v = 901"), "d", ranges.limit(0), "low", "high", "n", {"total": "r"}).collect()] == [(901, day(0), 0, 0)]
    with pytest.raises(TypeError):
        joins.range_totals(df, "d", ranges.withColumn("x", F.lit(0.5)), "low", "high", "n", {"total": "x"})
    sorted_rows = []
    whole = joins.running_total
    monkeypatch.setattr(joins, "running_total", lambda rows, *a: sorted_rows.append(rows.count()) or whole(rows, *a))
    many = spark.range(20_000).select(F.col("id").alias("r"), (F.col("id") % 50 * -1).alias("low"), (400 + F.col("id") % 50).alias("high"))
    found = joins.range_totals(spark.range(400).toDF("v"), "v", many, "low", "high", "n", {}).agg(F.min("n"), F.max("n")).first()
    assert tuple(found) == (20_000, 20_000) and sorted_rows == [500]


def test_like_join_sends_no_stretches_of_texts(spark):
    """The texts' stretches are many times the texts; patterns of few distinct stretches are sent instead, so no broadcast grows with the texts."""
    names = spark.range(20_000).select(F.concat(F.lit("ENTIDAD NUMERO "), F.col("id").cast("string")).alias("t"))
    found = patterns.like_join(names, "t", spark.createDataFrame([("%NUMERO 77%",), ("%DAD N%1",), ("%NADA%",)], "p string"), "p")
    assert found.count() == 111 + 2000
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    sent = plan[plan.index("BroadcastExchange") :].split("BroadcastExchange")[1:] if "BroadcastExchange" in plan else []
    assert not [s for s in sent if "Generate explode" in s.split("BroadcastQueryStage")[0]]


def test_bins_are_a_partition(spark):
    rng = random.Random(7)
    ends = [(a, a + rng.choice([-1, 0, 1, 7, 1000, 10**12])) for a in [rng.randrange(-1100, 1100) for _ in range(60)]] + [(-(2**63), 2**63 - 1), (0, 2**63 - 1), (-5, 5)]
    rows = spark.createDataFrame(ends, "a long, b long").select("a", "b", joins.dyadic(F.col("a"), F.col("b")).alias("bins")).collect()
    for r in rows:
        spans = sorted((x["bin"] << x["level"], (x["bin"] + 1 << x["level"]) - 1) for x in r["bins"])
        if r["a"] > r["b"]:
            assert spans == []
            continue
        assert spans[0][0] == r["a"] and spans[-1][1] == r["b"] and all(p[1] + 1 == q[0] for p, q in zip(spans, spans[1:], strict=False))
        assert all(sum(x["level"] == y["level"] for y in r["bins"]) <= 2 for x in r["bins"])


@pytest.mark.parametrize("kind", ["spread", "ties", "few"])
def test_quantile_sketches(spark, kind):
    rng = random.Random(8)
    value = {"spread": lambda: rng.lognormvariate(0, 3), "ties": lambda: float(rng.randrange(4)), "few": lambda: rng.random()}[kind]
    n = 60 if kind == "few" else 60_000
    rows = [(2020 + i % 3, 1 + i % 12, value()) for i in range(n)]
    df = spark.createDataFrame([*rows, (2020, 1, None), (2020, 1, float("nan")), (2031, 1, None)], "anio int, mes int, v double").repartition(6)
    kept = sketches.quantile_sketches(df, F.col("v"), ["anio", "mes"])
    assert kept.count() == 12 if kind != "few" else True
    shares = (0.0, 0.01, 0.5, 0.75, 0.9, 0.99, 0.999, 1.0)
    for by, group in ((["anio"], lambda r: r[0]), ([], lambda r: None)):
        found = sketches.quantiles(sketches.merged(kept, by), shares).collect()
        assert len(found) == len(shares) * (3 if by else 1)
        for r in found:
            own = sorted(v for *g, v in rows if not by or g[0] == r["anio"])
            assert r["n"] == len(own)
            below, to = sum(v < r["value"] for v in own) / len(own), sum(v <= r["value"] for v in own) / len(own)
            assert below <= r["share"] + sketches.RANK_ERROR + 1 / len(own) and to >= r["share"] - sketches.RANK_ERROR
    assert sketches.quantiles(sketches.merged(kept.limit(0), []), shares).count() == 0


def test_score_sketches(spark):
    scores = spark.range(4000).select((F.col("id") % 101).cast("double").alias("score"), F.date_add(F.lit(dt.date(2022, 11, 1)), (F.col("id") % 120).cast("int")).alias("fecha_firma"))
    kept = scoring.monthly_sketches(scores)
    assert {(r["anio"], r["mes"]) for r in kept.collect()} == {(2022, 11), (2022, 12), (2023, 1), (2023, 2)}
    exact = {r["share"]: r["value"] for r in scoring.distribution(scores).collect()}
    near = {r["share"]: r["value"] for r in scoring.sketched_distribution(kept).collect()}
    assert set(near) == set(exact) and all(abs(near[s] - exact[s]) <= 101 * sketches.RANK_ERROR + 1 for s in exact)
    assert {r["anio"] for r in scoring.sketched_distribution(kept, ["anio"]).collect()} == {2022, 2023}


def test_profile(spark, monkeypatch):
    rows = [(i, f"v{i % 3}", None, None if i % 4 else float(i), "x" * (i % 50) * 10) for i in range(2000)]
    df = spark.createDataFrame(rows, "many long, few string, none string, some double, long string").repartition(5)

    def slow():
        out = {}
        for c, kind in df.dtypes:
            values = [r[0] for r in df.select(F.col(c).cast("string")).collect()]
            there = sorted({v for v in values if v is not None})
            out[c] = (kind, len(values), round(sum(v is None for v in values) * 100 / len(values), 1), len(there), there[:3])
        return out

    wanted = slow()
    for few, size in ((1000, 4_000_000), (0, 0), (10**9, 10**12), (1000, 500)):
        monkeypatch.setattr(profiles, "FEW_VALUES", few)
        monkeypatch.setattr(profiles, "FEW_BYTES", size)
        assert {r["col"]: tuple(r)[1:] for r in profiles.profile(df).collect()} == wanted
    monkeypatch.undo()
    plan = profiles.profile(df, ["few", "none"])._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode(array(struct(col" not in plan.split("Exchange")[-1]
    assert profiles.profile(df.limit(0)).count() == 0
