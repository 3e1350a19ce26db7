"""Moving sums, buckets and switches against brute force, with one key that holds a third of all rows."""

from __future__ import annotations

import random
from collections import defaultdict
from datetime import timedelta

import pytest
from helpers import contract, day, rows_to_df
from pyspark.sql import functions as F

from pliego.operators import dedup, windows
from pliego.params import Params
from pliego.plans import flags, scoring
from pliego.plans.marts import reference_tables
from pliego.session import spread

START = day("2020-01-01")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    return [("hot" if i % 3 == 0 else f"k{rng.randrange(40)}", START + timedelta(days=rng.randrange(400)), f"{i:04}", rng.choice("ABC"), float(rng.randrange(100))) for i in range(900)]


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "k string, d date, i string, who string, v double").repartition(5)


def test_around(df, rows):
    got = {r["i"]: (r["n"], r["s"]) for r in windows.around(df, ["k"], "d", 30, "v", "n", "s").collect()}
    for k, d, i, _, _ in rows:
        near = [v for k2, d2, _, _, v in rows if k2 == k and abs((d2 - d).days) <= 30]
        assert got[i] == (len(near), sum(near))


def test_buckets_and_switches(df, rows):
    first = {}
    for k, d, *_ in rows:
        first[k] = min(d, first.get(k, d))
    bucketed = windows.buckets(df, ["k"], "d", 90)
    assert {r["i"]: r["bucket"] for r in bucketed.collect()} == {i: (d - first[k]).days // 90 for k, d, i, _, _ in rows}
    groups = defaultdict(list)
    for k, d, i, who, _ in rows:
        groups[k, (d - first[k]).days // 90].append((d, i, who))
    wanted = {g: (len(own), sum(a[2] != b[2] for a, b in zip(sorted(own), sorted(own)[1:]))) for g, own in groups.items()}
    got = {(r["k"], r["bucket"]): (r["n"], r["n_switches"]) for r in windows.switches(bucketed, ["k", "bucket"], "who", "d", "i").collect()}
    assert got == wanted


def test_latest_and_mode_of_a_hot_key(df, rows):
    latest = {r["k"]: r["i"] for r in dedup.keep_latest(df, ["k"], "d", "i").collect()}
    assert latest == {k: max((d, i) for k2, d, i, *_ in rows if k2 == k)[1] for k in {r[0] for r in rows}}
    mode = dict(dedup.mode_per_key(df, ["k"], "who").collect())
    for k in mode:
        counts = defaultdict(int)
        for k2, _, _, who, _ in rows:
            counts[who] += k2 == k
        assert mode[k] == min(counts, key=lambda w: (-counts[w], w))


def test_plans_limit_dedup_before_the_shuffle(df):
    plan = dedup.keep_latest(df, ["k"], "d")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and plan.rindex("WindowGroupLimit") > plan.index("Exchange")


def test_scores_do_not_depend_on_order_or_reruns(spark):
    rng = random.Random(2)
    contracts = [contract(i % 50, row_id=f"r{i:03}", doc_proveedor_norm=f"S{rng.randrange(4)}", fecha_firma=START + timedelta(days=rng.randrange(800)), valor_contrato=float(rng.choice([1e9, 2e9, 5e6])), cod_dpto="5", cod_mpio="1", es_competitiva=bool(i % 2), objeto_del_contrato=rng.choice(["obra", "un objeto de contrato bastante más largo que cuarenta"])) for i in range(120)]
    found = []
    for seed in (1, 2):
        random.Random(seed).shuffle(contracts)
        mart = reference_tables(spark) | {"fct_contrato": rows_to_df(spark, "fct_contrato", contracts).repartition(seed + 1), "fct_proceso": rows_to_df(spark, "fct_proceso", []), "dim_proveedor": rows_to_df(spark, "dim_proveedor", []), "dim_entidad": rows_to_df(spark, "dim_entidad", [{"nit_entidad_norm": "E1", "cod_dpto": "5", "n_contratos": 120, "valor_total": 1.0}]), "sanciones": rows_to_df(spark, "sanciones", []), "divipola": rows_to_df(spark, "divipola", [])}
        scored = scoring.run(mart, Params())
        found.append([sorted(map(str, scored[t].select(*[F.round(c, 9).alias(c) if k == "double" else F.col(c) for c, k in scored[t].dtypes]).collect())) for t in ("contrato_score", "entidad_score", "municipio_score")])
        tiers = scoring.tier_counts(scored["contrato_score"]).agg(F.sum("n")).first()[0]
        assert tiers == scored["contrato_score"].count() == 50
    assert found[0] == found[1]


def test_row_flags_equal_single_flags(spark):
    rows = [contract(i, es_competitiva=i % 2 == 0, modalidad_norm=["LICITACION_PUBLICA", "CONTRATACION_DIRECTA"][i % 2], proceso_de_compra=f"P{i % 7}", valor_contrato=float(i) * 1e8, duracion_dias_inicial=i, dias_adicionados=5, fecha_firma=START + timedelta(days=37 * i)) for i in range(40)]
    processes = [{"referencia": f"P{i}", "row_id": f"p{i}", "num_oferentes_unicos": i % 3, "precio_base": 1e9, "valor_adjudicacion": 5e8, "fecha_publicacion": START, "fecha_recepcion_respuestas": START + timedelta(days=i * 3)} for i in range(6)]
    mart = reference_tables(spark) | {"fct_contrato": rows_to_df(spark, "fct_contrato", rows), "fct_proceso": rows_to_df(spark, "fct_proceso", processes), "dim_proveedor": rows_to_df(spark, "dim_proveedor", [{"doc_proveedor_norm": "S1", "fecha_matricula": START}], fecha_matricula="date")}
    p = Params()
    once = sorted(map(tuple, flags.row_flags(mart, p).collect()))
    single = sorted(tuple(r) for f in flags.ROW_RULES for r in flags.long_rows(f, flags.FLAGS[f](mart, p)).collect())
    assert once == single and {f for _, f, *_ in once} == set(flags.ROW_RULES)
    assert all((e is not None) == fired for _, _, fired, e in flags.row_flags(mart, p, fired_only=True).collect())


def test_small_tables_are_spread_and_large_ones_left_alone(spark, tmp_path):
    cores = spark.sparkContext.defaultParallelism
    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    assert spread(table).rdd.getNumPartitions() == max(cores, table.rdd.getNumPartitions())
    assert sorted(r[0] for r in spread(table).collect()) == list(range(1000))
    many = spark.range(1000).repartition(cores + 1)
    assert spread(many) is many
