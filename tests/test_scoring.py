"""Scores, tiers, shrinkage, and the ranking metrics against their definitions."""

from __future__ import annotations

import dataclasses
import random

import pytest
from helpers import contract, day, rows_to_df
from pyspark.sql import functions as F

from pliego import testdata
from pliego.functions.evidence import parsed
from pliego.functions.numbers import combined, shrunk, tier, weighted_mean
from pliego.operators.ranking import auc, numbered, ordinal_rank, percent_rank, percentiles, precision_at, running_total
from pliego.params import Params
from pliego.plans import backtest, exports, flags, scoring

SMALL = Params(weights={"FX1": ("Uno", "contract", 10), "FX2": ("Dos", "contract", 30), "FX3": ("Tres", "contract", 60), "EX1": ("Cuatro", "entity", 5), "EX2": ("Cinco", "entity", 15)})


def flag_rows(spark, *rows):
    return rows_to_df(spark, "flags", [dict(zip(("key", "flag_id", "fired", "evidence_json"), r, strict=False)) for r in rows])


def mart_of(spark, contracts, entities=(), places=()):
    return {"fct_contrato": rows_to_df(spark, "fct_contrato", contracts), "dim_entidad": rows_to_df(spark, "dim_entidad", list(entities)), "divipola": rows_to_df(spark, "divipola", list(places))}


def test_contract_score(spark):
    long = flag_rows(spark, ("C1", "FX1", True, "a"), ("C1", "FX2", False, "b"), ("C1", "FX1", False, "z"), ("C2", "FX3", False, "c"), ("C2", "OTHER", True, "d"))
    m = mart_of(spark, [contract(1), contract(1, row_id="r0", fecha_firma=day("2023-05-01"), valor_contrato=7.0), contract(2), contract(3)])
    found = {r["id_contrato"]: r for r in scoring.contract_scores(m, long, SMALL).withColumn("b", parsed(F.col("flags_disparados"))).collect()}
    assert (found["C1"]["score"], found["C1"]["tier"], found["C1"]["n_flags_aplicables"], found["C1"]["valor_contrato"]) == (25.0, "medio", 2, 7.0)
    assert [(b["flag_id"], b["peso"], b["evidence"]) for b in found["C1"]["b"]] == [("FX1", 10, "a")]
    assert (found["C2"]["score"], found["C2"]["tier"]) == (0.0, "bajo")
    assert (found["C3"]["score"], found["C3"]["tier"], found["C3"]["n_flags_aplicables"], found["C3"]["b"]) == (None, None, 0, [])


@pytest.mark.parametrize(("score", "name"), [(0.0, "bajo"), (19.999, "bajo"), (20.0, "medio"), (40.0, "alto"), (59.99, "alto"), (60.0, "critico"), (100.0, "critico"), (None, None)])
def test_tiers(spark, score, name):
    assert spark.range(1).select(tier(F.lit(score).cast("double"), Params())).first()[0] == name


def test_shrink_and_combine(spark):
    row = spark.range(1).select(shrunk(F.lit(80.0), F.lit(20.0), F.lit(10), 10.0), shrunk(F.lit(None).cast("double"), F.lit(20.0), F.lit(10), 10.0), shrunk(F.lit(80.0), F.lit(None).cast("double"), F.lit(0), 10.0), combined(F.lit(10.0), F.lit(40.0), 119, 16), combined(F.lit(None).cast("double"), F.lit(4.0), 119, 16)).first()
    assert list(row) == pytest.approx([50.0, 20.0, 80.0, (1190 + 640) / 135, 4.0])


def test_weighted_mean_falls_back(spark):
    rows = spark.createDataFrame([("a", 10.0, 1.0), ("a", 20.0, 3.0), ("b", 10.0, 0.0), ("b", 20.0, None), ("c", None, 5.0)], "k string, v double, w double")
    assert dict(rows.groupBy("k").agg(weighted_mean(F.col("v"), F.col("w"))).collect()) == {"a": 17.5, "b": 15.0, "c": None}


def test_small_entities_shrink_to_their_department(spark):
    rows = [contract(i, nit_entidad_norm="BIG", cod_dpto="5", cod_mpio="1") for i in range(20)] + [contract("x", nit_entidad_norm="SMALL", cod_dpto="5", cod_mpio="2")]
    long = flag_rows(spark, *[(r["id_contrato"], "FX3", r["id_contrato"] == "Cx", "{}") for r in rows])
    entities = [{"nit_entidad_norm": "BIG", "cod_dpto": "5", "n_contratos": 20, "valor_total": 2000.0}, {"nit_entidad_norm": "SMALL", "cod_dpto": "5", "n_contratos": 1, "valor_total": 100.0}, {"nit_entidad_norm": "NONE", "n_contratos": 0}]
    m = mart_of(spark, rows, entities, [{"cod_dpto": "5", "dpto": "D", "cod_mpio": "1", "municipio": "M"}])
    score = scoring.contract_scores(m, long, SMALL)
    found = {r["nit_entidad_norm"]: r for r in scoring.entity_scores(m, score, flag_rows(spark), SMALL).collect()}
    assert 5 < found["SMALL"]["score"] < 50 and found["BIG"]["score"] < 3
    assert found["SMALL"]["datos_insuficientes"] and not found["BIG"]["datos_insuficientes"]
    assert found["NONE"]["score"] == pytest.approx(found["BIG"]["dept_mean_score"]) and found["NONE"]["combined_raw_score"] is None
    places = {r["cod_mpio"]: r for r in scoring.municipality_scores(m, score, SMALL).collect()}
    assert places["1"]["municipio"] == "M" and places["2"]["municipio"] is None and places["2"]["n_contratos"] == 1


def test_department_mean_of_zero(spark):
    rows = [contract(i, nit_entidad_norm=f"E{i}", cod_dpto=d, cod_mpio="1") for i, d in enumerate("5556")]
    long = flag_rows(spark, *[(f"C{i}", "FX3", i == 3, "{}") for i in range(4)])
    m = mart_of(spark, rows, [{"nit_entidad_norm": f"E{i}", "cod_dpto": d, "n_contratos": 1, "valor_total": 100.0} for i, d in enumerate("5556")])
    score = scoring.contract_scores(m, long, SMALL)
    plain, compat = ({r["nit_entidad_norm"]: r["dept_mean_score"] for r in scoring.entity_scores(m, score, flag_rows(spark), SMALL, compat=c).collect()} for c in (False, True))
    assert plain["E0"] == 0.0 and compat["E0"] == 25.0 and plain["E3"] == compat["E3"] == 100.0


def brute_auc(rows):
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))


def test_auc_equals_pairs(spark):
    rng = random.Random(3)
    rows = [(float(rng.choice([0, 0, 0, 1, 2, 5])), rng.random() < 0.3) for _ in range(300)]
    got = auc(spark.createDataFrame(rows, "s double, y boolean").repartition(5), "s", "y").first()
    assert got["auc"] == pytest.approx(brute_auc(rows)) and (got["n"], got["n_pos"]) == (300, sum(y for _, y in rows))
    assert auc(spark.createDataFrame([(1.0, True)], "s double, y boolean"), "s", "y").first()["auc"] is None
    assert auc(spark.createDataFrame([], "s double, y boolean"), "s", "y").first()["n"] == 0


def test_precision(spark):
    rows = [(float(100 - i // 2), i in (0, 1, 3), f"{i:03}") for i in range(100)]
    found = {r["name"]: (r["k"], r["precision"], r["lift"]) for r in precision_at(spark.createDataFrame(rows, "s double, y boolean, id string"), "s", "y", "id").collect()}
    assert found["top_10%"] == (10, 0.3, pytest.approx(10.0)) and found["top_1%"] == (1, 1.0, pytest.approx(1 / 0.03)) and "top_500" not in found and found["top_50"][1] == 0.06


def test_positions_and_running_totals(spark):
    rng = random.Random(5)
    rows = [(i, rng.randrange(10)) for i in range(500)]
    df = spark.createDataFrame(rows, "i long, v long").repartition(7)
    order = sorted(rows, key=lambda r: (-r[1], r[0]))
    assert {r["i"]: r["position"] for r in numbered(df, F.col("v").desc(), F.col("i")).collect()} == {r[0]: n + 1 for n, r in enumerate(order)}
    total, sums = 0, {}
    for i, v in order:
        total += v
        sums[i] = total
    assert {r["i"]: r["total"] for r in running_total(df, F.col("v"), [F.col("v").desc(), F.col("i")]).collect()} == sums
    assert numbered(df.limit(0), F.col("i")).count() == 0


def test_percentiles_and_ranks(spark):
    df = spark.createDataFrame([(g, float(v)) for g in "ab" for v in (1, 1, 2, 4)] + [("c", 9.0), ("a", None)], "g string, v double")
    assert {(r["g"], r["v"], round(r["percentile"], 4)) for r in percent_rank(df, "g", "v").collect()} == {("a", 1.0, 0.0), ("a", 2.0, 0.6667), ("a", 4.0, 1.0), ("b", 1.0, 0.0), ("b", 2.0, 0.6667), ("b", 4.0, 1.0), ("c", 9.0, 0.0)}
    assert dict(percentiles(df.where("g = 'a'"), "v", (0.0, 0.5, 0.9, 1.0)).collect()) == pytest.approx({0.0: 1.0, 0.5: 1.5, 0.9: 3.4, 1.0: 4.0})
    assert percentiles(df.limit(0), "v", (0.5,)).count() == 0
    one = ordinal_rank(spark.createDataFrame([("x", 1.0)], "k string, v double"), F.col("v")).first()
    assert (one["position"], one["percentile"]) == (1, 0.5)


def test_labels_only_after_signature(spark):
    scores = spark.createDataFrame([(f"C{i}", 1.0, day("2023-01-10"), f"S{i}", "E") for i in range(4)] + [("C9", 1.0, day("2023-01-10"), "", "S2")], "id_contrato string, score double, fecha_firma date, doc_proveedor_norm string, nit_entidad_norm string")
    sanctions = rows_to_df(spark, "sanciones", [{"doc_norm": f"S{i}", "fecha_sancion": day(d)} for i, d in enumerate(["2023-01-09", "2023-01-10", "2023-01-11"])] + [{"doc_norm": "S2", "fecha_sancion": day("2020-01-01")}, {"doc_norm": "S3"}])
    assert {r[0]: r[2] for r in backtest.labels(scores, sanctions).collect()} == {"C0": False, "C1": False, "C2": True, "C3": False, "C9": True}


def test_targets():
    assert backtest.targets(0.61, 1.6, [True, None]) == {"auc": True, "lift": True, "cases": True}
    assert backtest.targets(None, 1.5, [None]) == {"auc": False, "lift": False, "cases": False}


def test_scores_without_evidence_shuffle_narrow_rows(spark, sf):
    """Without evidence the flags of a contract are those that the flags themselves give, also where groups of few entities fire; what is written has the columns wanted."""
    p = dataclasses.replace(testdata.PARAMS, rotation_days=1460, rotation_min_contracts=3, rotation_winners=(2, 1000), rotation_min_share=0.0, rotation_min_alternation=0.3, split_days=60)
    mart = testdata.regional(spark, sf)
    of = lambda evidence: {r["key"]: (r["n_flags_aplicables"], r["n_flags_disparados"], r["score"]) for r in scoring.per_key(flags.folded(mart, p, evidence=evidence), p, "contract").collect()}
    told, lean = of(True), of(False)
    assert lean == told and len(lean) > 4000
    assert flags.splitting(mart, p).count() > 0 and flags.rotating(mart, p).count() > 0
    assert {r[0] for r in flags.splitting(mart, p).collect()} == {r[0] for r in flags.f05(mart, p).where("fired").select("key").collect()}
    assert {r[0] for r in flags.rotating(mart, p).collect()} == {r[0] for r in flags.f06(mart, p).where("fired").select("key").collect()}
    got = scoring.run(mart, p, ("contrato_score",), False, ("anio",))["contrato_score"]
    assert got.columns == ["id_contrato", "anio", "n_flags_aplicables", "n_flags_disparados", "score", "tier"]


@pytest.mark.parametrize("evidence", [False, True])
def test_contracts_bring_their_columns_with_their_flags(spark, sf, evidence):
    """Contracts written with their process need no join with it, and flags that bring the newest row's columns give the same scores as a join by id, of ids with several rows too."""
    m, p = testdata.mart(spark, sf, written=True), testdata.PARAMS
    found = flags.folded(m, p, evidence=evidence, columns=["anio", "fecha_firma"])
    assert flags.with_process(m, m["fct_contrato"], *flags.PROCESS) is m["fct_contrato"]
    once = scoring.contract_scores(m, found, p, ["anio", "fecha_firma"])
    apart = scoring.contract_scores(m, flags.folded(m, p, evidence=evidence), p, ["anio", "fecha_firma"])
    assert once.columns == apart.columns and 0 < apart.count() < m["fct_contrato"].count()
    assert once.exceptAll(apart).count() == apart.exceptAll(once).count() == 0


def test_wide_rows_are_sorted_after_their_shuffle_only(spark, sf):
    """Rows that bring columns are not sorted by id in the tasks that read them, which would spill there; they are sorted once, where an id's rows meet."""
    m, p = testdata.mart(spark, sf, written=True), testdata.PARAMS
    found = scoring.contract_scores(m, flags.folded(m, p, evidence=False, columns=["anio"]), p, ["anio"])
    lines = found._jdf.queryExecution().sparkPlan().toString().splitlines()
    top = next(i for i, line in enumerate(lines) if "Union" in line)
    assert any("REPARTITION_BY_COL" in line for line in lines[:top])
    last = max(i for i, line in enumerate(lines[:top]) if "Aggregate" in line)
    assert last < next(i for i, line in enumerate(lines[:top]) if "REPARTITION_BY_COL" in line)


def test_ids_of_many_rows_are_combined_before_their_shuffle(spark, sf, monkeypatch):
    """Ids that a sketch finds often are combined in tasks first, with the same scores."""
    m, p = testdata.mart(spark, sf, written=True), testdata.PARAMS
    m["fct_contrato"] = m["fct_contrato"].withColumn("id_contrato", F.when(F.crc32("row_id") % 2 == 0, F.lit("many")).otherwise(F.col("id_contrato")))
    score = lambda: scoring.contract_scores(m, flags.folded(m, p, evidence=True, columns=["anio", "fecha_firma"]), p, ["anio", "fecha_firma"])
    assert scoring.repeated_ids(m["fct_contrato"]) == []
    plain = score().collect()
    monkeypatch.setattr(scoring, "OFTEN", 1000)
    assert scoring.repeated_ids(m["fct_contrato"]) == ["many"] and scoring.repeated_ids(m["fct_contrato"].limit(0)) == []
    assert sorted(score().collect(), key=str) == sorted(plain, key=str) and sum(r["id_contrato"] == "many" for r in plain) == 1


def test_scores_read_what_is_wanted(spark, sf):
    """Score tables have only the contracts' columns that they read written."""
    m, p = testdata.mart(spark, sf, written=True), testdata.PARAMS
    suppliers = scoring.run(m, p, ("proveedor_score",), False)["proveedor_score"]
    plan = suppliers._jdf.queryExecution().optimizedPlan().toString()
    read = next(line for line in plan.splitlines() if "n_flags_disparados" in line and "Relation" in line)
    assert "valor_contrato" in read and "cod_mpio" not in read and "nit_entidad_norm" not in read


def test_figures_of_scores_with_their_modality(spark, sf):
    """National figures of scores that have their modality need no join with contracts, and are the same."""
    m, p = testdata.mart(spark, sf, written=True), testdata.PARAMS
    scores = scoring.run(m, p, ("contrato_score",), False, (*scoring.CONTRACT, "modalidad_norm"))["contrato_score"]
    figures = exports.kpis(scores, m["fct_contrato"], p)
    assert "Join" not in figures._jdf.queryExecution().optimizedPlan().toString()
    assert figures.collect() == exports.kpis(scores.drop("modalidad_norm"), m["fct_contrato"], p).collect()


def test_entities_are_planned_once(spark, sf):
    """The dimension of entities, which their scores and F04 read, comes from a table and not from all contracts again."""
    found = scoring.run(testdata.mart(spark, sf, written=True), testdata.PARAMS, ("entidad_score",), False)["entidad_score"]
    assert "nombre_entidad" in found.columns and "explode" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_cases_meet_ranks_of_distinct_scores(spark):
    """A case's percentile is found by year and score; no contracts are joined by id for it, and those without score or year have none."""
    rows = [(f"C{i}", "E1" if i < 3 else "E2", "S", 2020 if i != 2 else None, 1.0, float(i % 4) if i != 1 else None, "bajo") for i in range(9)]
    scores = spark.createDataFrame(rows, "id_contrato string, nombre_entidad string, nombre_proveedor string, anio int, valor_contrato double, score double, tier string")
    cases = spark.createDataFrame([("a", "A", 2000, 2030, ["E1"], [], []), ("b", "B", 2000, 2030, ["E2"], [], [])], backtest.CASES)
    found = backtest.case_summary(scores, cases)
    assert "(id_contrato" not in "".join(x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x)
    years = {r["id_contrato"]: r["percentil_anio"] for r in backtest.year_percentiles(scores).collect()}
    best = {r["slug"]: (r["n_matched"], r["best_score"], r["best_percentil_anio"], r["top_quartile_reached"]) for r in found.collect()}
    assert best == {"a": (2, 0.0, years["C0"], False), "b": (6, 3.0, years["C7"], True)} and "C1" not in years


@pytest.mark.parametrize("often", [False, True])
def test_concentration_shuffles_contracts_once(spark, sf, monkeypatch, often):
    """Contracts meet once, by entity and year, and those of frequent keys after they were summed by supplier; the rows are those of a plain computation."""
    m, p = testdata.regional(spark, sf) if often else testdata.mart(spark, sf, written=True), dataclasses.replace(testdata.PARAMS, concentration_min_contracts=3)
    if often:
        monkeypatch.setattr(flags, "OFTEN", 200)
    got = flags.f12(m, p)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(nit_entidad_norm" in plan and plan.count("REPARTITION_BY_COL") >= 1 and ("Union" in plan.split("REPARTITION_BY_COL")[0]) == often
    rows = [(r["nit_entidad_norm"], r["anio"], r["doc_proveedor_norm"], r["valor_contrato"]) for r in m["fct_contrato"].collect() if r["valor_contrato"] is not None and r["anio"] is not None and r["nit_entidad_norm"]]
    entity, pair, n = {}, {}, {}
    for e, y, s, v in rows:
        entity[e, y], n[e, y] = entity.get((e, y), 0) + v, n.get((e, y), 0) + 1
        if s:
            pair.setdefault((e, y), {}).setdefault(s, []).append(v)
    want = {(e, y): max(sum(v) for v in of.values()) / entity[e, y] for (e, y), of in pair.items() if n[e, y] >= 3}
    found = got.collect()
    assert len(found) == len(want) > 20
    assert all(r["participacion_proveedor_en_entidad"] == pytest.approx(want[r["key"], r["anio"]]) and r["n_contratos_entidad_anual"] == n[r["key"], r["anio"]] for r in found)


def test_evidence_in_one_pass_is_that_of_each_flag(spark, sf):
    """The list of fired flags built in one pass, sanctions by history and frequencies of short texts included, is that of each flag's own plan."""
    p = dataclasses.replace(testdata.PARAMS, rotation_days=1460, rotation_min_contracts=3, rotation_winners=(2, 1000), rotation_min_share=0.0, rotation_min_alternation=0.3, split_days=60, vague_length=50)
    mart = testdata.regional(spark, sf)
    assert "_history" in flags.supplier_dates(mart, True).columns
    listed = lambda rows: scoring.per_key(rows, p, "contract").select("key", "flags_disparados").where("flags_disparados <> '[]'")
    told, own = listed(flags.folded(mart, p)), listed(flags.run(mart, p, "contract", fired_only=True))
    assert told.exceptAll(own).count() == own.exceptAll(told).count() == 0
    seen = {r[0] for r in told.select(F.explode(parsed(F.col("flags_disparados"))["flag_id"])).distinct().collect()}
    assert seen >= {"F03", "F05", "F06", "F11", "F13"}


def test_evidence_meets_as_values_of_rows_that_fired(spark, sf, monkeypatch):
    """The lists of fired flags are those of the scores, but what is shuffled for them is values, not text; ids of many rows, combined first, have the same lists."""
    m, p = testdata.mart(spark, sf, written=True), testdata.PARAMS
    kinds = {c: t for c, t in flags.folded(m, p).dtypes if c.startswith("evidence_")}
    assert len(kinds) == 12 and all(t.startswith("struct<") for t in kinds.values())
    rows = lambda df: sorted(map(tuple, df.collect()))
    whole = scoring.run(m, p, ("contrato_score",), True, ())["contrato_score"].where("n_flags_disparados > 0").select("id_contrato", "flags_disparados")
    found = scoring.fired_lists(m, p)
    assert rows(found) == rows(whole)
    m["fct_contrato"] = m["fct_contrato"].withColumn("id_contrato", F.when(F.crc32("row_id") % 2 == 0, F.lit("many")).otherwise(F.col("id_contrato")))
    plain = rows(scoring.fired_lists(m, p))
    monkeypatch.setattr(scoring, "OFTEN", 1000)
    assert scoring.repeated_ids(m["fct_contrato"]) == ["many"] and rows(scoring.fired_lists(m, p)) == plain


def test_overview_counts_each_contract_once(spark, sf):
    """What flags apply to and fire in, from the numbers that scores take, is what their own rows give, where F05 and F06 add rows too."""
    p = dataclasses.replace(testdata.PARAMS, rotation_days=1460, rotation_min_contracts=3, rotation_winners=(2, 1000), rotation_min_share=0.0, rotation_min_alternation=0.3, split_days=60)
    mart = testdata.regional(spark, sf)
    own = flags.summary(flags.run(mart, p, "contract").unionByName(flags.run(mart, p, "entity")), p).collect()
    assert sorted(flags.overview(mart, p).collect()) == sorted(own) and all(r["fired"] > 0 for r in own if r["flag_id"] in ("F03", "F05", "F06", "F11"))
    assert {r["population"] for r in flags.overview({k: df.limit(0) for k, df in mart.items()}, p).collect()} == {0}
