"""Cleaning, staging, dimensions, enrichment and quality on small raw tables."""

from __future__ import annotations

import pytest
from helpers import contract, day, rows_to_df
from pyspark.sql import functions as F

from pliego.functions import casts, text
from pliego.operators import dedup, joins, profiles
from pliego.plans import enrichment, marts, quality


def one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize(("raw", "clean"), [("  Construcciones Andrés S.A.S. ", "CONSTRUCCIONES ANDRES"), ("Aseo,  S.A.", "ASEO"), ("Pérez e Hijos LTDA", "PEREZ E HIJOS"), ("López S EN C", "LOPEZ"), ("Hospital E.S.E.", "HOSPITAL"), ("CASAS", "CASAS"), ("   ", None), (None, None), ("ñame", "NAME")])
def test_company_names(spark, raw, clean):
    assert one(spark, text.company_name(F.lit(raw).cast("string"))) == clean


@pytest.mark.parametrize(("raw", "norm", "base"), [("900.123.456-7", "9001234567", "900123456"), ("800123456", "800123456", "800123456"), ("1.020.304.050", "1020304050", "1020304050"), ("n/a", None, None), (None, None, None), ("", None, None)])
def test_documents(spark, raw, norm, base):
    got = one(spark, text.document(F.lit(raw).cast("string")))
    assert (got["doc_raw"], got["doc_norm"], got["nit_base"]) == (raw, norm, base)


@pytest.mark.parametrize(("number", "person"), [("12345678", True), ("900123456", False), ("8001234567", False), ("1020304050", True), ("2020304050", None), ("123456789", None), ("", None), (None, None)])
def test_persons(spark, number, person):
    assert one(spark, text.natural_person(F.lit(number).cast("string"))) is person


@pytest.mark.parametrize(("raw", "value"), [("12.5", 12.5), (" 7 ", 7.0), ("1e3", 1000.0), ("5d", None), ("5F", None), ("NaN", None), ("inf", None), ("", None), ("x", None), (None, None)])
def test_lenient_numbers(spark, raw, value):
    assert one(spark, casts.lenient_double(F.lit(raw).cast("string"))) == value


@pytest.mark.parametrize(("raw", "value"), [("12.5", 13), ("-12.5", -13), ("14.4", 14), ("99999999999", None), ("", None)])
def test_lenient_ints(spark, raw, value):
    assert one(spark, casts.lenient_int(F.lit(raw))) == value


@pytest.mark.parametrize(("raw", "value"), [("2023-02-20 00:00:00.000000000", "2023-02-20"), ("2023-12-31T00:00:00.000", "2023-12-31"), ("2023", None), ("2023-05-01 junk", None), ("2023-02-30", None), (None, None)])
def test_lenient_dates(spark, raw, value):
    assert one(spark, casts.lenient_date(F.lit(raw).cast("string"))) == (value and day(value))


def test_codes_and_amounts(spark):
    row = spark.range(1).select(text.unspsc_segment(F.lit("V1.80111600")), text.unspsc_segment(F.lit("xx")), text.padded(F.lit("5"), 2), text.padded(F.lit("12345678"), 5), text.pesos(F.lit(2.5e12)), text.pesos(F.lit(1234.0)), text.humanised(F.lit("LICITACION_PUBLICA"))).first()
    assert list(row) == [80, None, "05", "12345678", "$2,5 billones", "$1.234", "Licitacion Publica"]


def raw_contracts(spark):
    cols = ":id id_contrato proceso_de_compra nit_entidad nombre_entidad documento_proveedor proveedor_adjudicado modalidad_de_contratacion tipo_de_contrato objeto_del_contrato codigo_de_categoria_principal fecha_de_firma fecha_de_inicio_del_contrato fecha_de_fin_del_contrato dias_adicionados valor_del_contrato valor_pagado urlproceso estado_contrato departamento ciudad file_name".split()
    base = {"id_contrato": "K", "nit_entidad": "900.1", "documento_proveedor": "12-3", "modalidad_de_contratacion": "Licitación pública", "codigo_de_categoria_principal": "V1.80111600", "fecha_de_firma": "2023-01-10T00:00:00.000", "fecha_de_inicio_del_contrato": "2023-01-11", "fecha_de_fin_del_contrato": "2023-01-21", "valor_del_contrato": "1000", "departamento": "Bogotá", "ciudad": "Bogotá", "file_name": "part-00000.parquet"}
    rows = [
        base | {":id": "row1"}, base | {":id": "row1", "valor_del_contrato": "2000", "file_name": "part-refresh-00000.parquet"}, base | {":id": "row2", "valor_del_contrato": "INVALID"}, base | {":id": "row3", "fecha_de_firma": "NOT-A-DATE"},
        base | {":id": "row4", "valor_del_contrato": "INVALID", "fecha_de_firma": "NOT-A-DATE"}, base | {":id": "row5", "valor_del_contrato": None}, base | {":id": "row6", "modalidad_de_contratacion": "Otra cosa", "ciudad": "Nada"}, base,
    ]
    return spark.createDataFrame([tuple(r.get(c) for c in cols) for r in rows], ", ".join(f"`{c}` string" for c in cols))


def test_staging_quarantine_and_facts(spark):
    mart = marts.reference_tables(spark) | {"divipola": marts.geography(spark.createDataFrame([("11", "BOGOTÁ", "11001", "BOGOTÁ")], "cod_dpto string, dpto string, cod_mpio string, nom_mpio string"))}
    staged = marts.staged(raw_contracts(spark))
    assert staged.count() == 6
    bad, good = marts.split_bad(staged)
    assert dict(bad.select("row_id", "reason").collect()) == {"row2": "bad_valor_del_contrato", "row3": "bad_fecha_de_firma", "row4": "bad_valor_del_contrato"}
    old = marts.staged_old([spark.createDataFrame([("u1", "5", "123", "2022-05-01"), ("u1", "5", "123", "2022-05-01")], "uid string, cuantia_contrato string, nit_entidad string, fecha_de_firma_del_contrato string"), spark.createDataFrame([("u2", "9")], "`:id` string, cuantia_contrato string")])
    fct = {r["row_id"]: r for r in marts.contracts(good, old, mart).collect()}
    assert set(fct) == {"row1", "row6", "u1"}
    assert (fct["row1"]["valor_contrato"], fct["row1"]["nit_entidad_norm"], fct["row1"]["modalidad_norm"], fct["row1"]["es_competitiva"], fct["row1"]["cod_mpio"], fct["row1"]["unspsc_segmento"], fct["row1"]["duracion_dias_inicial"], fct["row1"]["dias_adicionados"], fct["row1"]["anio"]) == (2000.0, "9001", "LICITACION_PUBLICA", True, "11001", 80, 10, 0, 2023)
    assert (fct["row6"]["modalidad_norm"], fct["row6"]["es_abierta"], fct["row6"]["cod_dpto"]) == ("OTRO", False, None)
    assert (fct["u1"]["source"], fct["u1"]["cod_dpto"]) == ("SECOP1", None)
    assert {r["reason"]: (r["source"], r["n"], round(r["pct"], 6)) for r in quality.quarantined(bad, staged).collect()} == {"bad_valor_del_contrato": ("S1", 2, 33.333333), "bad_fecha_de_firma": ("S1", 1, 16.666667)}


def test_processes(spark):
    cols = "id_del_proceso id_del_portafolio referencia_del_proceso entidad nit_entidad departamento_entidad ciudad_entidad modalidad_de_contratacion precio_base fecha_de_publicacion_del fecha_de_recepcion_de duracion unidad_de_duracion proveedores_invitados respuestas_al_procedimiento proveedores_unicos_con adjudicado valor_total_adjudicacion nombre_del_adjudicador :id".split()
    row = {"id_del_portafolio": "P1", "precio_base": "10.5", "fecha_de_publicacion_del": "2023-01-01", "adjudicado": "Si", "proveedores_unicos_con": "3", ":id": "x"}
    got = marts.processes(spark.createDataFrame([tuple(row.get(c) for c in cols)], ", ".join(f"`{c}` string" for c in cols)), marts.reference_tables(spark)).first()
    assert (got["referencia"], got["precio_base"], got["adjudicado"], got["num_oferentes_unicos"], got["modalidad_norm"], got["anio"]) == ("P1", 10.5, True, 3, "OTRO", 2023)


def test_sanctions(spark):
    make = lambda **c: spark.createDataFrame([tuple(c.values())], ", ".join(f"{k} string" for k in c))
    found = marts.sanctions(
        make(n_mero_de_identificaci_n="1-2", raz_n_social_de_la_entidad="A", fecha_de_resoluci_n_de_la="2020-01-01", descripci_n_o_detalle_resumen=None, tipo_de_sanci_n_multa="m"), make(documento_contratista="3", nombre_contratista="B", fecha_de_firmeza=None, fecha_de_publicacion="2020-01-02", numero_de_contrato="7", numero_de_resolucion=None),
        make(as_codigo_proveedor_objeto="4", nombre_proveedor_objeto_de="C", fecha_evento="bad", tipo_de_sancion="t", descripcion_otro_tipo_de=None), make(numero_identificacion="5", primer_nombre="D", segundo_nombre=None, primer_apellido="E", segundo_apellido=None, fecha_efectos_juridicos="2020-01-04", tipo_inhabilidad="i", sanciones="s"),
    ).collect()
    assert [(r["doc_norm"], r["fuente"], r["detalle"]) for r in found] == [("12", "CGR", "m"), ("3", "MULTA_SECOP1", "Contrato: 7 | Resolución: "), ("4", "MULTA_SECOP2", "t | "), ("5", "SIRI", "i | s")]
    assert found[2]["fecha_sancion"] is None and found[3]["nombre"] == "D  E "


def test_dimensions(spark):
    rows = [contract(1, nombre_entidad="B"), contract(2, nombre_entidad="A"), contract(3, nombre_entidad="B", cod_dpto="5"), contract(4, nit_entidad_norm="", doc_proveedor_norm="900123456"), contract(5, nit_entidad_norm="E2", nombre_entidad=None), contract(6, nit_entidad_norm="E2", nombre_entidad="Z"), contract(7, nit_entidad_norm="E2", nombre_entidad=None)]
    fct = rows_to_df(spark, "fct_contrato", rows)
    assert {r["nit_entidad_norm"]: tuple(r)[1:] for r in marts.entities(fct).collect()} == {"E1": ("B", "5", None, 3, 300.0), "E2": (None, None, None, 3, 300.0)}
    assert {r["doc_proveedor_norm"]: r["es_persona_natural"] for r in marts.suppliers(fct).collect()} == {"S1": True, "900123456": False}


def registers(spark):
    ibague = spark.createDataFrame([("800.111.222-3", "19970507"), ("800111222", "19970101"), ("NO APLICA", "19900101"), (None, "19900101"), ("5", "1972011")], "nit string, fecha_de_matricula string")
    santarosa = spark.createDataFrame([("800111222", "3", None, "19970601"), (None, None, "79.5", "20100101"), ("900222333", None, None, "bad")], "nit string, digito_verificacion string, numero_identificacion string, fecha_matricula string")
    return ibague, santarosa


def test_registry(spark):
    found = enrichment.resolved(*registers(spark))
    assert {r["nit_base"]: (r["fecha_matricula"], r["is_conflict"], r["n_sources_matched"], r["n_registros_ibague"]) for r in found.collect()} == {"800111222": (day("1997-01-01"), True, 2, 2), "795": (day("2010-01-01"), False, 1, 0)}
    dim = rows_to_df(spark, "dim_proveedor", [{"doc_proveedor_norm": "8001112223", "valor_total": 30.0}, {"doc_proveedor_norm": "1", "valor_total": 10.0, "es_persona_natural": True}])
    once = enrichment.enriched(dim, found)
    assert sorted(map(str, enrichment.enriched(once, found).collect())) == sorted(map(str, once.collect()))
    cover = {r["kind"]: r for r in enrichment.coverage(once).collect()}
    assert (cover["all"]["pct_matched"], cover["all"]["pct_valor"], cover["true"]["n_matched"], cover["unknown"]["n_matched"]) == (50.0, 75.0, 0, 1)
    assert enrichment.completeness({"live_count_at_start": 200, "status": "complete"}, 50)["pct_of_live_total"] == 25.0


def test_candidates_and_lookup(spark):
    dim = rows_to_df(spark, "dim_proveedor", [{"doc_proveedor_norm": d} for d in ("A", "B", "C")], fecha_matricula="date").withColumn("fecha_matricula", F.when(F.col("doc_proveedor_norm") == "C", F.lit("2020-01-01").cast("date")))
    fct = rows_to_df(spark, "fct_contrato", [contract(1, doc_proveedor_norm="A", valor_contrato=3e8), contract(2, doc_proveedor_norm="B", valor_contrato=1e6), contract(3, doc_proveedor_norm="C", valor_contrato=5e8)])
    assert [r[0] for r in enrichment.candidates({"dim_proveedor": dim, "fct_contrato": fct}).collect()] == ["A"]
    flags = rows_to_df(spark, "flags", [{"key": "C2", "fired": True}, {"key": "C1", "fired": False}])
    assert [r[0] for r in enrichment.candidates({"dim_proveedor": dim, "fct_contrato": fct, "flag_contrato": flags}).collect()] == ["A", "B"]
    wanted = spark.createDataFrame([("1",), ("2",)], "nit_base string")
    cache = spark.createDataFrame([("1", day("2001-01-01"))], "nit_base string, fecha_matricula date")
    assert dict(enrichment.looked_up(wanted, cache).collect()) == {"1": day("2001-01-01"), "2": None}
    assert dict(enrichment.looked_up(wanted, cache, lambda n: "20200202", 1000.0).collect()) == {"1": day("2001-01-01"), "2": day("2020-02-02")}


def test_lookups_are_written_back(spark, tmp_path):
    wanted = spark.createDataFrame([(str(i),) for i in range(12)] + [("3",), (None,)], "nit_base string")
    log = tmp_path / "asked"
    log.mkdir()

    def fetch(number, log=str(log)):
        import time
        import uuid

        with open(f"{log}/{uuid.uuid4().hex}", "w") as f:
            f.write(f"{number} {time.time()}")
        return "20200202" if int(number) % 3 else None

    cache = enrichment.LookupCache(str(tmp_path / "cache"))
    expected = {str(i): day("2020-02-02") if i % 3 else None for i in range(12)}
    assert dict(enrichment.looked_up(wanted, cache, fetch, 20.0, tasks=3).collect()) == expected
    times = sorted(float(f.read_text().split()[1]) for f in log.glob("*"))
    assert len(times) == 12 and all(b - a > 0.05 * 3 for a, b in zip(times, times[7:], strict=False))  # no seven within the time of three
    assert dict(enrichment.looked_up(wanted, cache, fetch, 20.0).collect()) == expected and len(list(log.glob("*"))) == 12  # those without a date aren't asked for again either
    more = spark.createDataFrame([("1",), ("77",)], "nit_base string")
    assert dict(enrichment.looked_up(more, cache, fetch, 50.0).collect()) == {"1": day("2020-02-02"), "77": day("2020-02-02")} and len(list(log.glob("*"))) == 13
    assert cache.rows(spark).where("NOT found").count() == 4


def test_join_operators(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    banned = lambda *v: spark.createDataFrame([(x,) for x in v], "b int")
    keys = lambda df: sorted((r[0] is None, r[0]) for r in df.select("k").collect())
    assert keys(joins.excluding(left, "k", banned(1), "b")) == [(False, 2)]
    assert joins.excluding(left, "k", banned(1, None), "b").count() == 0
    assert joins.excluding(left, "k", banned(), "b").count() == 3
    assert dict(joins.exists_marker(left, banned(1, 1).toDF("k"), ["k"], "there").collect()) == {1: True, 2: False, None: False}


def test_dedup_and_profile(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", None, "y"), ("b", None, "z"), (None, 5, "w")], "k string, v int, t string")
    assert {r["k"]: r["t"] for r in dedup.keep_latest(rows, ["k"], "v", "t").collect()} == {"a": "x", "b": "z"}
    found = {r["col"]: tuple(r)[2:] for r in profiles.profile(rows).collect()}
    assert found["v"] == (4, 50.0, 2, ["1", "5"]) and found["k"] == (4, 25.0, 2, ["a", "b"])
    assert dict(profiles.null_rates(rows, ["k", "t"]).collect()) == {"k": 25.0, "t": 0.0}


def test_join_coverage_counts_contracts_once(spark):
    fct = rows_to_df(spark, "fct_contrato", [contract(1, proceso_de_compra="P1"), contract(2, proceso_de_compra="P2"), contract(3)])
    proc = rows_to_df(spark, "fct_proceso", [{"referencia": "P1"}, {"referencia": "P1"}])
    assert tuple(quality.join_coverage(fct, proc).first()) == (3, 1, pytest.approx(100 / 3))
    assert "| Modalities" not in "".join(quality.report({"fct_contrato": fct, "fct_proceso": proc}))
