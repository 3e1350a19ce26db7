"""Raw text rows to published artifacts, through the command line."""

from __future__ import annotations

import json

import pytest

from pliego.__main__ import main
from pliego.plans import marts, scoring

N = 50


def write(spark, path, columns, rows):
    spark.createDataFrame([tuple(r.get(c) for c in columns) for r in rows], ", ".join(f"`{c}` string" for c in columns)).coalesce(1).write.parquet(str(path))


@pytest.fixture(scope="module")
def raw(spark, tmp_path_factory):
    """Fifty contracts of six entities, scores from none to all flags."""
    root = tmp_path_factory.mktemp("raw")
    contracts, processes = [], []
    for i in range(N):
        bad = i % 5  # how suspicious
        contracts.append({
            ":id": f"r{i}", "id_contrato": f"C{i:02}", "proceso_de_compra": f"P{i}", "nit_entidad": f"80000000{i % 6}", "nombre_entidad": f"Alcaldía {i % 6}", "documento_proveedor": f"10{i % 7}", "proveedor_adjudicado": f"Proveedor {i % 7}",
            "modalidad_de_contratacion": "Licitación pública" if i % 3 else "Contratación directa", "objeto_del_contrato": "obra" if bad > 2 else f"Construcción de la vía número {i} en el municipio de Bogotá", "codigo_de_categoria_principal": "V1.72141000",
            "fecha_de_firma": f"2023-{12 if bad > 1 else 1 + i % 6:02}-20", "valor_del_contrato": "2000000000" if bad > 2 else f"{1000 + i}", "dias_adicionados": "90" if bad > 3 else "0", "fecha_de_inicio_del_contrato": "2023-01-01", "fecha_de_fin_del_contrato": "2023-04-01",
            "departamento": "Bogotá", "ciudad": "Bogotá",
        })
        processes.append({":id": f"p{i}", "id_del_portafolio": f"P{i}", "precio_base": "2000000000" if bad > 3 else "5", "fecha_de_publicacion_del": "2023-01-01", "fecha_de_recepcion_de": "2023-01-03" if bad > 3 else "2023-03-01", "proveedores_unicos_con": "1" if bad > 2 else "4", "valor_total_adjudicacion": "2000000000"})
    contracts += [{":id": "bad", "valor_del_contrato": "INVALID", "fecha_de_firma": "2023-01-01"}]
    s1 = ":id id_contrato proceso_de_compra nit_entidad nombre_entidad documento_proveedor proveedor_adjudicado modalidad_de_contratacion tipo_de_contrato objeto_del_contrato codigo_de_categoria_principal fecha_de_firma fecha_de_inicio_del_contrato fecha_de_fin_del_contrato dias_adicionados valor_del_contrato valor_pagado urlproceso estado_contrato departamento ciudad".split()
    s2 = "id_del_proceso id_del_portafolio referencia_del_proceso entidad nit_entidad departamento_entidad ciudad_entidad modalidad_de_contratacion precio_base fecha_de_publicacion_del fecha_de_recepcion_de duracion unidad_de_duracion proveedores_invitados respuestas_al_procedimiento proveedores_unicos_con adjudicado valor_total_adjudicacion nombre_del_adjudicador :id".split()
    write(spark, root / "s1", s1, contracts)
    write(spark, root / "s2", s2, processes)
    write(spark, root / "divipola", ["cod_dpto", "dpto", "cod_mpio", "nom_mpio"], [{"cod_dpto": "5", "dpto": "ANTIOQUIA", "cod_mpio": "5001", "nom_mpio": "MEDELLÍN"}, {"cod_dpto": "11", "dpto": "BOGOTÁ", "cod_mpio": "11001", "nom_mpio": "BOGOTÁ"}])
    write(spark, root / "l1", ["n_mero_de_identificaci_n", "raz_n_social_de_la_entidad", "fecha_de_resoluci_n_de_la", "descripci_n_o_detalle_resumen", "tipo_de_sanci_n_multa"], [{"n_mero_de_identificaci_n": "104", "fecha_de_resoluci_n_de_la": "2020-01-01"}, {"n_mero_de_identificaci_n": "103", "fecha_de_resoluci_n_de_la": "2024-01-01"}])
    write(spark, root / "l2", ["documento_contratista", "nombre_contratista", "fecha_de_firmeza", "fecha_de_publicacion", "numero_de_contrato", "numero_de_resolucion"], [])
    write(spark, root / "l3", ["as_codigo_proveedor_objeto", "nombre_proveedor_objeto_de", "fecha_evento", "tipo_de_sancion", "descripcion_otro_tipo_de"], [])
    write(spark, root / "l4", ["numero_identificacion", "primer_nombre", "segundo_nombre", "primer_apellido", "segundo_apellido", "fecha_efectos_juridicos", "tipo_inhabilidad", "sanciones"], [])
    write(spark, root / "secop1_slices" / "caso" / "d1", ["uid", "numero_de_contrato", "cuantia_contrato", "fecha_de_firma_del_contrato", "valor_total_de_adiciones", "nit_entidad"], [{"uid": "u1", "numero_de_contrato": "OLD1", "cuantia_contrato": "100", "fecha_de_firma_del_contrato": "2096-05-01", "valor_total_de_adiciones": "60", "nit_entidad": "8000000001"}])
    return root


@pytest.fixture(scope="module")
def mart(spark, raw, tmp_path_factory):
    path = tmp_path_factory.mktemp("mart") / "m"
    main(["marts", str(raw), str(path)])
    return path


def test_mart(spark, mart):
    read = lambda t: spark.read.parquet(f"{mart}/{t}")
    assert read("fct_contrato").count() == N + 1 and read("quarantine").count() == 1 and read("fct_proceso").count() == N
    assert {r["source"]: r["n"] for r in read("fct_contrato").groupBy("source").count().withColumnRenamed("count", "n").collect()} == {"SECOP2": N, "SECOP1": 1}
    assert read("dim_entidad").count() == 7 and read("dim_proveedor").count() == 7 and read("sanciones").count() == 2


def test_scores_reach_every_tier(spark, mart, tmp_path):
    main(["score", str(mart), str(tmp_path / "s")])
    scores = spark.read.parquet(str(tmp_path / "s" / "contrato_score"))
    assert {r["tier"] for r in scores.collect()} >= {"bajo", "medio", "alto", "critico"} and scores.count() == N + 1
    flags = spark.read.parquet(str(tmp_path / "s" / "flag_contrato"))
    old = {r["flag_id"]: r["fired"] for r in flags.where("key = 'OLD1'").collect()}
    assert old["F03"] and not old["F09"] and "F01" not in old
    assert json.loads(flags.where("key = 'C04' AND flag_id = 'F03'").first()["evidence_json"])["dias_adicionados"] == 90


def test_export(spark, mart, tmp_path):
    web = tmp_path / "web"
    (web / "departamentos").mkdir(parents=True)
    (web / "departamentos" / "99.json").write_text("{}")  # of an earlier run
    cases = tmp_path / "cases.json"
    period = [2000, 2030]
    cases.write_text(json.dumps({"casos": [{"slug": "alcaldia", "nombre": "A", "periodo": period, "hint_entidad_like": ["%ALCALD_A%"]}, {"slug": "nadie", "periodo": period, "hint_entidad_like": ["%NADIE%"]}]}))
    main(["export", str(mart), str(web), "--cases", str(cases), "--version", "abc"])
    read = lambda name: json.loads((web / name).read_text())
    first = read("casos_prioritarios/000.json")
    scores = [i["score"] for i in first["items"]]
    assert first["n_items_total"] == N + 1 and scores == sorted(scores, reverse=True) and first["items"][0]["tier"] == "critico"
    assert {b["flag_id"] for b in first["items"][0]["banderas"]} >= {"F01", "F07"} and first["items"][0]["dpto"] == "BOGOTÁ"
    assert {i["tier"] for i in first["items"]} == {"bajo", "medio", "alto", "critico"}
    recent = read("contratos_recientes/000.json")
    assert "OLD1" not in {i["id_contrato"] for i in recent["items"]} and recent["n_items_total"] == N
    assert read("departamentos/05.json")["n_contratos"] == 0 and read("departamentos/11.json")["n_contratos"] == N and len(read("departamentos/11.json")["top_entidades"]) == 6
    top = read("entidades_top.json")
    assert top["n_items"] == 7 == len(top["items"]) and [i["score"] for i in top["items"]] == sorted((i["score"] for i in top["items"]), reverse=True) and "_score" not in top["items"][0]
    national = read("resumen_nacional.json")
    assert national["kpis"]["contratos_analizados"] == N + 1 and [d["cod_dpto"] for d in national["departamentos"]] == ["05", "11"]
    assert sum(x["n_contratos"] for x in national["serie_anio_tier"]) == N + 1 == sum(x["n_contratos"] for x in national["serie_anio_modalidad"])
    meta = read("meta.json")
    known = meta["backtest"]
    assert meta["artefactos"]["casos_prioritarios"]["n_chunks"] == 1 and len(meta["banderas"]) == 14 and known["n_positivos_l1_l4"] == 7 and known["auc_roc"] > 0 and known["lift_top_decil"] is not None
    assert meta["version"]["git_commit"] == "abc" and [c["slug"] for c in known["casos_emblematicos"]] == ["alcaldia", "nadie"]
    own = {c["slug"]: c for c in known["casos_emblematicos"]}
    assert own["alcaldia"]["n_matched"] > 0 and own["alcaldia"]["confirmado_manualmente"] and own["nadie"]["n_matched"] == 0 and own["nadie"]["cuartil_superior"] is None
    flags = [b for i in first["items"] for b in i["banderas"]] + [b for d in ("05", "11") for e in read(f"departamentos/{d}.json")["top_entidades"] for b in e["banderas"]]
    assert flags and all(isinstance(b["evidence"], dict) and b["evidence"] for b in flags)
    files = read("manifest.json")
    assert {str(f.relative_to(web)) for f in web.rglob("*.json")} == {f["path"] for f in files["files"]} | {"manifest.json"}
    assert files["total_bytes"] == sum((web / f["path"]).stat().st_size for f in files["files"])


def test_backtest_enrich_and_report(spark, mart, tmp_path):
    main(["backtest", str(mart), str(tmp_path / "b")])
    auc = spark.read.parquet(str(tmp_path / "b" / "auc")).first()
    assert auc["n_pos"] == 7 and auc["n"] == N + 1
    write(spark, mart / "e1_ibague", ["nit", "fecha_de_matricula"], [{"nit": "103", "fecha_de_matricula": "20221215"}])
    write(spark, mart / "e1_santarosa", ["nit", "digito_verificacion", "numero_identificacion", "fecha_matricula"], [])
    main(["enrich", str(mart), str(tmp_path / "e")])
    rich = scoring.run(marts.opened(spark, str(tmp_path / "e"), ["fct_contrato", "fct_proceso", "stg_secop1", "dim_entidad", "dim_proveedor", "sanciones", "divipola", "ref_smmlv", "ref_ventanas"]))
    assert {(r["key"], r["fired"]) for r in rich["flag_contrato"].where("flag_id = 'F02'").collect()} == {(f"C{i:02}", True) for i in range(N) if i % 7 == 3}
    main(["report", str(mart), str(tmp_path / "dq.md")])
    report = (tmp_path / "dq.md").read_text()
    assert all(f"## {title}" in report for title in ("Modalities", "Join keys", "Columns of contracts")) and f"| referencia | {N} | {N} | 100.0 |" in report
    main(["report", str(tmp_path / "e"), str(tmp_path / "dq2.md")])
    assert "## Registry" in (tmp_path / "dq2.md").read_text()
    assert {r["target"] for r in spark.read.parquet(str(tmp_path / "b" / "targets")).collect()} == {"auc", "lift", "cases"}


def test_sql_function_parity(spark):
    from pyspark.sql import functions as F

    from pliego.functions.sql import register
    from pliego.functions.text import nit_base

    register(spark)
    rows = spark.createDataFrame([(x,) for x in ("9001234567", "8001234567", "1001234567", "900123456", "", None, "90012345678")], "n string")
    assert rows.where(~F.expr("nit_base(n)").eqNullSafe(nit_base(F.col("n")))).count() == 0
