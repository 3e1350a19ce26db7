"""Each flag: what fires, what does not, what is not applicable."""

from __future__ import annotations

import pytest
from helpers import contract, day, fired, rows_to_df

from pliego.params import FLAGS, Params
from pliego.plans import flags
from pliego.plans.marts import reference_tables

P = Params()


@pytest.fixture
def mart(spark):
    def build(contracts=(), processes=(), **tables):
        found = reference_tables(spark) | {"fct_contrato": rows_to_df(spark, "fct_contrato", list(contracts)), "fct_proceso": rows_to_df(spark, "fct_proceso", list(processes))}
        return found | {k: rows_to_df(spark, k, v[0] if isinstance(v, tuple) else v, **(v[1] if isinstance(v, tuple) else {})) for k, v in tables.items()}

    return build


def competitive(i, **values):
    return contract(i, **{"es_competitiva": True, "modalidad_norm": "LICITACION_PUBLICA", "proceso_de_compra": f"P{i}"} | values)


def process(i, **values):
    return {"referencia": f"P{i}", "row_id": f"p{i}"} | values


def test_f01(mart):
    m = mart([competitive(1), competitive(2), competitive(3), contract(4, proceso_de_compra="P1")], [process(1, num_oferentes_unicos=1), process(2, num_oferentes_unicos=2), process(3)])
    assert fired(flags.f01(m, P)) == {"C1": True, "C2": False}


def test_f01_latest_snapshot_only(mart):
    snapshots = [process(1, num_oferentes_unicos=5, fecha_publicacion=day("2023-01-01")), process(1, num_oferentes_unicos=1, fecha_publicacion=day("2023-02-01")), process(1, num_oferentes_unicos=7)]
    found = flags.f01(mart([competitive(1)], snapshots), P).collect()
    assert [r["fired"] for r in found] == [True]


def test_f02(mart):
    contracts = [contract(i, proceso_de_compra="P1", doc_proveedor_norm=f"S{i}") for i in range(5)]
    dates = ["2023-01-01", "2023-04-01", "2022-12-31", "2023-04-02", None]
    suppliers = [{"doc_proveedor_norm": f"S{i}", "fecha_matricula": d and day(d)} for i, d in enumerate(dates)]
    m = mart(contracts, [process(1, fecha_publicacion=day("2023-04-01"))], dim_proveedor=(suppliers, {"fecha_matricula": "date"}))
    assert fired(flags.f02(m, P)) == {"C0": True, "C1": True, "C2": False, "C3": False}
    bare = mart(contracts, [process(1)], dim_proveedor=[])
    assert flags.f02(bare, P).count() == 0


def test_f03(mart):
    rows = [
        contract("time", duracion_dias_inicial=100, dias_adicionados=50), contract("short", duracion_dias_inicial=100, dias_adicionados=49), contract("none", duracion_dias_inicial=0, dias_adicionados=49),
        contract("money", proceso_de_compra="P1", valor_contrato=141.0), contract("fair", proceso_de_compra="P1", valor_contrato=139.0), contract("old", source="SECOP1", row_id="x", valor_contrato=100.0), contract("unknown", source="SECOP1", row_id="y"),
    ]
    m = mart(rows, [process(1, valor_adjudicacion=100.0)], stg_secop1=[{":id": "x", "valor_total_de_adiciones": "40"}, {":id": "x", "valor_total_de_adiciones": "40"}, {":id": "y", "valor_total_de_adiciones": "many"}])
    assert fired(flags.f03(m, P)) == {"Ctime": True, "Cshort": False, "Cmoney": True, "Cfair": False, "Cold": True}


def test_f04(mart):
    rows, entities = [], []
    for e in range(6):
        entities.append({"nit_entidad_norm": f"E{e}", "cod_dpto": "5"})
        rows += [contract(f"{e}-{i}", nit_entidad_norm=f"E{e}", modalidad_norm="CONTRATACION_DIRECTA" if e == 0 or i == 0 else "OTRO") for i in range(5)]
    rows += [contract("few", nit_entidad_norm="E9"), contract("blank", nit_entidad_norm="")]
    m = mart(rows, dim_entidad=[*entities, {"nit_entidad_norm": "E9", "cod_dpto": "5"}])
    assert fired(flags.f04(m, P)) == {"E0": True} | {f"E{e}": False for e in range(1, 6)}
    alike = mart([r for r in rows if r["nit_entidad_norm"] not in ("E0", "E9")], dim_entidad=entities)
    assert flags.f04(alike, P).count() == 0  # no spread, no z


def test_f05(mart):
    big = 120e6
    near = [contract(i, fecha_firma=day(d), valor_contrato=big) for i, d in enumerate(["2023-01-01", "2023-01-20", "2023-02-15"])]
    assert fired(flags.f05(mart(near), P)) == {"C0": True, "C1": True, "C2": True}
    assert set(fired(flags.f05(mart(near[:2]), P)).values()) == {False}
    assert set(fired(flags.f05(mart([r | {"valor_contrato": 1e7} for r in near]), P)).values()) == {False}
    far = [r | {"fecha_firma": day(f"2023-{1 + 4 * i:02}-01")} for i, r in enumerate(near)]
    assert set(fired(flags.f05(mart(far), P)).values()) == {False}
    assert flags.f05(mart([r | {"unspsc_segmento": None} for r in near] + [contract(9, fecha_firma=day("1999-01-01"))]), P).count() == 0
    edge = [r | {"fecha_firma": day(d)} for r, d in zip(near, ["2023-01-01", "2023-04-01", "2023-06-30"], strict=True)]
    assert fired(flags.f05(mart(edge), P)) == {"C0": False, "C1": True, "C2": False}  # ninety days, both ends included


def test_f06(mart):
    def rows(winners, gap=20):
        from datetime import timedelta

        return [contract(f"{i:02}", es_competitiva=True, doc_proveedor_norm=w, fecha_firma=day("2023-01-01") + timedelta(days=gap * i)) for i, w in enumerate(winners)]

    turns = flags.f06(mart(rows(["W1", "W2", "W3"] * 3)), P).collect()
    assert [r["fired"] for r in turns] == [True] * 9 and {r["indice_alternancia"] for r in turns} == {1.0}
    for winners in ([f"W{i}" for i in range(9)], ["A"] * 8 + ["B"], ["A"] * 4 + ["B"] * 4, ["A", "B"] * 3):
        assert set(fired(flags.f06(mart(rows(winners)), P)).values()) == {False}
    same_day = flags.f06(mart(rows(["A", "B"] * 5, gap=0)), P).collect()
    assert {r["indice_alternancia"] for r in same_day} == {1.0}


def test_f07(mart):
    dates = {1: ("2023-01-01", "2023-01-10"), 2: ("2023-01-01", "2023-01-11"), 3: ("2023-01-02", "2023-01-01"), 4: ("2023-01-01", None)}
    m = mart([competitive(i) for i in dates] + [competitive(5, modalidad_norm="CONCURSO_MERITOS")], [process(i, fecha_publicacion=day(a), fecha_recepcion_respuestas=b and day(b)) for i, (a, b) in dates.items()] + [process(5, fecha_publicacion=day("2023-01-01"), fecha_recepcion_respuestas=day("2023-01-02"))])
    assert fired(flags.f07(m, P)) == {"C1": True, "C2": False}


def test_f08(mart):
    m = mart([competitive(1, valor_contrato=100.4), competitive(2, valor_contrato=101.0), competitive(3), competitive(4, valor_contrato=None)], [process(1, precio_base=100.0), process(2, precio_base=100.0), process(3, precio_base=0.0), process(4, precio_base=100.0)])
    assert fired(flags.f08(m, P)) == {"C1": True, "C2": False}


def test_f09(mart):
    m = mart([contract(1, fecha_firma=day("2023-12-15")), contract(2, fecha_firma=day("2023-12-14")), contract(3, fecha_firma=day("2023-11-20")), contract(4, fecha_firma=None)])
    assert fired(flags.f09(m, P)) == {"C1": True, "C2": False, "C3": False}


def test_f10(mart):
    m = mart([contract(1, fecha_firma=day("2023-06-29")), contract(2, fecha_firma=day("2023-10-29")), contract(3, fecha_firma=day("2023-10-30")), competitive(4, fecha_firma=day("2023-07-01"))])
    assert fired(flags.f10(m, P)) == {"C1": True, "C2": True, "C3": False}


def test_f11(mart):
    sanctions = [{"doc_norm": "S1", "fuente": "SIRI", "fecha_sancion": day("2023-01-01")}, {"doc_norm": "S1", "fuente": "CGR", "fecha_sancion": day("2023-01-01")}, {"doc_norm": "S2", "fuente": "CGR", "fecha_sancion": day("2023-03-01")}, {"doc_norm": "S3", "fuente": "CGR"}]
    m = mart([contract(1), contract(1), *(contract(i, doc_proveedor_norm=f"S{i}") for i in (2, 3, 4)), contract(5, doc_proveedor_norm="")], sanciones=sanctions)
    found = flags.f11(m, P).collect()
    assert sorted((r["key"], r["fired"], r["n_sanciones_antes_firma"], r["n_sanciones_total_contexto"], r["fuentes_antes_firma"]) for r in found) == [
        ("C1", True, 2, 2, "CGR, SIRI"), ("C1", True, 2, 2, "CGR, SIRI"), ("C2", False, 0, 1, None), ("C3", False, 0, 1, None), ("C4", False, 0, 0, None),
    ]


def test_f12(mart):
    captured = [contract(i, doc_proveedor_norm="S1" if i < 3 else "", valor_contrato=100.0) for i in range(5)]
    assert fired(flags.f12(mart(captured), P)) == {"E1": True}
    spread = [contract(i, doc_proveedor_norm=f"S{i}") for i in range(5)]
    assert fired(flags.f12(mart(spread), P)) == {"E1": False}
    tied = flags.f12(mart(spread), P).collect()
    assert tied[0]["doc_proveedor_dominante"] == "S0"
    assert flags.f12(mart(spread[:4]), P).count() == 0


def test_f13(mart):
    long = "Prestación de servicios profesionales para el proyecto número"
    rows = [contract(i, objeto_del_contrato=f"{long} {i}") for i in range(17)] + [contract("e", objeto_del_contrato=f"{long} x"), contract("a", objeto_del_contrato=f"{long}  x"), contract("b", objeto_del_contrato=f"{long} X "), contract("c", objeto_del_contrato="  obra "), contract("d")]
    found = fired(flags.f13(mart(rows), P))
    assert {k for k, v in found.items() if v} == {"Ca", "Cb", "Cc", "Ce"} and len(found) == 21
    assert all(fired(flags.f13(mart(rows[:5]), P)).values())  # all frequencies alike: all reach the border


def test_f14(mart):
    m = mart([contract(1, valor_contrato=1.2e9), contract(2, valor_contrato=1.25e9), contract(3, valor_contrato=9e8), contract(4, valor_contrato=1.2e9 + 0.4), contract(5, valor_contrato=None)])
    assert fired(flags.f14(m, P)) == {"C1": True, "C2": False, "C3": False, "C4": True}


def test_run_and_summary(mart):
    m = mart([contract(1), contract(2, fecha_firma=day("2023-12-20"))], dim_proveedor=[], dim_entidad=[], sanciones=[], stg_secop1=[])
    long = flags.run(m, P, "contract")
    assert long.columns == ["key", "flag_id", "fired", "evidence_json"]
    found = {r["flag_id"]: (r["population"], r["fired"]) for r in flags.summary(long, P).collect()}
    assert set(found) == set(FLAGS) and found["F09"] == (2, 1) and found["F01"] == (0, 0)
