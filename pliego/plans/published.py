"""What each kind of published artifact has to look like, and the catalogue that goes with them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pliego.params import Params

# Names, types and bounds of the published fields.
TEXT = {"type": "string"}
NAMED = {"type": "string", "minLength": 1}
TEXT_OR_NULL = {"type": ["string", "null"]}
COUNT = {"type": "integer", "minimum": 0}
WHOLE = {"type": "integer"}
NUMBER = {"type": "number"}
NUMBER_OR_NULL = {"type": ["number", "null"]}
AMOUNT = {"type": "number", "minimum": 0}
PERCENT = {"type": "number", "minimum": 0, "maximum": 100}
TRUTH = {"type": "boolean"}
TRUTH_OR_NULL = {"type": ["boolean", "null"]}
TIER = {"type": "string", "enum": ["bajo", "medio", "alto", "critico"]}
TIER_OR_NULL = {"type": ["string", "null"], "enum": ["bajo", "medio", "alto", "critico", None]}
DEPARTMENT = {"type": "string", "pattern": "^[0-9]{2}$"}
DEPARTMENT_OR_NONE = {"type": ["string", "null"], "pattern": "^([0-9]{2})?$"}
PLACE = {"type": "string", "pattern": "^[0-9]{5}$"}
PLACE_OR_NONE = {"type": ["string", "null"], "pattern": "^([0-9]{5})?$"}
FLAG = {"type": "string", "pattern": "^F[0-9]{2}$"}
MOMENT = {"type": "string", "format": "date-time"}


def record(**fields: Mapping) -> dict:
    """An object with just these fields, all of them."""
    return {"type": "object", "required": list(fields), "additionalProperties": False, "properties": fields}


def listing(items: Mapping, **more: int) -> dict:
    return {"type": "array", "items": items} | more


FIRED_FLAG = record(flag_id=FLAG, nombre=TEXT, peso=NUMBER, evidence={"type": "object"})
CONTRACT = record(
    id_contrato=NAMED, nit_entidad=TEXT_OR_NULL, nombre_entidad=TEXT_OR_NULL, doc_proveedor=TEXT_OR_NULL, nombre_proveedor=TEXT_OR_NULL, cod_dpto=DEPARTMENT_OR_NONE, dpto=TEXT_OR_NULL,
    cod_mpio=PLACE_OR_NONE, municipio=TEXT_OR_NULL, modalidad=TEXT_OR_NULL, anio={"type": ["integer", "null"]}, valor_contrato=NUMBER_OR_NULL, fecha_firma=TEXT_OR_NULL, source=TEXT_OR_NULL,
    score=NUMBER, tier=TIER, urlproceso=TEXT_OR_NULL, n_flags_aplicables=COUNT, n_flags_disparados=COUNT, banderas=listing(FIRED_FLAG),
)
CHUNK = record(chunk_index=COUNT, n_chunks={"type": "integer", "minimum": 1}, n_items_total=COUNT, items=listing(CONTRACT))
ENTITY = record(
    nit_entidad=NAMED, nombre_entidad=TEXT_OR_NULL, cod_dpto=DEPARTMENT_OR_NONE, dpto=TEXT_OR_NULL, n_contratos=COUNT, valor_total=NUMBER_OR_NULL, score=NUMBER_OR_NULL, tier=TIER_OR_NULL,
    datos_insuficientes=TRUTH, n_flags_aplicables=COUNT, n_flags_disparados=COUNT, banderas=listing(FIRED_FLAG),
)
SUPPLIER = record(doc_proveedor=NAMED, nombre_proveedor=TEXT_OR_NULL, es_persona_natural=TRUTH_OR_NULL, n_contratos=COUNT, valor_total=NUMBER_OR_NULL, score=NUMBER_OR_NULL, tier=TIER_OR_NULL, datos_insuficientes=TRUTH)
TOTALS = {"n_contratos": COUNT, "valor_total": AMOUNT, "score_promedio": NUMBER_OR_NULL}
BY_TIER = {"n_bajo": COUNT, "n_medio": COUNT, "n_alto": COUNT, "n_criticos": COUNT}
MUNICIPALITY = record(cod_mpio=PLACE, municipio=TEXT_OR_NULL, n_contratos=COUNT, valor_total=AMOUNT, score=NUMBER_OR_NULL, tier=TIER_OR_NULL, datos_insuficientes=TRUTH)
CASE = record(
    slug=TEXT, nombre=TEXT, periodo=listing(WHOLE, minItems=2, maxItems=2), n_matched=COUNT, mejor_score=NUMBER_OR_NULL, mejor_tier=TEXT_OR_NULL, percentil_anio=NUMBER_OR_NULL,
    cuartil_superior=TRUTH_OR_NULL, confirmado_manualmente=TRUTH,
)
BACKTEST = record(
    auc_roc=NUMBER_OR_NULL, objetivo_auc_roc=NUMBER, lift_top_decil=NUMBER_OR_NULL, objetivo_lift_top_decil=NUMBER, cumple_objetivos=TRUTH, n_contratos_evaluados=COUNT, n_positivos_l1_l4=COUNT,
    precision_top_1pct=NUMBER_OR_NULL, precision_top_5pct=NUMBER_OR_NULL, precision_top_10pct=NUMBER_OR_NULL, casos_emblematicos=listing(CASE), n_casos_emblematicos_total=COUNT,
    n_casos_emblematicos_con_coincidencias_genuinas=COUNT, n_casos_emblematicos_en_percentil_superior=COUNT,
    monitor_ciudadano=record(n_total=COUNT, n_matched=COUNT, match_rate_pct=NUMBER_OR_NULL, nota=TEXT), resumen=NAMED,
)
CHUNKS = record(top_n=WHOLE, chunk_size=WHOLE, n_chunks=WHOLE, patron_archivo=TEXT)
RANKED = record(top_n=WHOLE, criterio=TEXT)

#: The seven kinds.
ARTIFACT_SCHEMAS = {
    "casos_prioritarios": CHUNK,
    "contratos_recientes": CHUNK,
    "departamento": record(
        cod_dpto=DEPARTMENT, dpto=TEXT_OR_NULL, **TOTALS, **BY_TIER, municipios=listing(MUNICIPALITY), top_entidades=listing(ENTITY), serie_anio=listing(record(anio=WHOLE, **TOTALS))
    ),
    "entidades_top": record(n_items=COUNT, items=listing(ENTITY)),
    "proveedores_top": record(n_items=COUNT, items=listing(SUPPLIER)),
    "resumen_nacional": record(
        generado_en=MOMENT,
        kpis=record(
            contratos_analizados=COUNT, valor_total_cop=AMOUNT, casos_criticos=COUNT, pct_contratacion_directa=PERCENT, n_entidades=COUNT, n_proveedores=COUNT, n_contratos_sin_departamento=COUNT, pct_geolocalizado=PERCENT
        ),
        serie_anio_modalidad=listing(record(anio=WHOLE, modalidad=TEXT, n_contratos=COUNT, valor_total=AMOUNT)),
        serie_anio_tier=listing(record(anio=WHOLE, tier=TIER, n_contratos=COUNT)),
        departamentos=listing(record(cod_dpto=DEPARTMENT, dpto=TEXT_OR_NULL, **TOTALS, **BY_TIER)),
    ),
    "meta": record(
        generado_en=MOMENT,
        version=record(git_commit=TEXT_OR_NULL),
        banderas=listing(record(id=FLAG, nombre=NAMED, nivel={"type": "string", "enum": ["contract", "entity"]}, peso=NUMBER, descripcion=NAMED), minItems=1),
        niveles_riesgo=listing(record(id=TIER, nombre=TEXT, min_score=NUMBER, max_score=NUMBER_OR_NULL), minItems=1),
        formula_score=NAMED,
        shrinkage=record(k=NUMBER, min_contratos_rank=WHOLE),
        backtest=BACKTEST,
        artefactos=record(casos_prioritarios=CHUNKS, contratos_recientes=CHUNKS, entidades_top=RANKED, proveedores_top=RANKED, departamentos=record(patron_archivo=TEXT, top_n_entidades_por_departamento=WHOLE)),
    ),
}

#: What each flag looks for, for readers of the catalogue.
DESCRIPTIONS = {
    "F01": "Un proceso competitivo recibió oferta de una sola empresa.",
    "F02": "La empresa ganadora se matriculó poco antes de firmar el contrato.",
    "F03": "Las adiciones en dinero o en días pasan del límite sobre lo pactado al inicio.",
    "F04": "La entidad contrata directamente mucho más que las de su mismo nivel y departamento.",
    "F05": "Varios contratos directos parecidos, cercanos en el tiempo, suman más que la cuantía que obliga a licitar.",
    "F06": "Pocos proveedores se turnan los contratos de un mismo tipo en una entidad.",
    "F07": "El plazo para presentar ofertas fue más corto de lo razonable.",
    "F08": "El valor adjudicado es casi igual al precio base.",
    "F09": "El contrato se firmó en los últimos días del año.",
    "F10": "Un contrato directo se firmó en época de restricción electoral.",
    "F11": "El proveedor ya tenía una sanción vigente o reciente al firmar.",
    "F12": "Un solo proveedor concentra gran parte del gasto anual de la entidad.",
    "F13": "El objeto del contrato es demasiado corto o se repite en muchísimos contratos.",
    "F14": "El valor del contrato es una cifra exacta y grande.",
}


def backtest_block(metrics: Mapping | None) -> dict:
    """The catalogue's words on how the ranking did against what became known later. metrics: of backtest.summed; without them, nothing was evaluated."""
    m = dict(metrics or {})
    auc, lift, cases = m.get("auc"), m.get("lift"), m.get("cases", [])
    real = [c for c in cases if c["confirmado_manualmente"]]
    high = sum(bool(c["cuartil_superior"]) for c in real)
    met = bool(m.get("reached"))
    if auc is None or lift is None:
        told = "AUC y lift no se pueden calcular: faltan contratos con sanción posterior o sin ella."
    else:
        told = f"AUC {auc:.4f} y lift {lift:.3f} en el decil superior sobre {m['n']} contratos, {m['n_pos']} de ellos con sanción posterior; {'cumple' if met else 'no cumple'} las metas. De {len(real)} casos conocidos con coincidencias, {high} llegan al cuartil superior de su año."
    facts = m.get("facts") or {"n_total": 0, "n_matched": 0, "match_rate_pct": None}
    return {
        "auc_roc": auc, "objetivo_auc_roc": m.get("auc_target", 0.6), "lift_top_decil": lift, "objetivo_lift_top_decil": m.get("lift_target", 1.5), "cumple_objetivos": met,
        "n_contratos_evaluados": m.get("n", 0), "n_positivos_l1_l4": m.get("n_pos", 0), **{f"precision_top_{k}pct": m.get("precision", {}).get(f"top_{k}%") for k in (1, 5, 10)},
        "casos_emblematicos": cases, "n_casos_emblematicos_total": len(cases), "n_casos_emblematicos_con_coincidencias_genuinas": len(real), "n_casos_emblematicos_en_percentil_superior": high,
        "monitor_ciudadano": {**{k: facts[k] for k in ("n_total", "n_matched", "match_rate_pct")}, "nota": "Hechos con departamento, municipio y año que coinciden con algún contrato."}, "resumen": told,
    }


def meta(p: Params, written: Mapping[str, tuple[int, int]], generated: str, metrics: Mapping | None = None, sizes: Sequence[int] = (2500, 1000, 300, 50, 500), version: str | None = None) -> dict:
    """The catalogue. written: kind -> (files, items) of what was written. sizes: of the lists of cases, recent contracts, ranked ones, a department's entities, and of a chunk."""
    top_cases, top_recent, top_ranked, top_department, chunk = sizes

    def chunks(kind: str, top: int, by: str) -> dict:
        files, items = written.get(kind, (0, 0))
        return {"top_n": top, "chunk_size": chunk, "n_chunks": files, "patron_archivo": f"{kind}/000.json, 001.json, ...: {items} contratos en {files} archivos de {chunk} como máximo, por {by}"}

    return {
        "generado_en": generated,
        "version": {"git_commit": version},
        "banderas": [{"id": k, "nombre": n, "nivel": of, "peso": w, "descripcion": DESCRIPTIONS.get(k, n)} for k, (n, of, w) in sorted(p.weights.items())],
        "niveles_riesgo": [{"id": t, "nombre": n, "min_score": least, "max_score": p.tiers[i + 1][2] if i + 1 < len(p.tiers) else None} for i, (t, n, least) in enumerate(p.tiers)],
        "formula_score": "100 x suma de pesos de las banderas disparadas / suma de pesos de las aplicables",
        "shrinkage": {"k": p.shrink_k, "min_contratos_rank": p.min_contracts},
        "backtest": backtest_block(metrics),
        "artefactos": {
            "casos_prioritarios": chunks("casos_prioritarios", top_cases, "score, luego valor"),
            "contratos_recientes": chunks("contratos_recientes", top_recent, "fecha de firma"),
            "entidades_top": {"top_n": top_ranked, "criterio": "score con contracción hacia el departamento; empates por valor total, luego NIT"},
            "proveedores_top": {"top_n": top_ranked, "criterio": "media de los scores ponderada por valor, con contracción hacia la nacional; empates por valor total, luego documento"},
            "departamentos": {"patron_archivo": "departamentos/NN.json, NN el código de dos cifras", "top_n_entidades_por_departamento": top_department},
        },
    }
