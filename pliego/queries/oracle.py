"""The mart, its flags and its scores over the test tables, said again in SQL for a second engine."""

from __future__ import annotations

from pliego.params import FLAGS, TIERS
from pliego.queries.registry import with_tables
from pliego.testdata import MODALITY, PARAMS, WINDOWS

_modality = "CASE o_orderpriority " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in MODALITY.items()) + " ELSE 'MINIMA_CUANTIA' END"
_name = lambda c: f"upper(regexp_replace(translate(trim(coalesce({c}, '')), 'áéíóúüñÁÉÍÓÚÜÑ', 'aeiouunAEIOUUN'), '[^A-Za-z0-9 ,.]', '', 'g'))"
_tier = lambda c: "CASE " + " ".join(f"WHEN {c} >= {least} THEN '{t}'" for t, _, least in reversed(TIERS)) + " END"
_weights = lambda level: "(VALUES " + ", ".join(f"('{k}', {w})" for k, (_, of, w) in FLAGS.items() if of == level) + ") AS w(flag_id, peso)"
_shrunk = lambda own, group, n: f"coalesce({n} / ({n} + 10.0) * {own} + (1 - {n} / ({n} + 10.0)) * {group}, {own}, {group})"
_wmean = lambda v, w: f"CASE WHEN sum(coalesce({w}, 0)) FILTER (WHERE {v} IS NOT NULL) > 0 THEN sum(coalesce({w}, 0) * {v}) / sum(coalesce({w}, 0)) FILTER (WHERE {v} IS NOT NULL) ELSE avg({v}) END"


def splitting(entity: str, contracts: str) -> str:
    return f"""
SELECT id_contrato AS key, n >= 3 AND total > {PARAMS.split_wages}::DOUBLE * value_cop AS fired, nit_entidad_norm, doc_proveedor_norm, unspsc_segmento, fecha_firma, n AS n_contratos_ventana, total AS suma_valor_ventana, {PARAMS.split_wages}::DOUBLE * value_cop AS umbral_smmlv_cop
FROM (SELECT *, count(*) OVER w AS n, sum(valor_contrato) OVER w AS total FROM (SELECT * REPLACE ({entity} AS nit_entidad_norm) FROM {contracts})
  WHERE modalidad_norm = 'CONTRATACION_DIRECTA' AND nit_entidad_norm <> '' AND doc_proveedor_norm <> '' AND unspsc_segmento IS NOT NULL AND fecha_firma IS NOT NULL AND valor_contrato IS NOT NULL
  WINDOW w AS (PARTITION BY nit_entidad_norm, doc_proveedor_norm, unspsc_segmento ORDER BY fecha_firma RANGE BETWEEN INTERVAL 90 DAYS PRECEDING AND INTERVAL 90 DAYS FOLLOWING)) c
JOIN ref_smmlv s ON c.anio = s.year"""


def rotation(contracts: str, days: int) -> str:
    return f"""
SELECT b.id_contrato AS key, n >= 8 AND winners BETWEEN 2 AND 4 AND least >= 0.15 AND alternation >= 0.6 AS fired, b.nit_entidad_norm, b.unspsc_segmento, b.bucket AS bucket_24m, b.doc_proveedor_norm, n AS n_procesos_grupo, winners AS n_ganadores_distintos,
  least AS participacion_minima_ganador, alternation AS indice_alternancia
FROM (SELECT *, CAST(floor((fecha_firma - min(fecha_firma) OVER (PARTITION BY nit_entidad_norm, unspsc_segmento)) / {days}.0) AS INTEGER) AS bucket FROM {contracts}
  WHERE es_competitiva AND nit_entidad_norm <> '' AND doc_proveedor_norm <> '' AND unspsc_segmento IS NOT NULL AND fecha_firma IS NOT NULL) b
JOIN (SELECT nit_entidad_norm, unspsc_segmento, bucket, CAST(sum(n) AS BIGINT) AS n, count(*) AS winners, min(n) / sum(n) AS least, CASE WHEN sum(n) > 1 THEN sum(moves) / (sum(n) - 1) ELSE 0 END AS alternation
  FROM (SELECT nit_entidad_norm, unspsc_segmento, bucket, doc_proveedor_norm, count(*) AS n, sum(CASE WHEN doc_proveedor_norm <> before THEN 1 ELSE 0 END) AS moves
    FROM (SELECT *, lag(doc_proveedor_norm) OVER (PARTITION BY nit_entidad_norm, unspsc_segmento, bucket ORDER BY fecha_firma, id_contrato, doc_proveedor_norm) AS before
      FROM (SELECT *, CAST(floor((fecha_firma - min(fecha_firma) OVER (PARTITION BY nit_entidad_norm, unspsc_segmento)) / {days}.0) AS INTEGER) AS bucket FROM {contracts}
        WHERE es_competitiva AND nit_entidad_norm <> '' AND doc_proveedor_norm <> '' AND unspsc_segmento IS NOT NULL AND fecha_firma IS NOT NULL))
    GROUP BY ALL) GROUP BY ALL) g USING (nit_entidad_norm, unspsc_segmento, bucket)"""


def vague(contracts: str) -> str:
    return f"""
SELECT id_contrato AS key, n < 40 OR often >= border AS fired, n AS longitud_objeto, often AS frecuencia_objeto, border AS umbral_decil_superior, n < 40 AS objeto_muy_corto, often >= border AS objeto_repetitivo
FROM (SELECT *, (SELECT percentile_cont(0.9) WITHIN GROUP (ORDER BY often) FROM (SELECT count(*) OVER (PARTITION BY object) AS often FROM (SELECT upper(trim(regexp_replace(objeto_del_contrato, '\\s+', ' ', 'g'))) AS object FROM {contracts} WHERE objeto_del_contrato IS NOT NULL))) AS border
  FROM (SELECT id_contrato, CAST(length(trim(objeto_del_contrato)) AS INTEGER) AS n, count(*) OVER (PARTITION BY upper(trim(regexp_replace(objeto_del_contrato, '\\s+', ' ', 'g')))) AS often FROM {contracts} WHERE objeto_del_contrato IS NOT NULL))"""


TABLES = {
    "fct_contrato": f"""
SELECT CASE WHEN l_linenumber = 7 THEN 'SECOP1' ELSE 'SECOP2' END AS source, concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_shipdate AS DATE)) AS row_id, concat_ws('-', l_orderkey, l_linenumber) AS id_contrato,
  CAST(l_orderkey AS VARCHAR) AS proceso_de_compra, CAST(o_custkey AS VARCHAR) AS nit_entidad_norm, c_name AS nombre_entidad, CASE WHEN l_suppkey % 37 = 0 THEN '' ELSE CAST(l_suppkey AS VARCHAR) END AS doc_proveedor_norm,
  'Supplier ' || l_suppkey AS nombre_proveedor, CAST(c_nationkey AS VARCHAR) AS cod_dpto, c_mktsegment AS cod_mpio, {_modality} AS modalidad_norm,
  {_modality} IN ('LICITACION_PUBLICA', 'SELECCION_ABREVIADA', 'CONCURSO_MERITOS') AS es_competitiva, {_modality} <> 'CONTRATACION_DIRECTA' AS es_abierta, l_returnflag AS tipo_de_contrato,
  concat_ws('  ', p_name, p_type, p_brand, 'suministro para la entidad') AS objeto_del_contrato, CAST(p_size % 10 AS INTEGER) AS unspsc_segmento, CAST(l_shipdate AS DATE) AS fecha_firma, CAST(o_orderdate AS DATE) AS fecha_inicio,
  CAST(l_shipdate AS DATE) AS fecha_fin, CAST(CAST(l_shipdate AS DATE) - CAST(o_orderdate AS DATE) AS INTEGER) AS duracion_dias_inicial, CAST(floor(l_quantity) AS INTEGER) AS dias_adicionados, l_extendedprice AS valor_contrato,
  l_extendedprice * (1 - l_discount) AS valor_pagado, CAST(year(l_shipdate) AS INTEGER) AS anio, CAST(NULL AS VARCHAR) AS urlproceso, l_linestatus AS estado
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey""",
    "fct_proceso": f"""
SELECT CAST(o_orderkey AS VARCHAR) AS referencia, concat_ws('|', o_orderkey, o_custkey, copy) AS row_id, CAST(o_orderdate AS DATE) - 5 * copy AS fecha_publicacion, CAST(o_orderdate AS DATE) - 5 * copy + CAST(o_orderkey % 40 - 3 AS INTEGER) AS fecha_recepcion_respuestas,
  CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_orderkey % 7 + copy AS INTEGER) END AS num_oferentes_unicos, CAST(o_orderkey % 9 AS INTEGER) AS num_respuestas, o_totalprice * 0.3::DOUBLE AS precio_base, o_totalprice * 0.5::DOUBLE AS valor_adjudicacion, {_modality} AS modalidad_norm
FROM orders JOIN (VALUES (0), (1)) AS t(copy) ON copy = 0 OR o_orderkey % 3 = 0""",
    "stg_secop1": "SELECT row_id, CAST(dias_adicionados * 1000 AS VARCHAR) AS valor_total_de_adiciones FROM fct_contrato WHERE source = 'SECOP1'",
    "proceso_dedup": "SELECT * FROM fct_proceso QUALIFY row_number() OVER (PARTITION BY referencia ORDER BY fecha_publicacion DESC NULLS LAST, row_id DESC) = 1",
    "contrato_proceso": "SELECT c.*, p.* EXCLUDE (row_id, modalidad_norm) FROM fct_contrato c JOIN proceso_dedup p ON c.proceso_de_compra = p.referencia",
    "dim_entidad": "SELECT nit_entidad_norm, min(nombre_entidad) AS nombre_entidad, min(cod_dpto) AS cod_dpto, min(cod_mpio) AS cod_mpio, count(*) AS n_contratos, sum(valor_contrato) AS valor_total FROM fct_contrato WHERE nit_entidad_norm <> '' GROUP BY 1",
    "dim_proveedor": """
SELECT doc_proveedor_norm, min(nombre_proveedor) AS nombre_proveedor, CASE WHEN length(doc_proveedor_norm) <= 8 THEN true END AS es_persona_natural, count(*) AS n_contratos, sum(valor_contrato) AS valor_total, DATE '1994-12-01' + CAST(doc_proveedor_norm AS INTEGER) * 23 AS fecha_matricula
FROM fct_contrato WHERE doc_proveedor_norm <> '' GROUP BY 1""",
    "sanciones": "SELECT CAST(user_id * 20 + event_id % 20 AS VARCHAR) AS doc_norm, ['CGR', 'MULTA_SECOP1', 'MULTA_SECOP2', 'SIRI'][user_id % 4 + 1] AS fuente, DATE '1995-01-01' + CAST(event_id * 37 % 2400 AS INTEGER) AS fecha_sancion FROM events WHERE event_type = 'error'",
    "divipola": f"SELECT DISTINCT CAST(c_nationkey AS VARCHAR) AS cod_dpto, n_name AS dpto, c_mktsegment AS cod_mpio, c_mktsegment AS municipio, {_name('n_name')} AS dpto_norm, {_name('c_mktsegment')} AS mpio_norm FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "ref_smmlv": "SELECT CAST(y AS INTEGER) AS year, CAST(1000 AS BIGINT) AS value_cop FROM range(1990, 2006) AS t(y)",
    "ref_ventanas": "SELECT window_id, tipo, CAST(inicio AS DATE) AS inicio, CAST(fin AS DATE) AS fin FROM (VALUES " + ", ".join(str(w) for w in WINDOWS) + ") AS t(window_id, tipo, inicio, fin)",
    "hechos": "SELECT CASE WHEN event_id % 5 <> 0 THEN 'nation_' || event_id % 25 END AS departamento, ['building', 'automobile', 'household', 'unknown'][event_id % 4 + 1] AS municipio, CAST(1990 + event_id % 12 AS INTEGER) AS anio FROM events WHERE event_type = 'error'",
    "f01": "SELECT id_contrato AS key, num_oferentes_unicos = 1 AS fired, num_oferentes_unicos, num_respuestas FROM contrato_proceso WHERE es_competitiva AND num_oferentes_unicos IS NOT NULL",
    "f02": "SELECT id_contrato AS key, fecha_publicacion - fecha_matricula BETWEEN 0 AND 90 AS fired, CAST(fecha_publicacion - fecha_matricula AS INTEGER) AS dias_desde_matricula, fecha_matricula, fecha_publicacion FROM contrato_proceso JOIN dim_proveedor USING (doc_proveedor_norm)",
    "f03": """
SELECT id_contrato AS key, coalesce(by_time AND dias_adicionados >= 0.5 * duracion_dias_inicial, false) OR coalesce(money >= 0.4, false) AS fired, source, dias_adicionados, duracion_dias_inicial,
  coalesce(by_time AND dias_adicionados >= 0.5 * duracion_dias_inicial, false) AS f03_tiempo, money AS ratio_adicion_dinero, coalesce(money >= 0.4, false) AS f03_dinero, CASE WHEN by_award THEN 'secop2_join' WHEN by_sum THEN 'secop1_directo' END AS fuente_dinero
FROM (SELECT *, CASE WHEN by_award THEN valor_contrato / valor_adjudicacion - 1 WHEN by_sum THEN added / valor_contrato END AS money
  FROM (SELECT c.*, p.valor_adjudicacion, TRY_CAST(s.valor_total_de_adiciones AS DOUBLE) AS added, coalesce(duracion_dias_inicial > 0, false) AS by_time, coalesce(c.source = 'SECOP2' AND p.valor_adjudicacion > 0, false) AS by_award,
      coalesce(c.source = 'SECOP1' AND s.valor_total_de_adiciones IS NOT NULL AND valor_contrato > 0, false) AS by_sum
    FROM fct_contrato c LEFT JOIN proceso_dedup p ON c.source = 'SECOP2' AND c.proceso_de_compra = p.referencia LEFT JOIN stg_secop1 s ON c.source = 'SECOP1' AND c.row_id = s.row_id))
WHERE by_time OR by_award OR by_sum""",
    "f04": """
SELECT nit_entidad_norm AS key, z_score >= 2 AS fired, nombre_entidad, cod_dpto, share_directa, mean_share_peers, sd_share_peers, n_peers, n_contratos, z_score
FROM (SELECT *, (share_directa - mean_share_peers) / nullif(sd_share_peers, 0) AS z_score
  FROM (SELECT *, avg(share_directa) OVER w AS mean_share_peers, stddev_pop(share_directa) OVER w AS sd_share_peers, count(*) OVER w AS n_peers
    FROM (SELECT d.nit_entidad_norm, d.nombre_entidad, d.cod_dpto, count(*) AS n_contratos, coalesce(sum(valor_contrato) FILTER (WHERE modalidad_norm = 'CONTRATACION_DIRECTA'), 0) / nullif(sum(valor_contrato), 0) AS share_directa
      FROM fct_contrato c JOIN dim_entidad d USING (nit_entidad_norm) WHERE valor_contrato IS NOT NULL GROUP BY ALL HAVING count(*) >= 5)
    WINDOW w AS (PARTITION BY cod_dpto)) WHERE n_peers >= 5)
WHERE z_score IS NOT NULL""",
    "f05": splitting("nit_entidad_norm", "fct_contrato"),
    "f06": rotation("fct_contrato", 730),
    "f07": """
SELECT id_contrato AS key, d < floor_days AS fired, modalidad_norm, d AS dias_ventana, floor_days AS piso_dias
FROM (SELECT *, CAST(fecha_recepcion_respuestas - fecha_publicacion AS INTEGER) AS d, CASE modalidad_norm WHEN 'LICITACION_PUBLICA' THEN 10 WHEN 'SELECCION_ABREVIADA' THEN 5 END AS floor_days FROM contrato_proceso)
WHERE es_competitiva AND floor_days IS NOT NULL AND d >= 0""",
    "f08": f"SELECT id_contrato AS key, abs(valor_contrato / precio_base - 1) <= {PARAMS.price_tolerance} AS fired, valor_contrato, precio_base, abs(valor_contrato / precio_base - 1) AS desviacion_pct FROM contrato_proceso WHERE es_competitiva AND precio_base > 0 AND valor_contrato IS NOT NULL",
    "f09": "SELECT id_contrato AS key, month(fecha_firma) = 12 AND day(fecha_firma) >= 15 AS fired, fecha_firma FROM fct_contrato WHERE fecha_firma IS NOT NULL",
    "f10": "SELECT id_contrato AS key, window_id IS NOT NULL AS fired, fecha_firma, window_id, tipo AS tipo_ventana FROM fct_contrato LEFT JOIN ref_ventanas ON fecha_firma BETWEEN inicio AND fin WHERE modalidad_norm = 'CONTRATACION_DIRECTA' AND fecha_firma IS NOT NULL",
    "f11": """
SELECT id_contrato AS key, count(*) FILTER (WHERE fecha_sancion < fecha_firma) > 0 AS fired, count(*) FILTER (WHERE fecha_sancion < fecha_firma) AS n_sanciones_antes_firma, count(fecha_sancion) AS n_sanciones_total_contexto,
  string_agg(DISTINCT fuente, ', ' ORDER BY fuente) FILTER (WHERE fecha_sancion < fecha_firma) AS fuentes_antes_firma, string_agg(DISTINCT fuente, ', ' ORDER BY fuente) AS fuentes_total_contexto, max(fecha_sancion) FILTER (WHERE fecha_sancion < fecha_firma) AS sancion_mas_reciente_antes_firma
FROM fct_contrato LEFT JOIN sanciones ON doc_norm = doc_proveedor_norm WHERE doc_proveedor_norm <> '' GROUP BY row_id, id_contrato""",
    "f12": """
SELECT nit_entidad_norm AS key, share > 0.5 OR (dependence > 0.8 AND n_supplier >= 5) AS fired, anio, doc_proveedor_norm AS doc_proveedor_dominante, n_entity AS n_contratos_entidad_anual, share AS participacion_proveedor_en_entidad, share > 0.5 AS condicion_a_captura_entidad,
  n_supplier AS n_contratos_proveedor_anual, dependence AS dependencia_proveedor_en_entidad, dependence > 0.8 AND n_supplier >= 5 AS condicion_b_dependencia_proveedor
FROM (SELECT *, pair / nullif(entity, 0) AS share, pair / nullif(supplier, 0) AS dependence
  FROM (SELECT nit_entidad_norm, doc_proveedor_norm, anio, sum(valor_contrato) AS pair FROM fct_contrato WHERE doc_proveedor_norm <> '' GROUP BY ALL)
  JOIN (SELECT nit_entidad_norm, anio, sum(valor_contrato) AS entity, count(*) AS n_entity FROM fct_contrato GROUP BY ALL HAVING count(*) >= 5) USING (nit_entidad_norm, anio)
  JOIN (SELECT doc_proveedor_norm, anio, sum(valor_contrato) AS supplier, count(*) AS n_supplier FROM fct_contrato WHERE doc_proveedor_norm <> '' GROUP BY ALL) USING (doc_proveedor_norm, anio)
  QUALIFY row_number() OVER (PARTITION BY nit_entidad_norm, anio ORDER BY pair DESC, doc_proveedor_norm) = 1)""",
    "f13": vague("fct_contrato"),
    "f14": f"SELECT id_contrato AS key, valor_contrato >= {PARAMS.round_min} AND CAST(round_even(valor_contrato, 0) AS BIGINT) % {PARAMS.round_unit} = 0 AS fired, valor_contrato FROM fct_contrato WHERE valor_contrato IS NOT NULL",
    "flag_contrato": " UNION ALL ".join(f"SELECT key, '{f}' AS flag_id, fired FROM {f.lower()}" for f, (_, of, _) in FLAGS.items() if of == "contract"),
    "flag_entidad": " UNION ALL ".join(f"SELECT key, '{f}' AS flag_id, fired FROM {f.lower()}" for f, (_, of, _) in FLAGS.items() if of == "entity"),
    "contract_flags": f"SELECT key, count(*) AS aplicables, count(*) FILTER (WHERE fired) AS disparados, coalesce(sum(peso) FILTER (WHERE fired), 0) * 100.0 / sum(peso) AS score FROM (SELECT key, flag_id, bool_or(fired) AS fired FROM flag_contrato GROUP BY ALL) JOIN {_weights('contract')} USING (flag_id) GROUP BY key",
    "entity_flags": f"SELECT key, count(*) AS aplicables, count(*) FILTER (WHERE fired) AS disparados, coalesce(sum(peso) FILTER (WHERE fired), 0) * 100.0 / sum(peso) AS score FROM (SELECT key, flag_id, bool_or(fired) AS fired FROM flag_entidad GROUP BY ALL) JOIN {_weights('entity')} USING (flag_id) GROUP BY key",
    "contrato_dedup": "SELECT * FROM fct_contrato QUALIFY row_number() OVER (PARTITION BY id_contrato ORDER BY fecha_firma DESC NULLS LAST, row_id DESC NULLS LAST) = 1",
    "contrato_score": f"""
SELECT id_contrato, nit_entidad_norm, nombre_entidad, doc_proveedor_norm, nombre_proveedor, cod_dpto, cod_mpio, valor_contrato, fecha_firma, anio, source, modalidad_norm, coalesce(aplicables, 0) AS n_flags_aplicables, coalesce(disparados, 0) AS n_flags_disparados, CAST(score AS DOUBLE) AS score, {_tier("score")} AS tier
FROM contrato_dedup LEFT JOIN contract_flags ON key = id_contrato""",
    "combined_entities": f"""
SELECT d.nit_entidad_norm, d.cod_dpto, d.n_contratos, d.valor_total, coalesce(f.aplicables, 0) AS n_flags_aplicables, coalesce(f.disparados, 0) AS n_flags_disparados, c.component AS contract_component, CAST(f.score AS DOUBLE) AS entity_component,
  coalesce((119 * c.component + 16 * f.score) / 135, c.component, f.score) AS combined_raw_score
FROM dim_entidad d LEFT JOIN (SELECT nit_entidad_norm, {_wmean("score", "valor_contrato")} AS component FROM contrato_score WHERE score IS NOT NULL GROUP BY 1) c USING (nit_entidad_norm) LEFT JOIN entity_flags f ON f.key = d.nit_entidad_norm""",
    "entidad_score": f"""
SELECT *, {_tier("score")} AS tier FROM (SELECT *, {_shrunk("combined_raw_score", "dept_mean_score", "n_contratos")} AS score, n_contratos < 10 AS datos_insuficientes
FROM (SELECT e.*, coalesce(g.m, (SELECT {_wmean("combined_raw_score", "valor_total")} FROM combined_entities)) AS dept_mean_score
  FROM combined_entities e LEFT JOIN (SELECT cod_dpto, {_wmean("combined_raw_score", "valor_total")} AS m FROM combined_entities GROUP BY 1) g ON e.cod_dpto IS NOT DISTINCT FROM g.cod_dpto))""",
    "municipio_score": f"""
SELECT *, {_tier("score")} AS tier FROM (SELECT *, {_shrunk("raw_score", "dept_mean_score", "n_contratos")} AS score, n_contratos < 10 AS datos_insuficientes
FROM (SELECT cod_dpto, cod_mpio, count(*) AS n_contratos, sum(valor_contrato) AS valor_total, {_wmean("score", "valor_contrato")} AS raw_score FROM contrato_score WHERE score IS NOT NULL GROUP BY ALL)
JOIN (SELECT cod_dpto, {_wmean("score", "valor_contrato")} AS dept_mean_score FROM contrato_score WHERE score IS NOT NULL GROUP BY 1) USING (cod_dpto))""",
    "proveedor_score": f"""
SELECT *, {_tier("score")} AS tier FROM (SELECT *, {_shrunk("own", "(SELECT " + _wmean("score", "valor_contrato") + " FROM contrato_score WHERE doc_proveedor_norm <> '')", "n_contratos")} AS score, n_contratos < 10 AS datos_insuficientes
FROM dim_proveedor JOIN (SELECT doc_proveedor_norm, {_wmean("score", "valor_contrato")} AS own FROM contrato_score WHERE doc_proveedor_norm <> '' AND score IS NOT NULL GROUP BY 1) USING (doc_proveedor_norm))""",
    "etiquetas": """
SELECT id_contrato, score, coalesce(a.d > fecha_firma, false) OR coalesce(b.d > fecha_firma, false) AS is_positive FROM contrato_score LEFT JOIN (SELECT doc_norm, max(fecha_sancion) AS d FROM sanciones GROUP BY 1) a ON a.doc_norm = doc_proveedor_norm
LEFT JOIN (SELECT doc_norm, max(fecha_sancion) AS d FROM sanciones GROUP BY 1) b ON b.doc_norm = nit_entidad_norm WHERE score IS NOT NULL AND fecha_firma IS NOT NULL""",
}


def sql(body: str) -> str:
    return with_tables(body, TABLES)
