"""A mart built from raw rows, table by table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pliego import rawdata
from pliego.params import MODALITIES
from pliego.queries.oracle import _name
from pliego.queries.registry import query, rounded, with_tables

_raw_modality = "CASE o_orderpriority " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in rawdata.MODALITIES.items()) + " ELSE 'Otra cosa' END"
_digits = lambda c: f"regexp_replace(coalesce({c}, ''), '[^0-9]', '', 'g')"
_strict = lambda c: f"upper(regexp_replace(translate({c}, 'ÁÉÍÓÚÜÑ', 'AEIOUUN'), '[^A-Z0-9 ,.]', '', 'g'))"
_values = ", ".join(f"('{raw}', '{name}', {competitive}, {is_open})" for raw, name, competitive, is_open in MODALITIES)

RAW = {
    "modalities": f"SELECT * FROM (VALUES {_values}) AS t(raw_value, modalidad_norm, es_competitiva, es_abierta)",
    "places": f"SELECT CAST(n_nationkey AS VARCHAR) AS cod_dpto, n_name AS dpto, CAST(n_nationkey * 1000 + k AS VARCHAR) AS cod_mpio, 'CIUDAD ' || k AS municipio, {_strict('n_name')} AS dpto_norm, {_strict(chr(39) + 'CIUDAD ' + chr(39) + ' || k')} AS mpio_norm FROM nation, range(4) AS r(k)",
    "lines": f"""
SELECT *, CASE WHEN l_linenumber % 3 = 0 THEN 'Secretaría de Salud ' ELSE 'SECRETARIA DE SALUD ' END || o_custkey AS entidad, CASE WHEN l_suppkey % 7 = 0 THEN '' ELSE CAST(l_suppkey AS VARCHAR) END AS documento,
  CASE WHEN l_linenumber % 2 = 0 THEN 'Proveedor ' || l_suppkey ELSE 'PROVEEDOR ' || l_suppkey || ' SAS' END AS proveedor, {_raw_modality} AS modalidad, l_partkey % 40 = 3 AS bad_date, CASE WHEN l_partkey % 40 NOT IN (3, 4) THEN CAST(l_shipdate AS DATE) END AS firma,
  CASE WHEN l_partkey % 30 <> 1 THEN CAST(l_shipdate AS DATE) + 30 END AS fin, CASE WHEN l_partkey % 9 <> 0 THEN CAST(round(CAST(l_quantity AS INTEGER) * 5 / 2.0) AS INTEGER) ELSE 0 END AS dias, l_partkey % 50 IN (0, 2) AS bad_value, CASE WHEN l_partkey % 50 > 2 THEN CAST(l_quantity AS INTEGER) * 1000.0::DOUBLE END AS valor,
  CASE l_partkey % 50 WHEN 0 THEN 'INVALID' WHEN 1 THEN '' WHEN 2 THEN '5d' ELSE CAST(CAST(l_quantity AS INTEGER) * 1000 AS VARCHAR) END AS valor_text, CASE l_partkey % 40 WHEN 3 THEN 'NOT-A-DATE' WHEN 4 THEN NULL ELSE strftime(l_shipdate, '%Y-%m-%dT00:00:00.000') END AS firma_text,
  concat_ws('-', 'part', l_linenumber, lpad(CAST(l_partkey AS VARCHAR), 9, '0'), lpad(CAST(l_suppkey AS VARCHAR), 9, '0'), strftime(l_shipdate, '%Y%m%d')) AS file_name
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "staged_new": "SELECT *, concat_ws('-', l_orderkey, l_linenumber % 5) AS id FROM lines WHERE l_linenumber <> 7 QUALIFY row_number() OVER (PARTITION BY concat_ws('-', l_orderkey, l_linenumber % 5) ORDER BY file_name DESC) = 1",
    "staged_older": "SELECT *, 'OLD-' || l_orderkey AS id FROM lines WHERE l_linenumber = 7 QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY firma_text DESC NULLS LAST, valor_text DESC, concat_ws('-', l_orderkey, l_partkey, l_suppkey) DESC) = 1",
    "raw_contracts": """
SELECT 'SECOP2' AS source, *, 'CO1.' || l_orderkey || '.' || l_linenumber AS id_contrato, 'Nation_' || (o_custkey % 25) AS departamento, 'Ciudad ' || (o_custkey % 5) AS ciudad, CAST(l_partkey % 80 + 10 AS INTEGER) AS segmento FROM staged_new WHERE NOT bad_value AND NOT bad_date
UNION ALL SELECT 'SECOP1', *, concat_ws('-', l_orderkey, l_partkey, l_suppkey), NULL, NULL, NULL FROM staged_older""",
    "built": f"""
SELECT source, id AS row_id, id_contrato, CAST(l_orderkey AS VARCHAR) AS proceso_de_compra, CAST(o_custkey AS VARCHAR) AS nit_entidad_norm, entidad AS nombre_entidad, documento AS doc_proveedor_norm, proveedor AS nombre_proveedor, p.cod_dpto, p.cod_mpio, coalesce(modalidad_norm, 'OTRO') AS modalidad_norm,
  coalesce(es_competitiva, false) AS es_competitiva, coalesce(es_abierta, false) AS es_abierta, l_returnflag AS tipo_de_contrato, 'Objeto ' || l_partkey AS objeto_del_contrato, segmento AS unspsc_segmento, firma AS fecha_firma, CAST(o_orderdate AS DATE) AS fecha_inicio, fin AS fecha_fin,
  CAST(fin - CAST(o_orderdate AS DATE) AS INTEGER) AS duracion_dias_inicial, dias AS dias_adicionados, valor AS valor_contrato, CAST(NULL AS DOUBLE) AS valor_pagado, CAST(year(firma) AS INTEGER) AS anio, 'https://x/' || l_orderkey AS urlproceso, l_linestatus AS estado
FROM raw_contracts LEFT JOIN modalities ON modalidad = raw_value LEFT JOIN places p ON {_name('departamento')} = {_name('p.dpto')} AND {_name('ciudad')} = {_name('p.municipio')}
WHERE valor IS NOT NULL AND firma IS NOT NULL""",
}


def _sql(body: str) -> str:
    return with_tables(body, RAW)


@query(_sql("SELECT * FROM built"))
def mart_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rawdata.mart(spark, sf_dir)["fct_contrato"]


@query(_sql("SELECT 'S1' AS source, id AS row_id, CASE WHEN bad_value THEN 'bad_valor_del_contrato' ELSE 'bad_fecha_de_firma' END AS reason, valor_text AS raw_valor, firma_text AS raw_fecha FROM staged_new WHERE bad_value OR bad_date"))
def mart_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rawdata.mart(spark, sf_dir)["quarantine"]


@query(
    _sql(f"""
SELECT 'P-' || o_orderkey AS id_del_proceso, CAST(o_orderkey AS VARCHAR) AS referencia, 'REF ' || o_orderkey AS referencia_del_proceso, 'Entidad ' || o_custkey AS nombre_entidad, CAST(o_custkey AS VARCHAR) AS nit_entidad_norm, 'Nation_' || (o_custkey % 25) AS departamento_entidad, 'Ciudad' AS ciudad_entidad,
  {_raw_modality} AS modalidad_raw, CAST(o_orderkey * 10 AS DOUBLE) AS precio_base, CAST(o_orderdate AS DATE) AS fecha_publicacion, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderdate AS DATE) END AS fecha_recepcion_respuestas, CAST(CASE WHEN o_orderkey % 4 <> 0 THEN 12 END AS INTEGER) AS duracion, 'Mes(es)' AS unidad_de_duracion,
  CAST(3 AS INTEGER) AS num_invitados, CAST(o_orderkey % 9 AS INTEGER) AS num_respuestas, CAST(o_orderkey % 7 + CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS INTEGER) AS num_oferentes_unicos, o_orderkey % 2 = 0 AS adjudicado, CAST(o_orderkey * 11 AS DOUBLE) AS valor_adjudicacion, 'Nombre' AS nombre_del_adjudicador,
  CAST(o_orderkey AS VARCHAR) AS row_id, coalesce(modalidad_norm, 'OTRO') AS modalidad_norm, coalesce(es_competitiva, false) AS es_competitiva, CAST(year(o_orderdate) AS INTEGER) AS anio
FROM orders LEFT JOIN modalities ON {_raw_modality} = raw_value""")
)
def mart_processes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each process once, as its last part has it."""
    return rawdata.mart(spark, sf_dir)["fct_proceso"]


@query("""
SELECT CAST(user_id AS VARCHAR) AS doc_norm, CASE WHEN user_id % 4 = 3 THEN 'Ana  Ruiz' || user_id || ' Gil' ELSE 'Empresa ' || user_id END AS nombre, ['CGR', 'MULTA_SECOP1', 'MULTA_SECOP2', 'SIRI'][user_id % 4 + 1] AS fuente, CASE WHEN user_id % 4 > 0 OR event_id % 6 > 0 THEN CAST(ts AS DATE) END AS fecha_sancion,
  CASE user_id % 4 WHEN 0 THEN CASE WHEN event_id % 3 = 0 THEN 'resumen' ELSE event_type END WHEN 1 THEN 'Contrato: ' || event_id || ' | Resolución: ' || CASE WHEN event_id % 2 = 0 THEN CAST(event_id AS VARCHAR) ELSE '' END
    WHEN 2 THEN event_type || ' | ' || CASE WHEN event_id % 2 = 0 THEN 'otra' ELSE '' END ELSE event_type || ' | ' || event_id END AS detalle
FROM events""")
def mart_sanctions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events, a quarter of the users through each source."""
    return rawdata.mart(spark, sf_dir)["sanciones"]


@query(_sql("SELECT * FROM places"))
def mart_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rawdata.mart(spark, sf_dir)["divipola"]


def _mode(key: str, col: str) -> str:
    return f"(SELECT {key}, {col} FROM (SELECT {key}, {col}, count(*) AS n FROM built WHERE {key} <> '' GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY n DESC, {col} NULLS LAST) = 1)"


def _mode_of_some(key: str, col: str) -> str:
    return f"(SELECT {key}, {col} FROM (SELECT {key}, {col}, count(*) AS n FROM built WHERE {key} <> '' AND {col} IS NOT NULL GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY n DESC, {col}) = 1)"


@query(
    _sql(f"""
SELECT nit_entidad_norm, nombre_entidad, cod_dpto, cod_mpio, n_contratos, round(valor_total, 2) AS valor_total FROM (SELECT nit_entidad_norm, count(*) AS n_contratos, sum(valor_contrato) AS valor_total FROM built WHERE nit_entidad_norm <> '' GROUP BY 1)
LEFT JOIN {_mode('nit_entidad_norm', 'nombre_entidad')} USING (nit_entidad_norm) LEFT JOIN {_mode_of_some('nit_entidad_norm', 'cod_dpto')} USING (nit_entidad_norm) LEFT JOIN {_mode_of_some('nit_entidad_norm', 'cod_mpio')} USING (nit_entidad_norm)""")
)
def mart_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names vary from contract to contract, so the most frequent one counts, ties by the smaller."""
    return rounded(rawdata.mart(spark, sf_dir)["dim_entidad"], "valor_total", digits=2)


@query(
    _sql(f"""
SELECT doc_proveedor_norm, nombre_proveedor, CASE WHEN length(doc_proveedor_norm) <= 8 THEN true END AS es_persona_natural, n_contratos, round(valor_total, 2) AS valor_total
FROM (SELECT doc_proveedor_norm, count(*) AS n_contratos, sum(valor_contrato) AS valor_total FROM built WHERE doc_proveedor_norm <> '' GROUP BY 1) LEFT JOIN {_mode('doc_proveedor_norm', 'nombre_proveedor')} USING (doc_proveedor_norm)""")
)
def mart_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rawdata.mart(spark, sf_dir)["dim_proveedor"], "valor_total", digits=2)
