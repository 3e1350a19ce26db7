"""Schemas of the mart's tables, as DDL text."""

from __future__ import annotations

SCHEMAS = {
    "fct_contrato": "source string, row_id string, id_contrato string, proceso_de_compra string, nit_entidad_norm string, nombre_entidad string, doc_proveedor_norm string, nombre_proveedor string, cod_dpto string, cod_mpio string, modalidad_norm string, es_competitiva boolean, es_abierta boolean, tipo_de_contrato string, objeto_del_contrato string, unspsc_segmento int, fecha_firma date, fecha_inicio date, fecha_fin date, duracion_dias_inicial int, dias_adicionados int, valor_contrato double, valor_pagado double, anio int, urlproceso string, estado string",
    "fct_proceso": "id_del_proceso string, referencia string, referencia_del_proceso string, nombre_entidad string, nit_entidad_norm string, departamento_entidad string, ciudad_entidad string, modalidad_raw string, precio_base double, fecha_publicacion date, fecha_recepcion_respuestas date, duracion int, unidad_de_duracion string, num_invitados int, num_respuestas int, num_oferentes_unicos int, adjudicado boolean, valor_adjudicacion double, nombre_del_adjudicador string, row_id string, modalidad_norm string, es_competitiva boolean, anio int",
    "dim_entidad": "nit_entidad_norm string, nombre_entidad string, cod_dpto string, cod_mpio string, n_contratos long, valor_total double",
    "dim_proveedor": "doc_proveedor_norm string, nombre_proveedor string, es_persona_natural boolean, n_contratos long, valor_total double",
    "sanciones": "doc_norm string, nombre string, fuente string, fecha_sancion date, detalle string",
    "divipola": "cod_dpto string, dpto string, cod_mpio string, municipio string, dpto_norm string, mpio_norm string",
    "monitor_ciudadano_hechos": "departamento string, municipio string, anio int, tipo_corrupcion string, sector string, descripcion string",
    "ref_modalidades": "raw_value string, modalidad_norm string, es_competitiva boolean, es_abierta boolean",
    "ref_smmlv": "year int, value_cop long",
    "ref_ventanas": "window_id string, tipo string, inicio date, fin date",
    "stg_secop1": "`:id` string, valor_total_de_adiciones string, valor_contrato_con_adiciones string",
    "quarantine": "source string, row_id string, reason string, raw_valor string, raw_fecha string",
    "flags": "key string, flag_id string, fired boolean, evidence_json string",
}
