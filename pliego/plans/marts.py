"""Raw rows, all of them text, to typed facts, dimensions and labels.

A mart is a dict of DataFrames by table name; a plan takes one and returns DataFrames, so any star schema that is bound to these
columns can be used.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pliego.functions.casts import keyed, lenient_date, lenient_double, lenient_int, present, truth
from pliego.functions.text import digits, name_key, natural_person, strict_name_key, unspsc_segment
from pliego.operators.dedup import keep_latest
from pliego.operators.joins import lookup
from pliego.operators.profiles import quarantine
from pliego.params import ELECTION_WINDOWS, MINIMUM_WAGE, MODALITIES
from pliego.schemas import SCHEMAS
from pliego.sources.files import aligned

Mart = dict[str, DataFrame]

# Columns of the older platform's datasets, under the newer one's names, best candidate first.
OLD_PLATFORM: dict[str, Sequence[str]] = {
    ":id": (":id", "uid"),
    "id_contrato": ("numero_de_contrato", "numero_del_contrato", "numero_de_constancia"),
    "proceso_de_compra": ("numero_de_proceso",),
    "nit_entidad": ("nit_de_la_entidad", "nit_entidad"),
    "nombre_entidad": ("nombre_entidad", "nombre_de_la_entidad"),
    "departamento": (),
    "ciudad": ("municipio_entidad", "dpto_y_muni_contratista"),
    "modalidad_de_contratacion": ("modalidad_de_contratacion", "tipo_de_proceso", "regimen_de_contratacion"),
    "tipo_de_contrato": ("tipo_de_contrato",),
    "objeto_del_contrato": ("detalle_del_objeto_a_contratar", "objeto_del_contrato_a_la", "objeto_a_contratar"),
    "codigo_de_categoria_principal": (),
    "fecha_de_firma": ("fecha_de_firma_del_contrato",),
    "fecha_de_inicio_del_contrato": ("fecha_ini_ejec_contrato",),
    "fecha_de_fin_del_contrato": ("fecha_fin_ejec_contrato",),
    "documento_proveedor": ("identificacion_del_contratista",),
    "proveedor_adjudicado": ("nom_razon_social_contratista", "nom_raz_social_contratista"),
    "valor_del_contrato": ("cuantia_contrato",),
    "valor_pagado": (),
    "dias_adicionados": ("tiempo_adiciones_en_dias",),
    "valor_total_de_adiciones": ("valor_total_de_adiciones",),
    "valor_contrato_con_adiciones": ("valor_contrato_con_adiciones",),
    "urlproceso": ("ruta_proceso_en_secop_i",),
    "estado_contrato": ("estado_del_proceso",),
}

CONTRACT_COLUMNS = ("nombre_entidad", "tipo_de_contrato", "objeto_del_contrato", "proceso_de_compra", "urlproceso", "id_contrato")


def reference_tables(spark: SparkSession) -> Mart:
    """Modalities, minimum wages and election windows from the fixed values in params."""
    wages = spark.createDataFrame(list(MINIMUM_WAGE.items()), SCHEMAS["ref_smmlv"])
    windows = spark.createDataFrame(ELECTION_WINDOWS, "window_id string, tipo string, inicio string, fin string")
    return {
        "ref_modalidades": spark.createDataFrame(MODALITIES, SCHEMAS["ref_modalidades"]),
        "ref_smmlv": wages,
        "ref_ventanas": windows.withColumns({c: F.col(c).cast("date") for c in ("inicio", "fin")}),
    }


def geography(raw: DataFrame) -> DataFrame:
    """Departments and municipalities with their strict name keys. raw: cod_dpto, dpto, cod_mpio, nom_mpio."""
    return raw.select("cod_dpto", "dpto", "cod_mpio", F.col("nom_mpio").alias("municipio"), strict_name_key(F.col("dpto")).alias("dpto_norm"), strict_name_key(F.col("nom_mpio")).alias("mpio_norm"))


def staged(raw: DataFrame) -> DataFrame:
    """Rows with an id, of each id the one from the last part file. raw has file_name."""
    return keep_latest(raw, [":id"], "file_name").drop("file_name")


def staged_old(frames: Sequence[DataFrame]) -> DataFrame:
    """Datasets of the older platform in one shape, each id once; rows without an id stay."""
    every = aligned(frames, OLD_PLATFORM).withColumn("source", F.lit("SECOP1"))
    latest = keep_latest(every, [":id"], "fecha_de_firma", "valor_del_contrato", "id_contrato")
    return latest.unionByName(every.where(F.col("`:id`").isNull()))


def split_bad(staged_rows: DataFrame, source: str = "S1") -> tuple[DataFrame, DataFrame]:
    """(quarantine, good rows): a value or date that is there but can't be read sends a row to quarantine, the value first."""
    value, date = F.col("valor_del_contrato"), F.col("fecha_de_firma")
    rules = {"bad_valor_del_contrato": present(value) & lenient_double(value).isNull(), "bad_fecha_de_firma": present(date) & lenient_date(date).isNull()}
    bad, good = quarantine(staged_rows, rules)
    return bad.select(F.lit(source).alias("source"), F.col("`:id`").alias("row_id"), "reason", value.alias("raw_valor"), date.alias("raw_fecha")), good


def _contracts(rows: DataFrame, source: str, mart: Mart) -> DataFrame:
    """One platform's rows, typed; rows without a readable value or date are left out."""
    text = {"departamento": F.lit(""), "ciudad": F.lit("")} if source == "SECOP1" else {c: F.coalesce(c, F.lit("")) for c in ("departamento", "ciudad")}
    typed = rows.select(
        F.lit(source).alias("source"),
        F.col("`:id`").alias("row_id"),
        *CONTRACT_COLUMNS,
        digits(F.col("nit_entidad")).alias("nit_entidad_norm"),
        digits(F.col("documento_proveedor")).alias("doc_proveedor_norm"),
        F.col("proveedor_adjudicado").alias("nombre_proveedor"),
        F.col("modalidad_de_contratacion").alias("_modality"),
        (F.lit(None).cast("int") if source == "SECOP1" else unspsc_segment(F.col("codigo_de_categoria_principal"))).alias("unspsc_segmento"),
        lenient_date(F.col("fecha_de_firma")).alias("fecha_firma"),
        lenient_date(F.col("fecha_de_inicio_del_contrato")).alias("fecha_inicio"),
        lenient_date(F.col("fecha_de_fin_del_contrato")).alias("fecha_fin"),
        lenient_int(F.coalesce("dias_adicionados", F.lit("0"))).alias("dias_adicionados"),
        lenient_double(F.col("valor_del_contrato")).alias("valor_contrato"),
        lenient_double(F.col("valor_pagado")).alias("valor_pagado"),
        F.col("estado_contrato").alias("estado"),
        name_key(text["departamento"]).alias("_dpto"),
        name_key(text["ciudad"]).alias("_mpio"),
    ).where(F.col("valor_contrato").isNotNull() & F.col("fecha_firma").isNotNull())
    typed = lookup(typed, mart["ref_modalidades"], {"_modality": "raw_value"}, {"modalidad_norm": "OTRO", "es_competitiva": False, "es_abierta": False})
    if source == "SECOP1":
        none = F.lit(None).cast("string")
        return typed.withColumns({"cod_dpto": none, "cod_mpio": none})
    places = mart["divipola"].select("cod_dpto", "cod_mpio", name_key(F.col("dpto")).alias("d"), name_key(F.col("municipio")).alias("m"))
    return lookup(typed, places.dropDuplicates(["d", "m"]), {"_dpto": "d", "_mpio": "m"}, {"cod_dpto": None, "cod_mpio": None})


def contracts(good: DataFrame, old: DataFrame | None, mart: Mart) -> DataFrame:
    """fct_contrato from the good staged rows of the newer platform and, if there are any, those of the older one."""
    rows = _contracts(good, "SECOP2", mart)
    if old is not None:
        rows = rows.unionByName(_contracts(old, "SECOP1", mart))
    rows = rows.withColumns({"duracion_dias_inicial": F.datediff("fecha_fin", "fecha_inicio"), "anio": F.year("fecha_firma")})
    return rows.select(*good.sparkSession.createDataFrame([], SCHEMAS["fct_contrato"]).columns)


def processes(staged_rows: DataFrame, mart: Mart) -> DataFrame:
    """fct_proceso from the staged rows of processes."""
    c = F.col
    typed = staged_rows.select(
        "id_del_proceso",
        c("id_del_portafolio").alias("referencia"),
        "referencia_del_proceso",
        c("entidad").alias("nombre_entidad"),
        digits(c("nit_entidad")).alias("nit_entidad_norm"),
        "departamento_entidad",
        "ciudad_entidad",
        c("modalidad_de_contratacion").alias("modalidad_raw"),
        lenient_double(c("precio_base")).alias("precio_base"),
        lenient_date(c("fecha_de_publicacion_del")).alias("fecha_publicacion"),
        lenient_date(c("fecha_de_recepcion_de")).alias("fecha_recepcion_respuestas"),
        lenient_int(c("duracion")).alias("duracion"),
        "unidad_de_duracion",
        lenient_int(c("proveedores_invitados")).alias("num_invitados"),
        lenient_int(c("respuestas_al_procedimiento")).alias("num_respuestas"),
        lenient_int(c("proveedores_unicos_con")).alias("num_oferentes_unicos"),
        truth(c("adjudicado")).alias("adjudicado"),
        lenient_double(c("valor_total_adjudicacion")).alias("valor_adjudicacion"),
        "nombre_del_adjudicador",
        c("`:id`").alias("row_id"),
    )
    typed = lookup(typed, mart["ref_modalidades"], {"modalidad_raw": "raw_value"}, {"modalidad_norm": "OTRO", "es_competitiva": False})
    return typed.withColumn("anio", F.year("fecha_publicacion"))


def _dimension(fct: DataFrame, key: str, modes: dict[str, bool]) -> DataFrame:
    """key, each column's most frequent value (True: null counts too), n_contratos and valor_total, from one pass over the facts.

    Values are counted by (key, column, value) before any key's rows meet, and before that together, as they seldom vary within a key.
    Ties go to the smaller value, null after all others.
    """
    alike = fct.where(keyed(F.col(key))).groupBy(key, *modes).agg(F.count("*").alias("_n"), F.sum("valor_contrato").alias("_v"))
    columns = F.array(*[F.struct(F.lit(i).alias("which"), F.col(c).alias("value")) for i, c in enumerate(modes)])
    tall = alike.select(key, "_n", "_v", F.explode(columns).alias("_x")).select(key, "_n", "_v", "_x.*")
    counted = tall.groupBy(key, "which", "value").agg(F.sum("_n").alias("_n"), F.sum("_v").alias("_v"))
    first = F.struct((-F.col("_n")).alias("n"), F.col("value").isNull().alias("null"), "value")
    best = [F.min(F.when((F.col("which") == i) & (F.lit(nulls) | F.col("value").isNotNull()), first))["value"].alias(c) for i, (c, nulls) in enumerate(modes.items())]
    once = F.col("which") == 0
    return counted.groupBy(key).agg(*best, F.sum(F.when(once, F.col("_n"))).alias("n_contratos"), F.sum(F.when(once, F.col("_v"))).alias("valor_total"))


def entities(fct: DataFrame) -> DataFrame:
    found = _dimension(fct, "nit_entidad_norm", {"nombre_entidad": True, "cod_dpto": False, "cod_mpio": False})
    return found.select("nit_entidad_norm", "nombre_entidad", "cod_dpto", "cod_mpio", "n_contratos", "valor_total")


def suppliers(fct: DataFrame) -> DataFrame:
    found = _dimension(fct, "doc_proveedor_norm", {"nombre_proveedor": True})
    return found.select("doc_proveedor_norm", "nombre_proveedor", natural_person(F.col("doc_proveedor_norm")).alias("es_persona_natural"), "n_contratos", "valor_total")


def sanctions(cgr: DataFrame, fines_old: DataFrame, fines_new: DataFrame, siri: DataFrame) -> DataFrame:
    """Four sources of sanctions in one table, by document."""
    some = lambda c: F.coalesce(F.col(c), F.lit(""))

    def rows(df: DataFrame, document: str, name: Column, source: str, date: Column, detail: Column) -> DataFrame:
        return df.select(digits(F.col(document)).alias("doc_norm"), name.alias("nombre"), F.lit(source).alias("fuente"), lenient_date(date).alias("fecha_sancion"), detail.alias("detalle"))

    parts = [
        rows(cgr, "n_mero_de_identificaci_n", F.col("raz_n_social_de_la_entidad"), "CGR", F.col("fecha_de_resoluci_n_de_la"), F.coalesce("descripci_n_o_detalle_resumen", "tipo_de_sanci_n_multa")),
        rows(
            fines_old, "documento_contratista", F.col("nombre_contratista"), "MULTA_SECOP1", F.coalesce("fecha_de_firmeza", "fecha_de_publicacion"),
            F.concat(F.lit("Contrato: "), some("numero_de_contrato"), F.lit(" | Resolución: "), some("numero_de_resolucion"))
        ),
        rows(fines_new, "as_codigo_proveedor_objeto", F.col("nombre_proveedor_objeto_de"), "MULTA_SECOP2", F.col("fecha_evento"), F.concat(some("tipo_de_sancion"), F.lit(" | "), some("descripcion_otro_tipo_de"))),
        rows(
            siri, "numero_identificacion", F.concat_ws(" ", *[some(c) for c in ("primer_nombre", "segundo_nombre", "primer_apellido", "segundo_apellido")]), "SIRI",
            F.col("fecha_efectos_juridicos"), F.concat(some("tipo_inhabilidad"), F.lit(" | "), some("sanciones"))
        ),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def build(spark: SparkSession, raw: dict[str, DataFrame], old: Sequence[DataFrame] = (), references: Mart | None = None) -> Mart:
    """A whole mart. raw: s1 and s2 (with file_name), divipola, and l1 to l4 for sanctions; facts of the press if there are any."""
    mart: Mart = dict(references or reference_tables(spark))
    mart["divipola"] = geography(raw["divipola"])
    mart["quarantine"], good = split_bad(staged(raw["s1"]))
    mart["stg_s2"] = staged(raw["s2"])
    if old:
        mart["stg_secop1"] = staged_old(old)
    mart["fct_contrato"] = contracts(good, mart.get("stg_secop1"), mart)
    mart["fct_proceso"] = processes(mart["stg_s2"], mart)
    mart["dim_entidad"], mart["dim_proveedor"] = entities(mart["fct_contrato"]), suppliers(mart["fct_contrato"])
    mart["sanciones"] = sanctions(*[raw[k] for k in ("l1", "l2", "l3", "l4")])
    mart["monitor_ciudadano_hechos"] = raw.get("facts", spark.createDataFrame([], SCHEMAS["monitor_ciudadano_hechos"]))
    return mart


def saved(mart: Mart, path: str) -> Mart:
    """The mart's tables as Parquet below path, in place of what was there, and read again."""
    out = {}
    for name, df in mart.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        out[name] = df.sparkSession.read.schema(df.schema).parquet(f"{path}/{name}")
    return out


def opened(spark: SparkSession, path: str, tables: Sequence[str]) -> Mart:
    return {t: spark.read.parquet(f"{path}/{t}") for t in tables}
