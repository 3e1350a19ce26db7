"""The driver's tables as raw rows, all of them text: both platforms' contracts, processes, places and four sources of sanctions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pliego.plans import marts
from pliego.plans.marts import Mart
from pliego.testdata import table

MODALITIES = {"1-URGENT": "Contratación directa", "2-HIGH": "Licitación pública", "3-MEDIUM": "Selección abreviada subasta inversa", "5-LOW": "Concurso de méritos abierto"}


def _text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _modality() -> Column:
    out = F.lit("Otra cosa")
    for raw, name in MODALITIES.items():
        out = F.when(F.col("o_orderpriority") == raw, name).otherwise(out)
    return out


def file_name() -> Column:
    """A part file for each line item, so that rows of one id are told apart by it."""
    c = F.col
    return F.concat_ws("-", F.lit("part"), "l_linenumber", F.lpad(c("l_partkey").cast("string"), 9, "0"), F.lpad(c("l_suppkey").cast("string"), 9, "0"), F.date_format("l_shipdate", "yyyyMMdd"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with what their order says, and texts of which some are spoilt."""
    c = F.col
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), c("l_orderkey") == c("o_orderkey"))
    whole = c("l_quantity").cast("int")
    return rows.withColumns(
        {
            "entidad": F.when(c("l_linenumber") % 3 == 0, _text("Secretaría de Salud ", c("o_custkey"))).otherwise(_text("SECRETARIA DE SALUD ", c("o_custkey"))),
            "nit": _text("NIT ", c("o_custkey"), "."),
            "documento": F.when(c("l_suppkey") % 7 == 0, "No Definido").otherwise(_text("CC ", c("l_suppkey"))),
            "proveedor": F.when(c("l_linenumber") % 2 == 0, _text("Proveedor ", c("l_suppkey"))).otherwise(_text("PROVEEDOR ", c("l_suppkey"), " SAS")),
            "modalidad": _modality(),
            "firma": F.when(c("l_partkey") % 40 == 3, "NOT-A-DATE").when(c("l_partkey") % 40 != 4, F.date_format("l_shipdate", "yyyy-MM-dd'T'00:00:00.000")),
            "inicio": F.date_format("o_orderdate", "yyyy-MM-dd"),
            "fin": F.when(c("l_partkey") % 30 == 1, "").otherwise(F.date_format(F.date_add(c("l_shipdate").cast("date"), 30), "yyyy-MM-dd")),
            "dias": F.when(c("l_partkey") % 9 != 0, (whole * 5 / 2).cast("decimal(10,1)").cast("string")),
            "valor": F.when(c("l_partkey") % 50 == 0, "INVALID").when(c("l_partkey") % 50 == 1, "").when(c("l_partkey") % 50 == 2, "5d").otherwise((whole * 1000).cast("string")),
        }
    )


def new_platform(rows: DataFrame) -> DataFrame:
    c = F.col
    return rows.where("l_linenumber <> 7").select(
        F.concat_ws("-", "l_orderkey", c("l_linenumber") % 5).alias(":id"), _text("CO1.", c("l_orderkey"), ".", c("l_linenumber")).alias("id_contrato"), c("entidad").alias("nombre_entidad"), c("l_returnflag").alias("tipo_de_contrato"),
        _text("Objeto ", c("l_partkey")).alias("objeto_del_contrato"), c("l_orderkey").cast("string").alias("proceso_de_compra"), _text("https://x/", c("l_orderkey")).alias("urlproceso"), c("nit").alias("nit_entidad"),
        c("documento").alias("documento_proveedor"), c("proveedor").alias("proveedor_adjudicado"), c("modalidad").alias("modalidad_de_contratacion"), _text("V1.", c("l_partkey") % 80 + 10, "101600").alias("codigo_de_categoria_principal"),
        c("firma").alias("fecha_de_firma"), c("inicio").alias("fecha_de_inicio_del_contrato"), c("fin").alias("fecha_de_fin_del_contrato"), c("dias").alias("dias_adicionados"), c("valor").alias("valor_del_contrato"),
        F.lit("n/a").alias("valor_pagado"), c("l_linestatus").alias("estado_contrato"), _text("Nation_", c("o_custkey") % 25).alias("departamento"), _text("Ciudad ", c("o_custkey") % 5).alias("ciudad"), file_name().alias("file_name"),
    )


def old_platform(rows: DataFrame) -> list[DataFrame]:
    """Two datasets whose columns have different names."""
    c = F.col
    some = rows.where("l_linenumber = 7")
    names = [
        ("uid", "numero_de_contrato", "nit_de_la_entidad", "nombre_entidad", "modalidad_de_contratacion", "detalle_del_objeto_a_contratar", "nom_razon_social_contratista"),
        (":id", "numero_de_constancia", "nit_entidad", "nombre_de_la_entidad", "tipo_de_proceso", "objeto_a_contratar", "nom_raz_social_contratista"),
    ]
    values = [_text("OLD-", c("l_orderkey")), F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey"), c("nit"), c("entidad"), c("modalidad"), _text("Objeto ", c("l_partkey")), c("proveedor")]
    same = [
        c("l_orderkey").cast("string").alias("numero_de_proceso"), c("l_returnflag").alias("tipo_de_contrato"), c("firma").alias("fecha_de_firma_del_contrato"), c("inicio").alias("fecha_ini_ejec_contrato"), c("fin").alias("fecha_fin_ejec_contrato"),
        c("documento").alias("identificacion_del_contratista"), c("valor").alias("cuantia_contrato"), c("dias").alias("tiempo_adiciones_en_dias"), _text("https://x/", c("l_orderkey")).alias("ruta_proceso_en_secop_i"), c("l_linestatus").alias("estado_del_proceso"),
    ]
    return [some.where(c("l_partkey") % 2 == i).select(*[v.alias(n) for v, n in zip(values, own, strict=True)], *same) for i, own in enumerate(names)]


def raw_processes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as processes; every third twice, the second time in a later part and with more bidders."""
    c = F.col
    rows = table(spark, sf_dir, "orders").withColumn("_copy", F.explode(F.when(c("o_orderkey") % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    key = c("o_orderkey")
    return rows.select(
        key.cast("string").alias(":id"), _text("P-", key).alias("id_del_proceso"), key.cast("string").alias("id_del_portafolio"), _text("REF ", key).alias("referencia_del_proceso"), _text("Entidad ", c("o_custkey")).alias("entidad"),
        _text("NIT ", c("o_custkey")).alias("nit_entidad"), _text("Nation_", c("o_custkey") % 25).alias("departamento_entidad"), F.lit("Ciudad").alias("ciudad_entidad"), _modality().alias("modalidad_de_contratacion"), (key * 10).cast("string").alias("precio_base"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'00:00:00.000").alias("fecha_de_publicacion_del"), F.when(key % 5 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("fecha_de_recepcion_de"), F.when(key % 4 == 0, "x").otherwise("12").alias("duracion"), F.lit("Mes(es)").alias("unidad_de_duracion"),
        F.lit("3").alias("proveedores_invitados"), (key % 9).cast("string").alias("respuestas_al_procedimiento"), (key % 7 + c("_copy")).cast("string").alias("proveedores_unicos_con"), F.when(key % 2 == 0, "Si").otherwise("No").alias("adjudicado"), (key * 11).cast("string").alias("valor_total_adjudicacion"),
        F.lit("Nombre").alias("nombre_del_adjudicador"), _text("part-", c("_copy")).alias("file_name"),
    )


def raw_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four municipalities in each nation."""
    rows = table(spark, sf_dir, "nation").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3))))
    return rows.select(F.col("n_nationkey").cast("string").alias("cod_dpto"), F.col("n_name").alias("dpto"), (F.col("n_nationkey") * 1000 + F.col("k")).cast("string").alias("cod_mpio"), _text("CIUDAD ", F.col("k")).alias("nom_mpio"))


def raw_sanctions(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Events as sanctions, a quarter of the users in each source."""
    c = F.col
    rows = table(spark, sf_dir, "events")
    of = lambda n: rows.where(c("user_id") % 4 == n)
    day, who, event = F.date_format("ts", "yyyy-MM-dd"), c("user_id").cast("string"), c("event_id").cast("string")
    spoilt = F.when(c("event_id") % 6 == 0, "sin fecha").otherwise(day)
    return [
        of(0).select(
            _text("NIT ", who).alias("n_mero_de_identificaci_n"), _text("Empresa ", who).alias("raz_n_social_de_la_entidad"), spoilt.alias("fecha_de_resoluci_n_de_la"),
            F.when(c("event_id") % 3 == 0, "resumen").alias("descripci_n_o_detalle_resumen"), c("event_type").alias("tipo_de_sanci_n_multa")
        ),
        of(1).select(
            who.alias("documento_contratista"), _text("Empresa ", who).alias("nombre_contratista"), F.when(c("event_id") % 2 == 0, day).alias("fecha_de_firmeza"),
            day.alias("fecha_de_publicacion"), event.alias("numero_de_contrato"), F.when(c("event_id") % 2 == 0, event).alias("numero_de_resolucion")
        ),
        of(2).select(
            who.alias("as_codigo_proveedor_objeto"), _text("Empresa ", who).alias("nombre_proveedor_objeto_de"), day.alias("fecha_evento"),
            c("event_type").alias("tipo_de_sancion"), F.when(c("event_id") % 2 == 0, "otra").alias("descripcion_otro_tipo_de")
        ),
        of(3).select(
            who.alias("numero_identificacion"), F.lit("Ana").alias("primer_nombre"), F.lit(None).cast("string").alias("segundo_nombre"),
            _text("Ruiz", who).alias("primer_apellido"), F.lit("Gil").alias("segundo_apellido"), day.alias("fecha_efectos_juridicos"),
            c("event_type").alias("tipo_inhabilidad"), event.alias("sanciones")
        ),
    ]


def mart(spark: SparkSession, sf_dir: str) -> Mart:
    """A whole mart, built from these raw rows."""
    rows = lines(spark, sf_dir)
    raw = {"s1": new_platform(rows), "s2": raw_processes(spark, sf_dir), "divipola": raw_places(spark, sf_dir)}
    raw |= dict(zip(("l1", "l2", "l3", "l4"), raw_sanctions(spark, sf_dir), strict=True))
    return marts.build(spark, raw, old_platform(rows))
