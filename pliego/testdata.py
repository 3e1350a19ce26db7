"""The driver's star schema bound to the mart: line items are contracts, orders processes, customers entities, suppliers suppliers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pliego.functions.text import name_key
from pliego.params import Params
from pliego.plans import flags, marts
from pliego.plans.marts import Mart
from pliego.session import cut, spread

#: Thresholds at which the flags fire on part of these tables.
PARAMS = Params(price_tolerance=0.05, split_wages=150.0, round_min=50_000.0, round_unit=100)
SPLITTING = Params(split_wages=150.0)
ROTATION = Params(rotation_days=1460)

WINDOWS = [("W1", "presidencial", "1996-01-29", "1996-05-29"), ("W2", "presidencial", "1996-05-30", "1996-06-19"), ("W3", "territorial", "1999-06-29", "1999-10-29")]
MODALITY = {"1-URGENT": "CONTRATACION_DIRECTA", "2-HIGH": "LICITACION_PUBLICA", "3-MEDIUM": "SELECCION_ABREVIADA", "5-LOW": "CONCURSO_MERITOS"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _day(col: str) -> Column:
    return F.col(col).cast("date")


def _modality() -> Column:
    out = F.lit("MINIMA_CUANTIA")
    for raw, name in MODALITY.items():
        out = F.when(F.col("o_orderpriority") == raw, name).otherwise(out)
    return out


def _row_id() -> Column:
    return F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", _day("l_shipdate"))


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda name: table(spark, sf_dir, name)
    # orders meet customers before line items, which are several times as many, meet them; the last join is by the text of the key, so that it leaves the
    # rows in order of their process and they meet that without another shuffle. Dates are shuffled, not timestamps
    orders = read("orders").withColumn("o_orderdate", _day("o_orderdate")).join(read("customer"), F.col("o_custkey") == F.col("c_custkey"))
    goods = read("part").select("p_partkey", "p_size", F.nullif(F.concat_ws("  ", "p_name", "p_type", "p_brand"), F.lit("")).alias("_goods"))
    lines = spread(read("lineitem")).withColumns({"l_shipdate": _day("l_shipdate"), "l_quantity": F.col("l_quantity").cast("int")}).join(goods, F.col("l_partkey") == F.col("p_partkey"))
    rows = lines.join(orders, F.col("l_orderkey").cast("string") == F.col("o_orderkey").cast("string"))
    none, c = F.lit(None).cast("string"), F.col
    modality = _modality()
    return rows.select(
        F.when(c("l_linenumber") == 7, "SECOP1").otherwise("SECOP2").alias("source"),
        _row_id().alias("row_id"),
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id_contrato"),
        c("l_orderkey").cast("string").alias("proceso_de_compra"),
        c("o_custkey").cast("string").alias("nit_entidad_norm"),
        c("c_name").alias("nombre_entidad"),
        F.when(c("l_suppkey") % 37 == 0, "").otherwise(c("l_suppkey").cast("string")).alias("doc_proveedor_norm"),
        F.concat(F.lit("Supplier "), c("l_suppkey")).alias("nombre_proveedor"),
        c("c_nationkey").cast("string").alias("cod_dpto"),
        c("c_mktsegment").alias("cod_mpio"),
        modality.alias("modalidad_norm"),
        modality.isin("LICITACION_PUBLICA", "SELECCION_ABREVIADA", "CONCURSO_MERITOS").alias("es_competitiva"),
        (modality != "CONTRATACION_DIRECTA").alias("es_abierta"),
        c("l_returnflag").alias("tipo_de_contrato"),
        F.concat_ws("  ", "_goods", F.lit("suministro para la entidad")).alias("objeto_del_contrato"),
        (c("p_size") % 10).cast("int").alias("unspsc_segmento"),
        _day("l_shipdate").alias("fecha_firma"),
        _day("o_orderdate").alias("fecha_inicio"),
        _day("l_shipdate").alias("fecha_fin"),
        F.datediff(_day("l_shipdate"), _day("o_orderdate")).alias("duracion_dias_inicial"),
        c("l_quantity").cast("int").alias("dias_adicionados"),
        c("l_extendedprice").alias("valor_contrato"),
        (c("l_extendedprice") * (1 - c("l_discount"))).alias("valor_pagado"),
        F.year("l_shipdate").alias("anio"),
        none.alias("urlproceso"),
        c("l_linestatus").alias("estado"),
    )


def processes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders, and an older snapshot of every third of them."""
    c = F.col
    rows = table(spark, sf_dir, "orders").withColumn("_copy", F.explode(F.when(c("o_orderkey") % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    published = F.date_sub(_day("o_orderdate"), 5 * c("_copy"))
    return rows.select(
        c("o_orderkey").cast("string").alias("referencia"),
        F.concat_ws("|", "o_orderkey", "o_custkey", "_copy").alias("row_id"),
        published.alias("fecha_publicacion"),
        F.date_add(published, (c("o_orderkey") % 40 - 3).cast("int")).alias("fecha_recepcion_respuestas"),
        F.when(c("o_orderkey") % 11 != 0, (c("o_orderkey") % 7 + c("_copy")).cast("int")).alias("num_oferentes_unicos"),
        (c("o_orderkey") % 9).cast("int").alias("num_respuestas"),
        (c("o_totalprice") * 0.3).alias("precio_base"),
        (c("o_totalprice") * 0.5).alias("valor_adjudicacion"),
        _modality().alias("modalidad_norm"),
    )


def sanctions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").where("event_type = 'error'")
    document = F.col("user_id") * 20 + F.col("event_id") % 20  # many documents, so that few contracts meet a sanction
    sources = F.array(*[F.lit(s) for s in ("CGR", "MULTA_SECOP1", "MULTA_SECOP2", "SIRI")])
    date = F.date_add(F.lit("1995-01-01").cast("date"), (F.col("event_id") * 37 % 2400).cast("int"))
    return rows.select(document.cast("string").alias("doc_norm"), F.get(sources, (F.col("user_id") % 4).cast("int")).alias("fuente"), date.alias("fecha_sancion"))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as facts: every fifth without a place, names of places in lower case."""
    segments = F.array(*[F.lit(s) for s in ("building", "automobile", "household", "unknown")])
    rows = table(spark, sf_dir, "events").where("event_type = 'error'")
    place = F.when(F.col("event_id") % 5 != 0, F.concat(F.lit("nation_"), F.col("event_id") % 25))
    return rows.select(place.alias("departamento"), F.get(segments, (F.col("event_id") % 4).cast("int")).alias("municipio"), (F.lit(1990) + F.col("event_id") % 12).cast("int").alias("anio"))


def mart(spark: SparkSession, sf_dir: str, written: bool = False) -> Mart:
    """The mart over sf_dir. written: the facts, which many flags and scores read, are built once and written, with their process and without the columns
    that none of them reads."""
    fct, offers = contracts(spark, sf_dir), processes(spark, sf_dir)
    if written:
        fct = fct.drop("es_abierta", "tipo_de_contrato", "fecha_inicio", "fecha_fin", "valor_pagado", "estado")
        fct = cut(flags.with_process({"fct_proceso": offers}, fct, *flags.PROCESS))
    places = table(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment").distinct().join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    windows = spark.createDataFrame(WINDOWS, "window_id string, tipo string, inicio string, fin string")
    suppliers = marts.suppliers(fct)
    registered = F.date_add(F.lit("1994-12-01").cast("date"), (F.col("doc_proveedor_norm").cast("int") * 23))
    return {
        "fct_contrato": fct,
        "fct_proceso": offers,
        "stg_secop1": table(spark, sf_dir, "lineitem").where("l_linenumber = 7").select(_row_id().alias(":id"), (F.col("l_quantity").cast("int") * 1000).cast("string").alias("valor_total_de_adiciones")),
        "dim_entidad": marts.entities(fct),
        "dim_proveedor": suppliers.withColumn("fecha_matricula", registered),
        "sanciones": sanctions(spark, sf_dir),
        "divipola": places.select(
            F.col("c_nationkey").cast("string").alias("cod_dpto"), F.col("n_name").alias("dpto"), F.col("c_mktsegment").alias("cod_mpio"),
            F.col("c_mktsegment").alias("municipio"), name_key(F.col("n_name")).alias("dpto_norm"), name_key(F.col("c_mktsegment")).alias("mpio_norm")
        ),
        "ref_smmlv": spark.range(1990, 2006).select(F.col("id").cast("int").alias("year"), F.lit(1000).cast("long").alias("value_cop")),
        "ref_ventanas": windows.withColumns({c: F.col(c).cast("date") for c in ("inicio", "fin")}),
        "monitor_ciudadano_hechos": facts(spark, sf_dir),
    }


def regional(spark: SparkSession, sf_dir: str) -> Mart:
    """Contracts with the region as their entity: few entities, so that a supplier's contracts meet."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("cod_dpto"), "n_regionkey")
    base = mart(spark, sf_dir)
    fct = base["fct_contrato"].join(nation, "cod_dpto").withColumn("nit_entidad_norm", F.col("n_regionkey").cast("string")).drop("n_regionkey")
    return base | {"fct_contrato": fct}


def rounds(spark: SparkSession, sf_dir: str) -> Mart:
    """Orders as contracts of their customer, won by their status: few winners."""
    c = F.col
    rows = table(spark, sf_dir, "orders")
    return {
        "fct_contrato": rows.select(
            c("o_orderkey").cast("string").alias("id_contrato"), c("o_custkey").cast("string").alias("nit_entidad_norm"), c("o_orderstatus").alias("doc_proveedor_norm"), F.lit(1).alias("unspsc_segmento"),
            _day("o_orderdate").alias("fecha_firma"), F.lit(True).alias("es_competitiva"),
        )
    }


def texts(spark: SparkSession, sf_dir: str) -> Mart:
    """Documents as contracts' objects."""
    return {"fct_contrato": table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id_contrato"), F.col("text").alias("objeto_del_contrato"))}
