"""What a mart's build did to its rows, and what the facts look like."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pliego.functions.casts import present
from pliego.functions.numbers import rate, ratio
from pliego.operators.joins import exists_marker
from pliego.operators.profiles import null_rates, profile
from pliego.operators.ranking import percentiles
from pliego.plans.enrichment import coverage
from pliego.plans.marts import Mart


def reconciled(raw: DataFrame, staged: DataFrame, name: str) -> DataFrame:
    """source, raw, staged, removed."""
    counts = raw.agg(F.count("*").alias("raw")).crossJoin(staged.agg(F.count("*").alias("staged")))  # one row each
    return counts.select(F.lit(name).alias("source"), "raw", "staged", (F.col("raw") - F.col("staged")).alias("removed"))


def quarantined(quarantine: DataFrame, staged: DataFrame) -> DataFrame:
    """source, reason, n and its percentage of all staged rows."""
    total = staged.agg(F.count("*").alias("_all"))
    counts = quarantine.groupBy("source", "reason").agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(total)).select("source", "reason", "n", ratio(F.col("n") * 100, F.col("_all")).alias("pct"))  # one row


def value_panel(fct: DataFrame) -> DataFrame:
    """One row: extremes of value and date, and how many rows have dates no contract can have."""
    odd = ~F.year("fecha_firma").between(1990, 2030) | (F.col("duracion_dias_inicial") < 0)
    return fct.agg(
        F.count("*").alias("n"), F.min("valor_contrato").alias("min_valor"), F.max("valor_contrato").alias("max_valor"), F.count_if(F.col("valor_contrato") <= 0).alias("n_not_positive"),
        F.min("fecha_firma").alias("first_date"), F.max("fecha_firma").alias("last_date"), F.count_if(odd).alias("n_odd_dates"),
    )


def value_percentiles(fct: DataFrame) -> DataFrame:
    return percentiles(fct, "valor_contrato", (0.5, 0.95, 0.99))


def geo_rate(fct: DataFrame) -> DataFrame:
    return fct.where("source = 'SECOP2'").agg(F.count("*").alias("total"), F.count_if(F.col("cod_dpto").isNotNull()).alias("n_matched"), rate(F.col("cod_dpto").isNotNull()).alias("pct"))


def join_coverage(fct: DataFrame, proc: DataFrame) -> DataFrame:
    """Contracts that have a process; a contract counts once however many snapshots its process has."""
    keys = proc.select(F.col("referencia").alias("proceso_de_compra"))
    marked = exists_marker(fct.where("source = 'SECOP2'"), keys, ["proceso_de_compra"], "_found")
    return marked.agg(F.count("*").alias("total"), F.count_if("_found").alias("n_matched"), rate(F.col("_found")).alias("pct"))


def join_keys(fct: DataFrame, proc: DataFrame) -> DataFrame:
    """(key, n_keyed, n_matched, pct): how many contracts find their process by each of a process's columns."""
    keyed_rows = fct.where((F.col("source") == "SECOP2") & present(F.col("proceso_de_compra")))
    parts = []
    for name in ("referencia", "id_del_proceso", "referencia_del_proceso"):
        marked = exists_marker(keyed_rows, proc.select(F.col(name).alias("proceso_de_compra")), ["proceso_de_compra"], "_found")
        parts.append(marked.agg(F.count("*").alias("n_keyed"), F.count_if("_found").alias("n_matched"), rate(F.col("_found")).alias("pct")).select(F.lit(name).alias("key"), "*"))
    return reduce(DataFrame.unionByName, parts)


def listed(found: DataFrame) -> DataFrame:
    """A profile with its examples as one text."""
    return found.withColumn("examples", F.substring(F.array_join("examples", ", "), 1, 120)).orderBy("col")


def modalities(fct: DataFrame, proc: DataFrame) -> DataFrame:
    """Rows of contracts and processes by modality, counted apart and summed."""
    one = lambda df: df.groupBy("modalidad_norm").agg(F.count("*").alias("_n"))
    return one(fct).unionByName(one(proc)).groupBy("modalidad_norm").agg(F.sum("_n").alias("n")).orderBy(F.col("n").desc(), "modalidad_norm")


def report(mart: Mart) -> dict[str, DataFrame]:
    """The panels of a quality report."""
    fct = mart["fct_contrato"]
    return {
        "Nulls": null_rates(fct, fct.columns),
        "Values": value_panel(fct),
        "Value percentiles": value_percentiles(fct),
        "Geography": geo_rate(fct),
        "Processes": join_coverage(fct, mart["fct_proceso"]),
        "Join keys": join_keys(fct, mart["fct_proceso"]),
        "Modalities": modalities(fct, mart["fct_proceso"]),
        "Columns of contracts": listed(profile(fct)),
        "Columns of processes": listed(profile(mart["fct_proceso"])),
    } | ({"Registry": coverage(mart["dim_proveedor"])} if "dim_proveedor" in mart and "fecha_matricula" in mart["dim_proveedor"].columns else {})
