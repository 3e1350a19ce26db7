"""Registration dates of suppliers from two chambers' registers, how far they reach, and who is left to look up."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pliego.functions.casts import compact_date
from pliego.functions.numbers import ratio
from pliego.functions.text import digits, nit_base
from pliego.operators.joins import earliest_of
from pliego.plans.marts import Mart
from pliego.session import cut
from pliego.streaming.keyed import KeyedTable

#: Fixed value: what the first register writes where a number does not apply.
NOT_APPLICABLE = "NO APLICA"


def _earliest(rows: DataFrame, source: str) -> DataFrame:
    found = rows.where((F.col("number") != "") & F.col("date").isNotNull()).groupBy(nit_base(F.col("number")).alias("nit_base"))
    return found.agg(F.min("date").alias("fecha_matricula"), F.count("*").alias(f"n_registros_{source}"))


def resolved(ibague: DataFrame, santarosa: DataFrame) -> DataFrame:
    """One row per base number: each register's earliest date, the earlier of both, and whether they disagree.

    The first register has one number with check digit; the second has number and check digit apart, and for persons another column.
    """
    some = F.col("nit").isNotNull() & ~F.upper(F.trim("nit")).isin(NOT_APPLICABLE, "")
    first = ibague.where(some).select(digits(F.col("nit")).alias("number"), compact_date(F.col("fecha_de_matricula")).alias("date"))
    with_check = F.concat(F.col("nit"), F.coalesce("digito_verificacion", F.lit("")))
    number = F.when(F.col("nit").isNotNull() & (F.trim("nit") != ""), with_check).otherwise(F.col("numero_identificacion"))
    second = santarosa.select(digits(number).alias("number"), compact_date(F.col("fecha_matricula")).alias("date"))
    both = earliest_of(_earliest(first, "ibague"), _earliest(second, "santarosa"), "nit_base", "fecha_matricula", ("ibague", "santarosa"))
    both = both.withColumnsRenamed({"fecha_matricula_ibague": "fecha_ibague", "fecha_matricula_santarosa": "fecha_santarosa"})
    return both.fillna(0, ["n_registros_ibague", "n_registros_santarosa"])


def resolved_stats(found: DataFrame) -> DataFrame:
    return found.agg(
        F.count("*").alias("n_nit_base"), F.count_if("is_conflict").alias("n_conflicts"), F.count_if(F.col("n_registros_ibague") > 1).alias("n_multi_registro_ibague"),
        F.count_if(F.col("n_registros_santarosa") > 1).alias("n_multi_registro_santarosa")
    )


def enriched(dim: DataFrame, found: DataFrame) -> DataFrame:
    """Suppliers with fecha_matricula, null where no register has them. Doing it twice changes nothing."""
    dates = found.select("nit_base", "fecha_matricula")
    return dim.drop("fecha_matricula").withColumn("nit_base", nit_base(F.col("doc_proveedor_norm"))).join(dates, "nit_base", "left").drop("nit_base")


def coverage(dim: DataFrame) -> DataFrame:
    """How many suppliers, and how much of their value, have a date: a row for all, one for each kind of person."""
    matched = F.col("fecha_matricula").isNotNull()
    sums = [
        F.count("*").alias("n_suppliers"), F.count_if(matched).alias("n_matched"), F.coalesce(F.sum("valor_total"), F.lit(0.0)).alias("valor_total"),
        F.coalesce(F.sum(F.when(matched, F.col("valor_total")).otherwise(0.0)), F.lit(0.0)).alias("valor_matched"),
    ]
    by_kind = dim.groupBy(F.coalesce(F.col("es_persona_natural").cast("string"), F.lit("unknown")).alias("kind")).agg(*sums)
    rows = by_kind.unionByName(dim.agg(*sums).withColumn("kind", F.lit("all")).select(by_kind.columns))
    return rows.withColumns({"pct_matched": ratio(F.col("n_matched") * 100, F.col("n_suppliers")), "pct_valor": ratio(F.col("valor_matched") * 100, F.col("valor_total"))})


def completeness(entry: dict, rows: int) -> dict:
    """Rows that are there against the rows that the remote source said it has."""
    live = entry.get("live_count_at_start")
    return {"rows_on_disk": rows, "live_total": live, "pct_of_live_total": rows * 100.0 / live if live else None, "status": entry.get("status", "unknown")}


def candidates(mart: Mart, min_value: float = 200_000_000) -> DataFrame:
    """Suppliers still without a date that have a large contract or a fired flag, largest contract first."""
    largest = mart["fct_contrato"].groupBy("doc_proveedor_norm").agg(F.max("valor_contrato").alias("max_valor"))
    rows = mart["dim_proveedor"].where(F.col("fecha_matricula").isNull()).select("doc_proveedor_norm", "nombre_proveedor").join(largest, "doc_proveedor_norm")
    wanted = rows.where(F.col("max_valor") >= min_value)
    if "flag_contrato" in mart:
        fired = mart["flag_contrato"].where("fired").select(F.col("key").alias("id_contrato")).distinct()
        flagged = mart["fct_contrato"].join(fired, "id_contrato", "left_semi").select("doc_proveedor_norm").distinct()
        wanted = wanted.unionByName(rows.join(flagged, "doc_proveedor_norm", "left_semi")).distinct()
    return wanted.orderBy(F.col("max_valor").desc(), "doc_proveedor_norm")


CACHE = "nit_base string, fecha_matricula date, found boolean, looked_at timestamp"


class LookupCache:
    """What has been looked up, one row a number, numbers for which nothing was found too; kept below `path` and added to by each run."""

    def __init__(self, path: str):
        self.table = KeyedTable(path, ["nit_base"], ["found", "looked_at"], buckets=16)

    def rows(self, spark: SparkSession) -> DataFrame:
        return self.table.current(spark) if self.table.commits(spark) else spark.createDataFrame([], CACHE)


def looked_up(wanted: DataFrame, cache: DataFrame | LookupCache, fetch: Callable[[str], str | None] | None = None, per_second: float = 1.0, tasks: int = 4) -> DataFrame:
    """(nit_base, fecha_matricula) of wanted numbers: from the cache, and where `fetch` is given, from it; what it gives is added to a LookupCache.

    Without `fetch`, numbers that are not in the cache have a null date. `fetch` gets a number and returns eight digits or nothing. All tasks together ask
    `per_second` times a second at most: there are `tasks` of them, and each waits its share. A number that is in the cache, with a date or without, is not asked for again.
    """
    spark = wanted.sparkSession
    known = cache.rows(spark) if isinstance(cache, LookupCache) else cache
    joined = wanted.select("nit_base").where("nit_base IS NOT NULL").distinct().join(known.select("nit_base", "fecha_matricula").withColumn("_known", F.lit(True)), "nit_base", "left")
    if fetch is None:
        return joined.drop("_known")
    wait = tasks / per_second

    def ask(frames):
        import time

        last = 0.0
        for frame in frames:
            got = []
            for number in frame["nit_base"]:
                time.sleep(max(0.0, last + wait - time.monotonic()))
                last = time.monotonic()
                got.append(fetch(number))
            yield frame.assign(found=got)

    missing = joined.where(F.col("_known").isNull()).select("nit_base").repartition(tasks).mapInPandas(ask, "nit_base string, found string")
    new = cut(missing.select("nit_base", compact_date(F.col("found")).alias("fecha_matricula")))  # asked for once, though read twice
    if isinstance(cache, LookupCache) and not new.isEmpty():
        cache.table.merge(new.select("nit_base", "fecha_matricula", F.col("fecha_matricula").isNotNull().alias("found"), F.current_timestamp().alias("looked_at")))
    return joined.where("_known").select("nit_base", "fecha_matricula").unionByName(new)
