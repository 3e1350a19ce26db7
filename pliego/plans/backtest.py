"""Checking the ranking against what is known later: sanctions after the signature, landmark cases, facts of the press."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pliego.functions.casts import present
from pliego.functions.text import name_key
from pliego.operators.joins import exists_marker, small
from pliego.operators.patterns import like_join
from pliego.operators.ranking import auc, percent_rank, percent_ranks, precision_at
from pliego.plans.flags import NARROW_ROWS
from pliego.plans.marts import Mart
from pliego.session import cut

CASES = "slug string, nombre string, first int, last int, entity_patterns array<string>, entity_names array<string>, supplier_names array<string>"


def labels(scores: DataFrame, sanciones: DataFrame) -> DataFrame:
    """(id_contrato, score, is_positive): whether supplier or entity was sanctioned strictly after the signature."""
    last = sanciones.groupBy("doc_norm").agg(F.max("fecha_sancion").alias("_last"))
    rows = scores.where("score IS NOT NULL AND fecha_firma IS NOT NULL").select("id_contrato", "score", "fecha_firma", "doc_proveedor_norm", "nit_entidad_norm")
    # suppliers are few beside contracts: the dates of those that have contracts may be few enough to be sent to every task
    some = small(cut(last.join(rows.select(F.col("doc_proveedor_norm").alias("doc_norm")).distinct(), "doc_norm", "left_semi")), NARROW_ROWS)
    for side, col, dates in (("_s", "doc_proveedor_norm", some), ("_e", "nit_entidad_norm", last)):
        rows = rows.join(dates.select(F.col("doc_norm").alias(f"{side}_doc"), F.col("_last").alias(side)), F.col(col) == F.col(f"{side}_doc"), "left")
    after = lambda side: F.coalesce(F.col(side) > F.col("fecha_firma"), F.lit(False))
    return rows.select("id_contrato", "score", (after("_s") | after("_e")).alias("is_positive"))


def metrics(labelled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row of AUC, and precision and lift at each k."""
    return auc(labelled, "score", "is_positive"), precision_at(labelled, "score", "is_positive", "id_contrato")


def load_cases(spark: SparkSession, path: str) -> DataFrame:
    """Landmark cases from a JSON file, or a YAML one where that library is installed: slug, nombre, periodo [first, last],
    hint_entidad_like, entidades [{nombre}], proveedores [{nombre}]."""
    with open(path, encoding="utf-8") as f:
        if path.endswith((".yaml", ".yml")):
            import yaml

            raw = yaml.safe_load(f)
        else:
            raw = json.load(f)
    raw = raw.get("cases", raw.get("casos", [])) if isinstance(raw, dict) else raw
    names = lambda items: [i["nombre"] for i in items or [] if i.get("nombre")]
    return spark.createDataFrame([(c["slug"], c.get("nombre"), *c["periodo"], c.get("hint_entidad_like") or [], names(c.get("entidades")), names(c.get("proveedores"))) for c in raw], CASES)


def landmark_matches(scores: DataFrame, cases: DataFrame, ignore_period: bool = False) -> DataFrame:
    """A row for each contract of a case: an entity pattern fits and the year lies in the period.

    coincide_proveedor and coincide_nombre_exacto tell whether a named supplier and an official name fit too; null where the case
    names none. Entities are matched once per name, not once per contract, and through an index of the patterns' pieces, so cases may be many.
    """
    like_one = lambda name, patterns: F.when(F.size(patterns) > 0, F.exists(patterns, lambda x: F.contains(name, name_key(x))))
    names = scores.select("nombre_entidad").distinct().withColumn("_name", name_key(F.col("nombre_entidad")))
    cases = cut(cases.withColumn("_case", F.monotonically_increasing_id()))
    wanted = cases.select("_case", F.explode("entity_patterns").alias("_pattern"))
    met = like_join(names, "_name", wanted, "_pattern").join(wanted, "_pattern").select("_name", "_case").distinct()
    hit = names.join(met, "_name").join(cases, "_case")
    hit = hit.withColumn("coincide_nombre_exacto", like_one(F.col("_name"), F.col("entity_names"))).drop("_name", "_case", "entity_names", "entity_patterns")
    rows = scores.join(hit.withColumnRenamed("nombre_entidad", "_entity"), F.col("nombre_entidad").eqNullSafe(F.col("_entity"))).drop("_entity")
    if not ignore_period:
        rows = rows.where(F.col("anio").between(F.col("first"), F.col("last")))
    rows = rows.withColumn("coincide_proveedor", like_one(name_key(F.col("nombre_proveedor")), F.col("supplier_names")))
    return rows.select("slug", "id_contrato", "nombre_entidad", "nombre_proveedor", "anio", "valor_contrato", "score", "tier", "coincide_proveedor", "coincide_nombre_exacto")


def year_percentiles(scores: DataFrame) -> DataFrame:
    """(id_contrato, percentil_anio): each scored contract's percent rank among those of its own year."""
    return percent_rank(scores, "anio", "score", "percentil_anio").select("id_contrato", "percentil_anio")


def case_summary(scores: DataFrame, cases: DataFrame) -> DataFrame:
    """One row per case: matches, the best contract's score, tier and percentile, and whether any reaches the top quartile.

    A contract's percentile follows from its year and score, so that matches meet the ranks of distinct scores, not those of all contracts.
    """
    ranked = landmark_matches(scores, cases).join(percent_ranks(scores, "anio", "score", "percentil_anio"), ["anio", "score"], "left")
    best = F.struct(F.coalesce("score", F.lit(-1.0)).alias("s"), F.col("id_contrato").alias("i"))
    found = ranked.groupBy("slug").agg(
        F.count("*").alias("n_matched"), F.count_if("coincide_nombre_exacto").alias("n_confirmed_exact_name"), F.max_by("score", best).alias("best_score"), F.max_by("tier", best).alias("best_tier"),
        F.max_by("percentil_anio", best).alias("best_percentil_anio"), F.bool_or(F.coalesce(F.col("percentil_anio") >= 0.75, F.lit(False))).alias("top_quartile_reached"),
    )
    wide = landmark_matches(scores, cases, ignore_period=True).groupBy("slug").agg(F.count("*").alias("n_matched_ignoring_period"))
    rows = cases.select("slug", "nombre", "first", "last").join(found, "slug", "left").join(wide, "slug", "left")
    return rows.fillna(0, ["n_matched", "n_confirmed_exact_name", "n_matched_ignoring_period"])


def fact_matches(facts: DataFrame, scores: DataFrame, divipola: DataFrame) -> DataFrame:
    """One row: how many facts there are, can be joined, have a known place, and have a contract of that place and year.

    Rates are over all facts and over those that can be joined.
    """
    usable = facts.where(present(F.col("departamento")) & present(F.col("municipio")) & F.col("anio").isNotNull())
    keyed_facts = usable.select("anio", name_key(F.col("departamento")).alias("dpto_norm"), name_key(F.col("municipio")).alias("mpio_norm"))
    places = divipola.select("dpto_norm", "mpio_norm", "cod_dpto", "cod_mpio").distinct()
    known = keyed_facts.join(places, ["dpto_norm", "mpio_norm"])
    marked = exists_marker(known, scores, ["cod_dpto", "cod_mpio", "anio"], "_contract")
    geo = marked.agg(F.count("*").alias("n_geo_matched"), F.count_if("_contract").alias("n_matched"))
    counts = facts.agg(F.count("*").alias("n_total"), F.count_if(present(F.col("departamento")) & present(F.col("municipio")) & F.col("anio").isNotNull()).alias("n_usable_join_keys"))
    joined = counts.crossJoin(F.broadcast(geo))  # one row each
    rate = lambda n: F.round(F.try_divide(F.col("n_matched") * 100.0, F.col(n)), 2)
    return joined.withColumns({"match_rate_pct": rate("n_total"), "match_rate_usable_pct": rate("n_usable_join_keys")})


AUC_TARGET, LIFT_TARGET = 0.6, 1.5


def targets(auc_value: float | None, lift: float | None, summary: Sequence[bool | None]) -> dict[str, bool]:
    """Whether the ranking reaches its targets: AUC and lift above theirs, every case that has data in its year's top quartile."""
    with_data = [s for s in summary if s is not None]
    return {"auc": auc_value is not None and auc_value > AUC_TARGET, "lift": lift is not None and lift > LIFT_TARGET, "cases": bool(with_data) and all(with_data)}


def run(mart: Mart, cases: DataFrame | None = None) -> Mart:
    """AUC, precision, whether the targets are reached, facts, and where given, cases, as tables."""
    by_auc, by_k = (cut(df) for df in metrics(labels(mart["contrato_score"], mart["sanciones"])))
    out = {"auc": by_auc, "precision": by_k, "facts": fact_matches(mart["monitor_ciudadano_hechos"], mart["contrato_score"], mart["divipola"])}
    found: list[bool | None] = []
    if cases is not None:
        out["cases"] = cut(case_summary(mart["contrato_score"], small(cases)))
        found = [r["top_quartile_reached"] for r in out["cases"].collect()]  # a row for each case, which are few
    lift = {r["name"]: r["lift"] for r in by_k.collect()}.get("top_10%")  # a row for each k
    reached = targets(by_auc.first()["auc"], lift, found)
    return out | {"targets": by_auc.sparkSession.createDataFrame(list(reached.items()), "target string, reached boolean")}


def summed(found: Mart, doubted: Sequence[str] = ()) -> dict:
    """What the catalogue of the artifacts says of a run's tables. doubted: slugs of cases whose matches were looked at and are none."""
    by_k = {r["name"]: r for r in found["precision"].collect()}  # a row for each k
    auc_row = found["auc"].first()
    cases = [
        {"slug": c["slug"], "nombre": c["nombre"] or c["slug"], "periodo": [c["first"], c["last"]], "n_matched": c["n_matched"], "mejor_score": c["best_score"], "mejor_tier": c["best_tier"],
         "percentil_anio": c["best_percentil_anio"], "cuartil_superior": c["top_quartile_reached"], "confirmado_manualmente": c["n_matched"] > 0 and c["slug"] not in doubted}
        for c in (found["cases"].orderBy("slug").collect() if "cases" in found else [])  # few
    ]
    return {
        "auc": auc_row["auc"], "n": auc_row["n"], "n_pos": auc_row["n_pos"], "lift": by_k["top_10%"]["lift"] if "top_10%" in by_k else None, "auc_target": AUC_TARGET, "lift_target": LIFT_TARGET,
        "precision": {k: r["precision"] for k, r in by_k.items()}, "reached": all(r["reached"] for r in found["targets"].collect()), "cases": cases, "facts": found["facts"].first().asDict(),
    }
