"""What is published: national and department views, ranked lists, single contracts."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pliego.functions.evidence import as_objects, parsed
from pliego.functions.numbers import weighted_mean
from pliego.functions.text import padded
from pliego.operators.dedup import keep_latest, top_per_group
from pliego.operators.joins import small
from pliego.params import Params
from pliego.plans.marts import Mart
from pliego.plans.published import ARTIFACT_SCHEMAS, meta
from pliego.plans.scoring import evidence_of
from pliego.session import cut
from pliego.sinks.artifacts import chunk_json, chunked, compact, publish

TOP_CASES, TOP_RECENT, TOP_ENTITIES, TOP_PER_DEPARTMENT, CHUNK = 2500, 1000, 300, 50, 500


def kpis(scores: DataFrame, fct: DataFrame, p: Params | None = None) -> DataFrame:
    """One row of national figures. The share of direct contracts counts those with a year, and divides by all.

    Scores that were made with modalidad_norm need not be joined with their contracts.
    """
    p, rows = p or Params(), scores
    if "modalidad_norm" not in scores.columns:
        modality = keep_latest(fct, ["id_contrato"], "fecha_firma", "row_id").select("id_contrato", "modalidad_norm")
        rows = scores.join(modality, "id_contrato", "left")
    n = F.count("*")
    return rows.agg(
        n.alias("contratos_analizados"), F.coalesce(F.sum("valor_contrato"), F.lit(0.0)).alias("valor_total_cop"), F.count_if(F.col("tier") == p.tiers[-1][0]).alias("casos_criticos"),
        F.coalesce(F.try_divide(F.count_if((F.col("modalidad_norm") == p.direct) & F.col("anio").isNotNull()) * 100.0, n), F.lit(0.0)).alias("pct_contratacion_directa"),
        F.count_distinct(F.nullif("nit_entidad_norm", F.lit(""))).alias("n_entidades"), F.count_distinct(F.nullif("doc_proveedor_norm", F.lit(""))).alias("n_proveedores"),
        F.count_if(F.col("cod_dpto").isNull()).alias("n_contratos_sin_departamento"), F.coalesce(F.try_divide(F.count("cod_dpto") * 100.0, n), F.lit(0.0)).alias("pct_geolocalizado"),
    )


def year_modality(scores: DataFrame, fct: DataFrame) -> DataFrame:
    modality = keep_latest(fct, ["id_contrato"], "fecha_firma", "row_id").select("id_contrato", F.col("modalidad_norm").alias("modalidad"))
    return scores.where("anio IS NOT NULL").join(modality, "id_contrato").groupBy("anio", "modalidad").agg(F.count("*").alias("n_contratos"), F.coalesce(F.sum("valor_contrato"), F.lit(0.0)).alias("valor_total"))


def year_tier(scores: DataFrame) -> DataFrame:
    return scores.where("anio IS NOT NULL AND tier IS NOT NULL").groupBy("anio", "tier").agg(F.count("*").alias("n_contratos"))


def _tier_counts(p: Params) -> list[Column]:
    """A count for each tier; the highest one's name is n_criticos."""
    return [F.count_if(F.col("tier") == t).alias("n_criticos" if t == "critico" else f"n_{t}") for t, _, _ in p.tiers]


def _totals() -> list[Column]:
    return [F.count("*").alias("n_contratos"), F.coalesce(F.sum("valor_contrato"), F.lit(0.0)).alias("valor_total"), weighted_mean(F.col("score"), F.col("valor_contrato")).alias("score_promedio")]


def department_names(divipola: DataFrame) -> DataFrame:
    return divipola.groupBy("cod_dpto").agg(F.min("dpto").alias("dpto"))


def departments(scores: DataFrame, divipola: DataFrame, p: Params | None = None) -> DataFrame:
    """Every department, those without contracts with zeros."""
    p = p or Params()
    found = scores.where("cod_dpto IS NOT NULL").groupBy("cod_dpto").agg(*_totals(), *_tier_counts(p))
    rows = department_names(divipola).join(found, "cod_dpto", "left")
    return rows.fillna(0, [c for c in found.columns if c.startswith("n_") or c == "valor_total"])


def _entity_fields() -> list[Column]:
    c = F.col
    own = ["n_contratos", "valor_total", "score", "tier", "datos_insuficientes", "n_flags_aplicables", "n_flags_disparados"]
    return [c("nit_entidad_norm").alias("nit_entidad"), c("nombre_entidad"), padded(c("cod_dpto"), 2).alias("cod_dpto"), c("dpto"), *map(c, own), parsed(c("flags_disparados")).alias("banderas")]


def department_details(mart: Mart, p: Params | None = None, top: int = TOP_PER_DEPARTMENT) -> DataFrame:
    """Every department with its totals, municipalities, top entities and years, as nested lists in one plan.

    Places and years are all there, as many as a department has; entities are the `top` first.
    """
    p = p or Params()
    scores = mart["contrato_score"]

    def listed(df: DataFrame, name: str, order: Sequence[Column], columns: Sequence[Column | str], n: int | None = None) -> DataFrame:
        some = df.where("cod_dpto IS NOT NULL")
        ranked = top_per_group(some, ["cod_dpto"], order, n) if n else some.withColumn("position", F.row_number().over(Window.partitionBy("cod_dpto").orderBy(*order)))
        return ranked.groupBy("cod_dpto").agg(F.array_sort(F.collect_list(F.struct("position", F.struct(*columns).alias("item"))))["item"].alias(name))

    best = [F.col("score").desc_nulls_last(), F.col("valor_total").desc_nulls_last()]
    places = listed(
        mart["municipio_score"], "municipios", [*best, F.col("cod_mpio")],
        [padded(F.col("cod_mpio"), 5).alias("cod_mpio"), "municipio", "n_contratos", F.coalesce("valor_total", F.lit(0.0)).alias("valor_total"), "score", "tier", "datos_insuficientes"]
    )
    ranked = mart["entidad_score"].join(department_names(mart["divipola"]), "cod_dpto", "left")
    entities = listed(ranked, "top_entidades", [*best, F.col("nit_entidad_norm")], _entity_fields(), top)
    yearly = scores.where("anio IS NOT NULL").groupBy("cod_dpto", "anio").agg(*_totals())
    years = listed(yearly, "serie_anio", [F.col("anio")], ["anio", "n_contratos", "valor_total", "score_promedio"])
    rows = departments(scores, mart["divipola"], p)
    for part in (places, entities, years):
        rows = rows.join(part, "cod_dpto", "left")
    kinds = dict(rows.dtypes)
    whole = {c: F.coalesce(c, F.array().cast(kinds[c])) for c in ("municipios", "top_entidades", "serie_anio")}  # none is an empty list
    return rows.withColumns(whole | {"cod_dpto": padded(F.col("cod_dpto"), 2)})


def _shown(rows: DataFrame, mart: Mart, p: Params | None, flags: bool) -> DataFrame:
    """Listed contracts with the names of their places, their modality and, if wanted, their flags with evidence. rows: a bounded list.

    Where the scores carry no evidence, it is built for these contracts alone.
    """
    rows = cut(rows)
    if flags and "flags_disparados" not in rows.columns:
        own = evidence_of(mart, rows.select(F.col("id_contrato").alias("key")), p)
        rows = rows.join(own, F.col("id_contrato") == F.col("key"), "left").drop("key")
    told = [parsed(F.col("flags_disparados")).alias("banderas")] if flags else []
    place = mart["divipola"].groupBy("cod_dpto", "cod_mpio").agg(F.min("municipio").alias("municipio"))
    wanted = mart["fct_contrato"].join(small(rows.select("id_contrato")), "id_contrato", "left_semi")
    modality = keep_latest(wanted, ["id_contrato"], "fecha_firma", "row_id").select("id_contrato", F.col("modalidad_norm").alias("modalidad"))
    named = rows.join(modality, "id_contrato").join(department_names(mart["divipola"]), "cod_dpto", "left").join(place, ["cod_dpto", "cod_mpio"], "left")
    return named.select(
        "id_contrato", F.col("nit_entidad_norm").alias("nit_entidad"), "nombre_entidad", F.col("doc_proveedor_norm").alias("doc_proveedor"), "nombre_proveedor", padded(F.col("cod_dpto"), 2).alias("cod_dpto"), "dpto",
        padded(F.col("cod_mpio"), 5).alias("cod_mpio"), "municipio", "modalidad", "anio", "valor_contrato", "fecha_firma", "source", "score", "tier", "urlproceso", "n_flags_aplicables", "n_flags_disparados", *told,
    )


def by_score() -> list[Column]:
    return [F.col("score").desc(), F.col("valor_contrato").desc_nulls_last(), F.col("id_contrato")]


def by_date() -> list[Column]:
    return [F.col("fecha_firma").desc(), F.col("id_contrato")]


def priority_cases(mart: Mart, top: int = TOP_CASES, p: Params | None = None, flags: bool = True) -> DataFrame:
    """The contracts of highest score, ties to the larger value, then the smaller id."""
    rows = mart["contrato_score"].where(F.col("score").isNotNull()).orderBy(*by_score()).limit(top)
    return _shown(rows, mart, p, flags)


def recent_contracts(mart: Mart, top: int = TOP_RECENT, today: str | None = None, p: Params | None = None, flags: bool = True) -> DataFrame:
    """The contracts signed last, none dated after today."""
    day = F.lit(today).cast("date") if today else F.current_date()
    rows = mart["contrato_score"].where(F.col("score").isNotNull() & (F.col("fecha_firma") <= day)).orderBy(*by_date()).limit(top)
    return _shown(rows, mart, p, flags)


def top_entities(mart: Mart, top: int = TOP_ENTITIES) -> DataFrame:
    order = [F.col("score").desc_nulls_last(), F.col("valor_total").desc_nulls_last(), F.col("nit_entidad_norm")]
    return mart["entidad_score"].orderBy(*order).limit(top).join(department_names(mart["divipola"]), "cod_dpto", "left")


def top_suppliers(scores: DataFrame, top: int = TOP_ENTITIES) -> DataFrame:
    return scores.orderBy(F.col("score").desc(), F.coalesce("valor_total", F.lit(0.0)).desc(), F.col("doc_proveedor_norm")).limit(top)


def pivoted(series: DataFrame, row: str, col: str, value: str, values: Sequence[str]) -> DataFrame:
    """One row for each `row`, one column for each of the values, zero where there is none."""
    return series.groupBy(row).pivot(col, list(values)).agg(F.sum(value)).fillna(0)


def filtered(rows: DataFrame, search: str = "", **facets: str) -> DataFrame:
    """Rows with the given facet values, and with the searched text in an id or a name, whatever its case."""
    for col, value in facets.items():
        rows = rows.where(F.col(col) == value)
    wanted = search.strip().lower()
    fields = ("id_contrato", "nombre_entidad", "nombre_proveedor", "nit_entidad_norm", "doc_proveedor_norm", "nit_entidad", "doc_proveedor")
    text = F.lower(F.concat_ws("\n", *[c for c in fields if c in rows.columns]))
    return rows.where(text.contains(wanted)) if wanted else rows


def facet_values(rows: DataFrame, col: str) -> DataFrame:
    return rows.where(F.col(col).isNotNull()).select(col).distinct().orderBy(col)


def found_by_id(id_contrato: str, *lists: DataFrame) -> DataFrame:
    """The contract's row from the first list that has it."""
    same = [df.where(F.col("id_contrato") == id_contrato).select("*", F.lit(i).alias("_list")) for i, df in enumerate(lists)]
    out = same[0]
    for df in same[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out.orderBy("_list").limit(1).drop("_list")


def _as_json(*columns: Column | str) -> Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def _with_objects(item: Column) -> Column:
    """A struct with a list of flags, their evidence as objects."""
    return item.withField("banderas", as_objects(item["banderas"]))


def _items(df: DataFrame, name: str, *order: str) -> DataFrame:
    """One row: all rows of a bounded list as an array of structs, in the order of the named columns, which tell them apart."""
    item = F.struct(*[F.col(c).alias(f"_{i}") for i, c in enumerate(order)], F.struct(*df.columns).alias("item"))
    return df.agg(F.array_sort(F.collect_list(item))["item"].alias(name))


def _one(kind: str, row: DataFrame) -> DataFrame:
    """The artifact that is one row."""
    return row.select(F.lit(f"{kind}.json").alias("path"), F.lit(kind).alias("kind"), _as_json(*row.columns).alias("json"))


def _chunks(kind: str, df: DataFrame, n: int, order: list[Column]) -> DataFrame:
    ready = chunk_json(chunked(df, n, *order), df.columns, _with_objects)
    return ready.select(F.format_string(f"{kind}/%03d.json", "chunk_index").alias("path"), F.lit(kind).alias("kind"), "json")


def _top(kind: str, df: DataFrame, id_col: str, fields: Sequence[Column], shape: Callable[[Column], Column] = lambda item: item) -> DataFrame:
    """A ranked list that is limited already: these fields of its rows."""
    ranked = df.select((-F.coalesce("score", F.lit(-1.0))).alias("_score"), (-F.coalesce("valor_total", F.lit(0.0))).alias("_value"), F.col(id_col).alias("_id"), F.struct(*fields).alias("_item"))
    listed = _items(ranked, "items", "_score", "_value", "_id").select(F.transform("items", lambda x: shape(x["_item"])).alias("items"))
    return _one(kind, listed.select(F.size("items").alias("n_items"), "items"))


def summary(mart: Mart, p: Params | None = None) -> DataFrame:
    """One row: national figures, series by year, and every department. Lists are as long as there are years and places."""
    scores, fct = mart["contrato_score"], mart["fct_contrato"]
    series = _items(year_modality(scores, fct), "serie_anio_modalidad", "anio", "modalidad")
    tiers = _items(year_tier(scores), "serie_anio_tier", "anio", "tier")
    places = departments(scores, mart["divipola"], p)
    row = kpis(scores, fct, p).select(F.struct("*").alias("kpis"))
    for part in (series, tiers, _items(places.withColumn("cod_dpto", padded(F.col("cod_dpto"), 2)), "departamentos", "cod_dpto")):
        row = row.crossJoin(F.broadcast(part))  # one row each
    return row


def artifacts(mart: Mart, chunk: int = CHUNK, today: str | None = None, p: Params | None = None, generated: str = "") -> DataFrame:
    """(path, kind, json, items): every artifact but the catalogue."""
    p = p or Params()
    details = department_details(mart, p)
    details = details.withColumn("top_entidades", F.transform("top_entidades", _with_objects))
    supplier = [F.col("doc_proveedor_norm").alias("doc_proveedor"), *map(F.col, ("nombre_proveedor", "es_persona_natural", "n_contratos", "valor_total", "score", "tier", "datos_insuficientes"))]
    parts = [
        _chunks("casos_prioritarios", priority_cases(mart, p=p), chunk, by_score()),
        _chunks("contratos_recientes", recent_contracts(mart, today=today, p=p), chunk, by_date()),
        details.select(F.concat(F.lit("departamentos/"), "cod_dpto", F.lit(".json")).alias("path"), F.lit("departamento").alias("kind"), _as_json(*details.columns).alias("json")),
        _top("entidades_top", top_entities(mart), "nit_entidad_norm", _entity_fields(), _with_objects),
        _top("proveedores_top", top_suppliers(mart["proveedor_score"]), "doc_proveedor_norm", supplier),
        _one("resumen_nacional", summary(mart, p).select(F.lit(generated).alias("generado_en"), "*")),
    ]
    return reduce(DataFrame.unionByName, parts).withColumn("items", F.coalesce(F.get_json_object("json", "$.n_items_total"), F.lit("0")).cast("int"))


def run(mart: Mart, out: str, chunk: int = CHUNK, today: str | None = None, p: Params | None = None, metrics: dict | None = None, generated: str | None = None, version: str | None = None) -> list[dict]:
    """Every artifact, its catalogue (meta.json) and manifest.json below out; returns the manifest's files. metrics: of backtest.summed; version: of the code that scored."""
    p = p or Params()
    now = generated or dt.datetime.now(dt.UTC).isoformat(timespec="seconds")
    ready = cut(artifacts(mart, chunk, today, p, now))
    counts = {r["kind"]: (r["n"], r["items"]) for r in ready.groupBy("kind").agg(F.count("*").alias("n"), F.max("items").alias("items")).collect()}  # a row for each kind
    catalogue = meta(p, counts, now, metrics, (TOP_CASES, TOP_RECENT, TOP_ENTITIES, TOP_PER_DEPARTMENT, chunk), version)
    own = ready.sparkSession.createDataFrame([("meta.json", "meta", compact(catalogue))], "path string, kind string, json string")
    return publish(ready.drop("items").unionByName(own), out, ARTIFACT_SCHEMAS)
