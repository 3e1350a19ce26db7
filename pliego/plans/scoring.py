"""Scores of contracts, entities, municipalities and suppliers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pliego.functions.casts import keyed
from pliego.functions.evidence import fired_list, object_json
from pliego.functions.numbers import combined, mean_of_parts, ratio, shrunk, tier, tier_order, weighted_mean, weighted_parts
from pliego.operators.dedup import keep_latest
from pliego.operators.joins import small
from pliego.operators.ranking import percentiles
from pliego.operators.sketches import merged, quantile_sketches, quantiles, repeated
from pliego.params import Params
from pliego.plans import flags
from pliego.plans.marts import Mart
from pliego.session import cut

CONTRACT = ["id_contrato", "nit_entidad_norm", "nombre_entidad", "doc_proveedor_norm", "nombre_proveedor", "cod_dpto", "cod_mpio", "valor_contrato", "fecha_firma", "anio", "urlproceso", "source"]


#: Rows of one contract id from which on they are combined before they are shuffled.
OFTEN = 100_000


def repeated_ids(contracts: DataFrame) -> list[str]:
    """The ids that may have OFTEN rows or more, from a sketch."""
    return repeated(contracts, F.col("id_contrato"), OFTEN)


def per_key(found: DataFrame, p: Params, level: str, often: Sequence[str] | None = None) -> DataFrame:
    """key, n_flags_aplicables, n_flags_disparados, score and, if they hold evidence, flags_disparados from folded flags, or from rows of a flag table.

    A key's rows of one flag count once, as fired if any has; the evidence is that of a fired row, the largest as text. All flags
    of a key come from one aggregation, which combines rows before they are shuffled. Where rows have _row, it gives the key's newest too.
    often: the keys of many rows, if known. Rows with _row, or with evidence as structures, are wide and seldom share a key, and combining them would sort all
    rows of a task, so that only those of these keys are combined first.
    """
    found = flags.folded_rows(found, p, level) if "flag_id" in found.columns else found
    bits, weights = flags.level_flags(p, level), {k: int(w) for k, (_, _, w) in p.weights.items()}
    told = [c for c in found.columns if c.startswith("evidence_")]
    typed = [c for c in told if found.schema[c].dataType.typeName() == "struct"]
    newest = [F.max("_row").alias("_row")] if "_row" in found.columns else []
    combined_rows = lambda rows, evidence: rows.groupBy("key").agg(F.bit_or("on").alias("on"), F.bit_or("fired").alias("fired"), *newest, *evidence)
    wide = often is not None and bool(newest or typed)
    if wide and often:
        many = F.coalesce(F.col("key").isin(*often), F.lit(False))
        largest = [F.max_by(c, object_json(F.col(c)) if c in typed else F.col(c)).alias(c) for c in told]
        found = found.where(~many).unionByName(combined_rows(found.where(many), largest))
    rows = (found.repartition("key") if wide else found).withColumns({c: object_json(F.col(c)) for c in typed})
    once = combined_rows(rows, [F.max(c).alias(c) for c in told])
    has = lambda c, k: F.col(c).bitwiseAND(F.lit(bits[k])) != 0
    total = lambda c: reduce(Column.__add__, [F.when(has(c, k), F.lit(weights[k])).otherwise(0) for k in bits])
    listed = [fired_list({k: (has("fired", k), F.col(f"evidence_{k}") if f"evidence_{k}" in told else F.lit(None).cast("string")) for k in bits}, p).alias("flags_disparados")] if told else []
    counts = [F.bit_count(c).cast("long").alias(n) for c, n in (("on", "n_flags_aplicables"), ("fired", "n_flags_disparados"))]
    return once.select("key", *(["_row"] if newest else []), *counts, ratio(total("fired") * 100.0, total("on")).alias("score"), *listed)


def evidence_of(mart: Mart, keys: DataFrame, p: Params | None = None) -> DataFrame:
    """(key, flags_disparados) of those of a bounded list of contracts (column key) to which a flag applies: for lists that show a few of many contracts."""
    p = p or Params()
    rows = flags.folded(mart, p).join(small(keys.select("key")), "key", "left_semi")
    return per_key(rows, p, "contract").select("key", "flags_disparados")


def fired_lists(mart: Mart, p: Params | None = None) -> DataFrame:
    """(key, flags_disparados) of all contracts in which a flag fires. Rows in which none does are not shuffled, nor is any other column of contracts."""
    p = p or Params()
    rows = flags.folded(mart, p).where("fired != 0 AND key IS NOT NULL")
    return per_key(rows, p, "contract", repeated_ids(mart["fct_contrato"])).select("key", "flags_disparados")


def _with_flags(rows: DataFrame, key: str, found: DataFrame) -> DataFrame:
    joined = rows.join(found, F.col(key) == F.col("key"), "left").drop("key")
    whole = joined.fillna(0, ["n_flags_aplicables", "n_flags_disparados"])
    return whole.fillna("[]", ["flags_disparados"]) if "flags_disparados" in whole.columns else whole


#: Columns of contracts that are had on demand only.
MORE = ["modalidad_norm"]


def kept(columns: Sequence[str]) -> list[str]:
    return [c for c in [*CONTRACT, *MORE] if c in columns and c != "id_contrato"]


def contract_scores(mart: Mart, found: DataFrame, p: Params | None = None, columns: Sequence[str] = CONTRACT) -> DataFrame:
    """contrato_score: each contract id once, its latest row; null where no flag applies. columns: those of contracts that are wanted beside the id.

    Rows of flags that have _row bring them along: contracts are shuffled by their id once, for flags and columns together.
    """
    p = p or Params()
    wanted = kept(columns)
    if "_row" in found.columns:
        once = per_key(found.where("key IS NOT NULL"), p, "contract", repeated_ids(mart["fct_contrato"]))
        rows = once.select(F.col("key").alias("id_contrato"), *[f"_row.{c}" for c in wanted], *[c for c in once.columns if c not in ("key", "_row")])
    else:
        rows = keep_latest(mart["fct_contrato"], ["id_contrato"], "fecha_firma", "row_id").select("id_contrato", *wanted)
        rows = _with_flags(rows, "id_contrato", per_key(found, p, "contract"))
    return rows.withColumn("tier", tier(F.col("score"), p))


def _level_means(rows: DataFrame, keys: list[str], value: str, weight: str) -> tuple[DataFrame, DataFrame]:
    """Weighted means with fallback: by keys (column group_mean) and over all (national_mean, one row), from one pass over the rows."""
    parts = rows.where(F.col(value).isNotNull()).groupBy(*keys).agg(*weighted_parts(F.col(value), F.col(weight)))
    names = ["wv", "w", "v", "n"]
    national = parts.agg(*[F.sum(c).alias(c) for c in names]).select(mean_of_parts(*map(F.col, names)).alias("national_mean"))
    return parts.select(*keys, mean_of_parts(*map(F.col, names)).alias("group_mean")), national


def _group_mean(compat: bool) -> Column:
    """The department's mean, else the national one; compat takes a department's mean of exactly 0 as missing."""
    own = F.nullif(F.col("group_mean"), F.lit(0.0)) if compat else F.col("group_mean")
    return F.coalesce(own, F.col("national_mean"))


def _shrunk(rows: DataFrame, raw: str, n: str, p: Params, compat: bool) -> DataFrame:
    rows = rows.withColumn("dept_mean_score", _group_mean(compat)).withColumn("k_shrinkage", F.lit(p.shrink_k))
    rows = rows.withColumn("score", shrunk(F.col(raw), F.col("dept_mean_score"), F.col(n), p.shrink_k))
    return rows.withColumns({"tier": tier(F.col("score"), p), "datos_insuficientes": F.col(n) < p.min_contracts}).drop("group_mean", "national_mean")


def entity_scores(mart: Mart, contract_score: DataFrame, found: DataFrame, p: Params | None = None, compat: bool = False) -> DataFrame:
    """entidad_score: contracts' value-weighted mean and the entity's own flags, drawn to the department's mean."""
    p = p or Params()
    own = contract_score.where(keyed(F.col("nit_entidad_norm")) & F.col("score").isNotNull()).groupBy("nit_entidad_norm").agg(weighted_mean(F.col("score"), F.col("valor_contrato")).alias("contract_component"))
    own_flags = per_key(found, p, "entity").withColumnRenamed("score", "entity_component")
    rows = mart["dim_entidad"].select("nit_entidad_norm", "nombre_entidad", "cod_dpto", "cod_mpio", "n_contratos", "valor_total").join(own, "nit_entidad_norm", "left")
    rows = _with_flags(rows, "nit_entidad_norm", own_flags)
    rows = rows.withColumn("combined_raw_score", combined(F.col("contract_component"), F.col("entity_component"), p.total_weight("contract"), p.total_weight("entity")))
    means, national = _level_means(rows, ["cod_dpto"], "combined_raw_score", "valor_total")
    means = means.withColumnRenamed("cod_dpto", "_dpto")
    rows = rows.join(means, F.col("cod_dpto").eqNullSafe(F.col("_dpto")), "left").drop("_dpto").crossJoin(F.broadcast(national))  # one row
    return _shrunk(rows, "combined_raw_score", "n_contratos", p, compat)


def municipality_scores(mart: Mart, contract_score: DataFrame, p: Params | None = None, compat: bool = False) -> DataFrame:
    """municipio_score: scored contracts of each municipality, drawn to the mean of its department's contracts."""
    p = p or Params()
    keys = ["cod_dpto", "cod_mpio"]
    parts = contract_score.where("cod_dpto IS NOT NULL AND cod_mpio IS NOT NULL AND score IS NOT NULL").groupBy(*keys).agg(*weighted_parts(F.col("score"), F.col("valor_contrato")))
    names = ["wv", "w", "v", "n"]
    sums = [F.sum(c).alias(c) for c in names]
    mean = lambda: mean_of_parts(*map(F.col, names))
    dept = parts.groupBy("cod_dpto").agg(*sums).select("cod_dpto", mean().alias("group_mean"))
    national = parts.agg(*sums).select(mean().alias("national_mean"))
    rows = parts.select(*keys, F.col("n").alias("n_contratos"), F.col("w").alias("valor_total"), mean().alias("raw_score"))
    rows = rows.join(dept, "cod_dpto").crossJoin(F.broadcast(national))  # one row
    places = mart["divipola"].groupBy(*keys).agg(F.min("dpto").alias("dpto"), F.min("municipio").alias("municipio"))
    return _shrunk(rows.join(places, keys, "left"), "raw_score", "n_contratos", p, compat)


def supplier_scores(mart: Mart, contract_score: DataFrame, p: Params | None = None) -> DataFrame:
    """Suppliers with a scored contract: their value-weighted mean, drawn to the national one."""
    p = p or Params()
    scored = contract_score.where(keyed(F.col("doc_proveedor_norm")) & F.col("score").isNotNull())
    means, national = _level_means(scored, ["doc_proveedor_norm"], "score", "valor_contrato")
    rows = mart["dim_proveedor"].select("doc_proveedor_norm", "nombre_proveedor", "es_persona_natural", "n_contratos", "valor_total").join(means, "doc_proveedor_norm").crossJoin(F.broadcast(national))  # one row
    score = shrunk(F.col("group_mean"), F.col("national_mean"), F.col("n_contratos"), p.shrink_k)
    rows = rows.withColumn("score", score).drop("group_mean", "national_mean")
    return rows.withColumns({"tier": tier(F.col("score"), p), "datos_insuficientes": F.col("n_contratos") < p.min_contracts})


def tier_counts(scores: DataFrame, p: Params | None = None) -> DataFrame:
    """tier, n, in the order of the tiers, highest first; rows without a score at the end."""
    p = p or Params()
    return scores.groupBy("tier").agg(F.count("*").alias("n")).withColumn("tier_order", tier_order(F.col("tier"), p)).orderBy(F.col("tier_order").asc_nulls_last())


SHARES = (0.5, 0.75, 0.9, 0.95, 0.99, 0.999, 1.0)


def distribution(scores: DataFrame, shares: Sequence[float] = SHARES) -> DataFrame:
    """(share, value): exact percentiles of the scores."""
    return percentiles(scores, "score", shares)


def monthly_sketches(scores: DataFrame) -> DataFrame:
    """(anio, mes, n, sketch): the scores of each month of signature, to be kept; those of a new month are added without reading the others."""
    dated = scores.where("fecha_firma IS NOT NULL AND score IS NOT NULL")
    return quantile_sketches(dated, F.col("score"), [F.year("fecha_firma").alias("anio"), F.month("fecha_firma").alias("mes")])


def sketched_distribution(sketches: DataFrame, by: Sequence[str] = (), shares: Sequence[float] = SHARES) -> DataFrame:
    """(by, n, share, value): the percentiles of scores from kept sketches, over the columns `by` or over everything; see sketches.RANK_ERROR."""
    return quantiles(merged(sketches, by), shares)


SCORES = ("contrato_score", "entidad_score", "municipio_score", "proveedor_score")
TABLES = ("flag_contrato", "flag_entidad", *SCORES)


#: What the other score tables read of contracts.
GROUPED = {"entidad_score": ("nit_entidad_norm", "valor_contrato"), "municipio_score": ("cod_dpto", "cod_mpio", "valor_contrato"), "proveedor_score": ("doc_proveedor_norm", "valor_contrato")}


def run(mart: Mart, p: Params | None = None, wanted: Sequence[str] = TABLES, evidence: bool = True, columns: Sequence[str] = CONTRACT) -> Mart:
    """The mart with the flag and score tables wanted; no others are planned.

    Contract scores, on which the other scores build, are computed once and written. The rest are plans, computed if they are used.
    evidence: whether contracts have the list of their fired flags (flags_disparados); `evidence_of` gives those of a few of them.
    columns: those of contracts that contrato_score has; what is written grows with them.
    """
    p = p or Params()
    needed = {*(columns if "contrato_score" in wanted else ()), *(c for name, read in GROUPED.items() if name in wanted for c in read)}
    if "entidad_score" in wanted:
        mart = mart | {"dim_entidad": cut(mart["dim_entidad"])}  # a row for each entity, read by its scores and by F04, where it is planned from all contracts
    contract = cut(contract_scores(mart, flags.folded(mart, p, evidence=evidence, columns=kept(tuple(needed))), p, tuple(needed))) if set(wanted) & set(SCORES) else None
    plans = {
        "flag_contrato": lambda: flags.run(mart, p, "contract"),
        "flag_entidad": lambda: flags.run(mart, p, "entity"),
        "contrato_score": lambda: contract,
        "entidad_score": lambda: entity_scores(mart, contract, flags.folded(mart, p, "entity"), p),
        "municipio_score": lambda: municipality_scores(mart, contract, p),
        "proveedor_score": lambda: supplier_scores(mart, contract, p),
    }
    return mart | {name: plans[name]() for name in wanted}
