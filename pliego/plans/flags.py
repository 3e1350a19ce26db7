"""Fourteen red flags. Each returns its applicable population only: key, fired, and the evidence as columns.

A row that can't be tested is absent, as it must not count in a score's denominator; absence is never filled with false.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pliego.functions.casts import keyed, lenient_double
from pliego.functions.evidence import as_json
from pliego.functions.numbers import is_multiple, ratio
from pliego.functions.text import object_key
from pliego.operators.dedup import keep_first, keep_latest
from pliego.operators.joins import in_range, small, threshold
from pliego.operators.sketches import repeated
from pliego.operators.windows import around, buckets, switches_between_days, switches_within_days
from pliego.params import Params
from pliego.plans.marts import Mart
from pliego.session import cut


#: Tables of two or three short columns: so many rows are still few enough to be sent to every task.
NARROW_ROWS = 1_000_000
#: Rows of one key from which on they are combined before they are shuffled.
OFTEN = 100_000


@dataclass(frozen=True)
class Rule:
    """A flag that one row, with what is joined to it, decides: where it applies, where it fires, and its evidence."""

    applies: Column
    fires: Column
    evidence: dict[str, Column]


def _yes(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def applied(rows: DataFrame, rule: Rule) -> DataFrame:
    return rows.where(rule.applies).select(contract_key(), rule.fires.alias("fired"), *[c.alias(name) for name, c in rule.evidence.items()])


def contract_key() -> Column:
    return F.col("id_contrato").alias("key")


# What is joined to contracts


def latest_processes(mart: Mart) -> DataFrame:
    """Each process once, its latest snapshot: joining all of them would count contracts several times."""
    return keep_latest(mart["fct_proceso"], ["referencia"], "fecha_publicacion", "row_id")


def with_process(mart: Mart, contracts: DataFrame, *columns: str) -> DataFrame:
    """Contracts with columns of their process, prefixed p_, null where there is none. A rule that needs one makes the join an inner one.

    Contracts that were written with them have them already.
    """
    if {f"p_{c}" for c in columns} <= set(contracts.columns):
        return contracts
    right = latest_processes(mart).select(F.col("referencia").alias("p_key"), *[F.col(c).alias(f"p_{c}") for c in columns])
    return contracts.join(right, F.col("proceso_de_compra") == F.col("p_key"), "left").drop("p_key")


def with_registration(mart: Mart, contracts: DataFrame) -> DataFrame:
    """Contracts with their supplier's fecha_matricula; null where there is no register."""
    dim = mart["dim_proveedor"]
    if "fecha_matricula" not in dim.columns:
        return contracts.withColumn("fecha_matricula", F.lit(None).cast("date"))
    return contracts.join(dim.where(F.col("fecha_matricula").isNotNull()).select("doc_proveedor_norm", "fecha_matricula"), "doc_proveedor_norm", "left")


def with_additions(mart: Mart, contracts: DataFrame) -> DataFrame:
    """Contracts with the sum of their additions, which those of the older platform have; contracts are read once."""
    none = F.lit(None).cast("double")
    if "stg_secop1" not in mart:
        return contracts.withColumn("added", none)
    # the others, most of the rows, can have no sum and are not shuffled for it
    return _old_with_additions(mart, contracts.where(_may_be_added_to())).unionByName(contracts.where(~_may_be_added_to()).withColumn("added", none))


def _may_be_added_to() -> Column:
    return _yes(F.col("source") == "SECOP1") & F.col("row_id").isNotNull()


def _old_with_additions(mart: Mart, contracts: DataFrame) -> DataFrame:
    sums = keep_latest(mart["stg_secop1"], [":id"], "valor_total_de_adiciones").select(F.col("`:id`").alias("s_id"), lenient_double(F.col("valor_total_de_adiciones")).alias("added"))
    return contracts.join(sums, F.col("row_id") == F.col("s_id"), "left").drop("s_id")


def with_window(mart: Mart, contracts: DataFrame) -> DataFrame:
    """Contracts with the election window of their signature, if any."""
    windows = mart["ref_ventanas"].select("window_id", F.col("tipo").alias("tipo_ventana"), "inicio", "fin")
    return in_range(contracts, "fecha_firma", windows, "inicio", "fin").drop("inicio", "fin")


# Flags that a row decides


def rule01(p: Params) -> Rule:
    """Single bidder: competitive contracts whose process counts its bidders."""
    n = F.col("p_num_oferentes_unicos")
    return Rule(F.col("es_competitiva") & n.isNotNull(), n == p.bidders, {"num_oferentes_unicos": n, "num_respuestas": F.col("p_num_respuestas")})


def rule02(p: Params) -> Rule:
    """Express company: registered at most some days before the process was published. No register, no rows."""
    days = F.datediff("p_fecha_publicacion", "fecha_matricula")
    return Rule(days.isNotNull(), days.between(0, p.express_days), {"dias_desde_matricula": days, "fecha_matricula": F.col("fecha_matricula"), "fecha_publicacion": F.col("p_fecha_publicacion")})


def rule03(p: Params) -> Rule:
    """Excessive additions, in days or in money; each platform tells the added money in its own way."""
    by_time = _yes(F.col("duracion_dias_inicial") > 0)
    by_award = _yes((F.col("source") == "SECOP2") & (F.col("p_valor_adjudicacion") > 0))
    by_sum = _yes((F.col("source") == "SECOP1") & F.col("added").isNotNull() & (F.col("valor_contrato") > 0))
    money = F.when(by_award, ratio(F.col("valor_contrato"), F.col("p_valor_adjudicacion")) - 1).when(by_sum, ratio(F.col("added"), F.col("valor_contrato")))
    in_time = by_time & _yes(F.col("dias_adicionados") >= p.added_days_ratio * F.col("duracion_dias_inicial"))
    in_money = _yes(money >= p.added_money_ratio)
    evidence = {"source": F.col("source"), "dias_adicionados": F.col("dias_adicionados"), "duracion_dias_inicial": F.col("duracion_dias_inicial"), "f03_tiempo": in_time, "ratio_adicion_dinero": money, "f03_dinero": in_money}
    return Rule(by_time | by_award | by_sum, in_time | in_money, evidence | {"fuente_dinero": F.when(by_award, F.lit("secop2_join")).when(by_sum, F.lit("secop1_directo"))})


def rule07(p: Params) -> Rule:
    """Short bidding window, in calendar days; dates in the wrong order are not tested."""
    floors = reduce(lambda rest, m: F.when(F.col("modalidad_norm") == m[0], F.lit(m[1])).otherwise(rest), p.floor_days.items(), F.lit(None).cast("int"))
    days = F.datediff("p_fecha_recepcion_respuestas", "p_fecha_publicacion")
    return Rule(F.col("es_competitiva") & floors.isNotNull() & (days >= 0), days < floors, {"modalidad_norm": F.col("modalidad_norm"), "dias_ventana": days, "piso_dias": floors})


def rule08(p: Params) -> Rule:
    """Copied price: the contract's value is that of the official estimate."""
    off = F.abs(ratio(F.col("valor_contrato"), F.col("p_precio_base")) - 1)
    return Rule(F.col("es_competitiva") & F.col("valor_contrato").isNotNull() & (F.col("p_precio_base") > 0), off <= p.price_tolerance, {"valor_contrato": F.col("valor_contrato"), "precio_base": F.col("p_precio_base"), "desviacion_pct": off})


def rule09(p: Params) -> Rule:
    """December rush."""
    signed = F.col("fecha_firma")
    return Rule(signed.isNotNull(), (F.month(signed) == p.rush_month) & (F.dayofmonth(signed) >= p.rush_day), {"fecha_firma": signed})


def rule10(p: Params) -> Rule:
    """Direct contracts signed in a window before an election."""
    signed = F.col("fecha_firma")
    return Rule((F.col("modalidad_norm") == p.direct) & signed.isNotNull(), F.col("window_id").isNotNull(), {"fecha_firma": signed, "window_id": F.col("window_id"), "tipo_ventana": F.col("tipo_ventana")})


def rule14(p: Params) -> Rule:
    """Round value."""
    value = F.col("valor_contrato")
    return Rule(value.isNotNull(), (value >= p.round_min) & is_multiple(value, p.round_unit), {"valor_contrato": value})


ROW_RULES: dict[str, Callable[[Params], Rule]] = {"F01": rule01, "F02": rule02, "F03": rule03, "F07": rule07, "F08": rule08, "F09": rule09, "F10": rule10, "F14": rule14}
PROCESS = ("num_oferentes_unicos", "num_respuestas", "fecha_publicacion", "fecha_recepcion_respuestas", "precio_base", "valor_adjudicacion")


def f01(mart: Mart, p: Params) -> DataFrame:
    return applied(with_process(mart, mart["fct_contrato"], "num_oferentes_unicos", "num_respuestas"), rule01(p))


def f02(mart: Mart, p: Params) -> DataFrame:
    return applied(with_registration(mart, with_process(mart, mart["fct_contrato"], "fecha_publicacion")), rule02(p))


def f03(mart: Mart, p: Params) -> DataFrame:
    return applied(with_additions(mart, with_process(mart, mart["fct_contrato"], "valor_adjudicacion")), rule03(p))


def f07(mart: Mart, p: Params) -> DataFrame:
    return applied(with_process(mart, mart["fct_contrato"], "fecha_publicacion", "fecha_recepcion_respuestas"), rule07(p))


def f08(mart: Mart, p: Params) -> DataFrame:
    return applied(with_process(mart, mart["fct_contrato"], "precio_base"), rule08(p))


def f09(mart: Mart, p: Params) -> DataFrame:
    return applied(mart["fct_contrato"], rule09(p))


def f10(mart: Mart, p: Params) -> DataFrame:
    return applied(with_window(mart, mart["fct_contrato"].where(F.col("modalidad_norm") == p.direct)), rule10(p))


def f14(mart: Mart, p: Params) -> DataFrame:
    return applied(mart["fct_contrato"], rule14(p))


def with_all(mart: Mart) -> DataFrame:
    """Contracts with all that the row rules need: read once, and joined once with their process."""
    return with_window(mart, with_registration(mart, with_process(mart, with_additions(mart, mart["fct_contrato"]), *PROCESS)))


def row_flags(mart: Mart, p: Params, wanted: Sequence[str] = tuple(ROW_RULES), fired_only: bool = False) -> DataFrame:
    """All flags that a row decides, in the long shape: contracts are read and joined with their process once for all of them."""
    rows = with_all(mart)
    rules = {flag_id: ROW_RULES[flag_id](p) for flag_id in wanted}
    tested = rows.withColumns({f"_on_{k}": r.applies for k, r in rules.items()} | {f"_fired_{k}": r.fires for k, r in rules.items()})
    found = []
    for k, rule in rules.items():
        evidence = as_json(*[c.alias(name) for name, c in rule.evidence.items()])
        own = F.struct(F.lit(k).alias("flag_id"), F.col(f"_fired_{k}").alias("fired"), (F.when(F.col(f"_fired_{k}"), evidence) if fired_only else evidence).alias("evidence_json"))
        found.append(F.when(F.col(f"_on_{k}"), own))
    return tested.select(contract_key(), F.explode(F.array(*found)).alias("x")).where(F.col("x").isNotNull()).select("key", "x.*")


# Flags that need a contract's neighbours


def f04(mart: Mart, p: Params) -> DataFrame:
    """Abuse of direct contracting: an entity's direct share lies far above its peers'. Peers share a department, and a level if known."""
    peers = [c for c in ("nivel_entidad", "cod_dpto") if c in mart["dim_entidad"].columns]
    own = mart["fct_contrato"].where(keyed(F.col("nit_entidad_norm")) & F.col("valor_contrato").isNotNull()).groupBy("nit_entidad_norm")
    own = own.agg(F.sum(F.when(F.col("modalidad_norm") == p.direct, F.col("valor_contrato"))).alias("_direct"), F.sum("valor_contrato").alias("_all"), F.count("*").alias("n_contratos"))
    dim = mart["dim_entidad"].select("nit_entidad_norm", "nombre_entidad", *peers).dropna(subset=peers)
    share = own.where(F.col("n_contratos") >= p.direct_min_contracts).join(dim, "nit_entidad_norm").withColumn("share_directa", ratio(F.coalesce("_direct", F.lit(0.0)), F.col("_all")))
    share = cut(share)  # a row for each entity, read twice
    stats = share.groupBy(*peers).agg(F.avg("share_directa").alias("mean_share_peers"), F.stddev_pop("share_directa").alias("sd_share_peers"), F.count("*").alias("n_peers"))
    rows = share.join(stats.where(F.col("n_peers") >= p.direct_min_peers), peers)
    rows = rows.withColumn("z_score", ratio(F.col("share_directa") - F.col("mean_share_peers"), F.col("sd_share_peers"))).where(F.col("z_score").isNotNull())
    return rows.select(F.col("nit_entidad_norm").alias("key"), (F.col("z_score") >= p.direct_z).alias("fired"), "nombre_entidad", *peers, "share_directa", "mean_share_peers", "sd_share_peers", "n_peers", "n_contratos", "z_score")


SPLITTING_GROUP = ("nit_entidad_norm", "doc_proveedor_norm", "unspsc_segmento")


def _may_split(p: Params) -> Column:
    c = F.col
    return _yes((c("modalidad_norm") == p.direct) & keyed(c("nit_entidad_norm")) & keyed(c("doc_proveedor_norm")) & c("unspsc_segmento").isNotNull() & c("fecha_firma").isNotNull() & c("valor_contrato").isNotNull())


def f05(mart: Mart, p: Params) -> DataFrame:
    """Splitting: several direct contracts of one entity, supplier and segment lie close in time and together exceed a limit."""
    return _split(mart, mart["fct_contrato"].where(_may_split(p)), p)


def _split(mart: Mart, rows: DataFrame, p: Params) -> DataFrame:
    keys, c = list(SPLITTING_GROUP), F.col
    near = around(rows, keys, "fecha_firma", p.split_days, "valor_contrato", "n_contratos_ventana", "suma_valor_ventana")
    wages = mart["ref_smmlv"].select(c("year").alias("anio"), "value_cop")
    near = near.join(wages, "anio").withColumn("umbral_smmlv_cop", c("value_cop") * p.split_wages)
    fired = (c("n_contratos_ventana") >= p.split_min_contracts) & (c("suma_valor_ventana") > c("umbral_smmlv_cop"))
    return near.select(contract_key(), fired.alias("fired"), *keys, "fecha_firma", "n_contratos_ventana", "suma_valor_ventana", "umbral_smmlv_cop")


def of_large_groups(rows: DataFrame, group: Sequence[str], least: int) -> DataFrame:
    """Rows of groups of at least so many: counts are combined before they are shuffled, and smaller groups' rows go no further."""
    large = cut(rows.groupBy(*group).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select(*group))
    return rows.join(small(large, NARROW_ROWS), list(group), "left_semi")


def splitting(mart: Mart, p: Params) -> DataFrame:
    """The rows of F05 that fire, which only those of groups with enough contracts can."""
    rows = mart["fct_contrato"].where(_may_split(p)).select("id_contrato", *SPLITTING_GROUP, "fecha_firma", "valor_contrato", "anio")
    return _split(mart, of_large_groups(rows, SPLITTING_GROUP, p.split_min_contracts), p).where("fired")


ROTATION_GROUP = ("nit_entidad_norm", "unspsc_segmento")


def _may_rotate() -> Column:
    c = F.col
    return _yes(c("es_competitiva") & keyed(c("nit_entidad_norm")) & keyed(c("doc_proveedor_norm")) & c("unspsc_segmento").isNotNull() & c("fecha_firma").isNotNull())


def rotations(rows: DataFrame, p: Params) -> tuple[DataFrame, DataFrame]:
    """(groups with their first day, groups and stretches of time with their counts and whether they fire)."""
    c = F.col
    group = list(ROTATION_GROUP)
    first = rows.groupBy(*group).agg(F.min("fecha_firma").alias("first"))
    bucketed = lambda df: buckets(df, group, "fecha_firma", p.rotation_days, first=first)
    keys = [*group, "bucket"]
    daily_wins = rows.groupBy(*group, "fecha_firma", "doc_proveedor_norm").agg(F.count("*").alias("_wins"))
    wins = bucketed(daily_wins).groupBy(*keys, "doc_proveedor_norm").agg(F.sum("_wins").alias("_wins"))
    winners = wins.groupBy(*keys).agg(F.count("*").alias("n_ganadores_distintos"), F.min("_wins").alias("_least"))
    moves = switches_between_days(bucketed(switches_within_days(rows, group, "doc_proveedor_norm", "fecha_firma", "id_contrato")), keys, "fecha_firma")
    stats = winners.join(moves, keys).withColumns({"participacion_minima_ganador": c("_least") / c("n"), "indice_alternancia": F.coalesce(F.try_divide("n_switches", c("n") - 1), F.lit(0.0))})
    fired = (c("n") >= p.rotation_min_contracts) & c("n_ganadores_distintos").between(*p.rotation_winners) & (c("participacion_minima_ganador") >= p.rotation_min_share) & (c("indice_alternancia") >= p.rotation_min_alternation)
    return first, stats.select(*keys, fired.alias("fired"), c("n").alias("n_procesos_grupo"), "n_ganadores_distintos", "participacion_minima_ganador", "indice_alternancia")


def f06(mart: Mart, p: Params) -> DataFrame:
    """Rotation: within a stretch of time, an entity's contracts of one segment go round among few winners."""
    group = list(ROTATION_GROUP)
    rows = mart["fct_contrato"].where(_may_rotate()).select("id_contrato", *group, "doc_proveedor_norm", "fecha_firma")
    return _rotated(rows, *rotations(rows, p), p)


def _rotated(rows: DataFrame, first: DataFrame, stats: DataFrame, p: Params) -> DataFrame:
    group = list(ROTATION_GROUP)
    bucketed = buckets(rows, group, "fecha_firma", p.rotation_days, first=first)
    return bucketed.join(stats, [*group, "bucket"]).select(contract_key(), "fired", *group, F.col("bucket").alias("bucket_24m"), "doc_proveedor_norm", "n_procesos_grupo", "n_ganadores_distintos", "participacion_minima_ganador", "indice_alternancia")


def rotating(mart: Mart, p: Params) -> DataFrame:
    """The rows of F06 that fire, which only those of groups with enough contracts can."""
    group = list(ROTATION_GROUP)
    rows = mart["fct_contrato"].where(_may_rotate()).select("id_contrato", *group, "doc_proveedor_norm", "fecha_firma")
    rows = cut(of_large_groups(rows, group, p.rotation_min_contracts))
    first, stats = rotations(rows, p)
    return _rotated(rows, first, stats.where("fired"), p)


def _listed(sources: Column) -> Column:
    return F.nullif(F.array_join(F.array_sort(sources), ", "), F.lit(""))


def f11(mart: Mart, p: Params) -> DataFrame:
    """Sanctioned supplier: sanctions strictly before the signature fire; all of them are context.

    Sanctions meet each (supplier, day of signature) once, not each contract.
    """
    rows = cut(mart["fct_contrato"].where(keyed(F.col("doc_proveedor_norm"))).select("id_contrato", "doc_proveedor_norm", "fecha_firma"))
    days = rows.select("doc_proveedor_norm", "fecha_firma").distinct()
    given = mart["sanciones"].groupBy(F.col("doc_norm").alias("doc_proveedor_norm"), "fecha_sancion", "fuente").agg(F.count("*").alias("_n"))
    before = F.col("fecha_sancion") < F.col("fecha_firma")
    listed = lambda c: _listed(F.collect_set(c))  # noqa: E731  as many as there are sources
    found = days.join(given, "doc_proveedor_norm").groupBy("doc_proveedor_norm", F.col("fecha_firma").alias("_day")).agg(
        F.coalesce(F.sum(F.when(before, F.col("_n"))), F.lit(0)).alias("_before"), F.sum("_n").alias("_all"), listed(F.when(before, F.col("fuente"))).alias("fuentes_antes_firma"), listed(F.col("fuente")).alias("fuentes_total_contexto"),
        F.max(F.when(before, F.col("fecha_sancion"))).alias("sancion_mas_reciente_antes_firma"),
    )
    right = found.withColumnRenamed("doc_proveedor_norm", "_doc")
    joined = rows.join(right, (F.col("doc_proveedor_norm") == F.col("_doc")) & F.col("fecha_firma").eqNullSafe(F.col("_day")), "left")
    n = lambda c: F.coalesce(c, F.lit(0))
    return joined.select(
        contract_key(), (n("_before") > 0).alias("fired"), n("_before").alias("n_sanciones_antes_firma"), n("_all").alias("n_sanciones_total_contexto"),
        "fuentes_antes_firma", "fuentes_total_contexto", "sancion_mas_reciente_antes_firma"
    )


def f12(mart: Mart, p: Params) -> DataFrame:
    """Concentration: in a year, an entity's largest supplier takes most of its value, or lives off this entity. One row per entity and year.

    Contracts are shuffled once, by entity and year, and summed there; only those of the keys that a sketch finds often are summed by supplier first.
    """
    c, year = F.col, ["nit_entidad_norm", "anio"]
    rows = mart["fct_contrato"].where(c("valor_contrato").isNotNull() & c("anio").isNotNull()).select(*year, "doc_proveedor_norm", "valor_contrato")
    of_entity, of_supplier = keyed(c("nit_entidad_norm")), keyed(c("doc_proveedor_norm"))
    supplier = rows.where(of_supplier).groupBy("doc_proveedor_norm", "anio").agg(F.sum("valor_contrato").alias("_supplier"), F.count("*").alias("n_contratos_proveedor_anual"))

    def largest(some: DataFrame) -> DataFrame:
        own = Window.partitionBy(*year)
        pair = some.groupBy(*year, "doc_proveedor_norm").agg(F.sum("valor_contrato").alias("_pair"), F.count("*").alias("_n"))
        pair = pair.withColumns({"_entity": F.sum("_pair").over(own), "n_contratos_entidad_anual": F.sum("_n").over(own)})
        return keep_first(pair.where((c("n_contratos_entidad_anual") >= p.concentration_min_contracts) & of_supplier), year, [c("_pair").desc(), c("doc_proveedor_norm")])

    rows, key = rows.where(of_entity), F.xxhash64(*year)
    often = repeated(rows, key, OFTEN)
    top = largest(rows.where(~key.isin(*often)).repartition(*year))
    if often:
        top = top.unionByName(largest(rows.where(key.isin(*often))))
    top = top.join(supplier, ["doc_proveedor_norm", "anio"]).withColumns({"share": ratio(c("_pair"), c("_entity")), "dependence": ratio(c("_pair"), c("_supplier"))})
    captured = F.coalesce(c("share") > p.entity_share, F.lit(False))
    dependent = F.coalesce((c("dependence") > p.supplier_share) & (c("n_contratos_proveedor_anual") >= p.concentration_min_contracts), F.lit(False))
    return top.select(
        c("nit_entidad_norm").alias("key"), (captured | dependent).alias("fired"), "anio", c("doc_proveedor_norm").alias("doc_proveedor_dominante"), "n_contratos_entidad_anual", c("share").alias("participacion_proveedor_en_entidad"),
        captured.alias("condicion_a_captura_entidad"), "n_contratos_proveedor_anual", c("dependence").alias("dependencia_proveedor_en_entidad"), dependent.alias("condicion_b_dependencia_proveedor"),
    )


def _hashed_texts(rows: DataFrame) -> DataFrame:
    """Rows with two hashes of different seeds, 128 bits in all, that stand for the text: what is shuffled does not grow with it."""
    text = object_key(F.col("objeto_del_contrato"))
    return rows.withColumn("_text", text).withColumns({"_a": F.xxhash64("_text"), "_b": F.xxhash64(F.lit(1), "_text"), "longitud_objeto": F.length(F.trim("objeto_del_contrato"))}).drop("_text")


def _frequencies(rows: DataFrame, p: Params) -> tuple[DataFrame, DataFrame]:
    """(each text's hashes with its rows, one row of the frequency from which a text is repetitive)."""
    counts = rows.groupBy("_a", "_b").agg(F.count("*").alias("frecuencia_objeto"), F.min("longitud_objeto").alias("_least"))
    # one row per distinct frequency, weighted by the rows that have it
    border = counts.groupBy("frecuencia_objeto").agg(F.sum("frecuencia_objeto").alias("_rows")).agg(F.percentile("frecuencia_objeto", p.vague_percentile, F.col("_rows")).alias("umbral_decil_superior"))
    return counts, border


def f13(mart: Mart, p: Params) -> DataFrame:
    """Vague object: very short, or as frequent as the most repeated tenth of contracts' objects."""
    rows = _hashed_texts(mart["fct_contrato"].where(F.col("objeto_del_contrato").isNotNull()).select("id_contrato", "objeto_del_contrato")).drop("objeto_del_contrato")
    counts, border = _frequencies(rows, p)
    counts = counts.drop("_least")
    short, often = F.col("longitud_objeto") < p.vague_length, F.col("frecuencia_objeto") >= F.col("umbral_decil_superior")
    joined = threshold(rows.join(counts, ["_a", "_b"]), border)
    return joined.select(contract_key(), (short | often).alias("fired"), "longitud_objeto", "frecuencia_objeto", "umbral_decil_superior", short.alias("objeto_muy_corto"), often.alias("objeto_repetitivo"))


FLAGS: dict[str, Callable[[Mart, Params], DataFrame]] = {f.__name__.upper(): f for f in (f01, f02, f03, f04, f05, f06, f07, f08, f09, f10, f11, f12, f13, f14)}


def long_rows(flag_id: str, found: DataFrame, fired_only: bool = False) -> DataFrame:
    """key, flag_id, fired, evidence_json; fired_only: evidence of rows that fired, null for the others."""
    evidence = as_json(*[c for c in found.columns if c not in ("key", "fired")])
    return found.select("key", F.lit(flag_id).alias("flag_id"), "fired", (F.when(F.col("fired"), evidence) if fired_only else evidence).alias("evidence_json"))


def run(mart: Mart, p: Params | None = None, level: str = "contract", fired_only: bool = False) -> DataFrame:
    """All flags of a level in one long table. fired_only: evidence only where a flag fired, which is all that scores need."""
    p = p or Params()
    own = [f for f, (_, of, _) in p.weights.items() if of == level and f in FLAGS]
    by_row = [f for f in own if f in ROW_RULES]
    parts = [row_flags(mart, p, by_row, fired_only)] if by_row else []
    parts += [long_rows(f, FLAGS[f](mart, p), fired_only) for f in own if f not in ROW_RULES]
    return reduce(DataFrame.unionByName, parts)


def level_flags(p: Params, level: str) -> dict[str, int]:
    """The flags of a level and the bit that stands for each."""
    return {k: 1 << i for i, k in enumerate(k for k, (_, of, _) in p.weights.items() if of == level)}


def folded_rows(long: DataFrame, p: Params, level: str, evidence: bool = True) -> DataFrame:
    """Rows in the long shape as rows of `folded`."""
    bits = level_flags(p, level)
    is_flag = lambda k: F.col("flag_id") == k
    bit = reduce(lambda rest, k: F.when(is_flag(k), F.lit(bits[k])).otherwise(rest), bits, F.lit(0))
    told = [F.when(is_flag(k) & F.col("fired"), F.col("evidence_json")).alias(f"evidence_{k}") for k in bits] if evidence else []
    return long.where(F.col("flag_id").isin(*bits)).select("key", bit.alias("on"), F.when(F.col("fired"), bit).otherwise(0).alias("fired"), *told)


def folded_flag(flag_id: str, found: DataFrame, p: Params, level: str, evidence: bool = True) -> DataFrame:
    """Rows of one flag, with its evidence as columns, as rows of `folded`."""
    bit = F.lit(level_flags(p, level)[flag_id])
    told = [F.when(F.col("fired"), F.struct(*[c for c in found.columns if c not in ("key", "fired")])).alias(f"evidence_{flag_id}")] if evidence else []
    return found.select("key", bit.alias("on"), F.when(F.col("fired"), bit).otherwise(0).alias("fired"), *told)


def folded(mart: Mart, p: Params | None = None, level: str = "contract", evidence: bool = True, columns: Sequence[str] | None = None) -> DataFrame:
    """All flags of a level as scores need them: key, bits of the flags that apply (on) and fired, and if wanted the evidence of each that fired.

    A contract's row rules are one row; other flags add rows of their own. Without evidence a row is its key and two numbers. Evidence is a structure of
    its values, which takes less to shuffle and to sort than their text: what meets by key is written as JSON then, not before.
    columns: contracts come once a row, also where no flag applies, with _row, a structure that orders an id's rows from old to new and holds these columns.
    """
    p = p or Params()
    if level == "contract":
        return marked(mart, p, evidence, columns)
    bits = level_flags(p, level)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [folded_flag(k, FLAGS[k](mart, p), p, level, evidence) for k in bits if k in FLAGS])


def additions(mart: Mart, p: Params) -> DataFrame:
    """The rows of F03 of contracts that may have additions, which are of the older platform; no process tells anything of those."""
    rows = mart["fct_contrato"].where(_may_be_added_to()).select("id_contrato", "row_id", "source", "dias_adicionados", "duracion_dias_inicial", "valor_contrato")
    return applied(_old_with_additions(mart, rows).withColumn("p_valor_adjudicacion", F.lit(None).cast("double")), rule03(p))


def supplier_dates(mart: Mart, evidence: bool = False) -> DataFrame:
    """(_doc, fecha_matricula, _sanctioned): of suppliers in contracts, the registration and the first sanction.

    evidence: and _history, for each day of a sanction (null too) how many there were and their sources, so it is no longer than there are days.
    """
    none, dim = F.lit(None).cast("date"), mart["dim_proveedor"]
    registered = dim.where(F.col("fecha_matricula").isNotNull()).select(F.col("doc_proveedor_norm").alias("_doc"), "fecha_matricula") if "fecha_matricula" in dim.columns else None
    docs = mart["fct_contrato"].where(keyed(F.col("doc_proveedor_norm"))).select(F.col("doc_proveedor_norm").alias("_doc")).distinct()
    given = mart["sanciones"].withColumnRenamed("doc_norm", "_doc")
    first = F.min("fecha_sancion").alias("_sanctioned")
    if evidence:
        daily = given.groupBy("_doc", "fecha_sancion").agg(F.count("*").alias("n"), F.collect_set("fuente").alias("sources"))
        found = daily.groupBy("_doc").agg(first, F.collect_list(F.struct("fecha_sancion", "n", "sources")).alias("_history"))
    else:
        found = given.groupBy("_doc").agg(first)
    found = found.join(docs, "_doc", "left_semi")
    return found.join(registered, "_doc", "full_outer") if registered is not None else found.withColumn("fecha_matricula", none)


def _sanctions_told() -> dict[str, Column]:
    """The evidence of F11 from a supplier's _history."""
    every, total = F.col("_history"), lambda days: F.aggregate(days, F.lit(0).cast("long"), lambda n, x: n + x["n"])
    before = F.filter(every, lambda x: x["fecha_sancion"] < F.col("fecha_firma"))
    sources = lambda days: _listed(F.array_distinct(F.flatten(F.transform(days, lambda x: x["sources"]))))
    return {
        "n_sanciones_antes_firma": total(before), "n_sanciones_total_contexto": total(every), "fuentes_antes_firma": sources(before), "fuentes_total_contexto": sources(every),
        "sancion_mas_reciente_antes_firma": F.array_max(F.transform(before, lambda x: x["fecha_sancion"])),
    }


def marked(mart: Mart, p: Params, evidence: bool = False, columns: Sequence[str] | None = None) -> DataFrame:
    """`folded` contract flags: key, on, fired, if wanted the evidence of each flag and _row.

    Whether a flag applies is told by the contract and its process. What the contract alone decides is folded to two numbers before contracts are shuffled,
    once, as a few narrow columns, to meet their process, unless they were written with it. Suppliers' dates and repetitive texts meet them before that, as
    tables sent to every task where they are proven few. F05 and F06 add rows of contracts in which they fire, from groups that have enough contracts, and
    F03 those of contracts that may have additions, which alone meet them.
    Evidence is built in the same pass, only where a flag fires.
    """
    bits = level_flags(p, "contract")
    c = F.col
    total = lambda cs: reduce(Column.__add__, [F.when(_yes(x), F.lit(bits[k])).otherwise(0) for k, x in cs.items() if k in bits], F.lit(0))
    rows = mart["fct_contrato"]
    worded = c("objeto_del_contrato").isNotNull()
    if "F13" in bits:
        rows = _hashed_texts(rows)
        counts, border = _frequencies(rows.where(worded), p)
        repeated = c("frecuencia_objeto") >= c("umbral_decil_superior")
        # evidence tells the frequency of short texts too
        shown = threshold(counts, border).where(repeated | (F.lit(evidence) & (c("_least") < p.vague_length)))
        often = cut(shown.select(c("_a").alias("_oa"), c("_b").alias("_ob"), repeated.alias("_often"), "frecuencia_objeto", "umbral_decil_superior"))
        rows = rows.join(small(often, NARROW_ROWS), (c("_a") == c("_oa")) & (c("_b") == c("_ob")) & worded, "left")
    dates = cut(supplier_dates(mart, evidence))
    rows = rows.join(small(dates, NARROW_ROWS), c("doc_proveedor_norm") == c("_doc"), "left")
    years = mart["ref_smmlv"].select(c("year").alias("_wage")).distinct()
    rows = with_window(mart, rows.join(small(years), c("anio") == c("_wage"), "left"))
    rules = {k: rule(p) for k, rule in ROW_RULES.items()}
    rules |= {"F05": Rule(_may_split(p) & c("_wage").isNotNull(), F.lit(False), {}), "F06": Rule(_may_rotate(), F.lit(False), {})}
    rules["F11"] = Rule(keyed(c("doc_proveedor_norm")), c("_sanctioned") < c("fecha_firma"), _sanctions_told())
    if "F13" in bits:
        short = c("longitud_objeto") < p.vague_length
        told = {"longitud_objeto": c("longitud_objeto"), "frecuencia_objeto": c("frecuencia_objeto"), "umbral_decil_superior": c("umbral_decil_superior"), "objeto_muy_corto": short, "objeto_repetitivo": repeated}
        rules["F13"] = Rule(worded, worded & (_yes(short) | _yes(c("_often"))), told)
    both = lambda own: (total({k: r.applies for k, r in own.items()}), total({k: _yes(r.applies) & r.fires for k, r in own.items()}))
    early = {k: r for k, r in rules.items() if k not in ("F01", "F02", "F03", "F07", "F08")}
    rows = rows.withColumns(dict(zip(("_on", "_fired"), both(early), strict=True)))
    rows = with_process(mart, rows.withColumn("added", F.lit(None).cast("double")), *PROCESS)
    if "stg_secop1" in mart:
        rules["F03"] = replace(rules["F03"], applies=rules["F03"].applies & ~_may_be_added_to())
    on, fired = both({k: r for k, r in rules.items() if k not in early})
    rows = rows.withColumns({"_on": c("_on") + on, "_fired": c("_fired") + fired})
    kept = [] if columns is None else [F.struct(c("fecha_firma"), c("row_id"), *[c(x) for x in columns if x not in ("fecha_firma", "row_id")]).alias("_row")]
    of = lambda k, r: F.when(c("_fired").bitwiseAND(F.lit(bits[k])) != 0, F.struct(*[x.alias(n) for n, x in r.evidence.items()]))
    named = [of(k, rules[k]).alias(f"evidence_{k}") for k in bits if k in rules and rules[k].evidence] if evidence else []
    rows = rows.select(contract_key(), c("_on").alias("on"), c("_fired").alias("fired"), *kept, *named)
    parts = [rows if kept else rows.where("on != 0")]
    # contracts' own rows tell that F05 and F06 apply, so that each contract counts once
    parts += [folded_flag(k, f(mart, p), p, "contract", evidence).withColumn("on", F.lit(0)) for k, f in {"F05": splitting, "F06": rotating}.items() if k in bits]
    if "stg_secop1" in mart and "F03" in bits:
        parts.append(folded_flag("F03", additions(mart, p), p, "contract", evidence))
    parts += [folded_flag(k, FLAGS[k](mart, p), p, "contract", evidence) for k in bits if k in FLAGS and k not in rules]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def tallies(found: DataFrame, p: Params, level: str) -> DataFrame:
    """flag_id, population, fired of a level's flags from rows of `folded`: a task sends the pairs of numbers that it has read, each once."""
    bits = level_flags(p, level)
    pairs = found.groupBy("on", "fired").agg(F.count("*").alias("_n"))
    of = lambda c, k: F.coalesce(F.sum(F.when(F.col(c).bitwiseAND(F.lit(bits[k])) != 0, F.col("_n"))), F.lit(0))
    every = pairs.agg(*[of(c, k).alias(f"{c}_{k}") for k in bits for c in ("on", "fired")])
    each = [F.struct(F.lit(k).alias("flag_id"), F.col(f"on_{k}").alias("population"), F.col(f"fired_{k}").alias("fired")) for k in bits]
    return every.select(F.inline(F.array(*each)))


def overview(mart: Mart, p: Params | None = None) -> DataFrame:
    """`summary` of the flags of both levels, from the pass that scores take: a contract's flags are two numbers, and F05 and F06 look only at groups that may fire."""
    p = p or Params()
    found = [tallies(folded(mart, p, level, evidence=False), p, level) for level in ("contract", "entity") if level_flags(p, level)]
    return _rates(reduce(DataFrame.unionByName, found), p)


def summary(long: DataFrame, p: Params | None = None) -> DataFrame:
    """flag_id, nombre, nivel, population, fired, rate_pct."""
    return _rates(long.groupBy("flag_id").agg(F.count("*").alias("population"), F.count_if("fired").alias("fired")), p or Params())


def _rates(counts: DataFrame, p: Params) -> DataFrame:
    names = counts.sparkSession.createDataFrame([(k, n, of) for k, (n, of, _) in p.weights.items()], "flag_id string, nombre string, nivel string")
    joined = F.broadcast(names).join(counts, "flag_id", "left").fillna(0, ["population", "fired"])  # names: one row a flag
    return joined.select("flag_id", "nombre", "nivel", "population", "fired", F.coalesce(F.try_divide(F.col("fired") * 100.0, "population"), F.lit(0.0)).alias("rate_pct"))
