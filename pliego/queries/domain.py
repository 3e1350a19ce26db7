"""Flags, scores, checks against outcomes, enrichment, quality and exports, over the test tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pliego import rawdata, testdata
from pliego.operators.ranking import auc, ordinal_rank, precision_at
from pliego.plans import backtest, enrichment, exports, flags, marts, quality, scoring
from pliego.plans.marts import Mart
from pliego.queries.oracle import rotation, splitting, sql, vague
from pliego.queries.registry import query, rounded
from pliego.session import cut

P = testdata.PARAMS


def scored(spark: SparkSession, sf_dir: str, *wanted: str, evidence: bool = False, columns: Sequence[str] = scoring.CONTRACT) -> Mart:
    """The mart with contracts' scores, or the other score tables named; with the evidence of all contracts if wanted. columns: see scoring.run."""
    return scoring.run(testdata.mart(spark, sf_dir, written=True), P, wanted or ("contrato_score",), evidence, columns)


LABELLED = ("fecha_firma", "doc_proveedor_norm", "nit_entidad_norm")


# Flags


@query(sql("SELECT * FROM f01"))
def f01_single_bidder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flags.f01(testdata.mart(spark, sf_dir), P)


@query(sql("SELECT * FROM f02"))
def f02_express_company(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flags.f02(testdata.mart(spark, sf_dir), P)


@query(sql("SELECT * REPLACE (round(ratio_adicion_dinero, 6) AS ratio_adicion_dinero) FROM f03"))
def f03_excess_additions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(flags.f03(testdata.mart(spark, sf_dir), P), "ratio_adicion_dinero")


@query(sql("SELECT * REPLACE (round(share_directa, 6) AS share_directa, round(mean_share_peers, 6) AS mean_share_peers, round(sd_share_peers, 6) AS sd_share_peers, round(z_score, 6) AS z_score) FROM f04"))
def f04_direct_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(flags.f04(testdata.mart(spark, sf_dir), P), "share_directa", "mean_share_peers", "sd_share_peers", "z_score")


_regional = "fct_contrato JOIN (SELECT CAST(n_nationkey AS VARCHAR) AS cod_dpto, CAST(n_regionkey AS VARCHAR) AS region FROM nation) USING (cod_dpto)"


@query(sql(f"SELECT * REPLACE (round(suma_valor_ventana, 2) AS suma_valor_ventana) FROM ({splitting('region', _regional)})"))
def f05_splitting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(flags.f05(testdata.regional(spark, sf_dir), testdata.SPLITTING), "suma_valor_ventana", digits=2)


_rounds = "(SELECT CAST(o_orderkey AS VARCHAR) AS id_contrato, CAST(o_custkey AS VARCHAR) AS nit_entidad_norm, o_orderstatus AS doc_proveedor_norm, CAST(1 AS INTEGER) AS unspsc_segmento, CAST(o_orderdate AS DATE) AS fecha_firma, true AS es_competitiva FROM orders)"


@query(f"SELECT * REPLACE (round(participacion_minima_ganador, 6) AS participacion_minima_ganador, round(indice_alternancia, 6) AS indice_alternancia) FROM ({rotation(_rounds, 1460)})")
def f06_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(flags.f06(testdata.rounds(spark, sf_dir), testdata.ROTATION), "participacion_minima_ganador", "indice_alternancia")


@query(sql("SELECT * FROM f07"))
def f07_short_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flags.f07(testdata.mart(spark, sf_dir), P)


@query(sql("SELECT * REPLACE (round(precio_base, 4) AS precio_base, round(desviacion_pct, 6) AS desviacion_pct) FROM f08"))
def f08_price_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rounded(flags.f08(testdata.mart(spark, sf_dir), P), "precio_base", digits=4), "desviacion_pct")


@query(sql("SELECT * FROM f09"))
def f09_december(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flags.f09(testdata.mart(spark, sf_dir), P)


@query(sql("SELECT * FROM f10"))
def f10_election_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flags.f10(testdata.mart(spark, sf_dir), P)


@query(sql("SELECT * FROM f11"))
def f11_sanctioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flags.f11(testdata.mart(spark, sf_dir), P)


@query(sql("SELECT * REPLACE (round(participacion_proveedor_en_entidad, 6) AS participacion_proveedor_en_entidad, round(dependencia_proveedor_en_entidad, 6) AS dependencia_proveedor_en_entidad) FROM f12"))
def f12_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = testdata.mart(spark, sf_dir)
    m["fct_contrato"] = cut(m["fct_contrato"].select("nit_entidad_norm", "doc_proveedor_norm", "anio", "valor_contrato"))  # read three times
    return rounded(flags.f12(m, P), "participacion_proveedor_en_entidad", "dependencia_proveedor_en_entidad")


@query(f"SELECT * FROM ({vague('(SELECT CAST(doc_id AS VARCHAR) AS id_contrato, text AS objeto_del_contrato FROM documents)')})")
def f13_vague_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flags.f13(testdata.texts(spark, sf_dir), P)


@query(sql("SELECT * FROM f14"))
def f14_round_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flags.f14(testdata.mart(spark, sf_dir), P)


@query(sql("SELECT f.flag_id, count(*) AS population, count(*) FILTER (WHERE fired) AS fired, round(count(*) FILTER (WHERE fired) * 100.0 / count(*), 6) AS rate_pct FROM (SELECT * FROM flag_contrato UNION ALL SELECT * FROM flag_entidad) f GROUP BY 1"))
def flag_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(flags.overview(testdata.mart(spark, sf_dir, written=True), P).select("flag_id", "population", "fired", "rate_pct"), "rate_pct")


# Scores

_SCORED = ["id_contrato", "valor_contrato", "fecha_firma", "anio", "n_flags_aplicables", "n_flags_disparados", "score", "tier"]


@query(sql(f"SELECT {', '.join(_SCORED)} FROM (SELECT * REPLACE (round(score, 6) AS score) FROM contrato_score)"))
def score_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = testdata.mart(spark, sf_dir, written=True)
    return rounded(scoring.contract_scores(m, flags.folded(m, P, evidence=False, columns=scoring.kept(_SCORED)), P, _SCORED).select(*_SCORED), "score")


_TOLD = "CASE WHEN v IS NULL THEN 'null' WHEN TRY_CAST(v AS DOUBLE) IS NOT NULL THEN printf('%.3f', TRY_CAST(v AS DOUBLE)) ELSE v END"
_PAIRS = f"array_to_string(list_sort(list_transform(list_filter(json_keys(j), lambda k: k <> 'key'), lambda k: k || '=' || {_TOLD.replace('v ', 'json_extract_string(j, k) ').replace('ELSE v', 'ELSE json_extract_string(j, k)')})), ';')"
_OF_FLAGS = " UNION ALL ".join(
    f"SELECT key AS id_contrato, '{k}' AS flag_id, {w} AS peso, {_PAIRS} AS evidence, CAST(j AS VARCHAR) AS text FROM (SELECT key, to_json(t) AS j FROM (SELECT * EXCLUDE (fired) FROM {k.lower()} WHERE fired) t)" for k,
    (_, of, w) in P.weights.items() if of == "contract"
)


@query(sql(f"SELECT id_contrato, flag_id, peso, arg_max(evidence, text) AS evidence FROM ({_OF_FLAGS}) GROUP BY ALL"))
def fired_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fired flags inside each contract's JSON list, with every key and value of their evidence, numbers to three digits."""
    lists = scoring.fired_lists(testdata.mart(spark, sf_dir, written=True), P)
    rows = lists.select(F.col("key").alias("id_contrato"), F.explode(exports.parsed(F.col("flags_disparados"))).alias("x"))
    # a cast that fails costs an exception, so only what looks like a number is cast
    number = r"(?i)^\s*([+-]?([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?|[+-]?inf(inity)?|nan)\s*$"
    told = lambda v: F.when(v.isNull(), F.lit("null")).when(v.rlike(number), F.format_string("%.3f", v.try_cast("double"))).otherwise(v)
    pairs = F.transform(F.map_entries(F.from_json("x.evidence", "map<string,string>")), lambda e: F.concat(e["key"], F.lit("="), told(e["value"])))
    return rows.select("id_contrato", "x.flag_id", "x.peso", F.array_join(F.array_sort(pairs), ";").alias("evidence"))


_ENTITY = ["nit_entidad_norm", "cod_dpto", "n_contratos", "n_flags_aplicables", "n_flags_disparados", "contract_component", "entity_component", "combined_raw_score", "dept_mean_score", "score", "tier", "datos_insuficientes"]
_ROUND = ["contract_component", "entity_component", "combined_raw_score", "dept_mean_score", "score"]


@query(sql(f"SELECT {', '.join(f'round({c}, 6) AS {c}' if c in _ROUND else c for c in _ENTITY)} FROM entidad_score"))
def score_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scored(spark, sf_dir, "entidad_score")["entidad_score"].select(*_ENTITY), *_ROUND)


@query(sql("SELECT cod_dpto, cod_mpio, n_contratos, round(valor_total, 2) AS valor_total, round(raw_score, 6) AS raw_score, round(dept_mean_score, 6) AS dept_mean_score, round(score, 6) AS score, tier, datos_insuficientes FROM municipio_score"))
def score_municipality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir, "municipio_score")["municipio_score"].select("cod_dpto", "cod_mpio", "n_contratos", "valor_total", "raw_score", "dept_mean_score", "score", "tier", "datos_insuficientes")
    return rounded(rounded(rows, "raw_score", "dept_mean_score", "score"), "valor_total", digits=2)


@query(sql("SELECT doc_proveedor_norm, es_persona_natural, n_contratos, round(score, 6) AS score, tier, datos_insuficientes FROM proveedor_score"))
def score_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scored(spark, sf_dir, "proveedor_score")["proveedor_score"].select("doc_proveedor_norm", "es_persona_natural", "n_contratos", "score", "tier", "datos_insuficientes"), "score")


@query(sql("SELECT tier, count(*) AS n, CAST(CASE tier WHEN 'critico' THEN 0 WHEN 'alto' THEN 1 WHEN 'medio' THEN 2 WHEN 'bajo' THEN 3 END AS INTEGER) AS tier_order FROM contrato_score GROUP BY 1"))
def tier_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.tier_counts(scored(spark, sf_dir, columns=())["contrato_score"], P)


_shares = (0.5, 0.75, 0.9, 0.95, 0.99, 0.999, 1.0)


@query(sql(" UNION ALL ".join(f"SELECT CAST({q} AS DOUBLE) AS share, round(percentile_cont({q}) WITHIN GROUP (ORDER BY score), 6) AS value FROM contrato_score" for q in _shares)))
def score_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scoring.distribution(scored(spark, sf_dir, columns=())["contrato_score"], _shares), "value")


# Outcomes


@query(sql("SELECT id_contrato, round(score, 6) AS score, is_positive FROM etiquetas"))
def labels_after_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = scored(spark, sf_dir, columns=LABELLED)
    return rounded(backtest.labels(m["contrato_score"], m["sanciones"]), "score")


_ranks = "SELECT is_positive, rank() OVER (ORDER BY round(score, 9)) + (count(*) OVER (PARTITION BY round(score, 9)) - 1) / 2.0 AS r FROM etiquetas"
_auc = "SELECT round((sum(r) FILTER (WHERE is_positive) - count(*) FILTER (WHERE is_positive) * (count(*) FILTER (WHERE is_positive) + 1) / 2.0) / (count(*) FILTER (WHERE is_positive) * count(*) FILTER (WHERE NOT is_positive)), 6) AS auc, count(*) AS n, count(*) FILTER (WHERE is_positive) AS n_pos, count(*) FILTER (WHERE NOT is_positive) AS n_neg"


@query(sql(f"{_auc} FROM ({_ranks})"))
def backtest_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = scored(spark, sf_dir, columns=LABELLED)
    return rounded(auc(rounded(backtest.labels(m["contrato_score"], m["sanciones"]), "score", digits=9), "score", "is_positive"), "auc")


@query(f"{_auc} FROM (SELECT quality = 1 AS is_positive, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0 AS r FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL)")
def auc_text_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = testdata.table(spark, sf_dir, "labels").where("quality IS NOT NULL").join(testdata.table(spark, sf_dir, "documents"), "doc_id")
    return rounded(auc(rows.withColumn("good", F.col("quality") == 1), "n_chars", "good"), "auc")


_top = lambda name, k: f"SELECT '{name}' AS name, CAST({k} AS BIGINT) AS k, round(avg(CASE WHEN is_positive THEN 1.0 ELSE 0 END), 6) AS precision, round(avg(CASE WHEN is_positive THEN 1.0 ELSE 0 END) / (SELECT avg(CASE WHEN is_positive THEN 1.0 ELSE 0 END) FROM etiquetas), 6) AS lift FROM placed WHERE i <= {k} AND {k} <= n GROUP BY ALL"
_share = lambda s: f"greatest(1, CAST(round_even(n * {s}, 0) AS BIGINT))"


@query(sql("SELECT * FROM (WITH placed AS (SELECT is_positive, row_number() OVER (ORDER BY round(score, 9) DESC, id_contrato) AS i, count(*) OVER () AS n FROM etiquetas) " + " UNION ALL ".join([
    _top("top_50", "50"), _top("top_100", "100"), _top("top_500", "500"), _top("top_1%", _share(0.01)), _top("top_5%", _share(0.05)), _top("top_10%", _share(0.1))
]) + ")"))
def precision_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = scored(spark, sf_dir, columns=LABELLED)
    found = precision_at(rounded(backtest.labels(m["contrato_score"], m["sanciones"]), "score", digits=9), "score", "is_positive", "id_contrato")
    return rounded(found, "precision", "lift")


CASES = [
    ("caso-1", "Uno", 1995, 1997, ["%00001"], ["Customer#000000001"], ["Supplier 1"]),
    ("caso-2", "Dos", 1996, 1999, ["%0002%", "%0003_"], [], []),
    ("caso-3", "Tres", 1900, 1901, ["%000044"], ["Customer 44"], []),
    ("caso-4", "Cuatro", 1996, 1999, ["NADIE%"], ["Nadie"], ["Nadie"]),
]
_key = lambda c: f"upper(regexp_replace({c}, '[^A-Za-z0-9 ,.]', '', 'g'))"
_cases = "(VALUES " + ", ".join(f"('{s}', {a}, {b}, {e!r}, {n!r}, {p!r})" for s, _, a, b, e, n, p in CASES) + ") AS c(slug, first, last, patterns, names, suppliers)"
_like = lambda text, of: f"CASE WHEN len({of}) > 0 THEN len(list_filter({of}, lambda x: contains({text}, {_key('x')}))) > 0 END"
_matches = f"""SELECT slug, id_contrato, score, tier, anio, {_like(_key('nombre_proveedor'), 'suppliers::VARCHAR[]')} AS coincide_proveedor, {_like(_key('nombre_entidad'), 'names::VARCHAR[]')} AS coincide_nombre_exacto
FROM contrato_score JOIN {_cases} ON len(list_filter(patterns, lambda x: {_key('nombre_entidad')} LIKE x)) > 0"""


@query(sql(f"SELECT * REPLACE (round(score, 6) AS score) FROM ({_matches} WHERE anio BETWEEN first AND last)"))
def landmark_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = backtest.landmark_matches(scored(spark, sf_dir, columns=("nombre_entidad", "nombre_proveedor", "anio", "valor_contrato"))["contrato_score"], spark.createDataFrame(CASES, backtest.CASES))
    return rounded(found.select("slug", "id_contrato", "score", "tier", "anio", "coincide_proveedor", "coincide_nombre_exacto"), "score")


_pct = "SELECT id_contrato, percent_rank() OVER (PARTITION BY anio ORDER BY round(score, 9)) AS percentil_anio FROM contrato_score WHERE score IS NOT NULL AND anio IS NOT NULL"


@query(sql(f"SELECT id_contrato, round(percentil_anio, 6) AS percentil_anio FROM ({_pct})"))
def percent_rank_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(backtest.year_percentiles(rounded(scored(spark, sf_dir, columns=("anio",))["contrato_score"], "score", digits=9)), "percentil_anio")


@query(sql(f"""SELECT c.slug, coalesce(n, 0) AS n_matched, coalesce(exact, 0) AS n_confirmed_exact_name, round(best_score, 6) AS best_score, best_tier, round(best_percentil_anio, 6) AS best_percentil_anio, top_quartile_reached, (SELECT count(*) FROM ({_matches}) m WHERE m.slug = c.slug) AS n_matched_ignoring_period
FROM {_cases} LEFT JOIN (SELECT slug, count(*) AS n, count(*) FILTER (WHERE coincide_nombre_exacto) AS exact, first(score ORDER BY score DESC NULLS LAST, id_contrato DESC) AS best_score, first(tier ORDER BY score DESC NULLS LAST, id_contrato DESC) AS best_tier,
  first(percentil_anio ORDER BY score DESC NULLS LAST, id_contrato DESC) AS best_percentil_anio, bool_or(coalesce(percentil_anio >= 0.75, false)) AS top_quartile_reached
  FROM (SELECT * REPLACE (round(score, 9) AS score) FROM ({_matches} WHERE anio BETWEEN first AND last)) LEFT JOIN ({_pct}) USING (id_contrato) GROUP BY slug) USING (slug)"""))
def landmark_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = backtest.case_summary(rounded(scored(spark, sf_dir, columns=("nombre_entidad", "nombre_proveedor", "anio", "valor_contrato"))["contrato_score"], "score", digits=9), spark.createDataFrame(CASES, backtest.CASES))
    return rounded(found.drop("nombre", "first", "last"), "best_score", "best_percentil_anio")


@query(sql("""SELECT n_total, n_usable_join_keys, n_geo_matched, n_matched, round(n_matched * 100.0 / n_total, 2) AS match_rate_pct, round(n_matched * 100.0 / n_usable_join_keys, 2) AS match_rate_usable_pct
FROM (SELECT count(*) AS n_total, count(*) FILTER (WHERE departamento IS NOT NULL) AS n_usable_join_keys FROM hechos), (SELECT count(*) AS n_geo_matched, CAST(sum(CAST(EXISTS (SELECT 1 FROM contrato_score c WHERE c.cod_dpto = d.cod_dpto AND c.cod_mpio = d.cod_mpio AND c.anio = h.anio) AS INT)) AS BIGINT) AS n_matched
  FROM hechos h JOIN divipola d ON upper(regexp_replace(h.departamento, '[^A-Za-z0-9 ,.]', '', 'g')) = d.dpto_norm AND upper(h.municipio) = d.mpio_norm)"""))
def fact_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = scored(spark, sf_dir, columns=("cod_dpto", "cod_mpio", "anio"))
    return backtest.fact_matches(m["monitor_ciudadano_hechos"], m["contrato_score"], m["divipola"])


# Enrichment and quality


def registers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Suppliers and customers as two chambers' registers, with numbers that overlap."""
    c, day = F.col, lambda n: F.date_format(F.date_add(F.lit("1990-01-01").cast("date"), n.cast("int")), "yyyyMMdd")
    first = testdata.table(spark, sf_dir, "supplier").select(
        F.when(c("s_suppkey") % 10 == 0, "NO APLICA").otherwise(F.concat(F.lit("900.000."), F.lpad(c("s_suppkey").cast("string"), 3, "0"), F.lit("-1"))).alias("nit"),
        F.when(c("s_suppkey") % 7 != 0, day(c("s_suppkey") * 13)).alias("fecha_de_matricula")
    )
    second = testdata.table(spark, sf_dir, "customer").select(
        F.when(c("c_custkey") % 2 == 0, F.concat(F.lit("900000"), F.lpad((c("c_custkey") % 200).cast("string"), 3, "0"))).alias("nit"), F.when(c("c_custkey") % 2 == 0, "1").alias("digito_verificacion"), c("c_custkey").cast("string").alias("numero_identificacion"), day(c("c_custkey") * 7 % 9000).alias("fecha_matricula"),
    )
    return first, second


_base = lambda n: f"CASE WHEN length({n}) = 10 AND left({n}, 1) IN ('8', '9') THEN left({n}, 9) ELSE {n} END"
_resolved = f"""SELECT coalesce(a.nit_base, b.nit_base) AS nit_base, a.d AS fecha_ibague, b.d AS fecha_santarosa, least(a.d, b.d) AS fecha_matricula, coalesce(a.d <> b.d, false) AS is_conflict, CAST((a.d IS NOT NULL)::INT + (b.d IS NOT NULL)::INT AS INTEGER) AS n_sources_matched, coalesce(a.n, 0) AS n_registros_ibague, coalesce(b.n, 0) AS n_registros_santarosa
FROM (SELECT {_base("number")} AS nit_base, min(d) AS d, count(*) AS n FROM (SELECT '900000' || lpad(CAST(s_suppkey AS VARCHAR), 3, '0') || '1' AS number, DATE '1990-01-01' + CAST(s_suppkey * 13 AS INTEGER) AS d FROM supplier WHERE s_suppkey % 10 <> 0 AND s_suppkey % 7 <> 0) GROUP BY 1) a
FULL JOIN (SELECT {_base("number")} AS nit_base, min(d) AS d, count(*) AS n FROM (SELECT CASE WHEN c_custkey % 2 = 0 THEN '900000' || lpad(CAST(c_custkey % 200 AS VARCHAR), 3, '0') || '1' ELSE CAST(c_custkey AS VARCHAR) END AS number, DATE '1990-01-01' + CAST(c_custkey * 7 % 9000 AS INTEGER) AS d FROM customer) GROUP BY 1) b ON a.nit_base = b.nit_base"""


@query(_resolved)
def registry_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = enrichment.resolved(*registers(spark, sf_dir))
    return found.select("nit_base", "fecha_ibague", "fecha_santarosa", "fecha_matricula", "is_conflict", "n_sources_matched", "n_registros_ibague", "n_registros_santarosa")


@query(f"SELECT count(*) AS n_nit_base, count(*) FILTER (WHERE is_conflict) AS n_conflicts, count(*) FILTER (WHERE n_registros_ibague > 1) AS n_multi_registro_ibague, count(*) FILTER (WHERE n_registros_santarosa > 1) AS n_multi_registro_santarosa FROM ({_resolved})")
def registry_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrichment.resolved_stats(enrichment.resolved(*registers(spark, sf_dir)))


_dim = f"(SELECT p.* EXCLUDE (fecha_matricula), CASE WHEN CAST(doc_proveedor_norm AS INTEGER) % 3 <> 0 THEN true END AS kind, r.fecha_matricula FROM dim_proveedor p LEFT JOIN ({_resolved}) r ON r.nit_base = p.doc_proveedor_norm)"
_cover = "count(*) AS n_suppliers, count(fecha_matricula) AS n_matched, round(sum(valor_total), 2) AS valor_total, round(coalesce(sum(valor_total) FILTER (WHERE fecha_matricula IS NOT NULL), 0), 2) AS valor_matched, round(count(fecha_matricula) * 100.0 / count(*), 6) AS pct_matched, round(coalesce(sum(valor_total) FILTER (WHERE fecha_matricula IS NOT NULL), 0) * 100 / sum(valor_total), 6) AS pct_valor"


def enriched_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = enrichment.resolved(*registers(spark, sf_dir))
    kind = F.when(F.col("doc_proveedor_norm").cast("int") % 3 != 0, True)
    return enrichment.enriched(testdata.mart(spark, sf_dir)["dim_proveedor"].withColumn("es_persona_natural", kind), found)


@query(sql(f"SELECT coalesce(CAST(kind AS VARCHAR), 'unknown') AS kind, {_cover} FROM {_dim} GROUP BY 1 UNION ALL SELECT 'all', {_cover} FROM {_dim}"))
def registry_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = enrichment.coverage(enriched_suppliers(spark, sf_dir))
    return rounded(rounded(found, "pct_matched", "pct_valor"), "valor_total", "valor_matched", digits=2)


@query(sql(f"""SELECT doc_proveedor_norm, nombre_proveedor, max_valor FROM {_dim} JOIN (SELECT doc_proveedor_norm, max(valor_contrato) AS max_valor FROM fct_contrato GROUP BY 1) USING (doc_proveedor_norm) WHERE fecha_matricula IS NULL AND (max_valor >= 104000 OR doc_proveedor_norm IN (SELECT doc_proveedor_norm FROM fct_contrato WHERE id_contrato IN (SELECT key FROM f14 WHERE fired)))"""))
def fallback_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = testdata.mart(spark, sf_dir)
    m |= {"dim_proveedor": enriched_suppliers(spark, sf_dir), "flag_contrato": flags.long_rows("F14", flags.f14(m, P))}
    return enrichment.candidates(m, min_value=104_000)


@query(sql("SELECT nit_entidad_norm, nombre_entidad, cod_dpto, cod_mpio, n_contratos, round(valor_total, 2) AS valor_total FROM dim_entidad"))
def entity_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(testdata.mart(spark, sf_dir)["dim_entidad"], "valor_total", digits=2)


@query(sql("SELECT doc_proveedor_norm, nombre_proveedor, es_persona_natural, n_contratos, round(valor_total, 2) AS valor_total FROM dim_proveedor"))
def supplier_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(testdata.mart(spark, sf_dir)["dim_proveedor"].drop("fecha_matricula"), "valor_total", digits=2)


def raw_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as raw text rows of many part files, some ids in several of them, some values and dates spoilt."""
    c = F.col
    value = F.when(c("l_partkey") % 50 == 0, "INVALID").when(c("l_partkey") % 50 == 1, "").when(c("l_partkey") % 50 == 2, "5d").otherwise(c("l_quantity").cast("int").cast("string"))
    date = F.when(c("l_partkey") % 40 == 3, "NOT-A-DATE").when(c("l_partkey") % 40 == 4, "2023").otherwise(F.date_format("l_shipdate", "yyyy-MM-dd'T'00:00:00.000"))
    return testdata.table(spark, sf_dir, "lineitem").select(F.concat_ws("-", "l_orderkey", c("l_linenumber") % 5).alias(":id"), value.alias("valor_del_contrato"), date.alias("fecha_de_firma"), rawdata.file_name().alias("file_name"), c("l_suppkey"))


_raw = "(SELECT concat_ws('-', l_orderkey, l_linenumber % 5) AS id, CASE l_partkey % 50 WHEN 0 THEN 'INVALID' WHEN 1 THEN '' WHEN 2 THEN '5d' ELSE CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) END AS v, CASE l_partkey % 40 WHEN 3 THEN 'NOT-A-DATE' WHEN 4 THEN '2023' ELSE strftime(l_shipdate, '%Y-%m-%dT00:00:00.000') END AS d, concat_ws('-', 'part', l_linenumber, lpad(CAST(l_partkey AS VARCHAR), 9, '0'), lpad(CAST(l_suppkey AS VARCHAR), 9, '0'), strftime(l_shipdate, '%Y%m%d')) AS f FROM lineitem)"
_bad = "SELECT id, CASE WHEN TRY_CAST(v AS DOUBLE) IS NULL AND trim(v) <> '' THEN 'bad_valor_del_contrato' WHEN TRY_CAST(d AS DATE) IS NULL AND trim(d) <> '' THEN 'bad_fecha_de_firma' END AS reason, v, d FROM staged"


@query(f"WITH staged AS (SELECT * FROM {_raw} QUALIFY row_number() OVER (PARTITION BY id ORDER BY f DESC) = 1) SELECT reason, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM staged), 6) AS pct FROM ({_bad}) WHERE reason IS NOT NULL GROUP BY 1")
def quarantine_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    staged = marts.staged(raw_contracts(spark, sf_dir))
    bad, _ = marts.split_bad(staged)
    return rounded(quality.quarantined(bad, staged).drop("source"), "pct")


@query(f"SELECT 'S1' AS source, (SELECT count(*) FROM {_raw}) AS raw, (SELECT count(DISTINCT id) FROM {_raw}) AS staged, (SELECT count(*) - count(DISTINCT id) FROM {_raw}) AS removed")
def row_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = raw_contracts(spark, sf_dir)
    return quality.reconciled(raw, marts.staged(raw), "S1")


_PANEL = ["unspsc_segmento", "doc_proveedor_norm", "urlproceso", "cod_dpto"]


@query(sql(" UNION ALL ".join(f"SELECT '{c}' AS col, round(avg(CASE WHEN {c} IS NULL THEN 100.0 ELSE 0 END), 6) AS null_pct FROM fct_contrato" for c in _PANEL)))
def null_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(quality.null_rates(testdata.contracts(spark, sf_dir), _PANEL), "null_pct")


@query(sql("SELECT count(*) AS n, min(valor_contrato) AS min_valor, max(valor_contrato) AS max_valor, count(*) FILTER (WHERE valor_contrato <= 0) AS n_not_positive, min(fecha_firma) AS first_date, max(fecha_firma) AS last_date, count(*) FILTER (WHERE year(fecha_firma) NOT BETWEEN 1990 AND 2030 OR duracion_dias_inicial < 0) AS n_odd_dates FROM fct_contrato"))
def value_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.value_panel(testdata.contracts(spark, sf_dir))


@query(sql(" UNION ALL ".join(f"SELECT CAST({s} AS DOUBLE) AS share, round(percentile_cont({s}) WITHIN GROUP (ORDER BY valor_contrato), 4) AS value FROM fct_contrato" for s in (0.5, 0.95, 0.99))))
def value_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(quality.value_percentiles(testdata.contracts(spark, sf_dir)), "value", digits=4)


@query(sql("SELECT count(*) AS total, count(*) FILTER (WHERE cod_dpto IS NOT NULL) AS n_matched, round(count(cod_dpto) * 100.0 / count(*), 6) AS pct FROM fct_contrato WHERE source = 'SECOP2'"))
def geo_match_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(quality.geo_rate(testdata.contracts(spark, sf_dir)), "pct")


@query(sql("SELECT count(*) AS total, count(*) FILTER (WHERE proceso_de_compra IN (SELECT referencia FROM fct_proceso WHERE num_oferentes_unicos > 2)) AS n_matched, round(count(*) FILTER (WHERE proceso_de_compra IN (SELECT referencia FROM fct_proceso WHERE num_oferentes_unicos > 2)) * 100.0 / count(*), 6) AS pct FROM fct_contrato WHERE source = 'SECOP2'"))
def join_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = testdata.processes(spark, sf_dir).where("num_oferentes_unicos > 2")
    return rounded(quality.join_coverage(testdata.contracts(spark, sf_dir), some), "pct")


@query(sql("SELECT modalidad_norm, count(*) AS n FROM (SELECT modalidad_norm FROM fct_contrato UNION ALL SELECT modalidad_norm FROM fct_proceso) GROUP BY 1"))
def modality_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.modalities(testdata.contracts(spark, sf_dir), testdata.processes(spark, sf_dir))


# Exports


@query(sql("""SELECT count(*) AS contratos_analizados, round(sum(valor_contrato), 2) AS valor_total_cop, count(*) FILTER (WHERE tier = 'critico') AS casos_criticos, round(count(*) FILTER (WHERE modalidad_norm = 'CONTRATACION_DIRECTA' AND anio IS NOT NULL) * 100.0 / count(*), 6) AS pct_contratacion_directa,
  count(DISTINCT nullif(nit_entidad_norm, '')) AS n_entidades, count(DISTINCT nullif(doc_proveedor_norm, '')) AS n_proveedores, count(*) FILTER (WHERE cod_dpto IS NULL) AS n_contratos_sin_departamento, round(count(cod_dpto) * 100.0 / count(*), 6) AS pct_geolocalizado FROM contrato_score"""))
def national_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = scored(spark, sf_dir, columns=("nit_entidad_norm", "doc_proveedor_norm", "cod_dpto", "valor_contrato", "anio", "modalidad_norm"))
    found = exports.kpis(m["contrato_score"], m["fct_contrato"], P)
    return rounded(rounded(found, "pct_contratacion_directa", "pct_geolocalizado"), "valor_total_cop", digits=2)


@query(sql("SELECT anio, modalidad_norm AS modalidad, count(*) AS n_contratos, round(sum(valor_contrato), 2) AS valor_total FROM contrato_score GROUP BY ALL"))
def year_modality(spark: SparkSession, sf_dir: str) -> DataFrame:
    fct = testdata.contracts(spark, sf_dir)
    latest = scoring.keep_latest(fct, ["id_contrato"], "fecha_firma", "row_id")
    return rounded(exports.year_modality(latest, fct), "valor_total", digits=2)


@query(sql("SELECT anio, tier, count(*) AS n_contratos FROM contrato_score WHERE tier IS NOT NULL GROUP BY ALL"))
def year_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.year_tier(scored(spark, sf_dir, columns=("anio",))["contrato_score"])


@query(sql("SELECT anio, count(*) AS n_contratos FROM contrato_score WHERE tier = 'critico' GROUP BY ALL"))
def critical_per_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.year_tier(scored(spark, sf_dir, columns=("anio",))["contrato_score"]).where("tier = 'critico'").select("anio", "n_contratos").orderBy("anio")


@query(sql("PIVOT (SELECT anio, modalidad_norm, 1 AS n FROM contrato_dedup) ON modalidad_norm IN ('CONTRATACION_DIRECTA', 'LICITACION_PUBLICA', 'MINIMA_CUANTIA') USING count(n) GROUP BY anio"))
def pivot_year_modality(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = scoring.keep_latest(testdata.contracts(spark, sf_dir), ["id_contrato"], "fecha_firma", "row_id")
    series = latest.groupBy("anio", "modalidad_norm").agg(F.count("*").alias("n"))
    return exports.pivoted(series, "anio", "modalidad_norm", "n", ["CONTRATACION_DIRECTA", "LICITACION_PUBLICA", "MINIMA_CUANTIA"])


_mean = "CASE WHEN sum(valor_contrato) FILTER (WHERE score IS NOT NULL) > 0 THEN sum(valor_contrato * score) / sum(valor_contrato) FILTER (WHERE score IS NOT NULL) ELSE avg(score) END"
_depts = f"""SELECT d.cod_dpto, d.dpto, coalesce(n, 0) AS n_contratos, coalesce(v, 0) AS valor_total, m AS score_promedio, coalesce(b, 0) AS n_bajo, coalesce(me, 0) AS n_medio, coalesce(al, 0) AS n_alto, coalesce(cr, 0) AS n_criticos FROM (SELECT DISTINCT cod_dpto, dpto FROM divipola) d
LEFT JOIN (SELECT cod_dpto, count(*) AS n, sum(valor_contrato) AS v, {_mean} AS m, count(*) FILTER (WHERE tier = 'bajo') AS b, count(*) FILTER (WHERE tier = 'medio') AS me, count(*) FILTER (WHERE tier = 'alto') AS al, count(*) FILTER (WHERE tier = 'critico') AS cr FROM contrato_score GROUP BY 1) USING (cod_dpto)"""


@query(sql(f"SELECT * REPLACE (round(valor_total, 2) AS valor_total, round(score_promedio, 6) AS score_promedio) FROM ({_depts})"))
def department_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = scored(spark, sf_dir, columns=("cod_dpto", "valor_contrato"))
    return rounded(rounded(exports.departments(m["contrato_score"], m["divipola"], P), "score_promedio"), "valor_total", digits=2)


_padded = "CASE WHEN length(cod_dpto) < 2 THEN lpad(cod_dpto, 2, '0') ELSE cod_dpto END"


@query(sql(f"""SELECT {_padded} AS cod_dpto, n_contratos, (SELECT count(*) FROM municipio_score x WHERE x.cod_dpto = d.cod_dpto) AS n_municipios,
  (SELECT nit_entidad_norm FROM entidad_score x WHERE x.cod_dpto = d.cod_dpto ORDER BY round(score, 9) DESC NULLS LAST, valor_total DESC NULLS LAST, nit_entidad_norm LIMIT 1) AS best_entity, (SELECT least(5, count(*)) FROM entidad_score x WHERE x.cod_dpto = d.cod_dpto) AS n_top, (SELECT min(anio) FROM contrato_score x WHERE x.cod_dpto = d.cod_dpto) AS first_year FROM ({_depts}) d"""))
def department_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = scored(spark, sf_dir, "contrato_score", "municipio_score", "entidad_score", columns=("cod_dpto", "cod_mpio", "anio", "valor_contrato"))
    found = exports.department_details(m | {"entidad_score": rounded(m["entidad_score"], "score", digits=9)}, P, top=5)
    size = lambda c: F.greatest(F.size(c), F.lit(0)).cast("long")
    return found.select(
        "cod_dpto", "n_contratos", size("municipios").alias("n_municipios"), F.get("top_entidades", F.lit(0))["nit_entidad"].alias("best_entity"),
        size("top_entidades").alias("n_top"), F.get("serie_anio", F.lit(0))["anio"].alias("first_year")
    )


@query(sql("SELECT id_contrato, nit_entidad_norm AS nit_entidad, dpto, municipio, modalidad_norm AS modalidad, anio, valor_contrato, fecha_firma, round(score, 6) AS score, tier, n_flags_disparados FROM contrato_score JOIN divipola USING (cod_dpto, cod_mpio) WHERE score IS NOT NULL ORDER BY round(score, 9) DESC, valor_contrato DESC NULLS LAST, id_contrato LIMIT 2500"))
def topn_priority_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = scored(spark, sf_dir)
    found = exports.priority_cases(m | {"contrato_score": rounded(m["contrato_score"], "score", digits=9)}, flags=False)
    return rounded(found.select("id_contrato", "nit_entidad", "dpto", "municipio", "modalidad", "anio", "valor_contrato", "fecha_firma", "score", "tier", "n_flags_disparados"), "score")


@query(sql("SELECT id_contrato, fecha_firma, valor_contrato, municipio FROM contrato_score JOIN divipola USING (cod_dpto, cod_mpio) WHERE score IS NOT NULL AND fecha_firma <= DATE '1998-06-30' ORDER BY fecha_firma DESC, id_contrato LIMIT 1000"))
def topn_recent_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.recent_contracts(scored(spark, sf_dir), today="1998-06-30", flags=False).select("id_contrato", "fecha_firma", "valor_contrato", "municipio")


@query(sql("SELECT nit_entidad_norm, dpto, round(score, 6) AS score, tier FROM entidad_score JOIN (SELECT DISTINCT cod_dpto, dpto FROM divipola) USING (cod_dpto) ORDER BY round(score, 9) DESC NULLS LAST, round(valor_total, 2) DESC NULLS LAST, nit_entidad_norm LIMIT 300"))
def topn_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = scored(spark, sf_dir, "entidad_score")
    exact = rounded(rounded(m["entidad_score"], "score", digits=9), "valor_total", digits=2)
    return rounded(exports.top_entities(m | {"entidad_score": exact}).select("nit_entidad_norm", "dpto", "score", "tier"), "score")


@query(sql("SELECT doc_proveedor_norm, round(score, 6) AS score, tier FROM proveedor_score ORDER BY round(score, 9) DESC, round(valor_total, 2) DESC, doc_proveedor_norm LIMIT 300"))
def topn_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    exact = rounded(rounded(scored(spark, sf_dir, "proveedor_score")["proveedor_score"], "score", digits=9), "valor_total", digits=2)
    return rounded(exports.top_suppliers(exact).select("doc_proveedor_norm", "score", "tier"), "score")


@query(sql("SELECT id_contrato, tier, cod_dpto FROM contrato_score WHERE tier = 'medio' AND cod_dpto = '7' AND (contains(lower(nombre_proveedor), 'supplier 1') OR contains(lower(id_contrato), 'supplier 1') OR contains(lower(nombre_entidad), 'supplier 1'))"))
def filter_and_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.filtered(scored(spark, sf_dir, columns=("nombre_entidad", "nombre_proveedor", "nit_entidad_norm", "doc_proveedor_norm", "cod_dpto", "cod_mpio", "anio", "valor_contrato"))["contrato_score"], " Supplier 1", tier="medio", cod_dpto="7").select("id_contrato", "tier", "cod_dpto")


@query(sql("SELECT DISTINCT modalidad_norm FROM fct_contrato"))
def facet_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.facet_values(testdata.contracts(spark, sf_dir), "modalidad_norm")


@query(sql("SELECT id_contrato, tier FROM contrato_score WHERE id_contrato = '100-1'"))
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir, columns=())["contrato_score"].select("id_contrato", "tier")
    return exports.found_by_id("100-1", rows.where("tier = 'critico'"), rows)


@query(sql("SELECT cod_dpto, n - i + 1 AS position, round(CASE WHEN n > 1 THEN (i - 1) / (n - 1) ELSE 0.5 END, 6) AS percentile FROM (SELECT cod_dpto, row_number() OVER (ORDER BY v, cod_dpto) AS i, count(*) OVER () AS n FROM (SELECT cod_dpto, round(sum(valor_contrato), 2) AS v FROM fct_contrato GROUP BY 1))"))
def ordinal_rank_departments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = testdata.contracts(spark, sf_dir).groupBy("cod_dpto").agg(F.round(F.sum("valor_contrato"), 2).alias("v"))
    return rounded(ordinal_rank(rows, F.col("v"), F.col("cod_dpto")).drop("v"), "percentile")
