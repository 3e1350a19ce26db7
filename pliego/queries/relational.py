"""Scans, joins, aggregates, windows, top lists and set operations on their own, over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pliego.functions.numbers import mean_of_parts, rate, ratio, weighted_mean, weighted_parts
from pliego.operators import dedup, joins, patterns, profiles, ranking, sketches, windows
from pliego.queries.oracle import sql
from pliego.queries.registry import query, rounded
from pliego.sinks import artifacts
from pliego.sources import documents, files, links, sheets
from pliego.testdata import WINDOWS, contracts, table

# Scans and projections


@query("SELECT c_custkey, c_nationkey, c_mktsegment FROM customer WHERE c_acctbal BETWEEN 0 AND 5000 AND c_mktsegment NOT IN ('BUILDING')")
def scan_project_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns and predicates reach the scan."""
    return table(spark, sf_dir, "customer").where(F.col("c_acctbal").between(0, 5000) & ~F.col("c_mktsegment").isin("BUILDING")).select("c_custkey", "c_nationkey", "c_mktsegment")


@query("SELECT o_custkey, o_orderkey FROM orders WHERE (o_orderpriority LIKE '1%' OR o_orderpriority LIKE '%LOW') AND year(o_orderdate) BETWEEN 1996 AND 1997")
def predicate_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders")
    period = files.in_period(F.col("o_orderdate").cast("date"), "date", 1996, 1997)
    return files.projected(rows.where(joins.like_any(F.upper("o_orderpriority"), ["1%", "%LOW"]) & period), ["o_custkey", "o_orderkey"])


@query("SELECT * EXCLUDE (s_acctbal, s_name) FROM supplier")
def select_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").drop("s_acctbal", "s_name")


@query("SELECT 'orders' AS file, count(*) AS n FROM orders UNION ALL SELECT 'customer', count(*) FROM customer")
def scan_file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = [files.parts(spark, f"{sf_dir}/{t}.parquet", with_file=True).select(F.lit(t).alias("file"), "file_name") for t in ("orders", "customer")]
    return both[0].unionByName(both[1]).where(F.col("file_name").endswith(".parquet")).groupBy("file").agg(F.count("*").alias("n"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS nombre, CAST(c_nationkey AS VARCHAR) AS lugar, CAST(NULL AS VARCHAR) AS extra FROM customer UNION ALL SELECT CAST(s_suppkey AS VARCHAR), s_name, CAST(s_nationkey AS VARCHAR), NULL FROM supplier")
def heterogeneous_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    shape = {"id": ("id", "c_custkey", "s_suppkey"), "nombre": ("c_name", "s_name"), "lugar": ("c_nationkey", "s_nationkey"), "extra": ("none_has_it",)}
    return files.aligned([table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")], shape)


@query("SELECT user_id AS departamento, event_type AS municipio, CAST(year(ts) AS INTEGER) AS anio FROM (SELECT CAST(user_id AS VARCHAR) AS user_id, event_type, ts FROM events)")
def sheet_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a sheet: a banner, an empty row, a header, then rows with the year in the last column."""
    rows = table(spark, sf_dir, "events").select((F.col("event_id") + 10).alias("row"), F.array(F.lit(None).cast("string"), F.col("user_id").cast("string"), "event_type", F.year("ts").cast("string")).alias("cells"))
    head = spark.createDataFrame([(1, ["Base de hechos", None, None, None]), (2, [None, None, None, None]), (3, ["#", " Departamento", "MUNICIPIO", "Año"])], "row long, cells array<string>")
    return sheets.facts(head.unionByName(rows)).select("departamento", "municipio", "anio")


@query("SELECT page_id, list_filter(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1), lambda x: true)[1] AS link, CAST(len(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS BIGINT) AS n FROM pages WHERE len(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) > 0")
def link_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = links.links(table(spark, sf_dir, "pages"), "page_id", "url", "html", endings=None)
    return found.groupBy("page_id").agg(F.min_by("link", "at").alias("link"), F.count("*").alias("n"))


def echo(options: dict[str, str]):
    """Transport: a server whose documents hold their own URL; those of every seventh length of URL are not there."""
    return lambda url: (404, {}, b"") if len(url) % 7 == 0 else (200, {"Content-Type": "text/plain"}, url.encode())


@query(r"""
WITH found AS (SELECT regexp_extract(url, '^[a-z]+://[^/?#]*') || unnest(regexp_extract_all(html, '(?i)href\s*=\s*["'']([^"''>]+)["'']', 1)) AS url FROM pages)
SELECT url, CASE WHEN length(url) % 7 > 0 THEN sha256(url) END AS sha256, CASE WHEN length(url) % 7 > 0 THEN octet_length(encode(url)) END AS n_bytes, length(url) % 7 = 0 AS failed FROM (SELECT DISTINCT url FROM found)""")
def documents_fetched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that a page links to, fetched once: bytes, digest, or why there is none."""
    found = links.links(table(spark, sf_dir, "pages"), "page_id", "url", "html", endings=None)
    got = documents.fetched(found, {"transport": f"{__name__}:echo"})
    return got.select("url", F.sha2("body", 256).alias("sha256"), "n_bytes", F.col("failure").isNotNull().alias("failed"))


@query("SELECT count(*) AS n, left(CAST(max(o_orderdate) AS VARCHAR), 10) AS latest FROM orders")
def source_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").agg(F.count("*").alias("n"), F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("latest"))


# Joins


@query("""
WITH spans AS (SELECT l_suppkey, l_returnflag, CAST(min(l_shipdate) AS DATE) AS first, CAST(max(l_shipdate) AS DATE) AS last FROM lineitem GROUP BY l_suppkey, l_returnflag, l_orderkey % 50)
SELECT CAST(o_orderdate AS DATE) AS d, count(DISTINCT o_orderkey) AS n_orders, count(first) / count(DISTINCT o_orderkey) AS n_spans, coalesce(sum(l_suppkey) / count(DISTINCT o_orderkey), 0) AS suppliers
FROM orders LEFT JOIN spans ON CAST(o_orderdate AS DATE) BETWEEN first AND last GROUP BY 1""")
def overlapping_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of many long, overlapping spans of days hold each order's day."""
    items = table(spark, sf_dir, "lineitem")
    day = F.col("l_shipdate").cast("date")
    spans = items.groupBy("l_suppkey", "l_returnflag", F.col("l_orderkey") % 50).agg(F.min(day).alias("first"), F.max(day).alias("last")).select("l_suppkey", "first", "last")
    days = table(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").cast("date").alias("d")).agg(F.count("*").alias("n_orders"))
    found = joins.range_totals(days, "d", spans, "first", "last", "n_spans", {"suppliers": "l_suppkey"})
    return found.select("d", "n_orders", F.col("n_spans").cast("double").alias("n_spans"), F.col("suppliers").cast("double").alias("suppliers"))


@query("""
WITH wanted AS (SELECT DISTINCT '%' || right(c_name, 4) || '_' AS p FROM customer WHERE c_name IS NOT NULL UNION SELECT DISTINCT '%' || split_part(p_name, ' ', 2) || '%' FROM part UNION SELECT DISTINCT left(s_name, 3) || '%0' || right(s_name, 2) FROM supplier),
texts AS (SELECT c_name AS t FROM customer UNION SELECT p_name FROM part UNION SELECT s_name FROM supplier)
SELECT p AS pattern, count(*) AS n, min(t) AS first FROM wanted JOIN texts ON t LIKE p GROUP BY 1""")
def pattern_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that fit each of many patterns, met through an index of the patterns' pieces."""
    read = lambda name, col: table(spark, sf_dir, name).select(F.col(col).alias("t"))
    names = [read("customer", "c_name"), read("part", "p_name"), read("supplier", "s_name")]
    t = F.col("t")
    made = (F.concat(F.lit("%"), F.right(t, F.lit(4)), F.lit("_")), F.concat(F.lit("%"), F.split_part(t, F.lit(" "), F.lit(2)), F.lit("%")), F.concat(F.left(t, F.lit(3)), F.lit("%0"), F.right(t, F.lit(2))))
    wanted = [n.select(p.alias("pattern")) for n, p in zip(names, made, strict=True)]
    found = patterns.like_join(names[0].union(names[1]).union(names[2]), "t", wanted[0].union(wanted[1]).union(wanted[2]), "pattern")
    return found.groupBy("pattern").agg(F.count("*").alias("n"), F.min("t").alias("first"))


@query("SELECT o_orderkey, coalesce(n, 'OTRO') AS prioridad, coalesce(urgent, false) AS urgent FROM orders LEFT JOIN (VALUES ('1-URGENT', 'ALTA', true), ('2-HIGH', 'ALTA', false)) AS r(p, n, urgent) ON o_orderpriority = p")
def lookup_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref = spark.createDataFrame([("1-URGENT", "ALTA", True), ("2-HIGH", "ALTA", False)], "p string, prioridad string, urgent boolean")
    return joins.lookup(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), ref, {"o_orderpriority": "p"}, {"prioridad": "OTRO", "urgent": False}).drop("o_orderpriority")


@query("SELECT s_suppkey, n_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey AND upper(trim(' ' || n_name)) = upper('nation_' || s_nationkey)")
def computed_key_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.upper(F.trim(F.concat(F.lit(" "), "n_name"))).alias("k"))
    rows = table(spark, sf_dir, "supplier").withColumn("_k", F.upper(F.concat(F.lit("nation_"), "s_nationkey")))
    return joins.lookup(rows, names, {"s_nationkey": "n_nationkey", "_k": "k"}, {"n_name": None}).select("s_suppkey", "n_name")


@query("SELECT o_orderkey, window_id FROM orders LEFT JOIN (VALUES " + ", ".join(f"('{w}', DATE '{a}', DATE '{b}')" for w, _, a, b in WINDOWS) + ") AS w(window_id, inicio, fin) ON CAST(o_orderdate AS DATE) BETWEEN inicio AND fin")
def range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = spark.createDataFrame(WINDOWS, "window_id string, tipo string, a string, b string").select("window_id", F.col("a").cast("date").alias("inicio"), F.col("b").cast("date").alias("fin"))
    return joins.in_range(table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("d")), "d", ranges, "inicio", "fin").select("o_orderkey", "window_id")


@query("SELECT p_partkey, count(l_orderkey) AS n, count(l_orderkey) FILTER (WHERE l_returnflag = 'R') AS n_returned, coalesce(max(l_quantity), 0) AS largest FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1")
def aggregate_back_to_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aggregated before the join, so rows are never multiplied."""
    stats = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("n_returned"), F.max("l_quantity").alias("largest"))
    return table(spark, sf_dir, "part").select("p_partkey").join(stats, "p_partkey", "left").fillna(0)


@query("SELECT c_custkey, round(c_acctbal - avg(c_acctbal) OVER w, 4) AS off_mean, round(stddev_pop(c_acctbal) OVER w, 4) AS sd, count(*) OVER w AS peers FROM customer WINDOW w AS (PARTITION BY c_nationkey, c_mktsegment)")
def peer_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, keys = table(spark, sf_dir, "customer"), ["c_nationkey", "c_mktsegment"]
    stats = rows.groupBy(*keys).agg(F.avg("c_acctbal").alias("m"), F.stddev_pop("c_acctbal").alias("sd"), F.count("*").alias("peers"))
    return rounded(rows.join(stats, keys).select("c_custkey", (F.col("c_acctbal") - F.col("m")).alias("off_mean"), "sd", "peers"), "off_mean", "sd", digits=4)


@query("SELECT coalesce(a.k, b.k) AS k, least(a.d, b.d) AS d, a.d AS d_a, b.d AS d_b, coalesce(a.d <> b.d, false) AS is_conflict, CAST((a.d IS NOT NULL)::INT + (b.d IS NOT NULL)::INT AS INTEGER) AS n_sources_matched FROM (SELECT o_custkey AS k, min(CAST(o_orderdate AS DATE)) AS d FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) a FULL JOIN (SELECT o_custkey AS k, min(CAST(o_orderdate AS DATE)) AS d FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) b ON a.k = b.k")
def full_outer_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = lambda s: table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == s).groupBy(F.col("o_custkey").alias("k")).agg(F.min(F.col("o_orderdate").cast("date")).alias("d"))
    return joins.earliest_of(first("F"), first("O"), "k", "d", ("a", "b"))


@query("SELECT p_partkey, p_retailprice > (SELECT avg(p_retailprice) FROM part) AS dear, round((SELECT avg(p_retailprice) FROM part), 4) AS border FROM part")
def cross_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    joined = joins.threshold(parts, parts.agg(F.avg("p_retailprice").alias("border")))
    return rounded(joined.select("p_partkey", (F.col("p_retailprice") > F.col("border")).alias("dear"), "border"), "border", digits=4)


_keys = "(SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_custkey END AS k FROM customer)"


@query(f"SELECT c_custkey FROM {_keys} WHERE k NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def null_aware_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 10 != 0, F.col("c_custkey")).alias("k"))
    return joins.excluding(rows, "k", table(spark, sf_dir, "orders").where("o_orderstatus = 'F'"), "o_custkey").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > 300000)")
def semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = table(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(big, "c_custkey", "left_semi").select("c_custkey")


@query("SELECT c_nationkey, count(*) AS n, CAST(sum(CAST(EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS INT)) AS BIGINT) AS n_with FROM customer GROUP BY 1")
def exists_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return joins.exists_marker(table(spark, sf_dir, "customer"), some, ["c_custkey"], "with_p").groupBy("c_nationkey").agg(F.count("*").alias("n"), F.count_if("with_p").alias("n_with"))


@query("SELECT l_orderkey, l_linenumber, a.n_name AS customer_nation, b.n_name AS supplier_nation FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation a ON a.n_nationkey = c_nationkey LEFT JOIN nation b ON b.n_nationkey = s_nationkey")
def dimension_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    named = lambda k, out: nation.select(F.col("n_nationkey").alias(k), F.col("n_name").alias(out))
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.join(named("c_nationkey", "customer_nation"), "c_nationkey", "left").join(named("s_nationkey", "supplier_nation"), "s_nationkey", "left").select("l_orderkey", "l_linenumber", "customer_nation", "supplier_nation")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN p_name WHEN l_returnflag = 'A' THEN s_name END AS other FROM lineitem LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey WHERE l_returnflag IN ('R', 'A')")
def split_then_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each branch joins on plain equality, then both are put together."""
    rows = table(spark, sf_dir, "lineitem")
    a = rows.where("l_returnflag = 'R'").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"), "left").select("l_orderkey", "l_linenumber", F.col("p_name").alias("other"))
    b = rows.where("l_returnflag = 'A'").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"), "left").select("l_orderkey", "l_linenumber", F.col("s_name").alias("other"))
    return a.unionByName(b)


# Aggregates


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS sum_qty, round(avg(l_extendedprice), 4) AS avg_price, min(l_shipdate)::DATE AS first, max(l_shipdate)::DATE AS last, count(*) FILTER (WHERE l_tax > 0.04) AS taxed, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY ALL")
def group_by_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"), F.sum("l_quantity").alias("sum_qty"), F.avg("l_extendedprice").alias("avg_price"), F.min("l_shipdate").cast("date").alias("first"), F.max("l_shipdate").cast("date").alias("last"),
        F.count_if(F.col("l_tax") > 0.04).alias("taxed"), F.count_distinct("l_suppkey").alias("suppliers"),
    )
    return rounded(found, "avg_price", digits=4)


@query("SELECT c_nationkey, round(avg(CASE WHEN c_acctbal < 0 THEN 100.0 ELSE 0 END), 6) AS pct_negative, bool_or(c_acctbal > 9900) AS any_rich, coalesce(max(c_acctbal) FILTER (WHERE c_mktsegment = 'BUILDING'), max(c_acctbal)) AS pick FROM customer GROUP BY 1")
def rates_and_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = F.coalesce(F.max(F.when(F.col("c_mktsegment") == "BUILDING", F.col("c_acctbal"))), F.max("c_acctbal"))
    return rounded(table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(rate(F.col("c_acctbal") < 0).alias("pct_negative"), F.bool_or(F.col("c_acctbal") > 9900).alias("any_rich"), pick.alias("pick")), "pct_negative")


@query("SELECT o_custkey, string_agg(DISTINCT o_orderstatus, ', ' ORDER BY o_orderstatus) AS statuses, string_agg(DISTINCT o_orderpriority, ', ' ORDER BY o_orderpriority) FILTER (WHERE o_totalprice > 200000) AS big FROM orders GROUP BY 1")
def distinct_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = lambda c: F.nullif(F.array_join(F.array_sort(F.collect_set(c)), ", "), F.lit(""))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(listed("o_orderstatus").alias("statuses"), listed(F.when(F.col("o_totalprice") > 200000, F.col("o_orderpriority"))).alias("big"))


_w = "CASE WHEN p_size > 10 THEN p_size - 10 ELSE 0 END"


@query(f"SELECT p_brand, round(CASE WHEN sum({_w}) > 0 THEN sum({_w} * p_retailprice) / sum({_w}) ELSE avg(p_retailprice) END, 6) AS mean FROM part GROUP BY 1")
def weighted_mean_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    weight = F.when(F.col("p_size") > 10, F.col("p_size") - 10).cast("double")
    return rounded(table(spark, sf_dir, "part").groupBy("p_brand").agg(weighted_mean(F.col("p_retailprice"), weight).alias("mean")), "mean")


@query("SELECT c_nationkey, c_mktsegment, round(sum(abs(c_acctbal) * c_custkey) / sum(abs(c_acctbal)), 4) AS mean, count(*) AS n FROM customer GROUP BY GROUPING SETS ((c_nationkey, c_mktsegment), (c_nationkey), ())")
def multi_level_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three levels from one pass over the rows."""
    rows = table(spark, sf_dir, "customer")
    parts = rows.rollup("c_nationkey", "c_mktsegment").agg(*weighted_parts(F.col("c_custkey").cast("double"), F.abs("c_acctbal")))
    return rounded(parts.select("c_nationkey", "c_mktsegment", mean_of_parts(F.col("wv"), F.col("w"), F.col("v"), F.col("n")).alias("mean"), "n"), "mean", digits=4)


@query("SELECT o_custkey, round(min(n) / sum(n), 6) AS least FROM (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL) GROUP BY 1")
def two_phase_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.count("*").alias("n"))
    return rounded(counts.groupBy("o_custkey").agg(ratio(F.min("n"), F.sum("n")).alias("least")), "least")


@query("SELECT o_custkey, max(o_totalprice) AS largest FROM orders GROUP BY 1 HAVING max(o_totalprice) >= 400000 OR o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9500)")
def having_or_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    rich = table(spark, sf_dir, "customer").where("c_acctbal > 9500").select(F.col("c_custkey").alias("o_custkey"))
    largest = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_totalprice").alias("largest"))
    return joins.exists_marker(largest, rich, ["o_custkey"], "rich").where((F.col("largest") >= 400000) | F.col("rich")).drop("rich")


@query("SELECT col, n_rows, round(null_pct, 1) AS null_pct, n_distinct, e1 FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS col, count(*) AS n_rows, (count(*) - count({c})) * 100.0 / count(*) AS null_pct, count(DISTINCT {c}) AS n_distinct, min(CAST({c} AS VARCHAR)) AS e1 FROM events" for c in ("event_type", "user_id", "props")) + ")")
def profile_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = profiles.profile(table(spark, sf_dir, "events"), ["event_type", "user_id", "props"])
    return found.select("col", "n_rows", "null_pct", "n_distinct", F.get("examples", F.lit(0)).alias("e1"))


_PROFILED = {"l_orderkey": "bigint", "l_shipdate": "timestamp", "l_extendedprice": "double", "l_returnflag": "string", "l_linenumber": "int", "l_discount": "double"}


@query(
    " UNION ALL ".join(f"SELECT '{c}' AS col, '{t}' AS type, count(*) AS n_rows, round((count(*) - count({c})) * 100.0 / count(*), 1) AS null_pct, count(DISTINCT {c}) AS n_distinct FROM lineitem" for c, t in _PROFILED.items())
)
def profile_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of few and of very many values: only the cells of the latter are shuffled."""
    rows = table(spark, sf_dir, "lineitem").withColumn("l_shipdate", F.col("l_shipdate").cast("timestamp"))
    return profiles.profile(rows, list(_PROFILED)).drop("examples")


_SHARES = (0.5, 0.75, 0.9, 0.95, 0.99, 0.999, 1.0)


@query(f"SELECT year(l_shipdate) AS anio, share, count(*) AS n, true AS within FROM lineitem, (SELECT unnest({list(_SHARES)}) AS share) WHERE l_extendedprice IS NOT NULL GROUP BY 1, 2")
def quantile_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices by year from sketches kept by month. within: the estimate's true rank is off by no more than the stated bound."""
    rows = table(spark, sf_dir, "lineitem").select(F.year("l_shipdate").alias("anio"), F.month("l_shipdate").alias("mes"), F.col("l_extendedprice").alias("v"))
    yearly = sketches.quantiles(sketches.merged(sketches.quantile_sketches(rows, F.col("v"), ["anio", "mes"]), ["anio"]), _SHARES)
    wide = yearly.groupBy("anio", "n").pivot("share", list(_SHARES)).agg(F.first("value")).toDF("anio", "n", *[f"s{i}" for i in range(len(_SHARES))])
    each = [F.struct(F.count_if(F.col("v") < F.col(f"s{i}")).alias("below"), F.count_if(F.col("v") <= F.col(f"s{i}")).alias("to"), F.lit(s).alias("share")) for i, s in enumerate(_SHARES)]
    ranks = rows.join(joins.small(wide), "anio").groupBy("anio", "n").agg(*[e.alias(f"e{i}") for i, e in enumerate(each)])
    placed = ranks.select("anio", "n", F.explode(F.array(*[f"e{i}" for i in range(len(_SHARES))])).alias("e")).select("anio", "n", "e.*")
    error = sketches.RANK_ERROR
    within = (F.col("below") <= (F.col("share") + error) * F.col("n")) & (F.col("to") >= (F.col("share") - error) * F.col("n"))
    return placed.select("anio", "share", "n", within.alias("within"))


# Windows


@query("SELECT o_custkey, o_orderkey, o_orderdate::DATE AS d FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC NULLS LAST) = 1")
def keep_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.keep_latest(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey", F.col("o_orderdate").cast("date").alias("d"))


@query("SELECT o_custkey, o_orderpriority FROM (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, o_orderpriority) = 1")
def mode_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.mode_per_key(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderpriority")


@query("SELECT o_orderkey, count(*) OVER w AS n, round(sum(o_totalprice) OVER w, 2) AS total FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE) RANGE BETWEEN INTERVAL 90 DAYS PRECEDING AND INTERVAL 90 DAYS FOLLOWING)")
def range_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("d"), "o_totalprice")
    return rounded(windows.around(rows, ["o_custkey"], "d", 90, "o_totalprice", "n", "total").select("o_orderkey", "n", "total"), "total", digits=2)


@query("SELECT o_orderkey, CAST(floor((CAST(o_orderdate AS DATE) - min(CAST(o_orderdate AS DATE)) OVER (PARTITION BY o_custkey)) / 730.0) AS INTEGER) AS bucket FROM orders")
def anchored_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("d"))
    return windows.buckets(rows, ["o_custkey"], "d", 730).select("o_orderkey", "bucket")


@query("SELECT o_custkey, count(*) AS n, CAST(sum(CASE WHEN o_orderstatus <> before THEN 1 ELSE 0 END) AS BIGINT) AS n_switches FROM (SELECT *, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE), o_orderkey) AS before FROM orders) GROUP BY 1")
def change_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", "o_orderkey", F.col("o_orderdate").cast("date").alias("d"))
    return windows.switches(rows, ["o_custkey"], "o_orderstatus", "d", "o_orderkey")


@query("SELECT p_partkey, count(*) OVER (PARTITION BY p_name) AS freq FROM part")
def text_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return rows.join(rows.groupBy("p_name").agg(F.count("*").alias("freq")), "p_name").select("p_partkey", "freq")


@query("SELECT c_custkey, round(percent_rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal), 9) AS percentile FROM customer")
def percent_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ranking.percent_rank(table(spark, sf_dir, "customer"), "c_nationkey", "c_acctbal").select("c_custkey", "percentile"), "percentile", digits=9)


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS position FROM orders")
def global_row_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.numbered(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), F.col("o_totalprice").desc(), F.col("o_orderkey")).drop("o_totalprice")


@query(" UNION ALL ".join(f"SELECT CAST({s} AS DOUBLE) AS share, round(percentile_cont({s}) WITHIN GROUP (ORDER BY o_totalprice), 4) AS value FROM orders" for s in (0, 0.1, 0.25, 0.5, 0.75, 0.9, 1)))
def percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ranking.percentiles(table(spark, sf_dir, "orders"), "o_totalprice", (0, 0.1, 0.25, 0.5, 0.75, 0.9, 1)), "value", digits=4)


# Top lists, chunks, sets


@query("SELECT c_nationkey, c_custkey, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS INTEGER) AS position FROM customer QUALIFY position <= 5")
def top_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.top_per_group(table(spark, sf_dir, "customer"), ["c_nationkey"], [F.col("c_acctbal").desc(), F.col("c_custkey")], 5).select("c_nationkey", "c_custkey", "position")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 100")
def top_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc_nulls_last(), "o_orderkey").limit(100)


@query("SELECT c_custkey, CAST(floor((i - 1) / 64) AS INTEGER) AS chunk_index, CAST(ceil(n / 64) AS INTEGER) AS n_chunks, n AS n_items_total FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS i, count(*) OVER () AS n FROM customer)")
def chunking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return artifacts.chunked(table(spark, sf_dir, "customer").select("c_custkey"), 64, F.col("c_custkey")).drop("position")


@query("SELECT CAST(floor((i - 1) / 64) AS INTEGER) AS chunk_index, count(*) AS n_items, max(c_custkey) AS last FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS i FROM customer) GROUP BY 1")
def json_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands in the chunks' JSON."""
    ready = artifacts.chunk_json(artifacts.chunked(table(spark, sf_dir, "customer").select("c_custkey"), 64, F.col("c_custkey")), ["c_custkey"])
    items = F.from_json(F.get_json_object("json", "$.items"), "array<struct<c_custkey:long>>")
    return ready.select("chunk_index", F.size(items).cast("long").alias("n_items"), F.element_at(items, -1)["c_custkey"].alias("last"))


@query("SELECT 'price' AS rule, count(*) FILTER (WHERE NOT coalesce(p_retailprice > 1000, false)) AS failed FROM part UNION ALL SELECT 'size', count(*) FILTER (WHERE NOT coalesce(p_size BETWEEN 1 AND 40, false)) FROM part")
def schema_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return artifacts.check_columns(table(spark, sf_dir, "part"), {"price": F.col("p_retailprice") > 1000, "size": F.col("p_size").between(1, 40)})


@query("SELECT DISTINCT c_mktsegment AS k, 'c' AS origin FROM customer UNION ALL SELECT DISTINCT o_orderpriority, 'o' FROM orders UNION ALL SELECT DISTINCT n_name, 'n' FROM nation")
def union_tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [table(spark, sf_dir, t).select(F.col(c).alias("k"), F.lit(tag).alias("origin")).distinct() for t, c, tag in (("customer", "c_mktsegment", "c"), ("orders", "o_orderpriority", "o"), ("nation", "n_name", "n"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT nk, CAST(sum(n) AS BIGINT) AS n FROM (SELECT c_nationkey AS nk, count(*) AS n FROM customer GROUP BY 1 UNION ALL SELECT s_nationkey, count(*) FROM supplier GROUP BY 1) GROUP BY 1")
def union_of_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda t, c: table(spark, sf_dir, t).groupBy(F.col(c).alias("nk")).agg(F.count("*").alias("n"))
    return one("customer", "c_nationkey").unionByName(one("supplier", "s_nationkey")).groupBy("nk").agg(F.sum("n").alias("n"))


@query("SELECT c_custkey FROM customer ORDER BY md5(c_custkey || ':7'), c_custkey LIMIT 50")
def deterministic_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.sampled(table(spark, sf_dir, "customer"), "c_custkey", 50).select("c_custkey")


@query(sql("SELECT id_contrato, row_id FROM fct_contrato WHERE fecha_firma <= DATE '1997-01-01' AND duracion_dias_inicial >= 0"))
def date_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No dates in the future, no negative gaps."""
    return contracts(spark, sf_dir).where("fecha_firma <= DATE'1997-01-01' AND duracion_dias_inicial >= 0").select("id_contrato", "row_id")
