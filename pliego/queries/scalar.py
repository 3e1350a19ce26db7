"""Column functions over the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pliego.functions import casts, evidence, numbers, text
from pliego.functions.sql import register
from pliego.params import Params
from pliego.queries.registry import query
from pliego.sources.links import absolute
from pliego.testdata import table

_raw = """(SELECT l_orderkey, l_linenumber, CASE l_orderkey % 8 WHEN 0 THEN CAST(l_linenumber AS VARCHAR) WHEN 1 THEN l_linenumber || '.5' WHEN 2 THEN '-12.5' WHEN 3 THEN '5d' WHEN 4 THEN '1e3' WHEN 5 THEN '' WHEN 6 THEN 'x' || l_linenumber ELSE '99999999999' END AS t,
  CASE l_orderkey % 6 WHEN 0 THEN '2023' WHEN 1 THEN '2023-05-01 junk' WHEN 2 THEN '2023-02-30' WHEN 3 THEN strftime(l_shipdate, '%Y-%m-%dT00:00:00.000') WHEN 4 THEN strftime(l_shipdate, '%Y%m%d') ELSE strftime(l_shipdate, '%Y-%m-%d') END AS d FROM lineitem)"""


def raw_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = F.col, F.col("l_linenumber").cast("string")
    kind, day = c("l_orderkey") % 8, c("l_orderkey") % 6
    number = F.when(kind == 0, n).when(kind == 1, F.concat(n, F.lit(".5"))).when(kind == 2, "-12.5").when(kind == 3, "5d").when(kind == 4, "1e3").when(kind == 5, "").when(kind == 6, F.concat(F.lit("x"), n)).otherwise("99999999999")
    fmt = lambda f: F.date_format("l_shipdate", f)
    date = F.when(day == 0, "2023").when(day == 1, "2023-05-01 junk").when(day == 2, "2023-02-30").when(day == 3, fmt("yyyy-MM-dd'T'00:00:00.000")).when(day == 4, fmt("yyyyMMdd")).otherwise(fmt("yyyy-MM-dd"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", number.alias("t"), date.alias("d"))


@query(f"SELECT l_orderkey, l_linenumber, TRY_CAST(t AS DOUBLE) AS as_double, TRY_CAST(t AS INTEGER) AS as_int, TRY_CAST(d AS DATE) AS as_date, CASE WHEN length(d) = 8 THEN CAST(TRY_STRPTIME(d, '%Y%m%d') AS DATE) END AS as_compact, coalesce(trim(t), '') <> '' AS present FROM {_raw}")
def lenient_casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, d = F.col("t"), F.col("d")
    return raw_texts(spark, sf_dir).select(
        "l_orderkey", "l_linenumber", casts.lenient_double(t).alias("as_double"), casts.lenient_int(t).alias("as_int"), casts.lenient_date(d).alias("as_date"),
        casts.compact_date(d).alias("as_compact"), casts.present(t).alias("present")
    )


_plain = "translate({}, 'áàâãäéèêëíìîïóòôõöúùûüñçÁÀÂÃÄÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÑÇ', 'aaaaaeeeeiiiiooooouuuuncAAAAAEEEEIIIIOOOOOUUUUNC')"


@query("SELECT doc_id, regexp_replace(coalesce(text, ''), '[^0-9]', '', 'g') AS digits, md5(upper(regexp_replace(translate(trim(coalesce(text, '')), 'áéíóúüñÁÉÍÓÚÜÑ', 'aeiouunAEIOUUN'), '[^A-Za-z0-9 ,.]', '', 'g'))) AS key, md5(upper(regexp_replace(translate(coalesce(text, ''), 'ÁÉÍÓÚÜÑ', 'AEIOUUN'), '[^A-Z0-9 ,.]', '', 'g'))) AS strict_key, md5(" + _plain.format("coalesce(text, '')") + ") AS plain FROM documents")
def text_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    some = F.coalesce(t, F.lit(""))
    return table(spark, sf_dir, "documents").select(
        "doc_id", text.digits(t).alias("digits"), F.md5(text.name_key(t).cast("binary")).alias("key"),
        F.md5(text.strict_name_key(some).cast("binary")).alias("strict_key"), F.md5(text.unaccented(some).cast("binary")).alias("plain")
    )


_suffixes = ["S.A.S.", "SA", "LTDA.", "S EN C", "E.U.", ""]


@query("SELECT c_custkey, upper(c_name) AS company FROM customer")
def company_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' names with a legal form behind them, spaces around and doubled."""
    form = F.get(F.array(*[F.lit(s) for s in _suffixes]), (F.col("c_custkey") % len(_suffixes)).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", text.company_name(F.concat(F.lit("  "), "c_name", F.lit("  "), form, F.lit(" "))).alias("company"))


_doc = "CASE c_custkey % 6 WHEN 0 THEN '900.' || lpad(CAST(c_custkey AS VARCHAR), 6, '1') || '-7' WHEN 1 THEN '80000' || lpad(CAST(c_custkey AS VARCHAR), 4, '0') WHEN 2 THEN CAST(c_custkey AS VARCHAR) WHEN 3 THEN '10' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') WHEN 4 THEN '55' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') ELSE 'n/a' END"


def document_texts() -> Column:
    """Customers' keys as document numbers in several spellings."""
    key = F.col("c_custkey").cast("string")
    kind = F.col("c_custkey") % 6
    return F.when(kind == 0, F.concat(F.lit("900."), F.lpad(key, 6, "1"), F.lit("-7"))).when(kind == 1, F.concat(F.lit("80000"), F.lpad(key, 4, "0"))).when(kind == 2, key).when(kind == 3, F.concat(F.lit("10"), F.lpad(key, 8, "0"))).when(kind == 4, F.concat(F.lit("55"), F.lpad(key, 9, "0"))).otherwise("n/a")


@query(f"SELECT c_custkey, nullif(n, '') AS doc_norm, nullif(CASE WHEN length(n) = 10 AND left(n, 1) IN ('8', '9') THEN left(n, 9) ELSE n END, '') AS nit_base, CASE WHEN n = '' THEN NULL WHEN length(n) <= 8 THEN true WHEN length(n) IN (9, 10) AND left(n, 1) IN ('8', '9') THEN false WHEN length(n) = 10 AND left(n, 1) = '1' THEN true END AS natural_person FROM (SELECT c_custkey, regexp_replace({_doc}, '[^0-9]', '', 'g') AS n FROM customer)")
def documents_and_persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = document_texts()
    rows = table(spark, sf_dir, "customer").select("c_custkey", text.document(raw).alias("doc"))
    return rows.select("c_custkey", "doc.doc_norm", "doc.nit_base", text.natural_person(F.coalesce("doc.doc_norm", F.lit(""))).alias("natural_person"))


@query(f"SELECT c_custkey, nullif(CASE WHEN length(n) = 10 AND left(n, 1) IN ('8', '9') THEN left(n, 9) ELSE n END, '') AS base FROM (SELECT c_custkey, regexp_replace({_doc}, '[^0-9]', '', 'g') AS n FROM customer)")
def sql_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base number through a function declared in SQL."""
    register(spark)
    rows = table(spark, sf_dir, "customer").select("c_custkey", text.digits(document_texts()).alias("n"))
    return rows.select("c_custkey", F.expr("nit_base(n)").alias("base"))


@query("SELECT p_partkey, TRY_CAST(left(CASE WHEN p_partkey % 3 = 0 THEN CAST(p_size AS VARCHAR) || '4321' WHEN p_partkey % 3 = 1 THEN CAST(p_size + 40 AS VARCHAR) || '99' ELSE 'x' END, 2) AS INTEGER) AS segment, CASE WHEN length(CAST(p_size AS VARCHAR)) < 2 THEN lpad(CAST(p_size AS VARCHAR), 2, '0') ELSE CAST(p_size AS VARCHAR) END AS padded, CAST(round_even(p_retailprice, 0) AS BIGINT) % 10 = 0 AS is_round, round(abs(p_retailprice / nullif(p_size - 7, 0) - 1), 6) AS deviation FROM part")
def codes_and_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, key = F.col("p_size"), F.col("p_partkey") % 3
    code = F.when(key == 0, F.concat(F.lit("V1."), size.cast("string"), F.lit("4321"))).when(key == 1, F.concat(F.lit("V12."), (size + 40).cast("string"), F.lit("99"))).otherwise("x")
    price = F.col("p_retailprice")
    return table(spark, sf_dir, "part").select(
        "p_partkey", text.unspsc_segment(code).alias("segment"), text.padded(size.cast("string"), 2).alias("padded"), numbers.is_multiple(price, 10).alias("is_round"),
        F.round(F.abs(numbers.ratio(price, size - 7) - 1), 6).alias("deviation")
    )


@query("SELECT o_orderkey, CAST(l AS INTEGER) AS days, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m, CAST(day(o_orderdate) AS INTEGER) AS d FROM (SELECT o_orderkey, o_orderdate, CAST(o_orderdate AS DATE) - DATE '1996-02-29' AS l FROM orders)")
def date_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.datediff(F.col("o_orderdate").cast("date"), F.lit("1996-02-29").cast("date")).alias("days"), F.year("o_orderdate").alias("y"),
        F.month("o_orderdate").alias("m"), F.dayofmonth("o_orderdate").alias("d")
    )


@query("SELECT c_custkey, CASE WHEN s >= 60 THEN 'critico' WHEN s >= 40 THEN 'alto' WHEN s >= 20 THEN 'medio' WHEN s >= 0 THEN 'bajo' END AS tier, round(coalesce(c_custkey / (c_custkey + 10.0) * s + (1 - c_custkey / (c_custkey + 10.0)) * 30, s, 30), 6) AS shrunk, round(coalesce((119 * s + 16 * e) / 135, s, e), 6) AS combined FROM (SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN CAST(c_custkey % 101 AS DOUBLE) END AS s, CASE WHEN c_custkey % 7 <> 0 THEN CAST(c_custkey % 90 AS DOUBLE) END AS e FROM customer)")
def score_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, key = Params(), F.col("c_custkey")
    s, e = F.when(key % 5 != 0, (key % 101).cast("double")), F.when(key % 7 != 0, (key % 90).cast("double"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", s.alias("s"), e.alias("e"))
    s, e = F.col("s"), F.col("e")
    return rows.select("c_custkey", numbers.tier(s, p).alias("tier"), F.round(numbers.shrunk(s, F.lit(30.0), key, 10.0), 6).alias("shrunk"), F.round(numbers.combined(s, e, 119, 16), 6).alias("combined"))


@query("SELECT n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN 'BOGOTA, D.C.' WHEN 1 THEN 'BOGOTA, D.C.' WHEN 2 THEN 'ARCHIPIELAGO DE SAN ANDRES, PROVIDENCIA Y SANTA CATALINA' WHEN 3 THEN 'NARINO' ELSE n_name END AS department FROM nation")
def department_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("n_nationkey") % 5
    raw = F.when(kind == 0, " Bogotá  D.C.").when(kind == 1, "Distrito Capital de Bogotá").when(kind == 2, "san andrés").when(kind == 3, "Nariño").otherwise(F.lower("n_name"))
    return table(spark, sf_dir, "nation").select("n_nationkey", text.department(raw).alias("department"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, n FROM (SELECT event_id, props, CASE WHEN event_id % 2 = 0 THEN '1' ELSE NULL END AS n FROM events)")
def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns to a JSON object, nulls kept, and back."""
    rows = table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.when(F.col("event_id") % 2 == 0, "1").alias("n"))
    packed = rows.select("event_id", evidence.as_json("k", "n").alias("j")).where(F.col("j").contains('"n":'))
    return packed.select("event_id", F.from_json("j", "k long, n string").alias("x")).select("event_id", "x.*")


@query("SELECT o_orderkey, o_orderstatus = 'F' AS yes FROM orders")
def truth_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.when(F.col("o_orderstatus") == "F", F.get(F.array(*[F.lit(w) for w in ("true", "Si", "1", "yes", "verdadero")]), (F.col("o_orderkey") % 5).cast("int"))).when(F.col("o_orderstatus") == "O", "no")
    return table(spark, sf_dir, "orders").select("o_orderkey", casts.truth(word).alias("yes"))


@query("SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || '/a/Datos%202022.xlsx' AS url, 'Datos_2022.xlsx' AS file FROM pages")
def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = absolute(F.lit("/a/Datos%202022.xlsx"), F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", url.alias("url"), text.file_name(url).alias("file"))
