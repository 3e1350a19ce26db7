"""Changed rows: high marks, upserts in batch and as a stream."""

from __future__ import annotations

import functools
import sqlite3
import uuid

from pyarrow import dataset
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pliego.operators.dedup import keep_latest
from pliego.queries.registry import query
from pliego.session import shared_dir
from pliego.sources.api import ApiDataSource
from pliego.streaming.incremental import high_mark, newer, upsert_available
from pliego.streaming.keyed import KeyedTable, Upsert
from pliego.testdata import table


@query("SELECT event_id, user_id FROM events WHERE ts > (SELECT max(ts) FROM events WHERE event_id % 100 = 7 AND event_id < (SELECT max(event_id) FROM events) / 2)")
def high_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows newer than the last one of an earlier pull."""
    rows = table(spark, sf_dir, "events")
    half = rows.agg(F.max("event_id")).first()[0] / 2
    mark = high_mark(rows.where((F.col("event_id") % 100 == 7) & (F.col("event_id") < half)), "ts")
    return newer(rows.withColumn("ts", F.col("ts").cast("timestamp_ntz")), "ts", mark).select("event_id", "user_id")


@query("SELECT user_id, max(event_id) AS event_id FROM events GROUP BY 1")
def upsert_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_id") % 2 == 0, "part-00000").otherwise("part-refresh-00000").alias("part"))
    return keep_latest(rows, ["user_id"], "event_id", "part").select("user_id", "event_id")


@query("SELECT user_id, max(event_id) AS event_id, count(*) * 0 + 1 AS n FROM events GROUP BY 1")
def upsert_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through Structured Streaming, in two runs over one checkpoint."""
    base = f"{shared_dir(spark).rstrip('/')}/upsert-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "events").select("user_id", "event_id")
    sink = Upsert(f"{base}/table", ["user_id"], "event_id", buckets=8)
    for half in (0, 1):
        rows.where(F.col("event_id") % 2 == half).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{base}/in")
        upsert_available(stream, sink, f"{base}/checkpoint").awaitTermination()
    found = sink.current(spark)
    return found.groupBy("user_id").agg(F.max("event_id").alias("event_id"), F.count("*").alias("n"))


@functools.lru_cache(maxsize=4)
def _remote(path: str) -> sqlite3.Connection:
    """The remote dataset `latest` (custkey, orderkey, changed) from the table that `snapshot` wrote, in order of its key, by which pages are found."""
    con = sqlite3.connect(":memory:", check_same_thread=False)
    con.execute("CREATE TABLE latest (custkey INTEGER PRIMARY KEY, orderkey INTEGER, changed TEXT)")
    for batch in dataset.dataset(path, format="parquet").to_batches(columns=["custkey", "orderkey", "changed"]):
        con.executemany("INSERT INTO latest VALUES (?, ?, ?)", zip(*batch.to_pydict().values(), strict=True))
    return con


def snapshot(spark: SparkSession, sf_dir: str, until: str, path: str) -> str:
    """Each customer's latest order as of a day, as the remote server keeps it; the path."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("custkey"), F.col("o_orderkey").alias("orderkey"), F.col("o_orderdate").cast("date").cast("string").alias("changed"))
    keep_latest(rows.where(F.col("changed") <= until), ["custkey"], "changed", "orderkey").write.parquet(path)
    return path


def orders_api(options: dict[str, str]):
    """Transport: a remote dataset served from the snapshot of orders below options['file']."""

    def get(params: dict[str, str]):
        con = _remote(options["file"])
        parts = [f"SELECT {params.get('$select', '*')} FROM latest", *(f"{word} {params[k]}" for k, word in (("$where", "WHERE"), ("$order", "ORDER BY"), ("$limit", "LIMIT"), ("$offset", "OFFSET")) if k in params)]
        found = con.execute(" ".join(parts))
        names = [c[0] for c in found.description]
        return 200, {}, [dict(zip(names, ("" if v is None else str(v) for v in row), strict=True)) for row in found]

    return get


def api_stream(spark: SparkSession, file: str, **more: str) -> DataFrame:
    """The dataset of `orders_api` as a stream of two slices."""
    spark.dataSource.register(ApiDataSource)
    own = {"transport": f"{__name__}:orders_api", "file": file, "key": "custkey", "updated": "changed", "slices": '["custkey % 2 = 0", "custkey % 2 = 1"]', "page": "2000", "select": "custkey,orderkey,changed"}
    return spark.readStream.format("paged_api").schema("custkey string, orderkey string, changed string").options(**own | more).load()


@query("""
WITH days AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders), half AS (SELECT d FROM days ORDER BY d LIMIT 1 OFFSET (SELECT count(*) // 2 FROM days)),
placed AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE) DESC, o_orderkey DESC) AS place, CAST(o_orderdate AS DATE) AS d FROM orders),
seen AS (SELECT DISTINCT o_custkey FROM orders WHERE CAST(o_orderdate AS DATE) <= (SELECT d FROM half))
SELECT o_custkey AS custkey, o_orderkey AS orderkey, 1 + CAST(o_custkey IN (SELECT * FROM seen) AND d > (SELECT d FROM half) AS INTEGER) AS versions FROM placed WHERE place = 1""")
def upsert_api_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A remote dataset followed by a stream in two runs over one checkpoint, between which rows were added and changed.

    versions: how often a row of the customer came, which is once for each version that a run could see.
    """
    days = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").cast("string").alias("d")).distinct()
    first = days.orderBy("d").offset(days.count() // 2).first()[0]  # the middle of all days
    base = f"{shared_dir(spark).rstrip('/')}/api-{uuid.uuid4().hex}"
    sink = Upsert(f"{base}/table", ["custkey"], "changed", buckets=8)

    def take(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/came/run={run}/batch={batch_id}")
        sink(batch, batch_id)

    for run, until in enumerate((first, "9999-12-31")):
        stream = api_stream(spark, snapshot(spark, sf_dir, until, f"{base}/remote/run={run}"))
        stream.writeStream.foreachBatch(take).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    came = spark.read.schema("custkey string").parquet(f"{base}/came").groupBy("custkey").agg(F.count("*").cast("int").alias("versions"))
    found = sink.current(spark).join(came, "custkey")
    return found.select(*[F.col(c).cast("long").alias(c) for c in ("custkey", "orderkey")], "versions")


_PLACED = "SELECT o_orderkey, CAST(floor(32 * o_orderkey / (max(o_orderkey) OVER () + 1.0)) AS INTEGER) AS bucket FROM orders"


@query(f"""
WITH placed AS ({_PLACED}), came AS (SELECT o_orderkey, bucket, bucket // 8 AS batch FROM placed UNION ALL SELECT o_orderkey, bucket, bucket // 8 + 1 FROM placed WHERE bucket % 8 >= 6 AND bucket < 24),
touched AS (SELECT batch, bucket, count(DISTINCT o_orderkey) AS n FROM came GROUP BY ALL)
SELECT batch, count(*) FILTER (WHERE bucket // 8 < batch) AS buckets_read, count(*) AS buckets_rewritten, CAST(sum(n) AS BIGINT) AS n_rows,
  (SELECT count(*) FROM placed WHERE bucket // 8 <= batch) AS table_rows, (SELECT count(*) FROM placed WHERE bucket // 8 < batch AND bucket % 8 >= 6) AS changed_rows FROM touched GROUP BY batch""")
def keyed_merge_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of four batches reads and rewrites of a table in 32 buckets: its own eight, and two whose rows come again, changed."""
    most = table(spark, sf_dir, "orders").agg(F.max("o_orderkey")).first()[0]
    bucket = F.floor(32 * F.col("o_orderkey") / F.lit(most + 1.0)).cast("int")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.lit(0).alias("version"))
    out = KeyedTable(f"{shared_dir(spark).rstrip('/')}/keyed-{uuid.uuid4().hex}", ["o_orderkey"], ["version"], 32, bucket)
    told = []
    for batch in range(4):
        again = rows.where((F.floor(bucket / 8) == batch - 1) & (bucket % 8 >= 6)).withColumn("version", F.lit(1))
        made = out.merge(rows.where(F.floor(bucket / 8) == batch).unionByName(again), "orders", batch)
        out.merge(again, "orders", batch)  # a batch that comes again changes nothing
        n, changed = out.current(spark).agg(F.count("*"), F.coalesce(F.sum("version"), F.lit(0))).first()
        told.append((batch, len(made.read), len(made.rewritten), made.rows, n, changed))
    return spark.createDataFrame(told, "batch int, buckets_read long, buckets_rewritten long, n_rows long, table_rows long, changed_rows long")
