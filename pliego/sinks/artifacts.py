"""Published artifacts: chunks of a list as JSON, checked against a schema and a size budget before they replace the old ones."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pliego.operators.ranking import numbered
from pliego.session import cut
from pliego.sinks.jsonschema import broken
from pliego.sinks.writer import MANIFEST, TextFiles, store_of

TOTAL_BYTES = 60_000_000
FILE_BYTES = 5_000_000


def chunked(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """df with position (from 0), chunk_index, n_chunks and n_items_total: consecutive slices of n in a total order."""
    if n <= 0:
        raise ValueError("a chunk has at least one item")
    placed = numbered(df, *order, name="position").withColumn("position", F.col("position") - 1)
    total = df.agg(F.count("*").alias("n_items_total"))
    return placed.crossJoin(F.broadcast(total)).withColumns({"chunk_index": F.floor(F.col("position") / n).cast("int"), "n_chunks": F.ceil(F.col("n_items_total") / n).cast("int")})  # total: one row


def chunk_json(chunks: DataFrame, columns: Sequence[str], shape: Callable[[Column], Column] = lambda item: item) -> DataFrame:
    """(chunk_index, json): each chunk as one JSON object with its items in order. A chunk is a bounded number of items. shape: what is written of an item, a struct."""
    item = F.struct("position", F.struct(*columns).alias("item"))
    grouped = chunks.groupBy("chunk_index", "n_chunks", "n_items_total").agg(F.array_sort(F.collect_list(item))["item"].alias("items"))
    shaped = F.transform("items", lambda x: shape(x)).alias("items")
    whole = F.to_json(F.struct("chunk_index", "n_chunks", "n_items_total", shaped), {"ignoreNullFields": "false"})
    return grouped.select("chunk_index", whole.alias("json"))


def check_columns(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """(rule, failed): how many rows break each rule, all rules in one pass; null breaks a rule."""
    row = df.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(f"{i}") for i, c in enumerate(rules.values())])
    items = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"`{i}`").alias("failed")) for i, n in enumerate(rules)])
    return row.select(F.explode(items).alias("x")).select("x.*")


def compact(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"), default=str)


def write_chunks(df: DataFrame, path: str, n: int, order: Sequence[Column], total: int = TOTAL_BYTES, each: int = FILE_BYTES) -> None:
    """Chunks as text files below path, one folder each, in place of what was there. Too large a result is an error, never cut."""
    ready = chunk_json(chunked(df, n, *order), df.columns)
    check_budget(ready, total, each)
    ready.write.mode("overwrite").partitionBy("chunk_index").text(path)


def check_budget(ready: DataFrame, total: int = TOTAL_BYTES, each: int = FILE_BYTES) -> None:
    whole, largest = ready.agg(F.coalesce(F.sum(F.octet_length("json")), F.lit(0)), F.coalesce(F.max(F.octet_length("json")), F.lit(0))).first()
    if whole > total or largest > each:
        raise ValueError(f"artifacts of {whole} bytes, the largest {largest}: over the budget of {total} and {each}")


class SchemaError(ValueError):
    """Artifacts break their schemas. problems: all of it, as a table (path, problem); the message shows the first ones of each path."""

    def __init__(self, problems: DataFrame, shown: int = 20):
        n = problems.count()
        first = problems.orderBy("path", "problem").limit(shown).collect()
        more = f"; and {n - len(first)} more, all of them in problems" if n > len(first) else ""
        super().__init__("artifacts break their schemas: " + "; ".join(f"{r['path']} {r['problem']}" for r in first) + more)
        self.problems = problems


def publish(ready: DataFrame, out: str, schemas: Mapping[str, Mapping], total: int = TOTAL_BYTES, each: int = FILE_BYTES) -> list[dict]:
    """Writes the artifacts (path, kind, json) as files below out, and last manifest.json, which is returned.

    All are checked first, against their schemas and one budget over everything, then tasks write them aside, and only then are they put in place: what
    is there stays if anything is wrong or fails. JSON files that are no longer in the list are deleted. out: a local path or a URI that pyarrow can open.
    """
    spark = ready.sparkSession
    ready = cut(ready.select("path", "kind", "json"))
    check_budget(ready, total, each)
    wrong = cut(broken(ready, schemas))
    if not wrong.isEmpty():
        raise SchemaError(wrong)
    spark.dataSource.register(TextFiles)
    ready.write.format("text_files").mode("overwrite").save(out)
    store, base = store_of(out)
    with store.open_input_stream(f"{base}/{MANIFEST}") as f:
        return json.loads(f.read())["files"]


def json_files(spark: SparkSession, out: str) -> list[str]:
    """Paths, relative to out, of the JSON files below it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(out)
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(where):
        return []
    base, found = store.makeQualified(where).toString().rstrip("/"), []
    files = store.listFiles(where, True)
    while files.hasNext():
        name = files.next().getPath().toString()
        if name.endswith(".json"):
            found.append(name[len(base) + 1 :])
    return found


def replace_table(df: DataFrame, path: str) -> DataFrame:
    """df written in place of what was there, and read again."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def append_parts(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("compression", "snappy").parquet(path)


def write_csv(df: DataFrame, path: str, mark: bool = False) -> None:
    """CSV with a header; quotes only where needed and doubled inside. mark: a byte-order mark before the header, as some sheets want."""
    if mark:
        df = df.withColumnRenamed(df.columns[0], "\ufeff" + df.columns[0])
    df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def markdown(title: str, df: DataFrame, rows: int = 200) -> str:
    """A report's table. df is a small aggregate; more than `rows` rows are an error."""
    got = df.limit(rows + 1).collect()
    if len(got) > rows:
        raise ValueError("too long for a report")
    lines = [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in got), ""])


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """One small text file, in whatever store the path names."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    out.write(bytearray(text.encode()))
    out.close()
