"""A table of the latest row of each key, changed by batches without rewriting what a batch does not touch.

Rows lie in buckets by a hash of their key. A batch is merged into the buckets that its keys fall into; those get new folders, all
others keep theirs. What a bucket's folder is, stands in a log: one small JSON file a commit, with the whole list, made under its own number
only if nobody has made that number yet. Readers take the newest entry and read just its folders, so they see whole commits only, and
a merge that dies halfway leaves folders that no entry names. An entry also records each source's last batch: a batch that
comes again after a failure changes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pliego.operators.dedup import keep_latest
from pliego.sinks.artifacts import write_text

BUCKETS = 64
BUCKET = "_bucket"


class Conflict(RuntimeError):
    """Another writer has committed meanwhile."""


@dataclass
class Commit:
    """One entry of the log. folders: bucket -> folder below the table; batches: source -> its last batch."""

    number: int = -1
    schema: str = ""
    buckets: int = 0
    folders: dict[str, str] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)
    read: list[int] = field(default_factory=list)
    rewritten: list[int] = field(default_factory=list)
    rows: int = 0


def _store(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _names(spark: SparkSession, path: str) -> list[str]:
    store, where = _store(spark, path)
    return sorted(s.getPath().getName() for s in store.listStatus(where)) if store.exists(where) else []


def write_once(spark: SparkSession, text: str, path: str) -> bool:
    """The text as a new file, whole or not at all; false if the file is there already, whoever made it."""
    jvm = spark._jvm
    part = f"{path}.{uuid.uuid4().hex}.part"
    write_text(spark, text, part)
    store, old = _store(spark, part)
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(store.makeQualified(old).toUri(), spark._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        files.rename(store.makeQualified(old), store.makeQualified(jvm.org.apache.hadoop.fs.Path(path)), none)
    except Exception as e:
        store.delete(old, False)
        if "FileAlreadyExists" in str(e):
            return False
        raise
    return True


class KeyedTable:
    """The latest row of each key below `path`, by the columns `order` (nulls are oldest), then by commit.

    bucket: the bucket of a row as a column of small integers, by default a hash of the keys; it may depend on the keys alone. Null keys have no row.
    Buckets are as many as the first commit had. Columns that a later batch adds are null in older rows; a batch may lack columns too.
    """

    def __init__(self, path: str, keys: Sequence[str], order: Sequence[str], buckets: int = BUCKETS, bucket: Column | None = None):
        self.path, self.keys, self.order, self.buckets, self.bucket = path.rstrip("/"), list(keys), list(order), buckets, bucket

    # The log

    def commits(self, spark: SparkSession) -> list[int]:
        return [int(n[:-5]) for n in _names(spark, f"{self.path}/_log") if n.endswith(".json")]

    def commit(self, spark: SparkSession, number: int | None = None) -> Commit:
        """The entry of that number, by default the newest; an empty one if the table has none."""
        numbers = [number] if number is not None else self.commits(spark)[-1:]
        if not numbers:
            return Commit()
        store, where = _store(spark, f"{self.path}/_log/{numbers[0]:012d}.json")
        found = store.open(where)
        try:
            return Commit(**json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(found, "UTF-8")))
        finally:
            found.close()

    # Reading

    def current(self, spark: SparkSession, number: int | None = None) -> DataFrame:
        """The rows as of a commit, by default the newest. Nothing is folded: each key is there once."""
        entry = self.commit(spark, number)
        if not entry.schema:
            raise ValueError(f"{self.path} has no commit")
        return self._rows(spark, entry, entry.folders)

    def _rows(self, spark: SparkSession, entry: Commit, folders: dict[str, str]) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(entry.schema))
        if not folders:
            return spark.createDataFrame([], schema)
        # looked up file by file: the bucket in a folder's name is no column
        return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(*[f"{self.path}/{f}" for f in folders.values()])

    def _bucketed(self, df: DataFrame, buckets: int) -> DataFrame:
        own = self.bucket if self.bucket is not None else F.xxhash64(*[F.col(f"`{k}`") for k in self.keys])
        return df.withColumn(BUCKET, F.pmod(own, F.lit(buckets)).cast("int"))

    # Merging

    def merge(self, batch: DataFrame, source: str = "", number: int | None = None, tries: int = 5) -> Commit:
        """Takes the batch's rows in and returns the commit; that of a batch of `source` whose number is not above the last one is left as it is.

        Rows of one key in a batch are first reduced to the latest. If another writer commits at the same time, the merge starts again from what
        that one left, `tries` times in all.
        """
        spark = batch.sparkSession
        for _ in range(tries):
            entry = self.commit(spark)
            if number is not None and number <= entry.batches.get(source, -1):
                return entry
            made = self._merged(batch, entry)
            if number is not None:
                made.batches[source] = number
            if write_once(spark, json.dumps(made.__dict__), f"{self.path}/_log/{made.number:012d}.json"):
                return made
        raise Conflict(f"{self.path}: {tries} times another writer was first")

    def _merged(self, batch: DataFrame, entry: Commit) -> Commit:
        spark, buckets = batch.sparkSession, entry.buckets or self.buckets
        new = self._staged(self._bucketed(keep_latest(batch, self.keys, *self.order), buckets))
        touched = sorted(r[0] for r in new.select(BUCKET).distinct().collect())  # `buckets` numbers at most
        old = {str(b): entry.folders[str(b)] for b in touched if str(b) in entry.folders}
        result = new
        if old:
            before = self._bucketed(self._rows(spark, entry, old), buckets).withColumn("_commit", F.lit(0))
            both = before.unionByName(new.withColumn("_commit", F.lit(1)), allowMissingColumns=True)
            result = keep_latest(both, self.keys, *self.order, "_commit").drop("_commit")
        folder = f"data/{uuid.uuid4().hex}"
        # one file a bucket: a bucket is meant to be of a file's size, so their number grows with the table
        result.repartition(max(1, len(touched)), BUCKET).write.partitionBy(BUCKET).parquet(f"{self.path}/{folder}")
        names = {n.split("=")[1]: f"{folder}/{n}" for n in _names(spark, f"{self.path}/{folder}") if n.startswith(f"{BUCKET}=")}
        schema = result.drop(BUCKET).schema if touched or not entry.schema else T.StructType.fromJson(json.loads(entry.schema))
        if entry.schema:
            known = T.StructType.fromJson(json.loads(entry.schema))
            schema = T.StructType([*known.fields, *[f for f in schema.fields if f.name not in known.fieldNames()]])
        return Commit(entry.number + 1, schema.json(), buckets, entry.folders | names, dict(entry.batches), sorted(map(int, old)), touched, new.count())

    def _staged(self, latest: DataFrame) -> DataFrame:
        """The batch as a table of its own: it is read for its buckets, its rows and their number, and may be a stream's."""
        path = f"{self.path}/staged/{uuid.uuid4().hex}"
        latest.write.parquet(path)
        store, where = _store(latest.sparkSession, path)
        store.deleteOnExit(where)
        return latest.sparkSession.read.schema(latest.schema).parquet(path)

    def vacuum(self, spark: SparkSession, keep: int = 2) -> list[str]:
        """Deletes all but the `keep` newest entries and the folders that only those older ones, or no entry, name; returns the folders. No merge may run meanwhile."""
        numbers = self.commits(spark)
        used = {f.split("/")[1] for n in numbers[-keep:] for f in self.commit(spark, n).folders.values()}
        gone = [f"data/{n}" for n in _names(spark, f"{self.path}/data") if n not in used]
        for path in [*gone, "staged", *(f"_log/{n:012d}.json" for n in numbers[:-keep])]:
            store, where = _store(spark, f"{self.path}/{path}")
            store.delete(where, True)
        return gone


class Upsert:
    """foreachBatch function: merges each batch into the keyed table below `path`, whose rows `current` gives.

    A batch belongs to its streaming query, as the checkpoint knows it: run again after a failure it changes nothing, and a query with a fresh
    checkpoint, whose batches count from zero again, is another source.
    """

    def __init__(self, path: str, keys: Sequence[str], *order: str, buckets: int = BUCKETS, bucket: Column | None = None):
        self.table = KeyedTable(path, keys, order, buckets, bucket)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        source = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "batches"
        self.table.merge(batch, source, batch_id)

    def current(self, spark: SparkSession) -> DataFrame:
        return self.table.current(spark)

    def compact(self, spark: SparkSession, out: str) -> Upsert:
        """The current rows as the first commit of a new table with the same keys, order and buckets."""
        t = self.table
        made = Upsert(out, t.keys, *t.order, buckets=t.buckets, bucket=t.bucket)
        made.table.merge(self.current(spark))
        return made
