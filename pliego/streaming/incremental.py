"""Changed rows as they arrive: only what is newer than the last refresh is read, and the latest part of each key wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pliego.streaming.keyed import Upsert


def newer(df: DataFrame, updated: str, since: str | None) -> DataFrame:
    """Rows updated after `since`; all of them where there is no such mark yet."""
    return df if since is None else df.where(F.col(updated) > F.lit(since))


def high_mark(df: DataFrame, updated: str) -> str | None:
    """The latest update as text."""
    return df.agg(F.max(F.col(updated)).cast("string")).first()[0]


def part_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """New part files of a folder as a stream, with the name of the file that each row came from."""
    rows = spark.readStream.schema(schema).parquet(path)
    return rows.select("*", F.col("_metadata.file_name").alias("file_name"))


def upsert_available(stream: DataFrame, sink: Upsert, checkpoint: str) -> StreamingQuery:
    """Everything that has arrived since the last run, then stop; the checkpoint remembers what has been read."""
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
