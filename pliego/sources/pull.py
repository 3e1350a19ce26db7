"""Pulling a remote dataset into part files: whole, resumed, or only what has changed."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pliego.operators.dedup import keep_latest
from pliego.sinks.artifacts import append_parts
from pliego.sources import manifest
from pliego.sources.api import ApiDataSource, best_match, remote_state, transport
from pliego.streaming.incremental import Upsert, upsert_available


def pull(spark: SparkSession, name: str, out: str, manifest_path: str, options: dict[str, str], columns: list[str], refresh: bool = False, updated: str = ":updated_at") -> dict:
    """Append what is new to out, and record it; returns the manifest's entry.

    A complete dataset is left alone unless refresh is asked for: then rows changed after the recorded latest change are appended as
    parts that sort after the earlier ones, and the same columns are asked for. Without such a record everything is pulled. A pull
    limited to some pages is partial, and the next one goes on after its last key.
    """
    spark.dataSource.register(ApiDataSource)
    entry = manifest.read(manifest_path).get(name, {})
    if entry.get("status") == "complete" and not refresh:
        return entry
    key = options.get("key", ":id")
    live, live_latest = remote_state(transport(options), updated, options.get("where", ""))
    wanted = list(dict.fromkeys([key, updated, *columns]))
    more = {"select": ",".join(wanted)}
    since = entry.get("max_updated_at") if refresh else None
    if since:
        more["where"] = " AND ".join(f"({w})" for w in (options.get("where", ""), f"{updated} > '{since}'") if w)
    elif entry.get("last_id") and "slices" not in options:
        more["after"] = entry["last_id"]
    schema = ", ".join(f"`{c}` string" for c in wanted)
    rows = spark.read.format("paged_api").schema(schema).options(**options | more).load()
    began = dt.datetime.now(dt.UTC)
    batch = f"{began:%Y%m%dT%H%M%S%f}"
    folder = f"{out.rstrip('/')}/batch={'r' if since else '0'}{batch}"  # refreshes sort after the first pull
    append_parts(rows, folder)
    got: DataFrame = spark.read.schema(rows.schema).parquet(folder)
    n, last, latest = got.agg(F.count("*"), F.max(f"`{key}`"), F.max(f"`{updated}`")).first()
    newest = max(x for x in (latest, entry.get("max_updated_at"), "") if x is not None) or None
    return manifest.update(
        manifest_path, name, status="partial" if "pages" in options else "complete", rows_pulled=entry.get("rows_pulled", 0) + n, last_id=last or entry.get("last_id"),
        max_updated_at=newest, live_count_at_start=live, live_latest_at_start=live_latest, columns=columns, started_at=began.isoformat(),
        finished_at=dt.datetime.now(dt.UTC).isoformat()
    )


def latest_rows(spark: SparkSession, out: str, key: str = ":id") -> DataFrame:
    """What out holds now: of rows with one key, that of the last batch."""
    df = spark.read.option("mergeSchema", "true").parquet(out)
    return keep_latest(df, [key], "batch").drop("batch")


def described(entry: Mapping) -> tuple[dict[str, str], list[str]]:
    """(options, columns) of a dataset as a catalogue describes it: any option of the data source, as text or JSON, columns, and instead of url, candidates (name, url)
    and find, the words that the right one's name holds most of."""
    options = {k: v if isinstance(v, str) else json.dumps(v) for k, v in entry.items() if k not in ("columns", "candidates", "find")}
    if "candidates" in entry:
        found = best_match(entry["candidates"], entry.get("find", []))
        if found is None:
            raise ValueError(f"no dataset is called anything like {entry.get('find', [])}")
        options["url"] = found["url"]
    return options, list(entry.get("columns", []))


def pull_all(spark: SparkSession, catalogue: Mapping[str, Mapping], out: str, manifest_path: str, only: Sequence[str] = (), refresh: bool = False, pages: int | None = None) -> dict:
    """Every dataset of a catalogue, or those named, below out, one after the other; all are tried before a failure of any is raised. Returns their manifest entries."""
    if unknown := [n for n in only if n not in catalogue]:
        raise ValueError(f"the catalogue has no {unknown}")

    def job(name: str):
        def run() -> dict:
            options, columns = described(catalogue[name])
            more = {"pages": str(pages)} if pages else {}
            return pull(spark, name, f"{out.rstrip('/')}/{name}", manifest_path, options | more, columns, refresh, options.get("updated", ":updated_at"))

        return run

    return manifest.try_all({n: job(n) for n in catalogue if not only or n in only})


def summary(manifest_path: str) -> list[dict]:
    """A row for each dataset of the manifest: what the source had, what is here, and whether all of it is."""
    return [{"name": n, "live": e.get("live_count_at_start"), "pulled": e.get("rows_pulled", 0), "status": e.get("status", "unknown"), "latest": e.get("max_updated_at")} for n, e in sorted(manifest.read(manifest_path).items())]


def follow(spark: SparkSession, entry: Mapping, out: str) -> StreamingQuery:
    """A dataset of a catalogue as a stream into the keyed table out/rows, by its key and latest change; out/checkpoint remembers how far it is. Everything until now, then stop."""
    spark.dataSource.register(ApiDataSource)
    options, columns = described(entry)
    key, updated = options.get("key", ":id"), options.get("updated", ":updated_at")
    wanted = list(dict.fromkeys([key, updated, *columns]))
    rows = spark.readStream.format("paged_api").schema(", ".join(f"`{c}` string" for c in wanted)).options(**options | {"select": ",".join(wanted)}).load()
    return upsert_available(rows, Upsert(f"{out}/rows", [key], updated), f"{out}/checkpoint")
