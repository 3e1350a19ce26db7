"""Documents behind links: fetched by tasks, kept with digest and type, and not fetched again.

A body is a row: what came, or why nothing did. Overload, server errors and lost connections are tried again as pages of the API are. The transport, a
function from a URL to (status, headers, bytes), is given by its import path, so tests need no network.
"""

from __future__ import annotations

import hashlib
import importlib
import urllib.error
import urllib.request
from collections.abc import Callable, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pliego.session import cut
from pliego.sources.api import tried

Transport = Callable[[str], tuple[int, Mapping[str, str], bytes]]
#: Bytes of the largest body that is kept; a larger one is a failure with its size, never cut.
LARGEST = 256_000_000
SCHEMA = "url string, status int, content_type string, n_bytes long, sha256 string, body binary, failure string"


def http(options: Mapping[str, str]) -> Transport:
    def get(url: str):
        request = urllib.request.Request(url, headers={"User-Agent": options.get("agent", "pliego")})
        try:
            with urllib.request.urlopen(request, timeout=float(options.get("timeout", "120"))) as got:
                return got.status, dict(got.headers), got.read(LARGEST + 1)
        except urllib.error.HTTPError as e:
            return e.code, dict(e.headers), b""

    return get


def one(send: Transport, url: str, pause: Callable[[float], None] | None = None) -> tuple:
    """The row of one document. Nothing that a server does is an error here: it is the row's failure."""
    try:
        status, headers, body = tried(lambda: send(url), url, **({"pause": pause} if pause else {}))
    except (RuntimeError, ValueError) as e:
        return url, None, None, None, None, None, str(e)
    kind = next((v for k, v in headers.items() if k.lower() == "content-type"), None)
    if len(body) > LARGEST:
        return url, status, kind, len(body), None, None, f"larger than {LARGEST} bytes"
    return url, status, kind, len(body), hashlib.sha256(body).hexdigest(), body, None


def fetched(links: DataFrame, options: Mapping[str, str], tasks: int = 16) -> DataFrame:
    """(url, status, content_type, n_bytes, sha256, body, failure) of every distinct URL of links that is not null.

    URLs of one host go to one task, one after the other, so a host sees one request at a time; `tasks` hosts are asked at once. A row is sent on as it comes:
    no task holds more than one body. The result is written before it is returned, so that nothing is fetched twice.
    """
    urls = links.select("url").where("url IS NOT NULL").distinct()
    host = F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)
    own = dict(options)

    def run(batches):
        module, _, name = own.get("transport", f"{__name__}:http").partition(":")
        send = getattr(importlib.import_module(module), name)(own)
        types = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string()]
        names = [c.split(" ")[0] for c in SCHEMA.split(", ")]
        for b in batches:
            for url in b.column("url").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(one(send, url), types, strict=True)], names)

    return cut(urls.repartition(tasks, host).mapInArrow(run, SCHEMA))


def gathered(links: DataFrame, options: Mapping[str, str], path: str, tasks: int = 16) -> DataFrame:
    """The documents below path, after those of links have been added that are not there or failed; a later success takes a failure's place.

    links has columns url and, as `sources.links` gives it, file; the result has the name of one link to each document.
    """
    from pliego.streaming.keyed import KeyedTable

    spark = links.sparkSession
    table = KeyedTable(path, ["url"], ["_good"], buckets=16)
    there = table.current(spark).where("failure IS NULL").select("url") if table.commits(spark) else None
    missing = links if there is None else links.join(there, "url", "left_anti")
    new = fetched(missing, options, tasks)
    if not new.isEmpty():
        names = links.groupBy("url").agg(F.min("file").alias("file"))
        table.merge(new.join(names, "url").withColumn("_good", F.col("failure").isNull()))
    return table.current(spark).drop("_good")
