"""A paged web API as a Spark data source.

A dataset is cut into slices by a column's ranges (years, say), one partition each; within a slice, pages follow each other by key
("id greater than the last one"), so that rows added meanwhile shift nothing. Pages stream into Spark row by row: no task holds
more than one. The transport, a function from request parameters to (status, headers, rows), is given by its import path, so tests
need no network.
"""

from __future__ import annotations

import csv
import importlib
import io
import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

PAGE = 50_000
ATTEMPTS = 5
Transport = Callable[[dict[str, str]], tuple[int, dict[str, str], list[dict[str, str]]]]


def http(options: dict[str, str]) -> Transport:
    """GET options['url'] with the parameters; a CSV page."""

    def get(params: dict[str, str]):
        request = urllib.request.Request(f"{options['url']}?{urllib.parse.urlencode(params)}", headers={"Accept": "text/csv"})
        try:
            with urllib.request.urlopen(request, timeout=float(options.get("timeout", "30"))) as got:
                return got.status, dict(got.headers), list(csv.DictReader(io.StringIO(got.read().decode())))
        except urllib.error.HTTPError as e:
            return e.code, dict(e.headers), []

    return get


def transport(options: dict[str, str]) -> Transport:
    module, _, name = options.get("transport", f"{__name__}:http").partition(":")
    return getattr(importlib.import_module(module), name)(options)


def tried(send: Callable[[], tuple], what: object, pause: Callable[[float], None] = time.sleep) -> tuple:
    """What send returns, (status, headers, content), once its status is 200. Overload, server errors and lost connections are tried again,
    ATTEMPTS times in all, after 2 to 30 seconds; anything else, and the last failure, is an error."""
    for attempt in range(ATTEMPTS):
        try:
            status, headers, content = send()
        except OSError as e:
            status, headers, content, failed = 0, {}, None, str(e)
        else:
            failed = f"status {status}"
        if status == 200:
            return status, headers, content
        if status and status != 429 and status < 500:
            break
        if attempt + 1 < ATTEMPTS:
            asked = headers.get("Retry-After", "")
            pause(min(30.0, float(asked) if asked.isdigit() else 2.0 * 2**attempt))
    raise RuntimeError(f"nothing for {what}: {failed}")


def fetch(send: Transport, params: dict[str, str], pause: Callable[[float], None] = time.sleep) -> list[dict[str, str]]:
    """One page, tried again as `tried` does."""
    return tried(lambda: send(params), params, pause)[2]


def pages(send: Transport, key: str, where: str, select: str, page: int, after: str | None, most: int | None, pause=time.sleep) -> Iterator[list[dict[str, str]]]:
    """Pages in key order, beginning after a key if one is given, until one is short or `most` have come."""
    n = 0
    while most is None or n < most:
        limits = [f"({w})" for w in (where, f"{key} > '{after}'" if after is not None else "") if w]
        params = {"$limit": str(page), "$order": key} | ({"$where": " AND ".join(limits)} if limits else {}) | ({"$select": select} if select else {})
        rows = fetch(send, params, pause)
        n += 1
        if rows:
            yield rows
            after = rows[-1][key]
        if len(rows) < page:
            return


class Slice(InputPartition):
    def __init__(self, where: str):
        self.where = where


class ApiReader(DataSourceReader):
    def __init__(self, options: dict[str, str], names: list[str]):
        self.options, self.names = options, names

    def partitions(self) -> list[Slice]:
        """One for each entry of the option `slices`, a JSON list of conditions that part the dataset; else a single one."""
        return [Slice(w) for w in json.loads(self.options.get("slices", '[""]'))]

    def read(self, partition: Slice) -> Iterator[tuple]:
        o = self.options
        where = " AND ".join(f"({w})" for w in (o.get("where", ""), partition.where) if w)
        most = int(o["pages"]) if "pages" in o else None
        for rows in pages(transport(o), o.get("key", ":id"), where, o.get("select", ""), int(o.get("page", PAGE)), o.get("after"), most):
            for row in rows:
                yield tuple(row.get(c) for c in self.names)


class ApiStream(DataSourceStreamReader):
    """A dataset as a stream: first its rows in key order, then what is changed, slice by slice.

    An offset holds for each slice: key, the last one read; goal, the last one there was when the slice was first seen; mark, the
    latest change there was then, and from there on the latest change read. Until key reaches goal, a batch goes on by key and leaves
    out what was changed after mark; from then on it reads what was changed after mark, in order of key. So each version of a row that a batch can see
    comes once: a row changed during the first phase comes with the second. Both ends of a batch are in its offsets, so one that is run again
    after a failure asks for the same rows. Option `batch`: so many rows a slice and batch, about. It holds once Spark has told this process where the query stands; until then a batch
    holds all that is left, as after a restart, and under a trigger that asks for the end before it tells the start.
    A slice that the options name for the first time begins from its first key.
    """

    def __init__(self, options: dict[str, str], names: list[str]):
        self.options, self.names = options, names
        self.key, self.updated = options.get("key", ":id"), options.get("updated", ":updated_at")
        self.slices = json.loads(options.get("slices", '[""]'))
        self.rows = int(options.get("batch", "1000000"))
        self.at: dict[str, dict] | None = None

    def initialOffset(self) -> dict:
        self.at = {}
        return {"slices": {}}

    def latestOffset(self) -> dict:
        known, stepwise = self.at or {}, self.at is not None
        self.at = known | {w: self.after(w, known.get(w), stepwise) for w in self.slices}
        return {"slices": self.at}

    def ask(self, select: str, limits: list[str], **more: str) -> dict[str, str]:
        where = " AND ".join(f"({w})" for w in (self.options.get("where", ""), *limits) if w)
        rows = fetch(transport(self.options), {"$select": select} | ({"$where": where} if where else {}) | {f"${k}": v for k, v in more.items()})
        return rows[0] if rows else {}

    def nth(self, column: str, limits: list[str]) -> str | None:
        """The value of column in the last row of the next batch, by that column; null if there are not so many rows."""
        return self.ask(column, limits, order=column, limit="1", offset=str(self.rows - 1)).get(column)

    def after(self, where: str, at: dict | None, stepwise: bool) -> dict:
        """A slice's offset one batch further on; without `stepwise`, one that stands for all there is now."""
        if at is None:
            ends = self.ask(f"max({self.key}) as goal, max({self.updated}) as mark", [where])
            goal, mark = ends.get("goal") or None, ends.get("mark") or None
            at = {"key": None, "goal": goal, "mark": mark}
            if not stepwise:
                return at | {"key": goal}
        if at["key"] != at["goal"]:
            limits = [where, f"{self.key} <= '{at['goal']}'", f"{self.key} > '{at['key']}'" if at["key"] is not None else ""]
            return at | {"key": self.nth(self.key, limits) or at["goal"]}
        limits = [where, f"{self.updated} > '{at['mark']}'" if at["mark"] is not None else f"{self.updated} IS NOT NULL"]
        return at | {"mark": self.nth(self.updated, limits) or self.ask(f"max({self.updated}) as mark", limits).get("mark") or at["mark"]}

    def limits(self, start: dict | None, end: dict) -> list[list[str]]:
        """Conditions of what lies between two offsets of a slice, one list for each range of rows."""
        out = []
        old = start or {"key": None, "goal": end["goal"], "mark": end["mark"]}
        if old["key"] != old["goal"]:
            to = end["key"] if end["goal"] == old["goal"] else old["goal"]
            seen = f"{self.updated} <= '{old['mark']}' OR {self.updated} IS NULL" if old["mark"] is not None else f"{self.updated} IS NULL"
            after = f"{self.key} > '{old['key']}'" if old["key"] is not None else ""
            out.append([after, f"{self.key} <= '{to}'", seen])
        if end["mark"] != old["mark"]:
            out.append([f"{self.updated} > '{old['mark']}'" if old["mark"] is not None else "", f"{self.updated} <= '{end['mark']}'"])
        return out

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        self.at = end["slices"]
        both = [(w, own) for w, to in end["slices"].items() for own in self.limits(start["slices"].get(w), to)]
        return [Slice(" AND ".join(f"({x})" for x in (w, *own) if x)) for w, own in both]

    def read(self, partition: Slice) -> Iterator[tuple]:
        return ApiReader(self.options, self.names).read(partition)


class ApiDataSource(DataSource):
    """spark.read.format("paged_api").schema("all columns as string").options(url=..., slices='["y=2023", "y=2024"]').load(), or readStream"""

    @classmethod
    def name(cls) -> str:
        return "paged_api"

    def schema(self) -> str:
        first = next(pages(transport(self.options), self.options.get("key", ":id"), "", "", 1, None, 1), [{}])
        return ", ".join(f"`{c}` string" for c in first[0]) if first[0] else "`:id` string"

    def reader(self, schema) -> ApiReader:
        return ApiReader(dict(self.options), schema.fieldNames())

    def streamReader(self, schema) -> ApiStream:
        return ApiStream(dict(self.options), schema.fieldNames())


def remote_state(send: Transport, updated: str = ":updated_at", where: str = "") -> tuple[int, str | None]:
    """How many rows the remote dataset has, of those that a condition lets through, and their latest change."""
    got = fetch(send, {"$select": f"count(1) as n, max({updated}) as latest"} | ({"$where": where} if where else {}))[0]
    return int(got["n"]), got["latest"] or None


def best_match(results: list[dict[str, str]], words: list[str]) -> dict[str, str] | None:
    """Of a catalogue's entries, the one whose name holds the most of the words, ties to the first; none if none holds any."""
    score = lambda r: sum(w.lower() in r.get("name", "").lower() for w in words)
    best = max(results, key=score, default=None)
    return best if best is not None and score(best) else None
