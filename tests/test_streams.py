"""Remote datasets as streams, keyed tables, and the command that pulls."""

from __future__ import annotations

import json
import os
import sqlite3
import sys
import types

import pytest
from pyspark.sql import functions as F

from pliego.__main__ import main
from pliego.sources import api, pull, sheets
from pliego.streaming.incremental import upsert_available
from pliego.streaming.keyed import Conflict, KeyedTable, Upsert, write_once

COLUMNS = (":id", "y", ":updated_at", "v")


def remote(options):
    """Transport: rows of a JSON file behind the query language, as a database knows it."""
    con = sqlite3.connect(":memory:")
    con.execute('CREATE TABLE t (":id" TEXT, y INTEGER, ":updated_at" TEXT, v TEXT)')
    with open(options["file"]) as f:
        con.executemany("INSERT INTO t VALUES (?, ?, ?, ?)", [[r.get(c) for c in COLUMNS] for r in json.load(f)])

    def get(params):
        quoted = {k: v.replace(":updated_at", '":updated_at"').replace(":id", '":id"') for k, v in params.items()}
        parts = [f"SELECT {quoted.get('$select', '*')} FROM t", *(f"{w} {quoted[k]}" for k, w in (("$where", "WHERE"), ("$order", "ORDER BY"), ("$limit", "LIMIT"), ("$offset", "OFFSET")) if k in quoted)]
        found = con.execute(" ".join(parts))
        names = [c[0] for c in found.description]
        return 200, {}, [dict(zip(names, row, strict=True)) for row in found]

    return get


@pytest.fixture
def served(spark, tmp_path):
    spark.sparkContext.environment["PYTHONPATH"] = f"{os.path.dirname(__file__)}:{os.path.dirname(os.path.dirname(__file__))}"

    def put(rows):
        (tmp_path / "rows.json").write_text(json.dumps(rows))
        return {"transport": "test_streams:remote", "file": str(tmp_path / "rows.json"), "page": "3"}

    return put


def rows(n, updated="2024-01-01", **more):
    return [{":id": f"{i:04}", "y": 2020 + i % 2, ":updated_at": updated, "v": f"v{i}"} | more for i in range(n)]


SLICES = json.dumps(["y = 2020", "y = 2021"])


def test_offsets_of_a_stream(served):
    """Every version of a row comes once, whatever happens to the reader and to the source between batches."""
    options = served(rows(11)) | {"slices": SLICES, "batch": "2"}
    reader = api.ApiStream(options, list(COLUMNS))
    got = []

    def batch(reader, start, end):
        return sorted(r for p in reader.partitions(start, end) for r in reader.read(p))

    at = reader.initialOffset()
    first = reader.latestOffset()
    assert batch(reader, at, first) == batch(reader, at, first) and len(batch(reader, at, first)) == 4  # two of each slice, again as often as asked
    got += batch(reader, at, first)
    # meanwhile a row not read yet is changed, one read is, one is new, and one has no date
    now = rows(12) + [{":id": "0099", "y": 2020, ":updated_at": None, "v": "undated"}]
    for r in now:
        if r[":id"] in ("0001", "0009", "0011"):
            r |= {":updated_at": "2024-03-01", "v": "new"}
    served(now)
    second = reader.latestOffset()
    got += batch(reader, first, second)
    # a new process knows no offset: its first batch holds all that is left
    other = api.ApiStream(options, list(COLUMNS))
    third = other.latestOffset()
    got += batch(other, second, third)
    fourth = other.latestOffset()
    assert fourth == third and batch(other, third, fourth) == []
    versions = sorted((r[0], r[3]) for r in got)
    assert len(set(versions)) == len(versions)
    wanted = {(r[":id"], r["v"]) for r in now if r[":id"] != "0099"} | {("0001", "v1")}
    assert set(versions) == wanted
    # slices that are new begin at their first key; an empty one has nothing
    more = api.ApiStream(options | {"slices": json.dumps(["y = 2020", "y = 1999", "y = 2021"])}, list(COLUMNS))
    assert batch(more, third, more.latestOffset()) == []
    only = api.ApiStream(options | {"slices": json.dumps(["y = 2021"])}, list(COLUMNS))
    assert len(batch(only, {"slices": {}}, only.latestOffset())) == 6


def test_stream_goes_on_after_a_failure(spark, served, tmp_path):
    spark.dataSource.register(api.ApiDataSource)
    sink = Upsert(str(tmp_path / "table"), [":id"], ":updated_at", buckets=4)
    broken, delivered = [True], []

    def take(batch, batch_id):
        delivered.extend((batch_id, r[":id"], r["v"]) for r in batch.collect())
        if broken[0] and batch_id == 1:
            raise RuntimeError("killed")
        sink(batch, batch_id)

    def run():
        stream = spark.readStream.format("paged_api").schema("`:id` string, y string, `:updated_at` string, v string").options(**options).load()
        q = stream.writeStream.foreachBatch(take).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
        q.awaitTermination()

    options = served(rows(9)) | {"slices": SLICES}
    run()
    changed = rows(10)
    changed[3] |= {"v": "new", ":updated_at": "2024-02-01"}
    changed[9] |= {":updated_at": "2024-02-01"}
    served(changed)
    with pytest.raises(Exception, match="killed"):
        run()
    broken[0] = False
    run()
    run()
    assert {(i, v) for b, i, v in delivered if b == 1} == {("0003", "new"), ("0009", "v9")} and sum(b == 1 for b, _, _ in delivered) == 4  # the failed batch, and the same again
    assert dict(sink.current(spark).select("`:id`", "v").collect()) == {r[":id"]: r["v"] for r in changed}
    assert max(b for b, _, _ in delivered) == 1


def test_merges_touch_their_buckets_only(spark, tmp_path):
    table = KeyedTable(str(tmp_path / "t"), ["k"], ["at"], 10, F.col("k") % 10)
    frame = lambda data: spark.createDataFrame(data, "k int, at int, v string")
    now = lambda **more: {r["k"]: (r["at"], r["v"]) for r in table.current(spark, **more).collect()}
    assert table.commits(spark) == []
    first = table.merge(frame([(i, 1, "a") for i in range(40)] + [(None, 1, "x"), (5, 0, "old"), (5, None, "none")]), "s", 0)
    assert (first.read, len(first.rewritten), first.rows) == ([], 10, 40)
    second = table.merge(frame([(3, 2, "b"), (13, 0, "late"), (103, 1, "new"), (4, 1, "same time")]), "s", 1)
    assert second.read == second.rewritten == [3, 4] and {b for b in second.folders if second.folders[b] != first.folders[b]} == {"3", "4"}
    wanted = {i: (1, "a") for i in range(40)} | {3: (2, "b"), 103: (1, "new"), 4: (1, "same time")}
    assert now() == wanted and now(number=0) == {i: (1, "a") for i in range(40)}
    # a batch that comes again, or an older one, changes nothing; another source's does
    assert table.merge(frame([(3, 9, "again")]), "s", 1).number == 1 == table.merge(frame([(3, 9, "again")]), "s", 0).number
    assert table.merge(frame([(3, 3, "other")]), "other", 0).number == 2 and now() == wanted | {3: (3, "other")}
    # an empty batch, and one with more and with fewer columns
    assert table.merge(frame([]), "s", 2).rewritten == [] and now() == wanted | {3: (3, "other")}
    table.merge(spark.createDataFrame([(7, 5, 1.5)], "k int, at int, more double"), "s", 3)
    assert {(r["v"], r["more"]) for r in table.current(spark).where("k IN (7, 8)").collect()} == {(None, 1.5), ("a", None)}
    gone = table.vacuum(spark, keep=1)
    assert gone and table.commits(spark) == [4] and len(now()) == 41 and not (tmp_path / "t" / "staged").exists()
    with pytest.raises(ValueError, match="no commit"):
        KeyedTable(str(tmp_path / "none"), ["k"], ["at"]).current(spark)


def test_two_writers_lose_nothing(spark, tmp_path, monkeypatch):
    table = KeyedTable(str(tmp_path / "t"), ["k"], ["at"], 4)
    frame = lambda k: spark.createDataFrame([(k, 1)], "k int, at int")
    table.merge(frame(1))
    merged, tries = KeyedTable._merged, []

    def slow(self, batch, entry):
        made = merged(self, batch, entry)
        if not tries:  # another writer commits in between
            tries.append(1)
            KeyedTable(self.path, ["k"], ["at"], 4).merge(frame(2))
        return made

    monkeypatch.setattr(KeyedTable, "_merged", slow)
    assert table.merge(frame(3)).number == 2
    assert {r["k"] for r in table.current(spark).collect()} == {1, 2, 3}
    assert write_once(spark, "a", str(tmp_path / "f")) and not write_once(spark, "b", str(tmp_path / "f")) and (tmp_path / "f").read_text() == "a"
    assert sorted(f.name for f in tmp_path.iterdir() if f.name.startswith("f")) == ["f"]
    monkeypatch.setattr("pliego.streaming.keyed.write_once", lambda *a: False)
    with pytest.raises(Conflict):
        table.merge(frame(4), tries=2)


def test_a_fresh_checkpoint_is_another_source(spark, tmp_path):
    sink = Upsert(str(tmp_path / "t"), ["k"], "v", buckets=4)
    for part, data in enumerate(([("a", 1), ("b", 1)], [("a", 2)])):
        spark.createDataFrame(data, "k string, v int").write.parquet(str(tmp_path / f"in{part}"))
        stream = spark.readStream.schema("k string, v int").parquet(str(tmp_path / f"in{part}"))
        upsert_available(stream, sink, str(tmp_path / f"checkpoint{part}")).awaitTermination()
    assert dict(sink.current(spark).collect()) == {"a": 2, "b": 1}
    folded = sink.compact(spark, str(tmp_path / "folded"))
    stream = spark.readStream.schema("k string, v int").parquet(str(tmp_path / "in1"))
    upsert_available(stream, folded, str(tmp_path / "checkpoint3")).awaitTermination()
    assert dict(folded.current(spark).collect()) == {"a": 2, "b": 1}


def test_pull_command(spark, served, tmp_path, capsys):
    options = served(rows(10))
    catalogue = {"one": options | {"columns": ["y", "v"], "slices": ["y = 2020", "y = 2021"]}, "two": options | {"columns": ["v"], "where": "y = 2020", "find": ["contratos", "2024"], "candidates": [{"name": "Otra cosa", "url": "a"}, {"name": "Contratos de 2024", "url": "b"}]}, "lost": options | {"file": str(tmp_path / "none"), "columns": []}}
    (tmp_path / "catalogue.json").write_text(json.dumps(catalogue))
    args = [str(tmp_path / "catalogue.json"), str(tmp_path / "raw")]
    with pytest.raises(RuntimeError, match="lost"):
        main(["pull", *args])
    told = {r["name"]: r for r in map(json.loads, capsys.readouterr().out.strip().split("\n"))}
    assert {n: (r["live"], r["pulled"], r["status"]) for n, r in told.items()} == {"one": (10, 10, "complete"), "two": (5, 5, "complete")}
    changed = rows(11)
    changed[2] |= {"v": "new", ":updated_at": "2024-02-01"}
    changed[10] |= {":updated_at": "2024-02-01"}
    served(changed)
    assert told["one"]["pct_of_live_total"] == 100.0
    main(["pull", *args, "--only", "one", "--refresh"])
    assert dict(pull.latest_rows(spark, str(tmp_path / "raw" / "one")).select(":id", "v").collect()) == {r[":id"]: r["v"] for r in changed}
    main(["follow", *args, "--only", "one"])
    found = KeyedTable(str(tmp_path / "raw" / "tables" / "one" / "rows"), [":id"], [":updated_at"]).current(spark)
    assert dict(found.select("`:id`", "v").collect()) == {r[":id"]: r["v"] for r in changed}
    with pytest.raises(ValueError, match="nine"):
        main(["pull", *args, "--only", "nine"])
    assert pull.described(catalogue["two"])[0]["url"] == "b"
    with pytest.raises(ValueError, match="called anything"):
        pull.described({"candidates": [{"name": "x", "url": "a"}], "find": ["z"]})


def test_sheet(spark, monkeypatch):
    """A workbook's cells, read through the library's interface."""
    grid = [("Informe", None), (None, None), ("Departamento", "Año"), ("Tolima", 2020), (None, None), ("Meta", "s/f")]
    book = types.SimpleNamespace(active=types.SimpleNamespace(iter_rows=lambda values_only: iter(grid)))
    monkeypatch.setitem(sys.modules, "openpyxl", types.SimpleNamespace(load_workbook=lambda path, read_only, data_only: book))
    cells = sheets.read_sheet(spark, "book.xlsx")
    assert [(r["departamento"], r["anio"]) for r in sheets.facts(cells).collect()] == [("Tolima", 2020), ("Meta", None)]


def test_remote_pages_are_found_by_key(spark, sf, tmp_path):
    """The fake remote finds a page in the index of its key; a scan for each page would make the pull quadratic."""
    from pliego.queries import incremental

    con = incremental._remote(incremental.snapshot(spark, sf, "9999-12-31", f"{tmp_path}/latest"))
    plan = con.execute("EXPLAIN QUERY PLAN SELECT * FROM latest WHERE (custkey % 2 = 0) AND (custkey > '7') ORDER BY custkey LIMIT 10").fetchall()
    assert "SEARCH" in plan[0][3] and not any("TEMP B-TREE" in r[3] for r in plan)
    assert con.execute("SELECT count(*) FROM latest").fetchone()[0] == spark.read.parquet(f"{sf}/orders.parquet").select("o_custkey").distinct().count()
