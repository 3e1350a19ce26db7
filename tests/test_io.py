"""Sources, sinks, incremental builds."""

from __future__ import annotations

import json
import threading

import pytest
from pyspark.sql import functions as F

from pliego.operators.ranking import numbered
from pliego.params import Params, load_params
from pliego.plans import exports, published
from pliego.sinks import artifacts, jsonschema, writer
from pliego.sources import api, documents, files, links, manifest, pull
from pliego.streaming.incremental import Upsert, part_stream, upsert_available


class Remote:
    """A remote dataset: pages by key, conditions `:id > 'x'`, `y = n` and `:updated_at > 'x'`."""

    def __init__(self, rows, failures=()):
        self.rows, self.failures, self.asked = rows, list(failures), []

    def __call__(self, params):
        self.asked.append(params)
        if self.failures:
            return self.failures.pop(0)
        rows = sorted(self.rows, key=lambda r: r[":id"])
        for part in params.get("$where", "").replace("(", "").replace(")", "").split(" AND "):
            if part:
                col, op, value = part.split(" ")
                rows = [r for r in rows if (r[col] > value.strip("'") if op == ">" else r[col] == value.strip("'"))]
        if params.get("$select", "").startswith("count(1)"):
            return 200, {}, [{"n": str(len(rows)), "latest": max((r[":updated_at"] for r in rows), default="")}]
        return 200, {}, rows[: int(params["$limit"])]


def remote(options):
    """Transport for tests: its rows come from a JSON file, so that tasks see it too."""
    with open(options["file"]) as f:
        return Remote(json.load(f))


def rows(n, updated="2024-01-01"):
    return [{":id": f"{i:04}", "y": str(2020 + i % 2), ":updated_at": updated, "v": f"v{i}"} for i in range(n)]


def test_pages_follow_the_key():
    send = Remote(rows(7))
    got = [r[":id"] for page in api.pages(send, ":id", "", "", 3, None, None) for r in page]
    assert got == [f"{i:04}" for i in range(7)] and len(send.asked) == 3
    assert [len(p) for p in api.pages(Remote(rows(6)), ":id", "", "", 3, None, None)] == [3, 3]
    assert [len(p) for p in api.pages(Remote(rows(9)), ":id", "", "", 3, "0002", 1)] == [3]


def test_retries():
    waits = []
    assert api.fetch(Remote(rows(1), [(429, {"Retry-After": "7"}, []), (503, {}, [])]), {"$limit": "5"}, waits.append) == rows(1)
    assert waits == [7.0, 4.0]
    with pytest.raises(RuntimeError):
        api.fetch(Remote([], [(500, {}, [])] * 5), {"$limit": "5"}, waits.append)
    send = Remote([], [(404, {}, [])])
    with pytest.raises(RuntimeError):
        api.fetch(send, {"$limit": "5"}, waits.append)
    assert len(send.asked) == 1


def test_pull_and_refresh(spark, tmp_path):
    source = tmp_path / "rows.json"
    source.write_text(json.dumps(rows(10)))
    options = {"transport": "test_io:remote", "file": str(source), "page": "3", "slices": '["y = 2020", "y = 2021"]'}
    out, log = str(tmp_path / "out"), str(tmp_path / "manifest.json")
    import os

    spark.sparkContext.environment["PYTHONPATH"] = f"{os.path.dirname(__file__)}:{os.path.dirname(os.path.dirname(__file__))}"
    entry = pull.pull(spark, "d", out, log, options, ["y", "v"])
    assert (entry["rows_pulled"], entry["status"], entry["max_updated_at"], entry["live_count_at_start"]) == (10, "complete", "2024-01-01", 10)
    assert pull.pull(spark, "d", out, log, options, ["y", "v"]) == entry
    changed = [r | {"v": "new", ":updated_at": "2024-02-01"} if r[":id"] == "0003" else r for r in rows(11)]
    changed[10][":updated_at"] = "2024-02-01"
    source.write_text(json.dumps(changed))
    pull.pull(spark, "d", out, log, options, ["y", "v"], refresh=True)
    found = dict(pull.latest_rows(spark, out).select(":id", "v").collect())
    assert len(found) == 11 and found["0003"] == "new" and found["0010"] == "v10" and found["0001"] == "v1"


def test_manifest_survives_concurrent_writers(tmp_path):
    path = str(tmp_path / "m.json")
    threads = [threading.Thread(target=manifest.update, args=(path, f"d{i % 4}"), kwargs={f"k{i}": i}) for i in range(24)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert {k: len(v) for k, v in manifest.read(path).items()} == {f"d{i}": 6 for i in range(4)}
    done = []
    with pytest.raises(RuntimeError, match="b: no"):
        manifest.try_all({"a": lambda: done.append(1), "b": lambda: (_ for _ in ()).throw(ValueError("no")), "c": lambda: done.append(2)})
    assert done == [1, 2]


def test_files(spark, tmp_path):
    for case, columns in (("c1/d1", "a string, b string"), ("c1/d2", "a string, extra string")):
        spark.createDataFrame([("1", "2")], columns).write.parquet(str(tmp_path / case))
    (tmp_path / "c2" / "d3").mkdir(parents=True)
    frames = files.datasets(spark, str(tmp_path))
    assert len(frames) == 2
    assert sorted(map(tuple, files.aligned(frames, {"x": ("extra", "b"), "n": ("none",)}).collect())) == [("2", None), ("2", None)]
    ref = tmp_path / "ref.csv"
    ref.write_text("raw_value,modalidad_norm,es_competitiva,es_abierta,more\nA,OTRO,false,true,x\n")
    assert tuple(files.reference(spark, str(ref), "ref_modalidades").first()) == ("A", "OTRO", False, True)
    lines = tmp_path / "multi.csv"
    lines.write_text('a,b\n"one\ntwo","say ""hi"""\n')
    assert tuple(files.text_csv(spark, str(lines), ["a", "b"]).first()) == ("one\ntwo", 'say "hi"')
    assert files.columns_like(["fecha_de_publicacion_del_x"], "fecha_de_publicacion_del") == "fecha_de_publicacion_del_x"
    assert files.column_for(["Nit Entidad", "anio"], ["ANIO"]) == "anio" and files.column_for(["Nit Entidad"], ["entidad"]) == "Nit Entidad" and files.column_for(["a"], ["z"]) is None
    assert files.projected(frames[0], ["a", "zzz"]).columns == frames[0].columns


def test_links(spark):
    html = '<a href="/x/Datos%20a.xlsx">1</a> <a href=\'b.csv?v=1\'>2</a><a HREF="https://o.org/c.zip">3</a><a href="page.html">4</a><a href="//h/d.ods">5</a>'
    found = links.links(spark.createDataFrame([(1, "https://s.org/dir/p?q=1", html)], "id int, url string, html string"), "id", "url", "html").orderBy("at").collect()
    assert [(r["url"], r["file"]) for r in found] == [("https://s.org/x/Datos%20a.xlsx", "Datos_a.xlsx"), ("https://s.org/dir/b.csv?v=1", "b.csv"), ("https://o.org/c.zip", "c.zip"), ("https://h/d.ods", "d.ods")]


def test_chunks_and_budget(spark, tmp_path):
    df = spark.createDataFrame([(i, None if i == 3 else f"t{i}") for i in range(10)], "i int, t string").repartition(4)
    artifacts.write_chunks(df, str(tmp_path / "list"), 4, [F.col("i").desc()])
    read = {r["chunk_index"]: json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "list")).collect()}
    assert [x["i"] for k in sorted(read) for x in read[k]["items"]] == list(range(9, -1, -1)) and read[0]["n_chunks"] == 3 and read[0]["n_items_total"] == 10
    assert read[1]["items"][2] == {"i": 3, "t": None}
    artifacts.write_chunks(df.limit(1), str(tmp_path / "list"), 4, [F.col("i")])
    assert spark.read.text(str(tmp_path / "list")).count() == 1  # nothing stale is left
    assert artifacts.chunked(df.limit(0), 4, F.col("i")).count() == 0
    with pytest.raises(ValueError, match="at least one"):
        artifacts.chunked(df, 0, F.col("i"))
    with pytest.raises(ValueError, match="budget"):
        artifacts.write_chunks(df, str(tmp_path / "big"), 4, [F.col("i")], total=10)


def test_publish_checks_before_it_writes(spark, tmp_path):
    schemas = {"a": {"type": "object", "required": ["x"]}}
    ready = spark.createDataFrame([("a/1.json", "a", '{"x":1}'), ("b.json", "a", '{"x":"ñ"}')], "path string, kind string, json string")
    out = str(tmp_path / "web")
    assert [m["bytes"] for m in artifacts.publish(ready, out, schemas)] == [7, 10]
    wrong = spark.createDataFrame([("c.json", "a", "{}")], ready.schema)
    with pytest.raises(ValueError, match="c.json .*lacks x"):
        artifacts.publish(wrong, out, schemas)
    with pytest.raises(ValueError, match="budget"):
        artifacts.publish(ready, out, schemas, total=16)
    assert sorted(artifacts.json_files(spark, out)) == ["a/1.json", "b.json", "manifest.json"]
    artifacts.publish(ready.limit(1).coalesce(1).where("path = 'a/1.json'"), out, schemas)
    assert sorted(artifacts.json_files(spark, out)) == ["a/1.json", "manifest.json"]


def test_a_failing_task_leaves_the_old_files(spark, tmp_path):
    out, schema = str(tmp_path / "web"), "path string, kind string, json string"
    spark.dataSource.register(writer.TextFiles)

    def save(rows):
        spark.createDataFrame(rows, schema).repartition(4).write.format("text_files").mode("overwrite").save(out)

    save([(f"d/{i}.json", "k", f'{{"i":{i}}}') for i in range(20)])
    before = {str(f.relative_to(tmp_path)): f.read_text() for f in tmp_path.rglob("*.json")}
    assert len(before) == 21 and len(json.loads(before["web/manifest.json"])["files"]) == 20 and not (tmp_path / "web" / "_staged").exists()
    for wrong in ("../x.json", None):
        with pytest.raises(Exception, match="no file can be written"):
            save([(f"d/{i}.json", "k", "new") for i in range(20)] + [(wrong, "k", "{}")])
    with pytest.raises(Exception, match="there twice"):
        save([("a.json", "k", "1"), ("a.json", "k", "2")])
    assert {str(f.relative_to(tmp_path)): f.read_text() for f in tmp_path.rglob("*.json")} == before
    save([("d/3.json", "k", "new")])
    assert not (tmp_path / "web" / "_staged").exists()
    assert {str(f.relative_to(tmp_path)) for f in tmp_path.rglob("*.json")} == {"web/d/3.json", "web/manifest.json"}


def served(options):
    """Transport for tests: each URL says itself how it is answered, and each request is noted in a file of its own."""
    import os
    import uuid

    def get(url):
        name = url.rsplit("/", 1)[-1]
        os.makedirs(options["log"], exist_ok=True)
        with open(f"{options['log']}/{uuid.uuid4().hex}", "w") as f:
            f.write(url)
        if name.startswith("lost"):
            raise OSError("connection reset")
        return (404, {}, b"") if name.startswith("no") and not os.path.exists(options.get("back", "none")) else (200, {"Content-type": "text/csv"}, f"body of {url}".encode())

    return get


def asked(log):
    return sorted(f.read_text() for f in log.glob("*"))


def test_documents_are_fetched_once(spark, tmp_path, monkeypatch):
    import hashlib
    import os

    monkeypatch.setattr(api, "ATTEMPTS", 1)
    spark.sparkContext.environment["PYTHONPATH"] = f"{os.path.dirname(__file__)}:{os.path.dirname(os.path.dirname(__file__))}"
    html = '<a href="/d/a.csv">1</a> <a href="b.xlsx">2</a> <a href="/d/a.csv">again</a> <a href="no.zip">3</a>'
    pages = spark.createDataFrame([(1, "https://s.org/x/p", html), (2, "https://t.org/", html), (3, "https://t.org/", None)], "id int, url string, html string")
    found = links.links(pages, "id", "url", "html")
    options = {"transport": "test_io:served", "log": str(tmp_path / "log"), "back": str(tmp_path / "back")}
    got = {r["url"]: r for r in documents.gathered(found, options, str(tmp_path / "docs"), tasks=3).collect()}
    assert len(got) == 6 and len(asked(tmp_path / "log")) == 6
    good = got["https://s.org/d/a.csv"]
    assert (good["file"], good["status"], good["content_type"], good["failure"]) == ("a.csv", 200, "text/csv", None) and good["sha256"] == hashlib.sha256(good["body"]).hexdigest() and good["n_bytes"] == len(good["body"])
    assert "404" in got["https://t.org/no.zip"]["failure"] and got["https://t.org/no.zip"]["body"] is None
    (tmp_path / "back").write_text("")
    again = {r["url"]: r["failure"] for r in documents.gathered(found, options, str(tmp_path / "docs"), tasks=3).collect()}
    assert set(again.values()) == {None} and len(asked(tmp_path / "log")) == 8  # only the two that had failed
    assert documents.gathered(found, options, str(tmp_path / "docs")).count() == 6 and len(asked(tmp_path / "log")) == 8


def test_documents_that_never_come(monkeypatch):
    waits = []

    def lost(url):
        raise OSError("reset")

    assert documents.one(lost, "u", waits.append)[-1] == "nothing for u: reset" and waits == [2.0, 4.0, 8.0, 16.0]
    monkeypatch.setattr(documents, "LARGEST", 3)
    assert documents.one(lambda u: (200, {}, b"abcd"), "u")[1:] == (200, None, 4, None, None, "larger than 3 bytes")


def test_evidence_is_described(spark):
    from pliego.functions.evidence import described

    text = '{"num_oferentes_unicos":1234,"fecha_firma":"2023-05-01","share_directa":0.4567,"precio_base":-2500000000.5,"f03_dinero":true,"z_score":2.346,"otra_clave":"x","valor_contrato":1234,"window_id":null,"anio":"abc"}'
    row = spark.createDataFrame([(text,), (None,)], "t string").select(described(F.col("t")).alias("d")).collect()
    assert [tuple(x) for x in row[0]["d"]] == [
        ("num_oferentes_unicos", "Oferentes únicos", "1.234"), ("fecha_firma", "Fecha de firma", "1 de mayo de 2023"), ("share_directa", "Participación de la entidad en contratación directa", "45,7%"), ("precio_base", "Precio base publicado", "-$2,5 mil millones"),
        ("f03_dinero", "¿Se activó por adición en valor?", "Sí"), ("z_score", "Desviaciones estándar sobre el grupo de pares", "2,35"), ("otra_clave", "Otra clave", "x"), ("valor_contrato", "Valor del contrato", "$1.234"), ("window_id", "Ventana electoral", "—"), ("anio", "Año", "abc"),
    ]
    assert row[1]["d"] is None


def test_accents_and_legal_forms(spark):
    from pliego.functions import text as t

    names = spark.createDataFrame([("Peña Ñuñez Ştefan Ğőřńű SAS",), ("Obras y Vías S. EN C.S.",), ("Casa LTDA",), ("e\u0301lan  s.a.",)], "n string")
    assert [r[0] for r in names.select(t.company_name(F.col("n"))).collect()] == ["PENA NUNEZ STEFAN GORNU", "OBRAS Y VIAS S. EN C.S.", "CASA", "ELAN"]


def test_csv_with_mark(spark, tmp_path):
    artifacts.write_csv(spark.createDataFrame([(1, "ñ")], "a int, b string").coalesce(1), str(tmp_path / "c"), mark=True)
    assert next((tmp_path / "c").glob("*.csv")).read_bytes() == "\ufeffa,b\n1,ñ\n".encode()


def problems(spark, schema, *texts):
    rows = [(f"{i}.json", "k", t) for i, t in enumerate(texts)]
    found = jsonschema.broken(spark.createDataFrame(rows, "path string, kind string, json string").repartition(2), {"k": schema}).collect()
    return [[r["problem"] for r in found if r["path"] == f"{i}.json"] for i in range(len(texts))]


def test_schema_problems(spark):
    schema = {"type": "object", "required": ["a", "z"], "properties": {"a": {"type": "array", "items": {"type": ["number", "null"], "minimum": 0}}, "t": {"type": "string", "enum": ["x"]}}}
    kinds = "not of type ['number', 'null']"
    wanted = ["$: lacks z", "$.a[2]: -1 is below 0", f"$.a[3]: {kinds}", f"$.a[4]: {kinds}", "$.t: not one of ['x']"]
    assert problems(spark, schema, '{"a": [1, null, -1, "s", true], "t": "y"}', "{", '{"a": [], "z": 1}', "[]") == [wanted, ["$: no JSON"], [], ["$: not of type ['object']"]]


def test_schema_words(spark):
    strict = {"type": "object", "additionalProperties": False, "required": ["c"], "properties": {"c": {"type": "string", "pattern": "^[0-9]{2}$"}, "n": {"type": ["string", "null"], "minLength": 2}, "i": {"type": "integer", "maximum": 3}, "l": {"type": "array", "minItems": 1, "maxItems": 2, "items": {"type": "boolean"}}, "d": {"type": "string", "format": "date-time"}, "o": {"type": "object"}, "e": {"type": ["string", "null"], "enum": ["a", None]}}}
    good = ['{"c": "07"}', '{"c": "07", "n": null, "i": 3, "l": [true], "d": "2024-01-01T00:00:00+00:00", "o": {"any": 1}, "e": null}', '{"c": "07", "i": 2.0, "e": "a"}']
    assert problems(spark, strict, *good) == [[], [], []]
    bad = '{"c": "7x", "n": "a", "i": 4, "l": [], "d": "today", "o": "{}", "e": "b", "more": 1, "other": null}'
    assert sorted(problems(spark, strict, bad)[0]) == sorted([
        "$: may not have more", "$: may not have other", '$.c: "7x" does not match ^[0-9]{2}$', "$.n: shorter than 2", "$.i: 4 is above 3", "$.l: fewer than 1 items", '$.d: "today" is not a date and time', "$.o: not of type ['object']", "$.e: not one of ['a', None]",
    ])
    assert problems(spark, strict, '{"c": "07", "i": 2.5, "l": [true, 1, false]}')[0] == ["$.i: not of type ['integer']", "$.l: more than 2 items", "$.l[1]: not of type ['boolean']"]
    with pytest.raises(ValueError, match="oneOf"):
        jsonschema.violations(F.lit(None), {"oneOf": []}, F.lit("$"))


def test_every_failure_is_kept(spark, tmp_path):
    rows = spark.range(70).select(F.format_string("%03d.json", "id").alias("path"), F.lit("k").alias("kind"), F.lit('{"a": [1, 2]}').alias("json"))
    with pytest.raises(artifacts.SchemaError, match="000.json .*and 120 more") as failed:
        artifacts.publish(rows, str(tmp_path / "w"), {"k": {"type": "object", "properties": {"a": {"type": "array", "items": {"type": "string"}}}}})
    assert failed.value.problems.count() == 140 and not (tmp_path / "w").exists()
    with pytest.raises(artifacts.SchemaError, match="no schema of kind k"):
        artifacts.publish(rows, str(tmp_path / "w"), {})


def test_reports_and_csv(spark, tmp_path):
    df = spark.createDataFrame([("a,b", 'q"', None)], "x string, y string, z string")
    assert "| a,b | q\" |  |" in artifacts.markdown("T", df)
    artifacts.write_csv(df, str(tmp_path / "c"))
    assert tuple(files.text_csv(spark, str(tmp_path / "c"), ["x", "y", "z"]).first()) == ("a,b", 'q"', None)
    artifacts.write_text(spark, "ñ", str(tmp_path / "r.md"))
    assert (tmp_path / "r.md").read_text() == "ñ"
    assert artifacts.replace_table(df, str(tmp_path / "t")).count() == 1


def test_params_file(tmp_path):
    path = tmp_path / "w.json"
    path.write_text(json.dumps({"flags": {"F01": {"nombre": "U", "nivel": "contract", "peso": 3}}, "tiers": [{"id": "t", "nombre": "T", "min_score": 1}], "shrinkage": {"k": 4, "min_contratos_rank": 2}}))
    p = load_params(str(path))
    assert (p.weights, p.tiers, p.shrink_k, p.min_contracts) == ({"F01": ("U", "contract", 3)}, [("t", "T", 1.0)], 4, 2)
    assert Params().total_weight("contract") == 119 and Params().total_weight("entity") == 16


def test_meta(spark):
    got = published.meta(Params(), {"casos_prioritarios": (5, 2100)}, "2024-01-01T00:00:00Z")
    assert got["niveles_riesgo"][0]["max_score"] == 20.0 and got["niveles_riesgo"][-1]["max_score"] is None and len(got["banderas"]) == 14 and got["artefactos"]["casos_prioritarios"]["n_chunks"] == 5
    assert problems(spark, published.ARTIFACT_SCHEMAS["meta"], json.dumps(got)) == [[]]
    told = published.backtest_block({"auc": 0.7, "lift": 2.0, "n": 10, "n_pos": 2, "reached": True, "precision": {"top_1%": 0.5}})
    assert told["precision_top_1pct"] == 0.5 and told["precision_top_5pct"] is None and told["cumple_objetivos"] and "0.7000" in told["resumen"]


def test_upsert_stream(spark, tmp_path):
    schema = "k string, v int"
    source, sink = str(tmp_path / "in"), Upsert(str(tmp_path / "out"), ["k"], "file_name")

    def arrive(name, data):
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(str(tmp_path / name))
        part = next((tmp_path / name).glob("part-*.parquet"))
        (tmp_path / "in").mkdir(exist_ok=True)
        part.rename(tmp_path / "in" / f"{name}.parquet")

    def run():
        upsert_available(part_stream(spark, source, schema), sink, str(tmp_path / "checkpoint")).awaitTermination()
        return dict(sink.current(spark).select("k", "v").collect())

    arrive("part-00000", [("a", 1), ("b", 1)])
    assert run() == {"a": 1, "b": 1}
    assert run() == {"a": 1, "b": 1}
    arrive("part-refresh-00000", [("a", 2), ("c", 2)])
    assert run() == {"a": 2, "b": 1, "c": 2}
    assert dict(sink.compact(spark, str(tmp_path / "folded")).current(spark).select("k", "v").collect()) == {"a": 2, "b": 1, "c": 2}


def test_lookup_filter_pivot(spark):
    rows = spark.createDataFrame([("C1", "Alcaldía X", "alto", 2020), ("C2", "Hospital", "medio", 2021)], "id_contrato string, nombre_entidad string, tier string, anio int")
    assert [r[0] for r in exports.filtered(rows, "ALCALDÍA").collect()] == ["C1"] and exports.filtered(rows, tier="bajo").count() == 0
    assert exports.found_by_id("C2", rows.where("tier = 'alto'"), rows).first()["tier"] == "medio"
    assert [tuple(r) for r in exports.pivoted(rows.withColumn("n", F.lit(1)), "anio", "tier", "n", ["alto", "medio"]).orderBy("anio").collect()] == [(2020, 1, 0), (2021, 0, 1)]
    assert numbered(rows, F.col("id_contrato")).count() == 2
