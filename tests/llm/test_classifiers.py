"""Language and toxicity: held-out accuracy, determinism, odd inputs."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from helpers_llm import odd_documents

from pliego.llm import langid, queries, toxicity

SF = "/root/testdata/sf0.01"


def labels_of(spark, column, table="labels"):
    return {r["doc_id"]: r[column] for r in spark.read.parquet(f"{SF}/{table}.parquet").collect()}


def test_language_of_held_out_documents(spark):
    lang = labels_of(spark, "lang", "documents")
    rows = queries.op6_language_id(spark, SF).collect()
    assert len(rows) == len(lang) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r["held_out"] and lang[r["doc_id"]] and r["lang_pred"] != langid.UNKNOWN]
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in rows) and np.mean([r["rejected"] for r in rows]) < 0.02


def test_language_of_odd_documents(spark):
    texts = spark.read.parquet(f"{SF}/documents.parquet").where("crc32(CAST(doc_id AS STRING)) % 4 != 2")
    model = langid.learn(texts)
    docs = odd_documents(spark)
    got = sorted(((r["doc_id"], r["lang_pred"], r["rejected"]) for r in langid.predict(docs, model).collect()), key=repr)
    und = {i for i, lang, _ in got if lang == langid.UNKNOWN}
    assert {2, 3, 4, None} == und and all(rejected for _, lang, rejected in got if lang == langid.UNKNOWN)
    assert langid.accepted(docs, model).columns == docs.columns
    assert langid.accepted(docs, model).count() == sum(not r for *_, r in got)
    assert langid.predict(docs.limit(0), model).count() == 0
    assert (langid.learn(texts.repartition(5)).scores == model.scores).all()


def test_language_without_labels(spark):
    model = langid.learn(odd_documents(spark))
    assert {r["lang_pred"] for r in langid.predict(odd_documents(spark), model).collect()} == {langid.UNKNOWN}


def test_rejection_is_calibrated():
    texts = [f"{w} {w}x{i} {w}y {i}" for i in range(300) for w in ("alpha", "bravo", "carlo")]
    model = langid.train(texts, ["a", "b", "c"] * 300)
    assert [langid.score(model, [t])[0][0] for t in ("alpha alphax3", "bravo bravoy", "carlo")] == ["a", "b", "c"]
    assert 0 < model.threshold <= langid.UNSURE and model.temperature > 0


def test_unlearned_languages_are_rejected(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("crc32(CAST(doc_id AS STRING)) % 4 != 2 AND lang IS NOT NULL")
    model = langid.learn(docs)
    strange = ["Litwo, ojczyzno moja, ty jesteś jak zdrowie, ile cię trzeba cenić", "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan", "Съешь же ещё этих мягких французских булок", "すべての人間は生まれながらにして自由"]
    assert langid.judged(model, strange)[2].all()
    assert langid.judged(model, [r["text"] for r in docs.collect()])[2].mean() <= 0.002
    for lang in model.languages:
        left = langid.learn(docs.where(f"lang != '{lang}'"))
        assert langid.judged(left, [r["text"] for r in docs.where(f"lang = '{lang}'").collect()])[2].mean() > 0.5, lang


def test_temperature_is_inside_its_grid():
    texts = [f"{w} {w}x{i} {w}y {i}" for i in range(300) for w in ("alpha", "bravo", "carlo")]
    assert 0.051 < langid.train(texts, ["a", "b", "c"] * 300).temperature < 4.9


def test_toxicity_of_held_out_documents(spark):
    toxic = labels_of(spark, "toxic")
    rows = queries.op8_toxicity(spark, SF).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in rows)
    held = [(toxic[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and toxic.get(r["doc_id"]) is not None]
    clean = [p for y, p in held if not y]
    assert np.mean([y == p for y, p in held]) >= 0.9 and np.mean(clean) <= 0.02


def test_toxicity_of_odd_documents(spark):
    docs, labels = odd_documents(spark), spark.createDataFrame([(1, 0), (5, 1), (5, 1), (None, 1), (6, None)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels)
    rows = toxicity.predict(docs, model).collect()
    assert len(rows) == docs.count() and len({r["score"] for r in rows if r["doc_id"] in (2, 3)}) == 1
    assert toxicity.accepted(docs, model).columns == docs.columns
    none = toxicity.learn(docs, labels.limit(0))
    assert {r["predicted"] for r in toxicity.predict(docs, none).collect()} == {0}


def test_pairs_are_learned():
    """Label 1 only where both words stand together: no sum of single weights can say that."""
    rng = np.random.default_rng(0)
    texts, y = [], []
    for _ in range(1600):
        a, b = rng.random(2) < 0.5
        texts.append(" ".join(["filler", *["qqinsult"] * int(a), *["zzgroup"] * int(b), f"w{rng.integers(50)}"]))
        y.append(int(a and b))
    rows = [toxicity.terms(t) for t in texts]
    model = toxicity.train(rows, np.array(y), epochs=30)
    p = toxicity.scores(model, ["filler qqinsult", "filler zzgroup", "filler qqinsult zzgroup", "filler"])
    assert (p >= 0.5).tolist() == [False, False, True, False]
    flat = toxicity.train(rows, np.array(y), epochs=30)
    flat.factors[:] = 0
    assert toxicity.raw(model, toxicity.terms("qqinsult zzgroup")) != pytest.approx(toxicity.raw(flat, toxicity.terms("qqinsult zzgroup")))


def test_pair_formula():
    model = toxicity.Model(0.3, np.arange(toxicity.BUCKETS, dtype=np.float32) % 7 / 10, np.random.default_rng(1).normal(size=(toxicity.BUCKETS, 3)).astype(np.float32))
    ids = toxicity.terms("one two three")
    v = model.factors[ids].astype(float)
    pairs = sum(v[i] @ v[j] for i in range(len(ids)) for j in range(i))
    assert toxicity.raw(model, ids) == pytest.approx(0.3 + model.weights[ids].sum() + pairs, rel=1e-4)


def test_letters_are_letters():
    model = langid.train(["alpha bravo carlo delta"] * 20, ["a"] * 20)
    names, sure = langid.score(model, ["²½", "①", "Ⅷ", "12 _", "ª", "日", "é"])
    assert names == [langid.UNKNOWN] * 4 + ["a"] * 3 and (sure[:4] == 0).all()


def test_language_is_the_mean_of_embeddings():
    """Scores of a text, gram by gram."""
    model = langid.train([f"{w} {w}x{i}" for i in range(100) for w in ("alpha", "bravo")], ["a", "b"] * 100)
    for text in ("alpha bravo", "Bravo, bravo!", "xx"):
        data = b" " + b" ".join(bytes(c if chr(c).isalpha() else 32 for c in text.lower().encode()).split()) + b" "
        grams = []
        for n, odd in ((3, 2654435769), (4, 2246822519)):
            for i in range(len(data) - 3 if n == 4 else len(data) - 2):
                key = int.from_bytes(data[i : i + n], "little")
                grams.append((((key ^ key >> 15) * odd) % 2**32) >> 16)
        z = np.mean([model.scores[g] for g in grams], axis=0, dtype=np.float64) + model.bias
        p = np.exp(z / model.temperature) / np.exp(z / model.temperature).sum()
        names, sure = langid.score(model, [text])
        assert names[0] == model.languages[p.argmax()] and sure[0] == pytest.approx(p.max(), rel=1e-4)


def test_toxicity_is_the_sum_over_pairs():
    """Terms by plain Python, pairs one by one."""
    rng = np.random.default_rng(2)
    model = toxicity.Model(-0.2, rng.normal(0, 0.3, toxicity.BUCKETS).astype(np.float32), rng.normal(0, 0.2, (toxicity.BUCKETS, 3)).astype(np.float32))
    m, prime = 2**64, 1099511628211
    mix = lambda key: ((key ^ key >> 29) * 0xBF58476D1CE4E5B9 % m) >> 46
    for text in ("You fool you", "short a bb ccc dddd eeeee insulting insulting", "", "é è longestwordofall"):
        found = []
        for w in toxicity.letters(text).split():
            whole = sum((c + 1) * pow(prime, i, m) for i, c in enumerate(w)) % m
            found.append(mix(whole ^ 0x9E3779B97F4A7C15))
            for n in toxicity.BEGINNINGS:
                if len(w) > n:
                    key = 0
                    for c in w[:n]:
                        key = (key * prime + c) % m
                    found.append(mix((key + (n << 58)) % m))
        ids = {*found, *(mix((i + (n << 32)) % m) for i in set(found) for n in toxicity.TIMES if found.count(i) >= n)}
        assert set(toxicity.terms(text).tolist()) == ids
        own = sorted(ids)
        z = model.base + sum(float(model.weights[i]) for i in own) + sum(float(model.factors[a].astype(float) @ model.factors[b].astype(float)) for k, a in enumerate(own) for b in own[:k])
        assert toxicity.scores(model, [text])[0] == pytest.approx(1 / (1 + np.exp(-z)), rel=1e-3)


def test_samples_are_bounded_by_rows(spark, monkeypatch):
    """One id on most rows gives one row of the sample."""
    seen = []
    monkeypatch.setattr(langid, "fit", lambda texts, labels: seen.append((texts, labels)))
    named = lambda i: "text number " + str(i).translate(str.maketrans("0123456789", "abcdefghij"))
    docs = spark.range(6000).selectExpr("CASE WHEN id < 5000 THEN 1 ELSE id END AS doc_id", "concat('text number ', translate(id, '0123456789', 'abcdefghij')) AS text", "CASE WHEN id = 5999 THEN 'rare' ELSE 'en' END AS lang")
    langid.learn(docs, sample_rows=100)
    texts, labels = seen.pop()
    assert 50 <= len(texts) <= 100 and "rare" in labels and len({tuple(langid.counted(named(i))[0]) for i in range(5000)} & {tuple(g) for g, _ in texts}) <= 1
    monkeypatch.setattr(toxicity, "train", lambda rows, y: seen.append(y))
    toxicity.learn(docs, docs.selectExpr("doc_id", "1 AS toxic"), sample_rows=100)
    assert len(seen.pop()) == 100


def test_texts_stay_where_they_are(spark, monkeypatch):
    """Thousands of long texts: the driver gets their buckets only, and no more than it may hold."""
    import numpy as np
    from pyspark.sql import functions as F

    docs = spark.range(1500).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, F.repeat(F.concat(F.lit("alpha bravo carlo delta "), F.col("id").cast("string")), 4000)).otherwise(F.repeat(F.lit("zulu yankee xray whisky "), 4000)).alias("text"), F.when(F.col("id") % 2 == 0, "a").otherwise("z").alias("lang"))
    got, fit = [], langid.fit
    monkeypatch.setattr(langid, "fit", lambda texts, labels, **more: got.append((texts, labels)) or fit(texts, labels, **more))
    model = langid.learn(docs, sample_rows=1000)
    assert len(got[0][0]) > 400 and sum(len(g) for g, _ in got[0][0]) < 200_000 and model.languages == ["a", "z"]
    assert langid.score(model, ["alpha bravo", "yankee xray"])[0] == ["a", "z"]
    monkeypatch.setattr(langid, "HELD", 5000)
    langid.learn(docs, sample_rows=1000)
    assert 0 < sum(len(g) for g, _ in got[1][0]) <= 5000
    assert all((np.diff(g) > 0).all() and c.sum() for g, c in got[1][0])


def test_many_languages(spark):
    """More labels than fit as one score a bucket each are all learned, from the embeddings."""
    import random

    rng = random.Random(4)
    words = {f"l{k:03}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(12)] for k in range(90)}
    rows = [(i, " ".join(rng.choice(words[name]) for _ in range(40)), name) for i, name in enumerate(list(words) * 12)]
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.languages) == 90 and model.weights is not None and model.scores.shape[1] == langid.WIDTH
    names, sure = langid.score(model, [" ".join(own) for own in words.values()])
    assert sum(a == b for a, b in zip(names, words, strict=True)) >= 85 and ((sure >= 0) & (sure <= 1)).all()
