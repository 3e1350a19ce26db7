"""The pipeline's stages against their operators, each on its own input."""

from __future__ import annotations

import corpus_pipeline as pipeline
from helpers_llm import ODD, odd_documents
from pyspark.sql import functions as F
from test_dedup import slow_components, slow_fingerprint
from test_tokens import check_packing

from pliego.llm import langid, tables, toxicity

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = tables.table(spark, SF, "documents")
    assert [name for name, _ in pipeline.STAGES] == ["language", "toxicity", "near-duplicates", "packing"]
    language, toxic, near, pack = (f for _, f in pipeline.STAGES)

    known = tables.written(language(spark, docs, SF))
    rejected = {r["doc_id"] for r in langid.predict(docs, langid.learn(docs)).where("rejected").collect()}
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    assert known.columns == docs.columns and ids(known) == ids(docs) - rejected

    mild = tables.written(toxic(spark, known, SF))
    found = toxicity.predict(known, toxicity.learn(known, tables.table(spark, SF, "labels")))
    assert mild.columns == docs.columns and ids(mild) == {r["doc_id"] for r in found.where("predicted = 0").collect()}
    labels = {r["doc_id"]: r["toxic"] for r in tables.table(spark, SF, "labels").collect()}
    assert not any(labels.get(i) == 0 for i in ids(known) - ids(mild))

    single = tables.written(near(spark, mild, SF))
    wanted = {c for *_, c in slow_components([(r["doc_id"], slow_fingerprint(r["text"])) for r in mild.collect()])}
    assert single.columns == docs.columns and ids(single) == wanted and single.count() == len(wanted)

    packed = pack(spark, single, SF).collect()
    check_packing(packed)
    assert {r["doc_id"] for r in packed} == wanted


def test_run(spark):
    rows = pipeline.run(spark, SF).collect()
    assert rows and check_packing(rows) > 0


def test_odd_documents_through_every_stage(spark):
    """Odd rows among ordinary ones, with columns that operators use inside."""
    odd = odd_documents(spark)
    plain = tables.table(spark, SF, "documents").select("doc_id", "text", "lang", "source").withColumn("doc_id", F.col("doc_id") + 1000)
    docs = tables.written(plain.unionByName(odd, allowMissingColumns=True))
    ids = lambda df: [r["doc_id"] for r in df.select("doc_id").collect()]
    language, toxic, near, pack = (f for _, f in pipeline.STAGES)

    known = language(spark, docs, SF)
    kept = ids(known)
    assert known.columns == docs.columns and not {2, 3, 4} & set(kept) and kept.count(10) in (0, 2) and kept.count(1) == kept.count(10) // 2
    mild = toxic(spark, docs, SF)
    assert mild.columns == docs.columns and {2, 3, 4} <= set(ids(mild)) and ids(mild).count(10) == 2

    single = near(spark, tables.written(odd), SF)
    found = ids(single)
    assert single.columns == odd.columns and found.count(1) == 1 and 10 not in found and {2, 5, 6} <= set(found) and not {3, 4} & set(found)
    rows = pack(spark, odd, SF).collect()
    assert check_packing(rows) > 0 and sum(r["piece"] == 0 for r in rows) == len(ODD)


def test_empty_table_through_every_stage(spark):
    none = tables.written(odd_documents(spark).limit(0))
    for name, stage in pipeline.STAGES:
        got = stage(spark, none, SF)
        assert got.count() == 0 and (got.columns == none.columns or name == "packing"), name
