"""A corpus pipeline: language, toxicity, near-duplicates, packing. Each stage works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pliego.llm import langid, packing, simhash, tables, toxicity


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the classifier, fitted on the labelled ones among them, accepts; all columns stay.

    Null and empty texts and those without a letter go, as they have no language. Null and repeated ids and repeated rows stay, or
    go, each for itself; very long texts are judged whole. Where no document is labelled no language is known, and all go. An
    empty table gives an empty one. Columns of any other name stay as they are.
    """
    return langid.accepted(docs, langid.learn(docs))


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier, fitted on the labelled ones among them, scores below a half; all columns stay.

    A null text is an empty one; an empty text has no telling term and stays. Null and repeated ids and repeated rows stay, or go,
    each for itself; very long texts are judged whole. Where no document is labelled all stay. An empty table gives an empty one.
    """
    return toxicity.accepted(docs, toxicity.learn(docs, tables.table(spark, sf_dir, "labels")))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest id, null ids last; all columns stay.

    Null and empty texts are one group. Rows of one id whose texts are no near-duplicates are different documents and stay; of rows
    equal in all columns one stays. Very long texts count whole. An empty table gives an empty one. No column may begin with _near.
    """
    return simhash.first_of_each(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents cut and packed into sequences: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text is an empty one, of one piece with the end id alone. Null and repeated ids and repeated rows stay, each with its
    own pieces; very long texts are cut, never shortened; other columns are left out. An empty table gives an empty one.
    """
    return packing.pack_documents(docs, tables.tokenizer_path("byte_bpe_50k.json"))


STAGES = [("language", known_language), ("toxicity", not_toxic), ("near-duplicates", without_near_duplicates), ("packing", packed)]

#: The classifiers and the packing can't be said in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = tables.written(stage(spark, docs, sf_dir))
    return docs
