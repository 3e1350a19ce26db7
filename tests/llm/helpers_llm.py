"""Documents with everything that may be odd about them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

LONG = "A very long text about nothing, with numbers 12345 and accents áéí. " * 1500
ODD = [
    (1, "The quick brown fox jumps over the lazy dog."), (2, None), (3, ""), (4, "   \n\t "), (5, LONG), (6, "x" * 70_000), (7, " " * 40_000 + "end"), (8, "naïve café — “quoted” 日本語 テキスト 🎉🎉"), (9, "<|endoftext|> and </s> and <unk> inside"),
    (10, "The quick brown fox jumps over the lazy dog."), (10, "The quick brown fox jumps over the lazy dog."), (None, "a row without an id"), (None, None), (11, "don't they'll I'm we've it's 'tis 123abc ABC\r\n\r\n  tabs\t\there"), (12, "word"), (13, "\x00\x01 control ▁ marks ▁▁ here"), (14, "  two  spaces   three    four "),
]


def odd_documents(spark: SparkSession) -> DataFrame:
    """Clashing names: columns that operators use inside."""
    rows = [(i, t, None, "s", "old", 7, 1.0) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, ids string, id int, score double").repartition(3)
