"""Texts matched with many LIKE patterns by an index of the patterns' literal pieces, not pattern by pattern."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pliego.operators.joins import small
from pliego.session import cut

GRAM = 4


def literals(pattern: Column) -> Column:
    """The pieces of a LIKE pattern between its wildcards; a backslash makes what follows literal."""
    pieces = F.regexp_extract_all(pattern, F.lit(r"(?s)((?:\\.|[^%_\\])+)"), 1)
    return F.transform(pieces, lambda x: F.regexp_replace(x, r"(?s)\\(.)", "$1"))


def _grams(text: Column, size: Column | int) -> Column:
    """All stretches of `size` characters; none if the text is shorter."""
    last = F.char_length(text) - size + 1
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.substr(text, i, F.lit(size) if isinstance(size, int) else size)))


def _sized(grams: Column, size: int) -> Column:
    return F.transform(grams, lambda g: F.struct(F.lit(size).alias("_size"), g.alias("_gram")))


def like_join(df: DataFrame, text: str, patterns: DataFrame, pattern: str, gram: int = GRAM) -> DataFrame:
    """(text, pattern): the distinct pairs of which the text is LIKE the pattern.

    A text that fits a pattern holds all its literal pieces, so of each pattern one stretch of up to `gram` characters is looked up among the texts', that
    which the fewest texts hold: candidates are joined by equality, and LIKE only confirms them. A stretch in no text needs no candidates. Patterns
    of wildcards alone are met by every text, which is their answer but for the length. Nulls match nothing. Texts and patterns may be any number.
    The stretches of texts are many times the texts, which Spark's size checks do not see; they are never the side that is sent to every task.
    """
    texts = df.select(F.col(text).alias("_text")).where("_text IS NOT NULL").distinct()
    rows = patterns.select(F.col(pattern).alias("_pattern")).where("_pattern IS NOT NULL").distinct()
    longest = F.coalesce(F.array_max(F.transform(literals(F.col("_pattern")), F.char_length)), F.lit(0))
    rows = cut(rows.withColumn("_size", F.least(longest, F.lit(gram)).cast("int")))
    sizes = sorted(r[0] for r in rows.select("_size").distinct().collect())  # 0 to `gram`
    own = [_sized(F.array_distinct(_grams(F.col("_text"), n)) if n else F.array(F.lit("")), n) for n in sizes]
    empty = "array<struct<_size: int, _gram: string>>"
    every = F.flatten(F.transform(literals(F.col("_pattern")), lambda x: F.coalesce(_grams(x, F.col("_size")), F.array().cast("array<string>"))))
    looked = rows.select("_pattern", "_size", F.explode(F.when(F.col("_size") > 0, F.array_distinct(every)).otherwise(F.array(F.lit("")))).alias("_gram"))
    # only stretches that some pattern looks for are counted; those in no text are left out, with a count of none
    held = texts.select("_text", F.explode(F.concat(*[F.coalesce(o, F.array().cast(empty)) for o in own], F.array().cast(empty))).alias("_g")).select("_text", "_g.*")
    met_by = lambda few: _few(held, few.select("_size", "_gram").distinct())
    often = met_by(looked).groupBy("_size", "_gram").agg(F.count("*").alias("_n"))
    # a pattern with a stretch that no text holds has no match, so it is dropped with that stretch's count of none
    counted = looked.join(often.hint("shuffle_merge"), ["_size", "_gram"], "left").fillna(0, ["_n"])
    rarest = counted.withColumn("_rn", F.row_number().over(Window.partitionBy("_pattern").orderBy("_n", "_gram"))).where("_rn = 1 AND _n > 0")
    met = _few(held, cut(rarest.select("_pattern", "_size", "_gram")))
    return met.where("_text LIKE _pattern").select(F.col("_text").alias(text), F.col("_pattern").alias(pattern))


def _few(held: DataFrame, few: DataFrame) -> DataFrame:
    """Texts' stretches that are among a few, with these rows: the few are sent to every task if they are few indeed, else both sides are shuffled."""
    sent = small(few)
    return held.join(sent if sent is not few else few.hint("shuffle_merge"), ["_size", "_gram"])
