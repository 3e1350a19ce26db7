"""Token counts for a piece model, with a shortcut for words that are one token whole.

Offline, every vocabulary string is encoded alone; those that come out as one token are proven whole tokens. No piece of such a
model crosses from a non-space to a space, which is checked too, so a text's count is the sum over its pre-tokens: those that are
whole tokens count 1 without any merging, and only the rest is merged, each distinct one once a batch at most. The model takes
its own space mark in a text for a space; such texts are not cut, but merged whole.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MEMO = 400_000
MEMO_CHARS = 64
SPACE = "▁"

_CUT = re.compile(r"(?<=[^ ]) ")


def cut(text: str) -> list[str]:
    """text cut at every space after a non-space: each part, with the space mark that stands for the cut, is one pre-token."""
    return _CUT.split(text) if "  " in text or text[:1] == " " else text.split(" ")


class Counter:
    """Tokens of a part between cuts. `whole` holds the proven single-token strings, `known` those and what was merged since."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces):
            raise ValueError("a piece of this model crosses word boundaries")
        words = [p[1:].replace(SPACE, " ") for p in pieces if p[0] == SPACE and len(p) > 1]
        self.whole = {w: 1 for w, ids in zip(words, self.model.encode(words, num_threads=1), strict=True) if len(ids) == 1}
        self.whole[""] = 1
        self.known = dict(self.whole)

    def counts(self, texts: list[str]) -> list[int]:
        parts = [[t] if SPACE in t else cut(t) for t in texts]
        rest = list(set().union(*parts) - self.known.keys())
        self.known.update(zip(rest, map(len, self.model.encode(rest, num_threads=1)), strict=True))
        out = [sum(map(self.known.__getitem__, p)) if t else 0 for t, p in zip(texts, parts, strict=True)]
        for part in rest:
            if len(part) > MEMO_CHARS and part not in self.whole:
                del self.known[part]
        if len(self.known) > MEMO:
            self.known = dict(self.whole)
        return out


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(docs: DataFrame, path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text", slice_rows: int = 1000) -> DataFrame:
    """id_col, n_bytes (UTF-8), n_tokens and over_limit of every whole text, one row for each row of docs.

    A null text is an empty one: no bytes, no tokens. Null and repeated ids stay, a row each; other columns are left out.
    Nothing is shuffled.
    """
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = T.StructType([T.StructField("id", base.schema["id"].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(batches):
        count = counter(path).counts
        for whole in batches:
            for at in range(0, whole.num_rows, slice_rows):
                b = whole.slice(at, slice_rows)
                texts = b.column("text").to_pylist()
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(count(texts), pa.int64())], ["id", "n_bytes", "n_tokens"])

    return base.mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > limit).withColumnRenamed("id", id_col)
