"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text's lower-cased letters are read as byte 3- and 4-grams, word borders included. Each gram is hashed to a row of an embedding
table, the rows of a text are averaged, and a linear softmax over the average gives the languages' probabilities. Embeddings and
softmax are trained together by stochastic gradient descent in numpy, on a bounded sample of labelled rows. As the classifier is
linear, one table of gram scores per language is all that prediction needs.

Calibration: a temperature is chosen on labelled rows kept out of training, and the rejection threshold there so that at most one
in a thousand of them is rejected, and none whose probability is UNSURE or more: a text half in each of two languages stays. As held-out
rows may all be right, the temperature fits their labels only up to the share of errors that so many rows can't exclude.

A probability says nothing about languages that were never learned. For those the share of a text's grams that training has seen is
taken: rejected is what lies below a point a quarter of the way from the lowest held-out row to the typical held-out row of a language
left out, each language in turn, or below the lowest held-out row if that is less. No labelled held-out row is rejected for its share, nor a text that lies less than
CHANCE standard errors below that point, as one of few grams easily does.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pliego.llm import tables

SAMPLE = 4000
#: Buckets of all texts of the sample together that the driver may get: eight bytes each.
HELD = 1 << 25
BUCKETS = 1 << 16
WIDTH = 16
EPOCHS = 4
VISITS = 200
REJECTED = 0.001
UNSURE = 0.4
CHANCE = 2.0
UNKNOWN = "und"

_LETTER = regex.compile(r"\p{L}")
_KEEP = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray  # BUCKETS x languages, or BUCKETS x WIDTH with weights
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0
    seen: np.ndarray | None = None  # BUCKETS, whether in training
    least_seen: float = 0.0
    weights: np.ndarray | None = None  # WIDTH x languages

    def of(self, mean: np.ndarray) -> np.ndarray:
        """Scores of the languages from a text's mean row of `scores`."""
        return (mean if self.weights is None else mean @ self.weights) + self.bias


def letters(text: str) -> bytes:
    """Lower-cased words of letters, a space around each."""
    return b" " + b" ".join(text.lower().encode(errors="replace").translate(_KEEP).split()) + b" "


def grams(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the 3-grams and of the 4-grams of data."""
    x = np.frombuffer(data, np.uint8).astype(np.uint32)
    three = x[:-2] | x[1:-1] << np.uint32(8) | x[2:] << np.uint32(16)
    four = three[:-1] | x[3:] << np.uint32(24)
    mix = lambda key, odd: ((key ^ key >> np.uint32(15)) * np.uint32(odd) >> np.uint32(16)).astype(np.int64)
    return mix(three, 2654435769), mix(four, 2246822519)


def buckets(text: str) -> np.ndarray:
    data = letters(text)
    return np.concatenate(grams(data)) if len(data) > 3 else np.empty(0, np.int64)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """A text's buckets, each once, and how often it has each: all that training reads of it."""
    return np.unique(buckets(text), return_counts=True)


def train(texts: list[str], labels: list[str], **more) -> Model:
    """A model from texts, as `fit` from their buckets."""
    return fit([counted(t) for t in texts], labels, **more)


def fit(texts: list[tuple[np.ndarray, np.ndarray]], labels: list[str], width: int = WIDTH, epochs: int | None = None, rate: float = 0.5, seed: int = 3, rejected: float = REJECTED) -> Model:
    """texts: each as `counted` gives it; those without a bucket are left out. epochs: by default EPOCHS, or so many that each language gets VISITS rows."""
    languages = sorted(set(labels))
    place = {y: k for k, y in enumerate(languages)}
    rng = np.random.default_rng(seed)
    rows = [(g, c, place[y]) for (g, c), y in zip(texts, labels, strict=True) if len(g)]
    order = rng.permutation(len(rows))
    held, used = order[: len(order) // 5], order[len(order) // 5 :]
    epochs = epochs or max(EPOCHS, -(-VISITS * len(languages) // max(1, len(used))))
    table, weights, bias = rng.normal(0, 0.1, (BUCKETS, width)), np.zeros((width, len(languages))), np.zeros(len(languages))
    steps = max(1, epochs * len(used))
    for n in range(epochs):
        for at, i in enumerate(rng.permutation(used)):
            ids, counts, y = rows[i]
            share = counts / counts.sum()
            mean = share @ table[ids]
            wrong = softmax(mean @ weights + bias)
            wrong[y] -= 1
            step = rate * (1 - (n * len(used) + at) / steps) + 0.01
            back = weights @ wrong
            weights -= step * np.outer(mean, wrong)
            bias -= 0.1 * step * wrong
            table[ids] -= step * 8 * share[:, None] * back
    # one score a bucket and language, or where languages are many the embeddings, of which the scores follow
    few = len(languages) <= width
    model = Model(languages, (table @ weights if few else table).astype(np.float32), bias, weights=None if few else weights.astype(np.float32))
    by_language = np.zeros((len(languages), BUCKETS), bool)
    for i in used:
        by_language[rows[i][2], rows[i][0]] = True
    model.seen = by_language.any(axis=0)
    if len(held):
        raw = np.array([model.of(c / c.sum() @ model.scores[g]) for g, c, _ in (rows[i] for i in held)])
        truth = np.array([rows[i][2] for i in held])
        # Platt's targets: one error more than was met, as wrong as all other languages together
        doubt = 1 / (len(held) + 2)
        target = np.full(raw.shape, doubt / max(1, len(languages) - 1))
        target[np.arange(len(truth)), truth] = 1 - doubt
        loss = lambda t: -(target * np.log(np.maximum(softmax(raw / t), 1e-300))).sum(axis=1).mean()
        model.temperature = float(min(np.geomspace(0.05, 5, 40), key=loss))
        top = np.sort(softmax(raw / model.temperature).max(axis=1))
        model.threshold = float(min(UNSURE, top[int(rejected * len(top))]))
        share = lambda i, known: float(rows[i][1] @ known[rows[i][0]] / rows[i][1].sum())
        own = min(share(i, model.seen) for i in held)
        by = by_language.sum(axis=0)
        # with one language there is none to leave out, and chance stands for it
        strange = float(np.median([share(i, by > by_language[rows[i][2]]) for i in held])) if len(languages) > 1 else float(model.seen.mean())
        model.least_seen = min(own, (3 * own + strange) / 4)
    return model


def learn(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample_rows: int = SAMPLE) -> Model:
    """A model from at most sample_rows rows with an id, a text and a label, one for each id.

    Half of them are drawn by hash of the id from all rows, the rest in equal parts from each label, so that a rare language is learned too; of more labels
    than these have rows, the most frequent. Rows of null ids are not learned from. Of the rows of a repeated id that is drawn, the one whose text and label
    hash lowest is taken. Texts stay where they are: only the buckets and counts of those drawn are sent, HELD in all; if they hold more, those
    rows whose ids hash lowest are learned from. No labelled row gives a model without languages.
    """
    rows = labelled.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    rows = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    ids = tables.written(rows.select("id", "lang").distinct())
    often = ids.groupBy("lang").agg(F.count("*").alias("_n")).orderBy(F.col("_n").desc(), "lang").limit(max(1, sample_rows // 2)).collect()
    if not often:
        return train([], [])
    each = max(1, sample_rows // (2 * len(often)))
    counts = ids.sparkSession.createDataFrame([(r["lang"], r["_n"]) for r in often], "lang string, _n long")
    ids = ids.join(F.broadcast(counts), "lang")  # half of sample_rows at most
    by_hash = Window.partitionBy("lang").orderBy(F.xxhash64("id", F.lit(7)), "id")
    # about four times as many as are wanted meet in a language's window, however many rows it has
    few = ids.where(tables.share_below("id", F.lit(4.0 * each) / F.col("_n")) | (F.col("_n") <= 4 * each))
    of_each = few.withColumn("_rank", F.row_number().over(by_hash)).where(F.col("_rank") <= each).select("id")
    keys = tables.sample(ids.select("id").distinct(), "id", sample_rows // 2).unionByName(of_each).distinct()
    rows = rows.join(F.broadcast(counts.select("lang")), "lang", "left_semi")

    def count(batches):
        for b in batches:
            found = [counted(t) for t in b.column("text").to_pylist()]
            lists = [pa.array([f[i].astype(np.int32) for f in found], pa.list_(pa.int32())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("lang"), *lists, pa.array([len(f[0]) for f in found], pa.int64())], ["id", "lang", "buckets", "counts", "held"])

    schema = T.StructType([rows.schema["id"], rows.schema["lang"], *[T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("buckets", "counts")], T.StructField("held", T.LongType())])
    drawn = tables.written(tables.drawn(rows, keys, "id", sample_rows).select("id", "lang", "text").mapInArrow(count, schema))
    upto = Window.orderBy(F.xxhash64("id", F.lit(7)), "id").rowsBetween(Window.unboundedPreceding, 0)  # sample_rows rows at most, without their texts
    fitting = drawn.select("id", "held").withColumn("_held", F.sum("held").over(upto)).where(F.col("_held") <= HELD).select("id")
    found = drawn.join(F.broadcast(fitting), "id").toArrow()
    order = np.argsort(np.array(found.column("id").to_pylist(), dtype=object).astype(str), kind="stable")
    found = found.take(pa.array(order))
    texts = [(g.values.to_numpy().astype(np.int64), c.values.to_numpy().astype(np.int64)) for g, c in zip(found.column("buckets"), found.column("counts"), strict=True)]
    return fit(texts, found.column("lang").to_pylist())


def score(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Language and calibrated probability of each text; UNKNOWN and 0 where there is no letter."""
    return _read(model, texts)[:2]


def _read(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """As score, and the share of each text's grams that training has seen, 1 where there is no gram, and how many there are."""
    names = [*model.languages, UNKNOWN]
    sure, share, total = np.zeros(len(texts)), np.ones(len(texts)), np.zeros(len(texts))
    which = np.full(len(texts), len(model.languages))
    known = [i for i, t in enumerate(texts) if t and _LETTER.search(t) and model.languages]
    data = [letters(texts[i]) for i in known]
    z = np.tile(model.of(np.zeros(model.scores.shape[1], np.float32)), (len(known), 1)) if known else np.zeros((0, len(names) - 1))
    for k, d in enumerate(data):
        if len(d) > 3:
            three, four = grams(d)
            z[k] = model.of((model.scores[three].sum(axis=0) + model.scores[four].sum(axis=0)) / (len(three) + len(four)))
            total[known[k]] = len(three) + len(four)
            share[known[k]] = (np.count_nonzero(model.seen[three]) + np.count_nonzero(model.seen[four])) / (len(three) + len(four))
    if known:
        p = softmax(z / model.temperature)
        which[known], sure[known] = p.argmax(axis=1), p.max(axis=1)
    return [names[i] for i in which], sure, share, total


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, lang_pred, score and rejected of every whole text, one row for each row of docs.

    A null text or one without a letter is UNKNOWN with score 0, and rejected; so is a text whose score is below the model's
    threshold, or too few of whose grams were seen in training, which keeps its most likely language. Null and repeated ids stay; other columns are left out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS rows
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = T.StructType([T.StructField("id", base.schema["id"].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])

    def run(batches):
        for b in batches:
            lang, sure, away = judged(shared.value, b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(lang, pa.string()), pa.array(sure), pa.array(away)], ["id", "lang_pred", "score", "rejected"])

    return base.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def judged(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    lang, sure, share, total = _read(model, texts)
    # the share of a text of few grams is uncertain: what may lie above the point by chance is not rejected for it
    strange = share < model.least_seen - CHANCE * np.sqrt(model.least_seen * (1 - model.least_seen) / np.maximum(total, 1))
    return lang, sure, (np.array(lang, dtype=object) == UNKNOWN) | (sure < model.threshold) | strange


def accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that `predict` would not reject.

    Rows with a null text, or one without a letter (an empty one is such), go. Null and repeated ids, repeated rows, and columns
    of any other name stay as they are; very long texts are judged whole; an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(~judged(shared.value, b.column(text_col).to_pylist())[2]))

    return docs.mapInArrow(run, docs.schema)
