"""Toxicity by a factorization machine over hashed terms.

A text's terms are its distinct lower-cased words and their beginnings of four to eight bytes, and that one of these occurs twice,
three or five times; each is hashed to one of BUCKETS weights and short factor vectors. The score is the logistic function of

    w0 + sum of w[i] + sum over pairs i < j of <v[i], v[j]>

so that two terms together, such as an insult and a mention of a group, can weigh more or less than both alone, which a sum of
single weights cannot say. All pairs cost one pass: 1/2 (|sum v|^2 - sum |v|^2). Trained by AdaGrad in numpy on a bounded sample;
only terms whose likelihood-ratio statistic with the label exceeds SIGNIFICANT get weights at all.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pliego.llm import tables
from pliego.llm.langid import letters

SAMPLE = 12_000
BUCKETS = 1 << 18
FACTORS = 6
EPOCHS = 15
BEGINNINGS = (4, 5, 6, 7, 8)
TIMES = (2, 3, 5)
SEEN = 3
SIGNIFICANT = 15.0
KEPT = 0.9


@dataclass
class Model:
    base: float
    weights: np.ndarray
    factors: np.ndarray


def terms(text: str) -> np.ndarray:
    """Distinct buckets of a text's terms."""
    x = np.frombuffer(letters(text), np.uint8).astype(np.uint64)
    gaps = np.flatnonzero(x == 32)
    start, size = gaps[:-1] + 1, np.diff(gaps) - 1
    start, size = start[size > 0], size[size > 0]
    if not len(start):
        return np.empty(0, np.int32)
    powers = np.full(int(size.max()) + 1, 1099511628211, np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    place = np.arange(len(x)) - np.repeat(np.r_[0, start], np.diff(np.r_[0, start, len(x)]))
    place = np.minimum(place, len(powers) - 1)
    weighted = (x + np.uint64(1)) * powers[place]
    weighted[x == 32] = 0
    keys = [np.add.reduceat(weighted, start) ^ np.uint64(0x9E3779B97F4A7C15)]
    for n in BEGINNINGS:
        long = start[size > n]
        key = np.zeros(len(long), np.uint64)
        for i in range(n):
            key = key * np.uint64(1099511628211) + x[long + i]
        keys.append(key + np.uint64(n << 58))
    ids, count = np.unique(mixed(np.concatenate(keys)), return_counts=True)
    often = [mixed(ids[count >= n].astype(np.uint64) + np.uint64(n << 32)) for n in TIMES]
    return np.unique(np.concatenate([ids, *often])).astype(np.int32)


def mixed(key: np.ndarray) -> np.ndarray:
    return ((key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(46)).astype(np.int64)


def counted(rows: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of every bucket: how many rows have it, and how many of these have label 1."""
    count = lambda own: np.bincount(np.concatenate([*own, np.empty(0, np.int32)]).astype(np.int64), minlength=BUCKETS).astype(float)
    return count(rows), count([r for r, y in zip(rows, labels, strict=True) if y])


def telling(seen: np.ndarray, hit: np.ndarray, n: float, p: float) -> np.ndarray:
    """Which buckets are used: those of SEEN rows at least whose two-by-two table with the label has a likelihood-ratio statistic over SIGNIFICANT. n rows, p of label 1."""
    part = lambda o, e: np.where(o > 0, o * np.log(np.maximum(o, 1e-12) / np.maximum(e, 1e-12)), 0)
    share = p / max(n, 1)
    cells = ((hit, seen * share), (seen - hit, seen * (1 - share)), (p - hit, (n - seen) * share), (n - p - seen + hit, (n - seen) * (1 - share)))
    return (seen >= SEEN) & (2 * sum(part(o, e) for o, e in cells) > SIGNIFICANT)


def raw(model: Model, ids: np.ndarray) -> float:
    v = model.factors[ids]
    total = v.sum(axis=0)
    return float(model.base + model.weights[ids].sum() + 0.5 * (total @ total - np.square(v).sum()))


def logistic(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def train(rows: list[np.ndarray], labels: np.ndarray, factors: int = FACTORS, epochs: int = EPOCHS, rate: float = 0.1, decay: float = 1e-3, toxic_weight: float = 3.0, kept: float = KEPT, seed: int = 1) -> Model:
    """Rows with label 1 weigh toxic_weight times those with 0, as they are few.

    Every visit of a row sees only a share `kept` of its terms, drawn anew, so that each telling term learns to stand alone.
    """
    rng = np.random.default_rng(seed)
    used = telling(*counted(rows, labels), float(len(rows)), float(labels.sum()))
    rows = [r[used[r]] for r in rows]
    base, w, v = -2.0, np.zeros(BUCKETS), rng.normal(0, 0.01, (BUCKETS, factors)) * used[:, None]
    w_sum, v_sum = np.full(BUCKETS, 1e-2), np.full((BUCKETS, factors), 1e-2)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            ids = rows[i][rng.random(len(rows[i])) < kept]
            own = v[ids]
            total = own.sum(axis=0)
            g = logistic(base + w[ids].sum() + 0.5 * (total @ total - np.square(own).sum())) - labels[i]
            g *= toxic_weight if labels[i] else 1.0
            g_w, g_v = g + decay * w[ids], g * (total - own) + decay * own
            w_sum[ids] += np.square(g_w)
            v_sum[ids] += np.square(g_v)
            w[ids] -= rate * g_w / np.sqrt(w_sum[ids])
            v[ids] -= 0.3 * rate * g_v / np.sqrt(v_sum[ids])
            base -= 0.02 * g
    return Model(float(base), w.astype(np.float32), v.astype(np.float32))


def learn(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE) -> Model:
    """A model from at most sample_rows labelled documents, one for each id, drawn by hash of the id.

    An id that is labelled more than once is toxic if one of its labels says so; of the documents of a repeated id the one whose
    text hashes lowest is taken, a null text as an empty one. Null ids and null labels are not learned from. What goes to the
    driver is counts, two for each of BUCKETS, and then of each row those terms that these counts show to be telling. No labelled document gives a model that scores every text alike, as not toxic.
    """
    marked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    keys = tables.sample(marked, "id", sample_rows)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = tables.drawn(texts, keys, "id", sample_rows).join(F.broadcast(keys), "id")  # sample_rows rows at most

    def run(batches):
        for b in batches:
            rows = [terms(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id").cast(pa.string()), b.column("y"), pa.array(rows, pa.list_(pa.int32()))], ["id", "y", "terms"])

    drawn = tables.written(found.mapInArrow(run, "id string, y int, terms array<int>"))
    lists = lambda b: [r.values.to_numpy() for r in b.column("terms")]

    def count(batches):
        seen, hit = np.zeros(BUCKETS), np.zeros(BUCKETS)
        for b in batches:
            more = counted(lists(b), b.column("y").to_numpy())
            seen, hit = seen + more[0], hit + more[1]
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(seen[at]), pa.array(hit[at])], ["term", "seen", "hit"])

    counts = drawn.mapInArrow(count, "term int, seen double, hit double").groupBy("term").agg(F.sum("seen").alias("seen"), F.sum("hit").alias("hit")).toArrow()  # BUCKETS rows at most
    seen, hit = np.zeros(BUCKETS), np.zeros(BUCKETS)
    seen[counts.column("term").to_numpy()], hit[counts.column("term").to_numpy()] = counts.column("seen").to_numpy(), counts.column("hit").to_numpy()
    n, p = drawn.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    used = docs.sparkSession.sparkContext.broadcast(telling(seen, hit, float(n), float(p)))  # BUCKETS flags

    def keep(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("y"), pa.array([r[used.value[r]] for r in lists(b)], pa.list_(pa.int32()))], ["id", "y", "terms"])

    got = drawn.mapInArrow(keep, drawn.schema).toArrow()
    order = np.argsort(np.array(got.column("id").to_pylist(), dtype=object).astype(str), kind="stable")
    got = got.take(pa.array(order))
    return train([np.asarray(r.values.to_numpy(), np.int32) for r in got.column("terms")], got.column("y").to_numpy())


def scores(model: Model, texts: list[str | None]) -> np.ndarray:
    return logistic(np.array([raw(model, terms(t or "")) for t in texts]))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, score (0 to 1) and predicted (1 from a half on) of every whole text, one row for each row of docs.

    A null text is an empty one, which gets the score of no term at all. Null and repeated ids stay; other columns are left out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS rows
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = T.StructType([T.StructField("id", base.schema["id"].dataType), T.StructField("score", T.DoubleType())])

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(scores(shared.value, b.column("text").to_pylist()), pa.float64())], ["id", "score"])

    return base.mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= 0.5).cast("int")).withColumnRenamed("id", id_col)


def accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that score below a half.

    A null text is an empty one and is judged like it. Null and repeated ids, repeated rows, and columns of any other name stay as
    they are; very long texts are judged whole; an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(scores(shared.value, b.column(text_col).to_pylist()) < 0.5))

    return docs.mapInArrow(run, docs.schema)
