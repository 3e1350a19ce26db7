"""Periodic runs of words, by naming blocks of power-of-two lengths (Karp, Miller and Rosenberg).

Level 0 names each word by its text, level k+1 names a block of 2^(k+1) words by the pair of names of its halves; equal names mean
equal blocks. The longest common extension of two places, to the right or to the left, is found by descending through the levels:
a block that agrees is taken whole. A run of period q and length L is a stretch of at least L - q places i whose word is that of
place i + q, so a grid whose step is the shortest such stretch meets every run of period q. Each grid place that agrees is extended
both ways; what is long enough is a run, and of equal stretches the smallest period counts.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEAST_WORDS = 6
LEAST_PERIODS = 4
#: Blocks of up to 2^TOP words have names; longer extensions take several of the largest.
TOP = 16
#: So many grid places are extended at a time.
GRID = 1 << 20
#: Periods of texts of more words than this are taken by doubling, so that long runs are known before multiples of their periods are tried.
SHORT = 4096


def named(words: list) -> np.ndarray:
    """Level 0: a number for each word, equal for equal words."""
    numbers: dict = {}
    return np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))


class Names:
    """Names of all blocks of 2^k words of one text. Levels are made when first asked for; above the last level where two blocks are equal there are none."""

    def __init__(self, words: np.ndarray):
        self.levels, self.last = [words], False

    def upto(self, longest: int) -> list[np.ndarray]:
        """The levels whose blocks are no longer than `longest` words, level 0 always."""
        while not self.last and len(self.levels) <= TOP and 1 << len(self.levels) <= longest:
            below, half = self.levels[-1], 1 << len(self.levels) - 1
            if len(below) <= half:
                self.last = True
                break
            pairs = below[:-half].astype(np.int64) * (int(below.max()) + 1) + below[half:]
            found, names = np.unique(pairs, return_inverse=True)
            if len(found) == len(pairs):  # no two blocks of this length are equal
                self.last = True
                break
            self.levels.append(names.astype(np.int32))
        return self.levels[: max(1, int(longest).bit_length())]


def extended(names: list[np.ndarray], a: np.ndarray, b: np.ndarray, step: int) -> np.ndarray:
    """How many words from a and b on agree, going right (step 1: words a, a+1 ...) or left (step -1: words a-1, a-2 ...)."""
    out = np.zeros(len(a), np.int64)
    for k in range(len(names) - 1, -1, -1):
        level, size = names[k], 1 << k
        alive = np.arange(len(a))
        while len(alive):  # once below the largest level, where a second block of one size can't agree
            x, y = ((p[alive] + step * out[alive]) - (size if step < 0 else 0) for p in (a, b))
            inside = (np.minimum(x, y) >= 0) & (np.maximum(x, y) < len(level))
            alive, x, y = alive[inside], x[inside], y[inside]
            alive = alive[level[x] == level[y]]
            out[alive] += size
            if k < len(names) - 1:
                break
    return out


def grid(n: int, first: int, last: int, least: int, times: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) of every grid place of the periods first to last."""
    periods = np.arange(first, last + 1)
    steps = np.maximum(least, times * periods) - periods
    counts = -(-(n - periods) // steps)
    period = np.repeat(periods, counts)
    place = (np.arange(len(period)) - np.repeat(np.cumsum(counts) - counts, counts)) * np.repeat(steps, counts)
    return place, period


def within(found: list[np.ndarray], place: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Whether place and place + period are in a known long run whose period divides this one: they would give that run again.

    Two runs of one period share fewer words than it has, so only the last one that starts before the place can hold both.
    """
    known = np.concatenate([f[f[:, 1] > SHORT] for f in found]) if found else np.empty((0, 3), np.int64)
    out = np.zeros(len(place), bool)
    for p in np.unique(known[:, 2]).tolist():
        own = known[known[:, 2] == p]
        own = own[np.argsort(own[:, 0])]
        at = np.searchsorted(own[:, 0], place, side="right") - 1
        out |= (at >= 0) & (period % p == 0) & (place + period < (own[:, 0] + own[:, 1])[np.maximum(at, 0)])
    return out


def runs_of(words: np.ndarray, least: int = LEAST_WORDS, times: int = LEAST_PERIODS) -> np.ndarray:
    """(start, length, period) of every run, by start, then period. words: names of level 0.

    A run is as long as it can be, its period q is its smallest, and it has at least max(least, times * q) words. times is 2 at least.
    """
    n = len(words)
    found, names, first = [], Names(words), 1
    longest = min(n // times, n - 1)  # the largest period that fits
    while first <= longest:
        last = first  # periods up to last make one batch of grid places
        size = 0
        while last <= longest and size < GRID and (n <= SHORT or last < 2 * first):
            size += -(-(n - last) // (max(least, times * last) - last))
            last += 1
        place, period = grid(n, first, last - 1, least, times)
        first = last
        same = words[place] == words[place + period]
        place, period = place[same], period[same]
        if not len(place):
            continue
        need = np.maximum(least, times * period) - period
        # words at grid places agree by chance; two of their neighbours on either side as well is rarer, and costs no levels
        near = np.zeros(len(place), np.int64)
        for by in (1, 2):
            after, before = place + period + by < n, place - by >= 0
            near += after & (words[np.minimum(place + by, n - 1)] == words[np.minimum(place + period + by, n - 1)])
            near += before & (words[np.maximum(place - by, 0)] == words[np.maximum(place + period - by, 0)])
        kept = near >= np.minimum(2, need - 1)  # of need >= 3 agreeing words in a row around the place, two are its neighbours
        kept &= ~within(found, place, period)
        place, period, need = place[kept], period[kept], need[kept]
        if not len(place):
            continue
        levels = names.upto(n)
        right = extended(levels, place, place + period, 1)
        left = extended(levels, place, place + period, -1)
        some = left + right >= need
        found.append(np.stack([place - left, left + right + period, period], axis=1)[some])
    if not found or not sum(map(len, found)):
        return np.empty((0, 3), np.int64)
    every = np.unique(np.concatenate(found), axis=0)  # by start, length, period: the smallest period of a stretch comes first
    own = np.ones(len(every), bool)
    own[1:] = (every[1:, :2] != every[:-1, :2]).any(axis=1)
    every = every[own]
    return every[np.lexsort((every[:, 2], every[:, 0]))]


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Whether each word stays: none that a run contains after its first period."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edges[:n]) == 0


def strongest(runs: np.ndarray) -> tuple[int, int, int] | None:
    """The run of most periods, exactly; ties to the smaller start, then the smaller period."""
    rows = map(tuple, runs.tolist())
    return max(rows, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)


RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_WORDS, times: int = LEAST_PERIODS) -> DataFrame:
    """Each row's id_col, runs (array of start, length, period, by start, then period), strongest (one of them) and collapsed (the text
    without the words that a run repeats, joined by one space).

    Words are what the six ASCII white-space characters part, told apart as they are written. A null text is an empty one, and a
    text without words or without runs has an empty array and null as strongest. Texts count whole, however long; rows of one id stay, a row each,
    with null ids too. Other columns are left out; an empty table gives an empty one.
    """
    if times < 2 or least < times:
        raise ValueError("times has to be 2 at least, and least no smaller than times")
    base = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    flat = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])

    def run(batches):
        for b in batches:
            every, best, texts = [], [], []
            for i in range(b.num_rows):
                words = b.column("text")[i].as_py().encode().split()
                runs = runs_of(named(words), least, times)
                every.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in runs.tolist()])
                top = strongest(runs)
                best.append(top and dict(zip(("start", "length", "period"), top, strict=True)))
                stay = kept_words(len(words), runs)
                texts.append(b" ".join(words if stay.all() else [words[k] for k in np.flatnonzero(stay)]).decode())
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(every, pa.list_(flat)), pa.array(best, flat), pa.array(texts, pa.string())], ["id", "runs", "strongest", "collapsed"])

    schema = T.StructType([T.StructField("id", base.schema["id"].dataType), T.StructField("runs", T.ArrayType(RUN)), T.StructField("strongest", RUN), T.StructField("collapsed", T.StringType())])
    return base.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def planted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, text_col) of docs, where a tenth of the texts, chosen by the id's hash, goes round in a period from some word on.

    With h = crc32 of the id, g = h / 10, n words: if h is a multiple of 10, each word i from a = g % n on is word a + (i - a) % p, with
    p = 1 + (n - a) / (3 + g % 8). Those texts' words are joined by one space; all others stay as they are, null ids and texts too.
    """
    words = F.filter(F.split(F.col(text_col), "[ \t-\r]+"), lambda w: w != "")
    marked = docs.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").alias(text_col)).withColumn("_h", F.crc32(F.col(id_col).cast("string").cast("binary")))

    def long(x: Column | str) -> Column:
        return F.floor(x).cast("long")

    chosen = marked.where("_h % 10 = 0").withColumn("_words", words).withColumn("_n", F.size("_words"))
    chosen = chosen.withColumn("_g", long(F.col("_h") / 10)).withColumn("_a", F.when(F.col("_n") > 0, F.col("_g") % F.col("_n")))
    chosen = chosen.withColumn("_p", 1 + long((F.col("_n") - F.col("_a")) / (3 + F.col("_g") % 8)))
    place = lambda i: F.when(i < F.col("_a"), i).otherwise(F.col("_a") + (i - F.col("_a")) % F.col("_p")).cast("int")
    around = F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda i: F.get("_words", place(i)))
    turned = F.when(F.col("_n") > 0, F.array_join(around, " ")).otherwise(F.col(text_col))
    rest = marked.where("_h IS NULL OR _h % 10 <> 0")
    return rest.select(id_col, text_col).unionByName(chosen.select(id_col, turned.alias(text_col)))


def digests(found: DataFrame) -> DataFrame:
    """What periodic_runs gives, with numbers and checksums in place of runs and texts; other columns stay in front."""
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n")
    text = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit(""))
    best = F.col("strongest")
    milli = F.expr("1000L * strongest.length div strongest.period")  # whole numbers, exact
    return found.select(
        *[F.col(f"`{c}`") for c in found.columns if c not in ("runs", "strongest", "collapsed")],
        F.size("runs").cast("long").alias("n_runs"),
        *[best[c].alias(c) for c in ("start", "length", "period")],
        milli.alias("exponent_milli"),
        *[F.sha2(c.cast("binary"), 256).alias(n) for c, n in ((text, "runs_sha256"), (F.col("collapsed"), "collapsed_sha256"))],
    )


__all__ = ["digests", "kept_words", "named", "periodic_runs", "planted", "runs_of", "strongest"]
