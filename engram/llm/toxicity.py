"""Toxicity by a counterfactual-regularised linear classifier.

A logistic model over the words of a text and their beginnings is fitted to a bounded sample of labelled rows. For every
sample row that names an identity group the text is read again with the term swapped for others of its kind, and the fit
pays for any change of score between the two readings, so that naming a group is no evidence by itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.llm.langid import bucket
from engram.llm.stages import materialize

#: Labelled rows that the model is fitted to at most, by the hash of doc_id; features it may use; rows a feature needs.
SAMPLE_ROWS = 20_000
MOST_FEATURES = 4096
LEAST_ROWS = 6
#: Weight of the squared weights, and of the squared change of the log odds under a swap.
RIDGE, FAIR = 1e-4, 1.0
STEPS = 400
#: Beginnings of words that are features beside the words themselves, in characters.
BEGINNINGS = (4, 5, 6, 7)
#: Words that a worker keeps the features of.
CACHE_WORDS = 400_000

#: Terms that name groups, by kind. A swap puts another term of the kind in its place.
IDENTITY_TERMS: dict[str, tuple[str, ...]] = {
    "religion": ("muslim", "christian", "jewish", "hindu", "buddhist", "catholic", "atheist", "musulman", "chrétien", "juif", "muslimisch", "christlich", "jüdisch", "musulmán", "cristiano", "judío"),
    "religions": ("muslims", "christians", "jews", "hindus", "buddhists", "catholics", "atheists", "musulmans", "chrétiens", "juifs", "muslime", "christen", "juden", "musulmanes", "cristianos", "judíos"),
    "gender": ("woman", "man", "girl", "boy", "femme", "homme", "frau", "mann", "mujer", "hombre"),
    "genders": ("women", "men", "girls", "boys", "femmes", "hommes", "frauen", "männer", "mujeres", "hombres"),
    "origin": ("african", "asian", "american", "european", "mexican", "arab", "turkish", "indian", "chinese", "french", "german", "spanish", "polish", "russian"),
    "color": ("black", "white", "brown", "noir", "blanc", "schwarz", "negro", "blanco"),
    "orientation": ("gay", "lesbian", "bisexual", "straight", "heterosexual", "homosexual", "transgender", "queer"),
    "status": ("immigrant", "refugee", "native", "foreigner", "citizen"),
    "ability": ("disabled", "blind", "deaf", "autistic"),
    "age": ("old", "young", "elderly", "teenage"),
}
_KIND = {term: (kind, i) for kind, terms in IDENTITY_TERMS.items() for i, term in enumerate(terms)}

_WORD = re.compile(r"[^\W\d_]+")


def features_of(word: str) -> list[int]:
    """Numbers of a word's features: the word, and its beginnings."""
    out = [crc32(b"w " + word.encode())]
    out += [crc32(b"b " + word[:n].encode()) for n in BEGINNINGS if len(word) > n - 1]
    return out


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


def swapped(words: set[str]) -> list[set[str]]:
    """The same words with every identity term replaced by the next of its kind, by the one after, and by none: else the
    terms of a kind could all weigh alike and still weigh."""
    named = [w for w in words if w in _KIND]
    out = [words - set(named)] if named else []
    for step in (1, 2) if named else ():
        other = {IDENTITY_TERMS[kind][(i + step) % len(IDENTITY_TERMS[kind])] for kind, i in map(_KIND.__getitem__, named)}
        out.append((words - set(named)) | other)
    return out


class Chosen:
    """The model's features of a set of words, with those of common words kept."""

    def __init__(self, numbers: dict[int, int]):
        self.numbers, self.known = numbers, {}

    def of(self, words: set[str]) -> list[int]:
        known, numbers, out = self.known, self.numbers, set()
        for word in words:
            own = known.get(word)
            if own is None:
                own = tuple(numbers[f] for f in features_of(word) if f in numbers)
                if len(known) < CACHE_WORDS:
                    known[word] = own
            if own:
                out.update(own)
        return sorted(out)


@dataclass
class Model:
    bias: float = 0.0
    numbers: dict[int, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))


def fit(rows: list[tuple[int, list[int], list[list[int]]]], size: int, ridge: float = RIDGE, fair: float = FAIR, steps: int = STEPS) -> tuple[float, np.ndarray]:
    """Bias and weights for rows of (label, features, features of each swapped reading), by accelerated gradient steps."""
    if not rows:
        return 0.0, np.zeros(size)
    y = np.array([r[0] for r in rows], float)
    row = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
    column = np.array([f for r in rows for f in r[1]], np.int64)
    pairs = [(set(r[1]), set(s)) for r in rows for s in r[2]]
    gained = [(i, f, 1.0) for i, (a, b) in enumerate(pairs) for f in b - a] + [(i, f, -1.0) for i, (a, b) in enumerate(pairs) for f in a - b]
    p_row, p_column, p_sign = (np.array([g[k] for g in gained], t) for k, t in ((0, np.int64), (1, np.int64), (2, float)))
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    weight = np.where(y == 1, np.sqrt((1 - share) / share), 1.0)  # the rarer label counts for more
    weight /= weight.sum()
    bias, w = float(np.log(share / (1 - share))), np.zeros(size)
    m, v, mb, vb = np.zeros(size), np.zeros(size), 0.0, 0.0
    for step in range(1, steps + 1):
        z = bias + np.bincount(row, w[column], minlength=len(rows))
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight
        g = np.bincount(column, error[row], minlength=size) + 2 * ridge * w
        if len(p_row):
            change = np.bincount(p_row, p_sign * w[p_column], minlength=len(pairs))
            g += 2 * fair * np.bincount(p_column, p_sign * change[p_row], minlength=size) / len(pairs)
        gb = error.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        rate = 0.05 / (1 + step / steps) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
        w -= rate * m / (np.sqrt(v) + 1e-8)
        bias -= rate * mb / (np.sqrt(vb) + 1e-8)
    return float(bias), w


def learn(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_ROWS, fair: float = FAIR) -> Model:
    """Fit the model to labelled rows of doc_id, text whose doc_id is not held out, `most` of them or about that. Of rows
    that share a doc_id the one whose text has the smallest hash is read."""
    held = bucket(F.col("doc_id"), 5) == 0
    known = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["toxic"].cast("int").alias("toxic")).filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = known.count()
    if n > most:
        known = known.filter(F.shiftrightunsigned(F.xxhash64("doc_id"), 11) < int(most / n * (1 << 53)))
    rows = docs.join(F.broadcast(known.withColumnRenamed("doc_id", "l_id")), F.col("doc_id") == F.col("l_id"))  # at most about `most` ids
    one = rows.groupBy("doc_id", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("one"))
    sample = materialize(one.select("toxic", "one.text"), "toxicity-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: dict[str, list[int]] = {}
        for batch in batches:
            seen: list[list[int]] = [[], []]
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = {f for w in words_of(text.as_py()) for f in (numbers.get(w) or numbers.setdefault(w, features_of(w)) if len(numbers) < CACHE_WORDS else features_of(w))}
                seen[toxic] += own
            (a, na), (b, nb) = (np.unique(np.array(s, np.int64), return_counts=True) for s in seen)
            keys = np.union1d(a, b)
            counts = np.zeros((2, len(keys)), np.int64)
            counts[0, np.searchsorted(keys, a)], counts[1, np.searchsorted(keys, b)] = na, nb
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts[0]), pa.array(counts[1])], names=["feature", "n0", "n1"])

    totals = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n0, n1 = totals.get(0, 0), totals.get(1, 0)
    counted = sample.mapInArrow(count, "feature long, n0 long, n1 long").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).filter(F.col("n0") + F.col("n1") >= LEAST_ROWS)
    # how far the share of toxic rows is from what chance explains
    expected = (F.col("n0") + F.col("n1")) * F.lit(n1 / max(1, n0 + n1))
    chosen = [r["feature"] for r in counted.orderBy(F.desc(F.abs(F.col("n1") - expected) / F.sqrt(expected + 1.0)), "feature").limit(MOST_FEATURES).collect()]
    named = {f for term in _KIND for f in features_of(term)}  # so that the swaps have something to act on
    numbers = {f: i for i, f in enumerate(dict.fromkeys([*chosen, *sorted(named)]))}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen = Chosen(numbers)
        for batch in batches:
            words = [words_of(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([chosen.of(w) for w in words], pa.list_(pa.int32())), pa.array([[chosen.of(s) for s in swapped(w)] for w in words], pa.list_(pa.list_(pa.int32())))],
                names=["toxic", "own", "swaps"],
            )

    rows = sample.mapInArrow(read, "toxic int, own array<int>, swaps array<array<int>>").collect()  # bounded by `most`
    bias, weights = fit(sorted((r["toxic"], r["own"], r["swaps"]) for r in rows), len(numbers), fair=fair)
    return Model(bias, numbers, weights)


def toxicity(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (1 if score >= 0.5) for every row of doc_id, text.

    The model is learned from labels of rows that are not held out, unless one is given. Null and empty texts score by
    the bias alone. Labels other than 0 and 1 are passed over; of several for one doc_id the higher counts. Without
    labels every score is 0.5. Repeated rows get the same score each; a null doc_id stays null and isn't held out. Features
    that say equally much are taken by their number; very long texts are read whole. Empty tables give empty tables; columns other than doc_id and text are never read.
    """
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    known = learn(docs, labels) if model is None else model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        live = np.abs(known.weights) > 1e-6
        chosen = Chosen({f: i for f, i in known.numbers.items() if live[i]})
        for batch in batches:
            z = np.array([known.bias + known.weights[chosen.of(words_of(t.as_py()))].sum() for t in batch.column(1)], float)
            score = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    held = F.coalesce(bucket(F.col("doc_id"), 5) == 0, F.lit(False))
    return docs.mapInArrow(run, "doc_id long, score double, predicted int").select("doc_id", held.alias("held_out"), "score", "predicted")
