"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text's letters are lower-cased, everything else is one space, and all runs of two to four characters
are hashed into buckets. Each bucket has an embedding; their mean goes through a linear layer and a
softmax. Embeddings and layer are trained by stochastic gradient descent in numpy, on whole short texts and
on snippets of a few words. A temperature and a rejection threshold are fitted on a part of the
sample that training does not see. As mean and layer are both linear, each bucket's
contribution to the scores is one row of a small table, which is all that tasks get.

The sample: of each of the ``SAMPLE_LANGS`` most frequent languages the ``SAMPLE_DOCS`` documents (fewer of each, if that is
more than ``SAMPLE_ALL`` together) of at most ``SAMPLE_CHARS`` characters
whose id has the least hash, from those that may be learned from. Prediction reads whole texts.

Defined results: null text, or one without letters, is "und" with score 0; if nothing may be
learned from, all are; repeated rows are judged alike; an empty table gives an empty result; other
columns are passed on as they are, but one named like the output, which is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

SAMPLE_DOCS = 1000
#: Languages that are learned at most, and documents of all of them together.
SAMPLE_LANGS, SAMPLE_ALL = 256, 16_000
SAMPLE_CHARS = 4000
BUCKETS = 1 << 16
DIMENSIONS = 16
ORDERS = (2, 3, 4)
EPOCHS = 4
RATE = 0.5
SNIPPET_WORDS = 6
#: Grams of one example that a training step looks at.
STEP_GRAMS = 600
#: Of predictions above the rejection threshold so many are right, on the calibration part.
ACCEPTED_RIGHT = 0.99
CHUNK = 1 << 20
PRIMES = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def characters(text: str | None) -> np.ndarray:
    """Code points: lower-cased letters, with single spaces between and around; empty without letters."""
    if not text:
        return np.zeros(0, np.uint32)
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")
    letter = _letters()[points]
    if not letter.any():
        return np.zeros(0, np.uint32)
    points = np.concatenate([[32], np.where(letter, points, 32), [32]]).astype(np.uint32)
    keep = np.ones(len(points), bool)
    keep[1:] = (points[1:] != 32) | (points[:-1] != 32)
    return points[keep]


def grams(points: np.ndarray) -> Iterator[np.ndarray]:
    """Buckets of all runs, a bounded part at a time."""
    for order in ORDERS:
        for a in range(0, max(0, len(points) - order + 1), CHUNK):
            part = points[a : a + CHUNK + order - 1]
            n = len(part) - order + 1
            h = np.full(n, order, np.uint32)
            for k in range(order):
                h = (h ^ part[k : k + n]) * PRIMES[k]
            h ^= h >> np.uint32(15)
            yield h & np.uint32(BUCKETS - 1)


@dataclass
class Model:
    labels: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        points = characters(text)
        if not len(points) or not self.labels:
            return "und", 0.0, False
        total, n = np.zeros(len(self.labels)), 0
        for g in grams(points):
            counts = self.table[g]
            total += counts.sum(axis=0, dtype=np.float64)
            n += len(g)
        p = softmax((total / max(1, n) + self.bias) / self.temperature)
        k = int(p.argmax())
        return self.labels[k], float(p[k]), bool(p[k] >= self.threshold)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(texts: list[str], labels: list[str], seed: int = 7) -> Model:
    names = sorted(set(labels))
    rng = np.random.default_rng(seed)
    examples = []
    for text, label in zip(texts, labels, strict=True):
        ws = text.split()
        at = int(rng.integers(0, max(1, len(ws) - SNIPPET_WORDS)))
        for t in (text, " ".join(ws[at : at + SNIPPET_WORDS])):
            points = characters(t)
            if len(points):
                examples.append((np.concatenate(list(grams(points))), names.index(label)))
    if not examples:
        return Model([], np.zeros((1, 0), np.float32), np.zeros(0), 1.0, 1.0)
    order = rng.permutation(len(examples))
    cut = len(order) // 5
    held, learned = order[:cut], order[cut:]
    vectors = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
    layer, bias = np.zeros((DIMENSIONS, len(names)), np.float32), np.zeros(len(names), np.float32)
    steps, done = EPOCHS * len(learned), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(learned):
            g, y = examples[i]
            g = g if len(g) <= STEP_GRAMS else g[rng.integers(0, len(g), STEP_GRAMS)]
            mean = vectors[g].mean(axis=0)
            error = softmax(mean @ layer + bias)
            error[y] -= 1
            rate = np.float32(RATE * (1 - done / steps))
            back = layer @ error
            layer -= rate * np.outer(mean, error)
            bias -= rate * error
            np.subtract.at(vectors, g, rate * back / np.float32(len(g)) * np.float32(20))
            done += 1
    table = (vectors @ layer).astype(np.float32)
    check = held if len(held) else learned
    scores = np.array([table[examples[i][0]].mean(axis=0) + bias for i in check], np.float64)
    truth = np.array([examples[i][1] for i in check])
    loss = lambda t: -np.log(softmax(scores / t)[np.arange(len(truth)), truth] + 1e-12).mean()
    temperature = float(min(np.geomspace(0.05, 10, 60), key=loss))
    p = softmax(scores / temperature)
    best, right = p.max(axis=1), p.argmax(axis=1) == truth
    down = np.argsort(-best, kind="stable")
    share = np.cumsum(right[down]) / np.arange(1, len(down) + 1)
    good = np.flatnonzero(share >= ACCEPTED_RIGHT)
    threshold = float(best[down[good[-1]]]) if len(good) else 1.0
    return Model(names, table, bias.astype(np.float64), temperature, threshold)


def held_out(key: Column) -> Column:
    return F.crc32(key.cast("string")) % 5 == 0


def learn(docs: DataFrame, may_learn: Column, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS, sample_langs: int = SAMPLE_LANGS, sample_all: int = SAMPLE_ALL) -> Model:
    """A model from the bounded sample of the rows (doc_id, text, lang) that may be learned from: of the most frequent
    languages (ties by name) equally many documents, if they have so many."""
    rows = docs.filter(may_learn & F.col("lang").isNotNull() & (F.length("text") <= sample_chars))
    known = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(sample_langs).collect()
    if not known:
        return train([], [])
    sample_docs = min(sample_docs, max(1, sample_all // len(known)))
    counts = docs.sparkSession.createDataFrame([tuple(r) for r in known], "lang string, count long")
    # hashes far above a language's n-th go first, so that no task gets more than a few times n of them
    h = F.xxhash64("doc_id")
    share = F.least(F.lit(1.0), F.lit(4.0 * sample_docs) / F.col("count"))
    most = counts.select("lang", (share * 2.0**64 - 2.0**63).alias("most"))  # ``sample_langs`` rows at most
    near = rows.join(F.broadcast(most), "lang").filter(h.cast("double") <= F.col("most"))
    order = Window.partitionBy("lang").orderBy(h, "doc_id", F.xxhash64("text"))
    rows = near.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= sample_docs)
    got = sorted((r.lang, r.n, r.text) for r in rows.select("lang", "n", "text").collect())
    return train([t for _, _, t in got], [lang for lang, _, _ in got])


PREDICTED = "lang string, score double, accepted boolean"


def with_language(docs: DataFrame, model: Model, text: str = "text", out: str = "language") -> DataFrame:
    """The rows with a struct of lang, score and accepted (score above the rejection threshold)."""
    given = docs.sparkSession.sparkContext.broadcast(model)

    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([given.value.predict(t) for t in texts], columns=["lang", "score", "accepted"])

    return docs.withColumn(out, F.pandas_udf(predicted, PREDICTED)(F.col(text)))


def language_report(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """doc_id, held_out, lang_pred, score, accepted of every row; the model sees none that is held out."""
    rows = docs.select(F.col(key).alias("doc_id"), "text", "lang")
    model = learn(rows, F.coalesce(~held_out(F.col("doc_id")), F.lit(False)))
    out = with_language(rows.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), F.col("language.lang").alias("lang_pred"), "language.score", "language.accepted")
