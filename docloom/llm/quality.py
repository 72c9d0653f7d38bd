"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Every word has a sparse random index vector; its context vector is the sum of the
index vectors of the words next to it, over the whole corpus. Words share a fixed
number of hashed buckets, so what is gathered is of fixed size. The shape of a
token (its case, digits and signs) has a random vector of its own. A document is
the weighted mean of its words' vectors, the mean of its shapes' vectors, and a
few measures of length and repetition. A two-layer numpy network is fitted on a
bounded labelled sample; a temperature fitted on a part kept apart calibrates it.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.batches import map_texts, name, pieces
from docloom.llm.labels import SAMPLE_ROWS, Words, bucket, labelled_texts

# Buckets of words and shapes, length of vectors, non-zero places of an index vector, words next to a word.
WORD_BUCKETS, SHAPE_BUCKETS, DIM, PLACES, NEAR = 1 << 13, 1 << 12, 32, 2, 2
HIDDEN, EPOCHS, RATE, DECAY = 32, 60, 0.01, 1e-4
THRESHOLD = 0.7
# Tokens whose vectors are gathered at a time.
_STEP = 65_536
_RUNS = re.compile(r"(.)\1+", re.S)


class _Kinds(dict):
    def __missing__(self, point: int) -> str:
        c = chr(point)
        self[point] = kind = "A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c
        return kind


def _number():
    kinds = _Kinds()

    def number(token: str) -> int:
        shape = _RUNS.sub(r"\1", token.translate(kinds))[:8]
        return bucket(token.lower(), WORD_BUCKETS) * SHAPE_BUCKETS + bucket(shape, SHAPE_BUCKETS)

    return number


def _index() -> tuple[np.ndarray, np.ndarray]:
    """Per word bucket, the places and signs of its index vector."""
    rng = np.random.default_rng(1)
    return rng.integers(0, DIM, (PLACES, WORD_BUCKETS)), rng.choice([-1.0, 1.0], (PLACES, WORD_BUCKETS))


def context_counts(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Context vectors and counts of all word buckets, over all rows.

    Each task adds up its own matrix; one row per bucket and task is shuffled, and
    the sums, of fixed size, come to the driver. Sums are of whole numbers, so they
    do not depend on the order.
    """
    columns = [f"v{i}" for i in range(DIM)] + ["n"]
    schema = "bucket int, " + ", ".join(f"{c} double" for c in columns)

    def run(batches):
        words = Words(_number())
        places, signs = _index()
        total = np.zeros(WORD_BUCKETS * DIM)
        seen = np.zeros(WORD_BUCKETS, np.int64)
        for batch in batches:
            for piece in pieces(batch, 0):
                texts = [words.ids(t) // SHAPE_BUCKETS for t in piece.column(0).to_pylist()]
                ids = np.concatenate(texts)
                doc = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
                seen += np.bincount(ids, minlength=WORD_BUCKETS)
                for step in range(1, NEAR + 1):
                    same = doc[step:] == doc[:-step]
                    left, right = ids[:-step][same], ids[step:][same]
                    for a, b in ((left, right), (right, left)):
                        for k in range(PLACES):
                            total += np.bincount(a * DIM + places[k][b], signs[k][b], WORD_BUCKETS * DIM)
        used = np.flatnonzero(seen)
        rows = total.reshape(WORD_BUCKETS, DIM)[used]
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int32()), *(pa.array(rows[:, i].copy()) for i in range(DIM)), pa.array(seen[used].astype(float))],
            names=["bucket", *columns],
        )

    parts = docs.select(F.coalesce(name(text).cast("string"), F.lit("")).alias("text")).mapInArrow(run, schema)
    found = parts.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in columns]).toArrow()  # WORD_BUCKETS rows at most
    context, seen = np.zeros((WORD_BUCKETS, DIM)), np.zeros(WORD_BUCKETS)
    at = np.asarray(found.column("bucket"))
    for i, c in enumerate(columns):
        (seen if c == "n" else context[:, i])[at] = np.asarray(found.column(c))
    return context, seen


def word_vectors(context: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Context vectors of length one, less their mean, and weighted so that frequent words count less."""
    unit = context / np.maximum(np.linalg.norm(context, axis=1, keepdims=True), 1e-9)
    share = seen / max(seen.sum(), 1)
    unit -= share @ unit
    return (unit * (1e-3 / (1e-3 + share))[:, None]).astype(np.float32)


def shape_vectors() -> np.ndarray:
    return np.random.default_rng(2).choice([-1.0, 1.0], (SHAPE_BUCKETS, DIM)).astype(np.float32)


def _sums(vectors: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return sum((vectors[ids[a : a + _STEP]].sum(0) for a in range(0, len(ids), _STEP)), np.zeros(DIM))


class Features:
    """Texts to rows of numbers."""

    def __init__(self, vectors: np.ndarray):
        self.words, self.vectors, self.shapes = Words(_number()), vectors, shape_vectors()

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), 2 * DIM + 4), np.float32)
        for row, text in zip(out, texts):
            ids = self.words.ids(text)
            n = len(ids)
            if n:
                word = ids // SHAPE_BUCKETS
                row[:DIM] = _sums(self.vectors, word) / n
                row[DIM : 2 * DIM] = _sums(self.shapes, ids % SHAPE_BUCKETS) / n
                row[2 * DIM :] = np.log1p(n), len(np.unique(ids)) / n, len(text) / n, text.count("\n") / n
        return out


class Network(NamedTuple):
    """What scoring needs: the word vectors, the features' scale, two layers and a temperature."""

    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    temperature: float

    def probability(self, features: np.ndarray) -> np.ndarray:
        z = np.clip((features - self.mean) / self.scale, -6, 6)
        return 1 / (1 + np.exp(-_logits(z, self.layers) / self.temperature))


def _logits(z: np.ndarray, layers: list[np.ndarray]) -> np.ndarray:
    w1, b1, w2, b2 = layers
    return np.clip(np.tanh(z @ w1 + b1) @ w2 + b2, -30, 30)


def train(z: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Two layers by Adam on the logistic loss, in batches of 256."""
    rng = np.random.default_rng(3)
    layers = [rng.normal(0, z.shape[1] ** -0.5, (z.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    first, second = [np.zeros_like(p) for p in layers], [np.zeros_like(p) for p in layers]
    t = 0
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        order = rng.permutation(len(z))
        for a in range(0, len(z), 256):
            x, target = z[order[a : a + 256]], y[order[a : a + 256]]
            w1, b1, w2, b2 = layers
            h = np.tanh(x @ w1 + b1)
            error = (1 / (1 + np.exp(-np.clip(h @ w2 + b2, -30, 30))) - target) / len(x)
            back = np.outer(error, w2) * (1 - h * h)
            grads = [x.T @ back + DECAY * w1, back.sum(0), h.T @ error + DECAY * w2, error.sum(keepdims=True)]
            t += 1
            for i, g in enumerate(grads):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                layers[i] = layers[i] - rate * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-8)
    return layers


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least logistic loss, between 1/4 and 8."""
    if not len(y):
        return 1.0
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
    loss = [np.mean(np.logaddexp(0, -(2 * y - 1) * logits / t)) for t in grid]
    return float(grid[int(np.argmin(loss))])


def fit(docs: DataFrame, labels: DataFrame, allowed: Column, id_column: str = "doc_id", text: str = "text", label: str = "quality", bound: int = SAMPLE_ROWS) -> Network:
    """A network for P(label is 1). Word vectors come from all `docs`, labels from at most `bound` rows that are `allowed`.

    Without labels of both values the network gives the same probability for all:
    the share of 1, or a half without any labels.
    """
    vectors = word_vectors(*context_counts(docs, text))
    sample = labelled_texts(docs, labels, id_column, text, label, allowed, bound)
    made = map_texts(sample, "text", [T.StructField("features", T.BinaryType())], lambda: _packed(vectors), ["id", "label"])
    rows = sorted(made.select("id", "label", "features").collect(), key=lambda r: (r.id, r.features))  # at most `bound` rows, but for repeated ids
    width = 2 * DIM + 4
    x = np.array([np.frombuffer(r.features, np.float32) for r in rows], np.float64).reshape(-1, width)
    y = np.array([r.label for r in rows], float)
    if len(set(y.tolist())) < 2:
        share = float(y.mean()) if len(y) else 0.5
        bias = np.log((share + 1e-3) / (1 - share + 1e-3))
        return Network(vectors, np.zeros(width), np.ones(width), [np.zeros((width, 1)), np.zeros(1), np.zeros(1), np.array([bias])], 1.0)
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = np.clip((x - mean) / scale, -6, 6)
    apart = np.random.default_rng(4).random(len(y)) < 0.2
    if len(set(y[~apart].tolist())) < 2:
        apart[:] = False
    layers = train(z[~apart], y[~apart])
    return Network(vectors, mean, scale, layers, fit_temperature(_logits(z[apart], layers), y[apart]))


def _packed(vectors):
    features = Features(vectors)
    return lambda texts: [pa.array([row.tobytes() for row in features(texts)], pa.binary())]


def score(docs: DataFrame, network: Network, text: str = "text", column: str = "score", keep: list[str] | None = None) -> DataFrame:
    """Add `column`, the calibrated probability of label 1, from the whole text alone.

    Null and empty texts score as a text without words. Rows are independent of
    each other; repeated rows score alike; an empty table stays empty; a column of
    that name is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def setup():
        network = shared.value
        features = Features(network.vectors)
        return lambda texts: [pa.array(network.probability(features(texts).astype(np.float64)))]

    return map_texts(docs, text, [T.StructField(column, T.DoubleType())], setup, keep)
