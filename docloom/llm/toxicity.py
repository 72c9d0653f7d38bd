"""Toxicity by maximum-scoring segments of token log-odds.

Tokens score by their log-odds between toxic and other labelled texts, with a
Dirichlet prior from the whole corpus; what is not significant scores slightly
below zero. A linear scan finds all maximal segments of a text. Segment scores of
texts that are not toxic follow an extreme-value law, whose parameters give each
segment an expected number of as good ones by chance (its E-value); the
significant segments of a document add up, and a logistic fit turns the sum into
a probability.
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

# Buckets of hashed words and of hashed word beginnings (of so many letters), numbered in one sequence.
WORD_BUCKETS, STEM_BUCKETS, STEM = 1 << 17, 1 << 16, 5
BUCKETS = WORD_BUCKETS + STEM_BUCKETS
# Weight of the prior in tokens; standard errors taken off a log-odds; a neutral token scores this at most.
PRIOR, ERRORS, DRIFT = 20_000.0, 3.0, -0.01
# A word met less often than this in the labelled texts scores by its beginning, which inflected forms share.
KNOWN = 30
# A segment of a larger E-value is no passage.
SIGNIFICANT = 0.05
THRESHOLD = 0.5
_EDGE = re.compile(r"^\W+|\W+$")


def _number(token: str) -> int:
    """The buckets of the token's word and of its beginning, as one number."""
    word = _EDGE.sub("", token).lower() or token
    return bucket(word, WORD_BUCKETS) * STEM_BUCKETS + bucket(word[:STEM], STEM_BUCKETS)


def _both(ids: np.ndarray) -> np.ndarray:
    """Counts of all buckets, those of beginnings after those of words."""
    return np.concatenate(
        (np.bincount(ids // STEM_BUCKETS, minlength=WORD_BUCKETS), np.bincount(ids % STEM_BUCKETS, minlength=STEM_BUCKETS))
    )


def token_counts(texts: DataFrame, by: str | None = None) -> DataFrame:
    """Counts `n` per `bucket` (and per value of the int column `by`): each task sends one row per bucket that it met."""
    source = texts.select(F.coalesce(name("text"), F.lit("")).alias("text"), (name(by) if by else F.lit(0)).cast("int").alias("of"))

    def run(batches):
        words, totals = Words(_number), {}
        for batch in batches:
            for piece in pieces(batch, 0):
                of = np.asarray(piece.column(1))
                ids = [words.ids(t) for t in piece.column(0).to_pylist()]
                for value in np.unique(of).tolist():
                    here = np.concatenate([i for i, v in zip(ids, of) if v == value])
                    totals[value] = totals.get(value, 0) + _both(here)
        for value, counts in totals.items():
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(used), value), pa.int32()), pa.array(used, pa.int32()), pa.array(counts[used], pa.int64())],
                names=["of", "bucket", "n"],
            )

    return source.mapInArrow(run, "of int, bucket int, n long").groupBy("of", "bucket").agg(F.sum("n").alias("n"))


def _dense(counts: DataFrame, of: int) -> np.ndarray:
    found = counts.filter(F.col("of") == of).select("bucket", "n").toArrow()  # BUCKETS rows at most
    out = np.zeros(BUCKETS)
    out[np.asarray(found.column("bucket"))] = np.asarray(found.column("n"))
    return out


class Scores(NamedTuple):
    """Scores of words and of word beginnings, and which words are known well enough."""

    words: np.ndarray
    stems: np.ndarray
    known: np.ndarray

    def of(self, ids: np.ndarray) -> np.ndarray:
        word = ids // STEM_BUCKETS
        return np.where(self.known[word], self.words[word], self.stems[ids % STEM_BUCKETS])


def _sure_log_odds(toxic: np.ndarray, other: np.ndarray, corpus: np.ndarray) -> np.ndarray:
    """Log-odds with a prior in proportion to the corpus, less `ERRORS` standard errors (towards zero)."""
    prior = PRIOR * (corpus + 0.1) / (corpus + 0.1).sum()

    def log_odds(n):
        return np.log((n + prior) / (n.sum() + PRIOR - n - prior))

    delta = log_odds(toxic) - log_odds(other)
    error = np.sqrt(1 / (toxic + prior) + 1 / (other + prior))
    return np.clip(np.sign(delta) * np.maximum(np.abs(delta) - ERRORS * error, 0), -4, 8)


def token_scores(toxic: np.ndarray, other: np.ndarray, corpus: np.ndarray) -> Scores:
    """Significant log-odds; all other tokens score by how much rarer such are in toxic texts, `DRIFT` at most."""
    cut_ = WORD_BUCKETS
    words = _sure_log_odds(toxic[:cut_], other[:cut_], corpus[:cut_])
    stems = _sure_log_odds(toxic[cut_:], other[cut_:], corpus[cut_:])
    share = [float(n[cut_:][stems > 0].sum() / max(n[cut_:].sum(), 1)) for n in (toxic, other)]
    drift = min(float(np.log((1 - share[0] + 1e-9) / (1 - share[1] + 1e-9))), DRIFT)
    return Scores(words + drift, stems + drift, (toxic + other)[:cut_] >= KNOWN)


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a sequence, in one pass.

    A list of candidates is kept with the running totals before and after each. A
    new positive score joins the last candidate that began at a lower total, if
    none in between ended at a higher one.
    """
    total = np.concatenate(([0.0], np.cumsum(scores)))
    kept: list[list] = []  # start, end, total before, total after, the candidate before with a lower total before
    for i in np.flatnonzero(scores > 0).tolist():
        new = [i, i + 1, total[i], total[i + 1], -1]
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= new[2]:
                j = kept[j][4]
            if j < 0 or kept[j][3] >= new[3]:
                new[4] = j
                kept.append(new)
                break
            new[0], new[2] = kept[j][0], kept[j][2]
            del kept[j:]
    return [(a, b, after - before) for a, b, before, after, _ in kept]


class Model(NamedTuple):
    scores: Scores
    rate: float  # lambda of the extreme-value law
    factor: float  # its K
    weights: np.ndarray  # of the bits of all passages, of the best one, and a constant

    def passages(self, ids: np.ndarray) -> list[tuple[int, int, float, float]]:
        """Significant segments: tokens from, to, score and E-value."""
        found = []
        for a, b, s in segments(self.scores.of(ids)):
            expected = self.factor * len(ids) * np.exp(-self.rate * s)
            if expected < SIGNIFICANT:
                found.append((a, b, float(s), float(expected)))
        return found

    def evidence(self, ids: np.ndarray) -> tuple[float, float]:
        """Log-odds against chance, of all significant segments and of the best."""
        surprise = [min(-np.log(max(e, 1e-300)), 60.0) for _, _, _, e in self.passages(ids)]
        return np.log1p(sum(surprise)), np.log1p(max(surprise, default=0.0))

    def probability(self, ids: np.ndarray) -> float:
        x = float(np.clip(np.dot(self.weights, (*self.evidence(ids), 1.0)), -30, 30))
        return 1 / (1 + np.exp(-x))


def fit_law(best: np.ndarray, lengths: np.ndarray, values: np.ndarray, times: np.ndarray) -> tuple[float, float]:
    """Lambda solves sum p(s) exp(lambda s) = 1 over token scores (`values`, met so many `times`) of texts that are
    not toxic; K makes the best segments of those texts likeliest."""
    share = (times + 1e-6) / (times + 1e-6).sum()
    low, high = 1e-3, 8.0
    for _ in range(60):
        rate = (low + high) / 2
        if share @ np.exp(rate * values) > 1:
            high = rate
        else:
            low = rate
    chance = (lengths * np.exp(-low * best)).sum()
    return low, max(float(len(best) / chance), 1e-6) if chance > 0 else 1.0


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights by Newton's method, lightly held towards zero."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(len(w))
        w = w - np.linalg.solve(hessian, x.T @ (p - y) + 0.05 * w)
    return w


def _best(texts: DataFrame, scores: Scores) -> list:
    """Per text: label, number of tokens and best segment."""

    def setup():
        words = Words(_number)

        def work(values):
            ids = [words.ids(v) for v in values]
            best = [max((s for _, _, s in segments(scores.of(i))), default=0.0) for i in ids]
            return [pa.array([len(i) for i in ids], pa.int64()), pa.array(best, pa.float64())]

        return work

    fields = [T.StructField("n", T.LongType()), T.StructField("best", T.DoubleType())]
    return map_texts(texts, "text", fields, setup, ["label"]).collect()


def _evidence(texts: DataFrame, model: Model) -> list:
    def setup():
        words = Words(_number)

        def work(values):
            found = [model.evidence(words.ids(v)) for v in values]
            return [pa.array([f[k] for f in found], pa.float64()) for k in (0, 1)]

        return work

    fields = [T.StructField("all", T.DoubleType()), T.StructField("most", T.DoubleType())]
    return map_texts(texts, "text", fields, setup, ["label"]).collect()


def fit(docs: DataFrame, labels: DataFrame, allowed: Column, id_column: str = "doc_id", text: str = "text", label: str = "toxic", bound: int = SAMPLE_ROWS) -> Model:
    """Fit on at most `bound` labelled rows that are `allowed`; the prior counts the words of all `docs`.

    Without labels of both values all texts score the same: the share of 1, or a half without any labels.
    """
    corpus = _dense(token_counts(docs.select(name(text).cast("string").alias("text"))), 0)
    sample = labelled_texts(docs, labels, id_column, text, label, allowed, bound)
    counts = token_counts(sample, "label")
    toxic, other = _dense(counts, 1), _dense(counts, 0)
    scores = token_scores(toxic, other, corpus)
    rows = _best(sample, scores)  # at most `bound` rows, but for repeated ids
    y = np.array([r.label for r in rows], float)
    if len(set(y.tolist())) < 2:
        share = float(y.mean()) if len(y) else 0.5
        return Model(scores, 1.0, 1.0, np.array([0.0, 0.0, np.log((share + 1e-3) / (1 - share + 1e-3))]))
    calm = [r for r in rows if r.label == 0]
    stems = slice(WORD_BUCKETS, None)
    rate, factor = fit_law(
        np.array([r.best for r in calm]), np.array([max(r.n, 1) for r in calm]), scores.stems, other[stems]
    )
    model = Model(scores, rate, factor, np.zeros(3))
    found = _evidence(sample, model)
    x = np.array([[r["all"], r["most"], 1.0] for r in found])
    return model._replace(weights=_logistic(x, np.array([r.label for r in found], float)))


def score(docs: DataFrame, model: Model, text: str = "text", column: str = "score", passages: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """Add `column`, the probability that the whole text is toxic; with `passages`, also where.

    A passage has `start` and `end` (code points), its score and its E-value. Null and
    empty texts have no passages. Rows are independent of each other; repeated rows
    score alike; an empty table stays empty; columns of these names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("e_value", T.DoubleType())]))
    arrow = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("e_value", pa.float64())]))

    def setup():
        model, words = shared.value, Words(_number)

        def where(value, ids):
            found = model.passages(ids)
            spans = list(_token_spans(value)) if found else []
            return [{"start": spans[a][0], "end": spans[b - 1][1], "score": s, "e_value": e} for a, b, s, e in found]

        def work(values):
            ids = [words.ids(v) for v in values]
            made = [pa.array([float(model.probability(i)) for i in ids], pa.float64())]
            return made + [pa.array([where(v, i) for v, i in zip(values, ids)], arrow)] * bool(passages)

        return work

    fields = [T.StructField(column, T.DoubleType())] + ([T.StructField(passages, kind)] if passages else [])
    return map_texts(docs, text, fields, setup, keep)


def _token_spans(text: str):
    at = 0
    for token in text.split():
        at = text.index(token, at)
        yield at, at + len(token)
        at += len(token)
