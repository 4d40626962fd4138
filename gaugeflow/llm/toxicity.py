"""Severity of toxic language by cumulative-link ordinal regression.

P(grade <= k) = sigmoid(threshold_k - w.x) with ordered thresholds and one weight vector for
all of them; x has log(1 + count) of each feature. The result is the expected grade.

Labels say toxic or not. Toxic documents of the training sample are split into grades 1 to
``GRADES`` by terciles of how often they have features; the others are grade 0. The
training sample is bounded: at most ``SAMPLE_ROWS`` labels, by a hash of their doc_id; of
equal texts one is taken. Features are words and runs of four bytes inside words that at
least ``LEAST_DOCS`` documents of the sample hold, toxic ones far more often than others (a z
score of ``LEAST_Z``); at most ``MOST_FEATURES``.

Null texts are empty and have severity as given by the thresholds alone. Labels without
doc_id or toxic are left out; a doc_id labelled both ways counts as toxic. Without labels of
both kinds, or without features, nothing is found toxic: severity 0. Rows are scored one
by one, so null or repeated doc_ids and further columns change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import ready, written
from .tokens import alphabet, word_and_gram_hashes

SAMPLE_ROWS, MOST_FEATURES, LEAST_Z, LEAST_DOCS = 20_000, 2048, 5.0, 5
GRADES, PENALTY, STEPS = 3, 1e-5, 1500


@dataclass(frozen=True)
class Model:
    """Sorted hashes of the features, their weights, the ordered thresholds."""

    features: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def at_least(self, scores: np.ndarray) -> np.ndarray:
        """Probability of each grade from 1 on, or a higher one."""
        if not len(self.thresholds):
            return np.zeros((len(scores), 1))
        return 1 / (1 + np.exp(self.thresholds[None, :] - scores[:, None]))


def feature_counts(
    features: np.ndarray, column: pa.Array, letters: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, how often) over a batch, and the words of each text."""
    words, pairs = np.zeros(len(column), np.int64), [np.empty(0, np.int64)]
    maybe = np.zeros(1 << 18, bool)
    maybe[features >> np.uint64(46)] = True
    for text, hashes, n in word_and_gram_hashes(column, letters):
        words += n
        if len(features):
            at = np.flatnonzero(maybe[hashes >> np.uint64(46)])
            place = np.minimum(np.searchsorted(features, hashes[at]), len(features) - 1)
            hit = features[place] == hashes[at]
            pairs.append(text[at[hit]] * len(features) + place[hit])
    found, times = np.unique(np.concatenate(pairs), return_counts=True)
    return found // max(len(features), 1), found % max(len(features), 1), times, words


def fit(
    row: np.ndarray, column: np.ndarray, value: np.ndarray, grade: np.ndarray, n_features: int
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of least penalised log loss, by Adam on all rows."""
    n, top = len(grade), int(grade.max(initial=0))
    share = np.array([(grade >= k).mean() for k in range(1, top + 1)]).clip(1e-3, 1 - 1e-3)
    first = np.log((1 - share) / share)
    gaps = np.log(np.maximum(np.diff(first), 1e-2))
    theta = np.concatenate([np.zeros(n_features), first[:1], gaps])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        w, t = theta[:n_features], theta[n_features:]
        limits = np.cumsum(np.concatenate([t[:1], np.exp(t[1:])]))
        z = np.bincount(row, w[column] * value, n)
        bounds = np.concatenate([[-np.inf], limits, [np.inf]])
        upper = 1 / (1 + np.exp(-np.clip(bounds[grade + 1] - z, -40, 40)))
        lower = 1 / (1 + np.exp(-np.clip(bounds[grade] - z, -40, 40)))
        upper[grade == top], lower[grade == 0] = 1.0, 0.0
        p = np.maximum(upper - lower, 1e-12)
        d_upper, d_lower = upper * (1 - upper) / p, lower * (1 - lower) / p
        g_z = (d_upper - d_lower) / n
        g_limits = (
            np.bincount(grade, d_lower, top + 1)[1:] - np.bincount(grade, d_upper, top + 1)[:top]
        ) / n
        # A threshold is the sum of the gaps up to it.
        g_t = np.cumsum(g_limits[::-1])[::-1]
        g_t[1:] *= np.exp(t[1:])
        g = np.concatenate([np.bincount(column, g_z[row] * value, n_features) + 2 * PENALTY * w, g_t])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return theta[:n_features], np.cumsum(np.concatenate([theta[n_features:][:1], np.exp(theta[n_features + 1 :])]))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on a bounded sample of labelled documents."""
    ready(docs.sparkSession)
    letters = alphabet(digits=False)
    # At most sample_rows rows of two numbers.
    chosen = (
        labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample_rows)
    )

    sample = written(
        docs.select("doc_id", "text")
        .join(F.broadcast(chosen), "doc_id")
        .groupBy("text")
        .agg(F.max("toxic").alias("toxic")),
        "toxicity-sample",
    )
    totals = sample.agg(F.count("*").alias("n"), F.sum("toxic").alias("bad")).first()
    n, bad = totals.n, totals.bad or 0
    none = Model(np.empty(0, np.uint64), np.empty(0), np.empty(0))
    if not 0 < bad < n:
        return none
    share = bad / n
    z = (F.col("bad") - F.col("n") * share) / F.sqrt(F.col("n") * share * (1 - share))

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Sums of the batch: a feature counts once for a text.
        for batch in batches:
            toxic = batch.column("toxic").to_numpy()
            found = [(t, h) for t, h, _ in word_and_gram_hashes(batch.column("text"), letters)]
            text, hashes = (np.concatenate(x) for x in zip(*found))
            order = np.lexsort((text, hashes))
            text, hashes = text[order], hashes[order]
            new = np.ones(len(text), bool)
            new[1:] = (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1])
            kinds, first = np.unique(hashes[new], return_index=True)
            n = np.add.reduceat(np.ones(int(new.sum()), np.int64), first) if len(first) else first
            hits = np.add.reduceat(toxic[text[new]].astype(np.int64), first) if len(first) else first
            yield pa.RecordBatch.from_arrays(
                [pa.array(kinds.view(np.int64)), pa.array(n), pa.array(hits)], ["feature", "n", "bad"]
            )

    chosen_features = (
        sample.mapInArrow(seen, "feature long, n long, bad long")
        .groupBy("feature")
        .agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
        .filter(F.col("n") >= LEAST_DOCS)
        .withColumn("z", z)
        .filter(F.col("z") >= LEAST_Z)
        .orderBy(F.desc("z"), "feature")
        .limit(MOST_FEATURES)
        .collect()
    )
    if not chosen_features:
        return none
    features = np.sort(np.array([r.feature for r in chosen_features], np.int64).view(np.uint64))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, column, times, words = feature_counts(features, batch.column("text"), letters)
            ends = np.searchsorted(text, np.arange(batch.num_rows + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (column, times)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("toxic"), pa.array(words), *lists], ["toxic", "words", "column", "times"]
            )

    # At most sample_rows rows, with a few features each; sorted, so that any run gives the same.
    rows = sorted(
        sample.mapInArrow(
            counted, "toxic int, words long, column array<long>, times array<long>"
        ).collect()
    )
    toxic = np.array([r.toxic for r in rows])
    often = np.array([sum(r.times) for r in rows])
    cuts = np.quantile(often[(toxic == 1) & (often > 0)], np.arange(1, GRADES) / GRADES)
    grade = np.where(toxic == 1, 1 + np.searchsorted(cuts, often, "left"), 0)
    # A grade that no document has is no grade.
    _, grade = np.unique(grade, return_inverse=True)
    row = np.repeat(np.arange(len(rows)), [len(r.column) for r in rows])
    column = np.array([c for r in rows for c in r.column], np.int64)
    times = np.array([t for r in rows for t in r.times], np.int64)
    weights, thresholds = fit(row, column, np.log1p(times), grade, len(features))
    return Model(features, weights, thresholds)


def _scores(model: Model, column: pa.Array, letters: np.ndarray) -> np.ndarray:
    row, feature, times, _ = feature_counts(model.features, column, letters)
    return model.at_least(np.bincount(row, model.weights[feature] * np.log1p(times), len(column)))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, expected severity, most probable grade, and whether grade 0 is the less likely."""
    ready(docs.sparkSession)
    letters = alphabet(digits=False)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at_least = _scores(model, batch.column("text"), letters)
            n = batch.num_rows
            reached = np.column_stack([np.ones(n), at_least, np.zeros(n)])
            grade = np.argmax(reached[:, :-1] - reached[:, 1:], axis=1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(np.round(at_least.sum(axis=1), 6)),
                    pa.array(grade.astype(np.int32)), pa.array(at_least[:, 0] > 0.5),
                ],
                ["doc_id", "severity", "grade", "toxic"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        score, f"doc_id {kind}, severity double, grade int, toxic boolean"
    )


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The documents, with all their columns, that are not found toxic."""
    ready(docs.sparkSession)
    letters = alphabet(digits=False)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_scores(model, batch.column("text"), letters)[:, 0] <= 0.5))

    return docs.mapInArrow(kept, docs.schema)
