"""Toxicity by a classifier chain of linear models over hashed words and word beginnings.

Categories are predicted one after another. The model of each is a logistic
regression on the presence of words and of their first 4, 5 and 6 bytes, plus
the log-odds of all earlier categories. Those inputs are out-of-fold predictions
while a later model is trained: each of ``FOLDS`` parts of the sample is
predicted by a model that has not seen it. When documents are scored, earlier
categories come from the models fitted on the whole sample.

The fit is one task over a bounded sample: at most ``SAMPLE`` labelled rows with and as many without
each category, chosen by a hash of the id over the whole table of labels. Only
features that at least ``MIN_DOCS`` training rows hold and whose rates differ by
``MIN_Z`` standard errors enter a model. Scoring reads whole texts, block by
block, and holds the selected features only.

Defined cases: a null or empty text has no features and gets the base rate; a null
label of a category leaves the row out of that category's model; a category
without both labels predicts its base rate (0 without labels); several labels of
an id count as several rows; repeated documents are scored row by row; an empty
table gives no rows; other columns pass through, one called like the result is
replaced.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import ALNUM, LOWER, _BYTE, add_column, bounded, bytes_of, mix, powers, word_bounds, words

#: Bound of the fit: labelled rows with and without each category. Folds, selection of features, penalty, steps.
SAMPLE, FOLDS, MIN_DOCS, MIN_Z, PENALTY, STEPS = 1500, 3, 4, 3.0, 1e-4, 200
#: Lengths of word beginnings in bytes, probability from which a document is rejected.
PREFIXES, REJECT = (4, 5, 6), 0.5


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text, 64-bit feature) of every word and word beginning, with repetitions."""
    data, bounds = bytes_of(texts)
    h, start, end = words(data, bounds, ALNUM, LOWER)
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(word_bounds(start, bounds)))
    found, where = [h], [owner]
    low, size = LOWER[data], end - start
    for k in PREFIXES:
        own = np.flatnonzero(size >= k)
        s, part = start[own], np.full(own.size, k, np.uint64)
        for j, p in enumerate(powers(k)):
            part += _BYTE[low[s + j]] * p
        found.append(mix(part * np.uint64(2 * k + 1)))
        where.append(owner[own])
    return np.concatenate(where), np.concatenate(found)


@dataclass
class Linear:
    """Bias, sorted features with weights, weights of the earlier categories' log-odds."""

    bias: float
    feature: np.ndarray
    weight: np.ndarray
    earlier: np.ndarray

    def score(self, rows: int, doc: np.ndarray, feature: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        """Log-odds; ``doc`` and ``feature`` may repeat pairs."""
        out = self.bias + earlier @ self.earlier
        if self.feature.size and feature.size:
            at = np.minimum(np.searchsorted(self.feature, feature), self.feature.size - 1)
            hit = self.feature[at] == feature
            pair = np.unique(doc[hit] * self.feature.size + at[hit])
            out = out + np.bincount(pair // self.feature.size, self.weight[pair % self.feature.size], minlength=rows)
        return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(rows: int, doc: np.ndarray, feature: np.ndarray, earlier: np.ndarray, y: np.ndarray, use: np.ndarray) -> Linear:
    """Logistic regression on the rows ``use``; pairs (doc, feature) are distinct."""
    n, pos = int(use.sum()), int(y[use].sum())
    none = np.zeros(0)
    if pos in (0, n):
        rate = pos / n if n else 0.0
        return Linear(float(np.log((rate + 1e-6) / (1 - rate + 1e-6))), none.astype(np.uint64), none, np.zeros(earlier.shape[1]))
    keep = use[doc]
    d, (names, f) = doc[keep], np.unique(feature[keep], return_inverse=True)
    have, with_y = np.bincount(f), np.bincount(f, y[d])
    rate = pos / n
    z = (with_y - have * rate) / np.sqrt(have * rate * (1 - rate))
    chosen = (have >= MIN_DOCS) & (np.abs(z) >= MIN_Z)
    place = np.cumsum(chosen) - 1
    own = chosen[f]
    d, f, names = d[own], place[f[own]], names[chosen]
    m = names.size
    w, b, e = np.zeros(m), np.log(rate / (1 - rate)), np.zeros(earlier.shape[1])
    # Adam on the whole sample: deterministic, no step size to tune per corpus.
    params = [w, np.array([b]), e]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for t in range(1, STEPS + 1):
        s = params[1][0] + earlier @ params[2] + np.bincount(d, params[0][f], minlength=rows)
        err = np.where(use, sigmoid(s) - y, 0) / n
        grads = [np.bincount(f, err[d], minlength=m) + PENALTY * params[0], np.array([err.sum()]), earlier.T @ err + PENALTY * params[2]]
        for p, g, a, v in zip(params, grads, first, second, strict=True):
            a += 0.1 * (g - a)
            v += 0.001 * (g * g - v)
            p -= 0.1 * (a / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Linear(float(params[1][0]), names, params[0], params[2])


def _distinct(doc: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((feature, doc))
    doc, feature = doc[order], feature[order]
    new = np.ones(doc.size, bool)
    new[1:] = (doc[1:] != doc[:-1]) | (feature[1:] != feature[:-1])
    return doc[new], feature[new]


def training_features(texts: pa.Array, step: int = 500) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, feature) pairs of features that at least ``MIN_DOCS`` texts hold."""
    docs, found = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for i in range(0, len(texts), step):
        d, f = _distinct(*features(texts.slice(i, step)))
        docs.append((d + i).astype(np.int32))
        found.append(f)
    doc, feature = np.concatenate(docs), np.concatenate(found)
    del docs, found
    order = np.argsort(feature, kind="stable")
    doc, feature = doc[order], feature[order]
    first = np.flatnonzero(np.concatenate(([True], feature[1:] != feature[:-1]))) if feature.size else np.zeros(0, np.int64)
    size = np.diff(np.append(first, feature.size))
    often = np.repeat(size >= MIN_DOCS, size)
    return doc[often], feature[often]


def fit_chain(texts: pa.Array, labels: np.ndarray, fold: np.ndarray) -> list[Linear]:
    """A model per category (column of ``labels``, nan: unknown) in chain order."""
    rows = len(texts)
    doc, feature = training_features(texts)
    earlier, models = np.zeros((rows, 0)), []
    for k in range(labels.shape[1]):
        y, known = np.nan_to_num(labels[:, k]), ~np.isnan(labels[:, k])
        models.append(fit(rows, doc, feature, earlier, y, known))
        if k + 1 < labels.shape[1]:
            out = np.zeros(rows)
            for i in range(FOLDS):
                part = fold == i
                m = fit(rows, doc, feature, earlier, y, known & ~part)
                out[part] = m.score(rows, doc, feature, earlier)[part]
            earlier = np.column_stack((earlier, np.clip(out, -8, 8)))
    return models


def sample_labels(labels: DataFrame, categories: dict[str, Column], key: str = "doc_id") -> DataFrame:
    """A bounded sample: per category the rows with and without it that have the smallest hashes."""
    rows = labels.filter(F.col(key).isNotNull()).select(F.col(key).alias("k"), *[c.cast("double").alias(f"y{i}") for i, c in enumerate(categories.values())])
    rows = rows.withColumn("h", F.xxhash64(F.col("k").cast("string"), F.lit("chain")))
    parts = [rows.filter(F.col(f"y{i}") == v).orderBy("h", "k").limit(SAMPLE) for i in range(len(categories)) for v in (0.0, 1.0)]
    return reduce(DataFrame.unionByName, parts).distinct()


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], key: str = "doc_id", text: str = "text") -> list[Linear]:
    few = sample_labels(labels, categories, key)  # at most 2 * SAMPLE rows a category: bounded, so it may be broadcast
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(few), "k").repartition(1).sortWithinPartitions("h", "k", "t")
    bounded(rows)
    n = len(categories)

    def run(batches):
        batches = list(batches)
        got = (pa.Table.from_batches(batches) if batches else schema.empty_table()).combine_chunks()
        y = np.column_stack([got[f"y{i}"].to_numpy(zero_copy_only=False) for i in range(n)]).astype(float)
        models = fit_chain(got["t"].combine_chunks() if got.num_rows else pa.array([], pa.string()), y, got["h"].to_numpy() % FOLDS)
        yield pa.RecordBatch.from_pydict({"models": pa.array([pickle.dumps(models)], pa.binary())})

    rows = rows.select("h", "t", *[f"y{i}" for i in range(n)])
    schema = pa.schema([("h", pa.int64()), ("t", pa.string()), *[(f"y{i}", pa.float64()) for i in range(n)]])
    found = rows.mapInArrow(run, "models binary").collect()
    return pickle.loads(found[0]["models"]) if found else fit_chain(pa.array([], pa.string()), np.zeros((0, n)), np.zeros(0))


def score(docs: DataFrame, models: list[Linear], name: str = "toxicity", text: str = "text") -> DataFrame:
    """``docs`` with an array column ``name``: the probability of each category in chain order."""
    box = docs.sparkSession.sparkContext.broadcast(models)
    known = np.unique(np.concatenate([m.feature for m in models]))
    gate = np.zeros(1 << 20, bool)
    gate[(known >> np.uint64(44)).astype(np.int64)] = True
    gates = docs.sparkSession.sparkContext.broadcast(np.packbits(gate))

    def run(batch: pa.RecordBatch) -> pa.Array:
        models, gate = box.value, np.unpackbits(gates.value).astype(bool)
        doc, feature = features(batch.column(batch.schema.get_field_index(text)))
        near = gate[(feature >> np.uint64(44)).astype(np.int64)]
        doc, feature = doc[near], feature[near]
        earlier = np.zeros((batch.num_rows, 0))
        for m in models:
            earlier = np.column_stack((earlier, np.clip(m.score(batch.num_rows, doc, feature, earlier), -8, 8)))
        return pa.array(list(sigmoid(earlier)), pa.list_(pa.float64()))

    return add_column(docs, name, "array<double>", text, run)


def categories_of(labels: DataFrame) -> dict[str, Column]:
    """The chain over the given labels: poor form first, then toxic."""
    return {"low_quality": 1 - labels["quality"], "toxic": labels["toxic"]}
