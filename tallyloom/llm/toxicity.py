"""Toxicity by cumulative-link ordinal regression on word features.

A text's features are the distinct words it holds (A-Z lower-cased). With one weight vector w and ordered
thresholds, P(grade <= k) = sigmoid(threshold_k - w.x); the expected severity is the sum over k of P(grade > k),
0 to 3. A document is rejected if its expected severity reaches the model's cut.

The labels table only says toxic or not. Grades are derived: 0 for clean; toxic documents get 1, 2 or 3 by the
terciles of the share of their words that are far more common in toxic documents.

Fitting uses PER_CLASS documents at most of each label, those with the smallest hash of their id. Word selection
is a distributed count over that sample; the driver sees at most FEATURES words and the sample's rows of them.
Four fifths of the sample fit the weights, the rest sets the cut: a quarter of the way from the score that the clean
documents stay below with PRECISION to the tenth percentile of toxic documents above it.

Nulls: a NULL text has no words; a NULL doc_id is scored and reported as such, and never used to fit. Labels that
are NULL are ignored; of several labels of a document the largest counts. Repeated rows give a row each. Without
labels of both kinds nothing is rejected. Other columns pass through `clean` untouched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm import bytescan
from tallyloom.llm.common import Workspace

PER_CLASS, FEATURES, GRADES = 3000, 1500, 4
PRECISION = 0.998
STEPS, LEARNING_RATE, PENALTY = 400, 0.05, 2e-3

_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def word_sets(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Per slice: first row, and for each distinct (row, word) the row, the word's hash and its count."""
    for at, _, raw, offsets in bytescan.slices(texts):
        data = _LOWER[raw]
        starts, ends, before = bytescan.words(data, offsets, _WORD)
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(before))
        hashes = bytescan.span_hashes(data, starts, ends)
        order = np.lexsort((hashes, row))
        row, hashes = row[order], hashes[order]
        first = np.ones(len(row), bool)
        first[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
        places = np.flatnonzero(first)
        yield at, row[places], hashes[places].view(np.int64), np.diff(np.append(places, len(row)))


class Model:
    """Sorted word hashes, a weight for each, ordered thresholds, and the cut on expected severity."""

    def __init__(self, words: np.ndarray, weights: np.ndarray, thresholds: np.ndarray, cut: float):
        self.words, self.weights, self.thresholds, self.cut = words, weights, thresholds, cut

    def severity(self, signal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected severity and most likely grade."""
        upto = 1 / (1 + np.exp(np.clip(signal[:, None] - self.thresholds[None, :], -500, 500)))
        edges = np.concatenate([np.zeros((len(signal), 1)), upto, np.ones((len(signal), 1))], 1)
        return (1 - upto).sum(1), np.diff(edges, axis=1).argmax(1)

    def signals(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """w.x and the number of known words, for every row of a batch."""
        signal, known = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        if not len(self.words):
            return signal, known
        for at, row, words, _ in word_sets(texts):
            place = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
            hit = self.words[place] == words
            np.add.at(signal, at + row[hit], self.weights[place[hit]])
            np.add.at(known, at + row[hit], 1)
        return signal, known


NO_MODEL = Model(np.zeros(0, np.int64), np.zeros(0), np.array([50.0, 51.0, 52.0]), np.inf)


def cumulative_link(x: np.ndarray, grade: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of largest penalised likelihood, by full-batch gradient steps (Adam)."""
    n, d = x.shape
    params = np.concatenate([np.zeros(d), [1.0], np.zeros(GRADES - 2)])  # weights, first threshold, log gaps
    mean, square = np.zeros_like(params), np.zeros_like(params)
    rows = np.arange(n)
    for step in range(1, steps + 1):
        w, gaps = params[:d], np.exp(params[d + 1 :])
        thresholds = params[d] + np.concatenate([[0.0], np.cumsum(gaps)])
        signal = x @ w
        upto = np.zeros((n, GRADES + 1))
        upto[:, -1] = 1
        upto[:, 1:-1] = 1 / (1 + np.exp(np.clip(signal[:, None] - thresholds[None, :], -500, 500)))
        high, low = upto[rows, grade + 1], upto[rows, grade]
        p = np.maximum(high - low, 1e-12)
        slope = np.zeros((n, GRADES + 1))
        slope[rows, grade + 1] += high * (1 - high) / p
        slope[rows, grade] -= low * (1 - low) / p
        by_threshold = slope[:, 1:-1].mean(0)
        later = np.cumsum(by_threshold[::-1])[::-1]
        gradient = np.concatenate([x.T @ (high + low - 1) / n - PENALTY * w, [later[0]], later[1:] * gaps])
        mean, square = 0.9 * mean + 0.1 * gradient, 0.999 * square + 0.001 * gradient**2
        params = params + LEARNING_RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return params[:d], params[d] + np.concatenate([[0.0], np.cumsum(np.exp(params[d + 1 :]))])


def _sample_words(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, toxic, word, n: the words of the labelled sample."""
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.where("toxic = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(PER_CLASS).unionByName(
        known.where("toxic = 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(PER_CLASS)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(F.col("doc_id").cast("long"), F.col("toxic").cast("int"), "text")

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, row, words, n in word_sets(b.column(2)):
                where = pa.array(at + row)
                yield pa.RecordBatch.from_arrays([b.column(0).take(where), b.column(1).take(where), pa.array(words), pa.array(n.astype(np.int64))], names=["doc_id", "toxic", "word", "n"])

    return rows.mapInArrow(take, "doc_id long, toxic int, word long, n long")


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    work = Workspace(docs.sparkSession, "toxicity", wide=True)
    words = work.keep(_sample_words(docs, labels), "sample")
    totals = {r["toxic"]: r["n"] for r in words.groupBy("toxic").agg(F.countDistinct("doc_id").alias("n")).collect()}
    if not totals.get(0) or not totals.get(1):
        return NO_MODEL
    t, c = F.col("t"), F.col("c")
    share_t, share_c = (t + 0.5) / (totals[1] + 1.0), (c + 0.5) / (totals[0] + 1.0)
    counts = words.groupBy("word").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")).where("t + c >= 5")
    z = (share_t - share_c) / F.sqrt(share_t * (1 - share_t) / totals[1] + share_c * (1 - share_c) / totals[0])
    picked = counts.withColumns({"z": z, "ratio": share_t / share_c}).where("abs(z) >= 4").orderBy(F.desc(F.abs("z")), "word").limit(FEATURES).collect()
    if not picked:
        return NO_MODEL
    keys = np.array(sorted(r["word"] for r in picked), np.int64)
    marked = {r["word"] for r in picked if r["ratio"] >= 5}
    chosen = docs.sparkSession.createDataFrame([(int(k),) for k in keys], "word long")
    got = words.join(F.broadcast(chosen), "word", "left_semi").select("doc_id", "word", "n").collect()
    ids = words.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.sum("n").alias("size")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    place = {r["doc_id"]: k for k, r in enumerate(ids)}
    x, density = np.zeros((len(ids), len(keys))), np.zeros(len(ids))
    for r in got:
        x[place[r["doc_id"]], np.searchsorted(keys, r["word"])] = 1
        density[place[r["doc_id"]]] += r["n"] * (r["word"] in marked)
    toxic = np.array([r["toxic"] for r in ids])
    density /= np.maximum([r["size"] for r in ids], 1)
    cuts = np.quantile(density[toxic == 1], [1 / 3, 2 / 3])
    grade = np.where(toxic == 1, 1 + np.searchsorted(cuts, density), 0)
    held = np.arange(len(ids)) % 5 == 0
    weights, thresholds = cumulative_link(x[~held], grade[~held])
    model = Model(keys, weights, thresholds, np.inf)
    severity, _ = model.severity(x @ weights)
    own = held if (toxic[held] == 1).any() and (toxic[held] == 0).any() else np.ones(len(ids), bool)
    low = float(np.quantile(severity[own & (toxic == 0)], PRECISION))
    above = severity[own & (toxic == 1) & (severity > low)]
    model.cut = low + 0.25 * (float(np.quantile(above, 0.1)) - low) if len(above) else np.inf
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_known words, signal, expected_severity, grade and rejected, one row per document row."""

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            signal, known = model.signals(b.column(1))
            severity, grade = model.severity(signal)
            columns = [b.column(0), pa.array(known), pa.array(signal), pa.array(severity), pa.array(grade.astype(np.int32)), pa.array(severity >= model.cut)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_known", "signal", "expected_severity", "grade", "rejected"])

    schema = "doc_id long, n_known long, signal double, expected_severity double, grade int, rejected boolean"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rate, schema)


def clean(docs: DataFrame, model: Model) -> DataFrame:
    """The document rows, all columns, that the model does not reject."""
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            severity, _ = model.severity(model.signals(b.column(at))[0])
            yield b.filter(pa.array(severity < model.cut))

    return docs.mapInArrow(keep, docs.schema)
