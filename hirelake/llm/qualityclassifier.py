"""Quality classifier: random-indexing word vectors pooled per document, a two-layer numpy network, temperature."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelake.llm.common import binary, bounded, documents, reachable, settle
from hirelake.llm.wordvectors import TEXT_BYTES, WordVectors, corpus_sums

#: Labelled documents that a fit reads at most: those of the lowest hashes of doc_id.
FIT_ROWS = 20_000
HIDDEN, ROUNDS, BATCH, RATE, DECAY, SEED = 32, 60, 128, 3e-3, 1e-4, 11
#: Every so many-th fit row sets the temperature instead of weights.
CALIBRATION_FOLDS = 4
#: Score from which a document counts as good.
GOOD = 0.7


class Network:
    """One hidden layer of tanh units and one output, trained by Adam on the log loss; scores are divided by a
    temperature that held-back rows fit best."""

    def __init__(self, width: int, hidden: int = HIDDEN, seed: int = SEED):
        random = np.random.default_rng(seed)
        self.parts = [random.normal(0, width ** -0.5, (width, hidden)), np.zeros(hidden), random.normal(0, hidden ** -0.5, hidden), np.zeros(1)]
        self.mean, self.spread, self.temperature = np.zeros(width), np.ones(width), 1.0

    def margins(self, rows: np.ndarray) -> np.ndarray:
        a, b, c, d = self.parts
        return np.tanh((rows - self.mean) / self.spread @ a + b) @ c + d[0]

    def scores(self, rows: np.ndarray) -> np.ndarray:
        return _logistic(self.margins(rows) / self.temperature)

    def fit(self, rows: np.ndarray, labels: np.ndarray, rounds: int = ROUNDS, seed: int = SEED) -> None:
        self.mean, self.spread = rows.mean(axis=0), np.maximum(rows.std(axis=0), 1e-6)
        scaled, random = (rows - self.mean) / self.spread, np.random.default_rng(seed)
        first, second, step = [np.zeros_like(p) for p in self.parts], [np.zeros_like(p) for p in self.parts], 0
        for _ in range(rounds):
            order = random.permutation(len(rows))
            for at in range(0, len(order), BATCH):
                x, y = scaled[order[at:at + BATCH]], labels[order[at:at + BATCH]]
                a, b, c, d = self.parts
                inner = np.tanh(x @ a + b)
                error = (_logistic(inner @ c + d[0]) - y) / len(y)
                back = np.outer(error, c) * (1 - inner ** 2)
                slopes = [x.T @ back + DECAY * a, back.sum(axis=0), inner.T @ error + DECAY * c, np.array([error.sum()])]
                step += 1
                for k, slope in enumerate(slopes):
                    first[k] += 0.1 * (slope - first[k])
                    second[k] += 0.001 * (slope ** 2 - second[k])
                    self.parts[k] = self.parts[k] - RATE * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)

    def calibrate(self, rows: np.ndarray, labels: np.ndarray) -> None:
        """The temperature of least log loss on ``rows``, by golden section over its logarithm (0.05 to 20)."""
        margins, ratio = self.margins(rows), (5 ** 0.5 - 1) / 2

        def loss(t: float) -> float:
            return float(np.logaddexp(0, np.where(labels > 0, -margins, margins) / np.exp(t)).mean())

        lo, hi = np.log(0.05), np.log(20.0)
        for _ in range(40):
            left, right = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
            lo, hi = (lo, right) if loss(left) <= loss(right) else (left, hi)
        self.temperature = float(np.exp((lo + hi) / 2))


def _logistic(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


def in_fit(doc_id: str = "doc_id"):
    """Rows whose labels may be learned from: crc32 of the id as text leaves another remainder than 2 by 4."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 != 2


class QualityModel:
    """Fitted vectors and network. Without examples of both classes the score is the share of label 1."""

    def __init__(self, vectors: WordVectors | None, network: Network | None, share: float):
        self.vectors, self.network, self.share = vectors, network, share

    def score(self, docs: DataFrame) -> DataFrame:
        """(doc_id, score) for each row of ``docs``: whole texts; null and empty texts too."""
        if self.network is None:
            return documents(docs).select("doc_id", F.lit(float(self.share)).alias("score"))
        reachable(docs.sparkSession)
        vectors, network = self.vectors, self.network

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in bounded(batches, limit=TEXT_BYTES):
                scores = network.scores(vectors.pooled(binary(batch.column("text"))))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores)], ["doc_id", "score"])

        return documents(docs).mapInArrow(run, "doc_id long, score double")


def fit_quality(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> QualityModel:
    """Vectors from the texts of all rows of ``docs``; the network from labelled rows outside the held-out fourth, at
    most ``fit_rows`` of them (lowest hashes of doc_id).

    A doc_id that is labelled more than once counts as label 1 if any of its labels is 1; labels other than 0 and 1, and
    null ones, are left out. Of rows that repeat a doc_id the text of the least hash is learned from. Only the features
    of the bounded list of documents and the vector table of fixed size reach the driver, where the network is trained.
    """
    known = labels.filter(F.col("quality").isin(0, 1) & in_fit()).groupBy("doc_id").agg(F.max("quality").cast("int").alias("label"))
    chosen = settle(known.select(F.col("doc_id").cast("long").alias("doc_id"), "label").orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows), "quality-labels")
    texts = documents(docs)
    found = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    fit = settle(found, "quality-documents")
    seen = fit.agg(F.count("*").alias("n"), F.sum("label").alias("k")).first()
    share = (seen["k"] or 0) / max(1, seen["n"])
    if not 0 < share < 1:
        return QualityModel(None, None, share)
    vectors = WordVectors(corpus_sums(texts))

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, limit=TEXT_BYTES):
            rows = vectors.pooled(binary(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(list(rows), pa.list_(pa.float64()))],
                                             ["doc_id", "label", "features"])

    pooled = settle(fit.mapInArrow(pool, "doc_id long, label int, features array<double>"), "quality-features")
    rows = pooled.select("doc_id", "label", "features", (F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(CALIBRATION_FOLDS)) == 0).alias("held"))
    table = rows.toArrow().sort_by("doc_id")  # bounded by fit_rows
    features = table.column("features").combine_chunks().flatten().to_numpy().reshape(-1, WordVectors.FEATURES)
    label, held = table.column("label").to_numpy().astype(float), table.column("held").to_numpy()
    if len(set(label[~held])) < 2:
        return QualityModel(None, None, share)
    network = Network(WordVectors.FEATURES)
    network.fit(features[~held], label[~held])
    if len(set(label[held])) == 2:
        network.calibrate(features[held], label[held])
    return QualityModel(vectors, network, share)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from a score of 0.7), a row for each row of ``docs``.

    A null text is scored as an empty one; a null doc_id is not held out; empty tables give no rows, and without usable
    labels every score is 0. Further columns are left out.
    """
    scored = fit_quality(docs, labels).score(docs)
    return scored.select("doc_id", F.coalesce(~in_fit(), F.lit(False)).alias("held_out"), "score",
                         F.when(F.col("score") >= GOOD, 1).otherwise(0).alias("predicted"))
