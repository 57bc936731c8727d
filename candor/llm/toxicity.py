"""Toxicity: a linear classifier over character n-grams whose features are scaled by naive Bayes log-count ratios.

Presence of character n-grams (orders 4 and 5, code points, lower case, told apart by a 64-bit hash) in labelled
documents is counted per class; the ratio of the smoothed counts scales each feature. Features are the n-grams of at
least `least_docs` labelled documents whose ratio lies at least `stands_out` standard errors from 0, however many they
are; they enter a logistic regression, fitted in numpy. Labels come from a bounded sample: about `sample_rows` of the
labelled rows outside the held-out share, chosen by a hash of the id (the documented bound). Scoring is a map over all
whole texts: no shuffle.

Null text counts as empty and, like every text without any feature, gets the score of the intercept. Repeated labels
of one id count as toxic if any is; rows of documents that share a labelled id are samples each. Without labels of both
classes every score is the share of toxic ones (0 if there are no labels at all), and `without_toxic` keeps all.
Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candor.llm.bpe import slices
from candor.llm.common import id_bucket, saved, share, text_or_empty
from candor.llm.grams import characters

ORDERS, SIEVE = (4, 5), 20
RUN = 400_000  # characters of texts at a time


def _present(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of the n-grams of texts, not yet distinct."""
    docs, ids = [], []
    own = [t.lower() for t in texts]
    for order in ORDERS:
        found, counts = characters(own, order)
        docs.append(np.repeat(np.arange(len(texts), dtype=np.int64), counts))
        ids.append(found)
    return np.concatenate(docs), np.concatenate(ids)


def _distinct(docs: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, docs))
    docs, ids = docs[order], ids[order]
    new = np.append(True, (docs[1:] != docs[:-1]) | (ids[1:] != ids[:-1])) if len(ids) else np.zeros(0, bool)
    return docs[new], ids[new]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each class that hold an n-gram, run by run."""
    for batch in batches:
        texts, toxic = batch.column(0).to_pylist(), np.array(batch.column(1).to_pylist(), np.int64)
        for a, b in slices(texts, RUN):
            docs, ids = _distinct(*_present(texts[a:b]))
            found, at = np.unique(ids, return_inverse=True)
            bad = np.bincount(at, toxic[a:b][docs], minlength=len(found)).astype(np.int64)
            every = np.bincount(at, minlength=len(found))
            for c in range(0, len(found), 100_000):
                d = slice(c, c + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(found[d].view(np.int64)), pa.array(every[d] - bad[d]), pa.array(bad[d])], ["id", "clean", "toxic"])


class Model:
    """Sorted hashes of the features, their weights, and the intercept."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray, bias: float):
        order = np.argsort(ids)
        self.ids, self.weights, self.bias = ids[order], weights[order], bias
        self.sieve = np.zeros(1 << SIEVE, bool)
        self.sieve[self.ids >> np.uint64(64 - SIEVE)] = True

    def hits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (document, feature) pairs."""
        docs, ids = _present(texts)
        if not len(self.ids) or not len(ids):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        maybe = np.flatnonzero(self.sieve[ids >> np.uint64(64 - SIEVE)])
        docs, ids = docs[maybe], ids[maybe]
        at = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
        known = self.ids[at] == ids
        pairs = np.unique(docs[known] * len(self.ids) + at[known])
        return pairs // len(self.ids), pairs % len(self.ids)

    def scores(self, texts: list[str]) -> np.ndarray:
        rows, columns = self.hits(texts)
        margin = np.bincount(rows, self.weights[columns], minlength=len(texts)) + self.bias
        return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))


def logistic(rows: np.ndarray, columns: np.ndarray, scale: np.ndarray, labels: np.ndarray, rounds: int = 150, penalty: float = 1.0) -> tuple[np.ndarray, float]:
    """Weights of scaled binary features given as (row, column) pairs, and the intercept, by full-batch Adam."""
    n, width = len(labels), len(scale)
    weights, bias = np.zeros(width + 1), np.log((labels.sum() + 1) / (n - labels.sum() + 1))
    weights[-1] = bias
    first, second = np.zeros(width + 1), np.zeros(width + 1)
    values = scale[columns]
    for t in range(1, rounds + 1):
        margin = np.bincount(rows, weights[columns] * values, minlength=n) + weights[-1]
        error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels) / n
        step = np.append(np.bincount(columns, error[rows] * values, minlength=width) + penalty * weights[:-1] / max(width, 1), error.sum())
        first, second = 0.9 * first + 0.1 * step, 0.99 * second + 0.01 * step**2
        weights = weights - 0.05 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-9)
    return weights[:-1] * scale, float(weights[-1])


def fit(docs: DataFrame, labels: DataFrame, held_out: int = 5, sample_rows: int = 6_000, least_docs: int = 3, stands_out: float = 3.0) -> tuple[Model, bool]:
    """The model, and whether labels of both classes were there to learn from."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (id_bucket(held_out) != 0)).groupBy("doc_id").agg(F.max("toxic").alias("mark"))
    total = known.count()
    chosen = known.where(share(total, sample_rows)).select(F.col("doc_id").alias("label_id"), "mark")
    sample = saved(docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id")).select("text", F.col("mark").cast("int").alias("mark")))
    sizes = sample.agg(F.count_if(F.col("mark") == 0).alias("clean"), F.count_if(F.col("mark") == 1).alias("toxic")).first()
    clean, toxic = sizes.clean, sizes.toxic
    if not clean or not toxic:
        part = toxic / max(clean + toxic, 1)
        return Model(np.zeros(0, np.uint64), np.zeros(0), float(np.log(max(part, 1e-9) / max(1 - part, 1e-9)))), False
    counted = sample.mapInArrow(_count, "id long, clean long, toxic long").groupBy("id").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    ratio = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("clean") + 0.5) / (clean + 1))
    error = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    best = counted.where(F.col("clean") + F.col("toxic") >= least_docs).select("id", ratio.alias("ratio"), (ratio / error).alias("z")).where(F.abs("z") >= stands_out).select("id", "ratio").toArrow()
    ids, scale = best.column("id").to_numpy().view(np.uint64), best.column("ratio").to_numpy()
    order = np.argsort(ids)
    bare = Model(ids[order], scale[order], 0.0)
    at = docs.sparkSession.sparkContext.broadcast(bare)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in slices(texts, RUN):
                rows, columns = at.value.hits(texts[a:b])
                lists = np.split(columns, np.cumsum(np.bincount(rows, minlength=b - a))[:-1])
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(a, b - a), pa.array(lists, pa.list_(pa.int32()))], ["mark", "features"])

    got = sample.mapInArrow(features, "mark int, features array<int>").toArrow()
    lists = got.column("features").combine_chunks()
    lengths = np.diff(lists.offsets.to_numpy())
    columns = lists.flatten().to_numpy().astype(np.int64)
    weights, bias = logistic(np.repeat(np.arange(len(lengths)), lengths), columns, bare.weights, got.column("mark").to_numpy().astype(float))
    at.unpersist()
    return Model(bare.ids, weights, bias), True


def score(docs: DataFrame, labels: DataFrame, held_out: int = 5, sample_rows: int = 6_000) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, held_out, sample_rows)[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for a, b in slices(texts, RUN):
                scores = model.value.scores(texts[a:b])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"]
                )

    given = docs.select("doc_id", (id_bucket(held_out) == 0).alias("held_out"), text_or_empty().alias("text"))
    return given.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, held_out: int = 5) -> DataFrame:
    """The documents whose score is below the threshold, with their columns as they are.

    Without labels of both classes nothing is known of either, and every document stays. Rows with null or equal ids
    are judged each by its own text; a null text is judged as an empty one.
    """
    fitted, both = fit(docs, labels, held_out)
    if not both:
        return docs
    model, at = docs.sparkSession.sparkContext.broadcast(fitted), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            for a, b in slices(texts, RUN):
                yield batch.slice(a, b - a).filter(pa.array(model.value.scores(texts[a:b]) < threshold))

    return docs.mapInArrow(run, docs.schema)
