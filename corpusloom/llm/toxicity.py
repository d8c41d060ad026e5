"""Toxicity: a character n-gram linear classifier on features scaled by naive Bayes log-count ratios.

A document's features are its distinct character n-grams, hashed to ``buckets``. Each is scaled by the log of how
much likelier it is in toxic than in other training documents, smoothed towards no evidence, and a logistic
regression with an L2 penalty is trained on the scaled features. Learning takes at most ``train_rows`` labelled
documents (a documented bound: those of smallest hash of doc_id), whose features meet in one task; the driver
sees only the finished weights, of fixed number. Scoring reads every whole text once and shuffles nothing.

Defined results for odd rows: null or empty text has no features and scores as the intercept says; a document
with several labels is toxic if any says so; null labels and labels without a document are ignored; a null
doc_id is not learned from and is not held out; without a labelled document of either class every score is that class's; repeated rows are scored each;
texts of any length are read whole; an empty table gives no row; further columns are no input, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import map_rows, prepare, smallest_hashes, table, utf8
from ._ngrams import codes, hashed

SIZES = (5, 6)
BUCKETS = 1 << 20


def remainder(doc_id: str, mod: int) -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % mod


class Model:
    """Weights by bucket (NB scaling included) and the intercept."""

    def __init__(self, weights: np.ndarray, intercept: float):
        self.weights, self.intercept = weights, intercept

    def score(self, features: np.ndarray) -> float:
        z = float(self.weights[features].sum(dtype=np.float64)) + self.intercept
        return 1 / (1 + float(np.exp(-min(max(z, -500.0), 500.0))))


def fit(features: list[np.ndarray], labels: np.ndarray, buckets: int = BUCKETS, smooth: float = 4.0, penalty: float = 1e-2, rounds: int = 80, min_docs: int = 3) -> Model:
    """Naive Bayes ratios from document counts, then logistic regression by Adam on all rows at once."""
    y = labels.astype(np.float64)
    n, n1 = len(y), float(y.sum())
    if not n or n1 in (0.0, float(n)):
        return Model(np.zeros(buckets, np.float32), 6.0 if n and n1 else -6.0)
    # A feature of each row at a time: what follows keeps one 32-bit and one 16- or 32-bit number for each.
    flat = np.concatenate(features).astype(np.int32, copy=False)
    row = np.repeat(np.arange(n, dtype=np.uint16 if n <= 1 << 16 else np.uint32), [len(f) for f in features])
    features.clear()
    df = np.bincount(flat, minlength=buckets)
    keep = df >= min_docs
    flat, row = flat[at := keep[flat]], row[at]
    del at
    parts = [slice(i, i + (1 << 21)) for i in range(0, len(flat), 1 << 21)]
    toxic = sum((np.bincount(flat[p], weights=y[row[p]], minlength=buckets) for p in parts), np.zeros(buckets))
    share = n1 / n
    ratio = np.log((toxic + smooth * share) / n1) - np.log((df - toxic + smooth * (1 - share)) / (n - n1))
    names = np.flatnonzero(keep)
    place = np.zeros(buckets, np.int32)
    place[names] = np.arange(len(names))
    for p in parts:
        flat[p] = place[flat[p]]
    scale = ratio[names].astype(np.float32)
    w, b = np.zeros(len(names)), np.log(share / (1 - share))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    each = np.where(y > 0, 0.5 / n1, 0.5 / (n - n1))  # both classes weigh the same
    for step in range(1, rounds + 1):
        scaled = (w * scale).astype(np.float32)
        z = np.full(n, b)
        for p in parts:
            z += np.bincount(row[p], weights=scaled[flat[p]], minlength=n)
        error = (each * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y)).astype(np.float32)
        g = np.zeros(len(names))
        for p in parts:
            g += np.bincount(flat[p], weights=error[row[p]], minlength=len(names))
        g = g * scale + penalty * w
        gb = float(error.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        rate, fix, fix2 = 0.05, 1 - 0.9**step, 1 - 0.99**step
        w -= rate * (m / fix) / (np.sqrt(v / fix2) + 1e-6)
        b -= rate * (mb / fix) / (np.sqrt(vb / fix2) + 1e-6)
    weights = np.zeros(buckets, np.float32)
    weights[names] = w * scale
    return Model(weights, float(b))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", train_rows: int = 8000, sizes: tuple[int, ...] = SIZES, buckets: int = BUCKETS) -> Model:
    """Fit on the labelled documents of smallest hash, ``train_rows`` at most. Their ids are of bounded number and are
    broadcast; the documents' features are made where the documents are."""
    known = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg(F.max(label).alias("_y"))
    chosen = known.join(F.broadcast(smallest_hashes(known, "_id", train_rows)), "_id")
    rows = docs.select(F.col(doc_id).alias("_id"), utf8(text)).join(F.broadcast(chosen), "_id").select("_y", text)

    def features(ys, texts):
        return [int(y) for y in ys], [hashed(codes(t), sizes, buckets).astype(np.int32) for t in texts]

    def learn(batches):
        found, ys = [], []
        for batch in batches:
            column = batch.column(1)
            flat, offsets = column.values.to_numpy(), column.offsets.to_numpy()
            found += [flat[a:b].copy() for a, b in zip(offsets, offsets[1:])]
            ys += batch.column(0).to_pylist()
        model = fit(found, np.array(ys, np.float64), buckets)
        at = np.flatnonzero(model.weights)
        bucket = np.concatenate([[-1], at]).astype(np.int32)
        weight = np.concatenate([[model.intercept], model.weights[at].astype(np.float64)])
        yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(weight)], names=["bucket", "weight"])

    learned = map_rows(rows, features, "y int, features array<int>").repartition(1).mapInArrow(learn, "bucket int, weight double").toArrow()
    bucket, weight = learned.column(0).to_numpy(), learned.column(1).to_numpy()
    if not len(bucket):
        return fit([], np.zeros(0), buckets)
    weights = np.zeros(buckets, np.float32)
    weights[bucket[bucket >= 0]] = weight[bucket >= 0]
    return Model(weights, float(weight[bucket < 0][0]))


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", sizes: tuple[int, ...] = SIZES) -> DataFrame:
    """(doc_id, score): how likely each whole text is toxic."""
    shared = prepare(docs.sparkSession).sparkContext.broadcast(model)
    kind = docs.schema[doc_id].dataType.simpleString()

    def rows(ids, texts):
        m = shared.value
        return ids, [m.score(hashed(codes(t), sizes, len(m.weights))) for t in texts]

    return map_rows(docs.select(F.col(doc_id).alias("doc_id"), utf8(text)), rows, f"doc_id {kind}, score double")


def drop_toxic(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.5, sizes: tuple[int, ...] = SIZES) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; all columns pass through. No row needs an id."""
    shared = prepare(docs.sparkSession).sparkContext.broadcast(model)
    place = docs.columns.index(text)

    def run(batches):
        m = shared.value
        for batch in batches:
            keep = [m.score(hashed(codes(t.as_py()), sizes, len(m.weights))) < threshold for t in batch.column(place)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "toxic")
    model = train(docs, labels.where(remainder("doc_id", 5) != 0))
    held_out = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False))
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
