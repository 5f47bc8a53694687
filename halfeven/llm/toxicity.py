"""Toxicity: a linear classifier over character n-grams, scaled by naive Bayes log-count ratios.

A text's features are its distinct character n-grams (of its A-Z lower-cased UTF-8 bytes), hashed to
a fixed number of buckets.  On labelled texts every bucket gets r = log(p / q), the ratio of its
smoothed share among toxic and clean texts; the buckets whose ratio is best supported are kept and a
logistic regression is fitted on features of value r.  A score is sigmoid(bias + sum of weight * r).

Fitting reads at most `max_train` labelled documents, chosen by the hash of their id; what comes to
the driver is a pair of counts per bucket and, per chosen document, its kept buckets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, slices, small_batches, table, tidy

ORDERS = (4, 5, 6)
BITS = 20
#: Labelled documents used for fitting, at most.
MAX_TRAIN = 20_000
#: Buckets that the classifier keeps, at most.
KEPT = 2_000
THRESHOLD = 0.3
#: Bytes of text that numpy holds at once, about (each takes some 100 bytes of arrays).
PIECE = 1 << 19
_PRIME = np.uint64(0x100000001B3)
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Model:
    """Weights (log-count ratio times regression weight) by bucket, and the bias."""

    buckets: np.ndarray
    weights: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << BITS, dtype=np.float32)
        out[self.buckets] = self.weights
        return out


def _fold(texts: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, one space around each, and each text's start; null is the empty text."""
    parts = [b" " + (t or "").encode().lower() + b" " for t in texts.to_pylist()]
    starts = np.zeros(len(parts) + 1, dtype=np.int64)
    np.cumsum([len(p) for p in parts], out=starts[1:])
    return np.frombuffer(b"".join(parts), dtype=np.uint8), starts


def _buckets(data: np.ndarray, order: int) -> np.ndarray:
    """The bucket of the n-gram that starts at each byte."""
    n = len(data) - order + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    h = np.full(n, order, dtype=np.uint64)
    for k in range(order):
        h *= _PRIME
        h += data[k : k + n]
    h *= _MIX
    h >>= np.uint64(64 - BITS)
    return h.astype(np.int64)


def _features(data: np.ndarray, starts: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, bucket) pairs; only buckets that `wanted` marks, if it is given."""
    docs, found = [], []
    for order in ORDERS:
        b = _buckets(data, order)
        at = np.arange(len(b)) if wanted is None else np.flatnonzero(wanted[b])
        doc = np.searchsorted(starts, at, side="right") - 1
        inside = at + order <= starts[doc + 1]
        docs.append(doc[inside])
        found.append(b[at[inside]])
    pairs = np.unique((np.concatenate(docs) << BITS) | np.concatenate(found))
    return pairs >> BITS, pairs & ((1 << BITS) - 1)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts that have each bucket, by label, of one partition."""
    n = np.zeros((2, 1 << BITS), dtype=np.int64)
    for batch in batches:
        label = np.asarray(batch.column("toxic").to_pylist(), dtype=np.int64)
        for a, b in slices(batch.column("text"), PIECE):
            doc, bucket = _features(*_fold(batch.column("text").slice(a, b - a)))
            np.add.at(n, (label[a:b][doc], bucket), 1)
    have = np.flatnonzero(n.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(have), pa.array(n[0][have]), pa.array(n[1][have])], ["bucket", "clean", "toxic"])


def training_rows(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """text and toxic of the chosen labelled documents: those with the smallest hash of their id, held-out ids left out."""
    usable = labels.select(F.col("doc_id").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(
        "doc_id is not null and toxic in (0, 1) and crc32(cast(doc_id as string)) % 4 != 2"
    )
    chosen = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    # at most max_train rows of 12 bytes
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic")


def _fit(doc: np.ndarray, column: np.ndarray, value: np.ndarray, y: np.ndarray, width: int, ridge: float = 1e-3, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression by accelerated gradient steps; column k of document i has the value value[k]."""
    w, bias, n = np.zeros(width), 0.0, len(y)
    v, vb = w.copy(), bias
    norm = np.bincount(doc, weights=value[column] ** 2, minlength=n).max(initial=0) + 1
    rate = 4.0 / norm
    for t in range(rounds):
        z = np.bincount(doc, weights=v[column] * value[column], minlength=n) + vb
        g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        step = np.bincount(column, weights=g[doc] * value[column], minlength=width) / n + ridge * v
        nw, nb = v - rate * n / max(1, y.sum()) * step, vb - rate * n / max(1, y.sum()) * g.mean()
        mu = t / (t + 3)
        v, vb, w, bias = nw + mu * (nw - w), nb + mu * (nb - bias), nw, nb
    return w, float(bias)


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, kept: int = KEPT, smoothing: float = 1.0) -> Model:
    """Fits the classifier.  Without labelled rows of both classes it is a constant score of the toxic share (0 of none)."""
    small_batches(docs.sparkSession)
    rows = materialise(training_rows(docs, labels, max_train), "training")
    # one row a bucket: bounded by 2^BITS whatever the corpus
    counts = rows.mapInArrow(tidy(_counts), "bucket long, clean long, toxic long").groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    sizes = dict(rows.groupBy("toxic").count().collect())
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_clean:
        share = n_toxic / max(1, n_toxic + n_clean)
        return Model(np.zeros(0, np.int64), np.zeros(0, np.float32), 30.0 if share == 1 else -30.0)
    ratio = F.log(((F.col("toxic") + smoothing) / (n_toxic + 2 * smoothing)) / ((F.col("clean") + smoothing) / (n_clean + 2 * smoothing)))
    support = F.abs(F.col("toxic") / n_toxic - F.col("clean") / n_clean) / F.sqrt((F.col("toxic") + F.col("clean") + 1) / (n_toxic + n_clean))
    best = counts.select("bucket", ratio.alias("r"), support.alias("s")).orderBy(F.desc("s"), "bucket").limit(kept).collect()
    buckets = np.array([b["bucket"] for b in best], dtype=np.int64)
    r = np.array([b["r"] for b in best])
    order = np.argsort(buckets)
    buckets, r = buckets[order], r[order]
    wanted = np.zeros(1 << BITS, dtype=bool)
    wanted[buckets] = True

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column("text"), PIECE):
                doc, bucket = _features(*_fold(batch.column("text").slice(a, b - a)), wanted)
                cut = np.searchsorted(doc, np.arange(b - a + 1))
                lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(np.searchsorted(buckets, bucket), pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("toxic").slice(a, b - a), lists], ["toxic", "columns"])

    # at most max_train rows of at most `kept` columns
    sample = rows.mapInArrow(tidy(present), "toxic int, columns array<int>").toArrow()
    lists = sample.column("columns").combine_chunks()
    y = sample.column("toxic").to_numpy().astype(float)
    doc = np.repeat(np.arange(len(y)), pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False).astype(int))
    column = pa.compute.list_flatten(lists).to_numpy(zero_copy_only=False).astype(int)
    w, bias = _fit(doc, column, r, y, len(buckets))
    return Model(buckets, (w * r).astype(np.float32), bias)


def scorer(model: Model):
    """A Pandas UDF from texts to scores."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weights = model.dense()
        wanted = weights != 0
        for texts in batches:
            held = pa.array([None if t is None else t for t in texts], pa.string())
            out = np.empty(len(held))
            for a, b in slices(held, PIECE):
                doc, bucket = _features(*_fold(held.slice(a, b - a)), wanted)
                z = np.bincount(doc, weights=weights[bucket], minlength=b - a) + model.bias
                out[a:b] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pd.Series(out)

    return score


def toxicity_scores(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Null and empty texts have the score of the bias.  Null ids are not held out.  Repeated rows each give a row,
    an empty table gives none.  A long text is scored as a whole.  Columns besides doc_id and text are ignored,
    whatever their names.
    """
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    scored = docs.select("doc_id", held_out.alias("held_out"), scorer(model)(F.col("text")).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int"))


def drop_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """`docs` without those that the classifier rejects, its columns as they were."""
    return docs.where(scorer(model)(F.col("text")) < threshold)


def op8_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity_scores(docs, fit(docs, table(spark, sf_dir, "labels")))
