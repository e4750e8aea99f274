"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text: its words (A-Z lower-cased, cut at ASCII characters that are no letters or
digits), pairs of neighbours and pairs with one word between, hashed into ``BUCKETS`` weights,
each once per text however often it occurs.  Per-coordinate learning rates and an L1 penalty
leave a few thousand weights that differ from zero; they are broadcast (at most BUCKETS values).

The model is fitted on ``MAX_LABELLED`` labelled texts at most, those with the smallest hashes of
doc_id, then of text, in one task that reads them in that order: the bound is a parameter, and results
do not depend on partitioning.  Every text is scored whole.

Defined results: a null or empty text has the score of the bias alone; labels without a value are
left out, of several for one doc_id the greatest counts; rows of equal doc_id and text are one labelled
text; with no label at all every score is 0; repeated rows are scored alike; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shapeloom.llm.common import PUNCTUATION, Block, blocks, mix, prefix_hash, range_hash, tune

BUCKETS = 1 << 20
MAX_LABELLED = 20_000
EPOCHS = 8
ALPHA, BETA, L1, L2 = 2.0, 1.0, 6.0, 1e-4
_NEXT, _SKIP = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA5CB9243F0AEF1B5)


def features(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(text of the block, bucket) of every feature occurrence."""
    starts, ends, first = block.words(PUNCTUATION)
    h = range_hash(prefix_hash(block.lowered()), starts, ends)
    doc = np.repeat(np.arange(block.n), np.diff(first))
    near, far = doc[1:] == doc[:-1], doc[2:] == doc[:-2]
    pair = mix(h[:-1] * _NEXT + h[1:])[near]
    skip = mix(h[:-2] * _SKIP + h[2:])[far]
    ids = np.concatenate([h, pair, skip]) & np.uint64(BUCKETS - 1)
    return np.concatenate([doc, doc[1:][near], doc[2:][far]]), ids.astype(np.int64)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


class Ftrl:
    """Per-coordinate FTRL-proximal; the last coordinate is the bias, which has no penalty."""

    def __init__(self, size: int):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        free = np.asarray(at) == len(self.z) - 1
        w = -(z - np.sign(z) * np.where(free, 0, L1)) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        return np.where((np.abs(z) > L1) | free, w, 0.0)

    def learn(self, at: np.ndarray, y: float) -> None:
        w = self.weights(at)
        g = sigmoid(w.sum()) - y
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def _fit(batches):
    """Rows (toxic, text) in a fixed order -> (bucket, weight) of all weights that are not zero."""
    texts, labels = [], []
    for batch in batches:
        labels += batch.column(0).to_pylist()
        for block in blocks(batch.column(1)):
            doc, ids = features(block)
            key = np.unique(doc * BUCKETS + ids)
            cut = np.searchsorted(key, np.arange(block.n + 1) * BUCKETS)
            texts += [np.append(key[a:b] % BUCKETS, BUCKETS).astype(np.int32) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    model = Ftrl(BUCKETS)
    if labels:
        rate = np.clip(np.mean(labels), 1e-4, 1 - 1e-4)
        model.z[-1] = -np.log(rate / (1 - rate)) * BETA / ALPHA
    rng = np.random.default_rng(1)
    for _ in range(EPOCHS):
        for k in rng.permutation(len(texts)):
            model.learn(texts[k], labels[k])
    w = model.weights(np.arange(BUCKETS + 1))
    at = np.flatnonzero(w) if labels else np.zeros(0, np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(w[at])], ["bucket", "weight"])


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> np.ndarray | None:
    """Weights (bias last) learnt from ``labels`` (doc_id, toxic) over the texts of ``docs``; None without labels."""
    tune(docs.sparkSession)
    order = F.xxhash64("doc_id")
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.orderBy(order, "doc_id").limit(max_labelled)
    # Texts are chosen by narrow rows, so that a doc_id of very many rows cannot fill the one task.
    own = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").withColumn("h", F.xxhash64(F.coalesce("text", F.lit(""))))  # max_labelled rows of two numbers
    keys = own.select("doc_id", "h").distinct().orderBy(order, "doc_id", "h").limit(max_labelled)
    rows = own.join(F.broadcast(keys), ["doc_id", "h"], "left_semi").dropDuplicates(["doc_id", "h"])
    one = rows.repartition(1).sortWithinPartitions(order, "doc_id", "h").select("toxic", "text")
    found = one.mapInArrow(_fit, "bucket long, weight double").collect()  # BUCKETS rows at most
    if not found:
        return None
    weights = np.zeros(BUCKETS + 1, np.float32)
    weights[[r[0] for r in found]] = [r[1] for r in found]
    return weights


def score(docs: DataFrame, weights: np.ndarray | None) -> DataFrame:
    """doc_id, score of each row of ``docs``."""
    tune(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        w = model.value
        for batch in batches:
            out = []
            for block in blocks(batch.column(1)):
                if w is None:
                    out.append(np.zeros(block.n))
                    continue
                doc, ids = features(block)
                used = w[ids] != 0
                key = np.unique(doc[used] * BUCKETS + ids[used])
                x = np.bincount(key // BUCKETS, weights=w[key % BUCKETS], minlength=block.n)
                out.append(sigmoid(x + w[-1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out) if out else np.zeros(0))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def predicted(column: Column) -> Column:
    return (column >= 0.5).cast("int")
