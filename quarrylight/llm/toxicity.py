"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text: its distinct words, word pairs and pairs with one word skipped, hashed to DIM_BITS bits, each worth 1.
Words are lower-cased runs of letters, digits and non-ASCII characters. Per-coordinate learning rates and L1 leave few
weights that are not zero; these are broadcast as two sorted arrays (at most `SAMPLE` documents' features, in practice a
few thousand).

Training reads at most SAMPLE labelled documents, in one task; scoring streams every whole text through numpy.

Defined results. Null or empty text: the bias alone. Without a training row every score is 0. Rows without an id are
scored, and are not held out. Repeated rows are scored each; ties do not matter. Very long texts are scored whole. Other
columns of the input are not read. An empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm import kernels as K
from quarrylight.llm.training import fold, labelled_sample

DIM_BITS = 30
SAMPLE = 16_000
ALPHA, BETA, L1, L2, EPOCHS = 0.15, 1.0, 5.0, 0.1, 4
BLOOM_BITS = 20


def feature_arrays(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, hashed feature) of every place, not yet distinct."""
    w = K.Words(data, offs, K.NON_ALNUM, lower=True)
    h, doc = w.hash, w.doc_of
    docs, feats = [doc], [K.mix(h + K.U(1))]
    for skip in (1, 2):
        m = max(0, len(h) - skip)
        same = doc[:m] == doc[skip:] if m else np.zeros(0, bool)
        pair = K.mix(h[:m] * K._B + h[skip:] * K._C + K.U(skip))
        docs.append(doc[:m][same])
        feats.append(pair[same])
    mask = K.U((1 << DIM_BITS) - 1)
    return np.concatenate(docs), np.concatenate(feats) & mask


class Ftrl:
    """FTRL-proximal for logistic loss on binary features; coordinates are dense places of the sample's features."""

    def __init__(self, n: int):
        self.z, self.n = np.zeros(n), np.zeros(n)

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - L1, 0)
        return -shrunk / ((BETA + np.sqrt(n)) / ALPHA + L2)

    def learn(self, at: np.ndarray, y: int) -> None:
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
        g = p - y
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def fit(examples: list[tuple[np.ndarray, int]], seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(features, weights) that are not zero, features ascending. Feature 2**DIM_BITS is the bias."""
    bias = 1 << DIM_BITS
    if not examples:
        return np.zeros(0, np.uint64), np.zeros(0)
    # 32-bit features and places: the sample's features are what a training task keeps in memory
    names = np.unique(np.concatenate([f for f, _ in examples] + [np.array([bias], np.uint32)]))
    rows = [np.append(np.searchsorted(names, f), len(names) - 1).astype(np.int32) for f, _ in examples]
    model = Ftrl(len(names))
    order = np.random.Generator(np.random.PCG64(seed))
    for _ in range(EPOCHS):
        for i in order.permutation(len(rows)):
            model.learn(rows[i], examples[i][1])
    w = model.weights()
    keep = w != 0
    return names[keep].astype(np.uint64), w[keep]


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    examples = []
    for b in batches:
        ys, ids = b.column("y").to_numpy(), b.column("doc_id").to_numpy()
        for i, j, data, offs in K.text_chunks(b.column("text")):
            doc, feat = feature_arrays(data, offs)
            at = np.searchsorted(np.sort(doc), np.arange(j - i + 1))
            feat = feat[np.argsort(doc, kind="stable")]
            examples += [(int(ids[r]), np.unique(feat[at[r - i] : at[r - i + 1]].astype(np.uint32)), int(ys[r])) for r in range(i, j)]
    examples.sort(key=lambda e: e[0])
    names, weights = fit([e[1:] for e in examples])
    yield pa.record_batch([pa.array(names.astype(np.int64)), pa.array(weights)], names=["feature", "weight"])


def train(docs: DataFrame, sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Weights from the bounded sample(doc_id, y): its texts go to one task, its nonzero weights to the driver."""
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").dropDuplicates(["doc_id"])
    got = rows.repartition(1).mapInArrow(_train, "feature long, weight double").toArrow()
    names = got["feature"].to_numpy().astype(np.uint64)
    order = np.argsort(names)
    return names[order], got["weight"].to_numpy()[order]


def _score(model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, weights = model.value
    bias = float(weights[names == (1 << DIM_BITS)].sum())
    low = K.U((1 << BLOOM_BITS) - 1)
    maybe = np.zeros(1 << BLOOM_BITS, bool)
    maybe[names & low] = True
    for b in batches:
        score = np.zeros(b.num_rows)
        for i, j, data, offs in K.text_chunks(b.column("text")):
            doc, feat = feature_arrays(data, offs)
            hit = maybe[feat & low]
            doc, feat = doc[hit], feat[hit]
            at = np.minimum(np.searchsorted(names, feat), max(len(names) - 1, 0))
            real = names[at] == feat if len(names) else np.zeros(len(feat), bool)
            pair = np.unique((doc[real].astype(np.uint64) << K.U(32)) | at[real].astype(np.uint64))
            sums = np.bincount((pair >> K.U(32)).astype(np.int64), weights[(pair & K.U(0xFFFFFFFF)).astype(np.int64)], j - i)
            score[i:j] = 1 / (1 + np.exp(-np.clip(sums + bias, -35, 35))) if len(names) else 0.0
        yield pa.record_batch([b.column("doc_id"), pa.array(score)], names=["doc_id", "score"])


def score_toxicity(docs: DataFrame, labels: DataFrame, target: str = "toxic", folds: int = 4, held_out: int = 2, sample: int = SAMPLE, threshold: float = 0.3) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    model = train(docs, labelled_sample(labels, target, folds, held_out, sample))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(partial(_score, shared), "doc_id long, score double")
    return scored.select(
        "doc_id", F.coalesce(fold("doc_id", folds) == held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
