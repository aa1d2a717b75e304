"""Quality classifier: a generalised additive model with pairwise interactions (GA2M).

Every text gets FEATURES statistics. Their values are cut into bins at quantiles of the training sample. Training goes
round the features in turn; each step fits a shallow tree (at most LEAVES leaves) to the current gradients over the
feature's bins and adds it, scaled by RATE, to that feature's lookup table. The PAIRS strongest interactions, by the
squared gradient that a coarse two-way table still explains, are then boosted the same way on two-way tables. A score is
the logistic of a sum of table entries: one vectorised look-up and addition per table.

Training reads at most SAMPLE labelled documents' statistics, in one task, from the statistics that scoring uses. The
model (tables of at most BINS and PAIR_BINS**2 entries) is broadcast.

Defined results. Null or empty text: statistics of an empty text, scored like any other. Without a training row every
score is 0. Rows without an id are scored, and are not held out. Repeated rows are scored each; ties do not matter. Very long
texts count whole. Other columns of the input are not read. An empty table gives none.
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
from quarrylight.session import settle

SAMPLE = 16_000
BINS, PAIR_BINS, PAIRS, LEAVES, ROUNDS, PAIR_ROUNDS, RATE = 32, 8, 6, 3, 120, 40, 0.1
FEATURES = (
    "log_words", "word_bytes", "long_words", "short_words", "upper", "title_words", "upper_words", "digits", "symbols", "bangs",
    "stops", "commas", "punctuation", "non_ascii", "spaces", "lines", "distinct_words", "top_repeat", "adjacent_repeat",
    "distinct_pairs", "distinct_triples", "word_end_symbols", "length_spread",
)


def _class(chars: bytes) -> np.ndarray:
    t = np.zeros(256, np.int64)
    t[list(chars)] = 1
    return t


_UPPER, _DIGIT = _class(bytes(range(65, 91))), _class(b"0123456789")
_SYMBOL, _BANG, _STOP, _COMMA, _NEWLINE, _BLANK = _class(b"#*$%&|<>@^~_=+{}[]\\/"), _class(b"!?"), _class(b"."), _class(b",;:"), _class(b"\n"), _class(b" \t\n\x0b\x0c\r")
_PUNCT, _WIDE = _class(b".,;:!?'\"()-"), _class(bytes(range(128, 256)))


def _distinct(values: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values, most frequent value's count) of each document; doc ascending."""
    out, top = np.zeros(n), np.zeros(n)
    if not len(values):
        return out, top
    order = np.lexsort((values, doc))
    v, d = values[order], doc[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (d[1:] != d[:-1])
    at = np.flatnonzero(new)
    runs = np.diff(np.append(at, len(v)))
    out = np.bincount(d[at], minlength=n).astype(float)
    np.maximum.at(top, d[at], runs)
    return out, top


def statistics(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """One row of FEATURES per text."""
    w = K.Words(data, offs)
    n_docs, n, size = len(offs) - 1, w.counts.astype(float), np.maximum(np.diff(offs), 1).astype(float)
    some = np.maximum(n, 1)
    length = (w.end - w.start).astype(np.int64)
    share = lambda table: K.sums_by_doc(table[data], offs) / size
    per_word = lambda flags: K.sums_by_doc(flags.astype(np.int64), w.docs) / some
    up = np.concatenate(([0], np.cumsum(_UPPER[data])))
    uppers = up[w.end] - up[w.start]
    h, doc = w.hash, w.doc_of
    words, top = _distinct(h, doc, n_docs)
    rows = {
        "log_words": np.log1p(n), "word_bytes": K.sums_by_doc(length, w.docs) / some, "long_words": per_word(length > 12), "short_words": per_word(length < 3),
        "upper": share(_UPPER), "title_words": per_word(_UPPER[data[w.start]] > 0) if len(w.start) else n * 0, "upper_words": per_word((uppers > 1) & (2 * uppers > length)),
        "digits": share(_DIGIT), "symbols": share(_SYMBOL), "bangs": share(_BANG), "stops": share(_STOP), "commas": share(_COMMA), "punctuation": share(_PUNCT),
        "non_ascii": share(_WIDE), "spaces": share(_BLANK), "lines": K.sums_by_doc(_NEWLINE[data], offs) / some, "distinct_words": words / some, "top_repeat": top / some,
        "word_end_symbols": per_word((_SYMBOL[data[w.end - 1]] + _BANG[data[w.end - 1]]) > 0) if len(w.end) else n * 0,
    }
    squares = K.sums_by_doc(length * length, w.docs) / some
    rows["length_spread"] = np.sqrt(np.maximum(squares - rows["word_bytes"] ** 2, 0))
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    rows["adjacent_repeat"] = per_word(same)
    for k, name in ((2, "distinct_pairs"), (3, "distinct_triples")):
        inside = w.inside(k)
        d = doc[: len(inside)][inside]
        count = np.bincount(d, minlength=n_docs)
        rows[name] = np.where(count > 0, _distinct(w.ngrams(k)[inside], d, n_docs)[0] / np.maximum(count, 1), 1.0)
    return np.column_stack([rows[f] for f in FEATURES]).astype(np.float32)


def _list_rows(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i, j, data, offs in K.text_chunks(b.column("text")):
            yield pa.record_batch([b.column("doc_id").slice(i, j - i), _list_rows(statistics(data, offs))], names=["doc_id", "x"])


def describe(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_describe, "doc_id long, x array<float>")


def _tree(grad: np.ndarray, hess: np.ndarray) -> np.ndarray:
    """Values per bin of the best tree of at most LEAVES leaves over ordered bins."""
    g, h = np.concatenate(([0], np.cumsum(grad))), np.concatenate(([0], np.cumsum(hess)))
    gain = lambda a, b: (g[b] - g[a]) ** 2 / (h[b] - h[a] + 1.0)
    cuts = [0, len(grad)]
    for _ in range(LEAVES - 1):
        best = (1e-9, 0)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            at = np.arange(a + 1, b)
            if len(at):
                gains = gain(a, at) + gain(at, b) - gain(a, b)
                best = max(best, (float(gains.max()), int(at[gains.argmax()])))
        if not best[1]:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.zeros(len(grad))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + 1.0)
    return out


def fit(x: np.ndarray, y: np.ndarray) -> dict:
    """The model: bias, edges per feature, tables per feature, pairs and their tables."""
    n, m = x.shape
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(m)]
    bins = np.column_stack([np.searchsorted(edges[f], x[:, f], "right") for f in range(m)])
    rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    bias = float(np.log(rate / (1 - rate)))
    raw = np.full(n, bias)
    tables = [np.zeros(len(e) + 1) for e in edges]

    def slopes():
        p = 1 / (1 + np.exp(-raw))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(ROUNDS):
        for f in range(m):
            g, h = slopes()
            size = len(tables[f])
            step = RATE * _tree(np.bincount(bins[:, f], g, size), np.bincount(bins[:, f], h, size))
            tables[f] += step
            raw += step[bins[:, f]]
    coarse = bins * PAIR_BINS // np.array([len(t) for t in tables])
    g, h = slopes()
    strength = []
    for a in range(m):
        for b in range(a):
            cell = coarse[:, a] * PAIR_BINS + coarse[:, b]
            sums, weight = np.bincount(cell, g, PAIR_BINS**2), np.bincount(cell, h, PAIR_BINS**2)
            strength.append((float((sums**2 / (weight + 1.0)).sum()), a, b))
    pairs = [(a, b) for _, a, b in sorted(strength, reverse=True)[:PAIRS]]
    pair_tables = [np.zeros(PAIR_BINS**2) for _ in pairs]
    for _ in range(PAIR_ROUNDS):
        for k, (a, b) in enumerate(pairs):
            g, h = slopes()
            cell = coarse[:, a] * PAIR_BINS + coarse[:, b]
            grid_g, grid_h = (np.bincount(cell, v, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS) for v in (g, h))
            # a shallow tree: cut the first feature once, then the second on either side
            best, step = -1.0, None
            for cut in range(1, PAIR_BINS):
                halves = [_tree(grid_g[s].sum(0), grid_h[s].sum(0)) for s in (slice(0, cut), slice(cut, None))]
                gain = sum(float((grid_g[s].sum(0) * v).sum()) for s, v in zip((slice(0, cut), slice(cut, None)), halves, strict=True))
                if gain > best:
                    best, step = gain, np.vstack([np.tile(halves[0], (cut, 1)), np.tile(halves[1], (PAIR_BINS - cut, 1))])
            pair_tables[k] += RATE * step.ravel()
            raw += RATE * step.ravel()[cell]
    return {"bias": bias, "edges": edges, "tables": tables, "pairs": pairs, "pair_tables": pair_tables}


def predict(model: dict, x: np.ndarray) -> np.ndarray:
    bins = np.column_stack([np.searchsorted(e, x[:, f], "right") for f, e in enumerate(model["edges"])])
    raw = np.full(len(x), model["bias"])
    for f, t in enumerate(model["tables"]):
        raw += t[bins[:, f]]
    coarse = bins * PAIR_BINS // np.array([len(t) for t in model["tables"]])
    for (a, b), t in zip(model["pairs"], model["pair_tables"], strict=True):
        raw += t[coarse[:, a] * PAIR_BINS + coarse[:, b]]
    return 1 / (1 + np.exp(-raw))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(FEATURES))


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import pickle

    parts = [(b.column("doc_id").to_numpy(), _matrix(b.column("x")), b.column("y").to_numpy()) for b in batches if b.num_rows]
    if parts:
        ids, x, y = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.argsort(ids, kind="stable")
        yield pa.record_batch([pa.array([pickle.dumps(fit(x[order], y[order]))])], names=["model"])


def _score(model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        score = predict(model.value, _matrix(b.column("x"))) if model.value else np.zeros(b.num_rows)
        yield pa.record_batch([b.column("doc_id"), pa.array(score)], names=["doc_id", "score"])


def score_quality(docs: DataFrame, labels: DataFrame, target: str = "quality", folds: int = 5, held_out: int = 0, sample: int = SAMPLE, threshold: float = 0.3) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    import pickle

    stats = settle(describe(docs), "quality-statistics")
    rows = stats.join(F.broadcast(labelled_sample(labels, target, folds, held_out, sample)), "doc_id").dropDuplicates(["doc_id"])
    models = rows.repartition(1).mapInArrow(_fit, "model binary").collect()
    model = docs.sparkSession.sparkContext.broadcast(pickle.loads(models[0]["model"]) if models else None)
    scored = stats.mapInArrow(partial(_score, model), "doc_id long, score double")
    return scored.select(
        "doc_id", F.coalesce(fold("doc_id", folds) == held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
