"""MinHash near-duplicates by an inverted join over signature coordinates, confirmed on full shingle sets.

A document's signature has COORDS MinHash coordinates; each (coordinate, value) pair is a token. A pair of documents of the
similarity asked for agrees in at least T = `match_threshold` coordinates, but for a probability under MISS. So documents are
posted only under their COORDS - T + SHARE rarest tokens (prefix filter: two that agree in T coordinates share SHARE of
these, in whatever order tokens stand, as long as it is one order for all). The order is by how many documents have the
shingle that made the token, read from a count sketch of all documents' shingles: 2**SKETCH_BITS counters, whatever the
input, so it can be broadcast. Hash collisions in it change the order, never the result.

Documents with equal sets are one class; only class representatives are posted. Collisions are then counted and merged:

0. Count: a document that stands in fewer than SHARE posting lists with others can't collide often enough with any, and
   leaves the lists (`peel`).
1. Star: in every posting list each document meets the list's smallest document. Collisions are counted per pair, a document
   keeps the partner it meets in the most lists, and pairs that agree in T coordinates are confirmed. A list of n copies gives
   n - 1 pairs.
2. Skip: a list whose documents are now in one component can't change any component and is skipped. Documents in SHARE or more
   of the other lists, of whatever length, meet by a prefix merge of their shingles, rarest first by the same sketch, which is exact
   (`prefix_pairs`); the pairs that agree in T coordinates are confirmed. So no list makes all its pairs.

Confirmation decides on full sets: 100 * intersection >= percent * union.

Defined results. Null or empty text, or one without words: empty set, never linked. Repeated doc_id rows give a row each
with the same answer if their texts are equal. Rows without an id are never linked: component_id null, kept true. Ties
between partners go to the smaller doc_id. An empty table gives none. Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.llm import kernels as K
from quarrylight.llm.filters import runtime_filters
from quarrylight.llm.graph import components
from quarrylight.session import settle

COORDS, MISS, SHARE, SKETCH_BITS = 64, 1e-6, 12, 18
_RNG = np.random.Generator(np.random.PCG64(20_240_501))
_A = _RNG.integers(0, 1 << 63, COORDS, np.uint64) * K.U(2) + K.U(1)
_ADD = _RNG.integers(0, 1 << 63, COORDS, np.uint64)
_A_INVERSE = np.array([pow(int(a), -1, 1 << 64) for a in _A], np.uint64)


def match_threshold(similarity: float, miss: float = MISS, coords: int = COORDS) -> int:
    """The most agreements that a pair of this similarity has with probability over 1 - miss."""
    below, t = 0.0, 0
    while (below := below + comb(coords, t) * similarity**t * (1 - similarity) ** (coords - t)) < miss:
        t += 1
    return t


def agreements(a: Column, b: Column) -> Column:
    """How many of COORDS bytes, packed eight a long, are equal."""
    unequal = []
    for i in range(COORDS // 8):
        x = a[i].bitwiseXOR(b[i])
        for shift in (1, 2, 4):
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
        unequal.append(F.bit_count(x.bitwiseAND(F.lit(0x0101010101010101))))
    return F.lit(COORDS) - reduce(lambda x, y: x + y, unequal)


def shingle_sets(data: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): document i's set is the sorted hashes[bounds[i]:bounds[i+1]]."""
    w = K.Words(data, offs, K.SPACE, lower=True)
    n = w.counts
    grams, inside = w.ngrams(k), w.inside(k)
    sizes = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    at = np.concatenate(([0], np.cumsum(sizes)))
    out = np.empty(at[-1], np.uint64)
    full = np.repeat(n >= k, sizes)
    out[full] = grams[inside]
    for i in np.flatnonzero((n > 0) & (n < k)):  # the whole sequence is the one shingle
        h = n[i : i + 1].astype(np.uint64)
        for x in w.hash[w.docs[i] : w.docs[i + 1]]:
            h = K.mix(h * K._B + x)
        out[at[i]] = h[0]
    for i in range(len(n)):
        out[at[i] : at[i + 1]].sort()
    keep = np.ones(len(out), bool)
    keep[1:] = out[1:] != out[:-1]
    keep[at[:-1][sizes > 0]] = True
    return out[keep], np.concatenate(([0], np.cumsum(keep)))[at]


# ------------------------------------------------------------------ count sketch

_CHUNK = 1 << 10


def _count_shingles(k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's counters, in chunks."""
    counts, mask = np.zeros(1 << SKETCH_BITS, np.uint32), K.U((1 << SKETCH_BITS) - 1)
    for b in batches:
        for _, _, data, offs in K.text_chunks(b.column("text")):
            counts += np.bincount(shingle_sets(data, offs, k)[0] & mask, minlength=len(counts)).astype(np.uint32)
    for i in range(0, len(counts), _CHUNK):
        if counts[i : i + _CHUNK].any():
            yield pa.record_batch([pa.array([i], pa.int32()), pa.array([counts[i : i + _CHUNK].tobytes()])], names=["start", "counts"])


def _add_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for start, counts in zip(b.column("start").to_pylist(), b.column("counts").to_pylist(), strict=True):
            sums[start] = sums.get(start, 0) + np.frombuffer(counts, np.uint32).astype(np.uint64)
    rows = [(i, np.minimum(x, K.U(0xFFFFFFFF)).astype(np.uint32).tobytes()) for i, x in sums.items()]
    yield pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["start", "counts"])


def shingle_sketch(docs: DataFrame, k: int) -> np.ndarray:
    """How many documents have the shingles of each hash class. Tasks send their counters, not their shingles."""
    per_task = docs.select("text").mapInArrow(partial(_count_shingles, k), "start int, counts binary")
    got = per_task.repartition("start").mapInArrow(_add_counts, "start int, counts binary").toArrow()
    counts = np.zeros(1 << SKETCH_BITS, np.uint32)
    for start, x in zip(got["start"].to_pylist(), got["counts"].to_pylist(), strict=True):
        counts[start : start + _CHUNK] = np.frombuffer(x, np.uint32)
    return counts


# ------------------------------------------------------------------ signatures

_SIG = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("posts", pa.list_(pa.int64())), ("packed", pa.list_(pa.int64()))])


def _signatures(k: int, threshold: int, sketch, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    mask, prefix = K.U((1 << SKETCH_BITS) - 1), min(COORDS, COORDS - threshold + SHARE)
    for b in batches:
        for i, j, data, offs in K.text_chunks(b.column("text")):
            sets, at = shingle_sets(data, offs, k)
            some = np.flatnonzero(np.diff(at) > 0)
            sums = [np.zeros(j - i, np.uint64) for _ in range(2)]
            tokens = np.zeros((len(some), COORDS), np.uint64)
            often = np.zeros((len(some), COORDS), np.uint32)
            coords = np.zeros((len(some), COORDS), np.uint8)
            if len(some):
                starts = at[:-1][some]
                for t, salt in enumerate((K._B, K._C)):
                    sums[t][some] = np.add.reduceat(K.mix(sets * salt), starts)
                for r in range(COORDS):
                    least = np.minimum.reduceat(sets * _A[r] + _ADD[r], starts)
                    often[:, r] = sketch.value[((least - _ADD[r]) * _A_INVERSE[r]) & mask]
                    tokens[:, r] = K.mix(least * K._B + K.U(r))
                    coords[:, r] = K.mix(least) & K.U(255)
            by_token = np.argsort(tokens, axis=1)
            tokens, often = np.take_along_axis(tokens, by_token, 1), np.take_along_axis(often, by_token, 1)
            posts = np.take_along_axis(tokens, np.argsort(often, axis=1, kind="stable")[:, :prefix], 1)
            lists = []
            for values in (posts.view(np.int64), coords.view(np.int64)):
                ends = np.cumsum(np.where(np.diff(at) > 0, values.shape[1], 0))
                lists.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(values.ravel())))
            yield pa.record_batch(
                [b.column("doc_id").slice(i, j - i), pa.array(np.diff(at).astype(np.int64)), *[pa.array(s.view(np.int64)) for s in sums], *lists], schema=_SIG
            )


def signatures(docs: DataFrame, k: int, threshold: int, sketch) -> DataFrame:
    """doc_id, n_shingles, two hashes of the set, its rarest tokens and its coordinates, a byte each."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(partial(_signatures, k, threshold, sketch), "doc_id long, n_shingles long, s1 long, s2 long, posts array<long>, packed array<long>")


_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("shared", pa.int64()), ("total", pa.int64())])


def _confirm(k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, part, own, doc_id, text) sorted so that a's own text comes first in each (a, part)."""
    group, lead = None, None
    for b in batches:
        a, part, own, doc = (b.column(c).to_numpy(zero_copy_only=False) for c in ("a", "part", "own", "doc_id"))
        out = []
        for i, j, data, offs in K.text_chunks(b.column("text")):
            sets, at = shingle_sets(data, offs, k)
            for r in range(i, j):
                s = sets[at[r - i] : at[r - i + 1]]
                if own[r] == 0:
                    group, lead = (a[r], part[r]), s.copy()
                elif group == (a[r], part[r]):
                    shared = len(np.intersect1d(lead, s, assume_unique=True))
                    out.append((a[r], doc[r], shared, len(lead) + len(s) - shared))
        cols = list(zip(*out, strict=True)) or [[]] * 4
        yield pa.record_batch([pa.array(c, pa.int64()) for c in cols], schema=_LINK)


def confirm(docs: DataFrame, pairs: DataFrame, k: int, percent: int, part_size: int = 256) -> DataFrame:
    """The pairs(a, b) with 100 * shared >= percent * total, decided on full sets.

    b's text travels to a; texts of neither never leave the scan (runtime Bloom filter). A document with many partners is dealt over parts of about part_size of them, each with a copy
    of its text, and a part streams through a task: no group is gathered.
    """
    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / part_size).cast("int").alias("_parts"))
    own = parts.select(F.col("a"), F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("part"), F.lit(0).alias("own"), F.col("a").alias("_id"))
    rest = pairs.join(parts, "a").select("a", F.pmod(F.hash("b"), F.col("_parts")).alias("part"), F.lit(1).alias("own"), F.col("b").alias("_id"))
    asked = settle(own.unionByName(rest), "sent").filter(F.col("own") >= 0)  # a filtered scan: lets the optimizer make a Bloom filter of it
    sent = asked.join(docs.select("doc_id", "text"), F.col("_id") == F.col("doc_id")).select("a", "part", "own", "doc_id", "text")
    met = sent.repartition("a", "part").sortWithinPartitions("a", "part", "own").mapInArrow(partial(_confirm, k), "a long, b long, shared long, total long")
    with runtime_filters(docs.sparkSession):
        return settle(met.filter(F.lit(100) * F.col("shared") >= F.lit(percent) * F.col("total")), "links")


def _rarest(k: int, percent: int, sketch, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A set's first shingles in the sketch's order that can be the first one shared with a set as similar as asked for."""
    mask = K.U((1 << SKETCH_BITS) - 1)
    for b in batches:
        ids, comps = (b.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "component"))
        for i, j, data, offs in K.text_chunks(b.column("text")):
            sets, at = shingle_sets(data, offs, k)
            n = np.diff(at)
            doc = np.repeat(np.arange(j - i), n)
            order = np.lexsort((sets, sketch.value[sets & mask], doc))
            h, place = sets[order], np.arange(len(sets)) - at[doc] + 1
            size = n[doc]
            probe = place <= size - -(-size * percent // 100) + 1
            short = place <= size - -(-size * 2 * percent // (100 + percent)) + 1
            d = doc[probe]
            yield pa.record_batch(
                [pa.array(ids[i:j][d]), pa.array(comps[i:j][d]), pa.array(size[probe].astype(np.int32)), pa.array(h[probe].view(np.int64)), pa.array(place[probe].astype(np.int32)), pa.array(short[probe])],
                names=["doc_id", "component", "n", "h", "place", "short"],
            )


def prefix_pairs(docs: DataFrame, crowd: DataFrame, k: int, percent: int, sketch) -> DataFrame:
    """Pairs of crowd(doc_id, component) across components that can reach the similarity: an exact prefix merge of shingles.

    A pair that reaches the similarity shares one of the shorter set's first n - 2pn/(1+p) + 1 shingles and the longer
    set's first n - pn + 1, in any one order of shingles. Rarest first, copies of one text with edits of their own have
    shingles of their own there and meet nobody, so a large crowd of them makes no pairs.
    """
    rows = docs.select("doc_id", "text").join(crowd, "doc_id").mapInArrow(partial(_rarest, k, percent, sketch), "doc_id long, component long, n int, h long, place int, short boolean")
    heads = settle(rows, "heads")
    x, y = (heads.select(F.col("h").alias(f"h{t}"), F.col("doc_id").alias(f"d{t}"), F.col("component").alias(f"c{t}"), F.col("n").alias(f"n{t}"), F.col("place").alias(f"p{t}"), F.col("short").alias(f"s{t}")) for t in "xy")
    order = (F.col("nx") < F.col("ny")) | ((F.col("nx") == F.col("ny")) & (F.col("dx") < F.col("dy")))
    fits = F.lit(100) * F.col("nx") >= F.lit(percent) * F.col("ny")
    # at the first shingle that both have, what is left of the shorter rest must still make up the overlap
    left = F.least(F.col("nx") - F.col("px"), F.col("ny") - F.col("py")) + 1
    reach = left * (100 + percent) >= F.lit(percent) * (F.col("nx") + F.col("ny"))
    met = x.filter("sx").join(y, (F.col("hx") == F.col("hy")) & (F.col("cx") != F.col("cy")) & order & fits & reach)
    return met.select(F.least("dx", "dy").alias("a"), F.greatest("dx", "dy").alias("b")).distinct()


def alike(pairs: DataFrame, reps: DataFrame, threshold: int) -> DataFrame:
    """The pairs(a, b) whose signatures agree in at least `threshold` coordinates."""
    for side in "ab":
        pairs = pairs.join(reps.select(F.col("doc_id").alias(side), F.col("packed").alias(f"_{side}")), side)
    return pairs.filter(agreements(F.col("_a"), F.col("_b")) >= threshold).select("a", "b")


def peel(posted: DataFrame) -> DataFrame:
    """Of posted(doc_id, token) what is in lists of two documents or more, with the list's smallest as a; documents with SHARE such rows or more."""
    lists = posted.groupBy("token").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("_last")).filter(F.col("a") < F.col("_last"))
    shared = posted.join(lists.select("token", "a"), "token").groupBy("doc_id").agg(F.collect_list(F.struct("token", "a")).alias("_t"))  # at most COORDS a document
    return settle(shared.filter(F.size("_t") >= SHARE).select("doc_id", F.explode("_t").alias("_t")).select("doc_id", "_t.*"), "postings")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    threshold = match_threshold(percent / 100)
    sketch = docs.sparkSession.sparkContext.broadcast(shingle_sketch(docs, k))
    sig = settle(signatures(docs, k, threshold, sketch), "signatures")
    classes = sig.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()).groupBy("n_shingles", "s1", "s2").agg(F.min("doc_id").alias("rep"))
    own = F.col("rep") == F.col("doc_id")
    member = settle(
        sig.join(classes, ["n_shingles", "s1", "s2"], "left").select(
            "doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("rep"), F.when(own, F.col("posts")).alias("posts"), F.when(own, F.col("packed")).alias("packed")
        ),
        "members",
    )
    reps = member.filter(F.col("posts").isNotNull()).select("doc_id", "posts", "packed").dropDuplicates(["doc_id"])
    posted = reps.select("doc_id", F.explode("posts").alias("token"))

    # 0. count: tokens of one document alone, and documents without enough others, end here
    shared = peel(peel(posted).select("doc_id", "token"))

    # 1. star
    met = shared.filter(F.col("a") < F.col("doc_id")).groupBy("doc_id", "a").agg(F.count(F.lit(1)).alias("n"))
    best = met.groupBy("doc_id").agg(F.max(F.struct("n", (-F.col("a")).alias("_a"))).alias("m"))
    tried = settle(alike(best.select((-F.col("m._a")).alias("a"), F.col("doc_id").alias("b")), reps, threshold), "star")
    links = confirm(docs, tried, k, percent).select("a", "b")
    joined = components(links)

    # 2. lists across components
    labelled = shared.join(joined, F.col("doc_id") == F.col("node"), "left").select("token", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    mixed = labelled.groupBy("token").agg(F.min("component").alias("_lo"), F.max("component").alias("_hi")).filter(F.col("_lo") != F.col("_hi"))
    meets = labelled.join(mixed.select("token"), "token").groupBy("doc_id", "component").agg(F.count(F.lit(1)).alias("n"))
    crowd = settle(meets.filter(F.col("n") >= SHARE).select("doc_id", "component"), "crowd")
    more = prefix_pairs(docs, crowd, k, percent, sketch).join(tried, ["a", "b"], "left_anti")
    found = confirm(docs, settle(alike(more, reps, threshold), "rest"), k, percent).select("a", "b")
    if not found.isEmpty():
        joined = components(links.unionByName(found))

    top = member.join(joined.select(F.col("node").alias("rep"), "component"), "rep", "left")
    named = F.col("doc_id").isNotNull()
    return top.select("doc_id", "n_shingles", F.when(named, F.coalesce("component", "rep")).alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
