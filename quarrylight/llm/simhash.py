"""SimHash near-duplicates: 64-bit fingerprints, compared exactly in tiles with exclusive-or and bit counts.

A fingerprint's bit is 1 if it is set in over half of the XXH64 values (seed 42) of the text's shingles, repeats included.
Equal fingerprints are one; what follows works on distinct ones, so a text copied a million times is compared once.

Tiles. Two fingerprints within the radius have population counts that differ by no more, in whole and summed over any cut into
pieces. So fingerprints are classed by the population counts of SUBWORDS pieces (at most 17^4 classes, whatever the input), a
class is dealt over tiles of about TILE fingerprints, and only tiles of classes whose counts differ by the radius or less in
all are compared: 1.6 % of all pairs for random fingerprints, where one count for the whole word would leave 34 %. Every pair of
tiles meets once: fingerprints visit the tiles of classes that come behind theirs, and the smaller tiles of their own. A task
holds one tile and streams its visitors, so no class is gathered. Of the links that a step of a tile finds only a spanning forest
is returned, so a crowd of near copies does not return its pairs; reachability, all that components ask for, is the same.

Defined results. Null or empty text, or one without words: fingerprint zero, linked like any other. Under k words: the whole
sequence is the one shingle. Repeated rows and rows of one doc_id count each by itself. Rows without an id have a fingerprint,
link nothing, and their component_id is null. Ties can't occur: the smallest id names a component. An empty table gives none.
Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.llm import kernels as K
from quarrylight.llm.graph import components
from quarrylight.session import settle

SEED, SUBWORDS, TILE = 42, 4, 1 << 15
#: comparisons done at once, and shingles whose bits are counted at once
STEP, BITS = 1 << 21, 1 << 16
_LOWER = bytes(K.LOWER)


# ------------------------------------------------------------------ fingerprints


def shingle_hashes(text: bytes, k: int) -> np.ndarray:
    """XXH64 of every k-word shingle of a text, joined by single spaces; of all words where there are fewer."""
    words = text.translate(_LOWER).split()  # bytes.split() parts at \x20 and \x09-\x0D
    if not words:
        return np.zeros(0, np.uint64)
    joined, n = b" ".join(words), max(1, len(words) - k + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    last = ends[min(k, len(words)) - 1 :].tolist()
    return np.fromiter((digest(joined[i:j], SEED) for i, j in zip(starts[:n].tolist(), last, strict=True)), np.uint64, n)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), BITS):
        ones += np.unpackbits(hashes[i : i + BITS].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def _fingerprints(k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column("text").cast(pa.large_binary())
        prints = np.fromiter((majority(shingle_hashes(t.as_py() or b"", k)) for t in texts), np.uint64, len(texts))
        yield pa.record_batch([b.column("doc_id"), pa.array(prints.view(np.int64))], names=["doc_id", "fingerprint"])


def fingerprints(docs: DataFrame, k: int = 3) -> DataFrame:
    """(doc_id, fingerprint), a row per row; the fingerprint's 64 bits as a long."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(partial(_fingerprints, k), "doc_id long, fingerprint long")


# ------------------------------------------------------------------ tiles

_DIGIT = 32  # a class is written in this base; population counts of a piece, radius added, stay below


def _class(value: Column, radius: int) -> Column:
    width = 64 // SUBWORDS
    counts = [F.bit_count(F.shiftrightunsigned(value, i * width).bitwiseAND(F.lit((1 << width) - 1))) + radius for i in range(SUBWORDS)]
    return reduce(lambda a, c: a * _DIGIT + c, counts).cast("int")


def _steps(radius: int) -> list[int]:
    """From a class to those behind it whose counts differ by at most the radius in all."""
    around = [d for d in product(range(-radius, radius + 1), repeat=SUBWORDS) if sum(map(abs, d)) <= radius]
    return sorted(s for s in (reduce(lambda a, c: a * _DIGIT + c, d) for d in around) if s > 0)


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(smallest node, node) for every other node of each component of the links a-b."""
    nodes, place = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    root = np.arange(len(nodes))
    while True:
        new, low = root.copy(), np.minimum(root[x], root[y])
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    other = root != np.arange(len(nodes))
    return nodes[root[other]], nodes[other]


def links(tile: np.ndarray, visitors: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Spanning links between a tile and its visitors, a step of STEP comparisons after the other."""
    width = max(1, STEP // max(1, len(tile)))
    for i in range(0, len(visitors), width):
        part = visitors[i : i + width]
        differ = (tile[:, None] ^ part[None, :]).view(np.uint64)  # bit counts of signed integers would be those of their magnitude
        x, y = np.nonzero(np.bitwise_count(differ) <= radius)
        apart = tile[x] != part[y]
        if apart.any():
            yield spanning(tile[x[apart]], part[y[apart]])


def _compare(radius: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (class, tile, visits, fingerprint) sorted so that a tile's own fingerprints come before its visitors."""
    group, own = None, np.zeros(0, np.int64)
    for b in batches:
        cls, tile, visits, value = (b.column(c).to_numpy(zero_copy_only=False) for c in ("class", "tile", "visits", "fingerprint"))
        change = (cls[1:] != cls[:-1]) | (tile[1:] != tile[:-1]) | (visits[1:] != visits[:-1])
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), len(cls)] if len(cls) else []
        found = []
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            if group != (cls[i], tile[i]):
                group, own = (cls[i], tile[i]), np.zeros(0, np.int64)
            part = value[i:j]
            if not visits[i]:
                own = np.concatenate((own, part))
            found += links(own, part, radius)
        for r in range(0, len(found), 1024):
            a, c = (np.concatenate(x) for x in zip(*found[r : r + 1024], strict=True))
            yield pa.record_batch([pa.array(a), pa.array(c)], names=["a", "b"])


def near_fingerprints(distinct: DataFrame, radius: int = 2, tile: int = TILE) -> DataFrame:
    """Links (a, b) over settled distinct(fingerprint) that connect whatever lies within the radius."""
    rows = distinct.select("fingerprint", _class(F.col("fingerprint"), radius).alias("class"))
    # at most 17^SUBWORDS rows, whatever the input
    tiles = F.broadcast(rows.groupBy("class").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("_tiles")))
    home = rows.join(tiles, "class").withColumn("tile", F.pmod(F.hash("fingerprint"), F.col("_tiles")))
    upto = lambda last: F.explode(F.sequence(F.lit(0), last - 1)).alias("tile")
    own = home.select("class", "tile", F.lit(0).alias("visits"), "fingerprint")
    earlier = home.filter("tile > 0").select("class", upto(F.col("tile")), F.lit(1).alias("visits"), "fingerprint")
    behind = rows.select("fingerprint", F.explode(F.array(*map(F.lit, _steps(radius)))).alias("_step"), "class")
    behind = behind.select("fingerprint", (F.col("class") + F.col("_step")).alias("class")).join(tiles, "class")
    behind = behind.select("class", upto(F.col("_tiles")), F.lit(1).alias("visits"), "fingerprint")
    met = own.unionByName(earlier).unionByName(behind).repartition("class", "tile").sortWithinPartitions("class", "tile", "visits")
    return met.mapInArrow(partial(_compare, radius), "a long, b long")


def simhash_groups(docs: DataFrame, k: int = 3, radius: int = 2, tile: int = TILE) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id."""
    prints = settle(fingerprints(docs, k), "fingerprints")
    named = F.col("doc_id").isNotNull()
    distinct = settle(prints.filter(named).groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "distinct")
    found = components(near_fingerprints(distinct, radius, tile)).select(F.col("node").alias("fingerprint"), "component")
    grouped = distinct.join(found, "fingerprint", "left").select("fingerprint", "least", F.coalesce("component", "fingerprint").alias("component"))
    first = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    of_print = settle(grouped.join(first, "component").select("fingerprint", "component_id"), "groups")
    out = prints.join(of_print, "fingerprint", "left")
    digits = F.lower(F.lpad(F.hex("fingerprint"), 16, "0"))
    return out.select("doc_id", digits.alias("fingerprint"), F.when(named, F.col("component_id")).alias("component_id"))
