"""Substring dedup: removes words covered by a long window that also starts in a document with a smaller id.

Reference shards and suffix automata, dealt by content instead of broadcast to everyone, because the reference is the
corpus itself and has no size bound. Every window of `length` words picks the smallest hash among its GRAM-word grams, so
equal windows pick equally wherever they stand. Consecutive windows with one pick form a run, and a run's words a stretch.

1. Stretches that are equal word for word are collapsed: a grouped minimum of doc_id over (pick, length, two 64-bit hashes)
   names the first document's as the representative; the others' windows all start in that smaller document.
2. Representatives whose pick also has other stretches go, by pick, to a shard. A shard adds stretches in doc_id order to a
   suffix automaton: a document's stretches are streamed through it for matching statistics, windows matched in full are
   covered, and only what is new is added. So the automaton holds earlier documents only, and stays small.
3. A shard of more than SHARD representatives is first dealt again: its windows pick once more, by another hash of their grams,
   so windows that share one common gram and little else part, and equal windows still meet. Its new stretches are collapsed
   and dealt as above, up to LEVELS times.

Then every document's covered words are removed in one pass over its text.

Defined results. Null text: no words. Texts under `length` words stay whole. Equal windows of one document don't remove
each other. Rows of one doc_id are taken to be one document: equal rows get equal answers. Rows without an id stay whole.
Columns to carry travel as one struct, whatever their names. An empty table gives none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylight.llm import kernels as K
from quarrylight.session import settle

GRAM, SHARD, LEVELS = 6, 2048, 8


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """min of x[i:i+width] for every i < len(x) - width + 1."""
    done = 1
    while 2 * done <= width:
        x = np.minimum(x[:-done], x[done:]) if len(x) > done else x[:0]
        done *= 2
    rest = width - done
    return np.minimum(x[:-rest], x[rest:]) if rest and len(x) > rest else x if not rest else x[:0]


_RUN = pa.schema(
    [("doc_id", pa.int64()), ("pick", pa.int64()), ("n", pa.int32()), ("h", pa.int64()), ("h2", pa.int64()), ("start", pa.int32()), ("words", pa.string())]
)
RUN_SCHEMA = "doc_id long, pick long, n int, h long, h2 long, start int, words string"


def _runs(length: int, level: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches of texts (level 0), or those that the stretches (pick, doc_id, start, words) of a large shard fall into."""
    for b in batches:
        ids = b.column("doc_id").to_numpy(zero_copy_only=False)
        picked, starts = (b.column(c).to_numpy(zero_copy_only=False) for c in ("pick", "start")) if level else (None, None)
        for i, j, data, offs in K.text_chunks(b.column("words" if level else "text")):
            w = K.Words(data, offs)
            grams = w.ngrams(GRAM)
            pick = _sliding_min(K.mix(grams + K.U(level)) if level else grams, length - GRAM + 1)
            at = np.flatnonzero(w.inside(length)[: len(pick)])
            if not len(at):
                continue
            doc = w.doc_of[at]
            value = pick[at]
            first = np.ones(len(at), bool)
            first[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
            a = np.flatnonzero(first)
            n = np.diff(np.append(a, len(at))) + length - 1
            start = at[a]
            hashes = []
            for base, powers in ((int(K._C), K._C), (int(K._B), K._B)):  # of words start .. start + n - 1
                sums = np.zeros(len(w.hash) + 1, np.uint64)
                np.cumsum(w.hash * K.powers(base, len(w.hash)), out=sums[1:])
                hashes.append(K.mix((sums[start + n] - sums[start]) * K.powers(K._inverse(base), len(w.hash))[start] + n.astype(np.uint64) * powers))
            value, row = value[a], doc[a]
            place = start - w.docs[row]
            words = pa.nulls(len(a), pa.string())
            if level:
                value = K.mix(picked[i:j][row].astype(np.int64).view(np.uint64) * K._B + value)
                place = place + starts[i:j][row]
                raw = data.tobytes()
                words = pa.array([raw[w.start[x] : w.end[x + m - 1]].decode() for x, m in zip(start.tolist(), n.tolist(), strict=True)], pa.string())
            yield pa.record_batch(
                [pa.array(ids[i:j][row]), pa.array(value.view(np.int64)), pa.array(n.astype(np.int32)), *[pa.array(h.view(np.int64)) for h in hashes], pa.array(place.astype(np.int32)), words], schema=_RUN
            )


class SuffixAutomaton:
    """Of any number of word sequences."""

    def __init__(self) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]

    def _state(self, length: int, link: int, edges: dict[str, int]) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, q: int, word: str) -> int:
        twin = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = twin
        while p != -1 and self.next[p].get(word) == q:
            self.next[p][word] = twin
            p = self.link[p]
        return twin

    def add(self, words: list[str]) -> None:
        last = 0
        for word in words:
            q = self.next[last].get(word)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, q, word)
                continue
            p, new = last, self._state(self.length[last] + 1, 0, {})
            while p != -1 and word not in self.next[p]:
                self.next[p][word] = new
                p = self.link[p]
            if p != -1:
                q = self.next[p][word]
                self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, word)
            last = new

    def matches(self, words: list[str]) -> Iterator[int]:
        """Matching statistics: for each place, the length of the longest suffix ending there that was added."""
        state, n = 0, 0
        for word in words:
            while state and word not in self.next[state]:
                state = self.link[state]
                n = self.length[state]
            if word in self.next[state]:
                state, n = self.next[state][word], n + 1
            yield n


def covered_windows(automaton: SuffixAutomaton, words: list[str], length: int) -> list[bool]:
    return [n >= length for n in automaton.matches(words)][length - 1 :]


def _spans(flags: list[bool], value: bool) -> Iterator[tuple[int, int]]:
    start = None
    for i, f in enumerate([*flags, not value]):
        if f == value and start is None:
            start = i
        elif f != value and start is not None:
            yield start, i
            start = None


_RANGE = pa.schema([("doc_id", pa.int64()), ("start", pa.int32()), ("stop", pa.int32())])


def _shards(length: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (pick, doc_id, start, words) sorted by pick and doc_id; words covered by earlier documents of the pick."""
    pick = doc = None
    automaton, waiting = SuffixAutomaton(), []
    for b in batches:
        out = []
        for p, d, at, text in zip(*(b.column(c).to_pylist() for c in ("pick", "doc_id", "start", "words")), strict=True):
            if p != pick:
                pick, doc, automaton, waiting = p, d, SuffixAutomaton(), []
            if d != doc:
                for words in waiting:
                    automaton.add(words)
                doc, waiting = d, []
            words = text.split(" ")
            flags = covered_windows(automaton, words, length)
            out += [(d, at + a, at + z + length - 1) for a, z in _spans(flags, True)]
            waiting += [words[a : z + length - 1] for a, z in _spans(flags, False)]
        cols = list(zip(*out, strict=True)) or [[]] * 3
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, _RANGE, strict=True)], schema=_RANGE)


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of each asked stretch of a text, one space apart."""
    for b in batches:
        ids, asked = b.column("doc_id").to_numpy(), b.column("asked").to_pylist()
        for i, j, data, offs in K.text_chunks(b.column("text")):
            w = K.Words(data, offs)
            raw = data.tobytes()
            cols = [[], [], [], [], []]
            for r in range(i, j):
                base = w.docs[r - i]
                for a in asked[r]:
                    s = base + a["start"]
                    words = b" ".join(raw[x:y] for x, y in zip(w.start[s : s + a["n"]].tolist(), w.end[s : s + a["n"]].tolist(), strict=True))
                    for c, v in zip(cols, (a["pick"], a["large"], int(ids[r]), a["start"], words.decode()), strict=True):
                        c.append(v)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.string()), strict=True)], names=["pick", "large", "doc_id", "start", "words"])


def covered_ranges(docs: DataFrame, length: int = 50) -> DataFrame:
    """(doc_id, start, stop): word ranges covered by windows that also start in a document with a smaller id."""
    texts = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    key, source, parts = ["pick", "n", "h", "h2"], texts, []
    for level in range(LEVELS):
        runs = source.mapInArrow(partial(_runs, length, level), RUN_SCHEMA)
        runs = settle(runs if level else runs.drop("words"), "runs")
        stretches = runs.groupBy(*key).agg(F.min("doc_id").alias("lead"), F.max("doc_id").alias("_last"))
        picks = stretches.groupBy("pick").agg(F.count(F.lit(1)).alias("kinds"), F.min("lead").alias("_lo"), F.max("_last").alias("_hi"))
        # picks of one document alone decide nothing
        shared = stretches.join(picks.filter(F.col("_lo") != F.col("_hi")).select("pick", "kinds"), "pick").filter((F.col("kinds") > 1) | (F.col("lead") != F.col("_last")))
        marked = runs.join(shared, key).withColumn("sure", F.col("lead") < F.col("doc_id")).filter(F.col("sure") | (F.col("kinds") > 1)).drop("h", "h2", "lead", "_last")
        marks = settle(marked, "marks")
        parts.append(marks.filter("sure").select("doc_id", "start", (F.col("start") + F.col("n")).alias("stop")))
        firsts = marks.filter(~F.col("sure")).withColumn("large", (F.col("kinds") > SHARD) & F.lit(level < LEVELS - 1))
        if not level:
            asked = firsts.groupBy("doc_id").agg(F.collect_list(F.struct("pick", "large", "start", "n")).alias("asked"))
            firsts = settle(texts.join(asked, "doc_id").mapInArrow(_stretches, "pick long, large boolean, doc_id long, start int, words string"), "stretches")
        firsts = firsts.select("pick", "doc_id", "start", "words", "large")
        dealt = firsts.filter(~F.col("large")).drop("large").repartition("pick").sortWithinPartitions("pick", "doc_id", "start")
        parts.append(dealt.mapInArrow(partial(_shards, length), "doc_id long, start int, stop int"))
        source = firsts.filter("large").drop("large")
        if source.isEmpty():
            break
    return reduce(DataFrame.unionByName, parts)


def _cut(text_out: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ranges = b.column("ranges").to_pylist()
        for i, j, data, offs in K.text_chunks(b.column("text")):
            w = K.Words(data, offs)
            raw = data.tobytes()
            removed, digests, texts = [], [], []
            for r in range(i, j):
                a, z = w.docs[r - i], w.docs[r - i + 1]
                keep = np.ones(z - a, bool)
                for x in ranges[r] or ():
                    keep[x["start"] : x["stop"]] = False
                kept = b" ".join(raw[s:e] for s, e in zip(w.start[a:z][keep].tolist(), w.end[a:z][keep].tolist(), strict=True))
                removed.append(int(z - a - keep.sum()))
                digests.append(hashlib.sha256(kept).hexdigest())
                if text_out:
                    texts.append(kept.decode() if removed[-1] else raw[offs[r - i] : offs[r - i + 1]].decode())
            cols = [b.column("doc_id").slice(i, j - i), pa.array(w.counts.astype(np.int64)), pa.array(removed, pa.int64()), pa.array(digests, pa.string())]
            cols += [pa.array(texts, pa.string())] * text_out + [b.column(c).slice(i, j - i) for c in b.schema.names if c == "carried"]
            yield pa.record_batch(cols, names=["doc_id", "n_words", "n_removed", "kept_sha256", *["kept_text"] * text_out, *["carried"] * (len(cols) - 4 - text_out)])


def dedup_substrings(docs: DataFrame, length: int = 50, text_out: bool = False, keep: list[str] | None = None) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, with text_out kept_text, with keep those columns as struct `carried`.

    kept_text is the text itself where nothing was removed, else the kept words one space apart.
    """
    ranges = covered_ranges(docs, length).groupBy("doc_id").agg(F.collect_set(F.struct("start", "stop")).alias("ranges"))
    carried = [F.struct(*[F.col(f"`{c}`") for c in keep]).alias("carried")] if keep else []
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *carried)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())])
    schema = T.StructType([*schema, *[T.StructField("kept_text", T.StringType())] * text_out, *([rows.schema["carried"]] if keep else [])])
    return rows.join(ranges, "doc_id", "left").mapInArrow(partial(_cut, text_out), schema)
