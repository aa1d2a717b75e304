"""SentencePiece encoding and decoding.

`encode_words` is the relational lattice: every distinct word is exploded into its substrings of bounded length, these are
equi-joined to the piece table, the edges are grouped by word, and a higher-order fold turns a word's edges into ids:
Viterbi over end places for unigram models, repeated best merges for BPE models. (For a BPE model Viterbi over piece
scores gives other ids than the model's own, so the merge rule replaces it there. Pieces never span a space, so words are
encoded independently of each other.)

`encode_documents` encodes whole texts: the HOT most frequent words of the corpus go through the lattice, and their ids,
a dictionary of at most HOT entries, are broadcast; the rest, rare words, are folded by the same rule where they occur. No
text is shuffled.

Defined results. Null or empty text: no pieces. Characters without a piece become their UTF-8 bytes' pieces. A space run
keeps every space. A text that has the escape mark U+2581 itself is encoded as if it were a space, as the model does, and
has round_trip false. Very long words use a heap, so a text without spaces is no hazard. Repeated rows give equal rows.
Rows without an id are encoded like any other and keep their null id. An empty table gives none. Other columns of the input,
whatever their names, are not read.
"""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.llm.quality_rules import bound

MARK = "▁"
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
HOT, HOT_CHARS, CACHE = 1 << 17, 24, 200_000


class Model:
    """Pieces of a model: scores and ids of ordinary pieces, ids of bytes, every piece's bytes."""

    def __init__(self, pieces: list[tuple[str, int, float]], byte_ids: list[int] | None = None, unk: int = 0, size: int | None = None):
        self.ids = {p: i for p, i, _ in pieces}
        self.scores = {p: s for p, _, s in pieces}
        self.byte_ids, self.unk = byte_ids, unk
        self.raw = [b""] * (size or max(self.ids.values()) + 1)
        for p, i, _ in pieces:
            self.raw[i] = p.replace(MARK, " ").encode()
        for b, i in enumerate(byte_ids or []):
            self.raw[i] = bytes([b])

    @classmethod
    def load(cls, path: str = DEFAULT_MODEL) -> Model:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        special = lambda i: sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)
        pieces = [(sp.id_to_piece(i), i, sp.get_score(i)) for i in range(sp.get_piece_size()) if not special(i)]
        byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        return cls(pieces, byte_ids if sp.is_byte(byte_ids[0]) else None, sp.unk_id(), sp.get_piece_size())

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(p, self.ids[p], self.scores[p]) for p in self.ids], "piece string, id int, score double")

    def fallback(self, symbol: str) -> list[int]:
        return [self.byte_ids[b] for b in symbol.encode()] if self.byte_ids else [self.unk]

    def encode_word(self, word: str) -> list[int]:
        """Ids of a word by BPE merges: the best-scored adjacent pair first, the leftmost of equals."""
        symbols = list(word) if len(word) < 24 else self._merge_long(word)
        get = self.scores.get
        while len(symbols) > 1:
            best, at, last = None, -1, symbols[0]
            for i in range(1, len(symbols)):
                s = get(last + symbols[i])
                if s is not None and (best is None or s > best):
                    best, at = s, i
                last = symbols[i]
            if best is None:
                break
            symbols[at - 1 : at + 1] = [symbols[at - 1] + symbols[at]]
        out: list[int] = []
        for s in symbols:
            i = self.ids.get(s)
            out += [i] if i is not None else self.fallback(s)
        return out

    def _merge_long(self, word: str) -> list[str]:
        text: list[str | None] = list(word)
        n = len(text)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[tuple[float, int, str, str]] = []

        def offer(i: int, j: int) -> None:
            if 0 <= i and j < n:
                score = self.scores.get(text[i] + text[j])
                if score is not None:
                    heapq.heappush(heap, (-score, i, text[i], text[j]))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if text[i] != a or j >= n or text[j] != b:
                continue
            text[i], text[j], after[i] = a + b, None, after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [s for s in text if s is not None]


def units(text: str) -> Iterator[str]:
    """Words of the escaped text, in order; a newline is a word."""
    for k, line in enumerate(text.split("\n")):
        if k:
            yield "\n"
        parts = line.replace(MARK, " ").split(" ")
        pad = 0
        for n, w in enumerate(parts):
            pad += bool(n) or not k
            if w:
                yield MARK * pad + w
                pad = 0
        if pad:
            yield MARK * pad


# ------------------------------------------------------------------ relational lattice


def _bpe_fold(word: Column, edges: Column) -> Column:
    score = F.map_from_entries(F.transform(edges, lambda e: F.struct(e["piece"], e["score"])))

    def merge(symbols: Column, scores: Column) -> Column:
        options = F.filter(
            F.transform(
                F.sequence(F.lit(1), F.size(symbols) - 1),
                lambda i: F.struct(F.try_element_at(scores, F.concat(F.element_at(symbols, i), F.element_at(symbols, i + 1))).alias("s"), (-i).alias("i")),
            ),
            lambda o: o["s"].isNotNull(),
        )

        def joined(best: Column) -> Column:
            at = -best["i"]
            pair = F.array(F.concat(F.element_at(symbols, at), F.element_at(symbols, at + 1)))
            return F.concat(F.slice(symbols, F.lit(1), at - 1), pair, F.slice(symbols, at + 2, F.size(symbols)))

        best = F.element_at(F.transform(F.array(F.array_max(options)), lambda b: F.when(b.isNull(), symbols).otherwise(joined(b))), 1)
        return F.when(F.size(symbols) < 2, symbols).otherwise(best)

    start = F.filter(F.split(word, ""), lambda c: c != "")
    return bound(score, lambda known: F.aggregate(F.sequence(F.lit(1), F.length(word)), start, lambda acc, _: merge(acc, known)))


def _viterbi_fold(word: Column, edges: Column, unk_score: float) -> Column:
    """Symbols of the best path: state is the best (score, symbols) of every prefix."""

    def extend(best: Column, end: Column) -> Column:
        arriving = F.filter(edges, lambda e: e["start"] + e["n"] - 1 == end)
        ways = F.transform(
            arriving,
            lambda e: F.struct((F.element_at(best, e["start"])["score"] + e["score"]).alias("score"), F.concat(F.element_at(best, e["start"])["symbols"], F.array(e["piece"])).alias("symbols")),
        )
        unknown = F.struct((F.element_at(best, end)["score"] + F.lit(unk_score)).alias("score"), F.concat(F.element_at(best, end)["symbols"], F.array(F.substring(word, end, F.lit(1)))).alias("symbols"))
        return F.concat(best, F.array(F.array_max(F.concat(ways, F.array(unknown)))))

    zero = F.array(F.struct(F.lit(0.0).alias("score"), F.array().cast("array<string>").alias("symbols")))
    return F.element_at(F.aggregate(F.sequence(F.lit(1), F.length(word)), zero, extend), -1)["symbols"]


def encode_words(words: DataFrame, model: Model, unigram: bool = False, unk_score: float = -1e6) -> DataFrame:
    """(word, ids) of the distinct words of words(word). The piece table, as large as the model, is broadcast."""
    longest = max(map(len, model.ids))
    # small words make much work: the number of tasks is set, not left to their bytes
    tasks = 2 * words.sparkSession.sparkContext.defaultParallelism
    distinct = words.filter(F.length("word") > 0).select("word").repartition(tasks, "word").distinct()
    substrings = distinct.select("word", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("start")).select(
        "word", "start", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("word") - F.col("start") + 1))).alias("n")
    )
    pieces = F.broadcast(model.table(words.sparkSession))
    edges = substrings.withColumn("piece", F.substring("word", F.col("start"), F.col("n"))).join(pieces, "piece", "left")
    lattice = edges.groupBy("word").agg(F.collect_list(F.when(F.col("id").isNotNull(), F.struct("start", "n", "piece", "id", "score"))).alias("edges"))
    lattice = lattice.withColumn("edges", F.array_sort("edges"))
    distinct_edges = F.array_distinct(F.transform("edges", lambda e: F.struct(e["piece"], e["score"])))
    fold = _viterbi_fold(F.col("word"), F.col("edges"), unk_score) if unigram else _bpe_fold(F.col("word"), distinct_edges)
    ids = F.map_from_entries(F.array_distinct(F.transform("edges", lambda e: F.struct(e["piece"], e["id"]))))
    if model.byte_ids:
        table = F.array(*[F.lit(i) for i in model.byte_ids])
        code = lambda s: F.transform(F.sequence(F.lit(1), F.octet_length(s)), lambda k: F.element_at(table, F.conv(F.substring(F.hex(F.encode(s, "UTF-8")), 2 * k - 1, F.lit(2)), 16, 10).cast("int") + 1))
    else:
        code = lambda s: F.array(F.lit(model.unk))
    one = lambda s, known: bound(F.try_element_at(known, s), lambda i: F.when(i.isNull(), code(s)).otherwise(F.array(i)))
    listed = bound(ids, lambda known: F.flatten(F.transform("symbols", lambda s: one(s, known))))
    return lattice.select("word", "edges", fold.alias("symbols")).select("word", listed.alias("ids"))


def hot_words(docs: DataFrame, top: int = HOT) -> DataFrame:
    """The `top` most frequent words, counted over the whole corpus, of at most HOT_CHARS characters."""
    words = F.array_remove(F.split(F.coalesce("text", F.lit("")), f"[ \n{MARK}]"), "")
    counted = docs.select(F.explode(words).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    best = counted.filter(F.length("w") <= HOT_CHARS).orderBy(F.col("n").desc(), "w").limit(top)
    return best.select(F.concat(F.lit(MARK), "w").alias("word"))


# ------------------------------------------------------------------ documents

_OUT = pa.schema([("doc_id", pa.int64()), ("n_pieces", pa.int64()), ("ids", pa.list_(pa.int32())), ("round_trip", pa.bool_())])
OUT_SCHEMA = "doc_id long, n_pieces long, ids array<int>, round_trip boolean"


def as_bytes(ids: list[int]) -> bytes:
    return array("i", ids).tobytes()


class Encoder:
    """Encodes texts with the lattice's words and a bounded cache. A word is kept as its int32 ids' bytes, so a text is one join."""

    def __init__(self, model: Model, hot: dict[str, bytes]):
        self.model, self.hot = model, hot
        self.marked, self.bare = {}, {}
        self.newline = as_bytes(model.encode_word("\n"))
        self.raw = pa.array(model.raw, pa.large_binary())

    def _missing(self, known: dict[str, bytes], mark: str, word: str) -> bytes:
        got = (self.hot.get(word) if mark else None) or known.get(word)
        if got is None:
            got = as_bytes(self.model.encode_word(mark + word))
            if len(word) <= 64:
                if len(known) > CACHE:
                    known.clear()
                known[word] = got
        return got

    def decoded(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """(bytes of the pieces of ids one after another, where each id's bytes start, and the end): one take over the pieces' bytes."""
        _, ends, raw = self.raw.take(pa.array(ids)).buffers()
        return (raw.to_pybytes() if raw is not None else b""), np.frombuffer(ends, np.int64)[: len(ids) + 1]

    def encode(self, text: str) -> bytes:
        """int32 ids."""
        text, out = text.replace(MARK, " "), []
        for k, line in enumerate(text.split("\n")) if text else ():
            if k:
                out.append(self.newline)
            words = line.split(" ")
            if "" in words:  # runs of spaces, or a space at an end
                for u in units(line) if not k else units_after_newline(line):
                    mark = MARK if u[0] == MARK else ""
                    out.append(self._missing(self.marked, MARK, u[1:]) if mark and u[1:2] not in ("", MARK) else self._missing(self.bare, "", u))
                continue
            if k:
                out.append(self._missing(self.bare, "", words[0]))
                words = words[1:]
            got = list(map(self.hot.get, words))
            if None in got:
                got = [g if g is not None else self._missing(self.marked, MARK, w) for g, w in zip(got, words, strict=True)]
            out += got
        return b"".join(out)


def units_after_newline(line: str) -> Iterator[str]:
    """Words of a line that isn't the first."""
    pad = 0
    for n, w in enumerate(line.split(" ")):
        pad += bool(n)
        if w:
            yield MARK * pad + w
            pad = 0
    if pad:
        yield MARK * pad


def _encode(shared, rows: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    encoder = Encoder(*shared.value)
    for whole in batches:
        for at in range(0, whole.num_rows, rows):
            b = whole.slice(at, rows)
            texts = [text or "" for text in b.column("text").to_pylist()]
            done = [encoder.encode(text) for text in texts]
            sizes = np.array([len(ids) // 4 for ids in done], np.int64)
            ids, offs = np.frombuffer(b"".join(done), np.int32), np.concatenate(([0], np.cumsum(sizes)))
            raw, ends = encoder.decoded(ids)
            at = ends[offs].tolist()
            # decode() leaves out the first byte, the space before the first word
            same = [raw[i + 1 : j] == text.encode() and raw[i : i + 1] in (b" ", b"") for i, j, text in zip(at[:-1], at[1:], texts, strict=True)]
            lists = pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(ids))
            yield pa.record_batch([b.column("doc_id"), pa.array(sizes), lists, pa.array(same)], schema=_OUT)


def decode(model: Model, ids: list[int]) -> str:
    raw = model.raw
    return b"".join([raw[i] for i in ids]).decode(errors="replace")[1:]


def encode_documents(docs: DataFrame, model_path: str = DEFAULT_MODEL, hot: int = HOT) -> DataFrame:
    """One row per document: doc_id, n_pieces, ids, round_trip (whether decoding gives the text back)."""
    model = Model.load(model_path)
    got = encode_words(hot_words(docs, hot), model).toArrow()
    table = {word[1:]: as_bytes(ids) for word, ids in zip(got["word"].to_pylist(), got["ids"].to_pylist(), strict=True)}
    shared = docs.sparkSession.sparkContext.broadcast((model, table))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(partial(_encode, shared, 256), OUT_SCHEMA)


def decode_documents(encoded: DataFrame, model_path: str = DEFAULT_MODEL) -> DataFrame:
    """(doc_id, text) of encoded(doc_id, ids)."""
    shared = encoded.sparkSession.sparkContext.broadcast(Model.load(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column("doc_id"), pa.array([decode(shared.value, x or []) for x in b.column("ids").to_pylist()], pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
