"""Benchmark decontamination by template canonicalisation.

Words become template tokens: numbers, units after a number, and names (capitalised words inside a sentence) are typed
placeholders, other words stand for themselves in lower case. Windows of WINDOW template tokens of the documents are
hash-joined to those of the benchmark items. Matches of one item on one diagonal (place in document minus place in item)
are one placement; it counts if at least min(NEED, the item's windows) of the item's windows match (NEED windows of
WINDOW tokens are 13 words) and its placeholders' values map one to one between item and document. So a question whose
numbers, names or units were exchanged consistently is caught, and one that only shares the template is not.

Items travel as a table of windows that is joined by hash; a bitmap of at most 2**BITMAP_BITS bits, whatever the size of
the benchmark, keeps documents' other windows from leaving the scan.

Windows with fewer than MIN_LITERAL literal words share only a template and are no evidence. An item with at most NEED other
windows (short, made of numbers or names, or without spaces) also gets one exact window: all its tokens as they are, in lower
case, where signs of arithmetic and characters of three or more bytes (Chinese, Japanese, Thai) are tokens each. So a verbatim
copy of any item is found. (With more windows the template finds it: only the first token's type depends on what is before.)

Defined results. Null or empty text: not contaminated. Items of fewer than WINDOW tokens are one window of their own
length. An item of one word is found in every document with that word; one without a token is never found. Repeated items are found each. Repeated documents get a row each.
Documents or items without an id are not searched: there is no id to name them by, and such a document counts as clean (the
pipeline gives its documents ids first). Very long texts are searched whole. Other columns are not read. Empty benchmark:
nothing is contaminated.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm import kernels as K
from quarrylight.session import settle

WINDOW, NEED, MIN_LITERAL, BITMAP_BITS = 8, 6, 4, 22
#: units of measure that are placeholders after a number
UNITS = (
    "mm cm m km g kg mg t l ml s ms h min hour hours day days week weeks month months year years minute minutes second "
    "seconds metre metres meter meters mile miles foot feet inch inches gram grams kilogram kilograms pound pounds ounce "
    "ounces litre litres liter liters dollar dollars euro euros cent cents percent degree degrees celsius fahrenheit watt "
    "watts volt volts joule joules newton newtons byte bytes kb mb gb hz khz mhz ghz kmh mph"
).split()

_DIGIT = np.zeros(256, np.int64)
_DIGIT[0x30:0x3A] = 1
_STOP = np.zeros(256, np.int64)
_STOP[[*b".!?:\n"]] = 1
#: tokens of exact windows by themselves: signs of arithmetic, first bytes of characters of three or four bytes
_SIGN = K._separators([*b"+-*/=<>^%"])
_SINGLE = _SIGN.copy()
_SINGLE[0xE0:] = True
_EXACT = K.U(0xA24BAED4963EE407)
_CODES = K.mix(np.arange(1, 4, dtype=np.uint64))


def _unit_hashes() -> np.ndarray:
    raw = " ".join(UNITS).encode()
    return np.sort(K.Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), K.NON_ALNUM, lower=True).hash)


_UNITS = _unit_hashes()


def template(data: np.ndarray, offs: np.ndarray) -> tuple[K.Words, np.ndarray, np.ndarray]:
    """(words, token hashes, which are placeholders)."""
    w = K.Words(data, offs, K.NON_ALNUM, lower=True)
    n = len(w.start)
    tokens = w.hash.copy()
    if not n:
        return w, tokens, np.zeros(0, bool)
    digits = np.concatenate(([0], np.cumsum(_DIGIT[data])))
    number = digits[w.end] - digits[w.start] == w.end - w.start
    first = np.zeros(n, bool)
    first[w.docs[:-1][w.counts > 0]] = True
    after = np.zeros(n, bool)
    after[1:] = number[:-1]
    unit = after & ~first & (_UNITS[np.minimum(np.searchsorted(_UNITS, tokens), len(_UNITS) - 1)] == tokens)
    stops = np.concatenate(([0], np.cumsum(_STOP[data])))
    inside = np.zeros(n, bool)
    inside[1:] = stops[w.start[1:]] == stops[w.end[:-1]]
    raw = data[w.start]
    name = (raw >= 0x41) & (raw <= 0x5A) & inside & ~first
    for flags, code in zip((name, unit, number), _CODES, strict=True):
        tokens[flags] = code
    return w, tokens, name | unit | number


def _windows(data: np.ndarray, offs: np.ndarray, sizes: tuple[int, ...], whole: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int, K.Words, np.ndarray]]:
    """(first words, hashes, documents, size) of usable windows of each size. whole: sizes under WINDOW only as a whole text."""
    w, tokens, slot = template(data, offs)
    literal = np.concatenate(([0], np.cumsum(~slot)))
    for size in sizes:
        at = np.flatnonzero(w.inside(size))
        if not len(at):
            continue
        doc = w.doc_of[at]
        good = literal[at + size] - literal[at] >= min(MIN_LITERAL, size)
        if whole and size < WINDOW:
            good &= w.counts[doc] == size
        at, doc = at[good], doc[good]
        yield at, w.ngrams(size, tokens)[at], doc, size, w, slot


def exact_words(data: np.ndarray, offs: np.ndarray) -> K.Words:
    """Words whose signs and characters of three or more bytes are words each."""
    w = K.Words(data, offs, K.NON_ALNUM & ~_SIGN, lower=True)
    n = len(data)
    first, last, single = np.zeros(n + 1, bool), np.zeros(n + 1, bool), np.flatnonzero(_SINGLE[data])
    first[w.start], last[w.end - 1] = True, True
    first[single] = True
    # a character's end ends a word, what follows it or stands before it is another
    past = single + 1 + (data[single] >= 0xE0) * 2 + (data[single] >= 0xF0)
    last[past - 1] = True
    word = np.append(~(K.NON_ALNUM & ~_SIGN)[w.data], False)
    first[past[word[past]]] = True
    first[offs[-1:]] = False
    before = single[single > 0] - 1
    last[before[word[before]]] = True
    w.start, w.end = np.flatnonzero(first), np.flatnonzero(last) + 1
    w.docs = np.searchsorted(w.start, offs)
    return w


def _exact_windows(w: K.Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first words, hashes, documents) of exact windows of one size."""
    at = np.flatnonzero(w.inside(size))
    return at, K.mix(w.ngrams(size)[at] ^ _EXACT), w.doc_of[at]


def _values(w: K.Words, slot: np.ndarray, at: int, size: int) -> list[str]:
    return [w.data[w.start[x] : w.end[x]].tobytes().decode(errors="replace") for x in range(at, at + size) if slot[x]]


_ROW = pa.schema([("id", pa.int64()), ("h", pa.int64()), ("place", pa.int32()), ("slots", pa.list_(pa.string())), ("exact", pa.int32()), ("size", pa.int32())])
ROW_SCHEMA = "id long, h long, place int, slots array<string>, exact int, size int"


def _rows(ids: np.ndarray, h: np.ndarray, place: np.ndarray, slots: list[list[str]], size: int, exact: bool) -> pa.RecordBatch:
    """Rows of windows of `size` words; exact: tokens of an exact window, 0 for template windows."""
    return pa.record_batch(
        [pa.array(ids.astype(np.int64)), pa.array(h.view(np.int64)), pa.array(place.astype(np.int32)), pa.array(slots, pa.list_(pa.string())), pa.array(np.full(len(ids), size * exact, np.int32)), pa.array(np.full(len(ids), size, np.int32))], schema=_ROW
    )


def _emit(sizes: tuple[int, ...], whole: bool, bitmap, exact: tuple[int, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Template windows, and exact windows: of the sizes asked for, or with whole of each text that needs one."""
    bits = None if bitmap is None else np.unpackbits(np.frombuffer(bitmap.value, np.uint8)).view(bool)
    low = K.U((1 << BITMAP_BITS) - 1)
    for b in batches:
        ids = b.column("id").to_numpy(zero_copy_only=False)
        for i, j, data, offs in K.text_chunks(b.column("text")):
            n_windows = np.zeros(j - i, np.int64)
            for at, h, doc, size, w, slot in _windows(data, offs, sizes, whole):
                if bits is not None:
                    hit = bits[h & low]
                    at, h, doc = at[hit], h[hit], doc[hit]
                n_windows += np.bincount(doc, minlength=j - i)
                yield _rows(ids[i:j][doc], h, at - w.docs[doc], [_values(w, slot, x, size) for x in at.tolist()], size, False)
            if not (whole or exact):
                continue
            w = exact_words(data, offs)
            few = np.where(n_windows <= NEED, w.counts, 0)
            for size in np.unique(few[few > 0]).tolist() if whole else exact:
                at, h, doc = _exact_windows(w, size)
                hit = few[doc] == size if whole else bits[h & low]
                at, h, doc = at[hit], h[hit], doc[hit]
                yield _rows(ids[i:j][doc], h, at - w.docs[doc], [[]] * len(at), size, True)


def _bitmap(windows: DataFrame) -> bytes:
    """Set bits of the windows' hashes; at most 2**BITMAP_BITS rows reach the driver."""
    low = windows.select(F.col("h").bitwiseAND(F.lit((1 << BITMAP_BITS) - 1)).alias("bit")).distinct().toArrow()
    bits = np.zeros(1 << BITMAP_BITS, bool)
    bits[low["bit"].to_numpy()] = True
    return np.packbits(bits).tobytes()


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_windows, first_word, last_word): placements that count, in words, or of exact windows in their tokens."""
    sizes = tuple(range(MIN_LITERAL, WINDOW + 1))
    named = benchmark.filter(F.col("item_id").isNotNull()).select(F.col("item_id").cast("long").alias("id"), F.col("text"))
    items = settle(named.mapInArrow(partial(_emit, sizes, True, None, ()), ROW_SCHEMA), "items")
    counts = items.groupBy("id").agg(F.countDistinct(F.when(F.col("exact") == 0, F.col("place"))).alias("n_item"))
    items = settle(items.join(counts, "id").select(F.col("id").alias("item_id"), "h", F.col("place").alias("_at"), F.col("slots").alias("_slots"), F.col("exact").alias("_exact"), "n_item"), "items")
    shared = docs.sparkSession.sparkContext.broadcast(_bitmap(items))
    # one row a length of an item that has an exact window
    exact = tuple(sorted(r[0] for r in items.filter("_exact > 0").select("_exact").distinct().collect()))
    texts = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("id"), "text")
    met = texts.mapInArrow(partial(_emit, sizes, False, shared, exact), ROW_SCHEMA).join(items, "h").filter("exact = _exact")
    pairs = F.zip_with("_slots", "slots", lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    placed = met.groupBy(F.col("id").alias("doc_id"), "item_id", (F.col("place") - F.col("_at")).alias("_diagonal"), "exact").agg(
        F.countDistinct("_at").alias("n_windows"), F.max("n_item").alias("n_item"), F.min("place").alias("first_word"),
        F.max(F.col("place") + F.col("size") - 1).alias("last_word"), F.array_distinct(F.flatten(F.collect_set(pairs))).alias("_pairs"),
    )
    values = [F.size(F.array_distinct(F.col("_pairs")[n])) for n in "ab"]
    one_to_one = (F.size("_pairs") == values[0]) & (F.size("_pairs") == values[1])
    enough = (F.col("exact") > 0) | (F.col("n_windows") >= F.least(F.lit(NEED), F.col("n_item")))
    return placed.filter(enough & one_to_one).select(
        "doc_id", "item_id", "n_windows", "first_word", "last_word"
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: doc_id, contaminated, item_ids (ascending), n_windows (of the best placement)."""
    leaks = find_leaks(docs, benchmark).groupBy("doc_id").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.max("n_windows").alias("n_windows"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id")).join(leaks, "doc_id", "left").select(
        "doc_id", F.col("item_ids").isNotNull().alias("contaminated"), F.coalesce("item_ids", F.array().cast("array<long>")).alias("item_ids"), F.coalesce("n_windows", F.lit(0)).alias("n_windows")
    )
