"""Product quantisation of integer vectors: codes of four parts, codebooks refined by rounds of exact nearest-entry search.

Each component x becomes floor(1024 * x). Codebooks (at most `entries` entries a part, a bound that no input changes) are
small, so the driver holds them and tasks get them by broadcast; vectors stay in the tasks. A round is one job: every task
assigns its vectors, writes them with their new codes and, beside them, its sums and counts by part and entry (at most
4 * entries rows a task), which Spark adds up. A round's folder goes when the next one is written.

Search is exponion search: a vector starts at the entry a that it had in the round before, at exact distance u. An entry c
that is as near or nearer obeys |c - a| <= 2u, so only the head of a's list of entries, sorted by distance, up to
|c - a|^2 <= 4u^2, is scanned. Equality is inside, so ties with lower indexes are never passed over. Distances are integers:
in doubles while every sum stays under 2^53, else in 64-bit integers.

Defined results. Vectors that are null, or hold a null or a component that is not finite, are dropped. Parts have a quarter of
the length of the smallest kept id's vector (the least length a multiple of four and not zero). Vectors of another length, or with a
component of RANGE or more (whose squares would pass 64 bits), can't be compared: they take no part, and code and error are
null. Rows without an id come last when codebooks start. Repeated ids count each by itself; equal ids are ordered by their vectors.
With fewer kept vectors than entries, codebooks are that small. An empty table gives none. Null labels are equal to each
other; label_error is null where no vector of the label has an error. Other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.session import discard, scratch, settle

PARTS, ENTRIES, ROUNDS, UNIT = 4, 256, 4, 1024
#: scaled components stay under this magnitude, so squared distances of up to 8,192 components fit 64 bits
RANGE = 1 << 24
#: vectors that a task assigns at once, and neighbours that are scanned at first; each further step takes twice as many
BATCH, BLOCK = 1 << 15, 64


# ------------------------------------------------------------------ search


def exact(x: np.ndarray, c: np.ndarray) -> np.dtype:
    """The type in which a squared distance of x's rows to c's, times the number of entries, is exact: doubles up to 2^53, else Python's integers."""
    most = max((int(np.abs(a).max()) if a.size else 0) for a in (x, c))
    return np.dtype(np.float64 if x.shape[1] * (2 * most) ** 2 * len(c) < 1 << 53 else object)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of every row of x to every row of c, both of the type that exact() names."""
    out = x @ (-2 * c.T)
    out += (x * x).sum(1)[:, None]
    out += (c * c).sum(1)
    return out


class Neighbours:
    """A part's entries, and for each its list of all entries by distance, then index."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        between = squared(*[entries.astype(exact(entries, entries))] * 2)
        self.order = np.argsort(between, axis=1, kind="stable")
        self.distance = np.take_along_axis(between, self.order, 1).astype(np.int64)

    def nearest(self, x: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of the nearest entry to each row of x, ties to the lower index; start: where each begins.

        A distance times the number of entries plus the index is one number, whose least is the nearest entry of the lowest index.
        """
        kind, n = exact(x, self.entries), len(self.entries)
        x, entries = x.astype(kind), self.entries.astype(kind)
        u = ((x - entries[start]) ** 2).sum(1)
        best = u * n + start
        by_start = np.argsort(start, kind="stable")
        bounds = np.searchsorted(start[by_start], np.arange(n + 1))
        for a in np.flatnonzero(np.diff(bounds)):
            rows = by_start[bounds[a] : bounds[a + 1]]
            # how much of a's list lies inside the radius; those who look furthest first
            reach = np.searchsorted(self.distance[a], 4 * u[rows].astype(np.int64), "right")
            furthest = np.argsort(-reach, kind="stable")
            rows, reach = rows[furthest], reach[furthest]
            own, least, first, width = x[rows], best[rows], 0, BLOCK
            while first < reach[0]:
                m = int(np.searchsorted(-reach, -first, "left"))  # rows whose radius passes this block's first entry
                block = self.order[a, first : first + width]
                found = squared(own[:m], entries[block])
                found *= n
                found += block
                least[:m] = np.minimum(least[:m], found.min(1))
                first, width = first + width, 2 * width
            best[rows] = least
        return (best % n).astype(np.int64), (best // n).astype(np.int64)


# ------------------------------------------------------------------ tasks

_STATE = "vec_id long, label string, x array<int>, code binary, error long"


def _integers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kept vectors in integers; x is null where a component is out of RANGE."""
    for b in batches:
        column = b.column("embedding")
        offs, flat = np.asarray(column.offsets), column.values
        bad = np.zeros(len(flat) + 1, np.int64)
        values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls: NaN
        np.cumsum(~np.isfinite(values), out=bad[1:])
        wide = np.zeros(len(flat) + 1, np.int64)
        with np.errstate(invalid="ignore", over="ignore"):
            scaled = np.floor(values * UNIT)
            np.cumsum(~(np.abs(scaled) < RANGE), out=wide[1:])
        keep = column.is_valid().to_numpy(zero_copy_only=False) & (bad[offs[1:]] == bad[offs[:-1]])
        fits = wide[offs[1:]] == wide[offs[:-1]]
        x = [scaled[i:j].astype(np.int32) if ok else None for i, j, ok in zip(offs[:-1][keep], offs[1:][keep], fits[keep], strict=True)]
        mask = pa.array(keep)
        yield pa.record_batch([b.column("vec_id").filter(mask), b.column("label").filter(mask), pa.array(x, pa.list_(pa.int32()))], names=["vec_id", "label", "x"])


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of about BATCH rows."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= BATCH:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def _assign(books, size: int, sums: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with new codes and errors (part null), then this task's sums by part and entry where asked for."""
    parts = [Neighbours(c) for c in books.value]
    width, n_entries = size // PARTS, len(books.value[0])
    total, count = np.zeros((PARTS, n_entries, width), np.int64), np.zeros((PARTS, n_entries), np.int64)
    for b in _gathered(batches):
        x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, size).astype(np.int64)
        before = b.column("code")
        start = np.frombuffer(b"".join(before.to_pylist()), np.uint8).reshape(-1, PARTS) if not before.null_count else np.zeros((len(x), PARTS), np.uint8)
        codes, error = np.zeros((len(x), PARTS), np.uint8), np.zeros(len(x), np.int64)
        for p, part in enumerate(parts):
            own = x[:, p * width : (p + 1) * width]
            at, far = part.nearest(own, start[:, p])
            codes[:, p] = at
            error += far
            if sums:
                order = np.argsort(at, kind="stable")
                seen, first = np.unique(at[order], return_index=True)
                total[p, seen] += np.add.reduceat(own[order], first, axis=0) if len(order) else 0
                count[p] += np.bincount(at, minlength=n_entries)
        code = pa.FixedSizeBinaryArray.from_buffers(pa.binary(PARTS), len(x), [None, pa.py_buffer(codes.tobytes())]).cast(pa.binary())
        yield _rows(b, code, pa.array(error))
    if sums:
        p, e = np.nonzero(count)
        yield pa.record_batch(
            [pa.nulls(len(p), pa.int64()), pa.nulls(len(p), pa.string()), pa.nulls(len(p), pa.list_(pa.int32())), pa.nulls(len(p), pa.binary()), pa.nulls(len(p), pa.int64()),
             pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(count[p, e]), pa.array(list(total[p, e]), pa.list_(pa.int64()))],
            schema=_OUT,
        )


_OUT = pa.schema([("vec_id", pa.int64()), ("label", pa.string()), ("x", pa.list_(pa.int32())), ("code", pa.binary()), ("error", pa.int64()), ("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])


def _rows(b: pa.RecordBatch, code: pa.Array, error: pa.Array) -> pa.RecordBatch:
    n = b.num_rows
    return pa.record_batch([*[b.column(c) for c in ("vec_id", "label", "x")], code, error, *[pa.nulls(n, f.type) for f in list(_OUT)[5:]]], schema=_OUT)


# ------------------------------------------------------------------ rounds


def _round(vectors: DataFrame, books: list[np.ndarray], sums: bool) -> tuple[DataFrame, str]:
    """(vectors with new codes and this round's sums, by kind; the folder that holds both)."""
    spark, size = vectors.sparkSession, PARTS * books[0].shape[1]
    schema = _STATE + ", part int, entry int, n long, sums array<long>"
    out = vectors.mapInArrow(partial(_assign, spark.sparkContext.broadcast(books), size, sums), schema)
    path = scratch(spark, "codes")
    out.withColumn("kind", F.when(F.col("part").isNull(), "vector").otherwise("sums")).write.partitionBy("kind").parquet(path)
    return spark.read.schema(schema + ", kind string").parquet(path), path


def _updated(books: list[np.ndarray], sums: DataFrame) -> list[np.ndarray]:
    """Every entry's floor(sum / count); entries without vectors stay. What comes to the driver has the codebooks' size."""
    each = sums.select("part", "entry", "n", F.posexplode("sums").alias("at", "value"))
    out = [b.copy() for b in books]
    for r in each.groupBy("part", "entry", "at").agg(F.sum("value").alias("value"), F.sum("n").alias("n")).collect():
        out[r["part"]][r["entry"], r["at"]] = r["value"] // r["n"]
    return out


def train_and_encode(vectors: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """(rows with code and error, final codebooks) of settled vectors(vec_id, label, x)."""
    in_order = [F.col("vec_id").asc_nulls_last(), F.col("x")]
    usable = vectors.filter((F.size("x") > 0) & (F.size("x") % PARTS == 0))
    lead = usable.orderBy(*in_order).limit(1).collect()
    nothing = [F.lit(None).cast("binary").alias("code"), F.lit(None).cast("long").alias("error")]
    if not lead:
        return vectors.select("vec_id", "label", *nothing), []
    same = F.coalesce(F.size("x") == len(lead[0]["x"]), F.lit(False))
    now, folder = vectors.filter(same).select("*", *nothing), None
    first = np.array([r["x"] for r in now.orderBy(*in_order).limit(entries).collect()], np.int64)
    books = np.split(first, PARTS, axis=1)
    for left in range(rounds, -1, -1):
        new, path = _round(now.select("vec_id", "label", "x", "code"), books, sums=left > 0)
        if left:
            books = _updated(books, new.filter("kind = 'sums'"))
        if folder:
            discard(vectors.sparkSession, folder)
        now, folder = new.filter("kind = 'vector'"), path
    rest = vectors.filter(~same).select("vec_id", "label", *nothing)
    return now.select("vec_id", "label", "code", "error").unionByName(rest), books


def compress_vectors(embeddings: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """One row per kept vector: vec_id, code, error, label_error, codebooks_sha256."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col("label").cast("string").alias("label"))
    vectors = settle(rows.mapInArrow(_integers, "vec_id long, label string, x array<int>"), "vectors")
    coded, books = train_and_encode(vectors, entries, rounds)
    # one row a label, settled so that its size is known and it is broadcast only while it is small
    by_label = settle(coded.groupBy(F.col("label").alias("_label")).agg(F.try_sum("error").alias("label_error")), "labels")
    digest = hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()
    out = coded.join(by_label, F.col("label").eqNullSafe(F.col("_label")), "left")
    return out.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
