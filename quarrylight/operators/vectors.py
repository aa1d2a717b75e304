"""Exact top-k search: blocks of queries against tiles of rows, as matrix products in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.session import settle, workers_find_us

#: rows of a tile, which a task holds, and scores that are made at once
TILE, STEP = 1 << 18, 1 << 22
DIGITS = 5


def _best(ids: np.ndarray, tile: np.ndarray, asked: np.ndarray, block: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score) of each query's k best rows of the tile: positive scores, highest first, equal ones by id; itself left out."""
    score = np.round(block @ tile.T, DIGITS)
    score[asked[:, None] == ids[None, :]] = -np.inf
    least = np.partition(score, -k, axis=1)[:, -k] if score.shape[1] > k else np.full(len(block), -np.inf)
    row, col = np.nonzero((score >= least[:, None]) & (score > 0))
    order = np.lexsort((ids[col], -score[row, col], row))
    row, col = row[order], col[order]
    first = np.searchsorted(row, np.arange(len(block)))
    heap = np.arange(len(row)) - first[row] < k
    row, col = row[heap], col[heap]
    return asked[row], ids[col], score[row, col]


def _search(k: int, dims: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (tile, asks, id, v) sorted so that a tile's rows come before the queries that visit it."""
    tile, held = None, []
    ids, matrix = np.zeros(0, np.int64), np.zeros((0, dims))
    for b in batches:
        at, asks, own = (b.column(c).to_numpy(zero_copy_only=False) for c in ("tile", "asks", "id"))
        v = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
        cuts = [0, *(np.flatnonzero((at[1:] != at[:-1]) | (asks[1:] != asks[:-1])) + 1).tolist(), len(at)] if len(at) else []
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            if tile != at[i]:
                tile, held = at[i], []
                ids, matrix = np.zeros(0, np.int64), np.zeros((0, dims))
            if not asks[i]:
                held.append((own[i:j].copy(), v[i:j].copy()))
                continue
            if held:
                ids, matrix = np.concatenate([ids, *[x for x, _ in held]]), np.concatenate([matrix, *[x for _, x in held]])
                held = []
            width = max(1, STEP // max(1, len(ids)))
            for a in range(i, j, width):
                q, r, s = _best(ids, matrix, own[a : min(j, a + width)], v[a : min(j, a + width)], k)
                yield pa.record_batch([pa.array(q), pa.array(r), pa.array(s)], names=["query", "id", "score"])


def top_k(rows: DataFrame, queries: DataFrame, k: int = 25, tile: int = TILE) -> DataFrame:
    """query, id, score, place: for each of queries(id, v) the k rows(id, v) with the highest positive dot product, ties by id.

    Rows are dealt over tiles of about `tile` rows; every query visits every tile, where a task holds the tile and streams the
    queries in blocks: a matrix product each, of which k rows a query are kept. These partial heaps meet by query, k rows a tile.
    So rows are moved once and queries once a tile, no rows are paired, and a task's memory is that of a tile. A query is not its own
    answer. Scores are rounded to DIGITS places, so the order does not hang on how products are added up. Vectors that are null,
    hold a null, or have another length than the smallest id's are left out; repeated ids count each by itself.
    """
    workers_find_us(rows.sparkSession)
    clean = lambda d: d.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x)))
    base, asked = clean(rows), clean(queries)
    facts = base.agg(F.count(F.lit(1)).alias("n"), F.min_by(F.size("v"), F.struct("id", F.size("v"))).alias("dims")).first()
    dims, tiles = facts["dims"] or 1, max(1, -(-facts["n"] // tile))
    base = base.select(F.pmod(F.xxhash64("id"), F.lit(tiles)).cast("int").alias("tile"), F.lit(0).alias("asks"), "id", "v")
    visits = asked.select(F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("tile"), F.lit(1).alias("asks"), "id", "v")
    met = base.unionByName(visits).filter(F.size("v") == dims).repartition(tiles, "tile").sortWithinPartitions("tile", "asks")
    heaps = settle(met.mapInArrow(partial(_search, k, dims), "query long, id long, score double"), "heaps")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return heaps.withColumn("place", place).filter(F.col("place") <= k)
