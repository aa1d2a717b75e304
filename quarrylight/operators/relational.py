"""Filters, searches, pages, per-key limits and keyed sinks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.session import settle


def where_given(df: DataFrame, **wanted) -> DataFrame:
    """Equality on every column whose wanted value is not None."""
    return reduce(lambda d, kv: d.filter(F.col(kv[0]) == F.lit(kv[1])), [(k, v) for k, v in wanted.items() if v is not None], df)


def escape_like(text: str) -> str:
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def matches(column: Column, text: str, mode: str) -> Column:
    """exact is case-sensitive; prefix and substring are not. % and _ in text stand for themselves."""
    if mode == "exact":
        return column == F.lit(text)
    pattern = escape_like(text) + "%"
    return column.ilike(pattern if mode == "prefix" else "%" + pattern)


def clamp(n: int, most: int) -> int:
    return min(max(n, 1), most)


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str | None = None) -> DataFrame:
    """First n rows of each key. Spark keeps at most n rows a key before the shuffle (window group limit)."""
    out = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_rank") <= n)
    return out.withColumnRenamed("_rank", rank) if rank else out.drop("_rank")


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by order, as one combining aggregate instead of a sort."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def keyset_page(df: DataFrame, key: str, before, size: int) -> DataFrame:
    """Rows before a cursor, newest first, one more than asked for; has_more and next_cursor are the same on every row."""
    page = (df if before is None else df.filter(F.col(key) < F.lit(before))).orderBy(F.col(key).desc()).limit(size + 1)
    place = F.row_number().over(Window.orderBy(F.col(key).desc()))  # size + 1 rows
    page = page.withColumn("_place", place).withColumn("has_more", F.max("_place").over(Window.partitionBy()) > size)
    page = page.filter(F.col("_place") <= size).drop("_place")
    return page.withColumn("next_cursor", F.when(F.col("has_more"), F.min(key).over(Window.partitionBy()).cast("string")))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows of both; new values win, except columns in keep, where old ones stay."""
    on = reduce(lambda a, b: a & b, [F.col(f"n.{k}").eqNullSafe(F.col(f"o.{k}")) for k in keys])
    hit = F.col("n._new").isNotNull()
    pick = lambda c: F.coalesce(f"n.{c}", f"o.{c}") if c in keys else F.coalesce(f"o.{c}", f"n.{c}") if c in keep else F.when(hit, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    both = new.withColumn("_new", F.lit(1)).alias("n").join(old.alias("o"), on, "full_outer")
    return both.select(*[pick(c).alias(c) for c in old.columns])


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti"))


def guarded_append(log: DataFrame, key: str, seq: str, cap: int) -> DataFrame:
    """Keys whose next sequence number is still allowed, with that number."""
    return log.groupBy(key).agg((F.coalesce(F.max(seq), F.lit(0)) + 1).alias("next_seq")).filter(F.col("next_seq") <= cap)


def not_in(df: DataFrame, key: str, other: DataFrame) -> DataFrame:
    """Rows of df whose key is NOT IN other(key), with SQL's nulls: none if other has a null, null keys only if other is empty.

    An anti join by equality, which needs no broadcast, and one row of counts.
    """
    o = other.select(F.col(key))
    facts = o.agg(F.count(F.lit(1)).alias("_rows"), F.count_if(F.col(key).isNull()).alias("_nulls"))
    rest = df.join(o.filter(F.col(key).isNotNull()).distinct(), key, "left_anti").join(F.broadcast(facts))
    return rest.filter((F.col("_nulls") == 0) & (F.col(key).isNotNull() | (F.col("_rows") == 0))).select(*df.columns)


def block_digest(rows: DataFrame, by: str, key: str, item: Column, fan: int = 4096) -> DataFrame:
    """(by, digest): a SHA-256 tree over rows in key order. Items are joined in blocks of `fan` keys, block digests in blocks of `fan` blocks, then all.

    So no group holds more than `fan` items, or one digest a fan * fan keys.
    """
    joined = lambda order: F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, "_h"))), lambda r: r["_h"]), "\n"), 256)
    out = rows.select(by, F.col(key).alias("_at"), item.alias("_h"))
    for _ in range(2):
        out = out.withColumn("_block", F.floor(F.col("_at") / fan)).groupBy(by, "_block").agg(joined("_at").alias("_h")).withColumnRenamed("_block", "_at")
    return out.groupBy(by).agg(joined("_at").alias("digest"))


def digest_tree(rows: DataFrame, by: str, key: str, item: Column, fan: int = 4096) -> DataFrame:
    """(by, level, block, digest): the levels of block_digest as rows, to be kept. Level 0: blocks of `fan` keys, 1: of fan * fan, 2: one root.

    digest of a block covers what is in it, in key order. key is a long that is unique within by.
    """
    joined = lambda order: F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, "_h"))), lambda r: r["_h"]), "\n"), 256)
    low = rows.select(by, F.floor(F.col(key) / fan).alias("block"), F.col(key).alias("_at"), item.alias("_h")).groupBy(by, "block").agg(joined("_at").alias("digest"))
    low = settle(low, "tree")
    middle = low.select(by, F.floor(F.col("block") / fan).alias("_b"), F.col("block").alias("_at"), F.col("digest").alias("_h")).groupBy(by, F.col("_b").alias("block")).agg(joined("_at").alias("digest"))
    middle = settle(middle, "tree")
    root = middle.select(by, F.col("block").alias("_at"), F.col("digest").alias("_h")).groupBy(by).agg(joined("_at").alias("digest")).withColumn("block", F.lit(0).cast("long"))
    return reduce(DataFrame.unionByName, [d.select(by, F.lit(k).alias("level"), "block", "digest") for k, d in enumerate((low, middle, root))])


def differing_blocks(old: DataFrame, new: DataFrame, by: str, fan: int = 4096) -> DataFrame:
    """(by, block) of the lowest level that differ between two digest trees, found from the roots down.

    Only what lies under a differing block is compared, so equal parts cost one row a root or a block. A block of one tree alone differs.
    """
    open_ = None
    for level, above in ((2, None), (1, F.lit(0).cast("long")), (0, F.floor(F.col("block") / fan))):
        a, b = (t.filter(F.col("level") == level).select(by, "block", F.col("digest").alias(n)) for t, n in ((old, "_old"), (new, "_new")))
        if open_ is not None:
            a, b = (t.withColumn("_up", above).join(open_, [by, "_up"], "left_semi").drop("_up") for t in (a, b))
        differ = settle(a.join(b, [by, "block"], "full_outer").filter(~F.col("_old").eqNullSafe(F.col("_new"))).select(by, "block"), "blocks")
        open_ = differ.withColumnRenamed("block", "_up")
    return differ


def tree_changes(old: DataFrame, new: DataFrame, blocks: DataFrame, by: str, key: str, digest: str, fan: int = 4096) -> DataFrame:
    """(by, key, state): added, removed and changed rows of old and new(by, key, digest); of rows outside `blocks` only the keys are looked at."""
    inside = lambda d: d.select(by, key, digest).withColumn("block", F.floor(F.col(key) / fan)).join(blocks, [by, "block"], "left_semi").drop("block")
    a, b = inside(old).withColumnRenamed(digest, "_old"), inside(new).withColumnRenamed(digest, "_new")
    state = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_old") != F.col("_new"), "changed")
    return a.join(b, [by, key], "full_outer").select(by, key, state.alias("state")).filter("state IS NOT NULL")
