"""Graph analytics by frontier joins. Rounds are settled in shared storage; only counts reach the driver."""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.session import settle


def impact(edges: DataFrame, roots: DataFrame, max_depth: int = 8, limit: int | None = None) -> DataFrame:
    """Reverse reachability over edges(source, target): (node, depth, via), nearest first.

    via is the smallest node of the level before that leads here. With a limit, the first by (depth, node) are kept and
    truncated tells on every row whether more were there.
    """
    seen = settle(roots.select(F.col("node"), F.lit(0).alias("depth"), F.lit(None).cast(roots.schema["node"].dataType).alias("via")).dropDuplicates(["node"]), "impact")
    frontier = seen
    for depth in range(1, max_depth + 1):
        step = edges.join(frontier.select(F.col("node").alias("target")), "target").groupBy(F.col("source").alias("node")).agg(F.min("target").alias("via"))
        frontier = settle(step.join(seen.select("node"), "node", "left_anti").select("node", F.lit(depth).alias("depth"), "via"), "impact")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    out = seen.filter("depth > 0")
    if limit is None:
        return out
    kept = out.orderBy("depth", "node").limit(limit + 1)
    n = F.count(F.lit(1)).over(Window.partitionBy())
    return kept.withColumn("_n", n).withColumn("_i", F.row_number().over(Window.orderBy("depth", "node"))).filter(F.col("_i") <= limit).select("node", "depth", "via", (F.col("_n") > limit).alias("truncated"))


def _chains(edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chains, rest, rings) of settled, distinct edges(source, target) without loops.

    An edge is inside a chain if it is its source's only one out and its target's only one in. chains(node, top, steps): the last
    node of each node's chain and how far it is, found by doubling, a round for each power of two; a node in no chain is its
    own top. rest(source, target, weight): the other edges, led on to their target's top. rings(node, component): chains that
    close, each an isolated circle, by its smallest node; they are not in chains.
    """
    out = edges.groupBy("source").agg(F.count(F.lit(1)).alias("_out"))
    into = edges.groupBy("target").agg(F.count(F.lit(1)).alias("_in"))
    marked = settle(edges.join(out, "source").join(into, "target").select("source", "target", ((F.col("_out") == 1) & (F.col("_in") == 1)).alias("_inner")), "chains")
    inner = marked.filter("_inner").select(F.col("source").alias("node"), F.col("target").alias("parent"))
    nodes = edges.select(F.explode(F.array("source", "target")).alias("node")).distinct()
    climbed = _climb(nodes.join(inner, "node", "left"))
    chains = settle(climbed.filter("at IS NULL").select("node", "top", "steps"), "chains")
    rings = climbed.filter("at IS NOT NULL").select("node", F.col("low").alias("component"))
    ahead = chains.select(F.col("node").alias("target"), "top", (F.col("steps") + 1).alias("weight"))
    rest = marked.filter("NOT _inner").join(ahead, "target").select("source", F.col("top").alias("target"), "weight")
    return chains, settle(rest, "chains"), rings


def kahn_levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, level) by repeated peeling of nodes without unpeeled prerequisites; edges(source, target): source needs target.

    Nodes on or behind a cycle, or that need a node which is not in nodes, get level null. Chains are drawn together first, so a
    round is a level of branches and joins, not of every edge.
    """
    n = settle(nodes.select("node").distinct(), "kahn")
    e = settle(edges.select("source", "target").distinct().join(n.withColumnRenamed("node", "source"), "source", "left_semi"), "kahn")
    loops = e.filter("source = target").select(F.col("source").alias("node"))
    chains, needs, _ = _chains(settle(e.filter("source <> target"), "kahn"))
    # what is not peeled: tops with a loop inside their chain, and tops that are no nodes, are kept waiting for themselves
    stuck = chains.join(loops.unionByName(chains.select("node").join(n, "node", "left_anti")), "node", "left_semi").select(F.col("top").alias("source"), F.col("top").alias("target"), F.lit(1).cast("long").alias("weight")).distinct()
    waiting = settle(needs.unionByName(stuck), "kahn")
    open_ = waiting.groupBy(F.col("source").alias("node")).agg(F.count(F.lit(1)).alias("need"))
    tops = chains.select(F.col("top").alias("node")).distinct().join(open_, "node", "left")
    state = settle(tops.select("node", F.coalesce("need", F.lit(0)).alias("need"), F.lit(0).cast("long").alias("level")), "kahn")
    done = state.select("node", "level").limit(0)
    while True:
        ready = state.filter("need = 0").select("node", "level")
        if ready.isEmpty():
            break
        done = done.unionByName(ready)
        met = waiting.join(ready.withColumnRenamed("node", "target"), "target").groupBy(F.col("source").alias("node")).agg(F.count(F.lit(1)).alias("_n"), F.max(F.col("level") + F.col("weight")).alias("_level"))
        left = state.filter("need > 0").join(met, "node", "left")
        state = settle(left.select("node", (F.col("need") - F.coalesce("_n", F.lit(0))).alias("need"), F.greatest("level", "_level").alias("level")), "kahn")
    found = chains.join(done.withColumnRenamed("node", "top"), "top").select("node", (F.col("level") + F.col("steps")).cast("int").alias("level"))
    alone = e.select(F.explode(F.array("source", "target")).alias("node")).distinct()
    free = n.join(alone, "node", "left_anti").select("node", F.lit(0).alias("level"))
    return n.join(found.unionByName(free), "node", "left")


def strongly_connected(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node of each cycle's component; nodes on no cycle are left out.

    Chains are drawn together to their last node first: a chain is on a cycle as a whole or not at all. In what is left, nodes
    without an edge in or out are trimmed, and the smallest label is spread to its fixpoint, forward and backward: edges between
    nodes that differ in either label are in no component and go, until none does. Then a pass goes backward from each label's own
    node inside its colour: what both reach is one component, and leaves the graph. Passes go on until no edge is left; each
    takes at least one component, so they end.
    """
    whole = settle(edges.select("source", "target").dropna().distinct(), "scc")
    loops = whole.filter("source = target").select(F.col("source").alias("node"), F.col("source").alias("component"))
    chains, rest, rings = _chains(settle(whole.filter("source <> target"), "scc"))
    closed = rest.filter("source = target").select(F.col("source").alias("top"), F.col("source").alias("label")).distinct()
    tops = _components(settle(rest.filter("source <> target").select("source", "target").distinct(), "scc")).select(F.col("node").alias("top"), F.col("component").alias("label"))
    labels = tops.unionByName(closed.join(tops, "top", "left_anti"))
    members = settle(chains.join(labels, "top").select("node", "label"), "scc")
    named = members.join(members.groupBy("label").agg(F.min("node").alias("component")), "label").select("node", "component")
    found = settle(named.unionByName(rings), "scc")
    return found.unionByName(loops.join(found, "node", "left_anti"))


def _spread(e: DataFrame) -> DataFrame:
    """(node, colour): the smallest node that leads to each node over e, itself included."""
    colour = settle(e.select(F.explode(F.array("source", "target")).alias("node")).distinct().withColumn("colour", F.col("node")), "scc")
    while True:
        come = e.join(colour.withColumnRenamed("node", "source"), "source").groupBy(F.col("target").alias("node")).agg(F.min("colour").alias("_c"))
        new = settle(colour.select("node", "colour").join(come, "node", "left").select("node", F.col("colour").alias("_was"), F.least("colour", F.coalesce("_c", "colour")).alias("colour")), "scc", colour)
        if new.filter("colour <> _was").isEmpty():
            return new.select("node", "colour")
        colour = new


def _components(e: DataFrame) -> DataFrame:
    """(node, component) of every component of two nodes or more, by a node of it; e: settled, distinct edges without loops."""
    none = settle(e.select(F.col("source").alias("node"), F.col("source").alias("component")).limit(0), "scc")
    found = []
    while True:
        while True:  # trim
            both = settle(e.select(F.col("source").alias("n")).intersect(e.select(F.col("target").alias("n"))), "scc")
            smaller = settle(e.join(both.select(F.col("n").alias("source")), "source", "left_semi").join(both.select(F.col("n").alias("target")), "target", "left_semi"), "scc")
            trimmed = smaller.count() < e.count()
            e = smaller
            if not trimmed:
                break
        if e.isEmpty():
            break
        colour = _spread(e)
        both = colour.join(_spread(e.select(F.col("target").alias("source"), F.col("source").alias("target"))).withColumnRenamed("colour", "back"), "node")
        facts = lambda end: both.select(F.col("node").alias(end), F.struct("colour", "back").alias(f"_{end}"))
        alike = settle(e.join(facts("source"), "source").join(facts("target"), "target").filter("_source = _target").select("source", "target"), "scc")
        if alike.count() < e.count():  # no component has two colours, either way
            e = alike
            continue
        inner = settle(e.join(colour.select(F.col("node").alias("source"), F.col("colour").alias("a")), "source").join(colour.select(F.col("node").alias("target"), F.col("colour").alias("b")), "target").filter("a = b").select("source", "target", F.col("a").alias("colour")), "scc")
        reach = settle(colour.filter("node = colour"), "scc")
        frontier = reach
        while True:
            back = inner.join(frontier.select(F.col("node").alias("target"), "colour"), ["target", "colour"]).select(F.col("source").alias("node"), "colour").distinct()
            frontier = settle(back.join(reach, ["node", "colour"], "left_anti"), "scc")
            if frontier.isEmpty():
                break
            reach = reach.unionByName(frontier)
        reach = settle(reach, "scc")
        found.append(reach.select("node", F.col("colour").alias("component")))
        for end in ("source", "target"):
            e = e.join(reach.select(F.col("node").alias(end)), end, "left_anti")
        e = settle(e, "scc")
    out = reduce(DataFrame.unionByName, found, none)
    sizes = out.groupBy("component").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    return settle(out.join(sizes, "component").select("node", "component"), "scc")


def _climb(parents: DataFrame) -> DataFrame:
    """(node, at, steps, low, top): chains of parents(node, parent) followed by doubling, a round for each power of two.

    at: null where the chain has ended, else, for chains that run into a cycle, a node of it; steps: edges passed; low: the
    smallest node met; top: the last node of an ended chain.
    """
    cur = settle(parents.select("node", F.col("parent").alias("at"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("steps"), F.col("node").alias("low"), F.coalesce("parent", "node").alias("top")), "climb")
    covered, n = 1, cur.count()
    while covered <= n and not cur.filter("at IS NOT NULL").isEmpty():
        up = cur.select(F.col("node").alias("at"), F.col("at").alias("_at"), F.col("steps").alias("_steps"), F.col("low").alias("_low"), F.col("top").alias("_top"))
        cur = settle(cur.join(up, "at", "left").select("node", F.col("_at").alias("at"), (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps"), F.least("low", "_low").alias("low"), F.coalesce("_top", "top").alias("top")), "climb")
        covered *= 2
    return cur


def ancestor_depth(parents: DataFrame) -> DataFrame:
    """(node, depth): parents followed from a node over parents(node, parent), until there is none or one comes again.

    So a node on a cycle has the cycle's length, and one before it the way there and that length. Rounds are logarithmic in
    the longest chain.
    """
    cur = _climb(parents)
    loops = cur.filter("at IS NOT NULL")
    if loops.isEmpty():
        return cur.select("node", "steps").withColumnRenamed("steps", "depth")
    ring = settle(cur.join(loops.select(F.col("at").alias("node")).distinct(), "node").select("node", "low"), "ring")
    ring = ring.join(ring.groupBy("low").agg(F.count(F.lit(1)).alias("_n")), "low").select(F.col("node").alias("top"), "_n")
    opened = parents.join(ring.select(F.col("top").alias("node"), F.lit(True).alias("_ring")), "node", "left").select("node", F.when(F.col("_ring").isNull(), F.col("parent")).alias("parent"))
    return _climb(opened).join(ring, "top", "left").select("node", (F.col("steps") + F.coalesce("_n", F.lit(0))).alias("depth"))


def shortest_paths(edges: DataFrame, start: DataFrame, max_depth: int = 64) -> DataFrame:
    """(node, depth, path) of what edges(source, target) lead to from start(node); of paths of one length the smallest.

    Raises if max_depth rounds don't reach everything.
    """
    seen = settle(start.select("node", F.lit(0).alias("depth"), F.array("node").alias("path")).dropDuplicates(["node"]), "paths")
    frontier = seen
    for depth in range(1, max_depth + 1):
        step = edges.join(frontier.select(F.col("node").alias("source"), "path"), "source").groupBy(F.col("target").alias("node")).agg(F.min(F.concat("path", F.array("target"))).alias("path"))
        frontier = settle(step.join(seen.select("node"), "node", "left_anti").select("node", F.lit(depth).alias("depth"), "path"), "paths")
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)
    raise RuntimeError(f"paths of more than {max_depth} edges")


def _reachable(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(node): what settled edges(source, target) lead to from start(node), itself included, whatever the depth."""
    seen = settle(start.select("node").distinct(), "reached")
    frontier = seen
    while True:
        step = edges.join(frontier.withColumnRenamed("node", "source"), "source").select(F.col("target").alias("node")).distinct()
        frontier = settle(step.join(seen, "node", "left_anti"), "reached")
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)


def all_shortest_paths(edges: DataFrame, start: DataFrame, most: int = 50) -> DataFrame:
    """(node, depth, paths, place, path): how many shortest paths lead from start(node) over edges(source, target), and the first `most` of each node in order.

    Breadth-first levels keep the edges between one level and the next; path counts add up along them (as decimals, null beyond 38
    digits), and paths are cut to the first `most` of a node in every level. That loses none of the first: what a node's first paths
    go through are first paths of the level before. Rounds go on to the deepest node; each is one join with the frontier.
    """
    e = settle(edges.select("source", "target").filter("source IS NOT NULL AND target IS NOT NULL").distinct(), "paths")
    first = start.select("node").dropna().distinct()
    seen = settle(first, "paths")
    level = settle(first.select("node", F.lit(0).alias("depth"), F.lit(1).cast("decimal(38,0)").alias("paths"), F.lit(1).alias("place"), F.array("node").alias("path")), "paths")
    out = [level]
    place = F.row_number().over(Window.partitionBy("node").orderBy("path"))
    for depth in itertools.count(1):
        step = e.join(level.select(F.col("node").alias("source"), "paths", "place", "path"), "source").join(seen.withColumnRenamed("node", "target"), "target", "left_anti")
        counts = step.filter("place = 1").groupBy(F.col("target").alias("node")).agg(F.try_sum("paths").cast("decimal(38,0)").alias("paths"))
        longer = step.select(F.col("target").alias("node"), F.concat("path", F.array("target")).alias("path")).withColumn("place", place).filter(F.col("place") <= most)
        level = settle(longer.join(counts, "node").select("node", F.lit(depth).alias("depth"), "paths", "place", "path"), "paths")
        if level.isEmpty():
            return reduce(DataFrame.unionByName, out)
        out.append(level)
        seen = settle(seen.unionByName(level.filter("place = 1").select("node")), "paths", seen)


def inference(nodes: DataFrame, edges: DataFrame, position: int) -> DataFrame:
    """(relation, node, path) around one node: ancestors and descendants with their shortest paths, orphans (not reachable from any root), cyclic nodes."""
    nodes, edges = settle(nodes, "nodes"), settle(edges, "edges")  # every round reads them
    start = nodes.filter(F.col("node") == position)
    down = shortest_paths(edges, start).filter("depth > 0").select(F.lit("descendant").alias("relation"), "node", "path")
    up = shortest_paths(edges.select(F.col("target").alias("source"), F.col("source").alias("target")), start).filter("depth > 0").select(F.lit("ancestor").alias("relation"), "node", "path")
    roots = nodes.join(edges.select(F.col("target").alias("node")).distinct(), "node", "left_anti")
    none = F.lit(None).cast(f"array<{nodes.schema['node'].dataType.simpleString()}>").alias("path")
    orphan = nodes.join(_reachable(edges, roots), "node", "left_anti").select(F.lit("orphan").alias("relation"), "node", none)
    cyclic = strongly_connected(edges).select(F.lit("cyclic").alias("relation"), "node", none)
    return down.unionByName(up).unionByName(orphan).unionByName(cyclic)
