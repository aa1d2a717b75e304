"""Incremental maintenance: finding lifecycles, index deltas, snapshot diffs, staleness and state machines.

Each is one full-outer equi-join of two snapshots on their fingerprint followed by projections; nothing is collected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.session import release, settle


def merge_findings(old: DataFrame, observed: DataFrame, keys: list[str], now: Column, coverage_complete: bool | Column = True) -> DataFrame:
    """New snapshot of findings(keys, status, first_seen, last_seen) after observed(keys).

    change is opened, reopened, refreshed, resolved or kept. Open findings that were not observed are resolved only where
    coverage is complete.
    """
    gate = coverage_complete if isinstance(coverage_complete, Column) else F.lit(coverage_complete)
    o, n = old.withColumn("_old", F.lit(1)), observed.select(*keys).distinct().withColumn("_new", F.lit(1))
    j = o.join(n, keys, "full_outer")
    seen, known, was_open = F.col("_new").isNotNull(), F.col("_old").isNotNull(), F.col("status") == "open"
    change = (
        F.when(seen & ~known, "opened").when(seen & ~was_open, "reopened").when(seen, "refreshed").when(was_open & gate, "resolved").otherwise("kept")
    )
    return j.select(
        *keys, change.alias("change"), F.when(seen, "open").when(was_open & gate, "resolved").otherwise(F.col("status")).alias("status"),
        F.coalesce("first_seen", now).alias("first_seen"), F.when(seen, now).otherwise(F.col("last_seen")).alias("last_seen"),
    )


def lifecycle_counts(merged: DataFrame, against_open_only: bool) -> DataFrame:
    """opened, refreshed, resolved. against_open_only: reopened findings count as opened, else as refreshed."""
    is_ = lambda *c: F.count_if(F.col("change").isin(*c))
    opened, refreshed = (("opened", "reopened"), ("refreshed",)) if against_open_only else (("opened",), ("refreshed", "reopened"))
    return merged.agg(is_(*opened).alias("opened"), is_(*refreshed).alias("refreshed"), is_("resolved").alias("resolved"))


def index_delta(old: DataFrame, new: DataFrame, key: str, content_hash: str) -> DataFrame:
    """added, modified, unchanged or deleted for every key of either snapshot."""
    a, b = old.select(F.col(key), F.col(content_hash).alias("_a")), new.select(F.col(key), F.col(content_hash).alias("_b"))
    j = a.withColumn("_x", F.lit(1)).join(b.withColumn("_y", F.lit(1)), key, "full_outer")
    state = F.when(F.col("_x").isNull(), "added").when(F.col("_y").isNull(), "deleted").when(F.col("_a").eqNullSafe(F.col("_b")), "unchanged").otherwise("modified")
    return j.select(key, state.alias("state"))


def to_parse(scanned: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Files whose (path, hash, analysis fingerprint) is not known yet."""
    return scanned.join(known.select(*keys), keys, "left_anti")


def snapshot_diff(previous: DataFrame, current: DataFrame, keys: list[str], watched: str) -> DataFrame:
    p = previous.select(*keys, F.col(watched).alias("previous")).withColumn("_p", F.lit(1))
    c = current.select(*keys, F.col(watched).alias("current")).withColumn("_c", F.lit(1))
    j = p.join(c, keys, "full_outer")
    state = F.when(F.col("_p").isNull(), "new").when(F.col("_c").isNull(), "resolved").when(~F.col("previous").eqNullSafe(F.col("current")), "changed").otherwise("persistent")
    return j.select(*keys, "previous", "current", state.alias("state"))


def illegal_transitions(log: DataFrame, key: str, order: list[str], state: str, allowed: list[tuple[str, str]]) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    steps = log.withColumn("from_state", F.lag(state).over(w)).withColumn("to_state", F.col(state))
    ok = reduce(lambda a, b: a | b, [(F.col("from_state") == a) & (F.col("to_state") == b) for a, b in allowed], F.lit(False))
    return steps.filter(F.col("from_state").isNotNull() & ~ok)


def stale(relations: DataFrame, changed: DataFrame, relation_key: str, changed_key: str) -> DataFrame:
    """relations with is_active false where their file changed."""
    hit = changed.select(F.col(changed_key).alias(relation_key)).distinct().withColumn("_hit", F.lit(1))
    return relations.join(hit, relation_key, "left").withColumn("is_active", F.col("is_active") & F.col("_hit").isNull()).drop("_hit")


def cascade(start: DataFrame, links: DataFrame) -> DataFrame:
    """(kind, id, round): start(kind, id) and all that links(from_kind, from_id, to_kind, to_id) lead to, each once, with the first round that did.

    Each round joins only what the round before found new, so every link is followed once; rounds are settled and go on until
    one finds nothing, whatever the depth. Circles end, as what was seen is not new. Rows with a null id lead nowhere.
    """
    new = settle(start.dropna(subset=["id"]).select("kind", "id").distinct().withColumn("round", F.lit(0)), "cascade")
    seen = settle(new, "cascade")
    while True:
        reached = new.join(links, (F.col("kind") == F.col("from_kind")) & (F.col("id") == F.col("from_id")))
        step = reached.dropna(subset=["to_id"]).groupBy(F.col("to_kind").alias("kind"), F.col("to_id").alias("id")).agg((F.min("round") + 1).alias("round"))
        new = settle(step.join(seen.select("kind", "id"), ["kind", "id"], "left_anti"), "cascade", new)
        if new.isEmpty():
            release(new)
            return seen
        seen = settle(seen.unionByName(new), "cascade", seen)


def invalidate_semantics(files: DataFrame, symbols: DataFrame, relations: DataFrame, imports: DataFrame) -> DataFrame:
    """What a new index makes stale: (kind, id, round) of relations, imports, symbol states and graph edges.

    files(file_id, old_hash, new_hash, was_active, is_active), symbols(symbol_id, file_id, was_active, is_active), relations(relation_id,
    subject, container, target, occurrence_file, target_file, edge_id), imports(import_id, source_file, target_file, edge_id). A file
    whose hash changed, or that is active no longer, invalidates the relations and imports that it takes part in and the states of its
    symbols; a symbol that is active no longer its own state and relations; a relation or import its edge.
    """
    changed = (F.col("old_hash") != F.col("new_hash")) | (F.col("was_active") & ~F.col("is_active"))
    stale = {
        "file": settle(files.filter(changed).select(F.col("file_id").alias("_from")).dropna().distinct(), "files"),
        "symbol": settle(symbols.filter("was_active AND NOT is_active").select(F.col("symbol_id").alias("_from")).dropna().distinct(), "symbols"),
    }

    def touched(df: DataFrame, kind: str, key: str, **ends: list[str]) -> DataFrame:
        """Ids of df one of whose ends is stale; only an id and one end of it go to a join."""
        each = lambda columns: df.select(F.col(key).alias("id"), F.explode(F.array(*columns)).alias("_from")).dropna()
        hit = [each(columns).join(stale[of], "_from", "left_semi").select("id") for of, columns in ends.items()]
        return settle(reduce(DataFrame.unionByName, hit).distinct().select(F.lit(kind).alias("kind"), "id", F.lit(1).alias("round")), kind)

    def edges(df: DataFrame, key: str, hit: DataFrame) -> DataFrame:
        return df.select(F.col(key).alias("id"), "edge_id").dropna().join(hit.select("id"), "id", "left_semi").select(F.col("edge_id").alias("id"))

    hit = [
        touched(relations, "relation", "relation_id", file=["occurrence_file", "target_file"], symbol=["subject", "container", "target"]),
        touched(imports, "import", "import_id", file=["source_file", "target_file"]),
        touched(symbols, "state", "symbol_id", file=["file_id"], symbol=["symbol_id"]),
    ]
    of_hit = edges(relations, "relation_id", hit[0]).unionByName(edges(imports, "import_id", hit[1])).distinct()
    return reduce(DataFrame.unionByName, [*hit, of_hit.select(F.lit("edge").alias("kind"), "id", F.lit(2).alias("round"))])


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    return child.join(parent.select(F.col(parent_key).alias(child_key)).distinct(), child_key, "left_anti")


def over_limit(df: DataFrame, key: str, active: Column, most: int) -> DataFrame:
    """Keys with more than `most` active rows."""
    return df.groupBy(key).agg(F.count_if(active).alias("n")).filter(F.col("n") > most)


def symbol_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """old, new(fingerprint, start_line, end_line, signature, parent): fingerprint and added, updated, unchanged or removed."""
    facts = F.struct("start_line", "end_line", "signature", "parent")
    a, b = old.select("fingerprint", facts.alias("_a")), new.select("fingerprint", facts.alias("_b"))
    state = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_a").eqNullSafe(F.col("_b")), "unchanged").otherwise("updated")
    return a.join(b, "fingerprint", "full_outer").select("fingerprint", state.alias("state"))


def replace_children(children: DataFrame, observed: DataFrame, parent: str, id_of: Column) -> DataFrame:
    """children with those of every parent in observed replaced by its rows, which get the id `id_of`; other parents keep theirs."""
    kept = children.join(observed.select(parent).distinct(), parent, "left_anti")
    return kept.unionByName(observed.withColumn("id", id_of).select(*kept.columns))


def current_reviews(reviews: DataFrame, findings: DataFrame) -> DataFrame:
    """reviews(review_id, finding_id, scan_run, content_hash) with `current`: the finding is open, seen by the same run, and its file's hash is the same.

    findings(finding_id, status, run, last_run, content_hash); the run is last_run, or run without one. Hashes may both be null.
    """
    f = findings.select("finding_id", "status", F.coalesce("last_run", "run").alias("_run"), F.col("content_hash").alias("_hash"))
    same = (F.col("status") == "open") & (F.col("scan_run") == F.col("_run")) & F.col("content_hash").eqNullSafe(F.col("_hash"))
    return reviews.join(f, "finding_id", "left").select("review_id", "finding_id", F.coalesce(same, F.lit(False)).alias("current"))


RETEST_RESULTS = ("retest_passed", "still_vulnerable", "unable_to_verify")


def apply_retests(lifecycle: DataFrame, retests: DataFrame) -> DataFrame:
    """lifecycle(finding_id, state) after retests(finding_id, rowid, status): the first known result after fix_applied becomes the state."""
    known = retests.filter(F.col("status").isin(*RETEST_RESULTS)).groupBy("finding_id").agg(F.min(F.struct("rowid", "status"))["status"].alias("_result"))
    moved = (F.col("state") == "fix_applied") & F.col("_result").isNotNull()
    return lifecycle.join(known, "finding_id", "left").select("finding_id", F.when(moved, F.col("_result")).otherwise(F.col("state")).alias("state"), moved.alias("transitioned"))


def without_fresh_retest(findings: DataFrame, retests: DataFrame, floor: int) -> DataFrame:
    """findings(finding_id, session_id, ordinal) of a campaign with no retest of their session above the floor."""
    fresh = retests.filter(F.col("rowid") > floor).select("finding_id", "session_id")
    return findings.join(fresh, ["finding_id", "session_id"], "left_anti").select("finding_id", "ordinal")


def materialise_graph(project: str, files: DataFrame, symbols: DataFrame, imports: DataFrame, calls: DataFrame, before: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a project's index: project, file and symbol nodes; contains, defines, imports and calls edges, each once.

    files(file_id), symbols(symbol_id, file_id), imports(source_file, target_file), calls(source_symbol, target_symbol).
    With the node table before, nodes that are gone stay in it as inactive.
    """
    text = lambda c: F.col(c).cast("string")
    nodes = reduce(DataFrame.unionByName, [
        files.sparkSession.createDataFrame([("project", project)], "kind string, id string"), files.select(F.lit("file").alias("kind"), text("file_id").alias("id")), symbols.select(F.lit("symbol").alias("kind"), text("symbol_id").alias("id")),
    ]).distinct().withColumn("is_active", F.lit(True))
    if before is not None:
        gone = before.join(nodes.select("kind", "id"), ["kind", "id"], "left_anti").withColumn("is_active", F.lit(False))
        nodes = nodes.unionByName(gone.select("kind", "id", "is_active"))
    edge = lambda df, kind, a, b: df.select(F.lit(kind).alias("kind"), a.cast("string").alias("source"), b.cast("string").alias("target"))
    edges = reduce(DataFrame.unionByName, [
        edge(files, "contains", F.lit(project), F.col("file_id")), edge(symbols, "defines", F.col("file_id"), F.col("symbol_id")),
        edge(imports, "imports", F.col("source_file"), F.col("target_file")), edge(calls, "calls", F.col("source_symbol"), F.col("target_symbol")),
    ])
    return nodes, edges.filter("source IS NOT NULL AND target IS NOT NULL").distinct()


def recover_interrupted(jobs: DataFrame, steps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(jobs, steps) after a restart: running jobs(job_id, status) and their running or pending steps(job_id, position, status) are interrupted."""
    running = jobs.filter("status = 'running'").select("job_id").withColumn("_hit", F.lit(True))
    s = steps.join(running, "job_id", "left")
    cut = F.coalesce(F.col("_hit"), F.lit(False)) & F.col("status").isin("running", "pending")
    after = F.when(F.col("status") == "running", "interrupted").otherwise(F.col("status"))
    return jobs.withColumn("status", after), s.withColumn("status", F.when(cut, "interrupted").otherwise(F.col("status"))).drop("_hit")
