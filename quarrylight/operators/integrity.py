"""Checks of stored records: receipts against results, immutability, verified claims, plans, and the audit page over them.

Every check is one equi-join or one grouped aggregate that returns what is wrong; nothing is collected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def receipt_check(steps: DataFrame, receipts: DataFrame) -> DataFrame:
    """steps(run_id, position, role, status, result), receipts(run_id, position, role, status, result_sha256): run_id, verified, problems.

    A run is verified if every step has exactly one receipt of its role, both are completed, and the receipt's digest is the
    SHA-256 of the step's result, which isn't empty. problems counts positions where that fails, on either side.
    """
    r = receipts.groupBy("run_id", "position").agg(F.count(F.lit(1)).alias("_n"), *[F.min(c).alias(f"_{c}") for c in ("role", "status", "result_sha256")])
    j = steps.withColumn("_step", F.lit(True)).join(r, ["run_id", "position"], "full_outer")
    good = (
        F.col("_step") & (F.col("_n") == 1) & (F.col("role") == F.col("_role")) & (F.col("status") == "completed") & (F.col("_status") == "completed")
        & (F.col("result") != "") & (F.sha2("result", 256) == F.col("_result_sha256"))
    )
    return j.groupBy("run_id").agg(F.count_if(~F.coalesce(good, F.lit(False))).alias("problems")).select("run_id", (F.col("problems") == 0).alias("verified"), "problems")


def audit_page(runs: DataFrame, verdicts: DataFrame, limit: int, before: int | None = None) -> DataFrame:
    """One row for a page of completed runs(run_id, rowid), newest first: total_completed, checked, verified, invalid, next_before (null: last page)."""
    total = runs.agg(F.count(F.lit(1)).alias("total_completed"))
    page = (runs if before is None else runs.filter(F.col("rowid") < before)).orderBy(F.desc("rowid")).limit(limit + 1)
    page = page.withColumn("_i", F.row_number().over(Window.orderBy(F.desc("rowid"))))  # at most limit + 1 rows
    shown = page.join(verdicts.select("run_id", "verified"), "run_id", "left").agg(
        F.count_if(F.col("_i") <= limit).alias("checked"), F.count_if((F.col("_i") <= limit) & F.coalesce("verified", F.lit(False))).alias("verified"),
        F.when(F.max("_i") > limit, F.min(F.when(F.col("_i") <= limit, F.col("rowid")))).alias("next_before"),
    )
    return total.join(F.broadcast(shown)).select("total_completed", "checked", "verified", (F.col("checked") - F.col("verified")).alias("invalid"), "next_before")


def rewritten(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, problem) of append-only rows that were changed or removed between two snapshots; new rows are fine."""
    digest = F.sha2(F.to_json(F.struct(*columns)), 256)
    j = before.select(key, digest.alias("_b")).join(after.select(key, digest.alias("_a")), key, "left")
    return j.filter(~F.col("_a").eqNullSafe(F.col("_b"))).select(key, F.when(F.col("_a").isNull(), "removed").otherwise("changed").alias("problem"))


def unproven(attempts: DataFrame, retests: DataFrame, results: DataFrame) -> DataFrame:
    """(attempt_id, problem) of attempts(attempt_id, finding_id, status, retest_state, application_run_id, retest_floor) that claim fix_verified without proof.

    Needed: retest state FIX_VERIFIED, an application run, a passed retests(finding_id, status, rowid) above the floor, and
    no FAIL in results(attempt_id, status, classification) that the patch introduced or that is unknown.
    """
    claims = attempts.filter("status = 'fix_verified'")
    latest = retests.filter("status = 'retest_passed'").groupBy("finding_id").agg(F.max("rowid").alias("_passed"))
    failed = results.filter(F.col("status") == "FAIL").filter(F.col("classification").isin("PATCH_INTRODUCED_FAILURE", "UNKNOWN")).select("attempt_id").distinct().withColumn("_fail", F.lit(True))
    j = claims.join(latest, "finding_id", "left").join(failed, "attempt_id", "left")
    problem = (
        F.when(~F.coalesce(F.col("retest_state") == "FIX_VERIFIED", F.lit(False)), "retest_state").when(F.col("application_run_id").isNull(), "no_application")
        .when(~F.coalesce(F.col("_passed") > F.col("retest_floor"), F.lit(False)), "no_fresh_retest").when(F.col("_fail"), "regression")
    )
    return j.select("attempt_id", problem.alias("problem")).filter("problem IS NOT NULL")


def digest_gate(rows: DataFrame, body: str, digest: str, fields: dict[str, str]) -> DataFrame:
    """rows with `valid`: the stored digest is that of the stored JSON body, and the columns agree with its fields (column: JSON path)."""
    ok = F.sha2(body, 256) == F.col(digest)
    for column, path in fields.items():
        ok = ok & F.col(column).cast("string").eqNullSafe(F.get_json_object(body, path))
    return rows.withColumn("valid", F.coalesce(ok, F.lit(False)))


#: fixed values: roles of a plan in their order
PLAN_ROLES = ["scout", "source", "dependencies", "database", "runtime", "report"]


def plan_violations(tasks: DataFrame, roles: list[str] | None = None) -> DataFrame:
    """tasks(plan_id, position, role, objective, depends_on array): every (plan_id, rule, role) that a plan breaks.

    The first two roles are mandatory and come first, in order; the second depends on the first alone, all later ones on the
    second at least. Dependencies are other, known, distinct, earlier tasks, at most four; roles keep their order.
    """
    roles = roles or PLAN_ROLES
    first, second = roles[:2]
    rank = lambda r: F.array_position(F.array(*map(F.lit, roles)), r)
    plans = tasks.groupBy("plan_id").agg(F.sort_array(F.collect_list(F.struct("position", "role", "objective", "depends_on"))).alias("s"))

    def broken(s: Column, x: Column, i: Column) -> Column:
        r, d = x["role"], x["depends_on"]
        place = lambda of: F.filter(s, lambda k: k["role"] == of)
        bad = lambda of: (of == r) | (F.size(place(of)) == 0)
        late = lambda of: F.exists(place(of), lambda k: k["position"] >= x["position"])
        before = F.array_max(F.transform(F.slice(s, F.lit(1), i), lambda k: rank(k["role"])))
        rules = [
            ("unknown_role", rank(r) == 0), ("duplicate_role", F.size(F.filter(s, lambda k: k["role"].eqNullSafe(r))) > 1), ("objective", (F.trim(x["objective"]) == "") | (F.length(x["objective"]) > 300)),
            ("dependency_count", F.size(d) > 4), ("dependency", F.exists(d, bad) | (F.size(F.array_distinct(d)) < F.size(d))), ("dependency_order", F.exists(d, late)),
            ("first_has_dependency", (r == first) & (F.size(d) > 0)), ("second_dependency", (r == second) & (F.array_join(d, ",") != first)),
            ("later_dependency", ~r.isin(first, second) & ~F.array_contains(d, second)), ("role_order", rank(r) <= before),
        ]
        return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(n).alias("rule"), r.alias("role"))) for n, c in rules]))

    n, had = F.size("s"), F.transform("s", lambda x: x["role"])
    size = F.when(~n.between(2, len(roles)), F.struct(F.lit("size").alias("rule"), F.lit(None).cast("string").alias("role")))
    absent = F.transform(F.array_except(F.array(F.lit(first), F.lit(second)), had), lambda r: F.struct(F.lit("mandatory").alias("rule"), r.alias("role")))
    steps = F.flatten(F.transform("s", lambda x, i: broken(F.col("s"), x, i)))
    return plans.select("plan_id", F.explode(F.concat(steps, F.array_compact(F.array(size)), absent)).alias("v")).select("plan_id", "v.rule", "v.role")


def over_rows(df: DataFrame, most: int) -> DataFrame:
    """One row: n (at most most + 1 rows are read) and overflow, whether df has more than `most` rows."""
    return df.limit(most + 1).agg(F.count(F.lit(1)).alias("n")).withColumn("overflow", F.col("n") > most)


def or_fail(df: DataFrame, most: int) -> DataFrame:
    """df, or an error when it has more than `most` rows."""
    if over_rows(df, most).first()["overflow"]:
        raise OverflowError(f"more than {most} rows")
    return df


def any_like(text: str, *columns: str) -> Column:
    """Case-insensitive containment of text, taken literally, in any of the columns."""
    return reduce(lambda a, b: a | b, [F.coalesce(F.contains(F.lower(c), F.lit(text.lower())), F.lit(False)) for c in columns])
