"""Triage ordering and response assignment.

Response assignment re-aims a backtracking search as a DataFrame job.  The
search returns the first feasible assignment in analyst order, which is the
lexicographically smallest feasible sequence of analyst indices.  A forward
dynamic programme finds it: the state after alert ``i`` is the vector of
remaining capacities, and for each reachable state only the smallest prefix
is kept (any feasible completion of a larger prefix also completes the
smaller one).  Each step is a join of the frontier with the eligible analysts
of the next alert, then ``groupBy(group, capacities).agg(min(prefix))``.
With 3 analysts of capacity 3 there are at most 64 states per group, so many
groups (e.g. one per day or per site) are planned at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .. import constants as C
from ..functions import scoring as S
from ..session import checkpoint_dir


def _tie(df: DataFrame):
    return [F.col(c) for c in ("log_type", "row_id") if c in df.columns]


def with_priority(alerts: DataFrame) -> DataFrame:
    return alerts.withColumn("heuristic_priority", S.triage_priority(
        *[c if c in alerts.columns else F.lit(0) for c in ("severity", "confidence", "risk_score")]))


def triage_queue(alerts: DataFrame, limit: int = C.TRIAGE_LIMIT) -> DataFrame:
    """T4: best-first queue - highest priority first, ``limit`` entries."""
    df = with_priority(alerts)
    top = df.orderBy(F.desc("heuristic_priority"), *_tie(df)).limit(limit)

    def num(c):
        return F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in df.columns else F.lit(0.0)
    return top.select(
        F.coalesce(F.col("source_ip").cast("string"), F.lit("nan")).alias("source_ip")
        if "source_ip" in df.columns else F.lit("").alias("source_ip"),
        F.coalesce(F.col("attack_type").cast("string"), F.lit("nan")).alias("attack_type"),
        num("severity").cast("int").alias("severity"),
        F.round(num("confidence"), 1).alias("confidence"),
        F.round(num("risk_score"), 2).alias("risk_score"),
        F.round(F.col("heuristic_priority"), 2).alias("priority"))


def response_candidates(alerts: DataFrame, limit: int = C.RESPONSE_MAX_ASSIGNMENTS,
                        group_cols: tuple[str, ...] = ()) -> DataFrame:
    """T5: the ``limit`` highest-risk alerts (by severity when unscored),
    per group when ``group_cols`` is given; adds ``rank`` (0-based)."""
    key = "risk_score" if "risk_score" in alerts.columns else "severity"
    order = [F.desc(key), *_tie(alerts)]

    def fields(df):
        return df.select(
            *group_cols,
            F.coalesce(F.col("source_ip").cast("string"), F.lit("nan")).alias("source_ip"),
            F.coalesce(F.col("attack_type").cast("string"), F.lit("unknown_anomaly"))
             .alias("attack_type"),
            F.coalesce(F.col("severity").cast("double"), F.lit(0.0)).cast("int").alias("severity"),
            F.round(F.coalesce(F.col("risk_score").cast("double"), F.lit(0.0)), 2)
             .alias("risk_score") if "risk_score" in df.columns else F.lit(0.0).alias("risk_score"),
            "rank")
    if not group_cols:
        top = alerts.orderBy(*order).limit(limit)
        w = Window.orderBy(*order)  # over at most ``limit`` rows
        return fields(top.withColumn("rank", F.row_number().over(w) - 1))
    return fields(top_k_per_group(alerts, list(group_cols), order, limit, "rank"))


def top_k_per_group(df: DataFrame, group_cols: list[str], order, k: int, rank_col: str = "rank",
                    salt_buckets: int = 1024) -> DataFrame:
    """Top ``k`` rows per group without sorting a whole group in one task.

    First a top-k inside (group, salt) partitions, salt = hash of the row
    modulo ``salt_buckets``; then the final rank over the at most
    ``k * salt_buckets`` survivors of each group."""
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(salt_buckets))
    w1 = Window.partitionBy(*group_cols, "_salt").orderBy(*order)
    pre = (df.withColumn("_salt", salt).withColumn("_r1", F.row_number().over(w1))
             .where(F.col("_r1") <= k).drop("_r1", "_salt"))
    w2 = Window.partitionBy(*group_cols).orderBy(*order)
    return pre.withColumn(rank_col, F.row_number().over(w2) - 1).where(F.col(rank_col) < k)


def analyst_skills(spark) -> DataFrame:
    rows = [(i, name, skill) for i, (name, skills) in enumerate(C.ANALYSTS) for skill in skills]
    return spark.createDataFrame(rows, "analyst_idx int, analyst string, attack_type string")


def skill_eligibility(alerts: DataFrame, keys: tuple[str, ...] = ("log_type", "row_id")) -> DataFrame:
    """(alert, analyst) pairs where the analyst handles the attack type;
    types nobody handles go to every analyst holding the fallback skill.
    The skills table is a fixed 9-row dimension (broadcast)."""
    skills = F.broadcast(analyst_skills(alerts.sparkSession))
    fallback = skills.where(F.col("attack_type") == C.FALLBACK_SKILL).select(
        "analyst_idx", "analyst")
    keys = [k for k in keys if k in alerts.columns]
    a = alerts.select(*keys, "attack_type")
    known = F.broadcast(skills.select("attack_type").distinct())
    direct = a.join(skills, "attack_type", "inner")
    fb = fallback.withColumnRenamed("analyst_idx", "_fidx").withColumn(
        "_fb", F.lit(C.FALLBACK_SKILL))
    other = (a.join(known, "attack_type", "left_anti")
              .withColumn("_fb", F.lit(C.FALLBACK_SKILL))
              .join(F.broadcast(fb), "_fb", "inner")
              .withColumnRenamed("_fidx", "analyst_idx"))
    return direct.unionByName(other, allowMissingColumns=True).select(
        *keys, "attack_type", "analyst_idx", "analyst")


def response_assignment(alerts: DataFrame, max_assignments: int = C.RESPONSE_MAX_ASSIGNMENTS,
                        max_per_analyst: int = C.RESPONSE_MAX_PER_ANALYST,
                        group_cols: tuple[str, ...] = ()) -> DataFrame:
    """One row per candidate alert with ``assigned_to`` (null when the
    group has no feasible assignment) and the group's ``unassigned`` count."""
    checkpoint_dir(alerts.sparkSession)
    gcols = list(group_cols) or ["_g"]
    if group_cols:
        cand = response_candidates(alerts, max_assignments, tuple(gcols))
    else:
        cand = response_candidates(alerts, max_assignments).withColumn("_g", F.lit(0))
    cand = cand.checkpoint()            # at most max_assignments rows per group
    n_in_group = cand.groupBy(*gcols).agg(F.count(F.lit(1)).alias("_n"))
    # one step row per (group, rank, eligible analyst); groups with fewer
    # candidates get "skip" steps (analyst -1) so every group takes the same
    # number of steps and the frontier is referenced once per step
    elig = skill_eligibility(cand, keys=(*gcols, "rank")).select(*gcols, "rank", "analyst_idx")
    pad = (n_in_group.where(F.col("_n") < max_assignments)
                     .select(*gcols, F.explode(F.sequence(F.col("_n").cast("int"),
                                                          F.lit(max_assignments - 1)))
                             .alias("rank"), F.lit(-1).alias("analyst_idx")))
    steps = elig.unionByName(pad).checkpoint()   # <= 3 * max_assignments rows per group
    n_analysts = len(C.ANALYSTS)
    caps = [f"_cap{i}" for i in range(n_analysts)]
    frontier = n_in_group.select(
        *gcols, *[F.lit(max_per_analyst).alias(c) for c in caps],
        F.array().cast("array<int>").alias("_path"))
    for i in range(max_assignments):
        step = steps.where(F.col("rank") == i).select(*gcols, "analyst_idx")
        moved = frontier.join(step, gcols, "inner")
        idx = F.col("analyst_idx")
        cap_now = F.element_at(F.array(*[F.col(c) for c in caps]), F.greatest(idx, F.lit(0)) + 1)
        moved = moved.where((idx < 0) | (cap_now > 0)).select(
            *gcols,
            *[F.when(idx == j, F.col(c) - 1).otherwise(F.col(c)).alias(c)
              for j, c in enumerate(caps)],
            F.when(idx >= 0, F.concat(F.col("_path"), F.array(idx))).otherwise(F.col("_path"))
             .alias("_path"))
        # <= 64 capacity states per group survive each step
        frontier = moved.groupBy(*gcols, *caps).agg(F.min("_path").alias("_path"))
    best = (frontier.join(n_in_group, gcols).where(F.size("_path") == F.col("_n"))
                    .groupBy(*gcols).agg(F.min("_path").alias("_path")))
    names = F.array(*[F.lit(n) for n, _ in C.ANALYSTS])
    out = (cand.join(best, gcols, "left").join(n_in_group, gcols, "left")
               .withColumn("assigned_to", F.when(
                   F.col("_path").isNotNull(),
                   F.element_at(names, F.element_at("_path", F.col("rank") + 1) + 1)))
               .withColumn("unassigned", F.when(F.col("_path").isNull(), F.col("_n"))
                           .otherwise(F.lit(0)).cast("bigint")))
    keep = [c for c in gcols if c != "_g"]
    return out.select(*keep, "rank", "source_ip", "attack_type", "severity", "risk_score",
                      "assigned_to", "unassigned")
