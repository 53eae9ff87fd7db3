"""Sagas: signup evaluation with compensation, and reconciliation of step logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldspark.functions.expressions import blank

PLANS = ("standard", "enterprise")


def step_log(signups: DataFrame, plans: tuple[str, ...] = PLANS) -> DataFrame:
    """(saga_id, stage, step, status, comp_status) of each signup: tenant and billing side by side, then the user.

    The user's step runs only if both others succeeded. If anything fails, whatever succeeded is compensated; the tenant
    of a company that starts with `sticky` cannot be. comp_status is null where nothing was compensated.
    """
    tenant = F.when(blank(F.col("company")), "validation-error").otherwise("ok")
    billing = F.when(F.coalesce(F.lower("plan").isin(*plans), F.lit(False)), "ok").otherwise("not-found")
    rows = signups.withColumns({"tenant": tenant, "billing": billing})
    first = (F.col("tenant") == "ok") & (F.col("billing") == "ok")
    rows = rows.withColumn("user", F.when(first, F.when(blank(F.col("email")) | ~F.col("email").contains("@"), "validation-error").otherwise("ok")))
    failed = ~first | (F.col("user") != "ok")
    undo = F.when(F.lower("company").startswith("sticky"), "failed").otherwise("ok")

    def step(stage: int, name: str, comp) -> object:
        return F.struct(F.lit(stage).alias("stage"), F.lit(name).alias("step"), F.col(name).alias("status"), F.when(failed & (F.col(name) == "ok"), comp).alias("comp_status"))

    steps = F.array(step(0, "tenant", undo), step(0, "billing", F.lit("ok")), step(1, "user", F.lit("ok")))
    return rows.select("saga_id", F.explode(steps).alias("s")).where("s.status is not null").select("saga_id", "s.*")


def reconcile(log: DataFrame) -> DataFrame:
    """(saga_id, outcome, failed_stage, failed_step, failed_status, orphans, retry_safe) from step logs.

    All steps ok is Succeeded; failed with everything undone is RolledBack and safe to retry; failed with a compensation
    that failed is PartiallyRolledBack, and the steps that are left are named. Of several failures in a stage the tenant's
    goes before billing's.
    """
    bad = F.col("status") != "ok"
    left = F.when((F.col("status") == "ok") & (F.col("comp_status") == "failed"), F.col("step"))
    at = F.struct("stage", F.when(F.col("step") == "tenant", 0).when(F.col("step") == "billing", 1).otherwise(2).alias("rank"))
    out = log.groupBy("saga_id").agg(
        F.min(F.when(bad, F.col("stage"))).alias("failed_stage"), F.min_by(F.col("step"), F.when(bad, at)).alias("failed_step"), F.min_by(F.col("status"), F.when(bad, at)).alias("failed_status"), F.array_join(F.array_sort(F.collect_set(left)), ",").alias("orphans")
    )
    outcome = F.when(F.col("failed_stage").isNull(), "Succeeded").when(F.col("orphans") == "", "RolledBack").otherwise("PartiallyRolledBack")
    return out.withColumn("outcome", outcome).withColumn("retry_safe", F.col("outcome") == "RolledBack")


def evaluate_signups(signups: DataFrame) -> DataFrame:
    """The outcome of each signup."""
    return reconcile(step_log(signups))


def _left(signups: DataFrame) -> DataFrame:
    """(saga_id, kind) of what exists after all signups."""
    log = step_log(signups).where("status = 'ok' and coalesce(comp_status, 'failed') = 'failed'")
    kind = F.when(F.col("step") == "billing", "account").otherwise(F.col("step"))
    return log.select("saga_id", kind.alias("kind"))


def survivors(signups: DataFrame) -> DataFrame:
    """(kind, survivors): tenants, accounts and users that exist after all signups, orphans included."""
    return _left(signups).groupBy("kind").agg(F.count("*").alias("survivors"))


def survivor_names(signups: DataFrame) -> DataFrame:
    """(kind, company, saga_id) of all survivors, sorted: rows, so a list of any length has room."""
    return _left(signups).join(signups.select("saga_id", "company"), "saga_id").select("kind", "company", "saga_id").orderBy("kind", "company", "saga_id")
