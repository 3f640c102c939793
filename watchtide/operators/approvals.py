"""Approval life cycle, folded from an event log.

Legal order is request, decision, execution (approved only), rollback.  Illegal events do not change
anything, so the state follows from the first event of each kind after the previous legal one: four
grouped minima instead of a row-by-row replay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from watchtide import fixed
from watchtide.functions.core import lookup


def _first_after(log: DataFrame, kinds: list[str], earlier: DataFrame, bound: str, name: str, where=None) -> DataFrame:
    rows = log.where(F.col("kind").isin(kinds)).join(earlier.where(F.col(bound).isNotNull()), "approval_id")
    rows = rows.where(F.col("seq") > F.col(bound))
    if where is not None:
        rows = rows.where(where)
    first = rows.groupBy("approval_id").agg(F.min(F.struct("seq", "kind", "actor", "t")).alias(f"_{name}"))
    return earlier.join(first, "approval_id", "left").withColumn(f"{name}_seq", F.col(f"_{name}.seq"))


def fold_approvals(log: DataFrame) -> DataFrame:
    """Current state per approval.

    ``log``: approval_id, seq (order within the approval), kind (request, approve, reject, execute,
    rollback), actor, t.
    """
    out = log.where("kind = 'request'").groupBy("approval_id").agg(F.min(F.struct("seq", "t")).alias("_r")).select(
        "approval_id", F.col("_r.seq").alias("request_seq"), F.col("_r.t").alias("created"))
    out = _first_after(log, ["approve", "reject"], out, "request_seq", "decision")
    out = _first_after(log, ["execute"], out, "decision_seq", "execution", F.col("_decision.kind") == "approve")
    out = _first_after(log, ["rollback"], out, "execution_seq", "rollback")
    status = (F.when(F.col("rollback_seq").isNotNull(), "rolled_back").when(F.col("execution_seq").isNotNull(), "executed")
              .when(F.col("_decision.kind") == "approve", "approved").when(F.col("_decision.kind") == "reject", "rejected")
              .otherwise("pending"))
    return out.select(
        "approval_id", status.alias("status"), "created", "request_seq", "decision_seq", "execution_seq", "rollback_seq",
        F.col("_decision.actor").alias("decided_by"), F.col("_decision.t").alias("decided"),
        F.coalesce("_rollback.t", "_execution.t", "_decision.t", "created").alias("updated"))


def illegal_events(log: DataFrame, state: DataFrame) -> DataFrame:
    """Log events that the life cycle rejects, with the reason."""
    rows = log.join(state.drop("updated", "decided", "decided_by", "created"), "approval_id", "left")
    decided = F.col("decision_seq") < F.col("seq")
    reason = (
        F.when(F.col("request_seq").isNull() | (F.col("seq") < F.col("request_seq")), F.lit("unknown approval"))
        .when((F.col("kind") == "request") & (F.col("seq") > F.col("request_seq")), F.lit("already requested"))
        .when(F.col("kind").isin("approve", "reject") & decided, F.lit("already decided"))
        .when((F.col("kind") == "execute") & ~F.coalesce(F.col("seq") == F.col("execution_seq"), F.lit(False)), F.lit("not approved"))
        .when((F.col("kind") == "rollback") & ~F.coalesce(F.col("seq") > F.col("execution_seq"), F.lit(False)), F.lit("nothing to roll back")))
    return rows.select("approval_id", "seq", "kind", reason.alias("reason")).where("reason IS NOT NULL")


def unauthorized_decisions(decisions: DataFrame, minimum: str = "senior_analyst") -> DataFrame:
    """Approvals of disruptive actions by someone below the required rank."""
    rank = F.coalesce(lookup(fixed.ROLE_RANK, F.col("role")), F.lit(0))
    return decisions.where((F.col("decision") == "approved") & F.col("disruptive") & (rank < fixed.ROLE_RANK[minimum]))


def list_approvals(state: DataFrame, status: str | None = None, case_id: str | None = None, limit: int = 50) -> DataFrame:
    out = state
    if status:
        out = out.where(F.col("status") == status)
    if case_id:
        out = out.where(F.col("case_id") == case_id)
    return out.orderBy(F.col("created").desc(), F.col("approval_id")).limit(limit)


def latest_executions(executions: DataFrame) -> DataFrame:
    """Newest execution per approval; only one row per key and task reaches the shuffle."""
    w = Window.partitionBy("approval_id").orderBy(F.col("t").desc(), F.col("execution_id").desc())
    return executions.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
