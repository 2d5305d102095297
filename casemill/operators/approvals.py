"""Approval requests, ordered approval steps, decisions and expiry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from casemill.functions.joins import small
from casemill.operators.requests import MIN_JUSTIFICATION, page

# Approvers per operation, operations with ordered steps, hours until expiry.
APPROVERS = {
    "PRODUCTION_MIGRATION": ("VP_APPROVER",),
    "RBAC_CHANGE": ("LEGAL_APPROVER", "VP_APPROVER"),
    "DATA_DELETION": ("LEGAL_APPROVER",),
    "SECURITY_CONFIG_CHANGE": ("LEGAL_APPROVER", "VP_APPROVER"),
    "PARTNER_ONBOARDING": ("LEGAL_APPROVER", "VP_APPROVER"),
}
SEQUENTIAL = ("PARTNER_ONBOARDING", "RBAC_CHANGE", "SECURITY_CONFIG_CHANGE")
EXPIRY_HOURS = 72
LEGAL, VP, ADMIN = "LEGAL_APPROVER", "VP_APPROVER", "SYSTEM_ADMIN"


def approval_rules(spark: SparkSession) -> DataFrame:
    """(operation, step_order, role, sequential), a fixed table of a few rows."""
    rows = [
        (operation, place, role, operation in SEQUENTIAL)
        for operation, roles in APPROVERS.items()
        for place, role in enumerate(roles, start=1)
    ]
    return spark.createDataFrame(rows, "operation string, step_order int, role string, sequential boolean")


def _short(justification: Column) -> Column:
    return F.coalesce(F.length(justification) < MIN_JUSTIFICATION, F.lit(True))


def check_approval_requests(requests: DataFrame, rules: DataFrame) -> DataFrame:
    """Add ``outcome``, ``status`` and ``expires_at`` to (operation, approver_role, justification, requested_at)."""
    known = rules.select("operation").distinct().withColumn("_known", F.lit(True))
    granted = rules.select("operation", F.col("role").alias("approver_role")).distinct().withColumn("_granted", F.lit(True))
    joined = requests.join(small(known), "operation", "left").join(
        small(granted), ["operation", "approver_role"], "left"
    )
    outcome = (
        F.when(F.col("_known").isNull(), F.lit("unknown_operation"))
        .when(F.col("_granted").isNull(), F.lit("role_not_required"))
        .when(_short(F.col("justification")), F.lit("justification_too_short"))
        .otherwise(F.lit("accepted"))
    )
    accepted = F.col("outcome") == "accepted"
    until = F.col("requested_at") + F.make_dt_interval(hours=F.lit(EXPIRY_HOURS))
    return joined.withColumn("outcome", outcome).select(
        *requests.columns,
        "outcome",
        F.when(accepted, F.lit("pending")).alias("status"),
        F.when(accepted, until).alias("expires_at"),
    )


def expand_steps(requests: DataFrame, rules: DataFrame) -> DataFrame:
    """One row per step: legal then VP for sequential operations, else the first required role."""
    steps = rules.where(F.col("sequential") | (F.col("step_order") == 1)).select("operation", "step_order", "role")
    return requests.join(small(steps), "operation").select(
        *requests.columns, "step_order", F.col("role").alias("approver_role")
    )


def missing_approvers(requests: DataFrame, approvals: DataFrame, rules: DataFrame) -> DataFrame:
    """Required roles per request that have not approved yet."""
    required = requests.select("request_id", "operation").join(small(rules.select("operation", "role")), "operation")
    given = approvals.where(F.col("status") == "approved").select("request_id", F.col("approver_role").alias("role"))
    return required.join(given, ["request_id", "role"], "left_anti").select("request_id", "operation", "role")


def _overdue(as_of: Column) -> Column:
    return F.coalesce((F.col("status") == "pending") & (as_of > F.col("expires_at")), F.lit(False))


def expire_approvals(approvals: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(approvals with overdue pending ones expired, one audit row for each of them)."""
    due = _overdue(as_of)
    updated = approvals.withColumn("status", F.when(due, F.lit("expired")).otherwise(F.col("status")))
    audit = approvals.where(due).select(
        F.lit("SYSTEM").alias("user_id"),
        F.lit("APPROVAL_AUTO_EXPIRED").alias("action"),
        F.col("approval_id").cast("string").alias("resource_id"),
        F.lit("success").alias("result"),
    )
    return updated, audit


def pending_approvals(
    approvals: DataFrame, as_of: Column, role: str | None = None, operation: str | None = None
) -> DataFrame:
    """Pending approvals after the expiry sweep."""
    rows = approvals.where((F.col("status") == "pending") & ~_overdue(as_of))
    if role:
        rows = rows.where(F.col("approver_role") == role)
    if operation:
        rows = rows.where(F.col("operation") == operation)
    return rows


def operations_approved(operations: DataFrame, approvals: DataFrame, as_of: Column) -> DataFrame:
    """Add ``approved``: the requester holds a live approval for the operation."""
    live = (
        approvals.where((F.col("status") == "approved") & (as_of <= F.col("expires_at")))
        .select("operation", "requester_id")
        .distinct()
        .withColumn("_ok", F.lit(True))
    )
    return (
        operations.join(live, ["operation", "requester_id"], "left")
        .withColumn("approved", F.col("_ok").isNotNull())
        .drop("_ok")
    )


def sequential_violations(steps: DataFrame) -> DataFrame:
    """VP steps with an earlier legal step of the same application that is not approved.

    Only the first open legal step of an application matters, so legal steps are folded to one row
    per application before the join.
    """
    open_legal = (
        steps.where((F.col("approver_role") == LEGAL) & (F.col("status") != "approved"))
        .groupBy("application_id")
        .agg(F.min("step_order").alias("_first_open"))
    )
    vp = steps.where(F.col("approver_role") == VP)
    return vp.join(open_legal, "application_id").where(F.col("_first_open") < F.col("step_order")).drop("_first_open")


def check_decisions(
    decisions: DataFrame,
    approvals: DataFrame,
    as_of: Column,
    steps: DataFrame | None = None,
    order: Sequence[str] = ("decided_at", "decision_id"),
) -> DataFrame:
    """Add ``outcome`` and ``new_status`` to (approval_id, approver_role, decision, justification, …).

    Decisions of one approval are applied one after another in the strict order of the columns ``order``:
    the first acceptable one decides, and to every later one the approval is no longer pending.
    ``steps`` switches to the stricter plane: an administrator may decide any step, and a VP step
    waits for its legal step.
    """
    known = approvals.select(
        "approval_id",
        F.lit(True).alias("_found"),
        F.col("status").alias("_status"),
        F.col("expires_at").alias("_until"),
        F.col("approver_role").alias("_role"),
    )
    joined = decisions.join(known, "approval_id", "left")
    role = F.col("approver_role")
    wrong_role = role.isNull() | (role != F.col("_role"))
    blocked = F.lit(False)
    if steps is not None:
        waiting = sequential_violations(steps).select("approval_id").distinct().withColumn("_waiting", F.lit(True))
        joined = joined.join(waiting, "approval_id", "left")
        blocked = F.col("_waiting").isNotNull()
        wrong_role = wrong_role & (F.coalesce(role, F.lit("")) != ADMIN)
    outcome = (
        F.when(_short(F.col("justification")), F.lit("VALIDATION_ERROR"))
        .when(F.col("_found").isNull(), F.lit("NOT_FOUND"))
        .when(F.col("_status") != "pending", F.lit("INVALID_STATUS"))
        .when(as_of > F.col("_until"), F.lit("EXPIRED"))
        .when(wrong_role, F.lit("ROLE_MISMATCH"))
        .when(blocked, F.lit("SEQUENTIAL_VIOLATION"))
        .otherwise(F.lit("APPLIED"))
    )
    judged = joined.withColumn("outcome", outcome)
    place = F.struct(*order)
    # Combined before the shuffle, so an approval with many decisions is one row per task.
    first = judged.where(F.col("outcome") == "APPLIED").groupBy("approval_id").agg(
        F.min(F.struct(place.alias("place"), F.col("decision").alias("decision"))).alias("_first")
    )
    judged = judged.join(first, "approval_id", "left").withColumn("_late", F.coalesce(place > F.col("_first.place"), F.lit(False)))
    pending = F.col("outcome").isin("APPLIED", "EXPIRED", "ROLE_MISMATCH", "SEQUENTIAL_VIOLATION")
    status = (
        F.when(F.col("_late"), F.col("_first.decision"))
        .when(F.col("outcome") == "APPLIED", F.col("decision"))
        .when(F.col("outcome") == "EXPIRED", F.lit("expired"))
        .otherwise(F.col("_status"))
    )
    return judged.withColumn(
        "outcome", F.when(F.col("_late") & pending, F.lit("INVALID_STATUS")).otherwise(F.col("outcome"))
    ).select(*decisions.columns, "outcome", status.alias("new_status"))


def _details(**fields: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(name) for name, c in fields.items()]), {"ignoreNullFields": "false"})


def decision_audit(
    checked: DataFrame, approvals: DataFrame, order: Sequence[str] = ("decided_at", "decision_id")
) -> DataFrame:
    """Audit rows (user_id, action, resource, resource_id, result, details) of what :func:`check_decisions` found.

    ``checked`` also holds ``approver_id``. An applied decision and one of the wrong role write a row each. An
    approval expires once: the first decision that comes too late ends it, and writes a row if it was to approve.
    The other outcomes write none.
    """
    approving = F.col("decision") == "approved"
    facts = approvals.select("approval_id", F.col("operation").alias("_operation"), F.col("approver_role").alias("_role"))
    applied, mismatch = F.col("outcome") == "APPLIED", F.col("outcome") == "ROLE_MISMATCH"
    action = (
        F.when(applied & approving, F.lit("APPROVAL_GRANTED"))
        .when(applied, F.lit("APPROVAL_REJECTED"))
        .when(approving, F.lit("APPROVAL_DENIED"))
        .otherwise(F.lit("APPROVAL_REJECT_DENIED"))
    )
    what = _details(operation=F.col("_operation"), justification=F.col("justification"))
    why = _details(
        reason=F.lit("role_mismatch"), required_role=F.col("_role"), actual_role=F.col("approver_role")
    )
    resource = F.lit("/api/approvals").alias("resource")
    resource_id = F.col("approval_id").cast("string").alias("resource_id")
    judged = checked.where(applied | mismatch).join(facts, "approval_id").select(
        F.col("approver_id").alias("user_id"),
        action.alias("action"),
        resource,
        resource_id,
        F.when(applied, F.lit("success")).otherwise(F.lit("failure")).alias("result"),
        F.when(applied, what).otherwise(why).alias("details"),
    )
    first = F.min_by(F.struct("approver_id", "decision"), F.struct(*order)).alias("_first")
    expired = checked.where(F.col("outcome") == "EXPIRED").groupBy("approval_id").agg(first)
    reason = _details(reason=F.lit(f"{EXPIRY_HOURS}-hour expiration window exceeded"))
    ended = expired.where(F.col("_first.decision") == "approved").select(
        F.col("_first.approver_id").alias("user_id"),
        F.lit("APPROVAL_EXPIRED").alias("action"),
        resource,
        resource_id,
        F.lit("failure").alias("result"),
        reason.alias("details"),
    )
    return judged.unionByName(ended)


def list_approvals(
    steps: DataFrame,
    applications: DataFrame,
    status: str | None = None,
    role: str | None = None,
    number: int = 1,
    size: int = 20,
) -> DataFrame:
    """Steps with their application, newest first, one page."""
    rows = steps
    if status:
        rows = rows.where(F.col("status") == status)
    if role:
        rows = rows.where(F.col("approver_role") == role)
    joined = rows.join(applications, "application_id")
    return page(joined, [F.desc("requested_at"), F.desc("approval_id")], number, size)
