"""Audit rows of decisions and of new cancellation requests."""

import json

from pyspark.sql import functions as F

from casemill.operators import approvals, requests

WHY = "a long enough reason"


def test_every_decision_that_matters_leaves_a_row(spark):
    known = spark.createDataFrame(
        [(1, "RBAC_CHANGE", "VP_APPROVER", "pending", 100), (2, "DATA_DELETION", "LEGAL_APPROVER", "pending", 100),
         (3, "RBAC_CHANGE", "VP_APPROVER", "pending", 10), (4, "RBAC_CHANGE", "VP_APPROVER", "pending", 10),
         (5, "RBAC_CHANGE", "VP_APPROVER", "approved", 100)],
        "approval_id long, operation string, approver_role string, status string, expires_at long",
    )
    decided = spark.createDataFrame(
        [(1, "a", "LEGAL_APPROVER", "approved", WHY, 1), (1, "b", "VP_APPROVER", "approved", WHY, 2),
         (1, "c", "VP_APPROVER", "rejected", WHY, 3), (2, "d", "VP_APPROVER", "rejected", WHY, 1),
         (2, "e", "LEGAL_APPROVER", "rejected", WHY, 2), (2, "f", None, "approved", WHY, 1),
         (3, "g", "VP_APPROVER", "approved", WHY, 1), (3, "h", "VP_APPROVER", "approved", WHY, 2),
         (4, "i", "VP_APPROVER", "rejected", WHY, 1), (4, "j", "VP_APPROVER", "approved", WHY, 2),
         (5, "k", "VP_APPROVER", "approved", WHY, 1), (6, "l", "VP_APPROVER", "approved", WHY, 1),
         (1, "m", "VP_APPROVER", "approved", "short", 0)],
        "approval_id long, approver_id string, approver_role string, decision string, justification string, decided_at long",
    )
    order = ["decided_at", "approver_id"]
    checked = approvals.check_decisions(decided, known, F.lit(50), order=order)
    rows = approvals.decision_audit(checked, known, order).collect()
    assert {(r.user_id, r.action, r.resource_id, r.result) for r in rows} == {
        ("a", "APPROVAL_DENIED", "1", "failure"), ("b", "APPROVAL_GRANTED", "1", "success"),
        ("d", "APPROVAL_REJECT_DENIED", "2", "failure"), ("e", "APPROVAL_REJECTED", "2", "success"),
        ("f", "APPROVAL_DENIED", "2", "failure"), ("g", "APPROVAL_EXPIRED", "3", "failure"),
    }
    details = {r.user_id: json.loads(r.details) for r in rows}
    assert details["b"] == {"operation": "RBAC_CHANGE", "justification": WHY}
    assert details["f"] == {"reason": "role_mismatch", "required_role": "LEGAL_APPROVER", "actual_role": None}
    assert approvals.decision_audit(checked.where("false"), known, order).count() == 0


def test_new_requests(spark):
    partners = spark.createDataFrame([(1, "A", "active"), (2, "B", "inactive"), (3, "C", "active")], "partner_id long, name string, status string")
    emails = spark.createDataFrame([(1, " P@x.co ", True), (1, "old@x.co", False)], "partner_id long, email string, is_active boolean")
    asked = spark.createDataFrame(
        [(1, 10, "u", 1, "p@X.co", f"  {WHY} "), (2, 10, "u", None, "p@x.co", WHY), (3, 10, "u", 1, "", WHY),
         (4, 10, None, 2, "p@x.co", WHY), (5, 10, "u", 3, "p@x.co", WHY), (6, 10, "u", 9, "p@x.co", WHY),
         (7, 10, "u", 1, "old@x.co", "short"), (8, None, "u", 1, "p@x.co", "short"), (9, 10, "u", 1, "p@x.co", " short    ...  "),
         (10, 10, "u", 1, "p@x.co", None), (11, 10, "u", None, None, None)],
        "request_id long, case_id long, requested_by string, partner_id long, sender_email string, justification string",
    ).withColumn("asked_at", F.to_timestamp_ntz(F.lit("2024-03-05 23:59:59")))
    checked = requests.create_requests(asked, partners, emails)
    rows = {r.request_id: r for r in checked.collect()}
    assert {i: (r.code, r.reason) for i, r in rows.items()} == {
        1: (201, "created"), 2: (400, "partner_id_required"), 3: (400, "sender_email_required"),
        4: (403, "partner_inactive"), 5: (403, "no_active_email_configured"), 6: (403, "partner_not_found"),
        7: (403, "email_mismatch"), 8: (400, "case_id_required"), 9: (201, "created"),
        10: (400, "justification_too_short"), 11: (400, "partner_id_required"),
    }
    one = rows[1]
    assert (one.current_state, one.justification, one.sender_email) == (requests.INITIAL, WHY, "p@x.co")
    assert one.radicado.startswith("ANU-20240305-") and one.radicado != rows[9].radicado
    assert rows[7].radicado is None and rows[7].current_state is None
    assert checked.where("request_id = 1").first().radicado == one.radicado

    audit = {(r.action, r.resource_id): r for r in requests.creation_audit(checked).collect()}
    assert set(audit) == {("CREATE_ANNULATION", "1"), ("CREATE_ANNULATION", "9")} | {
        ("EMAIL_AUTHORIZATION_DENIED", p) for p in ("1", "2", "3", "9")
    }
    assert audit["EMAIL_AUTHORIZATION_DENIED", "2"].user_id == "unknown"
    assert json.loads(audit["CREATE_ANNULATION", "1"].details)["initial_state"] == "Solicitada"
