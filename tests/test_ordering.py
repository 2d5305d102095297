"""Running totals in a global order, and decisions that follow one another."""

from datetime import datetime

from pyspark.sql import functions as F

from casemill.functions.ordering import with_running_total
from casemill.operators import approvals


def test_running_total_with_many_ties(spark):
    rows = [(f"n{i:05d}", 1) for i in range(2000)] + [("big", 50)]
    df = spark.createDataFrame(rows, "name string, n long")
    found = with_running_total(df, [F.desc("n"), F.col("name").asc()], "n", "upto").collect()
    total, expected = 0, {}
    for name, n in sorted(rows, key=lambda r: (-r[1], r[0])):
        total += n
        expected[name] = total
    assert {r.name: r.upto for r in found} == expected
    assert with_running_total(df.limit(0), [F.col("name").asc()], "n", "upto").count() == 0


def test_second_decision_finds_it_decided(spark):
    known = spark.createDataFrame(
        [(1, "VP_APPROVER", "pending", datetime(2030, 1, 1)), (2, "VP_APPROVER", "pending", datetime(2030, 1, 1))],
        "approval_id long, approver_role string, status string, expires_at timestamp",
    )
    why = "a long enough justification"
    rows = [
        (1, "LEGAL_APPROVER", "approved", why, 1, 1), (1, "VP_APPROVER", "rejected", why, 2, 3), (1, "VP_APPROVER", "approved", why, 2, 4),
        (1, "LEGAL_APPROVER", "approved", why, 3, 5), (1, "VP_APPROVER", "approved", "no", 9, 9), (2, "VP_APPROVER", "approved", why, 1, 1),
    ]
    names = "approval_id long, approver_role string, decision string, justification string, decided_at int, decision_id int"
    found = approvals.check_decisions(spark.createDataFrame(rows, names), known, F.lit(datetime(2025, 1, 1))).collect()
    by_place = {(r.approval_id, r.decision_id): (r.outcome, r.new_status) for r in found}
    assert by_place == {
        (1, 1): ("ROLE_MISMATCH", "pending"), (1, 3): ("APPLIED", "rejected"), (1, 4): ("INVALID_STATUS", "rejected"),
        (1, 5): ("INVALID_STATUS", "rejected"), (1, 9): ("VALIDATION_ERROR", "rejected"), (2, 1): ("APPLIED", "approved"),
    }
