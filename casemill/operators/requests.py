"""Cancellation requests: transition rules, checks, replay, listings."""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from casemill.functions.joins import small
from casemill.functions.scan import running_fold
from casemill.functions.text import strip
from casemill.operators.access import ROLES, check_partner_sender
from casemill.session import durable

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# States, terminal states, transitions with their roles, roles that never change state.
STATES = ("Solicitada", "En_Revision", "Aprobada", "Rechazada", "En_Ejecucion", "Cerrada")
INITIAL = "Solicitada"
TERMINAL = ("Cerrada", "Rechazada")
TRANSITIONS = {
    ("Solicitada", "En_Revision"): ("OPERATIONS_LEAD", "ANALYST", "SYSTEM_ADMIN"),
    ("En_Revision", "Aprobada"): ("LEGAL_APPROVER", "VP_APPROVER", "SYSTEM_ADMIN"),
    ("En_Revision", "Rechazada"): ("LEGAL_APPROVER", "VP_APPROVER", "SYSTEM_ADMIN"),
    ("Aprobada", "En_Ejecucion"): ("OPERATIONS_LEAD", "SYSTEM_ADMIN"),
    ("En_Ejecucion", "Cerrada"): ("OPERATIONS_LEAD", "SYSTEM_ADMIN"),
}
NEVER_CHANGE = ("INTERN_READONLY", "AUDITOR", "PARTNER_ADMIN", "PARTNER_OPERATOR", "CONTRACTOR_OPERATOR")
MIN_JUSTIFICATION = 10


def transition_rules(spark: SparkSession) -> DataFrame:
    """(from_state, to_state, role), a fixed table of a dozen rows."""
    rows = [(a, b, role) for (a, b), roles in TRANSITIONS.items() for role in roles]
    return spark.createDataFrame(rows, "from_state string, to_state string, role string")


def valid_targets(rules: DataFrame) -> DataFrame:
    """Sorted target states per state and role, joined by commas."""
    targets = F.array_join(F.sort_array(F.collect_set("to_state")), ",")  # at most one per state
    return rules.where(~F.col("from_state").isin(*TERMINAL)).groupBy("from_state", "role").agg(targets.alias("targets"))


def too_short(justification: Column) -> Column:
    return F.coalesce(F.length(strip(justification)) < MIN_JUSTIFICATION, F.lit(True))


def check_transitions(requests: DataFrame, rules: DataFrame) -> DataFrame:
    """Add ``code``, ``reason`` and ``valid_targets`` to (current_state, target_state, role, justification).

    Code 200 means the transition is allowed; the first failing check decides.
    """
    pairs = rules.select("from_state", "to_state").distinct().withColumn("_pair", F.lit(True))
    granted = rules.select("from_state", "to_state", "role").distinct().withColumn("_granted", F.lit(True))
    targets = pairs.groupBy("from_state").agg(F.array_join(F.sort_array(F.collect_set("to_state")), ",").alias("_targets"))
    current, target = F.col("current_state"), F.col("target_state")
    named = requests.withColumn("from_state", current).withColumn("to_state", target)
    joined = (
        named.join(small(pairs), ["from_state", "to_state"], "left")
        .join(small(granted), ["from_state", "to_state", "role"], "left")
        .join(small(targets), "from_state", "left")
    )
    checks = [
        (current.isNull(), 422, "state_required"),
        (too_short(F.col("justification")), 400, "justification_too_short"),
        (~current.isin(*STATES), 422, "unknown_state"),
        (~F.coalesce(target.isin(*STATES), F.lit(False)), 422, "unknown_target"),
        (current.isin(*TERMINAL), 422, "terminal_state"),
        (F.col("_pair").isNull(), 422, "undefined_transition"),
        (F.col("_granted").isNull(), 403, "role_not_authorized"),
    ]

    def verdict(code: int, reason: str) -> Column:
        return F.struct(F.lit(code).alias("code"), F.lit(reason).alias("reason"))

    failure = verdict(200, "ok")
    for broken, code, reason in reversed(checks):
        failure = F.when(broken, verdict(code, reason)).otherwise(failure)
    shown = F.col("_f.reason").isin("unknown_target", "undefined_transition")
    return joined.withColumn("_f", failure).select(
        *requests.columns,
        F.col("_f.code").alias("code"),
        F.col("_f.reason").alias("reason"),
        F.when(shown, F.coalesce("_targets", F.lit(""))).otherwise(F.lit("")).alias("valid_targets"),
    )


def request_rules():
    """(start, step) of the same rules for one attempt at a time, used by the streaming job."""
    allowed = {pair: frozenset(roles) for pair, roles in TRANSITIONS.items()}

    def start() -> dict:
        return {"state": INITIAL, "version": 1}

    def decide(now: dict, row) -> tuple[int, str]:
        if row.role not in ROLES:
            return 403, "unknown_role"
        if row.justification is None or len(row.justification.strip()) < MIN_JUSTIFICATION:
            return 400, "justification_too_short"
        if row.role in NEVER_CHANGE:
            return 403, "role_never_changes_state"
        if row.expected_version == row.expected_version and row.expected_version is not None:
            if int(row.expected_version) != now["version"]:
                return 409, "concurrent_change"
        if now["state"] in TERMINAL:
            return 409, "terminal_state"
        roles = allowed.get((now["state"], row.target_state))
        if roles is None:
            return 409, "undefined_transition"
        if row.role not in roles:
            return 403, "role_not_authorized"
        return 200, "ok"

    def step(now: dict, row) -> tuple[int, str, str, int]:
        code, reason = decide(now, row)
        if code == 200:
            now["state"], now["version"] = row.target_state, now["version"] + 1
        return code, reason, now["state"], now["version"]

    return start, step


REFUSALS = ((403, "unknown_role"), (400, "justification_too_short"), (403, "role_never_changes_state"))
OUTCOMES = (
    (200, "ok"), *REFUSALS, (409, "concurrent_change"), (409, "terminal_state"), (409, "undefined_transition"),
    (403, "role_not_authorized"),
)


def request_runs():
    """(read, judge): the same rules for many attempts on one request at a time.

    ``read`` makes numbers of the texts of a batch: (what an attempt asks for, the version it expects or NaN). What it
    asks for is a refusal that no state changes (1 to 3), or 4 and above for a pair of target and role. ``judge`` goes
    through attempts in order from (state, version) and gives their numbers in ``OUTCOMES``, and the rows and
    values of the changes: a request changes at most a few times, and all attempts between two changes meet the same
    state, so each stretch is judged at once.
    """
    targets = {state: i for i, state in enumerate(STATES)}
    roles = {role: i for i, role in enumerate(ROLES)}
    never = np.array([role in NEVER_CHANGE for role in ROLES] + [False])
    width = len(ROLES) + 1
    place = {name: i for i, (_, name) in enumerate(OUTCOMES)}
    tables = {}
    for state in STATES:
        table = np.full((len(STATES) + 1) * width, place["terminal_state" if state in TERMINAL else "undefined_transition"])
        for (source, target), granted in TRANSITIONS.items():
            if source == state and state not in TERMINAL:
                for role in range(width):
                    ok = role < len(ROLES) and ROLES[role] in granted
                    table[targets[target] * width + role] = place["ok" if ok else "role_not_authorized"]
        tables[state] = np.concatenate([np.arange(4), table]).astype(np.int8)

    def read(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        role = np.fromiter((roles.get(r, len(ROLES)) for r in rows["role"]), np.int16, len(rows))
        target = np.fromiter((targets.get(t, len(STATES)) for t in rows["target_state"]), np.int16, len(rows))
        short = np.fromiter((j is None or len(j.strip()) < MIN_JUSTIFICATION for j in rows["justification"]), bool, len(rows))
        asked = 4 + target * np.int16(width) + role
        refused = [role == len(ROLES), short, never[role]]
        asked = np.select(refused, [1, 2, 3], asked).astype(np.int16)
        return asked, np.trunc(rows["expected_version"].to_numpy(dtype="float64", na_value=np.nan))

    def judge(state: str, version: int, asked: np.ndarray, expected: np.ndarray):
        outcome, changes, start = np.empty(len(asked), np.int8), [], 0
        stale_free = np.isnan(expected)
        while start < len(asked):
            met = tables[state][asked[start:]]
            stale = (asked[start:] > 3) & ~stale_free[start:] & (expected[start:] != version)
            met[stale] = place["concurrent_change"]
            accepted = np.flatnonzero(met == 0)
            if not len(accepted):
                outcome[start:] = met
                break
            at = start + int(accepted[0])
            outcome[start : at + 1] = met[: at + 1 - start]
            state, version = STATES[(int(asked[at]) - 4) // width], version + 1
            changes.append((at, state, version))
            start = at + 1
        return outcome, changes

    return read, judge


def _situations() -> list[tuple[str, int]]:
    """All (state, version) pairs a request can be in, the initial one first."""
    found = [(INITIAL, 1)]
    for state, version in found:  # grows while it is read
        found.extend((b, version + 1) for a, b in TRANSITIONS if a == state and (b, version + 1) not in found)
    return found


SITUATIONS = _situations()
# One letter per situation. What attempts do to a request is a word with one letter per situation: where it
# leads from there. Words compose by ``translate``, in Spark and in Python alike.
LETTERS = "".join(chr(ord("a") + i) for i in range(len(SITUATIONS)))


def _compose(first: str, then: str) -> str:
    return first if then == LETTERS else first.translate(str.maketrans(LETTERS, then))


def _led_by(situation: Column, word: Column) -> Column:
    """Letter of the situation that a word leads to."""
    return F.call_function("translate", situation, F.lit(LETTERS), word)


def _granted(state: Column) -> Column:
    """Whether the attempt's target and role are allowed from a state."""
    allowed = [F.concat_ws(">", F.lit(a), F.lit(b), F.lit(r)) for (a, b), roles in TRANSITIONS.items() for r in roles]
    return F.coalesce(F.concat_ws(">", state, F.col("target_state"), F.col("role")).isin(*allowed), F.lit(False))


def _same_version(version: Column) -> Column:
    return F.col("expected_version").isNull() | (F.col("expected_version") == version)


def _word() -> Column:
    """What one attempt does in every situation; whether it is accepted depends on nothing else."""
    able = F.col("role").isin(*ROLES) & ~F.col("role").isin(*NEVER_CHANGE) & ~too_short(F.col("justification"))
    letter = dict(zip(SITUATIONS, LETTERS))
    leads = []
    for (state, version), stays in letter.items():
        there = F.lit(stays)
        for a, b in TRANSITIONS:
            if a == state:
                moves = able & (F.col("target_state") == b) & _granted(F.lit(a)) & _same_version(F.lit(version))
                there = F.when(moves, F.lit(letter[b, version + 1])).otherwise(there)
        leads.append(there)
    return F.concat(*leads)


def _dealt(log: DataFrame) -> DataFrame:
    """The log in order, dealt by ranges of (request, time), with the word of the attempts before each one
    in its range (``_before``) and with itself (``_after``): one pass, and a request may fill many ranges."""
    order = ["request_id", "attempted_at", "attempt_id", "target_state", "role", "justification", "expected_version"]
    parts = int(log.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = (
        log.withColumn("_word", _word())
        .repartitionByRange(parts, *order)
        .withColumn("_range", F.spark_partition_id())
        .sortWithinPartitions(*order)
    )
    return running_fold(ranges, ["request_id"], "_word", LETTERS, _compose, "_before", "_after").drop("_word")


def _met() -> Column:
    return (F.col("_range") == F.col("_at")) & F.col("request_id").eqNullSafe(F.col("_id"))


def _carried(dealt: DataFrame) -> DataFrame:
    """(_at, _id, _carry): the situation in which a request enters a range that it shares.

    Only the first and the last request of a range can be shared, so this is two rows a range at most.
    """
    request = F.struct("request_id")  # a struct orders null ids first, as the ranges do
    ends = dealt.groupBy("_range").agg(F.min(request).alias("_first"), F.max(request).alias("_last"))
    shared = F.explode(F.array_distinct(F.array("_first", "_last"))).alias("_end")
    wanted = ends.select(F.col("_range").alias("_at"), shared).select("_at", F.col("_end.request_id").alias("_id"))
    position = F.struct("attempted_at", "attempt_id", "target_state", "role", "justification", "expected_version")
    pieces = (
        dealt.join(F.broadcast(wanted), _met())
        .groupBy("request_id", "_range")
        .agg(F.max_by("_after", position).alias("_whole"))
    )
    ordered = pieces.repartition("request_id").sortWithinPartitions("request_id", "_range")
    return running_fold(ordered, ["request_id"], "_whole", LETTERS[0], _compose, "_carry", "_left").select(
        F.col("_range").alias("_at"), F.col("request_id").alias("_id"), "_carry"
    )


def replay_transitions(log: DataFrame) -> DataFrame:
    """Outcome of every attempt (request_id, attempt_id, attempted_at, target_state, role, justification,
    expected_version) in time order: code, reason, and the state and version after it.

    What attempts do composes associatively, so ranges of the log are folded side by side, however many
    attempts one request has, and each range starts from the situation that the ones before it lead to.
    Attempts without a request id belong to one request, those without a time come first, and attempts
    with the same time and id follow their other columns.
    """
    dealt = durable(_dealt(log))
    # At most two rows a range.
    placed = dealt.join(F.broadcast(_carried(dealt)), _met(), "left")
    situation = _led_by(F.coalesce("_carry", F.lit(LETTERS[0])), F.col("_before"))
    number = F.instr(F.lit(LETTERS), situation)
    states, versions = zip(*SITUATIONS)
    judged = placed.withColumn("_number", number).select(
        *log.columns,
        F.element_at(F.array(*map(F.lit, states)), F.col("_number")).alias("_state"),
        F.element_at(F.array(*map(F.lit, versions)), F.col("_number")).cast("long").alias("_version"),
    )
    now = F.col("_state")
    pairs = [F.concat_ws(">", F.lit(a), F.lit(b)) for a, b in TRANSITIONS]
    checks = [
        (~F.coalesce(F.col("role").isin(*ROLES), F.lit(False)), 403, "unknown_role"),
        (too_short(F.col("justification")), 400, "justification_too_short"),
        (F.col("role").isin(*NEVER_CHANGE), 403, "role_never_changes_state"),
        (~_same_version(F.col("_version")), 409, "concurrent_change"),
        (now.isin(*TERMINAL), 409, "terminal_state"),
        (~F.concat_ws(">", now, F.col("target_state")).isin(*pairs), 409, "undefined_transition"),
        (~_granted(now), 403, "role_not_authorized"),
    ]
    code, reason = F.lit(200), F.lit("ok")
    for broken, number, name in reversed(checks):
        code = F.when(broken, F.lit(number)).otherwise(code)
        reason = F.when(broken, F.lit(name)).otherwise(reason)
    result = judged.withColumns({"_code": code.cast("long"), "_reason": reason})
    accepted = F.col("_code") == 200
    return result.select(
        *log.columns,
        F.col("_code").alias("code"),
        F.col("_reason").alias("reason"),
        F.when(accepted, F.col("target_state")).otherwise(now).alias("state"),
        (F.col("_version") + accepted.cast("int")).alias("version"),
    )


def _absent(value: Column) -> Column:
    return F.coalesce(F.length(value.cast("string")) == 0, F.lit(True))


def create_requests(asked: DataFrame, partners: DataFrame, emails: DataFrame) -> DataFrame:
    """Add ``code``, ``reason``, ``radicado`` and ``current_state`` to new cancellation requests (request_id,
    case_id, requested_by, partner_id, sender_email, justification, asked_at).

    Code 201 creates the request in the initial state; the first failing check decides. Created requests keep
    the justification without outer blanks and the sender in lower case. The radicado follows from the day
    and ``request_id``, so that a repeated run gives the same.
    """
    judged = check_partner_sender(asked, partners, emails).withColumnRenamed("reason", "_denied")
    checks = [
        (_absent(F.col("partner_id")), 400, F.lit("partner_id_required")),
        (_absent(F.col("sender_email")), 400, F.lit("sender_email_required")),
        (~F.col("authorized"), 403, F.col("_denied")),
        (_absent(F.col("case_id")), 400, F.lit("case_id_required")),
        (too_short(F.col("justification")), 400, F.lit("justification_too_short")),
    ]
    code, reason = F.lit(201), F.lit("created")
    for broken, number, name in reversed(checks):
        code, reason = F.when(broken, F.lit(number)).otherwise(code), F.when(broken, name).otherwise(reason)
    created = F.col("code") == 201
    mark = F.upper(F.substring(F.sha2(F.col("request_id").cast("string"), 256), 1, 12))
    kept = {
        "justification": F.when(created, strip(F.col("justification"))).otherwise(F.col("justification")),
        "sender_email": F.when(created, F.lower("sender_email")).otherwise(F.col("sender_email")),
    }
    return judged.withColumns({"code": code, "reason": reason}).select(
        *[kept[c].alias(c) if c in kept else F.col(c) for c in asked.columns],
        "code",
        "reason",
        F.when(created, F.concat(F.lit("ANU-"), F.date_format("asked_at", "yyyyMMdd"), F.lit("-"), mark)).alias("radicado"),
        F.when(created, F.lit(INITIAL)).alias("current_state"),
    )


def creation_audit(checked: DataFrame, classification: str = "REAL_DATA") -> DataFrame:
    """Audit rows (user_id, action, resource, resource_id, result, details) of what :func:`create_requests` found:
    one for every request that was created, and one for every sender that its partner has not authorized."""
    created = F.col("code") == 201
    keep_nulls = {"ignoreNullFields": "false"}
    made = F.to_json(
        F.struct("case_id", "radicado", F.col("current_state").alias("initial_state"), "justification",
                 F.lit(classification).alias("data_classification"), "partner_id"), keep_nulls
    )
    refused = F.to_json(F.struct("sender_email", "partner_id", "reason"), keep_nulls)
    return checked.where(F.col("code").isin(201, 403)).select(
        F.coalesce(F.col("requested_by").cast("string"), F.lit("unknown")).alias("user_id"),
        F.when(created, F.lit("CREATE_ANNULATION")).otherwise(F.lit("EMAIL_AUTHORIZATION_DENIED")).alias("action"),
        F.lit("/api/annulations").alias("resource"),
        F.when(created, F.col("request_id").cast("string")).otherwise(F.col("partner_id").cast("string")).alias("resource_id"),
        F.when(created, F.lit("success")).otherwise(F.lit("failure")).alias("result"),
        F.when(created, made).otherwise(refused).alias("details"),
    )


def page(df: DataFrame, order: list[Column], number: int = 1, size: int = 20) -> DataFrame:
    """One page of an order that ends in a unique column, with the total beside each row."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    rows = df.orderBy(*order).offset((number - 1) * size).limit(size)
    return rows.crossJoin(F.broadcast(total))  # exactly one row


def requests_for(requests: DataFrame, users: DataFrame, email: str) -> DataFrame:
    """Requests opened by the user with an address."""
    owner = users.where(F.lower("email") == email.lower()).select(F.col("user_id").alias("requested_by"))
    return requests.join(owner, "requested_by", "left_semi")


def list_requests(
    requests: DataFrame, state: str | None = None, requested_by: str | int | None = None, number: int = 1, size: int = 20
) -> DataFrame:
    """Newest requests first, one page."""
    rows = requests
    if state:
        rows = rows.where(F.col("current_state") == state)
    if requested_by is not None:
        rows = rows.where(F.col("requested_by") == requested_by)
    return page(rows, [F.desc("created_at"), F.desc("request_id")], number, size)


def request_history(history: DataFrame, request_id: int) -> DataFrame:
    """State changes of one request in time order."""
    return history.where(F.col("request_id") == request_id).orderBy("transitioned_at", "transition_id")
