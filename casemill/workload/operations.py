"""Capacity, access, e-mail directory, requests, approvals, audit: tables derived from the driver tables."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from casemill.functions.severity import alert_level
from casemill.operators import access, approvals, audit, capacity, directory, requests
from casemill.operators.access import EMAIL_SHAPE, ROLES
from casemill.operators.requests import NEVER_CHANGE, STATES
from casemill.session import durable_dir
from casemill.sources import snapshots
from casemill.workload.registry import query, rnd
from casemill.workload.tables import table


def pick(values: Sequence[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values) + 1).cast("int"))


def pick_sql(values: Sequence[str], index: str) -> str:
    listed = ", ".join("'" + v + "'" for v in values)
    return f"([{listed}])[CAST(({index}) % {len(values)} + 1 AS INTEGER)]"


def _stamp(text: str) -> Column:
    return F.expr(f"timestamp_ntz'{text}'")


def _level_sql(value: str) -> str:
    return f"CASE WHEN {value} <= 85 THEN 'green' WHEN {value} <= 100 THEN 'yellow' WHEN {value} <= 120 THEN 'orange' ELSE 'red' END"


_USE_SQL = "CASE WHEN net_capacity > 0 THEN {load} / net_capacity * 100e0 WHEN {load} = 0 THEN 0e0 ELSE 100e0 END"


def _workers(spark, sf):
    return table(spark, sf, "supplier").select(
        F.col("s_name").alias("name"),
        (F.col("s_nationkey") * 4.0).alias("hours"),
        ((F.col("s_suppkey") % 5 + 5) / 10.0).alias("productivity_factor"),
        F.greatest(F.col("s_acctbal"), F.lit(0.0)).alias("assigned_work"),
    )


WORKERS = """workers AS (SELECT s_name AS name, s_nationkey * 4e0 AS hours, (s_suppkey % 5 + 5) / 10e0 AS productivity_factor,
  greatest(s_acctbal, 0e0) AS assigned_work FROM supplier)"""


@query(
    "ops01_capacity_by_user",
    f"""WITH {WORKERS} SELECT *, {_level_sql("utilization")} AS alert_level FROM (SELECT *, {_USE_SQL.format(load="assigned_work")} AS utilization
    FROM (SELECT *, hours * productivity_factor AS net_capacity FROM workers))""",
)
def capacity_by_user(spark, sf):
    return capacity.capacity_by_user(_workers(spark, sf))


@query("ops02_alert_level", f"SELECT o_orderkey, {_level_sql('o_totalprice / 3000')} AS alert_level FROM orders")
def alert_levels(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", alert_level(F.col("o_totalprice") / 3000).alias("alert_level"))


@query(
    "ops03_capacity_by_team",
    f"""SELECT *, {_level_sql("utilization")} AS alert_level FROM (SELECT *, {_USE_SQL.format(load="current_load")} AS utilization
    FROM (SELECT *, available_hours * 0.85e0 AS net_capacity FROM (SELECT c_nationkey AS team, count(*) AS analysts,
      count(*) FILTER (WHERE c_acctbal > 0) * 30e0 AS current_load, count(*) * 160e0 * 0.20e0 AS available_hours FROM customer GROUP BY 1)))""",
)
def capacity_by_team(spark, sf):
    teams = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("team")).agg(
        F.count(F.lit(1)).alias("analysts"), (F.count_if(F.col("c_acctbal") > 0) * 30.0).alias("current_load")
    )
    return capacity.capacity_by_team(teams)


@query(
    "ops04_capacity_report",
    f"""WITH {WORKERS} SELECT total_users, {rnd("net_capacity", 4)} AS net_capacity, {rnd("assigned_work", 2)} AS assigned_work,
      {rnd("utilization", 4)} AS utilization, {_level_sql("utilization")} AS alert_level FROM (SELECT *, {_USE_SQL.format(load="assigned_work")} AS utilization
    FROM (SELECT count(*) AS total_users, sum(hours * productivity_factor) AS net_capacity, sum(assigned_work) AS assigned_work FROM workers))""",
)
def capacity_report(spark, sf):
    report = capacity.capacity_report(_workers(spark, sf))
    places = {"net_capacity": 4, "assigned_work": 2, "utilization": 4}
    return report.withColumns({c: F.round(F.col(c) * float(10**p)) / float(10**p) for c, p in places.items()})


def _users(spark, sf):
    key = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        key.alias("user_id"),
        F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@"), F.lower("c_mktsegment"), F.lit(".example")).alias("email"),
        pick(ROLES, key).alias("role"),
        (F.col("c_acctbal") > 0).alias("is_active"),
        F.when(F.col("c_nationkey") % 4 != 0, _stamp("2024-01-01 00:00:00") + F.make_dt_interval(days=F.col("c_nationkey"))).alias("expires_at"),
    )


USERS = f"""users AS (SELECT c_custkey AS user_id, lower(replace(c_name, '#', '.')) || '@' || lower(c_mktsegment) || '.example' AS email,
  {pick_sql(ROLES, "c_custkey")} AS role, c_acctbal > 0 AS is_active,
  CASE WHEN c_nationkey % 4 <> 0 THEN TIMESTAMP '2024-01-01' + to_days(c_nationkey) END AS expires_at FROM customer)"""
DUE = "(is_active AND role IN ('INTERN_READONLY', 'CONTRACTOR_OPERATOR') AND expires_at IS NOT NULL AND expires_at <= TIMESTAMP '2024-01-15')"
NOW = "2024-01-15 00:00:00"


@query(
    "ops05_role_capacity",
    f"""WITH {USERS}, limits(role, capacity) AS (VALUES ('INTERN_READONLY', 12), ('CONTRACTOR_OPERATOR', 20), ('BUSINESS_OWNER', 10)),
      a AS (SELECT role, count(*) FILTER (WHERE is_active) AS active FROM users GROUP BY role)
    SELECT a.role, active, CAST(capacity AS BIGINT) AS capacity, CASE WHEN capacity IS NOT NULL THEN greatest(capacity - active, 0) ELSE 0 END AS room,
      coalesce(active < capacity, false) AS can_add, capacity IS NOT NULL AS is_known FROM a LEFT JOIN limits ON a.role = limits.role""",
)
def role_capacity(spark, sf):
    return access.role_capacity(_users(spark, sf), access.role_limits(spark))


@query("ops06_expire_users", f"WITH {USERS} SELECT user_id, email, role, is_active AND NOT {DUE} AS is_active, expires_at FROM users")
def expire_users(spark, sf):
    return access.expire_users(_users(spark, sf), _stamp(NOW))[0]


@query("ops06_expiry_audit", f"WITH {USERS} SELECT CAST(user_id AS VARCHAR) AS resource_id, 'USER_EXPIRED' AS action, 'success' AS result FROM users WHERE {DUE}")
def expiry_audit(spark, sf):
    return access.expire_users(_users(spark, sf), _stamp(NOW))[1].select("resource_id", "action", "result")


@query("ops07_missing_expiry", f"WITH {USERS} SELECT user_id, role FROM users WHERE role IN ('INTERN_READONLY', 'CONTRACTOR_OPERATOR') AND expires_at IS NULL")
def missing_expiry(spark, sf):
    return access.missing_expiry(_users(spark, sf)).select("user_id", "role")


_ASKED = ("READ_DASHBOARD", "EXPORT_DATA", "MANAGE_USERS", "INGEST_DATA", "FLY", "READ_AUDIT", "APPROVE_VP")
_ASKING = (*ROLES, "STRANGER")


@query(
    "ops08_authorize",
    f"""WITH log AS (SELECT event_id, {pick_sql(_ASKING, "user_id")} AS role, {pick_sql(_ASKED, "event_id")} AS permission FROM events),
      matrix(role, permission) AS (VALUES {", ".join(f"('{r}', '{p}')" for r, listed in access.ROLE_PERMISSIONS.items() for p in listed)})
    SELECT event_id, role, permission, EXISTS (SELECT 1 FROM matrix m WHERE m.role = log.role AND m.permission = log.permission) AS allowed FROM log""",
)
def authorize(spark, sf):
    log = table(spark, sf, "events").select(
        "event_id", pick(_ASKING, F.col("user_id")).alias("role"), pick(_ASKED, F.col("event_id")).alias("permission")
    )
    return access.authorize(log, access.permission_matrix(spark))


@query(
    "ops09_role_conflicts",
    f"""WITH a AS (SELECT DISTINCT user_id, {pick_sql(_ASKING, "event_id // 97 + user_id")} AS role FROM events WHERE value > 100)
    SELECT user_id, string_agg(role, ',' ORDER BY role) AS roles, count(*) AS n FROM a WHERE role <> 'STRANGER' GROUP BY user_id HAVING count(*) > 1""",
)
def role_conflicts(spark, sf):
    assigned = table(spark, sf, "events").where("value > 100").select(
        "user_id", pick(_ASKING, F.floor(F.col("event_id") / 97) + F.col("user_id")).alias("role")
    )
    return access.role_conflicts(assigned)


def _whitelist(spark, sf):
    users = _users(spark, sf)
    key = F.col("user_id")
    addresses = users.where("user_id % 5 = 0").select(
        F.lit("email").alias("kind"),
        F.concat(F.lit("  "), F.upper("email")).alias("entry"),
        F.when(key % 3 == 0, _stamp("2023-06-01 00:00:00")).when(key % 3 == 1, _stamp("2024-01-15 00:00:00")).alias("expires_at"),
    )
    domains = table(spark, sf, "customer").select(
        F.lit("domain").alias("kind"),
        F.concat(F.lower("c_mktsegment"), F.lit(".example")).alias("entry"),
        F.when(F.length("c_mktsegment") == 8, _stamp("2023-01-01 00:00:00")).when(F.length("c_mktsegment") == 9, _stamp("2025-01-01 00:00:00")).alias("expires_at"),
    ).where("length(entry) <> 17").distinct()
    return addresses.unionByName(domains)


def _senders(spark, sf):
    key = F.col("user_id")
    return _users(spark, sf).select(
        "user_id",
        F.when(key % 7 == 0, F.lit("no at sign")).when(key % 7 == 1, F.concat(F.lit("U"), key, F.lit("@Corp.Example "))).when(
            key % 7 == 2, F.concat(F.lit("a b@"), key)
        ).otherwise(F.col("email")).alias("email"),
    )


SENDERS = f"""{USERS}, senders AS (SELECT user_id, CASE user_id % 7 WHEN 0 THEN 'no at sign' WHEN 1 THEN 'U' || user_id || '@Corp.Example '
    WHEN 2 THEN 'a b@' || user_id ELSE email END AS email FROM users),
  addresses AS (SELECT lower(email) AS a, max(coalesce(CASE user_id % 3 WHEN 0 THEN TIMESTAMP '2023-06-01' WHEN 1 THEN TIMESTAMP '2024-01-15' END, TIMESTAMP '9999-12-31')) AS until
    FROM users WHERE user_id % 5 = 0 GROUP BY 1),
  domains AS (SELECT DISTINCT '@' || lower(c_mktsegment) || '.example' AS d,
    coalesce(CASE length(c_mktsegment) WHEN 8 THEN TIMESTAMP '2023-01-01' WHEN 9 THEN TIMESTAMP '2025-01-01' END, TIMESTAMP '9999-12-31') AS until
    FROM customer WHERE length(lower(c_mktsegment) || '.example') <> 17),
  j AS (SELECT s.*, regexp_matches(trim(s.email), '{EMAIL_SHAPE.replace("'", "''")}') AS valid,
    lower(trim(s.email)) LIKE '%@corp.example' AS corp, a.a IS NOT NULL AS ina, a.until > TIMESTAMP '2024-01-15' AS la,
    d.d IS NOT NULL AS ind, d.until > TIMESTAMP '2024-01-15' AS ld
    FROM senders s LEFT JOIN addresses a ON a.a = lower(trim(s.email))
    LEFT JOIN domains d ON d.d = '@' || list_last(string_split(lower(trim(s.email)), '@')) AND contains(s.email, '@')),
  k AS (SELECT *, valid AND (corp OR CASE WHEN ina THEN la ELSE coalesce(ld, false) END) AS authorized FROM j)"""


@query("ops10_authorize_emails", f"WITH {SENDERS} SELECT user_id, email, authorized FROM k")
def authorize_emails(spark, sf):
    return access.authorize_emails(_senders(spark, sf), _whitelist(spark, sf), _stamp(NOW)).drop("denial_reason")


@query(
    "ops11_denial_reason",
    f"""WITH {SENDERS} SELECT user_id, CASE WHEN NOT valid THEN 'INVALID_EMAIL_FORMAT' WHEN corp THEN 'UNKNOWN'
      WHEN ina AND NOT la THEN 'WHITELIST_ENTRY_EXPIRED' WHEN ind AND NOT ld THEN 'WHITELIST_DOMAIN_EXPIRED'
      ELSE 'EMAIL_NOT_IN_AUTHORIZED_LIST' END AS denial_reason FROM k WHERE NOT authorized""",
)
def denial_reason(spark, sf):
    checked = access.authorize_emails(_senders(spark, sf), _whitelist(spark, sf), _stamp(NOW))
    return checked.where(~F.col("authorized")).select("user_id", "denial_reason")


def _partners(spark, sf):
    supplier = table(spark, sf, "supplier")
    partners = supplier.where("s_suppkey % 10 <> 9").select(
        F.col("s_suppkey").alias("partner_id"),
        F.col("s_name").alias("name"),
        F.when(F.col("s_nationkey") % 5 == 0, F.lit("inactive")).otherwise(F.lit("active")).alias("status"),
    )
    emails = table(spark, sf, "customer").select(
        (F.col("c_custkey") % 120).alias("partner_id"),
        F.concat(F.lit(" P"), F.col("c_custkey") % 240, F.lit("@x.example")).alias("email"),
        ((F.col("c_nationkey") % 6 == 0) & (F.col("c_custkey") % 3 == 0)).alias("is_active"),
    )
    return partners, emails


PARTNERS = """partners AS (SELECT s_suppkey AS partner_id, s_name AS name, CASE WHEN s_nationkey % 5 = 0 THEN 'inactive' ELSE 'active' END AS status
    FROM supplier WHERE s_suppkey % 10 <> 9),
  emails AS (SELECT c_custkey % 120 AS partner_id, ' P' || (c_custkey % 240) || '@x.example' AS email,
    c_nationkey % 6 = 0 AND c_custkey % 3 = 0 AS is_active FROM customer),
  single AS (SELECT partner_id, min(lower(trim(email))) AS active_email FROM emails WHERE is_active GROUP BY 1)"""


@query(
    "join07_partner_context",
    f"""WITH {PARTNERS} SELECT partner_id, name, active_email FROM partners JOIN single USING (partner_id) WHERE status = 'active'
    ORDER BY partner_id LIMIT 1""",
)
def partner_context(spark, sf):
    return access.partner_context(*_partners(spark, sf))


@query(
    "ops12_partner_sender",
    f"""WITH {PARTNERS}, r AS (SELECT event_id, event_id % 115 AS partner_id, 'p' || (event_id % 230) || '@X.example' AS sender_email FROM events),
      c AS (SELECT r.*, CASE WHEN p.status IS NULL THEN 'partner_not_found' WHEN p.status <> 'active' THEN 'partner_inactive'
        WHEN active_email IS NULL THEN 'no_active_email_configured' WHEN lower(trim(sender_email)) <> active_email THEN 'email_mismatch' END AS reason
      FROM r LEFT JOIN partners p ON r.partner_id = p.partner_id LEFT JOIN single s ON r.partner_id = s.partner_id)
    SELECT event_id, partner_id, sender_email, reason IS NULL AS authorized, reason FROM c""",
)
def partner_sender(spark, sf):
    asked = table(spark, sf, "events").select(
        "event_id", (F.col("event_id") % 115).alias("partner_id"), F.concat(F.lit("p"), F.col("event_id") % 230, F.lit("@X.example")).alias("sender_email")
    )
    return access.check_partner_sender(asked, *_partners(spark, sf))


@query("ops13_active_email_conflicts", f"WITH {PARTNERS} SELECT partner_id, count(*) AS active_emails FROM emails WHERE is_active GROUP BY 1 HAVING count(*) > 1")
def active_email_conflicts(spark, sf):
    return access.active_email_conflicts(_partners(spark, sf)[1])


_DIRECTORY_STATES = ("activo", "activo", "inactivo", "suspendido")


def _directory(spark, sf):
    return _users(spark, sf).where("user_id % 9 <> 4").select("email", pick(_DIRECTORY_STATES, F.col("user_id")).alias("status"))


DIRECTORY = f"""{USERS}, dir AS (SELECT email, {pick_sql(_DIRECTORY_STATES, "user_id")} AS status FROM users WHERE user_id % 9 <> 4)"""


@query(
    "ops14_set_status",
    f"""WITH {DIRECTORY}, listed AS (SELECT email FROM users WHERE user_id % 2 = 0) SELECT email,
      CASE WHEN email IN (SELECT email FROM listed) THEN 'inactivo' ELSE status END AS status,
      email IN (SELECT email FROM listed) AND status <> 'inactivo' AS changed FROM dir""",
)
def set_status(spark, sf):
    listed = _users(spark, sf).where("user_id % 2 = 0").select(F.upper("email").alias("email"))
    return directory.set_status(_directory(spark, sf), listed, directory.INACTIVE)


@query(
    "ops14_directory_page",
    f"""WITH {DIRECTORY} SELECT email, (SELECT count(*) FROM dir WHERE status = 'activo') AS total FROM dir WHERE status = 'activo'
    ORDER BY email LIMIT 25 OFFSET 50""",
)
def directory_page(spark, sf):
    rows = directory.list_by_status(_directory(spark, sf), directory.ACTIVE).select("email")
    return requests.page(rows, [F.col("email")], number=3, size=25)


def _send_log(spark, sf):
    """Ten sends per second by three senders, one of them with most of the load."""
    key = F.col("event_id")
    users = _users(spark, sf).select("user_id", "email")
    return (
        table(spark, sf, "events")
        .select(
            key.alias("send_id"),
            F.when(F.col("user_id") % 10 < 6, F.lit(0)).otherwise(F.col("user_id") % 2 + 1).alias("sender"),
            F.col("user_id"),
            F.timestamp_micros((key * 100_000 + 1_704_067_200_000_000)).alias("sent_at"),
        )
        .join(users, "user_id", "left")
        .select("send_id", "sender", F.coalesce("email", F.lit("nobody")).alias("recipient"), "sent_at")
    )


SEND_LOG = f"""{DIRECTORY}, log AS (SELECT event_id AS send_id, CASE WHEN e.user_id % 10 < 6 THEN 0 ELSE e.user_id % 2 + 1 END AS sender,
  coalesce(email, 'nobody') AS recipient FROM events e LEFT JOIN users u ON u.user_id = e.user_id)"""


@query("ops15_send_outcomes")
def send_outcomes(spark, sf):
    return directory.send_outcomes(_send_log(spark, sf), _directory(spark, sf))


@query(
    "ops15_send_refusals",
    f"""WITH {SEND_LOG} SELECT send_id, sender, recipient, CASE WHEN status IS NULL THEN 'not_in_directory' ELSE 'inactive' END AS outcome
    FROM log LEFT JOIN dir ON recipient = email WHERE status IS NULL OR status <> 'activo'""",
)
def send_refusals(spark, sf):
    rows = directory.send_outcomes(_send_log(spark, sf), _directory(spark, sf))
    return rows.where(F.col("outcome").isin("not_in_directory", "inactive")).drop("sent_at")


@query(
    "ops15_busy_minutes",
    f"""WITH {SEND_LOG} SELECT sender, send_id // 600 AS minute, count(*) AS attempts, greatest(count(*) - 100, 0) AS beyond_limit
    FROM log GROUP BY 1, 2""",
)
def busy_minutes(spark, sf):
    start = F.lit(1_704_067_200)
    rows = directory.busy_upper_bound(_send_log(spark, sf))
    return rows.withColumn("minute", F.floor((F.unix_timestamp("minute") - start) / 60))


@query(
    "ops28_add_entries",
    f"""WITH {DIRECTORY}, n AS (SELECT email, min(user_id) AS arrival FROM users GROUP BY 1),
      m AS (SELECT n.*, dir.email IS NOT NULL AS known FROM n LEFT JOIN dir USING (email)),
      f AS (SELECT *, row_number() OVER (PARTITION BY known ORDER BY arrival, email) AS place FROM m)
    SELECT email, arrival, CASE WHEN known THEN 'exists' WHEN place <= (SELECT greatest(1400 - count(*), 0) FROM dir) THEN 'added' ELSE 'directory_full' END AS outcome FROM f""",
)
def add_entries(spark, sf):
    new = _users(spark, sf).select(F.concat(F.lit(" "), F.upper("email")).alias("email"), F.col("user_id").alias("arrival"))
    return directory.add_entries(_directory(spark, sf), new, cap=1400)


_STATES_SEEN = (*STATES, "Otra")
_JUSTIFY = ("short", "  padded  ", "a reason long enough", "another good reason")


def _attempts(spark, sf):
    key, owner = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf, "orders").select(
        key.alias("attempt_id"),
        F.when(owner % 13 != 0, pick(_STATES_SEEN, key)).alias("current_state"),
        pick(_STATES_SEEN, F.floor(key / 7)).alias("target_state"),
        pick(_ASKING, owner).alias("role"),
        pick(_JUSTIFY, owner + key).alias("justification"),
    )


def _rules_sql() -> str:
    rows = ", ".join(f"('{a}', '{b}', '{r}')" for (a, b), roles in requests.TRANSITIONS.items() for r in roles)
    return f"rules(from_state, to_state, role) AS (VALUES {rows})"


_STATE_LIST = ", ".join(f"'{s}'" for s in STATES)
ATTEMPTS = f"""attempts AS (SELECT o_orderkey AS attempt_id, CASE WHEN o_custkey % 13 <> 0 THEN {pick_sql(_STATES_SEEN, "o_orderkey")} END AS current_state,
  {pick_sql(_STATES_SEEN, "o_orderkey // 7")} AS target_state, {pick_sql(_ASKING, "o_custkey")} AS role,
  {pick_sql(_JUSTIFY, "o_custkey + o_orderkey")} AS justification FROM orders), {_rules_sql()},
  r AS (SELECT *, CASE WHEN current_state IS NULL THEN 'state_required' WHEN length(trim(justification)) < 10 THEN 'justification_too_short'
    WHEN current_state NOT IN ({_STATE_LIST}) THEN 'unknown_state' WHEN target_state NOT IN ({_STATE_LIST}) THEN 'unknown_target'
    WHEN current_state IN ('Cerrada', 'Rechazada') THEN 'terminal_state'
    WHEN NOT EXISTS (SELECT 1 FROM rules u WHERE u.from_state = current_state AND u.to_state = target_state) THEN 'undefined_transition'
    WHEN NOT EXISTS (SELECT 1 FROM rules u WHERE u.from_state = current_state AND u.to_state = target_state AND u.role = attempts.role) THEN 'role_not_authorized'
    ELSE 'ok' END AS reason FROM attempts)"""


@query(
    "ops16_check_transitions",
    f"""WITH {ATTEMPTS} SELECT attempt_id, current_state, target_state, role, justification, reason,
      CASE reason WHEN 'ok' THEN 200 WHEN 'justification_too_short' THEN 400 WHEN 'role_not_authorized' THEN 403 ELSE 422 END AS code,
      CASE WHEN reason IN ('unknown_target', 'undefined_transition') THEN coalesce((SELECT string_agg(DISTINCT to_state, ',' ORDER BY to_state)
        FROM rules u WHERE u.from_state = r.current_state), '') ELSE '' END AS valid_targets FROM r""",
)
def check_transitions(spark, sf):
    return requests.check_transitions(_attempts(spark, sf), requests.transition_rules(spark))


@query(
    "ops17_valid_targets",
    f"""WITH {ATTEMPTS} SELECT attempt_id, targets FROM attempts a JOIN (SELECT from_state, role, string_agg(to_state, ',' ORDER BY to_state) AS targets
      FROM rules WHERE from_state NOT IN ('Cerrada', 'Rechazada') GROUP BY 1, 2) t ON a.current_state = t.from_state AND a.role = t.role""",
)
def valid_targets(spark, sf):
    targets = requests.valid_targets(requests.transition_rules(spark)).withColumnRenamed("from_state", "current_state")
    return _attempts(spark, sf).join(targets, ["current_state", "role"]).select("attempt_id", "targets")


_WHY = (" a long enough reason ", "short", None, "another good reason")


def _asked(spark, sf):
    key = F.col("event_id")
    partner = F.when(key % 11 == 0, F.lit(None)).otherwise(key % 115)
    return table(spark, sf, "events").select(
        key.alias("request_id"),
        F.when(key % 13 != 0, F.col("user_id")).alias("case_id"),
        F.col("user_id").alias("requested_by"),
        partner.cast("long").alias("partner_id"),
        F.when(key % 17 == 0, F.lit("")).otherwise(F.concat(F.lit("P"), key % 230, F.lit("@x.Example"))).alias("sender_email"),
        pick(_WHY, F.floor(key / 3)).alias("justification"),
        F.col("ts").alias("asked_at"),
    )


ASKED = f"""{PARTNERS}, asked AS (SELECT event_id AS request_id, CASE WHEN event_id % 13 <> 0 THEN user_id END AS case_id,
    user_id AS requested_by, CASE WHEN event_id % 11 <> 0 THEN event_id % 115 END AS partner_id,
    CASE WHEN event_id % 17 = 0 THEN '' ELSE 'P' || (event_id % 230) || '@x.Example' END AS sender_email,
    ([' a long enough reason ', 'short', NULL, 'another good reason'])[CAST(event_id // 3 % 4 + 1 AS INTEGER)] AS justification, ts AS asked_at
    FROM events),
  seen AS (SELECT asked.*, CASE WHEN asked.partner_id IS NULL THEN 'partner_id_required' WHEN sender_email = '' THEN 'sender_email_required'
      WHEN p.status IS NULL THEN 'partner_not_found' WHEN p.status <> 'active' THEN 'partner_inactive'
      WHEN active_email IS NULL THEN 'no_active_email_configured' WHEN lower(trim(sender_email)) <> active_email THEN 'email_mismatch'
      WHEN case_id IS NULL THEN 'case_id_required' WHEN coalesce(length(trim(justification)), 0) < 10 THEN 'justification_too_short'
      ELSE 'created' END AS reason
    FROM asked LEFT JOIN partners p ON asked.partner_id = p.partner_id LEFT JOIN single s ON asked.partner_id = s.partner_id),
  made AS (SELECT request_id, case_id, requested_by, partner_id, CASE reason WHEN 'created' THEN lower(sender_email) ELSE sender_email END AS sender_email,
    CASE reason WHEN 'created' THEN trim(justification) ELSE justification END AS justification, asked_at,
    CASE WHEN reason = 'created' THEN 201 WHEN reason IN ('partner_not_found', 'partner_inactive', 'no_active_email_configured', 'email_mismatch') THEN 403 ELSE 400 END AS code,
    reason, CASE reason WHEN 'created' THEN 'ANU-' || strftime(asked_at, '%Y%m%d') || '-' || upper(substr(sha256(CAST(request_id AS VARCHAR)), 1, 12)) END AS radicado,
    CASE reason WHEN 'created' THEN 'Solicitada' END AS current_state FROM seen)"""


@query("ops16_create_requests", f"WITH {ASKED} SELECT * FROM made")
def create_requests(spark, sf):
    return requests.create_requests(_asked(spark, sf), *_partners(spark, sf))


@query(
    "ops16_creation_audit",
    f"""WITH {ASKED} SELECT CAST(requested_by AS VARCHAR) AS user_id, '/api/annulations' AS resource,
      CASE code WHEN 201 THEN 'CREATE_ANNULATION' ELSE 'EMAIL_AUTHORIZATION_DENIED' END AS action,
      CAST(CASE code WHEN 201 THEN request_id ELSE partner_id END AS VARCHAR) AS resource_id,
      CASE code WHEN 201 THEN 'success' ELSE 'failure' END AS result,
      CAST(CASE code WHEN 201 THEN json_object('case_id', case_id, 'radicado', radicado, 'initial_state', current_state, 'justification', justification,
        'data_classification', 'REAL_DATA', 'partner_id', partner_id)
        ELSE json_object('sender_email', sender_email, 'partner_id', partner_id, 'reason', reason) END AS VARCHAR) AS details
    FROM made WHERE code IN (201, 403)""",
)
def creation_audit(spark, sf):
    return requests.creation_audit(requests.create_requests(_asked(spark, sf), *_partners(spark, sf)))


def _transition_log(spark, sf):
    """Attempts on one request per customer, a third of them on a single request."""
    key = F.col("event_id")
    good = ("En_Revision", "Aprobada", "En_Ejecucion", "Cerrada", "Rechazada")
    return table(spark, sf, "events").select(
        F.when(key % 3 == 0, F.lit(0)).otherwise(F.col("user_id")).alias("request_id"),
        key.alias("attempt_id"),
        F.col("ts").alias("attempted_at"),
        pick(good, key).alias("target_state"),
        F.when(key % 4 != 0, F.lit("SYSTEM_ADMIN")).otherwise(pick(_ASKING, F.floor(key / 4))).alias("role"),
        pick(_JUSTIFY, F.floor(key / 5) + 2).alias("justification"),
        F.when(key % 5 == 0, (key % 4 + 1).cast("long")).alias("expected_version"),
    )


def _replay_sql() -> str:
    """The same rounds in SQL: the earliest accepted attempt after the last change, four times."""
    known = ", ".join(f"'{r}'" for r in ROLES)
    never = ", ".join(f"'{r}'" for r in NEVER_CHANGE)
    good = ("En_Revision", "Aprobada", "En_Ejecucion", "Cerrada", "Rechazada")
    rounds = []
    for k in range(1, 5):
        before = "'Solicitada'" if k == 1 else "p.target_state"
        source = "eligible e" if k == 1 else f"eligible e JOIN c{k - 1} p ON e.request_id = p.request_id AND (e.attempted_at, e.attempt_id) > (p.attempted_at, p.attempt_id)"
        rounds.append(
            f"""c{k} AS (SELECT request_id, attempted_at, attempt_id, target_state FROM (SELECT e.*, row_number() OVER (PARTITION BY e.request_id ORDER BY e.attempted_at, e.attempt_id) AS place
              FROM {source} WHERE (e.expected_version IS NULL OR e.expected_version = {k})
                AND EXISTS (SELECT 1 FROM rules u WHERE u.from_state = {before} AND u.to_state = e.target_state AND u.role = e.role)) WHERE place = 1)"""
        )
    every = " UNION ALL ".join(f"SELECT *, {k} AS k FROM c{k}" for k in range(1, 5))
    return f"""WITH {_rules_sql()}, log AS (SELECT CASE WHEN event_id % 3 = 0 THEN 0 ELSE user_id END AS request_id, event_id AS attempt_id, ts AS attempted_at,
        {pick_sql(good, "event_id")} AS target_state,
        CASE WHEN event_id % 4 <> 0 THEN 'SYSTEM_ADMIN' ELSE {pick_sql(_ASKING, "event_id // 4")} END AS role,
        {pick_sql(_JUSTIFY, "event_id // 5 + 2")} AS justification,
        CASE WHEN event_id % 5 = 0 THEN event_id % 4 + 1 END AS expected_version FROM events),
      eligible AS (SELECT * FROM log WHERE role IN ({known}) AND role NOT IN ({never}) AND length(trim(justification)) >= 10),
      {", ".join(rounds)}, changes AS ({every}),
      judged AS (SELECT l.*, coalesce((SELECT count(*) FROM changes c WHERE c.request_id = l.request_id AND (c.attempted_at, c.attempt_id) < (l.attempted_at, l.attempt_id)), 0) AS n,
        EXISTS (SELECT 1 FROM changes c WHERE c.request_id = l.request_id AND c.attempt_id = l.attempt_id) AS ok FROM log l),
      stated AS (SELECT j.*, coalesce(c.target_state, 'Solicitada') AS before FROM judged j LEFT JOIN changes c ON c.request_id = j.request_id AND c.k = j.n),
      r AS (SELECT *, CASE WHEN role NOT IN ({known}) THEN 'unknown_role' WHEN length(trim(justification)) < 10 THEN 'justification_too_short'
        WHEN role IN ({never}) THEN 'role_never_changes_state' WHEN expected_version <> n + 1 THEN 'concurrent_change'
        WHEN before IN ('Cerrada', 'Rechazada') THEN 'terminal_state'
        WHEN NOT EXISTS (SELECT 1 FROM rules u WHERE u.from_state = before AND u.to_state = target_state) THEN 'undefined_transition'
        WHEN NOT EXISTS (SELECT 1 FROM rules u WHERE u.from_state = before AND u.to_state = target_state AND u.role = stated.role) THEN 'role_not_authorized'
        ELSE 'ok' END AS reason FROM stated)
    SELECT request_id, attempt_id, attempted_at, target_state, role, justification, expected_version, reason,
      CASE WHEN reason = 'ok' THEN 200 WHEN reason = 'justification_too_short' THEN 400
        WHEN reason IN ('concurrent_change', 'terminal_state', 'undefined_transition') THEN 409 ELSE 403 END AS code,
      CASE WHEN ok THEN target_state ELSE before END AS state, n + 1 + ok::INT AS version FROM r"""


@query("ops18_replay_transitions", _replay_sql())
def replay_transitions(spark, sf):
    return requests.replay_transitions(_transition_log(spark, sf))


def _requests(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("request_id"),
        F.col("o_custkey").alias("requested_by"),
        pick(STATES, F.col("o_orderkey")).alias("current_state"),
        F.col("o_orderdate").alias("created_at"),
    )


REQUESTS = f"""requests AS (SELECT o_orderkey AS request_id, o_custkey AS requested_by, {pick_sql(STATES, "o_orderkey")} AS current_state,
  o_orderdate AS created_at FROM orders)"""


@query(
    "ops19_list_requests",
    f"""WITH {REQUESTS} SELECT *, (SELECT count(*) FROM requests WHERE current_state = 'Aprobada') AS total FROM requests
    WHERE current_state = 'Aprobada' ORDER BY created_at DESC, request_id DESC LIMIT 20 OFFSET 20""",
)
def list_requests(spark, sf):
    return requests.list_requests(_requests(spark, sf), state="Aprobada", number=2)


@query(
    "ops19_request_history",
    f"""SELECT user_id AS request_id, event_id AS transition_id, ts AS transitioned_at, {pick_sql(STATES, "event_id")} AS to_state
    FROM events WHERE user_id = 7""",
)
def request_history(spark, sf):
    history = table(spark, sf, "events").select(
        F.col("user_id").alias("request_id"),
        F.col("event_id").alias("transition_id"),
        F.col("ts").alias("transitioned_at"),
        pick(STATES, F.col("event_id")).alias("to_state"),
    )
    return requests.request_history(history, 7)


@query(
    "join04_requests_for",
    f"""WITH {REQUESTS}, {USERS} SELECT * FROM requests WHERE requested_by IN
    (SELECT user_id FROM users WHERE lower(email) = (SELECT min(email) FROM users))""",
)
def requests_for(spark, sf):
    users = _users(spark, sf)
    first = users.agg(F.min("email")).first()[0]
    return requests.requests_for(_requests(spark, sf), users, first.upper())


_OPERATIONS = (*approvals.APPROVERS, "SOMETHING_ELSE")
_APPROVERS = ("LEGAL_APPROVER", "VP_APPROVER", "ANALYST")
SNAPSHOT = "1998-06-01 12:00:00"


def _approvals(spark, sf):
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    return table(spark, sf, "orders").select(
        key.alias("approval_id"),
        (F.col("o_custkey") % 700).alias("application_id"),
        F.col("o_custkey").alias("requester_id"),
        pick(_OPERATIONS, key).alias("operation"),
        (key % 3 + 1).cast("int").alias("step_order"),
        pick(_APPROVERS[:2], F.floor(key / 3)).alias("approver_role"),
        F.when(status == "F", F.lit("approved")).when(status == "O", F.lit("pending")).otherwise(F.lit("rejected")).alias("status"),
        F.col("o_orderdate").alias("requested_at"),
        (F.col("o_orderdate") + F.make_dt_interval(hours=F.lit(approvals.EXPIRY_HOURS))).alias("expires_at"),
    )


APPROVALS = f"""approvals AS (SELECT o_orderkey AS approval_id, o_custkey % 700 AS application_id, o_custkey AS requester_id, {pick_sql(_OPERATIONS, "o_orderkey")} AS operation,
  CAST(o_orderkey % 3 + 1 AS INTEGER) AS step_order, {pick_sql(_APPROVERS[:2], "o_orderkey // 3")} AS approver_role,
  CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'O' THEN 'pending' ELSE 'rejected' END AS status,
  o_orderdate AS requested_at, o_orderdate + INTERVAL 72 HOUR AS expires_at FROM orders)"""
OVERDUE = f"(status = 'pending' AND TIMESTAMP '{SNAPSHOT}' > expires_at)"


@query("ops20_expire_approvals", f"WITH {APPROVALS} SELECT approval_id, CASE WHEN {OVERDUE} THEN 'expired' ELSE status END AS status, expires_at FROM approvals")
def expire_approvals(spark, sf):
    return approvals.expire_approvals(_approvals(spark, sf), _stamp(SNAPSHOT))[0].select("approval_id", "status", "expires_at")


@query("ops20_expiry_audit", f"WITH {APPROVALS} SELECT 'SYSTEM' AS user_id, 'APPROVAL_AUTO_EXPIRED' AS action, CAST(approval_id AS VARCHAR) AS resource_id, 'success' AS result FROM approvals WHERE {OVERDUE}")
def approval_audit(spark, sf):
    return approvals.expire_approvals(_approvals(spark, sf), _stamp(SNAPSHOT))[1]


@query("ops21_pending_approvals", f"WITH {APPROVALS} SELECT * FROM approvals WHERE status = 'pending' AND NOT {OVERDUE} AND approver_role = 'VP_APPROVER'")
def pending_approvals(spark, sf):
    return approvals.pending_approvals(_approvals(spark, sf), _stamp(SNAPSHOT), role="VP_APPROVER")


@query(
    "ops21_operations_approved",
    f"""WITH {APPROVALS}, wanted AS (SELECT event_id, user_id AS requester_id, {pick_sql(_OPERATIONS, "event_id")} AS operation FROM events)
    SELECT w.*, EXISTS (SELECT 1 FROM approvals a WHERE a.operation = w.operation AND a.requester_id = w.requester_id AND status = 'approved'
      AND TIMESTAMP '{SNAPSHOT}' <= expires_at) AS approved FROM wanted w""",
)
def operations_approved(spark, sf):
    wanted = table(spark, sf, "events").select(
        "event_id", F.col("user_id").alias("requester_id"), pick(_OPERATIONS, F.col("event_id")).alias("operation")
    )
    return approvals.operations_approved(wanted, _approvals(spark, sf), _stamp(SNAPSHOT))


def _approval_rules_sql() -> str:
    rows = ", ".join(
        f"('{o}', {i}, '{r}', {str(o in approvals.SEQUENTIAL).lower()})"
        for o, roles in approvals.APPROVERS.items()
        for i, r in enumerate(roles, start=1)
    )
    return f"rules(operation, step_order, role, sequential) AS (VALUES {rows})"


def _approval_requests(spark, sf):
    key = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        key.alias("request_id"),
        pick(_OPERATIONS, key).alias("operation"),
        pick(_APPROVERS, F.col("o_custkey")).alias("approver_role"),
        pick(_JUSTIFY, F.floor(key / 5)).alias("justification"),
        F.col("o_orderdate").alias("requested_at"),
    )


APPROVAL_REQUESTS = f"""asked AS (SELECT o_orderkey AS request_id, {pick_sql(_OPERATIONS, "o_orderkey")} AS operation, {pick_sql(_APPROVERS, "o_custkey")} AS approver_role,
  {pick_sql(_JUSTIFY, "o_orderkey // 5")} AS justification, o_orderdate AS requested_at FROM orders), {_approval_rules_sql()}"""


@query(
    "ops22_missing_approvers",
    f"""WITH {APPROVAL_REQUESTS}, {APPROVALS} SELECT request_id, asked.operation, role FROM asked JOIN rules ON rules.operation = asked.operation
    WHERE NOT EXISTS (SELECT 1 FROM approvals a WHERE a.approval_id = request_id AND a.approver_role = role AND a.status = 'approved')""",
)
def missing_approvers(spark, sf):
    given = _approvals(spark, sf).withColumnRenamed("approval_id", "request_id")
    return approvals.missing_approvers(_approval_requests(spark, sf), given, approvals.approval_rules(spark))


@query(
    "ops25_check_approval_requests",
    f"""WITH {APPROVAL_REQUESTS}, o AS (SELECT *, CASE WHEN operation NOT IN (SELECT operation FROM rules) THEN 'unknown_operation'
      WHEN NOT EXISTS (SELECT 1 FROM rules WHERE rules.operation = asked.operation AND role = approver_role) THEN 'role_not_required'
      WHEN length(justification) < 10 THEN 'justification_too_short' ELSE 'accepted' END AS outcome FROM asked)
    SELECT *, CASE WHEN outcome = 'accepted' THEN 'pending' END AS status, CASE WHEN outcome = 'accepted' THEN requested_at + INTERVAL 72 HOUR END AS expires_at FROM o""",
)
def check_approval_requests(spark, sf):
    return approvals.check_approval_requests(_approval_requests(spark, sf), approvals.approval_rules(spark))


@query(
    "ops26_expand_steps",
    f"""WITH {APPROVAL_REQUESTS} SELECT request_id, asked.operation, step_order, role AS approver_role FROM asked JOIN rules ON rules.operation = asked.operation
    WHERE sequential OR step_order = 1""",
)
def expand_steps(spark, sf):
    asked = _approval_requests(spark, sf).select("request_id", "operation")
    return approvals.expand_steps(asked, approvals.approval_rules(spark))


_DECIDERS = ("LEGAL_APPROVER", "VP_APPROVER", "SYSTEM_ADMIN")


def _decisions(spark, sf):
    number = F.col("l_linenumber")
    return table(spark, sf, "lineitem").select(
        F.when(number == 7, F.col("l_orderkey") + 10**12).otherwise(F.col("l_orderkey")).alias("approval_id"),
        pick(_DECIDERS, number).alias("approver_role"),
        F.when(F.col("l_returnflag") == "R", F.lit("rejected")).otherwise(F.lit("approved")).alias("decision"),
        pick(_JUSTIFY, F.col("l_suppkey")).alias("justification"),
        F.col("l_shipdate").alias("decided_at"),
        (F.col("l_orderkey") * 10 + number).alias("decision_id"),
    )


DECISIONS = f"""decisions AS (SELECT CASE WHEN l_linenumber = 7 THEN l_orderkey + 1000000000000 ELSE l_orderkey END AS approval_id, {pick_sql(_DECIDERS, "l_linenumber")} AS approver_role,
  CASE WHEN l_returnflag = 'R' THEN 'rejected' ELSE 'approved' END AS decision, {pick_sql(_JUSTIFY, "l_suppkey")} AS justification,
  l_shipdate AS decided_at, l_orderkey * 10 + l_linenumber AS decision_id FROM lineitem),
  waiting AS (SELECT v.approval_id FROM approvals v WHERE v.approver_role = 'VP_APPROVER' AND EXISTS (SELECT 1 FROM approvals l
    WHERE l.application_id = v.application_id AND l.approver_role = 'LEGAL_APPROVER' AND l.status <> 'approved' AND l.step_order < v.step_order))"""


def _decision_sql(strict: bool) -> str:
    role = "d.approver_role <> a.approver_role" + (" AND d.approver_role <> 'SYSTEM_ADMIN'" if strict else "")
    blocked = "WHEN a.approval_id IN (SELECT approval_id FROM waiting) THEN 'SEQUENTIAL_VIOLATION'" if strict else ""
    place = "ROW(decided_at, decision_id)"
    return f"""WITH {APPROVALS}, {DECISIONS}, judged AS (
      SELECT d.*, a.status, CASE WHEN length(justification) < 10 THEN 'VALIDATION_ERROR' WHEN a.approval_id IS NULL THEN 'NOT_FOUND'
        WHEN a.status <> 'pending' THEN 'INVALID_STATUS' WHEN TIMESTAMP '{SNAPSHOT}' > expires_at THEN 'EXPIRED'
        WHEN {role} THEN 'ROLE_MISMATCH' {blocked} ELSE 'APPLIED' END AS seen
      FROM decisions d LEFT JOIN approvals a ON a.approval_id = d.approval_id),
    first AS (SELECT approval_id AS first_id, min({place}) AS place, arg_min(decision, {place}) AS decided
      FROM judged WHERE seen = 'APPLIED' GROUP BY approval_id),
    placed AS (SELECT *, coalesce({place} > place, false) AS late FROM judged LEFT JOIN first ON first_id = approval_id),
    ordered AS (SELECT *, CASE WHEN late AND seen IN ('APPLIED', 'EXPIRED', 'ROLE_MISMATCH', 'SEQUENTIAL_VIOLATION')
      THEN 'INVALID_STATUS' ELSE seen END AS outcome FROM placed)
    SELECT approval_id, approver_role, decision, justification, decided_at, decision_id, outcome,
      CASE WHEN outcome = 'APPLIED' THEN decision WHEN outcome = 'EXPIRED' THEN 'expired' WHEN late THEN decided ELSE status END AS new_status
    FROM ordered"""


@query("ops27_check_decisions", _decision_sql(False))
def check_decisions(spark, sf):
    return approvals.check_decisions(_decisions(spark, sf), _approvals(spark, sf), _stamp(SNAPSHOT))


@query(
    "ops27_decision_audit",
    f"""WITH d AS ({_decision_sql(False)}), {APPROVALS}, j AS (
      SELECT d.*, CAST(d.approval_id % 97 AS VARCHAR) AS user_id, a.operation, a.approver_role AS required
      FROM d JOIN approvals a ON a.approval_id = d.approval_id),
    e AS (SELECT approval_id, arg_min(decision, ROW(decided_at, decision_id)) AS decision, min(user_id) AS user_id
      FROM j WHERE outcome = 'EXPIRED' GROUP BY approval_id)
    SELECT user_id, CASE WHEN outcome = 'APPLIED' THEN CASE decision WHEN 'approved' THEN 'APPROVAL_GRANTED' ELSE 'APPROVAL_REJECTED' END
        WHEN decision = 'approved' THEN 'APPROVAL_DENIED' ELSE 'APPROVAL_REJECT_DENIED' END AS action,
      '/api/approvals' AS resource, CAST(approval_id AS VARCHAR) AS resource_id,
      CASE outcome WHEN 'APPLIED' THEN 'success' ELSE 'failure' END AS result,
      CAST(CASE outcome WHEN 'APPLIED' THEN json_object('operation', operation, 'justification', justification)
        ELSE json_object('reason', 'role_mismatch', 'required_role', required, 'actual_role', approver_role) END AS VARCHAR) AS details
    FROM j WHERE outcome IN ('APPLIED', 'ROLE_MISMATCH')
    UNION ALL SELECT user_id, 'APPROVAL_EXPIRED', '/api/approvals', CAST(approval_id AS VARCHAR), 'failure',
      CAST(json_object('reason', '72-hour expiration window exceeded') AS VARCHAR) FROM e WHERE decision = 'approved'""",
)
def decision_audit(spark, sf):
    known = _approvals(spark, sf)
    named = _decisions(spark, sf).withColumn("approver_id", (F.col("approval_id") % 97).cast("string"))
    return approvals.decision_audit(approvals.check_decisions(named, known, _stamp(SNAPSHOT)), known)


@query("ops27_check_decisions_in_order", _decision_sql(True))
def check_decisions_in_order(spark, sf):
    known = _approvals(spark, sf)
    return approvals.check_decisions(_decisions(spark, sf), known, _stamp(SNAPSHOT), steps=known)


@query("join05_sequential_violations", f"WITH {APPROVALS}, {DECISIONS} SELECT approval_id FROM waiting")
def sequential_violations(spark, sf):
    return approvals.sequential_violations(_approvals(spark, sf)).select("approval_id")


@query(
    "join03_list_approvals",
    f"""WITH {APPROVALS}, j AS (SELECT approvals.*, s_name AS partner FROM approvals JOIN supplier ON s_suppkey = application_id
      WHERE status = 'pending' AND approver_role = 'LEGAL_APPROVER')
    SELECT approval_id, application_id, partner, requested_at, (SELECT count(*) FROM j) AS total FROM j
    ORDER BY requested_at DESC, approval_id DESC LIMIT 20""",
)
def list_approvals(spark, sf):
    applications = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("application_id"), F.col("s_name").alias("partner"))
    rows = approvals.list_approvals(_approvals(spark, sf), applications, status="pending", role="LEGAL_APPROVER")
    return rows.select("approval_id", "application_id", "partner", "requested_at", "total")


_RESOURCES = ("cases", "users", "reports")


def _audit(spark, sf):
    return table(spark, sf, "events").select(
        "event_id",
        F.col("ts").alias("timestamp"),
        F.col("user_id").cast("string").alias("user_id"),
        F.col("event_type").alias("action"),
        pick(_RESOURCES, F.col("event_id")).alias("resource"),
        F.when(F.col("event_type") == "error", F.lit("failure")).otherwise(F.lit("success")).alias("result"),
    )


AUDIT = f"""audit AS (SELECT event_id, ts AS timestamp, CAST(user_id AS VARCHAR) AS user_id, event_type AS action, {pick_sql(_RESOURCES, "event_id")} AS resource,
  CASE WHEN event_type = 'error' THEN 'failure' ELSE 'success' END AS result FROM events)"""


@query(
    "ops23_query_audit",
    f"""WITH {AUDIT}, m AS (SELECT * FROM audit WHERE timestamp >= TIMESTAMP '2024-01-05' AND timestamp <= TIMESTAMP '2024-01-20' AND action = 'click' AND resource = 'cases')
    SELECT *, (SELECT count(*) FROM m) AS total FROM m ORDER BY timestamp DESC, event_id DESC LIMIT 50""",
)
def query_audit(spark, sf):
    return audit.query_audit(
        _audit(spark, sf), date_start="2024-01-05 00:00:00", date_end="2024-01-20 00:00:00", action="click", resource="cases"
    )


@query(
    "win05_audit_page",
    f"""WITH {AUDIT} SELECT *, (SELECT count(*) FROM audit) AS total FROM audit ORDER BY timestamp DESC, event_id DESC LIMIT 30 OFFSET 60""",
)
def audit_page(spark, sf):
    return requests.page(_audit(spark, sf), [F.desc("timestamp"), F.desc("event_id")], number=3, size=30)


@query(
    "ops24_append_only_violations",
    f"""WITH {AUDIT} SELECT * FROM audit WHERE user_id = '5' OR action = 'error'""",
)
def append_only_violations(spark, sf):
    old = _audit(spark, sf)
    changed = old.where("user_id <> '5'").withColumn("result", F.when(F.col("action") == "error", F.lit("success")).otherwise(F.col("result")))
    return audit.append_only_violations(old, changed)


@query(
    "ops24_snapshot_violations",
    f"""WITH {AUDIT} SELECT * FROM audit WHERE event_id % 1000 = 7 OR (action = 'error' AND event_id < 1000)""",
)
def snapshot_violations(spark, sf):
    old = _audit(spark, sf)
    lost = old.where("event_id % 1000 <> 7")
    broken = (F.col("action") == "error") & (F.col("event_id") < 1000)
    changed = lost.withColumn("result", F.when(broken, F.lit("success")).otherwise(F.col("result")))
    root = f"{durable_dir(spark).rstrip('/')}/snapshots-{uuid.uuid4().hex}"
    for name, rows in (("old", old), ("new", changed)):
        snapshots.write_snapshot(rows, f"{root}/{name}", range_bits=10)
    return snapshots.snapshot_violations(spark, f"{root}/old", f"{root}/new")


assert set(NEVER_CHANGE) <= set(ROLES)
