"""Users, roles, permissions and e-mail authorisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from casemill.functions.joins import small
from casemill.functions.text import email_domain, strip

# Permissions, and the permissions of each role.
PERMISSIONS = (
    "READ_DASHBOARD", "READ_CHARTS", "READ_KPIS", "READ_FILTERS", "READ_RCA", "READ_QUALITY", "READ_RISK",
    "READ_STATISTICS", "READ_REPORTS", "EXPORT_DATA", "READ_ANNULATIONS", "CREATE_ANNULATION",
    "APPROVE_ANNULATION", "READ_CAPACITY", "MANAGE_CAPACITY", "READ_AUDIT", "READ_EVIDENCE", "APPROVE_LEGAL",
    "APPROVE_VP", "MANAGE_USERS", "MANAGE_ROLES", "MANAGE_CONFIG", "INGEST_DATA", "MANAGE_OWN_PARTNER",
)
ROLE_PERMISSIONS = {
    "SYSTEM_ADMIN": PERMISSIONS,
    "OPERATIONS_LEAD": (
        "READ_DASHBOARD", "READ_CHARTS", "READ_KPIS", "READ_FILTERS", "READ_RCA", "READ_QUALITY", "READ_RISK",
        "READ_STATISTICS", "READ_REPORTS", "EXPORT_DATA", "READ_ANNULATIONS", "READ_CAPACITY",
        "MANAGE_CAPACITY", "READ_EVIDENCE",
    ),
    "ANALYST": (
        "READ_DASHBOARD", "READ_CHARTS", "READ_KPIS", "READ_FILTERS", "READ_RCA", "READ_QUALITY", "READ_RISK",
        "READ_STATISTICS", "READ_REPORTS", "EXPORT_DATA", "READ_ANNULATIONS",
    ),
    "LEGAL_APPROVER": (
        "READ_DASHBOARD", "READ_CHARTS", "READ_KPIS", "READ_FILTERS", "READ_RCA", "READ_QUALITY",
        "READ_ANNULATIONS", "APPROVE_LEGAL", "APPROVE_ANNULATION", "READ_AUDIT",
    ),
    "VP_APPROVER": (
        "READ_DASHBOARD", "READ_CHARTS", "READ_KPIS", "READ_FILTERS", "READ_RCA", "READ_QUALITY",
        "READ_ANNULATIONS", "APPROVE_VP", "APPROVE_ANNULATION", "READ_AUDIT",
    ),
    "BUSINESS_OWNER": (
        "READ_DASHBOARD", "READ_CHARTS", "READ_KPIS", "READ_FILTERS", "READ_RCA", "READ_QUALITY",
        "READ_REPORTS", "EXPORT_DATA", "READ_ANNULATIONS", "CREATE_ANNULATION", "READ_CAPACITY",
    ),
    "AUDITOR": (
        "READ_DASHBOARD", "READ_CHARTS", "READ_KPIS", "READ_FILTERS", "READ_RCA", "READ_QUALITY", "READ_AUDIT",
        "READ_EVIDENCE", "READ_ANNULATIONS",
    ),
    "PARTNER_ADMIN": (
        "READ_DASHBOARD", "READ_CHARTS", "READ_KPIS", "READ_FILTERS", "READ_RCA", "READ_QUALITY",
        "MANAGE_OWN_PARTNER",
    ),
    "PARTNER_OPERATOR": (
        "READ_DASHBOARD", "READ_CHARTS", "READ_KPIS", "READ_FILTERS", "READ_RCA", "READ_QUALITY",
        "READ_ANNULATIONS",
    ),
    "CONTRACTOR_OPERATOR": (
        "READ_DASHBOARD", "READ_CHARTS", "READ_KPIS", "READ_FILTERS", "READ_RCA", "READ_QUALITY",
        "READ_STATISTICS",
    ),
    "INTERN_READONLY": (
        "READ_DASHBOARD", "READ_CHARTS", "READ_KPIS", "READ_FILTERS", "READ_RCA", "READ_QUALITY",
        "INGEST_DATA",
    ),
}
ROLES = tuple(ROLE_PERMISSIONS)
# Head-count limits, and roles whose users must have an expiry.
ROLE_LIMITS = {"INTERN_READONLY": 12, "CONTRACTOR_OPERATOR": 20, "BUSINESS_OWNER": 10}
EXPIRING_ROLES = ("INTERN_READONLY", "CONTRACTOR_OPERATOR")
# E-mail shape, longest address, suffix that is always authorised.
EMAIL_SHAPE = r"^[a-zA-Z0-9.!#$%&'*+/=?^_`{|}~-]+@[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?(?:\.[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?)*$"  # noqa: E501
EMAIL_LIMIT = 254
CORPORATE_SUFFIX = "@corp.example"


def permission_matrix(spark: SparkSession) -> DataFrame:
    """(role, permission), a fixed table of about a hundred rows."""
    rows = [(role, p) for role, listed in ROLE_PERMISSIONS.items() for p in listed]
    return spark.createDataFrame(rows, "role string, permission string")


def role_limits(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(ROLE_LIMITS.items()), "role string, capacity long")


def role_capacity(users: DataFrame, limits: DataFrame) -> DataFrame:
    """Active users per role against its limit; a role without a limit is marked unknown."""
    active = users.groupBy("role").agg(F.count_if(F.col("is_active")).alias("active"))
    return active.join(limits, "role", "full").select(
        "role",
        F.coalesce("active", F.lit(0)).alias("active"),
        "capacity",
        F.greatest(F.col("capacity") - F.coalesce("active", F.lit(0)), F.lit(0)).alias("room"),
        F.coalesce(F.coalesce("active", F.lit(0)) < F.col("capacity"), F.lit(False)).alias("can_add"),
        F.col("capacity").isNotNull().alias("is_known"),
    )


def _expired(as_of: Column) -> Column:
    due = F.col("is_active") & F.col("role").isin(*EXPIRING_ROLES) & (F.col("expires_at") <= as_of)
    return F.coalesce(due, F.lit(False))


def expire_users(users: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(users with expired ones set inactive, one audit row per user switched off)."""
    due = _expired(as_of)
    updated = users.withColumn("is_active", F.col("is_active") & ~due)
    audit = users.where(due).select(
        F.lit("SYSTEM").alias("user_id"),
        F.lit("USER_EXPIRED").alias("action"),
        F.lit("app_users").alias("resource"),
        F.col("user_id").cast("string").alias("resource_id"),
        F.lit("success").alias("result"),
        F.to_json(F.struct("role", "expires_at")).alias("details"),
    )
    return updated, audit


def missing_expiry(users: DataFrame) -> DataFrame:
    """Users of an expiring role without an expiry."""
    return users.where(F.col("role").isin(*EXPIRING_ROLES) & F.col("expires_at").isNull())


def authorize(requests: DataFrame, matrix: DataFrame) -> DataFrame:
    """Add ``allowed``: the role holds the permission. Unknown roles and permissions are denied."""
    granted = matrix.select("role", "permission").distinct().withColumn("_granted", F.lit(True))
    return (
        requests.join(small(granted), ["role", "permission"], "left")
        .withColumn("allowed", F.col("_granted").isNotNull())
        .drop("_granted")
    )


def role_conflicts(assignments: DataFrame) -> DataFrame:
    """Users that hold more than one valid role."""
    return (
        assignments.where(F.col("role").isin(*ROLES))
        .groupBy("user_id")
        .agg(F.array_join(F.sort_array(F.collect_set("role")), ",").alias("roles"), F.count_distinct("role").alias("n"))
        .where(F.col("n") > 1)
    )


def valid_email(address: Column) -> Column:
    bare = strip(address)
    return F.coalesce((F.length(bare) <= EMAIL_LIMIT) & bare.rlike(EMAIL_SHAPE), F.lit(False))


def _whitelist(whitelist: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(address entries, domain entries), each with one row per key: the last to expire wins."""
    lowered = F.lower(strip(F.col("entry")))
    never = F.lit("9999-12-31 00:00:00").cast("timestamp")
    keyed = whitelist.select(
        "kind",
        F.when((F.col("kind") == "domain") & ~lowered.startswith("@"), F.concat(F.lit("@"), lowered))
        .otherwise(lowered)
        .alias("key"),
        F.coalesce(F.col("expires_at").cast("timestamp"), never).alias("until"),
    )

    def entries(kind: str, name: str) -> DataFrame:
        return (
            keyed.where(F.col("kind") == kind).groupBy(F.col("key").alias(f"{name}_key")).agg(F.max("until").alias(f"{name}_until"))
        )

    return entries("email", "address"), entries("domain", "domain")


def authorize_emails(
    emails: DataFrame, whitelist: DataFrame, as_of: Column, corporate: str = CORPORATE_SUFFIX
) -> DataFrame:
    """Add ``authorized`` and ``denial_reason`` to rows with an ``email``.

    ``whitelist`` holds (kind in email or domain, entry, expires_at). An exact entry decides even when
    it has expired; only without one does the domain entry count.
    """
    addresses, domains = _whitelist(whitelist)
    prepared = emails.withColumn("_email", F.lower(strip(F.col("email")))).withColumn(
        "_domain", email_domain(F.col("_email"))
    )
    joined = prepared.join(addresses, F.col("_email") == F.col("address_key"), "left").join(
        small(domains), F.col("_domain") == F.col("domain_key"), "left"
    )
    valid = valid_email(F.col("email"))
    corporate_address = F.coalesce(F.col("_email").endswith(corporate), F.lit(False))
    address_live = F.col("address_until") > as_of
    domain_live = F.col("domain_until") > as_of
    listed = F.when(F.col("address_key").isNotNull(), address_live).otherwise(F.coalesce(domain_live, F.lit(False)))
    authorized = valid & (corporate_address | listed)
    reason = (
        F.when(authorized, F.lit(None).cast("string"))
        .when(~valid, F.lit("INVALID_EMAIL_FORMAT"))
        .when(corporate_address, F.lit("UNKNOWN"))
        .when(F.col("address_key").isNotNull() & ~address_live, F.lit("WHITELIST_ENTRY_EXPIRED"))
        .when(F.col("domain_key").isNotNull() & ~domain_live, F.lit("WHITELIST_DOMAIN_EXPIRED"))
        .otherwise(F.lit("EMAIL_NOT_IN_AUTHORIZED_LIST"))
    )
    return joined.select(*emails.columns, authorized.alias("authorized"), reason.alias("denial_reason"))


def _single_active(emails: DataFrame) -> DataFrame:
    """One active address per partner, the first by name."""
    return (
        emails.where(F.col("is_active"))
        .groupBy("partner_id")
        .agg(F.min(F.lower(strip(F.col("email")))).alias("active_email"))
    )


def partner_context(partners: DataFrame, emails: DataFrame) -> DataFrame:
    """First active partner (by id) with its active address."""
    return (
        partners.where(F.col("status") == "active")
        .join(_single_active(emails), "partner_id")
        .select("partner_id", "name", "active_email")
        .orderBy("partner_id")
        .limit(1)
    )


def check_partner_sender(requests: DataFrame, partners: DataFrame, emails: DataFrame) -> DataFrame:
    """Add ``authorized`` and ``reason`` to requests of (partner_id, sender_email)."""
    known = partners.select("partner_id", F.col("status").alias("_status"))
    joined = requests.join(known, "partner_id", "left").join(_single_active(emails), "partner_id", "left")
    sender = F.lower(strip(F.col("sender_email")))
    missing = F.col("partner_id").isNull() | F.coalesce(F.length("sender_email") == 0, F.lit(True))
    reason = (
        F.when(missing, F.lit("partner_id and sender_email are required"))
        .when(F.col("_status").isNull(), F.lit("partner_not_found"))
        .when(F.col("_status") != "active", F.lit("partner_inactive"))
        .when(F.col("active_email").isNull(), F.lit("no_active_email_configured"))
        .when(sender != F.col("active_email"), F.lit("email_mismatch"))
    )
    return joined.select(*requests.columns, reason.isNull().alias("authorized"), reason.alias("reason"))


def active_email_conflicts(emails: DataFrame) -> DataFrame:
    """Partners with more than one active address."""
    return (
        emails.where(F.col("is_active"))
        .groupBy("partner_id")
        .agg(F.count(F.lit(1)).alias("active_emails"))
        .where(F.col("active_emails") > 1)
    )
