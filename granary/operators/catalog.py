"""Lists, look-ups and filters over the service's tables.

Filters are and-ed equalities, where None or blank means no filter, and inclusive time bounds; all are plain Column
predicates, so they reach the scan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Order of each list; the last key makes it total.
ORDERS: dict[str, list[tuple[str, bool]]] = {
    "targets": [("name", True), ("id", True)], "storages": [("name", True), ("id", True)], "schedules": [("name", True), ("id", True)],
    "policies": [("name", True), ("id", True)], "notification_rules": [("name", True), ("id", True)], "users": [("email", True), ("id", True)],
    "tokens": [("created_at", False), ("id", True)], "jobs": [("queued_at", True), ("id", True)], "backups": [("ended_at", False), ("id", True)],
    "audit_events": [("seq", True)], "agents": [("agent_id", True)], "objects": [("object_key", True)],
}


def listed(df: DataFrame, kind: str) -> DataFrame:
    return df.orderBy(*[F.col(c).asc() if up else F.col(c).desc() for c, up in ORDERS[kind]])


def key_range(df: DataFrame, key: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows with start <= key < end, in key order; an open end is None, and start >= end is empty."""
    if start is not None:
        df = df.where(F.col(key) >= start)
    if end is not None:
        df = df.where(F.col(key) < end)
    return df.orderBy(key)


def key_prefix(df: DataFrame, key: str, prefix: str) -> DataFrame:
    return df.where(F.col(key).startswith(prefix)).orderBy(key)


def point(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.where(F.col(key) == value).limit(1)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def equals(**wanted) -> list[Column]:
    return [F.col(c) == x for c, x in wanted.items() if x is not None and x != ""]


def between(at: Column, since=None, until=None) -> list[Column]:
    if since is not None and until is not None and since > until:
        raise ValueError("since must not be after until")
    return [at >= F.lit(since).cast("timestamp_ntz")] * (since is not None) + [at <= F.lit(until).cast("timestamp_ntz")] * (until is not None)


def effective_time() -> Column:
    return F.coalesce("ended_at", "started_at")


def filter_backups(df: DataFrame, *, since=None, until=None, protected: bool | None = None, **wanted) -> DataFrame:
    """wanted: target_id, storage_id, type."""
    extra = [] if protected is None else [F.col("protected") == protected]
    return df.where(all_of(equals(**wanted) + extra + between(effective_time(), since, until)))


def filter_jobs(df: DataFrame, *, since=None, until=None, **wanted) -> DataFrame:
    return df.where(all_of(equals(**wanted) + between(F.col("queued_at"), since, until)))


def filter_audit(df: DataFrame, *, since=None, until=None, limit: int = 0, **wanted) -> DataFrame:
    """The first `limit` events (0: all) in order of seq."""
    out = df.where(all_of(equals(**wanted) + between(F.col("occurred_at"), since, until))).orderBy("seq")
    return out.limit(limit) if limit else out


def tail(df: DataFrame, n: int) -> DataFrame:
    """The last n events, in order: a top-k, then a sort of n rows."""
    return df.orderBy(F.desc("seq")).limit(n).orderBy("seq")


def search_audit(df: DataFrame, needle: str) -> DataFrame:
    """Events whose fields, metadata keys or values contain the text, whatever its case."""
    text = needle.strip().lower()
    hay = [F.lower(F.coalesce(F.col(c), F.lit(""))).contains(text) for c in ("actor_id", "action", "resource_type", "resource_id")]
    entries = F.map_entries(F.from_json("metadata_json", "map<string,string>"))
    inside = F.coalesce(F.exists(entries, lambda e: F.lower(e["key"]).contains(text) | F.lower(e["value"]).contains(text)), F.lit(False))
    return df.where(reduce(lambda a, b: a | b, hay) | inside)


def inactive_tokens(df: DataFrame, now: str) -> DataFrame:
    return df.where(F.col("revoked_at").isNotNull() | (F.col("expires_at") <= F.lit(now).cast("timestamp_ntz")))


def normalised_scopes(scopes: Column) -> Column:
    """Array of trimmed, distinct, sorted scopes without blanks."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(scopes, lambda s: F.trim(s)), lambda s: s != "")))


def allows(scopes: Column, required: Column | str) -> Column:
    """A scope fits by itself, as `*`, as `admin:*`, or as `prefix:*`; nothing required is always allowed."""
    need = F.lit(required) if isinstance(required, str) else required
    fits = F.exists(normalised_scopes(scopes), lambda s: (s == "*") | (s == "admin:*") | (s == need) | (s.endswith(":*") & need.startswith(F.substring(s, 1, F.length(s) - 1))))
    return (need == "") | fits


# The scopes of each role.
ROLE_SCOPES = {
    "admin": ["admin:*"],
    "operator": ["agent:read", "audit:read", "backup:*", "job:*", "metrics:read", "notification:*", "restore:*", "retention:*", "schedule:read", "storage:read", "target:read"],
    "viewer": ["agent:read", "audit:read", "backup:read", "job:read", "metrics:read", "notification:read", "restore:read", "retention:read", "schedule:read", "storage:read", "target:read"],
}


def role_scopes(role: Column) -> Column:
    out = F.when(F.lit(False), F.array().cast("array<string>"))
    for name, scopes in ROLE_SCOPES.items():
        out = out.when(role == name, F.array(*map(F.lit, scopes)))
    return out.otherwise(F.array().cast("array<string>"))


def role_allows(role: Column, required: str) -> Column:
    return role.isin(*ROLE_SCOPES) & allows(role_scopes(role), required)


EVENT_OF_STATUS = {"succeeded": "job.succeeded", "failed": "job.failed", "canceled": "job.canceled"}


def event_of(status: Column) -> Column:
    out = None
    for s, e in EVENT_OF_STATUS.items():
        out = F.when(status == s, e) if out is None else out.when(status == s, e)
    return out


# Parts of option names that mark secrets, and what stands for a masked value.
SECRET_WORDS = ("password", "secret", "token", "passphrase", "credential", "private_key", "access_key", "session_key", "encryption_key", "api_key", "apikey")
MASK = "***REDACTED***"


def redacted(options: Column) -> Column:
    """A map of options with secret values masked."""
    return F.transform_values(options, lambda k, v: F.when(F.translate(F.lower(k), "-.", "__").rlike("|".join(SECRET_WORDS)), F.lit(MASK)).otherwise(v))


def valid_id(c: Column) -> Column:
    return c.rlike(r"^[A-Za-z0-9_.:/-]{1,128}\z")


def safe_object_key(c: Column) -> Column:
    """Not blank, no absolute path, no backslash and no step upwards."""
    return ~(c.isNull() | (F.trim(c) == "") | c.startswith("/") | c.contains("\\") | c.rlike(r"(^|/)\.\.(/|$)"))


def violations(**rules: Column) -> Column:
    """Names of the rules that fail, sorted, joined by commas."""
    found = F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in sorted(rules.items())])
    return F.array_join(F.filter(found, lambda x: x.isNotNull()), ",")


def valid_storage_uri(kind: Column, uri: Column) -> Column:
    """Scheme fits the kind; remote kinds name a host or bucket, local ones a path."""
    host = F.coalesce(F.regexp_extract(uri, r"^[a-z0-9]+://([^/?#]*)", 1), F.lit(""))
    scheme = F.coalesce(F.regexp_extract(uri, r"^([a-z0-9]+)://", 1), F.lit(""))
    path = F.coalesce(F.regexp_extract(uri, r"^[a-z0-9]+://[^/?#]*(/[^?#]*)", 1), F.lit(""))
    local = (scheme == "file") & (host == "") & (path != "")
    return F.when(kind == "local", local).otherwise((scheme == kind) & (host != ""))
