"""Who may write where, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def key_hash(key: Column) -> Column:
    return F.sha2(key, 256)


def may_write(role: Column, own_source: Column, domains: Column, source: Column, domain: Column) -> Column:
    """Admins may, readers may not; writers may for their own source and the domains listed for them (none, if the list is empty)."""
    writer = (own_source == source) & F.array_contains(domains, domain)
    return F.coalesce(F.when(role == "admin", True).when(role == "source_writer", writer), F.lit(False))


def device_key_error(device_found: Column, key_found: Column, active: Column, revoked_at: Column, expires_at: Column, now: Column) -> Column:
    """Null for a good key, else the first of the errors."""
    return (
        F.when(~device_found, "DEVICE_NOT_FOUND")
        .when(~key_found, "INVALID_API_KEY")
        .when(~F.coalesce(active, F.lit(False)), "KEY_INACTIVE")
        .when(revoked_at.isNotNull(), "KEY_REVOKED")
        .when(expires_at < now, "KEY_EXPIRED")
    )


def call_error(given: Column, role: Column, active: Column, own_source: Column, domains: Column, source: Column, domain: Column) -> Column:
    """Null for a call that may write, else why not. role and what follows are those of the key with the given key's hash."""
    return (
        F.when(given.isNull(), "missing_key")
        .when(role.isNull(), "invalid_key")
        .when(~F.coalesce(active, F.lit(False)), "inactive_key")
        .when(~may_write(role, own_source, domains, source, domain), "forbidden")
    )


def global_key_error(given: Column, expected: str | None, production: bool) -> Column:
    """Null for a call with the one key of all callers, else why not. Without such a key all may call, but not in production: there it is a fault of the set-up."""
    if not expected:
        return F.lit("key_not_configured" if production else None).cast("string")
    return F.when(F.coalesce(given, F.lit("")) == "", "missing_key").when(given != F.lit(expected), "invalid_key")
