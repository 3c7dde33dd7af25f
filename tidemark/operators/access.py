"""Access: permissions by exact grant, scopes, identities, and rows that a principal may read."""

from __future__ import annotations

from datetime import datetime
from hashlib import sha256

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What may be granted.
PERMISSIONS = ("INGEST", "READ_METADATA", "READ_CONTENT", "READ_TEXT", "SEARCH", "DELETE", "LIST")


class Forbidden(PermissionError):
    """The principal has no such permission in the tenant."""


def permitted(rows: DataFrame, grants: DataFrame, permission: str) -> DataFrame:
    """Rows whose (principal_id, tenant_id) was granted the permission."""
    return rows.join(grants.where(F.col("permission") == permission).select("principal_id", "tenant_id"), ["principal_id", "tenant_id"], "left_semi")


class Grants:
    """Grants known to the driver; without any, everything is denied."""

    def __init__(self, given: dict[tuple[str, str], set[str]] | None = None) -> None:
        self.given = given or {}

    def require(self, principal: str | None, tenant: str | None, permission: str) -> None:
        if not (principal or "").strip() or not (tenant or "").strip():
            raise ValueError("principal and tenant must not be blank")
        if permission not in self.given.get((principal, tenant), ()):
            raise Forbidden(f"{permission} is not granted")


def require_scope(scopes: set[str], scope: str) -> None:
    if not scopes & {scope, "artifact.*"}:
        raise Forbidden(f"{scope} is not in scope")


def expired(expires_at: datetime | None, now: datetime) -> bool:
    """An identity without an end never expires; one that ends now has."""
    return expires_at is not None and expires_at <= now


class Sessions:
    """Identities by the handle that a caller presents; only hashes of handles are kept."""

    def __init__(self, given: dict[str, tuple[str, str, set[str], datetime | None]] | None = None) -> None:
        """given: for each handle the principal, tenant, scopes and end (null: none) of its identity."""
        self.given = {sha256(handle.encode()).hexdigest(): identity for handle, identity in (given or {}).items()}

    def identity(self, handle: str | None, now: datetime) -> tuple[str, str, set[str]]:
        """Principal, tenant and scopes behind a handle; blank, unknown and expired ones are refused alike."""
        found = self.given.get(sha256((handle or "").encode()).hexdigest()) if (handle or "").strip() else None
        if found is None or expired(found[3], now):
            raise Forbidden("authentication failed")
        return found[:3]


def require_tenant(rows: DataFrame, tenant: str) -> DataFrame:
    """The same rows; the job fails if any is of another tenant."""
    own = F.col("tenant_id").eqNullSafe(F.lit(tenant))
    return rows.where(F.when(own, F.lit(True)).otherwise(F.raise_error(F.lit("a row of another tenant")).cast("boolean")))
