"""Identity-header decoding and download gating as column expressions.

The header is base64 of a JSON object ``{auth_typ, claims:[{typ,val}],
name_typ, role_typ}``.  Missing, empty or malformed headers give an empty
group set.  Entirely JVM-side: no Python per request.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PRINCIPAL_SCHEMA = ("struct<auth_typ:string, claims:array<struct<typ:string, val:string>>, "
                    "name_typ:string, role_typ:string>")
# Fixed value: the bot endpoint has its own auth and skips the identity check.
AUTH_EXEMPT_PATHS = ["/api/messages"]
FILES_PREFIX = "/api/files/"


def group_ids(header: Column | str) -> Column:
    """G1: distinct ``val`` of claims with ``typ == 'groups'`` (array<string>)."""
    h = F.col(header) if isinstance(header, str) else header
    raw = F.try_to_binary(F.coalesce(h, F.lit("")), F.lit("base64"))
    doc = F.from_json(raw.cast("string"), PRINCIPAL_SCHEMA)
    groups = F.transform(F.filter(doc["claims"], lambda c: (c["typ"] == "groups") & c["val"].isNotNull()),
                         lambda c: c["val"])
    return F.coalesce(F.array_distinct(groups), F.array().cast("array<string>"))


def can_download(groups: Column, require_auth: bool, group_id: str | None) -> Column:
    """Allowed when auth is off, no group is configured, or the user is in it."""
    if not require_auth or not group_id:
        return F.lit(True)
    return F.array_contains(groups, F.lit(group_id))


def unsafe_name(filename: Column) -> Column:
    """Path rule: after ``\\`` -> ``/``, absolute names and ``..`` segments are refused."""
    n = F.regexp_replace(F.coalesce(filename, F.lit("")), r"\\", "/")
    return n.startswith("/") | n.rlike(r"(^|/)\.\.(/|$)") | (n == "")
