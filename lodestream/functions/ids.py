"""Stable identifiers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the DNS namespace of name-based UUIDs.
_DNS = "6ba7b8109dad11d180b400c04fd430c8"


def uuid5_dns(name: Column) -> Column:
    """The version-5 UUID of a name in the DNS namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit(_DNS)), F.encode(name, "UTF-8")))
    part = lambda a, n: F.substring(h, a, n)
    variant = F.translate(part(17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))


def point_id(text: Column, tenant: Column) -> Column:
    """The id of a chunk: text and tenant, so the same chunk of a tenant always gets the same id."""
    return uuid5_dns(F.concat(F.coalesce(text, F.lit("")), F.coalesce(tenant, F.lit(""))))


def cache_key(model: str, version: str, text: Column) -> Column:
    return F.sha1(F.concat_ws("|", F.lit(model), F.lit(version), F.coalesce(text, F.lit(""))))
