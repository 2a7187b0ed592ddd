"""Stable identifiers as native expressions."""

from __future__ import annotations

from uuid import NAMESPACE_DNS, UUID

from pyspark.sql import Column
from pyspark.sql import functions as F


def _dashed(hex32: Column) -> Column:
    parts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat_ws("-", *[F.substring(hex32, a, n) for a, n in parts])


def uuid5(name: Column, namespace: UUID = NAMESPACE_DNS) -> Column:
    """RFC 4122 version 5: SHA-1 of namespace and name with the version and variant bits set."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), F.pmod(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int"), F.lit(4)) + 1, F.lit(1))
    return _dashed(F.concat(F.substring(digest, 1, 12), F.lit("5"), F.substring(digest, 14, 3), variant, F.substring(digest, 18, 15)))


def sha1_id(*parts: Column) -> Column:
    """The first 32 hex digits of the SHA-1 of the parts joined by '|', dashed."""
    return _dashed(F.sha1(F.concat_ws("|", *parts).cast("binary")))


def row_digest(*columns: Column) -> Column:
    """SHA-256 of a row's canonical text; null is told apart from empty."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("\x00")) for c in columns]), 256)
