"""Keys by digest."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def event_identity(source: Column, patient: Column, happened_at: Column, author: Column) -> Column:
    return F.sha2(F.concat_ws("|", source, patient.cast("string"), happened_at, author), 256)


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def recovery_key(text: Column) -> Column:
    return F.substring(F.sha1(text), 1, 12)


def synthetic_key(kind: Column, text: Column) -> Column:
    """The key of what no group has: ``kind`` is code or blank, so that a code and a name that read alike differ."""
    digest = F.sha2(F.concat(kind, F.lit("\0"), text), 256)
    return F.concat(F.lit("UNMAPPED-"), F.upper(kind), F.lit("-"), F.substring(digest, 1, 20))
