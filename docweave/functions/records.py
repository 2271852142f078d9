"""Identities, hashes, citations and times of records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .urls import canonicalize_url


def logical_key(canonical: Column, version: Column) -> Column:
    return F.concat(canonicalize_url(canonical), F.lit("\x00"), F.coalesce(version, F.lit("")))


def content_identity(canonical: Column, version: Column, content_hash: Column) -> Column:
    """One identity for one version of one source with one content."""
    return F.sha2(F.concat(logical_key(canonical, version), F.lit("\x00"), F.lower(content_hash)), 256)


#: Fields that change with every run and are left out of hashes.
VOLATILE = frozenset("attempt_id completed_at created_at duration_ms finished_at recorded_at started_at timestamp updated_at".split())


def canonical_json(fields: dict[str, Column]) -> Column:
    """Compact JSON with sorted keys, nulls written out. Exact for strings, integers, booleans, arrays and structs of these (with their own fields sorted)."""
    kept = [fields[k].alias(k) for k in sorted(fields) if k not in VOLATILE]
    return F.to_json(F.struct(*kept), {"ignoreNullFields": "false"})


def canonical_hash(fields: dict[str, Column]) -> Column:
    return F.sha2(canonical_json(fields), 256)


def citation(source: Column, kind: Column, label: Column) -> Column:
    """source#kind=label with # and line ends of the label made safe; null if kind or label is blank."""
    k, t = F.trim(kind), F.replace(F.replace(F.trim(label), F.lit("#"), F.lit("%23")), F.lit("\n"), F.lit(" "))
    return F.when((k != "") & (t != ""), F.concat(source, F.lit("#"), k, F.lit("="), t))


def timestamp_ms(text: Column) -> Column:
    """Milliseconds of mm:ss or hh:mm:ss, with a comma or dot before up to three (or more, cut off) decimals; null for other text."""
    t = F.trim(text)
    form = r"^(?:([0-9]{1,2}):)?([0-9]{1,2}):([0-9]{2})(?:[.,]([0-9]{1,3}))?$"
    part = lambda i: F.coalesce(F.nullif(F.regexp_extract(t, form, i), F.lit("")), F.lit("0")).cast("long")
    milli = F.rpad(F.coalesce(F.nullif(F.regexp_extract(t, form, 4), F.lit("")), F.lit("0")), 3, "0").cast("long")
    return F.when(t.rlike(form), ((part(1) * 60 + part(2)) * 60 + part(3)) * 1000 + milli)


def validity_active(start: Column, end: Column, as_of: Column) -> Column:
    """Whether [start, end) holds ``as_of``; a null end is open."""
    return (start.isNull() | (start <= as_of)) & (end.isNull() | (as_of < end))


def to_utc(text: Column) -> Column:
    """A timestamp from RFC 3339 text; null if it has no time zone or is malformed."""
    return F.when(text.rlike(r"(?i)(Z|[+-][0-9]{2}:[0-9]{2})$"), F.try_to_timestamp(text))


def window_start(now: Column, days: int) -> Column:
    return now - F.make_dt_interval(days=F.lit(days))
