"""Surrogate keys, durations and batch ids as column expressions."""

from __future__ import annotations

import secrets
import string
from datetime import UTC, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Timestamps enter hashes in this form, whatever the session's zone or format.
STAMP = "yyyy-MM-dd HH:mm:ss"
#: Fixed value: the time in a batch id.
BATCH_TIME = "%Y%m%dT%H%M%SZ"


def hashed_key(*parts: Column | str) -> Column:
    """SHA-256 of the parts, joined by '|'."""
    return F.sha2(F.concat_ws("|", *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts]), 256)


def version_key(natural_key: str, ts: str) -> Column:
    """Surrogate of a version: natural key and the second it starts in."""
    return hashed_key(F.col(natural_key), F.date_format(ts, STAMP))


def days_between(start: Column | str, end: Column | str) -> Column:
    """Days from start to end with fractions, from whole seconds; null if either is."""
    seconds = lambda c: F.unix_seconds((F.col(c) if isinstance(c, str) else c).cast("timestamp"))
    return (seconds(end) - seconds(start)) / F.lit(86400.0)


def make_batch_id(now: datetime | None = None) -> str:
    """YYYYMMDDTHHMMSSZ and eight hex digits; a time without zone is taken for UTC."""
    now = datetime.now(UTC) if now is None else now
    second = now.replace(tzinfo=now.tzinfo or UTC).astimezone(UTC).strftime(BATCH_TIME)
    return "-".join((second, secrets.token_hex(4)))


def parse_batch_id(batch_id: str) -> tuple[datetime, str]:
    second, _, tail = batch_id.partition("-")
    if len(second) != 16 or len(tail) != 8 or set(tail) - set(string.hexdigits.lower()):
        raise ValueError(f"not a batch id: {batch_id!r}")
    return datetime.strptime(second, BATCH_TIME).replace(tzinfo=UTC), tail


def batch_time(batch_id: Column | str) -> Column:
    """The time in a batch id column; null where it is malformed."""
    return F.try_to_timestamp(F.regexp_extract(batch_id, r"^(\d{8}T\d{6})Z-[0-9a-f]{8}$", 1), F.lit("yyyyMMdd'T'HHmmss"))
