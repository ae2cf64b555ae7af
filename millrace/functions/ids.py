"""Identifiers and ingestion instants as they are meant."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def event_key(c: Column) -> Column:
    """The 16 bytes of an event identifier, whatever its spelling; null where it has none.

    Upper case, hyphens, braces, white space and the urn:uuid: prefix do not count. Half the
    size of the hex text, which matters wherever it is a shuffle key.
    """
    s = F.regexp_replace(F.lower(c), r"^[\s{(]*(?:urn:)?(?:uuid:)?|[\s{}()-]", "")
    return F.when(s.rlike("^[0-9a-f]{32}$"), F.unhex(s))


def event_hex(key: Column) -> Column:
    return F.lower(F.hex(key))


def ingest_us(seconds: Column) -> Column:
    """Microseconds since 1970 of an ingestion time that may be given in s, ms, us or ns (seconds are meant)."""
    x = F.when(F.isnan(seconds) | (seconds <= 0) | (seconds > 1e19), None).otherwise(seconds)
    scaled = (
        F.when(x < 1e11, x * 1e6)
        .when(x < 1e14, x * 1e3)
        .when(x < 1e17, x)
        .otherwise(x / 1e3)
    )
    return F.round(scaled).cast("long")
