"""Format detection: one ordered CASE, a pure function of the text; the first rule that holds wins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What the rules of detection test, which decides results.
RFC5424, RFC3164 = r"^<\d{1,3}>[1-9]\d* \S", r"^(?:<\d{1,3}>)?[A-Z][a-z]{2} {1,2}\d{1,2} \d{2}:\d{2}:\d{2} \S"
CEF, LEEF = r"(?:^|\s)CEF:\d+\|", r"(?:^|\s)LEEF:\d+\.\d+\|"
KEY = r"(?:^|\s)[A-Za-z][A-Za-z0-9_.-]*="
XML = r"^\s*<\?xml|^\s*<[A-Za-z_][\w.-]*[\s>]"
SYSLOG = ("rfc5424", "rfc3164")


def _all_filled(text: Column, sep: str) -> Column:
    """No part between separators is blank."""
    return ~text.rlike(rf"(?:^|{sep})\s*(?:{sep}|\z)")


def detect(text: Column) -> Column:
    """unknown, rfc5424, cef, leef, json, rfc3164, key_value, xml, csv or plain_text. Cheap literal tests guard the searches."""
    return (
        F.when(text.isNull() | (text == ""), "unknown")
        .when(text.startswith("<") & text.rlike(RFC5424), "rfc5424")
        .when(F.contains(text, F.lit("CEF:")) & text.rlike(CEF), "cef")
        .when(F.contains(text, F.lit("LEEF:")) & text.rlike(LEEF), "leef")
        .when(F.contains(text, F.lit("{")) & text.rlike(r"(?U)^\s*\{"), "json")
        .when(text.rlike(RFC3164), "rfc3164")
        .when(F.contains(text, F.lit("=")) & (F.regexp_count(text, F.lit(KEY)) >= 2), "key_value")
        .when(F.contains(text, F.lit("<")) & text.rlike(XML), "xml")
        .when(
            F.contains(text, F.lit("\t"))
            | (F.contains(text, F.lit(";")) & _all_filled(text, ";"))
            | (F.contains(text, F.lit(",")) & ~F.contains(text, F.lit(" ")) & _all_filled(text, ",")),
            "csv",
        )
        .otherwise("plain_text")
    )


def with_envelope(text: Column, fmt: Column) -> Column:
    """The format that leads: a CEF or LEEF message behind a syslog prefix is first of all syslog."""
    inner = fmt.isin("cef", "leef")
    return F.when(inner & text.rlike(RFC3164), "rfc3164").when(inner & text.rlike(RFC5424), "rfc5424").otherwise(fmt)


def behind_syslog(text: Column, fmt: Column) -> Column:
    """The text behind an approximate syslog header, '' if there is none."""
    after_data = F.when(F.contains(text, F.lit("] ")), F.substring(text, F.instr(text, "] ") + 2, F.length(text)))
    after_host = F.regexp_extract(text, r"(?s)^(?:<\d{1,3}>)?[A-Z][a-z]{2} {1,2}\d{1,2} \d{2}:\d{2}:\d{2} \S+ [^ ]* ?(.*)$", 1)
    return F.coalesce(F.when(fmt == "rfc5424", after_data).when(fmt == "rfc3164", after_host), F.lit(""))


def inner_format(text: Column, fmt: Column, sub: Column) -> Column:
    """The format by which an inner message is resolved: never syslog if anything else is in it. sub: detect(behind_syslog)."""
    return F.when(fmt.isin(*SYSLOG) & sub.isin("cef", "leef", "json", "key_value"), sub).otherwise(fmt)
