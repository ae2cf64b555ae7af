"""From raw messages to events: one lazy, row-local plan; as many rows out as in."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.config import Config
from millrace.functions import text as X
from millrace.operators import checks, detect, identity, parsers
from millrace.session import ship

#: Columns an input may have; those it lacks are added as nulls. raw_message is required.
META = {
    "event_id": "string", "ingested_at_unix_utc": "double", "transport": "string", "transport_protocol": "string", "peer_ip": "string", "peer_port": "int",
    "local_port": "int", "source_name": "string", "file_path": "string", "file_line_number": "bigint", "raw_bytes_b64": "string", "decode_note": "string",
}
LAYERS = ("normalized", "vendor_fields", "unknown_fields")


#: Columns that the parse of the message itself decides, or of what is in its envelope too; all others stand without a parse.
UNPARSED = frozenset(META) | {"raw_message", "raw_size_bytes", "decode_notes", "delivery_status", "delivery_target", "delivery_error", "delivery_attempts"}
IDENTITY = frozenset({"source_status", "vendor", "product", "source_evidence"})
EVENT = UNPARSED - {"decode_note"} | IDENTITY | {
    "format_detected", "parser_name", "parser_version", "parse_status", "parse_notes", "hostname", "truncated", "validation_status", "validation_problems",
    "normalized", "vendor_fields", "unknown_fields", "original_fields", "decoded", "protocol_metadata",
}


def placed_id() -> Column:
    """The identifier of a line of a file: equal whenever the file is read again. Null for what has no such place."""
    place = F.concat_ws("\u0001", "file_path", F.col("file_line_number").cast("string"), F.coalesce("raw_message", F.lit("")))
    return F.when(F.col("file_path").isNotNull() & F.col("file_line_number").isNotNull(), F.left(F.sha2(place, 256), F.lit(32)))


def with_meta(raw: DataFrame, at: float | None = None) -> DataFrame:
    """Adds what the input lacks.

    A line of a file is identified by its place, so that a replay repeats it; listeners give their
    messages identifiers of their own; any other row gets one that no other row has, however equal.
    """
    have = set(raw.columns)
    raw = raw.withColumns({c: F.lit(None).cast(t) for c, t in META.items() if c not in have})
    now = F.lit(at).cast("double") if at is not None else F.unix_micros(F.current_timestamp()) / 1e6
    own = F.coalesce("event_id", placed_id(), F.replace(F.expr("uuid()"), F.lit("-"), F.lit("")))
    return raw.withColumns({"ingested_at_unix_utc": F.coalesce("ingested_at_unix_utc", now), "event_id": own})


def parse_events(raw: DataFrame, cfg: Config = Config(), registry: list[parsers.Parser] | None = None, at: float | None = None, columns: Collection[str] | None = None) -> DataFrame:
    """raw_message (and any of META, and columns of the caller's own) to events.

    Null messages count as empty ones. Columns of the input that clash with an event's own are
    replaced. No value is ever dropped or cut: limits and type checks only annotate. With columns,
    only those of the event's are built (the caller's own stay): stages that none of them needs,
    a parse, that of the envelope's content, a check, are not in the plan at all.
    """
    ship(raw.sparkSession)
    asked = EVENT if columns is None else EVENT & set(columns)
    inside = bool(asked - UNPARSED - IDENTITY - {"format_detected"}) or bool(cfg.sources and asked & IDENTITY)
    outside = inside or bool(asked & IDENTITY)
    registry = registry or parsers.REGISTRY
    df = with_meta(raw, at).withColumn("_text", F.coalesce("raw_message", F.lit("")))
    text = F.col("_text")

    # which parser
    df = df.withColumn("_def", identity.configured(cfg.sources)).withColumn("_fmt", detect.detect(text))
    df = df.withColumn("_fmt", detect.with_envelope(text, F.col("_fmt")))
    hint = X.blank_to_null(F.col("_def")["parser_hint"])
    df = df.withColumn("_ok", parsers.accepts(text, hint, cfg, registry) if cfg.sources else F.lit(None).cast("boolean"))
    walked = parsers.resolve(text, F.col("_fmt"), cfg, registry)
    df = df.withColumn("_p1", F.when(F.col("_ok"), hint).otherwise(walked))
    df = df.withColumn("_lost", F.col("_p1").isNull()).withColumn("_p1", F.coalesce("_p1", F.lit("plain_text")))
    nothing = F.lit(None).cast(parsers.RESULT)
    df = parsers.parse(df, "_text", "_p1", "_r1", cfg, registry) if outside else df.withColumn("_r1", nothing)

    # what is inside a syslog envelope
    if inside:
        inner = F.when(F.col("_p1").isin(*detect.SYSLOG), X.blank_to_null(F.col("_r1")["message"]))
        df = parsers.fenced(df, "_inner", inner).withColumn("_ifmt", F.when(F.col("_inner").isNotNull(), detect.detect(F.col("_inner"))))
        df = df.withColumn("_behind", F.when(F.col("_ifmt").isin(*detect.SYSLOG), detect.behind_syslog(F.col("_inner"), F.col("_ifmt"))))
        df = df.withColumn("_sub", F.when(F.col("_behind").isNotNull(), detect.detect(F.col("_behind"))))
        df = df.withColumn("_ifmt", detect.inner_format(F.col("_inner"), F.col("_ifmt"), F.coalesce("_sub", F.lit(""))))
        df = df.withColumn("_p2", F.when(F.col("_inner").isNotNull(), parsers.resolve(F.col("_inner"), F.col("_ifmt"), cfg, registry)))
        df = df.withColumn("_p2", F.when((F.col("_p2") != F.col("_p1")) & (F.col("_p2") != "plain_text"), F.col("_p2")))
        df = parsers.parse(df, "_inner", "_p2", "_r2", cfg, registry)
    else:
        df = df.withColumns({"_p2": F.lit(None).cast("string"), "_r2": nothing})

    # one event of both
    r1, r2, chained = F.col("_r1"), F.col("_r2"), F.col("_p2").isNotNull()
    unknown = F.col("_lost") | (F.col("_p1") == "plain_text")

    joined = {"_normalized": "fields", "_vendor": "vendor", "_unknown": "unknown", "_original": "original", "_decoded": "decoded", "_protocol": "protocol"}
    df = df.withColumns({c: F.concat(r1[x], F.coalesce(r2[x], X.no_text_entries() if x == "original" else X.no_entries())) for c, x in joined.items()})

    either = lambda s: (r1["status"] == s) | (chained & (r2["status"] == s))
    mixed = chained & either("FAILED") & (r1["status"] != r2["status"])
    status = F.when(unknown, "UNKNOWN_FORMAT").when(mixed, "PARTIAL").when(either("FAILED"), "FAILED").when(either("PARTIAL"), "PARTIAL").otherwise("PARSED")
    df = df.withColumns(
        {
            **{c: X.last_wins(F.col(c)) for c in joined},
            "format_detected": F.when(unknown, "unknown").otherwise(F.col("_fmt")),
            "parser_name": F.when(chained, F.concat_ws("+", "_p1", "_p2")).otherwise(F.col("_p1")),
            "parser_version": parsers.version_of(F.coalesce("_p2", "_p1"), registry),
            "parse_status": status,
            "hostname": F.coalesce(X.blank_to_null(r1["hostname"]), X.blank_to_null(r2["hostname"])),
            "_sig": identity.signature(text),
        }
    )

    # limits, identity, checks
    extracted = F.concat("_normalized", "_vendor", "_unknown")
    df = df.withColumn("_big", F.when(F.octet_length(text) > cfg.limits.max_field_bytes, checks.oversized(extracted, cfg.limits)).otherwise(F.array().cast("array<string>"))).withColumn("_many", checks.too_many(F.size("_normalized") + F.size("_vendor") + F.size("_unknown"), cfg.limits))
    decision = F.when(F.col("_ok").isNotNull(), F.concat(F.lit("PARSER_HINT:"), F.when(F.col("_ok"), "hint_used").otherwise("hint_rejected_fallback"), F.lit(":"), hint))
    own = lambda c: F.array(F.concat(F.lit("parser="), F.col(c), F.lit("@"), parsers.version_of(F.col(c), registry)))
    notes = F.array_distinct(
        F.concat(F.array_compact(F.array(decision)), r1["notes"], own("_p1"), F.coalesce(F.concat(r2["notes"], own("_p2")), F.array().cast("array<string>")), X.notes(("CHAIN_PARTIAL:envelope parsed, inner failed", mixed)), "_big", F.array_compact(F.array("_many")))
    )
    vendor_of = lambda k: F.try_variant_get(F.get(F.filter("_decoded", lambda e: e["k"] == k), F.lit(0))["v"], "$", "string")
    by_format = lambda a, b: F.when(F.col("_fmt") == "cef", vendor_of(a)).when(F.col("_fmt") == "leef", vendor_of(b))
    ident = identity.identify(F.col("_def"), F.col("_sig"), F.col("format_detected"), by_format("cef_device_vendor", "leef_vendor"), by_format("cef_device_product", "leef_product"), r1["tag"])
    if asked & {"validation_status", "validation_problems"}:
        df = parsers.fenced(df, "_six", checks.ipv6_values(F.col("_normalized")))
        df = df.withColumn("_bad6", F.when(F.col("_six").isNotNull(), checks.bad_ipv6(F.col("_six"))))
    else:
        df = df.withColumn("_bad6", F.lit(None).cast("array<string>"))
    missing = F.when(text == "", F.struct(F.lit("raw").alias("field"), F.lit("raw_message missing").alias("problem"), F.lit(None).cast("string").alias("value")))
    as_map = lambda c: F.map_from_entries(F.col(c))
    df = df.withColumns(
        {
            "parse_notes": notes,
            "truncated": (F.size("_big") > 0) | F.col("_many").isNotNull(),
            "raw_size_bytes": F.octet_length("raw_message").cast("bigint"),
            "decode_notes": F.array_compact(F.array("decode_note")),
            "source_name": F.coalesce(F.col("_def")["source_id"], F.col("source_name")),
            "validation_problems": F.concat(checks.problems(F.col("_normalized"), F.col("_bad6")), F.array_compact(F.array(missing))),
            "normalized": as_map("_normalized"), "vendor_fields": as_map("_vendor"), "unknown_fields": as_map("_unknown"), "original_fields": as_map("_original"),
            "decoded": as_map("_decoded"), "protocol_metadata": as_map("_protocol"),
            **ident,
        }
    )
    df = df.withColumns(
        {
            "validation_status": F.when(F.size("validation_problems") > 0, "INVALID").otherwise("VALID"),
            "delivery_status": F.lit("PENDING"), "delivery_target": F.lit(None).cast("string"), "delivery_error": F.lit(None).cast("string"), "delivery_attempts": F.lit(0),
        }
    )
    return df.select(*[c for c in df.columns if c in asked or (c not in EVENT and c != "decode_note" and not c.startswith("_"))])


def text_of(layer: str, key: str) -> Column:
    """A field of a layer as text; null if it is absent, null or no scalar."""
    return F.try_variant_get(F.col(layer)[key], "$", "string")


def long_of(layer: str, key: str) -> Column:
    return F.try_variant_get(F.col(layer)[key], "$", "bigint")


def metrics(events: DataFrame) -> DataFrame:
    """name, value: the counters of a batch of events, in one pass with partial sums."""
    counts = {
        "events_received": F.count("*"),
        "events_parsed": F.count_if(F.col("parse_status") == "PARSED"),
        "events_partial_parsed": F.count_if(F.col("parse_status") == "PARTIAL"),
        "events_parse_failed": F.count_if(F.col("parse_status") == "FAILED"),
        "events_unknown_format": F.count_if(F.col("parse_status") == "UNKNOWN_FORMAT"),
        "events_unknown_source": F.count_if(F.col("source_status") == "UNKNOWN"),
        "events_validation_failed": F.count_if(F.col("validation_status") == "INVALID"),
        "events_field_limits": F.count_if(F.col("truncated")),
        "error.PARSE_ERROR": F.count_if(F.exists("parse_notes", lambda n: n.startswith("PARSE_ERROR:"))),
    }
    one = events.agg(*[c.alias(n.replace(".", "_")) for n, c in counts.items()])
    return one.select(F.explode(F.create_map(*[x for n in counts for x in (F.lit(n), F.col(n.replace(".", "_")))])).alias("name", "value"))


def delivery_metrics(outcomes: DataFrame) -> DataFrame:
    """name, value: deliveries per kind of target (what its name says before ':'), what was spooled or rejected, and errors of the target itself."""
    status, error = F.col("delivery_status"), F.coalesce("delivery_error", F.lit(""))
    kind = (
        F.when(status == "DELIVERED", F.concat(F.lit("delivery_delivered."), F.substring_index("delivery_target", ":", 1)))
        .when(status == "REJECTED", "delivery_rejected.spool").otherwise(F.concat(F.lit("events_"), F.lower(status)))
    )
    names = F.array_compact(F.array(kind, F.when(error.startswith("ADAPTER:"), "error.SIEM_DELIVERY_ERROR")))
    return outcomes.select(F.explode(names).alias("name")).groupBy("name").agg(F.count("*").alias("value"))


def recent(events: DataFrame, n: int = 100) -> DataFrame:
    """The last n events, at most 1000."""
    return events.orderBy(F.desc("ingested_at_unix_utc"), F.desc("event_id")).limit(max(1, min(n, 1000)))


def event_by_id(events: DataFrame, event_id: str) -> DataFrame:
    return events.where(F.col("event_id") == event_id).limit(1)


def summary(events: DataFrame) -> DataFrame:
    return events.select(F.left("event_id", F.lit(8)).alias("id"), "format_detected", "source_status", "vendor", "parser_name", "parse_status")
