"""Events to the wire: spool JSON lines, syslog with JSON, LEEF 1.0, bulk NDJSON; and what a bulk answer says. Columns only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.functions.ids import ingest_us

_ALL = {"ignoreNullFields": "false"}


def _json(c: Column) -> Column:
    return F.to_json(c, _ALL)


def document() -> Column:
    """The whole event as one nested struct, the layers as maps."""
    s = lambda **cols: F.struct(*[(F.col(v) if isinstance(v, str) else v).alias(k) for k, v in cols.items()])
    null = F.lit(None).cast("string")
    return s(
        ingestion=s(event_id="event_id", ingested_at_unix_utc="ingested_at_unix_utc"),
        transport=s(transport="transport", protocol="transport_protocol", peer_ip="peer_ip", peer_port="peer_port", local_port="local_port", source_name="source_name", file_path="file_path", file_line_number="file_line_number"),
        raw=s(raw_message="raw_message", raw_bytes_b64="raw_bytes_b64", raw_size_bytes="raw_size_bytes", truncated="truncated"),
        protocol_metadata="protocol_metadata", decoded="decoded", decode_ok=F.lit(None).cast("boolean"), decode_notes="decode_notes",
        source=s(status="source_status", vendor="vendor", product="product", product_version=null, hostname="hostname", evidence="source_evidence"),
        parser=s(name="parser_name", version="parser_version", status="parse_status", notes="parse_notes", format_detected="format_detected", duration_ms=F.lit(None).cast("double")),
        normalized="normalized", vendor="vendor_fields", unknown="unknown_fields", original="original_fields",
        validation=s(status="validation_status", problems="validation_problems"),
        delivery=s(status="delivery_status", target="delivery_target", error="delivery_error", attempts="delivery_attempts"),
    )


def spool_json() -> Column:
    return _json(document())


def severity() -> Column:
    """0..10: event.severity if it is a number, else the syslog severity, else 5."""
    own = F.when(F.schema_of_variant(F.col("normalized")["event.severity"]) == "BIGINT", F.try_variant_get(F.col("normalized")["event.severity"], "$", "bigint"))
    return F.coalesce(F.when(own.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(10), own))), F.try_variant_get(F.col("protocol_metadata")["syslog.severity"], "$", "bigint"), F.lit(5)).cast("bigint")


def _shown(v: Column) -> Column:
    return F.coalesce(F.try_variant_get(v, "$", "string"), F.to_json(v))


def leef() -> Column:
    """LEEF 1.0, tab-delimited: severity, addresses, the raw message, unknown (u_) and vendor (v_) fields in key order."""
    product = F.coalesce(X.blank_to_null(F.col("product")), X.blank_to_null(F.col("parser_name")))
    clean = lambda c: F.replace(c, F.lit("|"), F.lit("/"))
    head = F.concat(
        F.lit("LEEF:1.0|"), clean(F.coalesce(X.blank_to_null(F.col("vendor")), F.lit("UnknownVendor"))), F.lit("|"), clean(F.coalesce(product, F.lit("UnknownProduct"))),
        F.lit("|1.0|"), clean(F.coalesce(product, F.lit("event"))), F.lit("\t"),
    )

    def layer(prefix: str, c: str) -> Column:
        keys = F.array_sort(F.map_keys(c))
        return F.transform(keys, lambda k: F.concat(X.leef_key(F.concat(F.lit(prefix), k)), F.lit("="), X.leef_value(F.coalesce(_shown(F.col(c)[k]), F.lit("None")))))

    field = lambda name, k: F.array_compact(F.array(F.when(F.coalesce(_shown(F.col("normalized")[k]), F.lit("")) != "", F.concat(F.lit(f"{name}="), _shown(F.col("normalized")[k])))))
    attrs = F.concat(
        F.array(F.concat(F.lit("sev="), severity().cast("string"))), field("src", "source.ip"), field("dst", "destination.ip"),
        F.array(F.concat(F.lit("raw="), X.leef_value(F.coalesce("raw_message", F.lit(""))))), layer("u_", "unknown_fields"), layer("v_", "vendor_fields"),
    )
    return F.concat(head, F.array_join(attrs, "\t"))


def _instant(unix: Column) -> Column:
    """An ingestion time, whatever its unit; one that is no such time as it stands."""
    return F.timestamp_micros(F.coalesce(ingest_us(unix), F.floor(unix * 1e6).cast("bigint")))


def bsd_stamp(unix: Column) -> Column:
    ts = _instant(unix)
    return F.concat(F.date_format(ts, "MMM"), F.lit(" "), F.lpad(F.dayofmonth(ts).cast("string"), 2, " "), F.date_format(ts, " HH:mm:ss"))


def syslog_json(tag: str = "millrace", pri: int = 134) -> Column:
    host = F.coalesce(X.blank_to_null(F.col("hostname")), X.blank_to_null(F.col("peer_ip")), F.lit("unknown"))
    return F.concat(F.lit(f"<{pri}>"), bsd_stamp(F.col("ingested_at_unix_utc")), F.lit(" "), host, F.lit(f" {tag}: "), spool_json())


def index_name(prefix: str) -> Column:
    """The index of the day of ingestion, whatever the unit of its time."""
    return F.concat(F.lit(f"{prefix}-"), F.date_format(_instant(F.col("ingested_at_unix_utc")), "yyyy.MM.dd"))


def bulk_lines(prefix: str = "millrace") -> Column:
    """An action line and a document line. The document's members are named by their dotted paths."""
    action = F.concat(F.lit('{"index":{"_index":"'), index_name(prefix), F.lit('"}}'))
    plain = {
        "ingestion.event_id": "event_id", "ingestion.ingested_at_unix_utc": "ingested_at_unix_utc", "transport.transport": "transport", "transport.protocol": "transport_protocol",
        "transport.peer_ip": "peer_ip", "transport.peer_port": "peer_port", "transport.source_name": "source_name", "transport.file_path": "file_path",
        "transport.file_line_number": "file_line_number", "raw.raw_message": "raw_message", "raw.raw_bytes_b64": "raw_bytes_b64", "raw.raw_size_bytes": "raw_size_bytes",
        "raw.truncated": "truncated", "source.status": "source_status", "source.vendor": "vendor", "source.product": "product", "source.hostname": "hostname",
        "source.evidence": "source_evidence", "parser.name": "parser_name", "parser.version": "parser_version", "parser.status": "parse_status", "parser.notes": "parse_notes",
        "parser.format_detected": "format_detected", "validation.status": "validation_status", "validation.problems": "validation_problems", "delivery.status": "delivery_status",
        "delivery.target": "delivery_target", "delivery.error": "delivery_error", "delivery.attempts": "delivery_attempts", "decode_notes": "decode_notes",
    }
    fixed = _json(F.struct(*[F.col(c).alias(k) for k, c in plain.items()]))
    prefixed = lambda p, c: F.transform(F.map_entries(c), lambda e: F.struct(F.concat(F.lit(f"{p}."), e["key"]).alias("key"), e["value"].alias("value")))
    layers = F.concat(*[prefixed(p, c) for p, c in (("normalized", "normalized"), ("vendor", "vendor_fields"), ("unknown", "unknown_fields"), ("protocol_metadata", "protocol_metadata"), ("decoded", "decoded"))])
    rest = _json(F.map_from_entries(layers))
    joined = F.when(rest == "{}", fixed).otherwise(F.concat(F.left(fixed, F.length(fixed) - 1), F.lit(","), F.substring(rest, F.lit(2), F.length(rest))))
    return F.concat(action, F.lit("\n"), joined, F.lit("\n"))


def bulk_outcome(answers: DataFrame) -> DataFrame:
    """batch_id, position (0-based), error (null if delivered) of each event of a batch, from http_status, body and n_events.

    Another status than 200 fails the whole batch, and so does a body that is no JSON object. If
    the answer reports errors or tells of another number of items, each item counts for itself
    and an item that is missing counts as delivered; else all are delivered.
    """
    v = F.try_parse_json("body")
    ok = F.schema_of_variant(v).startswith("OBJECT")
    items = F.try_variant_get(v, "$.items", "array<variant>")
    errors = F.coalesce(F.try_variant_get(v, "$.errors", "boolean"), F.lit(False))
    whole = (
        F.when(F.col("http_status") != 200, F.concat(F.lit("ELASTIC_HTTP:"), F.col("http_status").cast("string"))).when(~F.coalesce(ok, F.lit(False)), F.lit("ELASTIC_BAD_RESPONSE"))
    )
    by_item = errors | (F.coalesce(F.size(items), F.lit(0)) != F.col("n_events"))
    seq = F.when(F.col("n_events") > 0, F.sequence(F.lit(0), F.col("n_events") - 1)).otherwise(F.array().cast("array<int>"))
    base = answers.withColumn("_items", items).withColumn("_whole", whole).withColumn("_by", by_item)
    item = F.get("_items", F.col("position"))
    err = F.coalesce(F.try_variant_get(item, "$.index.error", "variant"), F.when(F.try_variant_get(item, "$.index", "variant").isNull(), F.try_variant_get(item, "$.error", "variant")))
    said = F.when(err.isNotNull() & ~F.is_variant_null(err), F.concat(F.lit("ELASTIC_ITEM:"), F.to_json(err)))
    return base.select("batch_id", "_items", "_whole", "_by", F.explode(seq).alias("position")).select("batch_id", "position", F.coalesce("_whole", F.when(F.col("_by"), said)).alias("error"))
