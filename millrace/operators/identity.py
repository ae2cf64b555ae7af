"""Where an event comes from: configured sources, signatures in the message, protocol headers; with the evidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.config import Source

#: Fixed values: (name, expression, vendor, product), in order.
SIGNATURES = [
    ("sig_cisco_asa", r"%ASA-\d-\d+:", "Cisco", "ASA"),
    ("sig_cisco_pix", r"%PIX-\d-\d+:", "Cisco", "PIX"),
    ("sig_cisco_fwsm", r"%FWSM-\d-\d+:", "Cisco", "FWSM"),
    ("sig_cisco_asdm", r"%ASDM-\d-\d+:", "Cisco", "ASDM"),
    ("sig_fortigate", r"(?s)\blogid=\d{10}\b.*\btype=\w+.*\bsubtype=\w+", "Fortinet", "FortiGate"),
    ("sig_sonicwall", r"(?s)\bid=firewall\b.*\bsn=\w+.*\bfw=\d+\.\d+\.\d+\.\d+", "SonicWall", "Firewall"),
]
#: A literal without which the signature can't match; tested first.
_NEEDLE = {"sig_cisco_asa": "%ASA-", "sig_cisco_pix": "%PIX-", "sig_cisco_fwsm": "%FWSM-", "sig_cisco_asdm": "%ASDM-", "sig_fortigate": "logid=", "sig_sonicwall": "id=firewall"}

_DEFINITION = "struct<source_id:string,vendor:string,product:string,parser_hint:string>"


def configured(sources: tuple[Source, ...]) -> Column:
    """The first configured source that all its set anchors match, as a struct; null if none does.

    The definitions are configuration: they become one CASE in the plan, no join is needed.
    """
    out = F.lit(None).cast(_DEFINITION)
    for s in reversed(sources):
        anchors = [F.col(c) == F.lit(v) for c, v in (("transport", s.transport), ("peer_ip", s.peer_ip), ("local_port", s.port), ("file_path", s.file_path)) if v not in (None, "")]
        if not anchors:
            continue
        match = anchors[0]
        for a in anchors[1:]:
            match = match & a
        made = F.struct(F.lit(s.source_id).alias("source_id"), F.lit(s.vendor).alias("vendor"), F.lit(s.product).alias("product"), F.lit(s.parser_hint).alias("parser_hint"))
        out = F.when(F.coalesce(match, F.lit(False)), made.cast(_DEFINITION)).otherwise(out)
    return out


def signature(raw: Column) -> Column:
    """struct<name, match, vendor, product> of the first signature in the message; null if there is none."""
    kind = "struct<name:string,match:string,vendor:string,product:string>"
    out = F.lit(None).cast(kind)
    for name, rx, vendor, product in reversed(SIGNATURES):
        found = F.struct(F.lit(name).alias("name"), F.left(F.regexp_extract(raw, rx, 0), F.lit(80)).alias("match"), F.lit(vendor).alias("vendor"), F.lit(product).alias("product"))
        out = F.when(F.contains(raw, F.lit(_NEEDLE[name])) & raw.rlike(rx), found.cast(kind)).otherwise(out)
    return out


def identify(definition: Column, sig: Column, fmt: Column, header_vendor: Column, header_product: Column, tag: Column) -> dict[str, Column]:
    """source_status, vendor, product and source_evidence (array of [key, value])."""
    known, signed = definition.isNotNull(), sig.isNotNull()
    by_header = fmt.isin("cef", "leef") & (F.coalesce(header_vendor, F.lit("")) != "")
    has_tag = fmt.isin("rfc5424", "rfc3164") & (F.coalesce(tag, F.lit("")) != "")
    pair = lambda c, k, v: F.when(c, F.array(k if isinstance(k, Column) else F.lit(k), v))
    free = ~known & ~signed
    evidence = F.array_compact(
        F.array(
            pair(known, "configured_source", definition["source_id"]),
            pair(known & (F.coalesce(definition["parser_hint"], F.lit("")) != ""), "parser_hint", definition["parser_hint"]),
            pair(F.coalesce(F.col("transport"), F.lit("")) != "", "transport", F.col("transport")),
            pair(F.coalesce(F.col("transport_protocol"), F.lit("")) != "", "protocol", F.col("transport_protocol")),
            pair(F.col("peer_ip").isNotNull(), "peer", F.col("peer_ip")),
            pair(F.col("local_port").isNotNull(), "port", F.col("local_port").cast("string")),
            pair(F.col("file_path").isNotNull(), "file", F.col("file_path")),
            pair(~known & signed, "signature", sig["name"]),
            pair(~known & signed, "signature_match", sig["match"]),
            pair(free & by_header, F.concat(fmt, F.lit("_header")), F.concat_ws("|", header_vendor, F.coalesce(header_product, F.lit("")))),
            pair(free & has_tag, F.when(fmt == "rfc5424", "rfc5424.appname").otherwise("rfc3164.tag"), tag),
            pair(free & ~by_header, "result", F.lit("no deterministic rule matched")),
        )
    )
    return {
        "source_status": F.when(known, "KNOWN").when(signed | by_header, "INFERRED").otherwise("UNKNOWN"),
        "vendor": F.when(known, definition["vendor"]).when(signed, sig["vendor"]).when(by_header, header_vendor),
        "product": F.when(known, definition["product"]).when(signed, sig["product"]).when(by_header, header_product),
        "source_evidence": evidence,
    }
