"""Queries of the engine's own operators. Each renders telemetry from a table's columns and parses it
back, or runs over the raw messages; the SQL tells the result from the columns themselves."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.config import Config, Limits, Source
from millrace.functions import text as X
from millrace.operators import checks, detect, parsers, serialize
from millrace.plans import pipeline as P
from millrace.session import spread, table
from millrace.sources import framing

CFG = Config(reference_year=2025)
_n, _s = P.long_of, P.text_of


def _c(*parts: str | Column) -> Column:
    """Concatenation: strings are literals, '$x' is column x as text."""
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.col(p[1:]).cast("string") if p.startswith("$") else F.lit(p) for p in parts])


def _parsed(df: DataFrame, raw: Column, cfg: Config = CFG, columns: tuple[str, ...] | None = None) -> DataFrame:
    return P.parse_events(spread(df).withColumn("raw_message", raw), cfg, at=1_760_000_000.0, columns=columns)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---- detection -------------------------------------------------------------------------------


def _detect_sql(t: str) -> str:
    filled = lambda sep: f"NOT regexp_matches({t}, '(?:^|{sep})\\s*(?:{sep}|\\z)')"
    return f"""CASE WHEN {t} IS NULL OR {t} = '' THEN 'unknown'
 WHEN regexp_matches({t}, '^<\\d{{1,3}}>[1-9]\\d* \\S') THEN 'rfc5424' WHEN regexp_matches({t}, '(?:^|\\s)CEF:\\d+\\|') THEN 'cef'
 WHEN regexp_matches({t}, '(?:^|\\s)LEEF:\\d+\\.\\d+\\|') THEN 'leef' WHEN regexp_matches({t}, '^\\s*\\{{') THEN 'json'
 WHEN regexp_matches({t}, '^(?:<\\d{{1,3}}>)?[A-Z][a-z]{{2}} {{1,2}}\\d{{1,2}} \\d{{2}}:\\d{{2}}:\\d{{2}} \\S') THEN 'rfc3164'
 WHEN len(regexp_extract_all({t}, '(?:^|\\s)[A-Za-z][A-Za-z0-9_.-]*=')) >= 2 THEN 'key_value'
 WHEN regexp_matches({t}, '^\\s*<\\?xml') OR regexp_matches({t}, '^\\s*<[A-Za-z_][\\w.-]*[\\s>]') THEN 'xml'
 WHEN contains({t}, chr(9)) OR (contains({t}, ';') AND {filled(';')}) OR (contains({t}, ',') AND NOT contains({t}, ' ') AND {filled(',')}) THEN 'csv' ELSE 'plain_text' END"""


@query(f"SELECT doc_id, {_detect_sql('text')} AS format FROM documents")
def detect_documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", detect.detect(F.col("text")).alias("format"))


@query(f"SELECT row_id, {_detect_sql('raw_message')} AS format FROM telemetry")
def detect_telemetry(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "telemetry").select("row_id", detect.detect(F.col("raw_message")).alias("format"))


@query(f"SELECT line_id, {_detect_sql('raw_message')} AS format FROM file_lines")
def detect_file_lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "file_lines").select("line_id", detect.detect(F.col("raw_message")).alias("format"))


@query(f"SELECT {_detect_sql('props')} AS format, count(*) AS n FROM events GROUP BY ALL")
def detect_props(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(detect.detect(F.col("props")).alias("format")).agg(F.count("*").alias("n"))


# ---- key=value -------------------------------------------------------------------------------


@query("SELECT event_id, '10.0.0.' || (user_id % 250) AS ip, user_id AS port, 'u' || user_id AS who, event_type AS act, event_id AS sent FROM events")
def parse_kv_events(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumnRenamed("event_id", "eid")
    raw = _c("src=10.0.0.", F.col("user_id") % 250, " sport=", "$user_id", " user=u", "$user_id", ' action="', "$event_type", '" bytes_sent=', "$eid")
    return _parsed(e, raw).select(
        F.col("eid").alias("event_id"), _s("normalized", "source.ip").alias("ip"), _n("normalized", "source.port").alias("port"),
        _s("normalized", "source.user.name").alias("who"), _s("normalized", "event.action").alias("act"), _n("normalized", "source.bytes").alias("sent"),
    )


@query("SELECT event_id, 'b' || user_id AS last_user, 'x' || user_id AS first_note, 'y' || user_id AS second_note FROM events")
def kv_duplicate_keys(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumnRenamed("event_id", "eid")
    raw = _c("user=a", "$user_id", " note=x", "$user_id", " user=b", "$user_id", " note=y", "$user_id")
    return _parsed(e, raw).select(F.col("eid").alias("event_id"), _s("normalized", "source.user.name").alias("last_user"), _s("unknown_fields", "kv.note").alias("first_note"), _s("unknown_fields", "kv.note#2").alias("second_note"))


@query("SELECT event_id, event_type AS loose, NULL::BIGINT AS port, 'KV_INVALID_NUMERIC:sport=x' || user_id AS note FROM events")
def kv_unpaired(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumnRenamed("event_id", "eid")
    raw = _c("$event_type", " user=a sport=x", "$user_id")
    return _parsed(e, raw).select(F.col("eid").alias("event_id"), _s("unknown_fields", "kv.unpaired_0").alias("loose"), _n("normalized", "source.port").alias("port"), F.col("parse_notes")[0].alias("note"))


# ---- CEF -------------------------------------------------------------------------------------


@query("SELECT event_id, event_type AS name, user_id AS port, 'k ' || user_id AS message, 'v' || event_id AS odd, 'INFERRED' AS status FROM events")
def parse_cef_events(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumnRenamed("event_id", "eid")
    raw = _c("CEF:0|Acme|Gate|1.0|7|", "$event_type", "|5|src=10.0.0.1 spt=", "$user_id", " msg=k ", "$user_id", " oddField=v", "$eid")
    return _parsed(e, raw).select(
        F.col("eid").alias("event_id"), _s("normalized", "cef.name").alias("name"), _n("normalized", "source.port").alias("port"), _s("normalized", "message").alias("message"),
        _s("unknown_fields", "cef.ext.oddField").alias("odd"), F.col("source_status").alias("status"),
    )


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 4 WHEN 3 THEN 8 WHEN 4 THEN 10 ELSE least(user_id, 10) END AS severity FROM events""")
def cef_severity(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumnRenamed("event_id", "eid")
    words = F.array(*[F.lit(w) for w in ("Unknown", "Low", "Medium", "High", "Very-High")])
    sev = F.when(F.col("eid") % 6 < 5, F.get(words, (F.col("eid") % 6).cast("int"))).otherwise(F.col("user_id").cast("string"))
    return _parsed(e, _c("CEF:0|A|B|1|2|n|", sev, "|act=x")).select(F.col("eid").alias("event_id"), _n("normalized", "event.severity").alias("severity"))


@query("SELECT p_partkey, p_name || '|' || p_brand AS name, 'a=b ' || p_name || chr(10) || p_type AS message, p_brand AS first, p_type AS second FROM part")
def cef_escapes(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    raw = _c("CEF:0|A|B|1|2|", "$p_name", "\\|", "$p_brand", "|3|msg=a\\=b ", "$p_name", "\\n", "$p_type", " x=", "$p_brand", " x=", "$p_type")
    return _parsed(p, raw).select(
        "p_partkey", F.replace(_s("normalized", "cef.name"), F.lit("\\|"), F.lit("|")).alias("name"), _s("normalized", "message").alias("message"),
        _s("unknown_fields", "cef.ext.x").alias("first"), _s("unknown_fields", "cef.ext.x#2").alias("second"),
    )


@query("SELECT event_id, NULL::BIGINT AS port, 'CEF_INVALID_PORT:spt=p' || user_id AS note, 'VALID' AS validation FROM events")
def cef_invalid_port(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumnRenamed("event_id", "eid")
    return _parsed(e, _c("CEF:0|A|B|1|2|n|3|spt=p", "$user_id")).select(F.col("eid").alias("event_id"), _n("normalized", "source.port").alias("port"), F.col("parse_notes")[0].alias("note"), F.col("validation_status").alias("validation"))


@query("SELECT event_id, 'FAILED' AS status, 'CEF_HEADER_INCOMPLETE:' || (3 + event_id % 4) || '/7 fields' AS note FROM events")
def cef_short_header(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumnRenamed("event_id", "eid")
    raw = F.concat(F.lit("CEF:0|A|B"), F.repeat(F.lit("|x"), (F.col("eid") % 4).cast("int")))
    return _parsed(e, raw).select(F.col("eid").alias("event_id"), F.col("parse_status").alias("status"), F.col("parse_notes")[0].alias("note"))


# ---- LEEF ------------------------------------------------------------------------------------


@query("SELECT s_suppkey, s_name AS who, s_nationkey AS severity, s_suppkey AS port, 'a ' || s_name AS odd FROM supplier")
def parse_leef_tab(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    raw = _c("LEEF:1.0|Acme|Mail|2|77|\tusrName=", "$s_name", "\tsev=", "$s_nationkey", "\tsrcPort=", "$s_suppkey", "\todd=a ", "$s_name")
    return _parsed(s, raw).select("s_suppkey", _s("normalized", "source.user.name").alias("who"), _n("normalized", "event.severity").cast("int").alias("severity"), _n("normalized", "source.port").alias("port"), _s("unknown_fields", "leef.attr.odd").alias("odd"))


@query("SELECT c_custkey, c_name AS who, c_mktsegment AS category, CASE WHEN c_custkey % 2 = 0 THEN '^' ELSE ';' END AS delim FROM customer")
def leef_custom_delim(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    even = F.col("c_custkey") % 2 == 0
    sep = F.when(even, "^").otherwise(";")
    raw = _c("LEEF:2.0|Acme|Mail|2|77|", F.when(even, "x5E").otherwise(";"), "|usrName=", "$c_name", sep, "cat=", "$c_mktsegment")
    return _parsed(c, raw).select("c_custkey", _s("normalized", "source.user.name").alias("who"), _s("normalized", "event.category").alias("category"), _s("decoded", "leef_delimiter").alias("delim"))


@query("SELECT c_custkey, c_name || ' of ' || c_mktsegment AS message, c_mktsegment AS category, true AS deviates FROM customer")
def leef_space_deviation(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    raw = _c("LEEF:1.0|Acme|Mail|2|77|msg=", "$c_name", " of ", "$c_mktsegment", " cat=", "$c_mktsegment")
    return _parsed(c, raw).select("c_custkey", _s("normalized", "message").alias("message"), _s("normalized", "event.category").alias("category"), F.array_contains("parse_notes", "LEEF_SPACE_SEPARATOR_DEVIATION:tab delimiter absent").alias("deviates"))


# ---- syslog ----------------------------------------------------------------------------------


@query("""SELECT o_orderkey, (o_orderkey % 192) // 8 AS facility, (o_orderkey % 192) % 8 AS severity, 'h' || o_custkey AS host, NULL::VARCHAR AS app, o_orderpriority AS message,
 strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS ts FROM orders""")
def parse_rfc5424(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    raw = _c("<", F.col("o_orderkey") % 192, ">1 ", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"), " h", "$o_custkey", " - 1 ID - ", "$o_orderpriority")
    return _parsed(o, raw).select(
        "o_orderkey", _n("normalized", "log.syslog.facility").alias("facility"), _n("normalized", "log.syslog.severity").alias("severity"), F.col("hostname").alias("host"),
        _s("normalized", "log.syslog.appname").alias("app"), _s("normalized", "message").alias("message"), _s("normalized", "@timestamp").alias("ts"),
    )


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 1000 > 191 THEN 'PARTIAL' ELSE 'PARSED' END AS status FROM orders")
def rfc5424_pri(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return _parsed(o, _c("<", F.col("o_orderkey") % 1000, ">1 - - - - - - m")).select("o_orderkey", F.col("parse_status").alias("status"))


@query("SELECT event_id, 'u' || user_id AS a, event_type || ' \"x\"' AS b, event_type AS message FROM events")
def rfc5424_sd(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumnRenamed("event_id", "eid")
    raw = _c('<13>1 - h a p m [ex@1 a="u', "$user_id", '" b="', "$event_type", ' \\"x\\""] ', "$event_type")
    sd = F.col("vendor_fields")["log.syslog.structure.ex@1"]
    return _parsed(e, raw).select(F.col("eid").alias("event_id"), F.try_variant_get(sd, "$.a", "string").alias("a"), F.try_variant_get(sd, "$.b", "string").alias("b"), _s("normalized", "message").alias("message"))


@query("""SELECT event_id, CASE WHEN date_trunc('second', ts) = ts THEN strftime(ts - INTERVAL 5 HOUR - INTERVAL 30 MINUTE, '%Y-%m-%dT%H:%M:%SZ')
 ELSE strftime(ts - INTERVAL 5 HOUR - INTERVAL 30 MINUTE, '%Y-%m-%dT%H:%M:%S.%fZ') END AS ts FROM events""")
def rfc5424_ts_utc(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumnRenamed("event_id", "eid")
    raw = _c("<13>1 ", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), "+05:30 h a p m - x")
    return _parsed(e, raw).select(F.col("eid").alias("event_id"), _s("normalized", "@timestamp").alias("ts"))


@query("""SELECT o_orderkey, 'h' || o_custkey AS host, 'ord' AS tag, o_orderkey % 30000 AS pid, o_orderpriority AS message, strftime(o_orderdate, '2024-%m-%dT%H:%M:%SZ') AS ts FROM orders""")
def parse_rfc3164(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    stamp = F.concat(F.date_format("o_orderdate", "MMM"), F.lit(" "), F.lpad(F.dayofmonth("o_orderdate").cast("string"), 2, " "), F.date_format("o_orderdate", " HH:mm:ss"))
    raw = _c("<13>", stamp, " h", "$o_custkey", " ord[", F.col("o_orderkey") % 30000, "]: ", "$o_orderpriority")
    return _parsed(o, raw, Config(reference_year=2024)).select(
        "o_orderkey", F.col("hostname").alias("host"), _s("normalized", "log.syslog.appname").alias("tag"), _s("normalized", "log.syslog.procid").cast("bigint").alias("pid"),
        _s("normalized", "message").alias("message"), _s("normalized", "@timestamp").alias("ts"),
    )


@query("SELECT event_id, 'rfc3164+cef' AS parser, 'rfc3164' AS format, event_type AS name, user_id AS port, 'UNKNOWN' AS source FROM events")
def chain_rfc3164_cef(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumnRenamed("event_id", "eid")
    raw = _c("<13>Oct  1 10:00:00 gate CEF:0|A|B|1|2|", "$event_type", "|3|spt=", "$user_id")
    return _parsed(e, raw).select(F.col("eid").alias("event_id"), F.col("parser_name").alias("parser"), F.col("format_detected").alias("format"), _s("normalized", "cef.name").alias("name"), _n("normalized", "source.port").alias("port"), F.col("source_status").alias("source"))


@query("SELECT event_id, 'rfc5424+json' AS parser, user_id AS who, event_type AS kind FROM events")
def chain_rfc5424_json(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumnRenamed("event_id", "eid")
    raw = _c('<13>1 - h a p m - {"who": ', "$user_id", ', "kind": "', "$event_type", '"}')
    return _parsed(e, raw).select(F.col("eid").alias("event_id"), F.col("parser_name").alias("parser"), _n("normalized", "json.who").alias("who"), _s("normalized", "json.kind").alias("kind"))


# ---- ASA, FortiGate --------------------------------------------------------------------------


@query("""SELECT l_orderkey, l_linenumber, 'rfc3164+cisco_asa' AS parser, '10.0.' || (l_partkey % 250) || '.1' AS src, l_suppkey AS sport, '10.9.0.' || l_linenumber AS dst, l_linenumber::BIGINT AS dport,
 CASE WHEN l_linenumber % 2 = 0 THEN (l_quantity::BIGINT) * 3600 + 61 END AS seconds, CASE WHEN l_linenumber % 2 = 0 THEN l_partkey END AS bytes FROM lineitem""")
def parse_asa_connections(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem")
    ends = [" for outside:10.0.", F.col("l_partkey") % 250, ".1/", "$l_suppkey", " (10.1.1.1/1) to inside:10.9.0.", "$l_linenumber", "/", "$l_linenumber"]
    built = _c("<163>Jan 12 10:22:11 FW01 : %ASA-6-302013: Built outbound TCP connection 9", *ends)
    down = _c("<163>Jan 12 10:22:11 FW01 : %ASA-6-302014: Teardown TCP connection 9", *ends, " duration ", F.col("l_quantity").cast("bigint"), ":01:01 bytes ", "$l_partkey", " TCP FINs")
    return _parsed(x, F.when(F.col("l_linenumber") % 2 == 0, down).otherwise(built), columns=("parser_name", "normalized")).select(
        "l_orderkey", "l_linenumber", F.col("parser_name").alias("parser"), _s("normalized", "source.ip").alias("src"), _n("normalized", "source.port").alias("sport"),
        _s("normalized", "destination.ip").alias("dst"), _n("normalized", "destination.port").alias("dport"), _n("normalized", "event.duration_seconds").alias("seconds"),
        _n("normalized", "network.bytes").alias("bytes"),
    )


@query("""SELECT row_id, regexp_extract(raw_message, '%ASA-[0-7]-(\\d{6}): ', 1) AS message_id, regexp_extract(raw_message, '%ASA-([0-7])-', 1)::BIGINT AS severity, 'PARTIAL' AS status, 'Cisco' AS vendor
 FROM telemetry WHERE contains(raw_message, '%ASA-')""")
def asa_partial(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "telemetry").where(F.contains("raw_message", F.lit("%ASA-"))).select("row_id", "raw_message")
    return P.parse_events(t, CFG).select("row_id", _s("normalized", "cisco.message_id").alias("message_id"), _n("normalized", "event.severity").alias("severity"), F.col("parse_status").alias("status"), "vendor")


@query("""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS ts, event_type AS message, user_id AS sent, lpad(event_id::VARCHAR, 10, '0') AS logid, 'fortigate' AS parser, 'Fortinet' AS vendor FROM events""")
def parse_fortigate(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumnRenamed("event_id", "eid")
    raw = _c("date=", F.date_format("ts", "yyyy-MM-dd"), " time=", F.date_format("ts", "HH:mm:ss"), " logid=", F.lpad(F.col("eid").cast("string"), 10, "0"), " type=traffic subtype=local sentbyte=", "$user_id", ' msg="', "$event_type", '"')
    return _parsed(e, raw).select(
        F.col("eid").alias("event_id"), _s("normalized", "@timestamp").alias("ts"), _s("normalized", "message").alias("message"), _n("normalized", "source.bytes").alias("sent"),
        _s("vendor_fields", "fortigate.logid").alias("logid"), F.col("parser_name").alias("parser"), "vendor",
    )


@query("SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%SZ') AS ts FROM events")
def fortigate_eventtime(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumnRenamed("event_id", "eid")
    raw = _c("eventtime=", F.unix_seconds(F.col("ts").cast("timestamp")) * 1000, " logid=0000000013 type=event subtype=system")
    return _parsed(e, raw).select(F.col("eid").alias("event_id"), _s("normalized", "@timestamp").alias("ts"))


# ---- JSON, CSV, plain ------------------------------------------------------------------------


@query("SELECT event_id, (json_extract(props, '$.k'))::BIGINT AS k, 'json' AS parser FROM events")
def parse_json_props(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumnRenamed("event_id", "eid")
    return _parsed(e, F.col("props")).select(F.col("eid").alias("event_id"), _n("normalized", "json.k").alias("k"), F.col("parser_name").alias("parser"))


@query("SELECT event_id, event_type AS nested, user_id AS first, event_id AS second, 443 AS port, '[1, 2]' AS list FROM events")
def json_duplicates(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumnRenamed("event_id", "eid")
    raw = _c('{"a": {"b": "', "$event_type", '"}, "x": ', "$user_id", ', "x": ', "$eid", ', "dst_port": "443", "l": [1, 2]}')
    return _parsed(e, raw).select(
        F.col("eid").alias("event_id"), _s("normalized", "json.a.b").alias("nested"), _n("normalized", "json.x").alias("first"), _n("normalized", "json.x#2").alias("second"),
        _n("normalized", "destination.port").cast("int").alias("port"), F.col("original_fields")["original.json.l"].alias("list"),
    )


@query("SELECT n_nationkey, n_name AS col_1, n_nationkey::VARCHAR AS col_2, n_regionkey::VARCHAR AS col_3, 'PARTIAL' AS status FROM nation")
def parse_csv_noschema(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    raw = _c('"', "$n_name", '";', "$n_nationkey", ";", "$n_regionkey")
    return _parsed(n, raw).select("n_nationkey", *[_s("normalized", f"col_{i}").alias(f"col_{i}") for i in (1, 2, 3)], F.col("parse_status").alias("status"))


@query("SELECT r_regionkey, r_name AS name, r_regionkey::VARCHAR AS id, 'PARSED' AS status FROM region")
def csv_schema(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "region")
    cfg = Config(reference_year=2025, csv_schema=("id", "name"), csv_delimiter="\t")
    return _parsed(r, _c("$r_regionkey", "\t", "$r_name"), cfg).select("r_regionkey", _s("normalized", "name").alias("name"), _s("normalized", "id").alias("id"), F.col("parse_status").alias("status"))


@query("""SELECT line_id, CASE WHEN greatest(c, t, s) = 0 THEN NULL WHEN c = greatest(c, t, s) THEN ',' WHEN t = greatest(c, t, s) THEN chr(9) ELSE ';' END AS delimiter
 FROM (SELECT line_id, length(raw_message) - length(replace(raw_message, ',', '')) AS c, length(raw_message) - length(replace(raw_message, chr(9), '')) AS t, length(raw_message) - length(replace(raw_message, ';', '')) AS s FROM file_lines)""")
def csv_delimiter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "file_lines").select("line_id", parsers.csv_delimiter(F.col("raw_message"), None).alias("delimiter"))


@query("SELECT doc_id, length(text) - length(replace(text, chr(10), '')) + 1 AS line_count, strlen(text) AS byte_length FROM documents")
def plain_stats(spark: SparkSession, d: str) -> DataFrame:
    t = F.coalesce(F.col("text"), F.lit(""))
    none = F.array().cast("array<string>")
    r = parsers.plain_text(parsers.Scope(t, none, none, F.array().cast(parsers._PAIRS), none, F.lit(None), CFG))
    got = lambda k: F.try_variant_get(F.get(F.filter("e", lambda x: x["k"] == k), F.lit(0))["v"], "$", "bigint")
    return table(spark, d, "documents").select("doc_id", r["decoded"].alias("e")).select("doc_id", got("line_count").alias("line_count"), got("byte_length").alias("byte_length"))


# ---- checks, limits, identity ----------------------------------------------------------------


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '10.0.0.' || (user_id % 256) WHEN event_id % 3 = 1 THEN '10.0.0.' || (256 + user_id) ELSE 'fe80::' || (user_id % 10) END AS ip,
 CASE WHEN event_id % 3 = 1 THEN 1 ELSE 0 END AS n_problems, CASE WHEN event_id % 3 = 1 THEN 'INVALID' ELSE 'VALID' END AS status FROM events""")
def validate_ip(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumnRenamed("event_id", "eid")
    kind = F.col("eid") % 3
    ip = F.when(kind == 0, _c("10.0.0.", F.col("user_id") % 256)).when(kind == 1, _c("10.0.0.", F.col("user_id") + 256)).otherwise(_c("fe80::", F.col("user_id") % 10))
    return _parsed(e, _c("src=", ip, " user=x")).select(F.col("eid").alias("event_id"), _s("normalized", "source.ip").alias("ip"), F.size("validation_problems").alias("n_problems"), F.col("validation_status").alias("status"))


@query("SELECT event_id, CASE WHEN user_id * 2000 > 65535 THEN 'source.port' END AS field FROM events")
def validate_port(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumnRenamed("event_id", "eid")
    return _parsed(e, _c("sport=", F.col("user_id") * 2000, " user=x")).select(F.col("eid").alias("event_id"), F.get("validation_problems", F.lit(0))["field"].alias("field"))


@query("SELECT event_id, event_id % 2 = 0 AS ok FROM events")
def validate_timestamp(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumnRenamed("event_id", "eid")
    stamp = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.when(F.col("eid") % 2 == 0, "+02:00").otherwise(""))
    return _parsed(e, _c('{"time": "', stamp, '"}')).select(F.col("eid").alias("event_id"), (F.size("validation_problems") == 0).alias("ok"))


@query("""SELECT doc_id, strlen(text) > 8192 AS truncated, CASE WHEN strlen(text) > 8192 THEN 'FIELD_LIMIT_EXCEEDED:message:' || strlen(text) || '>8192' END AS note FROM documents""")
def field_limits(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.to_json(F.struct(F.col("text").alias("msg"))).alias("j"))
    return _parsed(docs, F.col("j")).select("doc_id", "truncated", F.get(F.filter("parse_notes", lambda n: n.startswith("FIELD_LIMIT")), F.lit(0)).alias("note"))


@query("SELECT event_id, user_id % 40 > 18 AS truncated, CASE WHEN user_id % 40 > 18 THEN 'FIELD_COUNT_LIMIT_EXCEEDED:' || (user_id % 40 - 18) || '_beyond_20' END AS note FROM events")
def field_count(spark: SparkSession, d: str) -> DataFrame:
    # two pairs at least, or it is no key=value message
    e = table(spark, d, "events").withColumnRenamed("event_id", "eid")
    raw = F.array_join(F.transform(F.sequence(F.lit(1), (F.col("user_id") % 40 + 2).cast("int")), lambda i: F.concat(F.lit("k"), i.cast("string"), F.lit("=1"))), " ")
    return _parsed(e, raw, Config(limits=Limits(max_field_count=20))).select(F.col("eid").alias("event_id"), "truncated", F.get(F.filter("parse_notes", lambda n: n.startswith("FIELD_COUNT")), F.lit(0)).alias("note"))


def _sources(spark: SparkSession, d: str) -> tuple[Source, ...]:
    """The configured sources: a fixed table of configuration."""
    rows = table(spark, d, "sources").orderBy("source_id").collect()
    return tuple(Source(r["source_id"], r["transport"], r["peer_ip"], None, r["file_path"], r["vendor"], r["product"], r["parser_hint"]) for r in rows)


_MATCHED = """m AS (SELECT t.row_id, t.raw_message, min(s.source_id) AS source_id FROM telemetry t LEFT JOIN sources s ON (s.transport IS NULL OR s.transport = t.transport)
 AND (s.peer_ip IS NULL OR s.peer_ip = t.peer_ip) AND (s.file_path IS NULL OR s.file_path = t.file_path) AND coalesce(s.transport, s.peer_ip, s.file_path) IS NOT NULL GROUP BY ALL)"""


@query(f"WITH {_MATCHED} SELECT row_id, m.source_id AS source, CASE WHEN m.source_id IS NOT NULL THEN 'KNOWN' END AS status, s.vendor, s.product FROM m LEFT JOIN sources s USING (source_id)")
def source_configured(spark: SparkSession, d: str) -> DataFrame:
    from millrace.operators import identity

    t = table(spark, d, "telemetry").withColumn("local_port", F.lit(None).cast("int")).withColumn("_def", identity.configured(_sources(spark, d)))
    return t.select("row_id", F.col("_def.source_id").alias("source"), F.when(F.col("_def").isNotNull(), "KNOWN").alias("status"), F.col("_def.vendor").alias("vendor"), F.col("_def.product").alias("product"))


@query("""SELECT row_id, CASE WHEN regexp_matches(raw_message, '%ASA-\\d-\\d+:') THEN 'Cisco' WHEN regexp_matches(raw_message, '\\blogid=\\d{10}\\b.*\\btype=\\w+.*\\bsubtype=\\w+', 's') THEN 'Fortinet'
 WHEN regexp_matches(raw_message, '^CEF:0\\|') THEN 'Haldenworks' WHEN regexp_matches(raw_message, '^LEEF:') THEN 'Norvane' END AS vendor FROM telemetry""")
def source_identity(spark: SparkSession, d: str) -> DataFrame:
    return P.parse_events(spread(table(spark, d, "telemetry").select("row_id", "raw_message")), CFG, columns=["vendor"]).select("row_id", "vendor")


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'plain_text' ELSE 'key_value' END AS parser, CASE WHEN event_id % 2 = 0 THEN 'PARSER_HINT:hint_used:plain_text' ELSE 'PARSER_HINT:hint_rejected_fallback:cef' END AS note,
 CASE WHEN event_id % 2 = 0 THEN 'one' ELSE 'two' END AS source FROM events""")
def hint_routing(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumnRenamed("event_id", "eid")
    e = e.withColumn("transport", F.when(F.col("eid") % 2 == 0, "udp").otherwise("tcp"))
    cfg = Config(reference_year=2025, sources=(Source("one", transport="udp", parser_hint="plain_text"), Source("two", transport="tcp", parser_hint="cef")))
    return _parsed(e, _c("a=", "$user_id", " b=", "$event_type"), cfg).select(F.col("eid").alias("event_id"), F.col("parser_name").alias("parser"), F.col("parse_notes")[0].alias("note"), F.col("source_name").alias("source"))


# ---- whole pipeline over the raw messages ----------------------------------------------------


#: Format of an event: what detection says of the envelope, or unknown where no parser but the last resort takes it.
_FORMAT_SQL = f"""CASE WHEN f IN ('cef', 'leef') AND regexp_matches(t, '^(?:<\\d{{1,3}}>)?[A-Z][a-z]{{2}} {{1,2}}\\d{{1,2}} \\d{{2}}:\\d{{2}}:\\d{{2}} \\S') THEN 'rfc3164' WHEN f IN ('cef', 'leef') AND regexp_matches(t, '^<\\d{{1,3}}>[1-9]\\d* \\S') THEN 'rfc5424'
 WHEN f = 'key_value' AND NOT regexp_matches(t, '\\blogid=\\d{{10}}\\b') AND len(list_filter(regexp_extract_all(t, '[A-Za-z][A-Za-z0-9_.\\-]*=(?:"[^"\\\\]*(?:\\\\[^\\n][^"\\\\]*)*"|[^\\s]*)|[^ ]+'), lambda x: regexp_matches(x, '^[A-Za-z][A-Za-z0-9_.-]*='))) < 2 THEN 'unknown'
 WHEN f = 'csv' AND contains(t, chr(10)) THEN 'unknown' WHEN f = 'plain_text' AND NOT regexp_matches(t, '%(ASA|PIX|FWSM|ASDM)-[0-7]-\\d{{5,6}}: ') THEN 'unknown' WHEN f = 'xml' THEN 'unknown' ELSE f END"""
_FORMATS = f"f AS (SELECT row_id, event_id, coalesce(raw_message, '') AS t, {_detect_sql('raw_message')} AS f FROM telemetry), formats AS (SELECT row_id, event_id, t, {_FORMAT_SQL} AS format FROM f)"


def _all_events(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Events of all messages: every column, or the asked ones."""
    t = table(spark, d, "telemetry").select("row_id", "ingested_at_unix_utc", "transport", "transport_protocol", "peer_ip", "peer_port", "source_name", "file_path", "file_line_number", "raw_message")
    return P.parse_events(spread(t), CFG, columns=columns or None)


@query()
def status_summary(spark: SparkSession, d: str) -> DataFrame:
    return _all_events(spark, d, "format_detected", "parser_name", "parse_status").groupBy("format_detected", "parser_name", "parse_status").agg(F.count("*").alias("n"))


@query("SELECT 'events_received' AS name, count(*) AS value FROM telemetry")
def metrics_received(spark: SparkSession, d: str) -> DataFrame:
    return P.metrics(_all_events(spark, d)).where("name = 'events_received'")


@query()
def metrics_counters(spark: SparkSession, d: str) -> DataFrame:
    return P.metrics(_all_events(spark, d))


@query("SELECT row_id, raw_message, strlen(raw_message) AS size FROM telemetry")
def lossless_raw(spark: SparkSession, d: str) -> DataFrame:
    """One event per message, the message itself untouched."""
    return _all_events(spark, d, "raw_message", "raw_size_bytes").select("row_id", "raw_message", F.col("raw_size_bytes").alias("size"))


@query("SELECT row_id FROM telemetry ORDER BY ingested_at_unix_utc DESC, row_id DESC LIMIT 100")
def recent_events(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "telemetry").select("row_id", "ingested_at_unix_utc", F.lpad(F.col("row_id").cast("string"), 20, "0").alias("event_id"))
    return P.recent(t, 100).select("row_id")


_VENDOR = """CASE WHEN regexp_matches(t, '%ASA-\\d-\\d+:') THEN 'Cisco' WHEN regexp_matches(t, '\\blogid=\\d{10}\\b.*\\btype=\\w+.*\\bsubtype=\\w+', 's') THEN 'Fortinet'
 WHEN regexp_matches(t, '^CEF:0\\|') THEN 'Haldenworks' WHEN regexp_matches(t, '^LEEF:') THEN 'Norvane' END"""


@query(f"WITH {_FORMATS} SELECT row_id, substr(event_id, 1, 8) AS id, format AS format_detected, {_VENDOR} AS vendor FROM formats")
def replay_summary(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "telemetry").select("row_id", "event_id", "raw_message")
    return P.parse_events(spread(t), CFG, columns=["event_id", "format_detected", "vendor"]).select("row_id", F.left("event_id", F.lit(8)).alias("id"), "format_detected", "vendor")


@query("SELECT count(*) AS n_events, count(*) AS n_ids, count(DISTINCT row_id) AS n_rows FROM telemetry")
def ids_unique(spark: SparkSession, d: str) -> DataFrame:
    """Messages without identifiers, many of them equal: as many identifiers as messages."""
    t = table(spark, d, "telemetry").select("row_id", "raw_message")
    e = P.parse_events(spread(t), CFG, columns=["event_id"])
    return e.groupBy("event_id").agg(F.count("*").alias("n"), F.count_distinct("row_id").alias("r")).agg(F.sum("n").alias("n_events"), F.count("*").alias("n_ids"), F.sum("r").alias("n_rows"))


@query(f"WITH {_FORMATS} SELECT 'events_received' AS name, count(*) AS value FROM formats UNION ALL SELECT 'events_unknown_format', count_if(format = 'unknown')::BIGINT FROM formats")
def metrics_formats(spark: SparkSession, d: str) -> DataFrame:
    return P.metrics(_all_events(spark, d)).where("name IN ('events_received', 'events_unknown_format')")


def _stream_of(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table's file, or folder of files, as a stream."""
    schema = table(spark, d, name).schema
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{d}/{name}.parquet")
    folder = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()
    source = spark.readStream.schema(schema)
    return source.parquet(f"{d}/{name}.parquet") if folder else source.option("pathGlobFilter", f"{name}.parquet").parquet(d)


@query(f"WITH {_FORMATS} SELECT event_id, format, t AS raw, count(*) AS n FROM formats GROUP BY ALL")
def stream_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """The whole pipeline as a stream: messages in, events parsed, spooled as JSON lines, and read back."""
    from millrace.session import new_path
    from millrace.streaming import jobs

    messages = _stream_of(spark, d, "telemetry").select("event_id", "ingested_at_unix_utc", F.coalesce("raw_message", F.lit("")).alias("raw_message"))
    out = new_path(spark, "spool")
    jobs.run(messages, CFG, out, new_path(spark, "spool-checkpoint"), once=True).awaitTermination()
    doc = F.col("value")
    back = spark.read.text(out).select(F.get_json_object(doc, "$.ingestion.event_id").alias("event_id"), F.get_json_object(doc, "$.parser.format_detected").alias("format"), F.get_json_object(doc, "$.raw.raw_message").alias("raw"))
    return back.groupBy("event_id", "format", "raw").agg(F.count("*").alias("n"))


# ---- sinks -----------------------------------------------------------------------------------


@query("SELECT event_id, 'LEEF:1.0|UnknownVendor|key_value|1.0|key_value' || chr(9) || 'sev=5' || chr(9) || 'src=10.0.0.1' || chr(9) || 'raw=src=10.0.0.1 my-key=' || event_type || chr(9) || 'u_kv.my-key=' || event_type AS line FROM events")
def serialize_leef(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumnRenamed("event_id", "eid")
    needs = ("vendor", "product", "parser_name", "normalized", "unknown_fields", "vendor_fields", "protocol_metadata", "raw_message")
    return _parsed(e, _c("src=10.0.0.1 my-key=", "$event_type"), columns=needs).select(F.col("eid").alias("event_id"), serialize.leef().alias("line"))


@query("SELECT event_id, '<134>Oct  9 08:53:20 h' || user_id || ' millrace: {' AS head, event_type AS message FROM events")
def serialize_syslog(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumnRenamed("event_id", "eid")
    line = serialize.syslog_json()
    out = _parsed(e, _c("<13>1 - h", "$user_id", " a p m - ", "$event_type")).select(F.col("eid").alias("event_id"), line.alias("l"))
    return out.select("event_id", F.concat(F.substring_index("l", ": {", 1), F.lit(": {")).alias("head"), F.get_json_object(F.concat(F.lit("{"), F.substring("l", F.instr("l", ": {") + 3, F.length("l"))), "$.normalized.message").alias("message"))


@query("SELECT event_id, event_type AS raw, 'PENDING' AS delivery FROM events")
def spool_lines(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumnRenamed("event_id", "eid")
    j = F.col("j")
    return _parsed(e, F.col("event_type")).select(F.col("eid").alias("event_id"), serialize.spool_json().alias("j")).select("event_id", F.get_json_object(j, "$.raw.raw_message").alias("raw"), F.get_json_object(j, "$.delivery.status").alias("delivery"))


@query("""SELECT row_id, 'millrace-' || strftime(make_timestamp((CASE WHEN ingested_at_unix_utc < 1e11 THEN floor(ingested_at_unix_utc * 1e6) WHEN ingested_at_unix_utc < 1e14 THEN floor(ingested_at_unix_utc * 1e3)
 WHEN ingested_at_unix_utc < 1e17 THEN floor(ingested_at_unix_utc) ELSE floor(ingested_at_unix_utc / 1e3) END)::BIGINT), '%Y.%m.%d') AS index FROM telemetry""")
def elastic_index(spark: SparkSession, d: str) -> DataFrame:
    """The index of every row, whatever the unit of its ingestion time."""
    return table(spark, d, "telemetry").select("row_id", serialize.index_name("millrace").alias("index"))


@query("SELECT event_id, 'millrace-2025.10.09' AS index, event_type AS raw, 'a' || user_id AS who FROM events")
def elastic_bulk(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumnRenamed("event_id", "eid").withColumn("raw_message", _c("user=a", "$user_id", " kind=", "$event_type"))
    out = P.parse_events(e, CFG, at=1_760_000_000.0).select(F.col("eid").alias("event_id"), F.split(serialize.bulk_lines(), "\n").alias("l"))
    v = F.parse_json(F.col("l")[1])
    return out.select(
        "event_id", F.get_json_object(F.col("l")[0], "$.index._index").alias("index"),
        F.regexp_extract(F.try_variant_get(v, "$['raw.raw_message']", "string"), "kind=(.*)$", 1).alias("raw"), F.try_variant_get(v, "$['normalized.source.user.name']", "string").alias("who"),
    )


@query("""SELECT batch_id, CASE WHEN http_status <> 200 THEN 'ELASTIC_HTTP:' || http_status WHEN NOT json_valid(body) THEN 'ELASTIC_BAD_RESPONSE' END AS error, n_events AS n FROM bulk_response""")
def bulk_outcome(spark: SparkSession, d: str) -> DataFrame:
    o = serialize.bulk_outcome(table(spark, d, "bulk_response").select("batch_id", "http_status", "body", "n_events"))
    return o.groupBy("batch_id", "error").agg(F.count("*").cast("int").alias("n"))


@query("""WITH p AS (SELECT row_id, batch_id, row_number() OVER (PARTITION BY batch_id ORDER BY row_id) - 1 AS pos FROM telemetry)
 SELECT row_id FROM p ANTI JOIN (SELECT batch_id, unnest(delivered) AS pos FROM bulk_response) d ON p.batch_id = d.batch_id AND p.pos = d.pos""")
def delivery_pending(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a batch that the target did not take: what a retry sends again. A batch is bounded by the batch limit."""
    from pyspark.sql.window import Window as W

    rows = table(spark, d, "telemetry").select("row_id", "batch_id").withColumn("pos", F.row_number().over(W.partitionBy("batch_id").orderBy("row_id")) - 1)
    done = table(spark, d, "bulk_response").select("batch_id", F.explode("delivered").alias("pos"))
    return rows.join(done, ["batch_id", "pos"], "left_anti").select("row_id")


# ---- bytes -----------------------------------------------------------------------------------


@query("SELECT doc_id, text, NULL::VARCHAR AS note FROM documents WHERE text IS NOT NULL")
def decode_utf8(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.encode("text", "UTF-8").alias("data"))
    return framing.decoded(docs).select("doc_id", F.col("raw_message").alias("text"), F.col("decode_note").alias("note"))


@query("SELECT event_id, 'ü' || event_type AS text, 'DECODE:invalid utf-8; latin-1 lossless byte mapping used' AS note FROM events")
def decode_latin1(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", F.concat(F.unhex(F.lit("FC")), F.encode("event_type", "UTF-8")).alias("data"))
    return framing.decoded(e).select("event_id", F.col("raw_message").alias("text"), F.col("decode_note").alias("note"))


@query("SELECT doc_id::VARCHAR AS connection, i::BIGINT AS seq, CASE WHEN i = 0 THEN text ELSE 'end' END AS text FROM documents, (SELECT unnest([0, 1]) AS i) WHERE text <> ''")
def frame_octet(spark: SparkSession, d: str) -> DataFrame:
    """Every text as a counted frame, whatever its length; a frame of no octets is none."""
    docs = table(spark, d, "documents").where("text <> ''")
    blob = F.encode(F.concat(F.octet_length("text").cast("string"), F.lit(" "), F.col("text"), F.lit("3 end")), "UTF-8")
    f = framing.framed_blobs(docs.select(F.col("doc_id").cast("string").alias("connection"), blob.alias("data")), limit=1 << 31)
    return f.select("connection", "seq", F.decode("frame", "UTF-8").alias("text"))


@query("""WITH p AS (SELECT batch_id, row_id, string_split(raw_message || chr(13) || chr(10), chr(10)) AS parts FROM telemetry WHERE raw_message IS NOT NULL),
 l AS (SELECT batch_id, row_id, unnest(generate_series(1, len(parts) - 1)) AS i, parts FROM p)
 SELECT batch_id::VARCHAR AS connection, row_number() OVER (PARTITION BY batch_id ORDER BY row_id, i) - 1 AS seq, CASE WHEN ends_with(parts[i], chr(13)) THEN left(parts[i], len(parts[i]) - 1) ELSE parts[i] END AS text FROM l""")
def frame_newline(spark: SparkSession, d: str) -> DataFrame:
    """A batch's messages as one connection, cut into chunks that split messages anywhere."""
    t = table(spark, d, "telemetry").where("raw_message IS NOT NULL")
    parts = F.array(F.encode(F.left("raw_message", F.lit(7)), "UTF-8"), F.encode(F.concat(F.substring("raw_message", F.lit(8), F.length("raw_message")), F.lit("\r\n")), "UTF-8"))
    chunks = t.select(F.col("batch_id").cast("string").alias("connection"), "row_id", F.posexplode(parts).alias("i", "data")).withColumn("seq", F.col("row_id") * 2 + F.col("i"))
    return framing.frames(chunks.select("connection", "seq", "data")).select("connection", "seq", F.decode("frame", "UTF-8").alias("text"))


@query("SELECT event_id, event_type = 'x' OR length(event_type) > 5 AS too_long FROM events WHERE length(event_type) <= 5")
def frame_datagram(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("data", F.encode("event_type", "UTF-8"))
    return framing.datagrams(e, 5).select("event_id", (F.octet_length("data") > 5).alias("too_long"))


# ---- scalar functions ------------------------------------------------------------------------


@query("""SELECT l_orderkey, l_linenumber, (l_linenumber * 3600 + 62)::BIGINT AS seconds, (l_partkey % 256) // 8 AS facility, (l_partkey % 256) % 8 AS severity, 'a_b.' || l_linenumber AS safe FROM lineitem""")
def scalar_functions(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem")
    facility, severity = X.pri_parts(F.col("l_partkey") % 256)
    return x.select(
        "l_orderkey", "l_linenumber", X.duration_seconds(_c("$l_linenumber", ":01:02")).alias("seconds"), facility.alias("facility"), severity.alias("severity"),
        X.leef_key(_c("a b.", "$l_linenumber")).alias("safe"),
    )


@query("SELECT row_id, coalesce(try_cast(peer_ip AS VARCHAR), '') <> '' AND regexp_full_match(peer_ip, '(25[0-5]|2[0-4]\\d|1\\d\\d|[1-9]?\\d)(\\.(25[0-5]|2[0-4]\\d|1\\d\\d|[1-9]?\\d)){3}') AS ok FROM telemetry WHERE peer_ip IS NOT NULL")
def ipv4_check(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "telemetry").where("peer_ip IS NOT NULL").select("row_id", F.col("peer_ip").rlike(checks.IPV4).alias("ok"))


# ---- resolution, evidence, delivery, streams ---------------------------------------------------


@query("SELECT event_id, 'rfc3164+cef' AS parser, 'PARTIAL' AS status, true AS told, event_type AS kept FROM events")
def chain_partial(spark: SparkSession, d: str) -> DataFrame:
    """The envelope is parsed, what is in it is not: nothing of the envelope is lost."""
    e = table(spark, d, "events").withColumnRenamed("event_id", "eid")
    out = _parsed(e, _c("<13>Oct  1 10:00:00 ", "$event_type", " CEF:0|A|B|short"))
    return out.select(F.col("eid").alias("event_id"), F.col("parser_name").alias("parser"), F.col("parse_status").alias("status"), F.array_contains("parse_notes", "CHAIN_PARTIAL:envelope parsed, inner failed").alias("told"), F.col("hostname").alias("kept"))


@query("SELECT event_id, 'plain_text' AS parser, 'UNKNOWN_FORMAT' AS status, 'unknown' AS format, '<note>' || event_type || '</note>' AS message FROM events")
def fallback_unknown(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumnRenamed("event_id", "eid")
    out = _parsed(e, _c("<note>", "$event_type", "</note>"))
    return out.select(F.col("eid").alias("event_id"), F.col("parser_name").alias("parser"), F.col("parse_status").alias("status"), F.col("format_detected").alias("format"), _s("normalized", "message").alias("message"))


@query("""SELECT event_id, event_id % 3 AS kind, CASE event_id % 3 WHEN 0 THEN 'INVALID' ELSE 'VALID' END AS status, CASE event_id % 3 WHEN 0 THEN 'raw_message missing' END AS problem FROM events""")
def raw_missing(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumnRenamed("event_id", "eid").withColumn("kind", F.col("eid") % 3)
    raw = F.when(F.col("kind") == 1, F.col("event_type")).when(F.col("kind") == 2, " ").otherwise("")
    return _parsed(e, raw).select(F.col("eid").alias("event_id"), "kind", F.col("validation_status").alias("status"), F.get("validation_problems", F.lit(0))["problem"].alias("problem"))


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'SD_OMITTED:deviation tolerated; text kept as message' WHEN 1 THEN 'SD_UNBALANCED:preserved as structured-data text' WHEN 3 THEN 'SD_UNPARSED:n' END AS note,
 CASE event_id % 5 WHEN 0 THEN 'text ' || event_type WHEN 2 THEN event_type WHEN 3 THEN 'm' END AS message FROM events""")
def rfc5424_deviations(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumnRenamed("event_id", "eid")
    kind = F.col("eid") % 5
    tail = (
        F.when(kind == 0, _c(" text ", "$event_type")).when(kind == 1, _c(' [open a="', "$event_type", '"')).when(kind == 2, _c(" - ", "$event_type"))
        .when(kind == 3, _c(' [n a="[', "$event_type", ']"] m')).otherwise(_c(' [a x="1"][b y="2"] ', "$event_type"))
    )
    note = F.get(F.filter("parse_notes", lambda n: n.startswith("SD_")), F.lit(0))
    return _parsed(e, F.concat(F.lit("<13>1 - h a p m"), tail)).select(F.col("eid").alias("event_id"), note.alias("note"), _s("normalized", "message").alias("message"))


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'INFERRED' WHEN 1 THEN 'UNKNOWN' ELSE 'INFERRED' END AS status,
 CASE event_id % 3 WHEN 0 THEN 'signature=sig_cisco_asa' WHEN 1 THEN 'rfc5424.appname=' || event_type ELSE 'cef_header=Acme|' || event_type END AS evidence FROM events""")
def source_evidence(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumnRenamed("event_id", "eid")
    kind = F.col("eid") % 3
    raw = F.when(kind == 0, _c("%ASA-6-110001: ", "$event_type")).when(kind == 1, _c("<13>1 - h ", "$event_type", " p m - x")).otherwise(_c("CEF:0|Acme|", "$event_type", "|1|2|n|3|act=x"))
    first = F.get("source_evidence", F.lit(0))
    return _parsed(e, raw).select(F.col("eid").alias("event_id"), F.col("source_status").alias("status"), F.concat_ws("=", first[0], first[1]).alias("evidence"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN least(user_id, 10) WHEN 1 THEN (user_id % 192) % 8 ELSE 5 END AS severity FROM events")
def leef_severity(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumnRenamed("event_id", "eid")
    kind = F.col("eid") % 3
    raw = F.when(kind == 0, _c("CEF:0|A|B|1|2|n|", "$user_id", "|act=x")).when(kind == 1, _c("<", F.col("user_id") % 192, ">1 - h a p m - x")).otherwise(F.col("event_type"))
    return _parsed(e, raw).select(F.col("eid").alias("event_id"), serialize.severity().alias("severity"))


@query("""SELECT event_id, CASE WHEN event_type = 'error' THEN 'FAILED' ELSE 'DELIVERED' END AS status, CASE WHEN event_type = 'error' THEN 'REFUSED:error' END AS error,
 CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS attempts FROM events""")
def deliver_statuses(spark: SparkSession, d: str) -> DataFrame:
    """Delivery to a target that refuses some events: retried, then reported."""
    from millrace.sources import sinks

    def send(lines: list[str]) -> list[str | None]:
        return ["REFUSED:error" if x == "error" else None for x in lines]

    e = table(spark, d, "events").select(F.col("event_id").cast("string").alias("event_id"), "event_type")
    out = sinks.deliver(spread(e), sinks.Target("test:local", lambda: F.col("event_type"), send), Limits(max_delivery_retries=1, retry_backoff_seconds=0.0))
    return out.select(F.col("event_id").cast("bigint").alias("event_id"), F.col("delivery_status").alias("status"), F.col("delivery_error").alias("error"), F.col("delivery_attempts").alias("attempts"))


@query("SELECT row_id FROM telemetry WHERE row_id = 7")
def event_lookup(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "telemetry").select("row_id", F.col("row_id").cast("string").alias("event_id"))
    return P.event_by_id(t, "7").select("row_id")


@query("""WITH t AS (SELECT event_type AS source_name, epoch_us(ts) AS ev, epoch_us(ts) + (event_id % 4) * 7200000000 AS ing FROM events),
 k AS (SELECT source_name, ev // 3600000000 * 3600000000 AS hour_us, ing - (ev // 3600000000 + 1) * 3600000000 AS late FROM t)
 SELECT source_name, hour_us, CASE WHEN late <= 600000000 THEN 'on_time' WHEN late <= 21600000000 THEN 'late' ELSE 'expired' END AS kind, count(*) AS n FROM k GROUP BY ALL""")
def stream_hourly_counts(spark: SparkSession, d: str) -> DataFrame:
    """A streaming query over the events table: counts per source and hour with their corrections."""
    from millrace.session import new_path
    from millrace.streaming import jobs

    e = _stream_of(spark, d, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    times = e.select(F.col("event_type").alias("source_name"), us.alias("event_us"), (us + (F.col("event_id") % 4) * 7_200_000_000).alias("ingest_us"))
    out = new_path(spark, "hourly")
    jobs.hourly_counts(times, out, new_path(spark, "hourly-checkpoint")).awaitTermination()
    return spark.read.parquet(out).groupBy("source_name", "hour_us", "kind").agg(F.sum("n").alias("n"))


#: Which entries of the operator inventory each query shows.
COVERS = {
    "DET0-DET9": ["detect_documents", "detect_telemetry", "detect_file_lines", "detect_props"], "DET10, RES1-RES2": ["status_summary", "chain_rfc3164_cef"],
    "RES3, SID5": ["hint_routing"], "RES4-RES6": ["chain_rfc3164_cef", "chain_rfc5424_json", "chain_partial", "parse_asa_connections"], "RES7": ["fallback_unknown"], "RES10": ["cef_short_header"],
    "PAR1, FN1, FN11": ["parse_rfc5424", "rfc5424_pri", "rfc5424_sd", "rfc5424_ts_utc", "rfc5424_deviations"], "PAR2": ["parse_rfc3164"],
    "PAR3, FN2-FN4": ["parse_cef_events", "cef_severity", "cef_escapes", "cef_invalid_port", "cef_short_header"], "PAR4, FN7": ["parse_leef_tab", "leef_custom_delim", "leef_space_deviation"],
    "PAR5, FN5-FN6": ["parse_kv_events", "kv_duplicate_keys", "kv_unpaired"], "PAR6": ["parse_fortigate", "fortigate_eventtime"], "PAR7, FN12": ["parse_asa_connections", "asa_partial", "scalar_functions"],
    "PAR8, FN8-FN9": ["parse_json_props", "json_duplicates"], "PAR9": ["parse_csv_noschema", "csv_schema", "csv_delimiter"], "PAR10": ["plain_stats"],
    "NRM1-NRM2, FN10": ["validate_ip", "validate_port", "validate_timestamp", "ipv4_check"], "LIM1-LIM2": ["field_limits", "field_count"], "VAL1": ["raw_missing"],
    "SID1": ["source_configured"], "SID2-SID4": ["source_identity", "source_evidence"], "SNK1": ["spool_lines"], "SNK2": ["serialize_syslog"], "SNK3, SNK5, FN13": ["serialize_leef", "leef_severity"],
    "SNK4, FN14": ["elastic_index", "elastic_bulk", "bulk_outcome"], "DLV1-DLV5": ["deliver_statuses", "delivery_pending"], "MET1": ["metrics_counters", "metrics_received", "metrics_formats"],
    "INS1-INS2": ["recent_events", "event_lookup"], "CLI2": ["replay_summary"], "SRC8, FN16": ["lossless_raw", "ids_unique", "replay_summary"], "FRM1-FRM3": ["frame_octet", "frame_newline"], "FRM5": ["frame_datagram"],
    "DEC1": ["decode_utf8", "decode_latin1"], "RT1": ["stream_pipeline", "stream_hourly_counts"],
}
