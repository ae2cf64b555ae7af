"""The queries of the general problems, each over its whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.ids import event_hex, event_key, ingest_us
from millrace.operators import dedup, drift, late, loglines, nested, skew, timestamps
from millrace.session import stored, table

SHARE = 0.04


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.changes(table(spark, d, "spool_files"), table(spark, d, "spool_rows"))


def p1_typed(spark: SparkSession, d: str) -> DataFrame:
    """One consistent table of all rows: a typed cell per row and field, or the value as rescued JSON."""
    return drift.typed(table(spark, d, "spool_files"), table(spark, d, "spool_rows"), ["spool_row_id"])


def p1_accounted(spark: SparkSession, d: str) -> DataFrame:
    """Per layer: members of all objects, and how many are null, in a typed column, or rescued."""
    t = p1_typed(spark, d)
    held = F.coalesce(*[F.col(c).cast("string") for c in drift.AS]).isNotNull()
    one = t.groupBy("layer").agg(F.count("*").alias("n_members"), F.count_if(~held & F.col("rescued").isNull()).alias("n_null"), F.count_if(held | F.col("rescued").isNotNull()).alias("n_kept"), F.count_if(held & F.col("rescued").isNotNull()).alias("n_twice"))
    return one


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    e = loglines.entries(table(spark, d, "file_lines"))
    return e.select("file_path", "first_line", "entry_ts", "level", "component", F.md5(F.col("message").cast("binary")).alias("message_md5"))


def _pressure(spark: SparkSession, d: str) -> tuple[DataFrame, int]:
    t = table(spark, d, "telemetry")
    rows = t.select("peer_ip", "source_name", F.coalesce(event_key(F.col("event_id")), F.encode("event_id", "UTF-8")).alias("event"), ingest_us(F.col("ingested_at_unix_utc")).alias("ingest_us"))
    return skew.compress(rows, ["peer_ip", "source_name"], "event", "ingest_us"), t.count()


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    compressed, total = _pressure(spark, d)
    return skew.heavy(skew.per_key(compressed), total, SHARE).select("field", "key_value")


def p3_keys(spark: SparkSession, d: str) -> DataFrame:
    compressed, _ = _pressure(spark, d)
    k = skew.per_key(compressed)
    return k.select("field", "key_value", "n_rows", F.col("n_values").alias("n_events"), F.col("last").alias("last_ingest_us"))


def p3_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Exact mode and quartiles of the message size of every key, from weighted values."""
    c = skew.compress(table(spark, d, "telemetry").select("peer_ip", "source_name", "raw_size_bytes"), ["peer_ip", "source_name"], "raw_size_bytes")
    at = skew.percentiles(c, [0.25, 0.5, 0.75])
    m = skew.modes(c)
    same = (at["field"] == m["field"]) & at["key_value"].eqNullSafe(m["key_value"])
    q = lambda i: F.element_at(F.col("percentiles"), i + 1)
    return at.join(m, same).select(at["field"], at["key_value"], "mode", "mode_rows", q(0).alias("q1"), q(1).alias("q2"), q(2).alias("q3"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    n = nested.nodes(table(spark, d, "telemetry"))
    return n.select(event_hex(F.col("event_key")).alias("event_id"), "field", "node", "parent")


def p4_tables(spark: SparkSession, d: str) -> DataFrame:
    """The rows of the flat tables: each root and element with its table, its foreign key and its inlined members."""
    n = nested.rows(table(spark, d, "telemetry"))
    return n.select(event_hex(F.col("event_key")).alias("event_id"), "field", "table", "node", "parent", "attrs")


def _times(spark: SparkSession, d: str) -> DataFrame:
    return timestamps.event_times(table(spark, d, "telemetry"), table(spark, d, "sources"))


BOUND_S, CUTOFF_S, IDLE_S = 600, 21_600, 3600


def _clock(spark: SparkSession, d: str) -> DataFrame:
    """Every delivery moves its source's clock."""
    return table(spark, d, "telemetry").select("source_name", ingest_us(F.col("ingested_at_unix_utc")).alias("ingest_us"))


def _classified(spark: SparkSession, d: str) -> DataFrame:
    times = stored(_times(spark, d).select("event_key", "source_name", "event_us", "ingest_us"), "times")
    return late.classify(times, _clock(spark, d), BOUND_S, CUTOFF_S, IDLE_S)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    c = _classified(spark, d)
    return c.where("kind != 'on_time'").select(event_hex(F.col("event_key")).alias("event_id"), "kind")


def p5_hours(spark: SparkSession, d: str) -> DataFrame:
    return late.hourly(_classified(spark, d))


def p5_watermarks(spark: SparkSession, d: str) -> DataFrame:
    """When each live source passed each hour, by a record or its idle timeout."""
    clock = _clock(spark, d)
    return late.punctuations(clock, late.live_hours(clock, BOUND_S, IDLE_S), [BOUND_S], IDLE_S)


def p5_closings(spark: SparkSession, d: str) -> DataFrame:
    """When each hour closed, and how many of its live sources were punctuated by their timeout."""
    return late.closings(_clock(spark, d), BOUND_S, IDLE_S)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return dedup.repeats(table(spark, d, "telemetry")).select(event_hex(F.col("event_key")).alias("event_id"), "row_id")


def p6_kept(spark: SparkSession, d: str) -> DataFrame:
    """The one row of each event."""
    store = dedup.BucketStore(spark)
    store.upsert(dedup.copies(table(spark, d, "telemetry")))
    return store.compact().select(event_hex(F.col("event_key")).alias("event_id"), "row_id")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _times(spark, d).select(event_hex(F.col("event_key")).alias("event_id"), "event_us")


def p7_ambiguity(spark: SparkSession, d: str) -> DataFrame:
    """Per source and layout: events, events with several readings, unclear ones, those where the likeliest reading isn't the chosen one, and those of several readings where the rule left the choice to the posterior."""
    t = _times(spark, d)
    return t.groupBy("source", "layout").agg(
        F.count("*").alias("n_events"), F.count_if(F.col("n_readings") > 1).alias("n_several"), F.count_if(~F.col("clear")).alias("n_unclear"),
        F.count_if(F.col("likeliest_us") != F.col("event_us")).alias("n_other"), F.count_if(~F.col("by_rule") & (F.col("n_readings") > 1)).alias("n_by_posterior"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (p1_found, p1_typed, p1_accounted, p2_found, p3_found, p3_keys, p3_sizes, p4_found, p4_tables, p5_found, p5_hours, p5_watermarks, p5_closings, p6_found, p6_kept, p7_found, p7_ambiguity)
}

_KEY = "regexp_replace(regexp_replace(lower(event_id), '^[\\s{(]*(urn:)?(uuid:)?', ''), '[\\s{}()-]', '', 'g')"
_US = """CASE WHEN ingested_at_unix_utc IS NULL OR ingested_at_unix_utc <= 0 THEN NULL
 WHEN ingested_at_unix_utc < 1e11 THEN round(ingested_at_unix_utc * 1e6) WHEN ingested_at_unix_utc < 1e14 THEN round(ingested_at_unix_utc * 1e3)
 WHEN ingested_at_unix_utc < 1e17 THEN round(ingested_at_unix_utc) ELSE round(ingested_at_unix_utc / 1e3) END::BIGINT"""
_PAIRS = f"""pairs AS (SELECT 'peer_ip' AS field, peer_ip AS key_value, {_KEY} AS k, {_US} AS us, raw_size_bytes AS size FROM telemetry
 UNION ALL SELECT 'source_name', source_name, {_KEY}, {_US}, raw_size_bytes FROM telemetry)"""
_RANKED = f"""ranked AS (SELECT {_KEY} AS event_id, row_id, row_number() OVER (PARTITION BY {_KEY} ORDER BY {_US} NULLS LAST, row_id) AS rn
 FROM telemetry WHERE regexp_full_match({_KEY}, '[0-9a-f]{{32}}'))"""

_PASSED = f"""t AS (SELECT coalesce(source_name, chr(1)) AS s, {_US} AS us FROM telemetry WHERE {_US} IS NOT NULL), span AS (SELECT s, min(us) AS lo, max(us) AS hi FROM t GROUP BY s),
 h AS (SELECT s, unnest(generate_series((lo - 600000000 + 3599999999) // 3600000000 - 1, (hi + 3000000000) // 3600000000 - 1)) * 3600000000 AS hour_us FROM span),
 passed AS (SELECT h.s, hour_us, least(t.us, hour_us + 7800000000) AS passed_us FROM h ASOF LEFT JOIN t ON h.s = t.s AND hour_us + 4200000000 < t.us)"""


def _untext(j: str) -> str:
    inner = f"try_cast({j}->>'$' AS JSON)"
    return f"CASE WHEN json_type({j}) = 'VARCHAR' AND regexp_matches({j}->>'$', '^[\\[{{ \\n\\t]') AND json_type({inner}) IN ('OBJECT', 'ARRAY') THEN {inner} ELSE {j} END"


_MEMBERS = "map_entries(from_json(j, '\"MAP(VARCHAR, JSON)\"'))"
_STEP = "'/' || replace(replace(x.key, '~', '~0'), '/', '~1')"
#: The schema graph by one recursion over all rows, the nodes by another over the first copies.
_NODES = f"""WITH RECURSIVE t AS (SELECT row_id, {_KEY} AS k, {_US} AS us, vendor_fields, validation_problems FROM telemetry),
 docs AS (SELECT row_id, 'vendor_fields' AS field, try_cast(vendor_fields AS JSON) AS j FROM t WHERE vendor_fields IS NOT NULL
  UNION ALL SELECT row_id, 'validation_problems', to_json(list_transform(validation_problems, lambda x: CASE WHEN x IS NULL THEN NULL ELSE {{'value': coalesce(try_cast(x.value AS JSON), to_json(x.value))}} END)) FROM t WHERE len(validation_problems) > 0),
 shape AS (SELECT row_id, field, '' AS path, false AS element, {_untext("j")} AS j FROM docs
  UNION ALL SELECT row_id, field, path || e.step, e.element, {_untext("e.v")} FROM (SELECT row_id, field, path, unnest(CASE json_type(j)
   WHEN 'OBJECT' THEN list_transform({_MEMBERS}, lambda x: {{'step': {_STEP}, 'element': false, 'v': x.value}})
   WHEN 'ARRAY' THEN list_transform(from_json(j, '["JSON"]'), lambda x: {{'step': '', 'element': true, 'v': x}}) END) AS e FROM shape WHERE json_type(j) IN ('OBJECT', 'ARRAY'))),
 odd AS (SELECT field, path FROM shape WHERE json_type(j) = 'ARRAY' OR (json_type(j) = 'OBJECT' AND NOT element) GROUP BY ALL HAVING count(DISTINCT json_type(j)) = 2),
 firsts AS (SELECT k, row_id FROM t WHERE regexp_full_match(k, '[0-9a-f]{{32}}') QUALIFY row_number() OVER (PARTITION BY k ORDER BY us NULLS LAST, row_id) = 1),
 walk AS (SELECT k, field, '' AS path, '' AS node, '' AS parent, false AS element, {_untext("j")} AS j FROM docs JOIN firsts USING (row_id)
  UNION ALL SELECT k, field, path || e.step, node || e.at, CASE WHEN is_node THEN node ELSE parent END, e.element, {_untext("e.v")} FROM (SELECT w.k, w.field, w.path, w.node, w.parent, w.element AND json_type(j) = 'OBJECT' AS is_node, unnest(CASE
   WHEN json_type(j) = 'OBJECT' AND NOT element AND o.path IS NOT NULL THEN [{{'step': '', 'at': '/0', 'element': true, 'v': j}}]
   WHEN json_type(j) = 'OBJECT' THEN list_transform({_MEMBERS}, lambda x: {{'step': {_STEP}, 'at': {_STEP}, 'element': false, 'v': x.value}})
   WHEN json_type(j) = 'ARRAY' THEN list_transform(from_json(j, '["JSON"]'), lambda x, i: {{'step': '', 'at': '/' || (i - 1), 'element': true, 'v': x}}) END) AS e
   FROM walk w LEFT JOIN odd o ON o.field = w.field AND o.path = w.path WHERE json_type(j) IN ('OBJECT', 'ARRAY')))
 SELECT k AS event_id, field, node, parent FROM walk WHERE element AND json_type(j) = 'OBJECT'"""

_CHANGES = """WITH files AS (SELECT file_id, stream_id, row_number() OVER (PARTITION BY stream_id ORDER BY opened_at, file_id) AS ord FROM spool_files),
 l AS (SELECT file_id, 'vendor_fields' AS layer, try_cast(vendor_fields AS JSON) AS j FROM spool_rows UNION ALL SELECT file_id, 'unknown_fields', try_cast(unknown_fields AS JSON) FROM spool_rows),
 m AS (SELECT file_id, layer, unnest(map_entries(from_json(j, '"MAP(VARCHAR, JSON)"'))) AS e FROM l WHERE json_type(j) = 'OBJECT'),
 c AS (SELECT stream_id, ord, layer, e.key AS field, e.value::VARCHAR AS v, CASE json_type(e.value) WHEN 'VARCHAR' THEN 1 WHEN 'BOOLEAN' THEN 4 WHEN 'ARRAY' THEN 5 WHEN 'OBJECT' THEN 6 WHEN 'DOUBLE' THEN 3 WHEN 'NULL' THEN NULL ELSE 2 END AS kind FROM m JOIN files USING (file_id)),
 k AS (SELECT stream_id, ord, layer, field, kind, count(*) AS n FROM c GROUP BY ALL),
 t AS (SELECT stream_id, ord, layer, field, coalesce(arg_max(kind, n * 10 - kind) FILTER (kind IS NOT NULL), 0) AS kind FROM k GROUP BY ALL),
 d AS (SELECT coalesce(a.stream_id, b.stream_id) AS stream_id, coalesce(a.ord, b.ord + 1) AS ord, coalesce(a.layer, b.layer) AS layer, coalesce(a.field, b.field) AS field,
   CASE WHEN b.field IS NULL THEN 'added' WHEN a.field IS NULL THEN 'removed' WHEN a.kind <> b.kind AND a.kind > 0 AND b.kind > 0 THEN 'retyped' END AS change
  FROM t a FULL JOIN t b ON a.stream_id = b.stream_id AND a.ord = b.ord + 1 AND a.layer = b.layer AND a.field = b.field),
 changed AS (SELECT file_id, d.* FROM d JOIN files USING (stream_id, ord) WHERE change IS NOT NULL AND ord > 1),
 new AS (SELECT x.file_id, x.stream_id, x.ord, x.layer, x.field, v, count(*) AS n FROM changed x JOIN c USING (stream_id, ord, layer, field) WHERE change = 'added' AND kind IS NOT NULL GROUP BY ALL),
 lost AS (SELECT DISTINCT x.stream_id, x.ord, x.layer, x.field AS old_field, v FROM changed x JOIN c ON c.stream_id = x.stream_id AND c.ord = x.ord - 1 AND c.layer = x.layer AND c.field = x.field WHERE change = 'removed' AND kind IS NOT NULL),
 same AS (SELECT file_id, stream_id, ord, layer, field, old_field, sum(n) AS same FROM new JOIN lost USING (stream_id, ord, layer, v) GROUP BY ALL),
 total AS (SELECT stream_id, ord, layer, field, sum(n) AS total FROM new GROUP BY ALL),
 pairs AS (SELECT *, same / total AS share FROM same JOIN total USING (stream_id, ord, layer, field) WHERE same * 2 > total),
 best AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY stream_id, ord, layer, field ORDER BY share DESC, same DESC, old_field) = 1),
 renamed AS (SELECT * FROM best QUALIFY row_number() OVER (PARTITION BY stream_id, ord, layer, old_field ORDER BY share DESC, same DESC, field) = 1)
 SELECT file_id, layer, 'renamed' AS change, field, old_field FROM renamed UNION ALL SELECT file_id, layer, change, field, '' FROM changed x
 WHERE NOT EXISTS (FROM renamed r WHERE r.stream_id = x.stream_id AND r.ord = x.ord AND r.layer = x.layer AND ((change = 'added' AND r.field = x.field) OR (change = 'removed' AND r.old_field = x.field)))"""


def _entries_sql() -> str:
    """The entries of file_lines: one CASE over the layouts' expressions, a running maximum, one concatenation."""
    words = "emergency|informational|information|critical|warning|verbose|notice|severe|emerg|panic|alert|fatal|error|debug|trace|crit|warn|info|err"
    iso, hms = r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?(?:Z|[+-]\d{2}:?\d{2})?", r"\d{2}:\d{2}:\d{2}"
    data = r'(?:-|(?:\[[^\s=\]"]+(?: [^\s=\]"]+="(?:[^"\\\]]|\\.)*")*\])+)'
    # expression, and what its groups are: priority, time, level, component, message
    layouts = [
        (rf"^<(\d{{1,3}})>\d{{1,2}} ({iso}) \S+ (\S+) \S+ \S+ {data}(?: (.*))?$", "ptcm"),
        (rf"^(?:<(\d{{1,3}})>)?((?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) [ \d]\d {hms}) \S+ ([^\s:\[\]]+)(?:\[\d+\])?: ?(.*)$", "ptcm"),
        (rf"^({iso}) +({words}) +\[[^\]]*\] (\S+) +- ?(.*)$", "tlcm"),
        (rf"^\[({iso})\] ([^\s/\]]+)[./]({words}): ?(.*)$", "tclm"),
        (rf"^(\d{{1,2}}/\d{{1,2}}/\d{{4}} \d{{1,2}}:\d{{2}}:\d{{2}}(?: [AP]M)?);({words});([^;]*);(.*)$", "tlcm"),
        (rf"^([IWEFDV])(\d{{4}} {hms}(?:\.\d+)?) +\d+ ([^\s:\]]+):\d+\] ?(.*)$", "Ltcm"),
        (rf"^(\d{{4}}/\d{{2}}/\d{{2}} {hms}(?:\.\d+)?) \[({words})\] ([^\s:]+): ?(.*)$", "tlcm"),
        (rf"^(\d{{9,10}}(?:\.\d+)?) \[({words})\](?: \(([^)]*)\))?(?: (.*))?$", "tlcm"),
    ]
    arms = ""
    for rx, groups in layouts:
        flags = "si" if "l" in groups else "s"
        level = "'P' || g.p" if "p" in groups else "g.l"
        arms += f" WHEN regexp_matches(raw, '{rx}', '{flags}') THEN list_transform([regexp_extract(raw, '{rx}', {list(groups.lower())}, '{flags}')], lambda g: {{'ts': g.t, 'lvl': {level}, 'comp': g.c, 'msg': g.m}})[1]\n"

    def members(at: str) -> str:
        first = lambda *keys: "coalesce(" + ", ".join(at.replace("?", k) for k in keys) + ")"
        return (
            f"{{'ts': {first('@timestamp', 'timestamp', 'time', 'ts')}, 'lvl': coalesce({first('level', 'severity', 'lvl', 'loglevel')}, ''), "
            f"'comp': coalesce({first('component', 'logger', 'mod', 'module', 'app', 'program')}, ''), 'msg': {first('message', 'msg', 'event')}}}"
        )

    pair = r'([A-Za-z@_][\w.@-]*)=("(?:[^"\\]|\\.)*"|\S*)'
    unquoted = r"""replace(replace(replace(replace(replace(y.v[2:-2], '\\', chr(1)), '\n', chr(10)), '\t', chr(9)), '\"', '"'), chr(1), '\')"""
    levels = {"emerg": "0 emerg emergency panic", "alert": "1 alert", "crit": "2 crit critical fatal f", "err": "3 err error severe e", "warning": "4 warning warn w", "notice": "5 notice", "info": "6 info information informational i", "debug": "7 debug trace verbose d v"}
    level = " ".join(f"WHEN w IN ({', '.join(repr(w) for w in ws.split())}) THEN '{name}'" for name, ws in levels.items())
    as_json, as_pairs = members("(j->>'$.\"?\"')"), members("p['?']")
    return rf"""WITH once AS (SELECT file_path, file_line_number AS n, arg_max(coalesce(raw_message, ''), len(raw_message)) AS raw FROM file_lines WHERE file_path IS NOT NULL AND file_line_number IS NOT NULL GROUP BY ALL),
 r AS (SELECT *, CASE WHEN raw[1] = '{{' AND json_type(try_cast(raw AS JSON)) = 'OBJECT' THEN try_cast(raw AS JSON) END AS j,
  CASE WHEN regexp_full_match(raw, '(?:{pair}(?: +|$))+', 's') THEN map_from_entries(list_distinct(list_transform(regexp_extract_all(raw, '{pair}', 0), lambda x: list_transform([{{'k': split_part(x, '=', 1), 'v': substr(x, strpos(x, '=') + 1)}}],
   lambda y: {{'k': y.k, 'v': CASE WHEN len(y.v) > 1 AND y.v[1] = '"' THEN {unquoted} ELSE y.v END}})[1]))) END AS p FROM once),
 h AS (SELECT file_path, n, raw, CASE WHEN raw = '' OR regexp_matches(raw, '^\s') THEN NULL
 {arms} WHEN j IS NOT NULL THEN {as_json} WHEN p IS NOT NULL THEN {as_pairs} END AS e FROM r),
 hh AS (SELECT file_path, n, raw, CASE WHEN e.ts IS NOT NULL AND (e.msg IS NOT NULL OR e.lvl LIKE 'P%') THEN e END AS e FROM h),
 g AS (SELECT *, max(CASE WHEN e IS NOT NULL THEN n END) OVER (PARTITION BY file_path ORDER BY n) AS first_line FROM hh),
 a AS (SELECT file_path, first_line, any_value(e) AS e, string_agg(CASE WHEN e IS NOT NULL THEN coalesce(e.msg, '') ELSE raw END, chr(10) ORDER BY n) AS message FROM g WHERE first_line IS NOT NULL GROUP BY ALL),
 s AS (SELECT *, CASE WHEN e.lvl LIKE 'P_%' THEN (substr(e.lvl, 2)::INT & 7)::VARCHAR ELSE lower(e.lvl) END AS w FROM a)
 SELECT file_path, first_line, e.ts AS entry_ts, CASE {level} ELSE '' END AS level, CASE WHEN e.comp = '-' THEN '' ELSE coalesce(e.comp, '') END AS component, md5(regexp_replace(message, '^\s+|\s+$', '', 'g')) AS message_md5 FROM s"""


ORACLES: dict[str, str] = {
    "p1_found": _CHANGES,
    "p2_found": _entries_sql(),
    "p4_found": _NODES,
    "p1_accounted": """WITH l AS (SELECT 'vendor_fields' AS layer, try_cast(vendor_fields AS JSON) AS j FROM spool_rows UNION ALL SELECT 'unknown_fields', try_cast(unknown_fields AS JSON) FROM spool_rows),
 o AS (SELECT layer, j FROM l WHERE json_type(j) = 'OBJECT'), m AS (SELECT layer, unnest(map_values(from_json(j, '"MAP(VARCHAR, JSON)"'))) AS v FROM o)
 SELECT layer, count(*) AS n_members, count_if(v IS NULL OR v::VARCHAR = 'null')::BIGINT AS n_null, count_if(NOT (v IS NULL OR v::VARCHAR = 'null'))::BIGINT AS n_kept, 0::BIGINT AS n_twice FROM m GROUP BY layer""",
    "p5_watermarks": f"WITH {_PASSED} SELECT nullif(s, chr(1)) AS source_name, hour_us, passed_us FROM passed",
    "p5_closings": f"WITH {_PASSED} SELECT hour_us, max(passed_us) AS closed_us, count(*) AS n_sources, count_if(passed_us = hour_us + 7800000000)::BIGINT AS n_idle FROM passed GROUP BY hour_us",
    "p3_found": f"WITH {_PAIRS} SELECT field, key_value FROM pairs WHERE key_value IS NOT NULL GROUP BY ALL HAVING count(*) >= {SHARE} * (SELECT count(*) FROM telemetry)",
    "p3_keys": f"WITH {_PAIRS} SELECT field, key_value, count(*) AS n_rows, count(DISTINCT k) AS n_events, max(us) AS last_ingest_us FROM pairs GROUP BY field, key_value",
    "p3_sizes": f"""WITH {_PAIRS}, c AS (SELECT field, key_value, size, count(*) AS n FROM pairs WHERE size IS NOT NULL GROUP BY ALL),
 m AS (SELECT field, key_value, size AS mode, n AS mode_rows FROM c QUALIFY row_number() OVER (PARTITION BY field, key_value ORDER BY n DESC, size) = 1),
 q AS (SELECT field, key_value, quantile_cont(size, 0.25)::DOUBLE AS q1, quantile_cont(size, 0.5)::DOUBLE AS q2, quantile_cont(size, 0.75)::DOUBLE AS q3 FROM pairs WHERE size IS NOT NULL GROUP BY ALL)
 SELECT q.field, q.key_value, mode, mode_rows, q1, q2, q3 FROM q JOIN m ON q.field = m.field AND q.key_value IS NOT DISTINCT FROM m.key_value""",
    "p6_found": f"WITH {_RANKED} SELECT event_id, row_id FROM ranked WHERE rn > 1",
    "p6_kept": f"WITH {_RANKED} SELECT event_id, row_id FROM ranked WHERE rn = 1",
}
