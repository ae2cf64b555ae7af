import json

import pytest
from pyspark.sql import functions as F

from millrace import config
from millrace.config import Config, Limits, Source
from millrace.functions import text as X
from millrace.operators import checks, parsers, serialize
from millrace.plans import pipeline as P
from millrace.sources import framing, readers, sinks
from millrace.streaming import jobs

CFG = Config(reference_year=2026)

#: Message -> (source status, vendor, format, parser, parse status, fields): one per format, each with rules of its own to show.
SHOWN = {
    '<77>2 2026-03-04T05:06:07.25+02:00 - tidesync - SYNC [run@99 n="3" q="a\\"b"] spool is 80% full': (
        "UNKNOWN", None, "rfc5424", "rfc5424", "PARSED",
        {"@timestamp": "2026-03-04T03:06:07.250000Z", "log.syslog.facility": 9, "log.syslog.severity": 5, "log.syslog.priority": 77, "log.syslog.appname": "tidesync", "log.syslog.msgid": "SYNC", "message": "spool is 80% full"},
    ),
    "<189>Feb 29 23:59:59 edge-7 : %ASA-6-302014: Teardown TCP connection 51 for dmz:172.16.3.9/8443 (203.0.113.4/8443) to lab:10.8.0.77/40112 duration 1:02:03 bytes 4096 TCP Reset-I": (
        "INFERRED", "Cisco", "rfc3164", "rfc3164+cisco_asa", "PARSED",
        {"source.ip": "172.16.3.9", "source.port": 8443, "destination.ip": "10.8.0.77", "destination.port": 40112, "network.transport": "tcp", "network.bytes": 4096, "event.duration_seconds": 3723,
         "cisco.message_id": "302014", "cisco.connection_id": "51", "cisco.first_interface": "dmz"},
    ),
    "CEF:1|Brine Works|tide\\|gate|7.2|q-9|lease refused|Very-High|dpt=8080 dst=198.51.100.7 msg=two words \\= one cfp1=0.5 oddOne=x y": (
        "INFERRED", "Brine Works", "cef", "cef", "PARSED", {"event.severity": 10, "destination.port": 8080, "destination.ip": "198.51.100.7", "message": "two words = one", "cef.cfp1": "0.5"},
    ),
    "LEEF:2.0|Quill|Roster|3|shift-change|^|sev=3^usrName=ada q^srcPort=7^proto=udp": (
        "INFERRED", "Quill", "leef", "leef", "PARSED", {"leef.event_id": "shift-change", "event.severity": 3, "source.user.name": "ada q", "source.port": 7, "network.transport": "udp"},
    ),
    'date=2026-02-28 time=23:00:59 logid=1122334455 type=utm subtype=webfilter vd="edge" srcip=192.0.2.9 sentbyte=77 policyid=12 msg="page held back"': (
        "INFERRED", "Fortinet", "key_value", "fortigate", "PARSED",
        {"fortigate.vdom": "edge", "source.ip": "192.0.2.9", "source.bytes": 77, "fortigate.policyid": 12, "message": "page held back", "@timestamp": "2026-02-28T23:00:59Z"},
    ),
    '{"time": "2026-03-04T05:06:07Z", "dst": "2001:db8::5", "src_port": "995", "unit": {"deck": {"no": 4}}, "twin": "l", "twin": "r"}': (
        "UNKNOWN", None, "json", "json", "PARSED", {"source.port": 995, "destination.ip": "2001:db8::5", "json.unit.deck.no": 4, "json.twin": "l", "json.twin#2": "r"},
    ),
    'srcip=192.0.2.1 dport=53 usr="ada q" proto=tcp bytes_sent=12 level=notice': (
        "UNKNOWN", None, "key_value", "key_value", "PARSED", {"source.ip": "192.0.2.1", "destination.port": 53, "source.user.name": "ada q", "source.bytes": 12, "log.level": "notice"},
    ),
    "the tide turned at noon, said nobody": ("UNKNOWN", None, "unknown", "plain_text", "UNKNOWN_FORMAT", {"message": "the tide turned at noon, said nobody"}),
}

ABUSE = [
    "", None, " ", "<949>1 - - - - - - x", "<1>0 2026-01-01T00:00:00Z h a p m - x", "<134>1 2026-13-45T99:99:99Z h a p m - x", '<13>1 - h a p m [a x="1" x="2"] m', "<13>1 - h a p m [unclosed m",
    "<13>1 - h a p m", "<13>", "Jan 32 25:61:61 h t: x", "Foo  1 10:00:00 h t: x", "CEF:0|a|b|c|d|e|5", "CEF:0|a|b|c", "CEF:0|a|b|c|d|e|X|src=1 src=2 justtext", "CEF:0|a|b|c|d|e|5|k\\=1=2 x=a|b",
    '{"a":', '{"a":1,"a":2,"a":3}', "{bad json}", '{"a":' * 41 + "1" + "}" * 41, '{"l": [[1], {"x": 2}]}', "[1,2,3]", '"text"', "<134>1 " + "x" * 5000, "CEF:" + "|" * 500, 'k="' + "v" * 60_000 + '" b=1',
    "<13>1 - h a p m " + '[a b="c"]' * 200 + " m", "\x00\x01 ctrl", "m" * 3000, "a=1 " * 300, "a,,b", "a;b;c", "<note>x</note>", "a\tb", "CEF:0|a|b|c|d|e|5|msg=\\\\", "id=firewall sn=A1 time=x fw=1.2.3.4", "²=1 ³=2",
]


@pytest.fixture(scope="module")
def shown(spark):
    df = spark.createDataFrame([(m,) for m in SHOWN], "raw_message string")
    return {r["raw_message"]: r for r in P.parse_events(df, CFG).withColumn("n", F.to_json("normalized")).withColumn("u", F.to_json("unknown_fields")).drop("normalized", "unknown_fields", "vendor_fields", "decoded", "protocol_metadata").collect()}


def test_a_message_of_each_format(shown):
    for raw, (status, vendor, fmt, parser, parsed, fields) in SHOWN.items():
        r = shown[raw]
        assert (r["source_status"], r["vendor"], r["format_detected"], r["parser_name"], r["parse_status"]) == (status, vendor, fmt, parser, parsed)
        own = json.loads(r["n"])
        assert {k: own.get(k) for k in fields} == fields
        assert r["validation_status"] == "VALID"
    assert json.loads(shown[next(m for m in SHOWN if m.startswith("CEF"))]["u"]) == {"cef.ext.oddOne": "x y"}


def test_no_row_is_lost_or_changed(spark):
    rows = [(i, m, "clash", "clash") for i, m in enumerate(ABUSE + ABUSE[:3])]
    df = spark.createDataFrame(rows, "i int, raw_message string, vendor string, normalized string")
    got = {r["i"]: r for r in P.parse_events(df, CFG).select("i", "raw_message", "parse_status", "validation_status", "parser_name", "parse_notes").collect()}
    assert {i: r["raw_message"] for i, r in got.items()} == {i: m for i, m, *_ in rows}
    assert {r["parse_status"] for r in got.values()} <= {"PARSED", "PARTIAL", "FAILED", "UNKNOWN_FORMAT"}
    by = {m: got[i] for i, m, *_ in rows}
    assert by[""]["validation_status"] == by[None]["validation_status"] == "INVALID"
    assert by["CEF:0|a|b|c|d|e|5"]["parse_notes"][0] == "CEF_HEADER_INCOMPLETE:7/7 fields"
    assert by['{"a":' * 41 + "1" + "}" * 41]["parse_notes"][0].startswith("JSON_MAX_DEPTH_EXCEEDED:")
    assert by["a,,b"]["parser_name"] == "plain_text" and by["[1,2,3]"]["parser_name"] == "csv" and by["a;b;c"]["parser_name"] == "csv"
    assert by["<note>x</note>"]["parse_status"] == "UNKNOWN_FORMAT"
    assert by["<13>1 - h a p m [unclosed m"]["parse_notes"][0].startswith("SD_UNBALANCED")
    assert P.parse_events(df.limit(0), CFG).count() == 0


def test_a_replay_gives_the_same(spark):
    df = spark.createDataFrame([(m, "/f", i) for i, m in enumerate(SHOWN)], "raw_message string, file_path string, file_line_number bigint")
    once, again = (sorted(map(str, P.parse_events(df, CFG, at=1.0).select("event_id", F.to_json("normalized"), "parse_notes").collect())) for _ in range(2))
    assert once == again


def test_sources_hints_limits(spark):
    cfg = Config(Limits(max_field_bytes=10, max_field_count=3), (Source("a", peer_ip="1.1.1.1", vendor="V", product="P", parser_hint="cef"), Source("b", transport="udp", parser_hint="none"), Source("never")), reference_year=2026)
    df = spark.createDataFrame([(1, "x=1 y=2 z=345678901234 w=4", "1.1.1.1", "tcp"), (2, "x=1 y=2", "2.2.2.2", "udp"), (3, "x=1 y=2", None, None)], "i int, raw_message string, peer_ip string, transport string")
    r = {x["i"]: x for x in P.parse_events(df, cfg).select("i", "source_status", "source_name", "vendor", "parse_notes", "truncated", "source_evidence", F.to_json("unknown_fields").alias("u")).collect()}
    assert (r[1]["source_status"], r[1]["source_name"], r[1]["vendor"], r[1]["truncated"]) == ("KNOWN", "a", "V", True)
    assert r[1]["parse_notes"][0] == "PARSER_HINT:hint_rejected_fallback:cef"
    assert "FIELD_LIMIT_EXCEEDED:kv.z:12>10" in r[1]["parse_notes"] and "FIELD_COUNT_LIMIT_EXCEEDED:1_beyond_3" in r[1]["parse_notes"]
    assert json.loads(r[1]["u"])["kv.z"] == "345678901234"
    assert r[1]["source_evidence"][:2] == [["configured_source", "a"], ["parser_hint", "cef"]]
    assert r[2]["source_name"] == "b" and not any(n.startswith("PARSER_HINT") for n in r[2]["parse_notes"])
    assert (r[3]["source_status"], r[3]["source_evidence"]) == ("UNKNOWN", [["result", "no deterministic rule matched"]])


def test_own_parser(spark):
    mine = parsers.Parser("mine", ("plain_text",), lambda t, c: t.startswith("MY "), lambda s: parsers._result("PARSED", X.notes(), fields=X.entries(("my", F.substring(s.text, 4, 100), None))), "2.0")
    df = spark.createDataFrame([("MY word",), ("other",)], "raw_message string")
    got = {r["raw_message"]: (r["parser_name"], r["parser_version"], r["m"]) for r in P.parse_events(df, CFG, parsers.registered(parsers.REGISTRY, mine, 0)).withColumn("m", P.text_of("normalized", "my")).collect()}
    assert got == {"MY word": ("mine", "2.0", "word"), "other": ("plain_text", "1.0.0", None)}


def test_equal_messages_are_events_of_their_own(spark):
    rows = [("same", "1.1.1.1", None, None), ("same", "1.1.1.1", None, None), ("same", "2.2.2.2", None, None), ("same", None, "/f", 1), ("same", None, "/f", 2), ("same", None, "/f", None)]
    df = spark.createDataFrame(rows, "raw_message string, peer_ip string, file_path string, file_line_number bigint")
    ids = [r[0] for r in P.parse_events(df, CFG, at=1.0).select("event_id").collect()]
    assert len(set(ids)) == len(rows) and all(len(i) == 32 for i in ids)
    again = {r[0] for r in P.parse_events(df, CFG, at=9.0).select("event_id").collect()}
    assert len(again & set(ids)) == 2  # lines of files keep theirs


def test_stages_that_are_not_asked_for_are_not_in_the_plan(spark):
    df = spark.createDataFrame([(m, "own") for m in SHOWN], "raw_message string, mine string")
    plan = lambda *c: P.parse_events(df, CFG, columns=c)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan("raw_message", "raw_size_bytes", "event_id") + plan("format_detected")
    counts = [plan(*c).count("ArrowEvalPython") for c in (("vendor",), ("parse_status",), ("parse_status", "validation_status"))]
    assert counts == sorted(set(counts)), counts
    whole = P.parse_events(df, CFG, at=1.0)
    assert set(whole.columns) == P.EVENT | {"mine"}
    for c in ("format_detected", "vendor", "source_status", "parser_name", "parse_status", "parse_notes", "hostname", "validation_status", "truncated"):
        part = P.parse_events(df, CFG, at=1.0, columns=[c, "raw_message"])
        assert set(part.columns) == {c, "raw_message", "mine"}
        assert sorted(map(str, part.select("raw_message", c).collect())) == sorted(map(str, whole.select("raw_message", c).collect()))


def test_connection_messages_word_by_word(spark):
    head = "<166>Jan 02 03:04:05 gw : %ASA-6-"
    bodies = {
        "302013: Built inbound TCP connection 7 for a:1.2.3.4/5 (1.2.3.4/5) to b:fe80::1/6 (x/6)": ("PARSED", "7", 5, 6, None),
        "302013: Built inbound TCP connection 7 for a:1.2.3.4/5 to b:2.3.4.5/6 duration 0:00:01 bytes 9 more": ("PARSED", "7", 5, 6, 9),
        "302013: Built TCP connection 7 for a:1.2.3.4/5 to b:2.3.4.5/6": ("PARTIAL", None, None, None, None),
        "302014: Teardown UDP connection 8 for a:1.2.3.4/5 to b:2.3.4.5/6 duration 0:00:01 bytes 9": ("PARSED", "8", 5, 6, 9),
        "302014: Teardown TCP connection 8 for a:1.2.3.4/5 to b:2.3.4.5/6 duration 0:00:01 bytes 9 why 7?": ("PARTIAL", None, None, None, None),
        "302014: Teardown TCP connection 8 for a:1.2.3.4/5 to b:2.3.4.5/6": ("PARTIAL", None, None, None, None),
        "302015: Built UDP connection 9 for a:1.2.3.4/5 to nowhere": ("PARSED", "9", 5, None, None),
        "302015: Built inbound UDP connection 9 for a:1.2.3.4/5 to b:2.3.4.5/6": ("PARTIAL", None, None, None, None),
    }
    df = spark.createDataFrame([(head + b, b) for b in bodies], "raw_message string, body string")
    for r in P.parse_events(df, CFG).select("body", "parse_status", P.text_of("normalized", "cisco.connection_id").alias("c"), *[P.long_of("normalized", k).alias(n) for k, n in (("source.port", "s"), ("destination.port", "d"), ("network.bytes", "b"))]).collect():
        assert tuple(r)[1:] == bodies[r["body"]], r["body"]


def test_a_parser_that_raises_fails_its_own_row(spark):
    def parse(text):
        return {"fields": {"n": int(text[3:]), "list": [1]}, "unknown": {"rest": text}, "notes": ["read"]}

    mine = parsers.python_parser("mine", ("plain_text",), lambda t, c: t.startswith("MY "), parse)
    df = spark.createDataFrame([("MY 5",), ("MY x",), ("other",)], "raw_message string")
    got = {r["raw_message"]: r for r in P.parse_events(df, CFG, parsers.registered(parsers.REGISTRY, mine, 0)).select("raw_message", "parser_name", "parse_status", "parse_notes", P.long_of("normalized", "n").alias("n")).collect()}
    assert (got["MY 5"]["parser_name"], got["MY 5"]["parse_status"], got["MY 5"]["n"], got["MY 5"]["parse_notes"][0]) == ("mine", "PARSED", 5, "read")
    assert got["MY x"]["parse_status"] == "FAILED" and got["MY x"]["parse_notes"][0].startswith("PARSE_ERROR:ValueError:")
    assert got["other"]["parser_name"] == "plain_text"


def test_framing():
    f = framing.Framer(100)
    assert f.feed(b"5 he") == [] and f.feed(b"llo3 a\nb") == [b"hello", b"a\nb"] and f.style == "octet"
    f = framing.Framer(100)
    assert f.feed(b"one\r\ntwo\nthr") == [b"one", b"two"] and f.feed(b"ee\n") == [b"three"] and f.style == "newline"
    assert framing.Framer(5000).feed(b"2026 foo\n") == [b"2026 foo"]
    f = framing.Framer(100)
    assert f.feed(b"0 x") == [] and f.error.endswith("invalid octet count 0") and f.feed(b"ok\n") == []
    f = framing.Framer(10)
    assert f.feed(b"x" * 27) == [] and f.error.startswith("LIMIT:")
    assert len(framing.Framer(100).feed(b"0123456789\n" * 5000)) == 5000  # a full buffer of good frames is no error


def test_frames_of_interleaved_connections(spark):
    rows = [("a", 1, b"5 he"), ("b", 1, b"x\ny"), ("a", 2, b"llo3 abc"), ("b", 2, b"z\n"), ("c", 1, b"0 x"), ("c", 2, b"more\n"), (None, 1, b"n\n"), ("d", 1, None)]
    df = spark.createDataFrame(rows, "connection string, seq bigint, data binary").orderBy(F.rand(3))
    got = sorted((str(r["connection"]), r["seq"], r["frame"] and bytes(r["frame"]), r["error"]) for r in framing.frames(df).collect())
    assert got == [("None", 0, b"n", None), ("a", 0, b"hello", None), ("a", 1, b"abc", None), ("b", 0, b"x", None), ("b", 1, b"yz", None), ("c", 0, None, "FRAME:invalid octet count 0")]


def test_files_are_numbered_across_splits(spark, tmp_path):
    lines = [f"line {i} " + "x" * (i % 50) for i in range(1, 4001)]
    lines[10] = ""
    (tmp_path / "a.log").write_bytes("\n".join(lines).encode() + b"\n")
    (tmp_path / "b.log").write_bytes(b"\xfcber\nlast")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = readers.read_files(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    got = {(r["file_path"].rsplit("/", 1)[1], r["file_line_number"]): r for r in rows}
    assert [got["a.log", i + 1]["raw_message"] for i in range(4000)] == lines
    assert got["b.log", 1]["raw_message"] == "über" and got["b.log", 1]["raw_bytes_b64"] and got["b.log", 2]["raw_message"] == "last"


def test_serialised_events(spark):
    df = readers.replay(spark, ["src=10.0.0.1 my-key=a|b", b"\xff raw"])
    rows = P.parse_events(df, CFG, at=1_760_000_000.0).orderBy("file_line_number").select(serialize.leef().alias("l"), serialize.syslog_json().alias("s"), serialize.spool_json().alias("j"), serialize.bulk_lines().alias("b")).collect()
    assert rows[0]["l"] == "LEEF:1.0|UnknownVendor|key_value|1.0|key_value\tsev=5\tsrc=10.0.0.1\traw=src=10.0.0.1 my-key=a|b\tu_kv.my-key=a|b"
    assert rows[0]["s"].startswith("<134>Oct  9 08:53:20 unknown millrace: {")
    doc = json.loads(rows[1]["j"])
    assert doc["raw"]["raw_message"] == "ÿ raw" and doc["raw"]["raw_bytes_b64"] == "/yByYXc=" and doc["transport"]["file_line_number"] == 2
    action, flat, end = rows[0]["b"].split("\n")
    assert json.loads(action) == {"index": {"_index": "millrace-2025.10.09"}} and json.loads(flat)["normalized.source.ip"] == "10.0.0.1" and end == ""


def test_bulk_answers(spark):
    item = sinks.bulk_errors(200, '{"errors":true,"items":[{"index":{"status":201}},{"index":{"error":{"type":"x"}}}]}', 3)
    assert item == [None, 'ELASTIC_ITEM:{"type": "x"}', "ELASTIC_ITEM_MISSING"]
    assert sinks.bulk_errors(200, "{}", 2) == ["ELASTIC_ITEM_MISSING"] * 2 and sinks.bulk_errors(200, "[]", 1) == ["ELASTIC_BAD_RESPONSE"]
    assert sinks.bulk_errors(200, '{"errors":false,"items":[{"create":{"status":201}},7]}', 2) == [None, None]
    assert sinks.bulk_errors(503, "", 2) == ["ELASTIC_HTTP:503"] * 2 and sinks.bulk_errors(200, "no", 1) == ["ELASTIC_BAD_RESPONSE"]
    rows = [(1, 200, '{"errors":true,"items":[{"index":{"status":201}},{"index":{"error":{"type":"x"}}}]}', 3), (2, 503, None, 1), (3, 200, "no", 1), (4, 200, "{}", 0)]
    got = sorted((r["batch_id"], r["position"], r["error"]) for r in serialize.bulk_outcome(spark.createDataFrame(rows, "batch_id bigint, http_status int, body string, n_events int")).collect())
    assert got == [(1, 0, None), (1, 1, 'ELASTIC_ITEM:{"type":"x"}'), (1, 2, None), (2, 0, "ELASTIC_HTTP:503"), (3, 0, "ELASTIC_BAD_RESPONSE")]


def test_delivery_retries_and_spools(spark, tmp_path):
    flag = str(tmp_path / "second")

    def send(lines):
        import os

        if any("boom" in x for x in lines):
            raise RuntimeError("boom")
        if os.path.exists(flag):
            return [None] * len(lines)
        open(flag, "w").close()
        return ["SYSLOG_SEND:later"] * len(lines)

    target = sinks.Target("mine:x", lambda: F.col("raw_message"), send)
    events = P.parse_events(spark.createDataFrame([("fine", "1"), ("boom", "2")], "raw_message string, event_id string").coalesce(1), CFG)
    out = {r["event_id"]: r for r in sinks.deliver_or_spool(events, target, str(tmp_path / "spool"), str(tmp_path / "out"), Limits(max_delivery_retries=1, retry_backoff_seconds=0.01), batch=1).collect()}
    assert (out["1"]["delivery_status"], out["1"]["delivery_attempts"], out["1"]["delivery_target"]) == ("DELIVERED", 2, "mine:x")
    assert (out["2"]["delivery_status"], out["2"]["delivery_error"]) == ("SPOOLED", "ADAPTER:RuntimeError:boom")
    assert out["2"]["delivery_target"] == f"spool:{tmp_path / 'spool'}"
    assert [json.loads(r[0])["raw"]["raw_message"] for r in spark.read.text(str(tmp_path / "spool")).collect()] == ["boom"]
    (tmp_path / "file").write_text("no folder")
    lost = sinks.deliver_or_spool(events.where("event_id = '2'"), target, str(tmp_path / "file" / "spool"), str(tmp_path / "out2"), Limits(max_delivery_retries=0), batch=1).first()
    assert lost["delivery_status"] == "REJECTED" and lost["delivery_error"].startswith("SPOOL_FAILED:") and lost["delivery_target"] is None


def test_stream_of_files_to_spool(spark, tmp_path):
    (tmp_path / "in").mkdir()
    run = lambda: jobs.run(readers.stream_files(spark, str(tmp_path / "in"), limit=20), CFG, str(tmp_path / "spool"), str(tmp_path / "cp"), once=True)
    (tmp_path / "in" / "a.log").write_text("a=1 b=2\n" + "x" * 21 + "\n{\"x\": 1}\na=1 b=2\n")
    q = run()
    q.awaitTermination(120)
    assert jobs.counters(q) == {"events_oversized_file_line": 1}
    (tmp_path / "in" / "b.log").write_text("a=1 b=2\n")
    run().awaitTermination(120)
    docs = [json.loads(r[0]) for r in spark.read.text(str(tmp_path / "spool")).collect()]
    got = sorted((d["transport"]["file_path"][-5:], d["transport"]["file_line_number"], d["parser"]["name"]) for d in docs)
    assert got == [("a.log", 1, "key_value"), ("a.log", 3, "json"), ("a.log", 4, "key_value"), ("b.log", 1, "key_value")]
    ids = {d["ingestion"]["event_id"] for d in docs}
    batch = P.parse_events(readers.read_files(spark, str(tmp_path / "in"), 20), CFG).select("event_id").collect()
    assert len(ids) == 4 and {r[0] for r in batch} == ids


def test_what_is_too_long_is_counted(spark, tmp_path):
    from pyspark.sql import Observation

    (tmp_path / "a.log").write_text("short\n" + "x" * 50 + "\nlast\n")
    seen = Observation("lines")
    rows = readers.read_files(spark, str(tmp_path / "a.log"), 20, seen).collect()
    assert [(r["file_line_number"], r["raw_message"]) for r in sorted(rows, key=lambda r: r["file_line_number"])] == [(1, "short"), (3, "last")] and seen.get == {"events_oversized_file_line": 1}
    seen = Observation("packets")
    assert framing.datagrams(spark.createDataFrame([(b"x" * 9,), (b"y",), (None,)], "data binary"), 5, seen).count() == 1 and seen.get == {"events_oversized_datagram": 1}


def test_udp_and_tcp(spark, tmp_path):
    import socket
    import time

    for kind, port, payload, want in (("udp", 15_514, b"a=1 b=2", ["a=1 b=2"]), ("tcp", 15_601, b"3 x=1one\n", ["x=1"])):
        q = readers.listen(spark, kind, port, limit=1000).writeStream.format("memory").queryName(f"got_{kind}").start()
        deadline = time.time() + 60
        got = []
        while time.time() < deadline and not got:
            try:
                s = socket.socket(socket.AF_INET, socket.SOCK_DGRAM if kind == "udp" else socket.SOCK_STREAM)
                s.connect(("127.0.0.1", port))
                s.sendall(payload)
                if kind == "udp":
                    s.sendall(b"z" * 2000)
                    s.sendall(payload)
                s.close()
            except OSError:
                pass
            time.sleep(1)
            rows = spark.sql(f"SELECT raw_message, event_id FROM got_{kind}").collect()
            got = [r["raw_message"] for r in rows]
        counted = jobs.counters(q)
        q.stop()
        assert got[:1] == want and len({r["event_id"] for r in rows}) == len(rows)
        assert kind == "tcp" or (len(got) > 1 and set(got) == {"a=1 b=2"} and counted["events_oversized_datagram"] > 0)


def test_metrics_and_inspection(spark):
    e = P.parse_events(spark.createDataFrame([(m,) for m in SHOWN], "raw_message string"), CFG, at=5.0)
    m = {r["name"]: r["value"] for r in P.metrics(e).collect()}
    assert (m["events_received"], m["events_parsed"], m["events_unknown_format"], m["events_unknown_source"], m["events_parse_failed"], m["error.PARSE_ERROR"]) == (8, 7, 1, 4, 0, 0)
    one = P.recent(e, 1).first()["event_id"]
    assert P.event_by_id(e, one).count() == 1 and P.summary(e).columns == ["id", "format_detected", "source_status", "vendor", "parser_name", "parse_status"]


def test_config(tmp_path, monkeypatch):
    good = tmp_path / "c.json"
    good.write_text('{"sources": [{"source_id": "a", "peer_ip": "1.1.1.1"}], "siem": {"type": "elastic", "url": "http://x", "api_key_env": "KEY"}}')
    cfg = config.load(str(good))
    monkeypatch.setenv("KEY", "s3")
    good.write_text('{"limits": {"max_queue_size": 5, "max_batch_events": 7}}')
    assert config.load(str(good)).limits.max_batch_events == 7
    assert cfg.sources[0].source_id == "a" and config.secret(cfg.siem, "api_key") == "s3" and jobs.target_of(cfg).metric == "elastic"
    for bad in ("[]", "{", '{"odd": 1}', '{"siem": {"type": "ftp"}}', '{"listeners": [{"type": "udp"}]}', '{"limits": {"max_message_byte": 1}}', '{"limits": {"max_field_count": 0}}', '{"sources": [{"x": 1}]}'):
        good.write_text(bad)
        with pytest.raises(config.ConfigError):
            config.load(str(good))


def test_scalar_functions(spark):
    def one(c):
        return spark.range(1).select(c.alias("x")).first()["x"]

    lit = F.lit
    assert one(X.cef_unescape(lit("a\\=b\\\\n\\n\\q"))) == "a=b\\n\n\\q"
    assert one(X.split_unescaped(lit("a\\|b|c\\\\|d|"))) == ["a\\|b", "c\\\\", "d", ""]
    assert [one(X.cef_severity(lit(s))) for s in ("7", "99", "Very-High", "x", "")] == [7, 10, 10, None, None]
    assert [one(X.delimiter(lit(s))) for s in ("^", "x5E", "0x20AC", "")] == ["^", "^", "€", None]
    assert one(X.rfc3339_utc(lit("2026-01-01T00:00:00.5+01:00"))) == "2025-12-31T23:00:00.500000Z"
    assert one(X.rfc3339_utc(lit("2026-13-01T00:00:00Z"))) is None
    assert one(X.duration_seconds(lit("1:02:03"))) == 3723 and one(X.duration_seconds(lit("x"))) is None
    assert one(X.unquote(lit('"a \\"b\\" \\\\"'))) == 'a "b" \\'


def test_http(spark):
    import threading
    import urllib.error
    import urllib.request

    from millrace import api

    e = P.parse_events(spark.createDataFrame([("a=1 b=2", "id1")], "raw_message string, event_id string"), CFG, at=5.0).persist()
    s = api.server(spark, lambda: e, CFG, port=0)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{s.server_address[1]}"
    get = lambda path, data=None: json.loads(urllib.request.urlopen(base + path, data, timeout=120).read())
    assert get("/health") == {"status": "ok"} and get("/metrics")["events_received"] == 1
    assert get("/events?limit=5")[0]["raw"]["raw_message"] == "a=1 b=2" and get("/events/id1")["parser"]["name"] == "key_value"
    assert get("/api/parse", b'{"x": 1}')["normalized"]["json.x"] == 1
    with urllib.request.urlopen(base + "/", timeout=60) as page:
        assert page.headers["Content-Type"].startswith("text/html") and b"/api/parse" in page.read()
    with pytest.raises(urllib.error.HTTPError):
        get("/events/none")
    s.shutdown()
    e.unpersist()


def test_delivery_metrics_and_release(spark):
    import os

    from millrace import session

    rows = [("DELIVERED", "elastic:http://x", None), ("DELIVERED", "elastic:http://y", None), ("SPOOLED", "spool:s", "ADAPTER:KeyError:x"), ("REJECTED", None, "SPOOL_FAILED:x")]
    m = P.delivery_metrics(spark.createDataFrame(rows, "delivery_status string, delivery_target string, delivery_error string"))
    assert {r["name"]: r["value"] for r in m.collect()} == {"delivery_delivered.elastic": 2, "events_spooled": 1, "delivery_rejected.spool": 1, "error.SIEM_DELIVERY_ERROR": 1}
    df = session.stored(spark.range(3), "three")
    path = session._made[spark.sparkContext.applicationId][-1]
    assert df.count() == 3 and os.path.isdir(path)
    session.release(spark)
    assert not os.path.exists(path)


def test_cli(spark, tmp_path, capsys, monkeypatch):
    from millrace import cli

    monkeypatch.setattr(cli, "_spark", lambda: spark)
    assert cli.main(["parse", "a=1 b=2"]) == 0
    assert json.loads(capsys.readouterr().out)["parser"]["name"] == "key_value"
    (tmp_path / "x.log").write_text("a=1 b=2\nplain words\n")
    assert cli.main(["replay", str(tmp_path / "x.log"), "--summary"]) == 0
    assert [line.split("  ")[1] for line in capsys.readouterr().out.splitlines()] == ["key_value", "unknown"]
    assert cli.main(["test-parser", "CEF:0|a|b|c|d|e|5|src=1.1.1.1"]) == 0
    assert {json.loads(x)["parser"] for x in capsys.readouterr().out.splitlines()} >= {"cef", "plain_text"}
    assert cli.main(["test-parser", "x", "--parser", "nope"]) == 2 and cli.main(["test-parser", "x", "--parser", "cef"]) == 1
    served = []

    class Surface:
        server_address = ("127.0.0.1", 1)

        def serve_forever(self):
            raise KeyboardInterrupt

        def server_close(self):
            pass

    monkeypatch.setattr(cli.api, "server", lambda spark, events, cfg, port: served.append((events().count(), port)) or Surface())
    assert cli.main(["replay", str(tmp_path / "x.log"), "--summary", "--api", "--api-port", "81"]) == cli.main(["serve"]) == 0 and served == [(2, 81), (0, 8080)]
    (tmp_path / "bad.json").write_text("[]")
    assert cli.main(["parse", "x", "--config", str(tmp_path / "bad.json")]) == 2


def test_index_of_the_day_in_any_unit(spark):
    df = spark.createDataFrame([(x,) for x in (1.76e9, 1.76e12, 1.76e15, 1.76e18)], "ingested_at_unix_utc double")
    assert {r[0] for r in df.select(serialize.index_name("millrace")).collect()} == {"millrace-2025.10.09"}


def test_all_configured_sources_are_read(spark, tmp_path):
    from millrace.plans import queries

    columns = "source_id string, transport string, peer_ip string, file_path string, vendor string, product string, parser_hint string"
    spark.createDataFrame([(f"s{i:04}", "udp", f"10.0.{i // 250}.{i % 250}", None, None, None, None) for i in range(1001)], columns).write.parquet(str(tmp_path / "sources.parquet"))
    assert len(queries._sources(spark, str(tmp_path))) == 1001


def test_python_answers_before_the_rows_end(spark):
    """Rows wait in the JVM for what Python answers; were nothing read until the input ends, a whole partition would wait, in the end on disk."""
    now = F.expr("reflect('java.lang.System', 'nanoTime')").cast("bigint")
    df = spark.range(0, 250_000, 1, 1).select(now.alias("taken"), F.lit("x").alias("text"), F.lit(None).cast("string").alias("parser"))
    read = parsers.parse(df, "text", "parser", "r", Config(), parsers.REGISTRY).select("taken", "r", now.alias("back"))
    first, last, lost = read.agg(F.min("back"), F.max("taken"), F.count("r")).first()
    assert first < last and lost == 0
    six = spark.range(0, 250_000, 1, 1).select(now.alias("taken"), F.when(F.col("id") == 7, F.array(F.lit("::1"), F.lit("no:6"))).alias("values"))
    seen = six.select("taken", checks.bad_ipv6(F.col("values")).alias("bad"), now.alias("back"))
    first, last, bad = seen.agg(F.min("back"), F.max("taken"), F.max("bad")).first()
    assert first < last and bad == ["no:6"]
