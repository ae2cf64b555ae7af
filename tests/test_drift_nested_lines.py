import json

from pyspark.sql import functions as F

from millrace.operators import drift, loglines, nested

FILES = "file_id bigint, stream_id bigint, product string, opened_at timestamp, ord string"
SPOOL = "spool_row_id bigint, file_id bigint, vendor_fields string, unknown_fields string, layer string, field string, place string, kind string"


def changes(spark, files, rows):
    f = spark.sql("SELECT * FROM VALUES " + ",".join(f"({i}, {s}, 'p', timestamp '{t}', 'clash')" for i, s, t in files) + " AS t(file_id, stream_id, product, opened_at, ord)")
    r = spark.createDataFrame([(i, fid, v, u, *["clash"] * 4) for i, (fid, v, u) in enumerate(rows)], SPOOL)
    return sorted(tuple(x) for x in drift.changes(f, r).select("file_id", "layer", "change", "field", "old_field").collect())


def test_changes(spark):
    files = [(5, 1, "2025-01-01"), (2, 1, "2025-01-02"), (9, 2, "2025-01-01"), (7, 1, "2025-01-03")]
    old = [(5, json.dumps({"a": f"x{i}", "b": i, "gone": True, "n": None}), None) for i in range(4)] * 2  # repeated rows
    new = [(2, json.dumps({"A": f"x{i}", "b": i + 0.5, "fresh": [1]}), "{}") for i in range(4)] + [(2, '{"b": "?"}', "not json"), (2, None, None), (2, "[1]", '{"u": 1}')]
    assert changes(spark, files, old + new + [(9, '{"z": 1}', None), (None, '{"z": 1}', None), (77, '{"z": 1}', None)]) == [
        (2, "unknown_fields", "added", "u", ""), (2, "vendor_fields", "added", "fresh", ""), (2, "vendor_fields", "removed", "gone", ""), (2, "vendor_fields", "removed", "n", ""),
        (2, "vendor_fields", "renamed", "A", "a"), (2, "vendor_fields", "retyped", "b", ""),
        (7, "unknown_fields", "removed", "u", ""), (7, "vendor_fields", "removed", "A", ""), (7, "vendor_fields", "removed", "b", ""), (7, "vendor_fields", "removed", "fresh", ""),
    ]


def test_changes_of_nothing(spark):
    assert changes(spark, [(1, 1, "2025-01-01")], []) == []


def test_cells():
    got = dict((f, (k, v)) for f, k, v in drift.cells_of('{"t": "5", "w": 5, "d": 5.0, "e": 1e5, "b": false, "a": [2, 1], "o": {"y": 1, "x": 2.50}, "n": null}'))
    assert got == {
        "t": ("text", "5"), "w": ("whole", "5"), "d": ("decimal", "5.0"), "e": ("decimal", "1e5"), "b": ("boolean", "false"), "a": ("array", "[2,1]"), "o": ("object", '{"x":2.50,"y":1}'), "n": (None, None),
    }
    assert drift.cells_of('{"a": "\\ud800x", "b": 1} then text') == [("a", "text", "\ufffdx"), ("b", "whole", "1")]
    assert drift.cells_of(None) == drift.cells_of("") == drift.cells_of("[1]") == drift.cells_of("{") == []


def test_built_in_cells_say_what_python_says(spark):
    objects = [
        '{"t": "5", "w": 5, "d": 5.0, "f": 2.50, "b": false, "a": [2, {"y": 1, "x": "q\\"u"}], "o": {"y": 1, "x": [null]}, "n": null, "é": "\\u00e9\\n", "": ""}',
        '{"a": 1, "a": "two"}', '{"e": 1e5}', '{"long": 0.12345678901234567890}', '{"big": 123456789012345678901234567890123456789012345}', '{"x": NaN}', '{"o": {"x": 1, "x": 2}}', '{"s": "\\ud800"}',
        '{"a": 1} {"b": 2}', '{"a": 1', "{'a': 1}", "[1]", "null", '"s"', "", " ", None, "{}", ' {"a": 9223372036854775808}', '{"a": ' + "9" * 2000 + "}", '{"a": "' + "x" * 300_000 + '"}', "[" * 3000, '{"a": "\t"}',
    ]
    df = spark.createDataFrame([(i, o, "clash") for i, o in enumerate(objects)], "id int, unknown_fields string, kind string")
    got = {i: [] for i in range(len(objects))}
    for r in drift.cells(df, ["id"], ["unknown_fields"]).collect():
        got[r["id"]].append((r["field"], r["kind"], r["value"]))
    number = lambda k, v: float(v) if k == "decimal" else json.loads(v) if k in ("array", "object") else v
    for i, o in enumerate(objects):
        same = lambda cells: sorted((f, k or "", str(number(k, v))) for f, k, v in cells)
        assert same(got[i]) == same(drift.cells_of(o)), o
    exact = {(i, c[0]): c[2] for i, cs in got.items() for c in cs}
    assert exact[3, "long"] == "0.12345678901234567890" and exact[2, "e"] == "1e5" and len(exact[4, "big"]) == 45


def test_typed_table_accounts_for_every_cell(spark):
    f = spark.sql("SELECT * FROM VALUES (1, 1, timestamp '2025-01-01'), (2, 1, timestamp '2025-01-02'), (3, 1, timestamp '2025-01-03') AS t(file_id, stream_id, opened_at)")
    rows = [(1, 1, '{"a": "x", "b": 1, "n": null}'), (2, 2, '{"a": 5, "b": 2.5, "new": true}'), (3, 3, '{"a": "y", "b": 0.5, "new": false}'), (4, 3, '{"a": "z", "b": "?"}'), (5, 3, None)]
    df = spark.createDataFrame([(*r, None, "clash", "clash") for r in rows], "spool_row_id bigint, file_id bigint, vendor_fields string, unknown_fields string, target string, how string")
    t = {(r["spool_row_id"], r["field"]): r for r in drift.typed(f, df, ["spool_row_id"]).collect()}
    assert {k: r["how"] for k, r in t.items()} == {
        (1, "a"): "held", (1, "b"): "replayed", (1, "n"): None, (2, "a"): "rescued", (2, "b"): "replayed", (2, "new"): "replayed",
        (3, "a"): "replayed", (3, "b"): "held", (3, "new"): "held", (4, "a"): "replayed", (4, "b"): "rescued",
    }
    assert t[1, "b"]["as_decimal"] == 1.0 and t[2, "a"]["rescued"] == "5" and t[4, "b"]["rescued"] == '"?"' and t[2, "new"]["as_boolean"] is True
    assert drift.typed(f, df.limit(0), ["spool_row_id"]).count() == drift.typed(f.limit(0), df, ["spool_row_id"]).count() == 0


def test_rescue_promote_replay(spark):
    rows = [(1, '{"a": "x", "b": 5, "new": [1]}'), (2, '{"a": 7, "b": "five", "c \\"q\\"": 1.5}'), (3, None), (4, '{"b": null}')]
    df = spark.createDataFrame(rows, "id bigint, vendor_fields string")
    t = drift.ingest(df, {"a": "text", "b": "whole"}, ["id"])
    got = {r["id"]: (r["a"], r["b"], r["_rescued"] and json.loads(r["_rescued"])) for r in t.collect()}
    assert got == {1: ("x", 5, {"new": [1]}), 2: (None, None, {"a": 7, "b": "five", 'c "q"': 1.5}), 3: (None, None, None), 4: (None, None, None)}
    again = {r["id"]: (r["a"], r["new"], r["_rescued"] and json.loads(r["_rescued"])) for r in drift.replay(t, {"new": "array"}).collect()}
    assert again[1] == ("x", "[1]", None) and again[2][2] == {"a": 7, "b": "five", 'c "q"': 1.5}


def test_what_does_not_cast_without_loss_is_rescued(spark):
    values = [("whole", "whole", "9" * 39), ("whole", "whole", "9" * 38), ("decimal", "whole", "9007199254740993"), ("decimal", "whole", "5"), ("decimal", "decimal", "0.1234567890123456789"), ("decimal", "decimal", "2.50"),
              ("decimal", "decimal", "1e999"), ("whole", "text", "x"), ("text", "text", "x"), ("object", "object", "{}"), ("text", None, None)]
    df = spark.createDataFrame([(i, *v) for i, v in enumerate(values)], "id int, target string, kind string, value string")
    rows = drift.enforce(df, ["id"]).orderBy("id").collect()
    assert [r["id"] for r in rows if r["rescued"] is not None] == [0, 2, 4, 6, 7]
    assert all((r["rescued"] is None) == any(r[c] is not None for c in ("as_text", "as_whole", "as_decimal", "as_boolean", "as_json")) for r in rows[:-1])
    t = drift.ingest(spark.createDataFrame([(1, '{"a": 9007199254740993}')], "id bigint, vendor_fields string"), {"a": "decimal"}, ["id"]).first()
    assert (t["a"], json.loads(t["_rescued"])) == (None, {"a": 9007199254740993})


def test_nodes(spark):
    problems = "array<struct<field:string,problem:string,value:string>>"
    rows = [
        (1, '{"as": [{"t": 1, "os": [{"x": 1}, null, {"y": {"z": [1, 2]}}]}, 5, "{\\"t\\": 2}"], "s/~": {"k": [{"v": 1}]}}', [("f", "p", '{"ctx": [{"a": 1}]}'), None, ("g", "p", "17")]),
        (2, '{"as": {"t": 3, "os": {"x": 2}}}', None),
        (2, '{"as": [{"t": "another copy"}]}', None),
        (3, None, []), (4, "not json", None), (5, '{"as": "[{\\"t\\": 1}]", "m": [[{"q": 1}]]}', None),
    ]
    df = spark.createDataFrame([(f"{i:032x}", 1e9 + n, n, v, p, "clash") for n, (i, v, p) in enumerate(rows)], f"event_id string, ingested_at_unix_utc double, row_id bigint, vendor_fields string, validation_problems {problems}, node string")
    got = sorted((int(r["k"], 16), r["field"][0], r["node"], r["parent"]) for r in nested.nodes(df).withColumn("k", F.hex("event_key")).collect())
    assert got == [
        (1, "v", "/0", ""), (1, "v", "/0/value/ctx/0", "/0"), (1, "v", "/2", ""),
        (1, "v", "/as/0", ""), (1, "v", "/as/0/os/0", "/as/0"), (1, "v", "/as/0/os/2", "/as/0"), (1, "v", "/as/2", ""), (1, "v", "/s~1~0/k/0", ""),
        (2, "v", "/as/0", ""), (2, "v", "/as/0/os/0", "/as/0"),
        (5, "v", "/as/0", ""), (5, "v", "/m/0/0", ""),
    ]
    attrs = {(r["table"], r["node"]): json.loads(r["attrs"]) for r in nested.rows(df).collect() if r["field"] == "vendor_fields"}
    assert attrs[("/as/os", "/as/0/os/2")] == {"y/z": [1, 2]}
    assert nested.nodes(df.limit(0)).count() == nested.rows(df.limit(0)).count() == 0


def records(spark, docs):
    problems = "array<struct<field:string,problem:string,value:string>>"
    return spark.createDataFrame([(f"{i:032x}", 1e9, i, d, None, "clash") for i, d in enumerate(docs)], f"event_id string, ingested_at_unix_utc double, row_id bigint, vendor_fields string, validation_problems {problems}, table string")


def test_tables_are_shared_as_the_graph_says(spark):
    docs = [
        '{"id": 7, "meta": {"site": "x", "deep": {"on": true}}, "arr": [{"x": 1}], "children": [{"n": "a", "children": [{"n": "b", "sub": {"children": [{"n": "c"}]}}]}]}',
        '{"id": 8, "left": {"owners": [{"team": "t"}]}, "right": [{"owners": [{"team": "u"}, null, {"team": null}], "x": 2.5}]}', '{"only": "scalars"}', "{}",
    ]
    df = records(spark, docs)
    got = sorted((r["table"], r["node"], r["parent"]) for r in nested.rows(df).collect() if r["node"])
    assert got == [
        ("/arr", "/arr/0", ""), ("/children", "/children/0", ""), ("/children", "/children/0/children/0", "/children/0"), ("/children", "/children/0/children/0/sub/children/0", "/children/0/children/0"),
        ("/right", "/right/0", ""), ("owners", "/left/owners/0", ""), ("owners", "/right/0/owners/0", "/right/0"), ("owners", "/right/0/owners/2", "/right/0"),
    ]
    t = {name: df for (field, name), df in nested.flat_tables(df).items() if field == "vendor_fields"}
    assert set(t) == {nested.ROOT, "/arr", "/children", "/right", "owners"}
    roots = {r["id"]: (r["meta/site"], r["meta/deep/on"], r["only"]) for r in t[nested.ROOT].where("id IS NOT NULL").collect()}
    assert roots == {7: ("x", True, None), 8: (None, None, None)} and t[nested.ROOT].count() == 4
    assert [r["x"] for r in t["/right"].collect()] == [2.5] and t["owners"].where("team IS NOT NULL").count() == 2 and sorted(r["n"] for r in t["/children"].collect()) == ["a", "b", "c"]


def test_members_that_look_alike_are_kept_apart(spark):
    docs = ['{"r": [{"a": {"b": [2]}, "a.b": 1, "a/b": 3}]}', '{"r": [{"a.b": "t", "l": [[1, null], [2], 3]}]}', '{"a": 1, "arr": [{"x": 1}]}']
    got = {r["node"] + str(i): json.loads(r["attrs"]) for i, d in enumerate(docs) for r in nested.rows(records(spark, [d])).collect()}
    assert got["/r/00"] == {"a/b": [2], "a.b": 1, "a~1b": 3} and got["/r/01"]["a.b"] == "t" and sorted(map(str, got["/r/01"]["l"])) == ["1", "2", "3", "None"]
    assert got["2"] == {"a": 1} and got["/arr/02"] == {"x": 1}


def test_an_events_nodes_are_its_first_copys(spark):
    df = records(spark, ["{}", '{"r": [{"x": 1}]}']).withColumn("event_id", F.lit("0" * 32))
    assert nested.nodes(df).count() == 0


def test_header_lines():
    p = loglines.parse_line
    assert p("<171>1 2025-12-24T15:27:32.5Z h gatekeeperd 789 - [origin ip=\"1.2.3.4\"] retry [spool] - x") == ("2025-12-24T15:27:32.5Z", "err", "gatekeeperd", "retry [spool] - x")
    assert p("Nov  2 03:55:39 h quillproxy[3328]: hi: x") == ("Nov  2 03:55:39", "", "quillproxy", "hi: x")
    assert p("2025-11-19 02:45:57,131 WARN  [worker-19] net.brine.Writer - a - b") == ("2025-11-19 02:45:57,131", "warning", "net.brine.Writer", "a - b")
    assert p("[2025-11-03T01:51:14+01:00] ingest.carrier/CRITICAL: m") == ("2025-11-03T01:51:14+01:00", "crit", "ingest.carrier", "m")
    assert p("11/3/2025 3:17:29 AM;Verbose;LeaseSvc;m, n") == ("11/3/2025 3:17:29 AM", "debug", "LeaseSvc", "m, n")
    assert p("F1119 04:06:00.733732  2310 frame_cut.cc:311] m") == ("1119 04:06:00.733732", "crit", "frame_cut.cc", "m")
    assert p("2025/11/02 04:11:32 [info] leasemon: m") == ("2025/11/02 04:11:32", "info", "leasemon", "m")
    assert p("1762054515.726 [notice] (tidesync) m") == ("1762054515.726", "notice", "tidesync", "m")
    assert p("1762054515.726 [notice] retry 1 of 9 [spool] - (x) m") == ("1762054515.726", "notice", "", "retry 1 of 9 [spool] - (x) m")
    assert p("1762054515 [err]") == ("1762054515", "err", "", "") and p("1762054515.7 [err]x") is None
    assert p('{"severity": 4, "@timestamp": "t1", "component": "c", "msg": "a\\nb"}') == ("t1", "warning", "c", "a\nb")
    assert p('level=err time=2025-12-24T12:49:59.808Z component=q msg="a \\"b\\""') == ("2025-12-24T12:49:59.808Z", "err", "q", 'a "b"')
    for line in (None, "", "  ", "\tat x.y", "  > 2025-11-02 22:35:55,812 ERROR [main] a.B - x", "{", '{"n": 1}', "WHERE state = 'x'", "Traceback (most recent call last):", "a" * 200_000):
        assert p(line) is None


def test_entries(spark):
    lines = [
        ("/f", 1, "orphan"), ("/f", 2, "Nov  2 03:55:39 h a: one"), ("/f", 2, None), ("/f", 2, "Nov  2 03:55"), ("/f", 2, "Nov  2 03:55:39 h a: one"), ("/f", 3, "  two"), ("/f", 4, None), ("/f", 5, "three  "), ("/f", 6, ""),
        ("/f", 20_000, "Nov  2 03:55:40 h a: far"), ("/f", 20_001, "tail"), ("/g", 1, "tail of nothing"), (None, 1, "Nov  2 03:55:40 h a: x"), ("/h", None, "Nov  2 03:55:40 h a: x"),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in lines], "file_path string, file_line_number bigint, raw_message string, n string").orderBy(F.rand(1))
    got = sorted((r["file_path"], r["first_line"], r["component"], r["message"]) for r in loglines.entries(df).collect())
    assert got == [("/f", 2, "a", "one\n  two\n\nthree"), ("/f", 20_000, "a", "far\ntail")]
    assert loglines.entries(df.limit(0)).count() == 0


def test_entry_carries_over_blocks(spark):
    n = loglines.BLOCK * 3
    df = spark.range(1, n).select(F.lit("/f").alias("file_path"), F.col("id").alias("file_line_number"), F.when(F.col("id") == 5, "Nov  2 03:55:39 h a: x").otherwise("c").alias("raw_message"))
    got = loglines.with_entry(loglines.parsed_lines(df))
    assert got.where("first_line = 5").count() == n - 5 and got.where("first_line IS NULL").count() == 4
