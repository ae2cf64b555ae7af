"""Random inputs against the standard library and plain recounts."""

import csv
import json
import random
import re

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.config import Config
from millrace.functions import text as X
from millrace.operators import detect, drift, nested, parsers
from millrace.sources.framing import Framer


def parse_all(spark, messages, name, cfg=Config(reference_year=2025)):
    df = spark.createDataFrame([(i, m, name) for i, m in enumerate(messages)], "i int, t string, p string")
    rows = parsers.parse(df, "t", "p", "r", cfg, parsers.REGISTRY).orderBy("i").select(F.to_json("r.fields").alias("f"), F.to_json("r.unknown").alias("u"), "r.original", "r.status").collect()
    return [({e["k"]: e.get("v") for e in json.loads(r["f"])}, {e["k"]: e.get("v") for e in json.loads(r["u"])}, r["status"]) for r in rows]


def test_csv_like_the_standard_library(spark):
    rnd = random.Random(1)
    lines = ["".join(rnd.choice('ab ,,";""x') for _ in range(rnd.randint(1, 14))) for _ in range(400)] + ['"open, to the end', 'a,"b ""c"" d",e', '"a"b,c', ",", '""']
    lines = [x for x in lines if "," in x and x.count(",") >= x.count(";")]
    # quotes that close and open again within one field are left out: no writer makes them
    lines = [x for x in lines if not re.search(r'(?:^|,)"(?:[^"]|"")*"[^,"]*"', x)]
    for line, (fields, _, status) in zip(lines, parse_all(spark, lines, "csv")):
        want = next(csv.reader([line]))
        assert [fields[f"col_{i + 1}"] for i in range(len(want))] == want and len(fields) == len(want), line
        assert status == "PARTIAL"
    for d in "|^]\\":
        got = parse_all(spark, [f'a{d}"b{d}c"{d}d'], "csv", Config(reference_year=2025, csv_delimiter=d))
        assert list(got[0][0].values()) == ["a", f"b{d}c", "d"]


def test_key_values_keep_every_token(spark):
    rnd = random.Random(2)
    words = ["a=1", "b=", 'c="x y"', 'd="q \\"r\\" \\\\"', "loose", "=x", "9z=1", 'e="open', "a=2", "f.g-h_1=ü", "k=v=w"]
    lines = [(" " * rnd.randint(1, 3)).join(rnd.choice(words) for _ in range(rnd.randint(2, 12))) for _ in range(300)]
    token = re.compile(r'([A-Za-z][A-Za-z0-9_.\-]*)=("(?:[^"\\]|\\.)*"|\S*)|([^ ]+)')
    for line, (fields, unknown, status) in zip(lines, parse_all(spark, lines, "key_value")):
        pairs, loose, seen = {}, [], {}
        for m in token.finditer(line):
            if m[3]:
                loose.append(m[3])
                continue
            seen[m[1]] = seen.get(m[1], 0) + 1
            v = m[2]
            if len(v) > 1 and v[0] == v[-1] == '"':
                v = v[1:-1].replace('\\"', '"').replace("\\\\", "\\")
            pairs[m[1] if seen[m[1]] == 1 else f"{m[1]}#{seen[m[1]]}"] = v
        if len(pairs) < 2:
            assert status == "FAILED"
            continue
        assert not fields and unknown == {f"kv.{k}": v for k, v in pairs.items()} | {f"kv.unpaired_{i}": t for i, t in enumerate(loose)}, line


def test_cef_extension_scan(spark):
    rnd = random.Random(3)
    parts = ["src=1.1.1.1", "x=a b", "y=a\\=b", "z=c\\nd", "lone", "x=again", "w=", "p.q=7 ", "e=back\\\\"]
    exts = [" ".join(rnd.choice(parts) for _ in range(rnd.randint(1, 9))) for _ in range(200)]

    def scan(ext):
        cuts, i = [0], 0
        while i < len(ext):
            if ext[i] == "\\":
                i += 2
                continue
            if ext[i] == " " and re.match(r"[A-Za-z0-9_.]+=", ext[i + 1 :]):
                cuts.append(i + 1)
            i += 1
        segs = [ext[a:b] for a, b in zip(cuts, cuts[1:] + [len(ext)])]
        return [s[:-1] if n < len(segs) - 1 and s.endswith(" ") else s for n, s in enumerate(segs)]

    unescape = lambda v: re.sub(r"\\(.)", lambda m: {"=": "=", "\\": "\\", "n": "\n", "r": "\r"}.get(m[1], m[0]), v)
    for ext, (fields, unknown, _) in zip(exts, parse_all(spark, ["CEF:0|a|b|c|d|e|5|" + e for e in exts], "cef")):
        want, seen, loose = {}, {}, 0
        for s in scan(ext.rstrip()):  # a message without a prefix is stripped
            m = re.match(r"([A-Za-z0-9_.]+)=(.*)", s, re.S)
            if not m:
                want[f"cef.ext.unpaired_{loose}"] = s
                loose += 1
                continue
            seen[m[1]] = seen.get(m[1], 0) + 1
            if m[1] != "src" or seen[m[1]] > 1:
                want[f"cef.ext.{m[1]}" + (f"#{seen[m[1]]}" if seen[m[1]] > 1 else "")] = unescape(m[2])
        assert {k: v for k, v in unknown.items() if v != ""} == {k: v for k, v in want.items() if v != ""}, ext


@given(st.lists(st.binary(min_size=1, max_size=30), min_size=1, max_size=20), st.lists(st.integers(1, 40), max_size=30))
def test_octet_frames_whatever_the_chunks(frames, cuts):
    data, got, f = b"".join(b"%d " % len(x) + x for x in frames), [], Framer(100)
    for n in [*cuts, len(data)]:
        got += f.feed(data[:n])
        data = data[n:]
    assert got == frames and not f.error


@given(st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=5), lambda c: st.lists(c, max_size=4) | st.dictionaries(st.text(min_size=1, max_size=3), c, max_size=4), max_leaves=20))
def test_nodes_point_at_objects(doc):
    def at(pointer):
        v = nested._untext(doc)
        for step in pointer.split("/")[1:]:
            v = nested._untext(v)
            v = v[int(step)] if isinstance(v, list) else v[step.replace("~1", "/").replace("~0", "~")]
        return nested._untext(v)

    got = nested.nodes_of(doc, frozenset())
    assert all(isinstance(at(n), dict) for n, *_ in got) and len({n for n, *_ in got}) == len(got)
    assert all(p == "" or n.startswith(p + "/") for n, p, *_ in got) and {p for _, p, *_ in got} <= {n for n, *_ in got} | {""}


@given(st.dictionaries(st.text(max_size=4), st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=4) | st.lists(st.integers(), max_size=3), max_size=6))
def test_cells_say_what_the_object_says(obj):
    got = {f: (k, v) for f, k, v in drift.cells_of(json.dumps(obj))}
    assert {f: v if k in ("text", None) else json.loads(v) for f, (k, v) in got.items()} == obj


def test_detection_of_blank_parts(spark):
    cases = {"a;b": "csv", "a; ;b": "plain_text", ";a": "plain_text", "a,b": "csv", "a, b": "plain_text", "a,,b": "plain_text", "a;,b": "csv", "a; ": "plain_text", "a,b;": "csv", "x\ty": "csv"}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r["t"]: r["f"] for r in df.withColumn("f", detect.detect(F.col("t"))).collect()} == cases
    assert X.SEP not in "".join(cases)
