"""The contract: names, columns, and that SQL and query tell the same at the smallest size."""

import glob
import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUICK = ["p1_found", "p1_accounted", "p2_found", "p4_found", "p5_closings", "ids_unique", "p3_found", "p3_keys", "p3_sizes", "p6_found", "p6_kept", "detect_documents", "detect_telemetry", "source_configured", "delivery_pending", "frame_octet", "decode_latin1", "csv_delimiter", "plain_stats", "bulk_outcome"]


def test_names():
    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q)
    assert {f"p{n}_found" for n in range(1, 8)} <= set(q)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", QUICK)
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    want = con.execute(entry.oracle_sql()[name])
    cols = sorted(d[0] for d in want.description)
    order = [[d[0] for d in want.description].index(c) for c in cols]
    df = entry.queries()[name](spark, SF)
    assert sorted(df.columns) == cols
    assert sorted(repr(tuple(r)) for r in df.select(*cols).collect()) == sorted(repr(tuple(r[i] for i in order)) for r in want.fetchall())


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_found_columns(spark):
    want = {
        "p1_found": "file_id bigint, layer string, change string, field string, old_field string", "p2_found": "file_path string, first_line bigint, entry_ts string, level string, component string, message_md5 string",
        "p3_found": "field string, key_value string", "p4_found": "event_id string, field string, node string, parent string", "p5_found": "event_id string, kind string",
        "p6_found": "event_id string, row_id bigint", "p7_found": "event_id string, event_us bigint", "p8_found": "capacity bigint, doc_id bigint", "p9_found": "doc_id bigint, item_id bigint", "p10_found": "doc_id bigint",
    }
    for name, f in entry.queries().items():
        if name in want:
            assert ", ".join(f"{c} {t}" for c, t in f(spark, SF).dtypes) == want[name]
