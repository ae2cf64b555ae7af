from collections import Counter

from pyspark.sql import functions as F

from millrace.functions.ids import event_key, ingest_us
from millrace.operators import dedup, skew

ROWS = "event_id string, ingested_at_unix_utc double, row_id bigint, event_key string, ingest_us string"


def test_identifier_spellings(spark):
    k = "0123456789abcdef0123456789abcdef"
    forms = [k, k.upper(), f" {k}", f"urn:uuid:{k[:8]}-{k[8:12]}-{k[12:16]}-{k[16:20]}-{k[20:]}", "{" + k + "}", f"URN:UUID:{k}"]
    df = spark.createDataFrame([(f,) for f in forms + ["", None, k[:-1], k + "0", "g" + k[1:]]], "s string")
    got = [r[0] for r in df.select(F.lower(F.hex(event_key(F.col("s"))))).collect()]
    assert got == [k] * 6 + [None] * 5


def test_ingest_units(spark):
    df = spark.createDataFrame([(1759286237.635,), (1759286237635.0,), (1759286237635000.0,), (1759286237635000000.0,), (0.0,), (None,), (float("nan"),), (-1.0,)], "x double")
    assert [r[0] for r in df.select(ingest_us(F.col("x"))).collect()] == [1759286237635000] * 4 + [None] * 4


def test_repeats_against_brute_force(spark):
    ids = ["%032x" % (i % 7 if i % 3 else 1) for i in range(60)]  # one identifier owns a third
    rows = [(ids[i], float(1_700_000_000 + (i * 37) % 11), i, "clash", "clash") for i in range(60)] + [(None, 1.7e9, 100, "", ""), ("bad", 1.7e9, 101, "", ""), (ids[1], None, 102, "", "")]
    first = {}
    for e, t, r, *_ in rows:
        if e and len(e) == 32:
            first[e] = min(first.get(e, (9e99, 0)), (9e98 if t is None else t, r))
    want = sorted(r for e, t, r, *_ in rows if e and len(e) == 32 and (9e98 if t is None else t, r) != first[e])
    df = spark.createDataFrame(rows, ROWS)
    for runs in (1, 2, 5):
        assert sorted(r["row_id"] for r in dedup.repeats(df, runs).collect()) == want
    assert dedup.repeats(df.limit(0)).count() == 0


def test_upsert_is_idempotent_and_compaction_does_not_shuffle(spark):
    df = dedup.copies(spark.createDataFrame([("%032x" % (i % 5), 1e9 + i, i, "", "") for i in range(20)], ROWS))
    for buckets in (None, 4):
        store = dedup.BucketStore(spark, buckets=buckets)
        store.upsert(df)
        store.upsert(df.where("row_id > 3"))
        store.upsert(df)
        spark.conf.set(dedup._ORDER, "true")
        plan = store._merged(store.runs[0][1], store.runs[1][1])._jdf.queryExecution().sparkPlan().toString() + store._merged(store.runs[0][1], store.runs[1][1])._jdf.queryExecution().executedPlan().toString()
        spark.conf.unset(dedup._ORDER)
        assert "SortMergeJoin" in plan and "Exchange" not in plan and "+- Sort " not in plan
        store.compact()
        store.upsert(df)
        assert sorted((r["row_id"]) for r in store.compact().collect()) == [0, 1, 2, 3, 4]
    assert dedup.BucketStore(spark).compact().count() == 0
    assert dedup.BucketStore(spark, rows=dedup.BUCKET_ROWS * 50).buckets == 50


def test_skew_per_key(spark):
    rows = [("hot", f"v{i % 4}", i) for i in range(50)] + [(None, "v", 7), ("cold", None, 3), ("cold", "x", 1)]
    df = spark.createDataFrame(rows, "k string, v string, t bigint").withColumn("n", F.lit("clash")).withColumn("field", F.lit("clash"))
    c = skew.compress(df, ["k"], "v", "t")
    got = {r["key_value"]: (r["n_rows"], r["n_values"], r["last"]) for r in skew.per_key(c).collect()}
    assert got == {"hot": (50, 4, 49), None: (1, 1, 7), "cold": (2, 1, 3)}
    assert [(r["field"], r["key_value"]) for r in skew.heavy(skew.per_key(c), len(rows), 0.04).collect()] == [("k", "hot")]
    assert skew.heavy(skew.per_key(skew.compress(df.limit(0), ["k"], "v")), 0, 0.04).count() == 0
    modes = {r["key_value"]: (r["mode"], r["mode_rows"]) for r in skew.modes(c).collect()}
    top = Counter(v for k, v, _ in rows if k == "hot")
    assert modes["hot"] == (min(v for v, n in top.items() if n == max(top.values())), max(top.values()))
    numbers = skew.compress(spark.createDataFrame([("a", x) for x in [1, 1, 2, 3, 10]], "k string, v bigint"), ["k"], "v")
    assert skew.percentiles(numbers, [0.5]).first()["percentiles"] == [2.0]
