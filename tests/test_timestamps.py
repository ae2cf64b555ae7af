import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import late, timestamps

US = 1_000_000
TELEMETRY = "event_id string, ingested_at_unix_utc double, row_id bigint, source_name string, peer_ip string, file_path string, raw_message string, zone string, stamp string"
SOURCES = "source_id string, peer_ip string, file_path string, time_zone string"


def us(text):
    return int(dt.datetime.fromisoformat(text).replace(tzinfo=dt.timezone.utc).timestamp()) * US


@pytest.mark.parametrize(
    "message, layout, wall, offset",
    [
        ("2025-10-01 02:37:04,705 relayd up", "iso", us("2025-10-01T02:37:04") + 705_000, None),
        ('{"@timestamp":"2025-10-01T04:19:21+02:00"}', "iso_zoned", us("2025-10-01T04:19:21"), 7200),
        ('{"t":"2025-10-01T04:19:21.123456789Z"}', "iso_zoned", us("2025-10-01T04:19:21") + 123_456, 0),
        ('date=2025-09-30 time=20:46:34 tz="-0430" logid=1', "pair_zoned", us("2025-09-30T20:46:34"), -16_200),
        ("10.0.0.1 - a [01/Oct/2025:02:22:39 +0000] \"GET\"", "clf", us("2025-10-01T02:22:39"), 0),
        ("01.10.2025 04:20:23 tidesync up", "dot", us("2025-10-01T04:20:23"), None),
        ("20251001073713 leasemon up", "compact", us("2025-10-01T07:37:13"), None),
        ('ts="20251001T120001Z" user=a', "compact", us("2025-10-01T12:00:01"), 0),
        ("eventtime=1759283899793715638 logid=1535353849", "epoch_ns", 1759283899793715, 0),
        ("a rt=1760028722454 b=1", "epoch_ms", 1760028722454000, 0),
        ('{"time": 1759305680}', "epoch_s", 1759305680 * US, 0),
        ("1759298425.220 foldagent up", "epoch_s", 1759298425220000, 0),
        ("<1>Oct 01 2025 18:11:25 h x", "named", us("2025-10-01T18:11:25"), None),
        ("<129>Nov 34 26:70:15 h CEF:0|a|b|c|d|e|1|rt=1760028722454", "epoch_ms", 1760028722454000, 0),
        ("0000-00-00 00:00:00 then 2025-10-01 00:00:00 CDT x", "iso", us("2025-10-01T00:00:00"), None),
    ],
)
def test_layouts(message, layout, wall, offset):
    got = timestamps.read_stamp(message, us("2025-10-05T00:00:00"))
    assert (got[0], got[1][0][1], got[2]) == (layout, wall, offset)


@pytest.mark.parametrize("message", [None, "", "n/a", "Xyz 12 04:10:22 x", "logid=1535353849 n=1759283899", "2025-13-01T00:00:00Z", "02/30/2025 10:00:00", "1.2.3.4 10:00", "Feb 30 10:00:00 x"])
def test_no_time(message):
    assert timestamps.read_stamp(message, None) is None


def test_readings_of_ambiguous_stamps():
    assert [r for r, _ in timestamps.read_stamp("03/04/2025 10:00:00", None)[1]] == ["month_first", "day_first"]
    assert [r for r, _ in timestamps.read_stamp("13/04/2025 10:00:00 x", None)[1]] == ["day_first"]
    assert timestamps.read_stamp("4/13/2025 12:00:01 AM;x", None)[1] == [("month_first", us("2025-04-13T00:00:01"))]
    years = [r for r, _ in timestamps.read_stamp("Feb 29 10:00:00 h x", us("2027-03-01T00:00:00"))[1]]
    assert "year+1" in years and "year-3" in years


def resolved(spark, rows, sources=()):
    full = [(r + (None,) * 9)[:7] + ("clash", "clash") for r in rows]
    out = timestamps.event_times(spark.createDataFrame(full, TELEMETRY), spark.createDataFrame(list(sources), SOURCES))
    return {r["k"]: r for r in out.withColumn("k", F.lower(F.hex("event_key"))).collect()}


def test_first_copy_zone_and_rule(spark):
    a, b, c, e, g, h = ("%032x" % i for i in range(1, 7))
    at = us("2025-11-02T12:00:00") / US
    rows = [
        (a.upper(), at, 2, "s", None, None, "2025-11-02 01:30:00 CDT x"),  # repeated hour: the later one not after ingestion
        (f"urn:uuid:{a[:8]}-{a[8:12]}-{a[12:16]}-{a[16:20]}-{a[20:]}", (at - 19_900) * 1000, 1, "s", None, None, "2025-11-02 01:30:00 CDT x"),  # the first copy, in ms
        (b, at, 3, None, "1.1.1.1", None, "2026-03-08 02:30:00 x"),  # skipped hour: offset before the change
        (c, at, 4, "unknown", None, "/f", "Nov  2 11:00:00 h x"),
        (e, at, 5, None, None, None, "11/02/2025 10:00:00 x"),
        (g, None, 6, None, None, None, "2025-01-01 00:00:00 x"),
        (h, at, 7, None, None, None, None),
        ("no id", at, 8, None, None, None, "2025-01-01 00:00:00 x"),
        (None, at, 9, None, None, None, "2025-01-01 00:00:00 x"),
    ]
    got = resolved(spark, rows, [("s", None, None, "America/Chicago"), ("p", "1.1.1.1", None, "America/Chicago"), ("f", None, "/f", None)])
    assert set(got) == {a, b, c, e, g}
    assert got[a]["row_id"] == 1 and got[a]["n_readings"] == 2
    assert got[a]["event_us"] == us("2025-11-02T06:30:00")  # ingested at 06:28:20: no reading is before, the earliest counts
    assert got[b]["event_us"] == us("2026-03-08T08:30:00")
    assert got[c]["event_us"] == us("2025-11-02T11:00:00")
    assert got[e]["event_us"] == us("2025-11-02T10:00:00")
    assert got[g]["event_us"] == us("2025-01-01T00:00:00") and got[g]["ingest_us"] is None


def test_em_prefers_what_a_source_writes(spark):
    at = us("2025-12-31T00:00:00") / US
    sure = [("%032x" % i, at, i, "s", None, None, f"{13 + i % 10}/11/2025 10:00:00 x") for i in range(40)]
    got = resolved(spark, sure + [("f" * 32, at, 99, "s", None, None, "05/11/2025 10:00:00 x")], [("s", None, None, None)])
    r = got["f" * 32]
    assert r["n_readings"] == 2 and r["event_us"] == us("2025-11-05T10:00:00") == r["likeliest_us"] and r["posterior"] > 0.9 and r["clear"]


def test_the_posterior_chooses_where_the_rule_does_not(spark):
    at = us("2025-01-02T00:00:00") / US
    sure = [("%032x" % i, us("2025-12-31T00:00:00") / US, i, "s", None, None, f"{13 + i % 10}/11/2025 10:00:00 x") for i in range(40)]
    got = resolved(spark, sure + [("f" * 32, at, 99, "s", None, None, "05/11/2025 10:00:00 x"), ("e" * 32, None, 98, "s", None, None, "06/11/2025 10:00:00 x")], [("s", None, None, None)])
    # every reading lies after ingestion: the source writes the day first, so the later of the two counts
    assert got["f" * 32]["event_us"] == us("2025-11-05T10:00:00") and not got["f" * 32]["by_rule"]
    assert got["e" * 32]["event_us"] == us("2025-11-06T10:00:00")


def instants(wall, zone):
    """Every instant (us) at which the zone's clock shows the wall time; a skipped one by the offset before the change."""
    both = {int((wall.replace(tzinfo=zone, fold=f).astimezone(dt.timezone.utc) - EPOCH) / dt.timedelta(microseconds=1)) for f in (0, 1)}
    shown = {x for x in both if (EPOCH + dt.timedelta(microseconds=x)).astimezone(zone).replace(tzinfo=None) == wall}
    return shown or {int((wall.replace(tzinfo=zone, fold=0).astimezone(dt.timezone.utc) - EPOCH) / dt.timedelta(microseconds=1))}


EPOCH = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)


def written(rnd, at, zone):
    """(text, every instant it may mean) of an instant, in a random layout."""
    utc = EPOCH + dt.timedelta(microseconds=at)
    wall = utc.astimezone(zone).replace(tzinfo=None)
    sec = wall.replace(microsecond=0)
    kind = rnd.randrange(10)
    if kind == 0:
        return sec.strftime("%Y-%m-%d %H:%M:%S"), instants(sec, zone)
    if kind == 1:
        off = rnd.choice([-570, -240, 0, 60, 345])
        own = (utc + dt.timedelta(minutes=off)).replace(tzinfo=None)
        return own.strftime("%Y-%m-%dT%H:%M:%S.%f") + f"{'-' if off < 0 else '+'}{abs(off) // 60:02}:{abs(off) % 60:02}", {at}
    if kind == 2:
        years = [y for y in range(2015, 2029) if y % 4 == 0 or (sec.month, sec.day) != (2, 29)]
        return sec.strftime("%b ") + f"{sec.day:>2}" + sec.strftime(" %H:%M:%S"), {x for y in years for x in instants(sec.replace(year=y), zone)}
    if kind == 3:
        return sec.strftime("%b %d %Y %H:%M:%S"), instants(sec, zone)
    if kind == 4:
        days = {(sec.month, sec.day), (sec.day, sec.month)} if sec.day <= 12 else {(sec.month, sec.day)}
        text = f"{sec.month}/{sec.day}/{sec.year} {sec.hour % 12 or 12}:{sec:%M:%S} {'AP'[sec.hour // 12]}M"
        return text, {x for mo, d in days for x in instants(sec.replace(month=mo, day=d), zone)}
    if kind == 5:
        return sec.strftime("%d.%m.%Y %H:%M:%S"), instants(sec, zone)
    if kind == 6:
        return sec.strftime("%Y%m%d%H%M%S"), instants(sec, zone)
    if kind == 7:
        return f"date={sec:%Y-%m-%d} time={sec:%H:%M:%S}", instants(sec, zone)
    if kind == 8:
        ms = wall.replace(microsecond=wall.microsecond // 1000 * 1000)
        return ms.strftime("%Y/%m/%d %H:%M:%S,") + f"{ms.microsecond // 1000:03}", instants(ms, zone)
    digits = rnd.choice([0, 3, 6, 9])
    n = at * 1000 // 10 ** (9 - digits)
    return f"ts={n}", {n * 10 ** (9 - digits) // 1000}


def test_any_instant_in_any_layout_against_brute_force(spark):
    from zoneinfo import ZoneInfo

    rnd = random.Random(11)
    zones = ["America/Chicago", "Europe/Berlin", "Australia/Sydney", "Asia/Tokyo", "Europe/London", "America/Sao_Paulo", "Australia/Lord_Howe", "Asia/Kathmandu"]
    near = [us(t) for t in ("2025-03-09T08:00:00", "2025-11-02T07:00:00", "2025-03-30T01:00:00", "2025-10-26T01:00:00", "2025-04-05T16:00:00", "2025-10-04T16:00:00", "2025-01-01T00:00:00", "2024-02-29T12:00:00", "2025-04-05T15:00:00")]
    rows, want = [], {}
    for i in range(1500):
        name = rnd.choice(zones)
        at = rnd.choice(near) + rnd.randrange(-3 * 3600 * US, 3 * 3600 * US) if rnd.random() < 0.6 else us("2024-06-01T00:00:00") + rnd.randrange(500 * 86_400 * US)
        ingested = at + rnd.choice([rnd.randrange(1, 5 * US), rnd.randrange(7200 * US), rnd.randrange(9 * 86_400 * US)])
        ingested = round(ingested / US, 3)
        text, may = written(rnd, at, ZoneInfo(name))
        key = f"{i:032x}"
        rows.append((key, ingested, i, name, None, None, text + rnd.choice(["", " h app: x", ";y"])))
        before = {x for x in may if x <= round(ingested * US)}
        if before:
            want[key] = max(before), text, name
    got = resolved(spark, rows, [(z, None, None, z) for z in zones])
    wrong = [(want[k], got[k]["event_us"] if k in got else None) for k in want if k not in got or got[k]["event_us"] != want[k][0]]
    assert not wrong, (len(wrong), wrong[:5])


def test_empty(spark):
    assert resolved(spark, []) == {}


def test_late_kinds_and_hours(spark):
    end = us("2025-10-01T11:00:00")
    rows = [(f"{i}", s, end - 1, end + d) for i, (s, d) in enumerate([("a", 600 * US), ("a", 600 * US + 1), ("a", 21_600 * US), ("b", 21_600 * US + 1), (None, 0)])]
    df = spark.createDataFrame(rows + [("9", "a", None, end), ("10", "a", end - 1, None)], "event_id string, source_name string, event_us bigint, ingest_us bigint")
    c = late.classify(df)
    assert {r["event_id"]: r["kind"] for r in c.collect()} == {"0": "on_time", "1": "late", "2": "late", "3": "expired", "4": "on_time", "10": "on_time"}
    hours = {r["source_name"]: (r["n_closed"], r["n_late"], r["n_final"], r["n_expired"]) for r in late.hourly(c).collect()}
    assert hours == {"a": (2, 2, 4, 0), "b": (0, 0, 0, 1), None: (1, 0, 1, 0)}


def test_a_source_passes_with_its_first_record_after_the_bound(spark):
    m = 60 * US
    rows = [("a", 10 * m, 65 * m), ("a", 10 * m, 72 * m), ("a", 10 * m, 70 * m), ("b", 10 * m, 20 * m), (None, 5 * m, None), ("c", 10 * m, 500 * m), ("c", 10 * m, 80 * m)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "source_name string, event_us bigint, ingest_us bigint, passed_us string").withColumns({"kind": F.lit("clash"), "hour_us": F.lit("clash")})
    got = {(r["source_name"], r["ingest_us"]): (r["passed_us"] // m, r["kind"]) for r in late.classify(df, idle_s=1800).collect()}
    assert got == {
        ("a", 65 * m): (72, "on_time"), ("a", 72 * m): (72, "late"), ("a", 70 * m): (72, "on_time"), ("b", 20 * m): (100, "on_time"), (None, None): (100, "on_time"),
        ("c", 80 * m): (80, "late"), ("c", 500 * m): (80, "expired"),
    }


@pytest.mark.parametrize("seed", range(3))
def test_watermarks_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    h, bound, idle = late.HOUR, 600, rnd.choice([0, 3600, 20_000])
    clock = [(rnd.choice(["a", "b", None]), rnd.choice([rnd.randrange(60 * h), rnd.randrange(60) * h + bound * US])) for _ in range(40)] + [("a", None)]
    df = spark.createDataFrame(clock, "source_name string, ingest_us bigint")
    want = {}
    for s in {x for x, _ in clock}:
        own = [t for x, t in clock if x == s and t is not None]
        for hour in range(-2 * h, 70 * h, h):
            due = hour + h + bound * US
            if min(own) <= due <= max(own) + idle * US:
                want[s, hour] = min([t for t in own if t > due] + [due + idle * US])
    hours = late.live_hours(df, bound, idle)
    assert {(r["source_name"], r["hour_us"]): r["passed_us"] for r in late.punctuations(df, hours, [bound], idle).collect()} == want
    closed = {k: max(v for (_, j), v in want.items() if j == k) for k in {j for _, j in want}}
    assert {r["hour_us"]: r["closed_us"] for r in late.closings(df, bound, idle).collect()} == closed


def test_no_clock_no_hours(spark):
    none = spark.createDataFrame([], "source_name string, event_us bigint, ingest_us bigint")
    assert late.classify(none).count() == late.closings(none).count() == late.live_hours(none, 600, 0).count() == 0


def test_stream_carries_watermarks_over_batches(spark, tmp_path):
    from millrace.streaming import jobs

    end = 3600 * US
    batches = [[("a", 5, 10), ("b", 5, end + 700 * US), (None, 5, None)], [("a", 6, end), ("b", 6, 20), ("b", None, 30)], [("b", 7, 40), ("a", 7, end + 22_000 * US)]]
    schema = "source_name string, event_us bigint, ingest_us bigint"
    for i, rows in enumerate(batches):  # one file a batch, read in order of time
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        jobs.hourly_counts(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = sorted((r["batch"], r["source_name"] or "", r["kind"], r["n"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    # b's clock had passed the hour in the first batch, so b's older records are late whatever their own ingestion
    assert got == [(0, "", "on_time", 1), (0, "a", "on_time", 1), (0, "b", "late", 1), (1, "a", "on_time", 1), (1, "b", "late", 1), (2, "a", "expired", 1), (2, "b", "late", 1)]
    low = {r["batch"]: r["low_us"] for r in spark.read.parquet(str(tmp_path / "out-low")).collect()}
    assert low == {0: end + 100 * US, 1: end - 600 * US, 2: end + 21_400 * US}
