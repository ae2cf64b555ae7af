"""One UTC instant per event from stamps of many layouts, precisions and zones.

A stamp may allow several readings: no year, day or month first, an hour repeated at a clock
change. Each reading is an interpretation of its layout. Per source, expectation-maximisation
fits the mixture of interpretations and of ingestion delays: a value gives each of its valid
readings a share of itself. The posteriors stay with every event; a reading that is not clear
(posterior under CLEAR) is marked. A rule fixes the choice where it can: the latest reading not
after ingestion counts, whatever its posterior. Where every reading lies after ingestion, or that
is unknown, the rule says nothing and the reading of the highest posterior counts.

Defined results: no message or no valid time in it: no instant. A null source, peer and path:
UTC. A null ingestion: readings count from year 2025. Equal posteriors: the earliest instant. Repeated rows: one
event. Empty table: no rows.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.ids import event_key, ingest_us
from millrace.session import stored

CLEAR = 0.9
EM_ROUNDS = 25
#: A broadcast side is the fixed table of configured sources; beyond this many rows it is joined by shuffle.
MAX_BROADCAST_ROWS = 10_000

_MONTHS = {m: i + 1 for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split())}
_MON = "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
_HMS = r"\d{2}:\d{2}:\d{2}(?:[.,]\d+)?"
_OFFSET = r"(?:Z|[+-]\d{2}:?\d{2})(?![\w:])"
_LETTERS = r"[A-Z]{2,5}(?![\w:])"
#: Where a time may stand; the leftmost valid one counts. Bare numbers are times only at the
#: start of a message or as the value of a key that names a time.
_FIND = re.compile(
    "|".join(
        (
            rf'(?P<pair>\bdate="?\d{{4}}-\d{{2}}-\d{{2}}"?[ ,]+time="?{_HMS}"?(?:[ ,]+tz="?[+-]\d{{2}}:?\d{{2}}"?)?)',
            rf"(?P<iso>(?<![\d.-])\d{{4}}[-/]\d{{2}}[-/]\d{{2}}[T ]{_HMS}(?: ?{_OFFSET}| {_LETTERS})?)",
            rf"(?P<named>(?<![A-Za-z]){_MON} {{1,2}}\d{{1,2}}(?: \d{{4}})? {_HMS}(?: {_OFFSET}| {_LETTERS})?)",
            rf"(?P<clf>(?<!\d)\d{{1,2}}/{_MON}/\d{{4}}:{_HMS}(?: {_OFFSET})?)",
            r"(?P<slash>(?<![\d/])\d{1,2}/\d{1,2}/\d{4},? \d{1,2}:\d{2}:\d{2}(?:[.,]\d+)?(?: ?[AP]M\b)?)",
            rf"(?P<dot>(?<![\d.])\d{{1,2}}\.\d{{1,2}}\.\d{{4}},? {_HMS})",
            r"(?P<compact>(?<![\w.-])(?:19|20)\d{6}T?\d{6}(?:[.,]\d+)?Z?(?!\w))",
            r'(?P<epoch>(?:^|(?<![\w.-])(?:@?timestamp|time|ts|rt|devTime|eventtime|epoch|t)"?\s*[=:]\s*"?)\d{9,19}(?:\.\d{1,9})?(?![\w.:/-]))',
        )
    )
)
_NUM = re.compile(r"\d+")
_TAIL = re.compile(r"\.\d+$")
_CLOCK = re.compile(r"(\d{1,2}):(\d{2}):(\d{2})(?:[.,](\d+))?")
_EPOCH_DAY = dt.date(1970, 1, 1).toordinal()
_US = 1_000_000


def _wall(y: int, mo: int, d: int, clock: tuple[int, int]) -> int | None:
    """Microseconds of a wall clock as if it were UTC; None if there is no such day."""
    try:
        return (dt.date(y, mo, d).toordinal() - _EPOCH_DAY) * 86_400 * _US + clock[0] * _US + clock[1]
    except ValueError:
        return None


def _clock(text: str, ampm: str = "") -> tuple[int, int] | None:
    m = _CLOCK.search(text)
    if not m:
        return None
    h, mi, s = int(m[1]), int(m[2]), int(m[3])
    if ampm:
        if not 1 <= h <= 12:
            return None
        h = h % 12 + (12 if ampm == "P" else 0)
    if h > 23 or mi > 59 or s > 59:
        return None
    return h * 3600 + mi * 60 + s, int((m[4] or "0")[:6].ljust(6, "0"))


def _offset(text: str) -> int | None:
    m = re.search(r'(?:(Z)|([+-])(\d{2}):?(\d{2}))"?$', text)
    if not m:
        return None
    if m[1]:
        return 0
    if int(m[3]) > 18 or int(m[4]) > 59:
        return None
    return (int(m[3]) * 60 + int(m[4])) * 60 * (-1 if m[2] == "-" else 1)


def _years(mo: int, d: int, clock: tuple[int, int], about: int) -> list[tuple[str, int]]:
    """Readings of a day without a year: the year of ingestion, its neighbours, and the last leap year."""
    out = []
    for y in range(about + 1, about - 9, -1):
        w = _wall(y, mo, d, clock)
        if w is not None:
            out.append((f"year{y - about:+d}", w))
            if y < about and len(out) >= 3:
                break
    return out


def _read(kind: str, text: str, year: int) -> tuple[str, list[tuple[str, int]], int | None] | None:
    """(layout, [(reading, wall microseconds)], offset in s or None for the source's zone); None if invalid."""
    if kind == "epoch":
        digits = re.split(r"[=:\"\s]", text)[-1]
        whole, _, frac = digits.partition(".")
        n = int(whole)
        if len(whole) <= 11:
            us, unit = n * _US + int(frac[:6].ljust(6, "0") if frac else 0), "s"
        elif len(whole) <= 14:
            us, unit = n * 1000 + int(frac[:3].ljust(3, "0") if frac else 0), "ms"
        elif len(whole) <= 17:
            us, unit = n, "us"
        else:
            us, unit = n // 1000, "ns"
        return (f"epoch_{unit}", [("", us)], 0) if us < 4_102_444_800 * _US else None
    if kind == "compact":
        t = text.replace("T", "")
        clock = _clock(f"{t[8:10]}:{t[10:12]}:{t[12:14]}" + (f".{re.split('[.,]', t)[1].rstrip('Z')}" if re.search("[.,]", t) else ""))
        w = clock and _wall(int(t[:4]), int(t[4:6]), int(t[6:8]), clock)
        return None if w is None else ("compact", [("", w)], 0 if text.endswith("Z") else None)
    ampm = ""
    if kind == "slash" and text[-1] == "M":
        ampm = text[-2]
    at = text.index(":") + 1 if kind == "clf" else 0  # the year of such a stamp touches the hour
    clock = _clock(text[at:], ampm)
    if clock is None:
        return None
    if kind in ("iso", "pair"):
        y, mo, d = map(int, _NUM.findall(text)[:3])
        readings = [("", _wall(y, mo, d, clock))]
        after = text[_CLOCK.search(text).end() :]
        off = _offset(after) if kind == "iso" or "tz=" in after else None
        layout = kind + ("" if off is None else "_zoned")
    elif kind == "named":
        mo, nums = _MONTHS[text[:3].lower()], _NUM.findall(text)
        has_year = re.match(r"\w{3} +\d+ \d{4} ", text)
        off = _offset(text[_CLOCK.search(text).end() :])
        if has_year:
            layout, readings = "named", [("", _wall(int(nums[1]), mo, int(nums[0]), clock))]
        else:
            layout, readings = "named_yearless", _years(mo, int(nums[0]), clock, year)
    elif kind == "clf":
        d, mon, y = text.split(":", 1)[0].split("/")
        layout, readings = "clf", [("", _wall(int(y), _MONTHS[mon.lower()], int(d), clock))]
        off = _offset(text[_CLOCK.search(text, at).end() :])
    elif kind == "dot":
        d, mo, y = map(int, _NUM.findall(text)[:3])
        layout, readings, off = "dot", [("", _wall(y, mo, d, clock))], None
    else:
        a, b, y = map(int, _NUM.findall(text)[:3])
        layout, off = "slash_ampm" if ampm else "slash", None
        readings = [("month_first", _wall(y, a, b, clock)), ("day_first", _wall(y, b, a, clock))]
        if a == b:
            readings = readings[:1]
    readings = [x for x in readings if x[1] is not None]
    return (layout, readings, off) if readings and min(x[1] for x in readings) >= 0 else None


def read_stamp(message: str | None, about_us: int | None) -> tuple[str, list[tuple[str, int]], int | None] | None:
    """The first valid time of a message with all its readings; about_us tells the year where it is not written."""
    if not message:
        return None
    year = 2025 if about_us is None else (dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=about_us)).year
    at = 0
    while m := _FIND.search(message, at):
        kind = m.lastgroup
        if got := _read(kind, m[kind], year):
            return got
        at = max(m.end(), at + 1)
    return None


_STAMP = T.StructType(
    [
        T.StructField("layout", T.StringType()),
        T.StructField("readings", T.ArrayType(T.StringType())),
        T.StructField("walls", T.ArrayType(T.LongType())),
        T.StructField("offset_s", T.IntegerType()),
    ]
)


@F.pandas_udf(_STAMP)
def _stamp_udf(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for messages, about in batches:
        rows = []
        for m, a in zip(messages, about):
            got = read_stamp(m, None if pd.isna(a) else int(a))
            rows.append((None, None, None, None) if got is None else (got[0], [x[0] for x in got[1]], [x[1] for x in got[1]], got[2]))
        out = pd.DataFrame(rows, columns=["layout", "readings", "walls", "offset_s"])
        out["offset_s"] = out["offset_s"].astype("Int32")
        yield out


def with_zone(events: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds source (source_id matched by source_name, else peer_ip, else file_path) and zone.

    The sides are the configured sources: broadcast while they are few, as counted; else shuffled.
    """
    small = sources.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS
    side = F.broadcast if small else (lambda df: df)

    def by(column: str, n: str) -> DataFrame:
        return (
            sources.where(F.col(column).isNotNull())
            .groupBy(F.col(column).alias(f"_k{n}"))
            .agg(F.min(F.struct(F.col("source_id").alias("id"), F.col("time_zone").alias("zone"))).alias(f"_s{n}"))
        )

    out = events
    for n, (own, other) in enumerate((("source_name", "source_id"), ("peer_ip", "peer_ip"), ("file_path", "file_path"))):
        out = out.join(side(by(other, str(n))), F.col(own) == F.col(f"_k{n}"), "left")
    hit = F.coalesce("_s0", "_s1", "_s2")
    return out.withColumns({"source": hit["id"], "zone": F.coalesce(hit["zone"], F.lit("UTC"))}).drop(*[f"_{a}{n}" for a in "ks" for n in range(3)])


def first_stamps(telemetry: DataFrame, sources: DataFrame) -> DataFrame:
    """event_key, ingest_us, row_id, source_name, source, zone and the readings of each event's first copy.

    Stamps are read before the shuffle, so that what moves is a few numbers instead of the message;
    the minimum combines on the map side, so an event of very many copies stays one row a task.
    """
    rows = with_zone(
        telemetry.select(
            event_key(F.col("event_id")).alias("event_key"),
            ingest_us(F.col("ingested_at_unix_utc")).alias("ingest_us"),
            "row_id", "source_name", "peer_ip", "file_path", "raw_message",
        ).where(F.col("event_key").isNotNull()),
        sources,
    )
    stamped = rows.withColumn("stamp", _stamp_udf("raw_message", "ingest_us"))
    order = F.struct(F.coalesce("ingest_us", F.lit(2**63 - 1)).alias("o"), F.col("row_id"), F.col("ingest_us"), F.col("source_name"), F.col("source"), F.col("zone"), F.col("stamp"))
    return stamped.groupBy("event_key").agg(F.min(order).alias("f")).select("event_key", "f.row_id", "f.ingest_us", "f.source_name", "f.source", "f.zone", "f.stamp.*")


def _utc(wall: Column, zone: Column) -> Column:
    """A wall clock (us) of a zone as UTC; in a skipped hour the offset before the change holds, in a repeated one the earlier instant."""
    return F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(wall), zone))


def _local(utc: Column, zone: Column) -> Column:
    return F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(utc), zone))


def candidates(stamps: DataFrame) -> DataFrame:
    """Adds cands array<struct<label, us>>: every instant that a stamp may mean, its label naming layout and reading."""
    zone, off = F.col("zone"), F.col("offset_s")

    def instants(i: Column) -> Column:
        wall, name = F.element_at("walls", i), F.concat(F.col("layout"), F.lit("/"), F.element_at("readings", i))
        return F.struct(name.alias("label"), F.when(off.isNotNull(), wall - off.cast("long") * _US).otherwise(_utc(wall, zone)).alias("us"), wall.alias("wall"))

    base = F.transform(F.sequence(F.lit(1), F.size("walls")), instants)
    # the clock shows a wall time again if the offset is smaller a while later: at the instant which that offset makes of it
    a_while = 3 * 3600 * _US
    offset_after = lambda c: _local(c["us"] + a_while, zone) - c["us"] - a_while
    moved = F.transform("_base", lambda c: F.struct(F.concat(c["label"], F.lit("/repeated")).alias("label"), (c["wall"] - offset_after(c)).alias("us"), c["wall"].alias("wall"), c["us"].alias("first")))
    again = F.transform(
        F.filter(moved, lambda c: (c["us"] > c["first"]) & (_local(c["us"], zone) == c["wall"])), lambda c: F.struct(c["label"].alias("label"), c["us"].alias("us"), c["wall"].alias("wall"))
    )
    both = F.when(off.isNull() & (zone != "UTC"), F.concat("_base", again)).otherwise(F.col("_base"))
    return (
        stamps.where(F.size("walls") > 0)
        .withColumn("_base", base)
        .withColumn("cands", F.transform(both, lambda c: F.struct(c["label"].alias("label"), c["us"].alias("us"))))
        .drop("_base", "walls", "readings", "offset_s")
    )


def _bin(delay_us: Column) -> Column:
    """Delay in powers of two of a second; -1 for an instant after ingestion, -2 where ingestion is unknown."""
    return F.when(delay_us.isNull(), F.lit(-2)).when(delay_us < 0, F.lit(-1)).otherwise(F.floor(F.log2(delay_us / F.lit(1e6) + 1)).cast("int"))


def _em(pdf: pd.DataFrame) -> pd.DataFrame:
    """EM over one source's signatures (label and delay bin of each reading) and their counts."""
    labels: dict[str, float] = {}
    bins: dict[int, float] = {}
    rows = [([tuple(c.values() if isinstance(c, dict) else c) for c in sig], float(n)) for sig, n in zip(pdf["sig"], pdf["n"])]
    for sig, n in rows:
        for a, b in sig:
            labels[a] = labels.get(a, 0.0) + n / len(sig)
            bins[b] = bins.get(b, 0.0) + n / len(sig)
    for _ in range(EM_ROUNDS):
        total = sum(labels.values()) + 0.5 * len(labels)
        pa = {a: (v + 0.5) / total for a, v in labels.items()}
        pb = {b: (v + 0.5) / (sum(bins.values()) + 0.5 * len(bins)) for b, v in bins.items()}
        labels, bins = dict.fromkeys(pa, 0.0), dict.fromkeys(pb, 0.0)
        for sig, n in rows:
            like = [pa[a] * pb[b] for a, b in sig]
            z = sum(like)
            for (a, b), p in zip(sig, like):
                labels[a] += n * p / z
                bins[b] += n * p / z
    return pd.DataFrame({"source": [pdf["source"].iloc[0]], "pi": [list(pa.items())], "theta": [list(pb.items())]})


def mixtures(cands: DataFrame) -> DataFrame:
    """source, pi (label -> weight), theta (delay bin -> weight), fitted by EM.

    What is fitted are counts per source and signature: their number is bound by sources x
    layouts x bins whatever the input's size, and they combine before the shuffle.
    """
    sig = F.transform("cands", lambda c: F.struct(c["label"].alias("label"), _bin(F.col("ingest_us") - c["us"]).alias("bin")))
    stats = cands.groupBy(F.coalesce("source", F.lit("")).alias("source"), sig.alias("sig")).agg(F.count("*").alias("n"))
    fitted = stats.groupBy("source").applyInPandas(_em, "source string, pi array<struct<k:string,v:double>>, theta array<struct<k:int,v:double>>")
    return fitted.select("source", F.map_from_entries("pi").alias("pi"), F.map_from_entries("theta").alias("theta"))


def resolve(cands: DataFrame, fitted: DataFrame) -> DataFrame:
    """Adds event_us, posterior, n_readings, clear, likeliest_us and by_rule (whether the rule chose) to each event.

    fitted has one row per configured source (and one for none), so it is broadcast.
    """
    own = F.coalesce("source", F.lit(""))
    j = cands.join(F.broadcast(fitted.withColumnRenamed("source", "_source")), own == F.col("_source"), "left")
    like = F.transform(
        "cands",
        lambda c: F.struct(
            c["us"].alias("us"),
            (F.coalesce(F.element_at("pi", c["label"]), F.lit(1e-9)) * F.coalesce(F.element_at("theta", _bin(F.col("ingest_us") - c["us"])), F.lit(1e-9))).alias("like"),
        ),
    )
    j = j.withColumn("_like", like).withColumn("_z", F.aggregate("_like", F.lit(0.0), lambda a, c: a + c["like"]))
    likeliest = -F.array_max(F.transform("_like", lambda c: F.struct(c["like"].alias("like"), (-c["us"]).alias("sooner"))))["sooner"]
    before = F.array_max(F.transform(F.filter("_like", lambda c: c["us"] <= F.col("ingest_us")), lambda c: c["us"]))
    j = j.withColumn("likeliest_us", likeliest).withColumn("by_rule", before.isNotNull()).withColumn("event_us", F.coalesce(before, "likeliest_us"))
    chosen = F.aggregate(F.filter("_like", lambda c: c["us"] == F.col("event_us")), F.lit(0.0), lambda a, c: a + c["like"]) / F.col("_z")
    return j.select(
        "event_key", "row_id", "ingest_us", "source_name", "source", "zone", "layout", "event_us",
        chosen.alias("posterior"), F.size("cands").alias("n_readings"), (chosen >= CLEAR).alias("clear"), "likeliest_us", "by_rule",
    )


def event_times(telemetry: DataFrame, sources: DataFrame) -> DataFrame:
    """The whole operator. The readings are written once: the fit and the choice both read them."""
    cands = stored(candidates(first_stamps(telemetry, sources)), "stamps")
    return resolve(cands, mixtures(cands))
