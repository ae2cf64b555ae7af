"""Counts per source and hour of event time that late records still correct, up to a cut-off.

Each source has a low watermark on the ingestion clock: a source whose clock has moved past t
vouches that its hours ended before t - bound are complete. Its own records move it; a source
that is silent is punctuated by an idle timeout. A record is diverted from the count of its
source and hour if it is ingested at or after the punctuation that passed that hour: up to a
second punctuation, the cut-off's, it corrects the count (late), beyond it stays out (expired).
An hour as a whole closes when every live source has passed it.

Which instant passed an hour is an as-of lookup: the first ingestion of the source after the
hour's end plus the bound. Ingestions are bucketed by the hour to whose bound they are the next,
so that the first of a bucket, a partial aggregate, is that instant, and a window over a source's
buckets (no more than there are hours) carries it over hours in which the source was silent.

Defined results: an event without a time has no hour and no kind; a null source is a source of
its own; without an ingestion time a record is on time and moves no clock; equal instants share
their punctuation; repeated rows are counted as often as they are given; no rows, no hours;
columns of the names that are added are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from millrace.session import stored

US = 1_000_000
HOUR = 3600 * US
#: Punctuations are broadcast up to this many rows, as counted; beyond they are joined by shuffle.
MAX_BROADCAST_ROWS = 200_000


def _due(hour: Column, bound_s: int) -> Column:
    return hour + F.lit(HOUR + bound_s * US)


def _next_bound(ingest_us: Column, bound_s: int) -> Column:
    """The last hour whose bound lies before an ingestion."""
    return (F.ceil((ingest_us - bound_s * US) / HOUR) - 2).cast("long") * HOUR


def punctuations(clock: DataFrame, hours: DataFrame, bounds_s: Sequence[int], idle_s: int) -> DataFrame:
    """source_name, hour_us, passed_us (one for each of bounds_s) for every (source_name, hour_us) of hours.

    clock: source_name, ingest_us, one row per delivery. passed_us is the source's first
    ingestion after the hour's end plus the bound, and no later than idle_s after that point. All
    bounds are answered in one pass.
    """
    each = F.explode(F.array(*[F.struct(F.lit(b).cast("long").alias("bound_s"), _next_bound(F.col("ingest_us"), b).alias("hour_us")) for b in bounds_s])).alias("b")
    firsts = clock.where(F.col("ingest_us").isNotNull()).select("source_name", "ingest_us", each).groupBy("source_name", "b.bound_s", "b.hour_us").agg(F.min("ingest_us").alias("first_us"))
    asked = hours.select("source_name", F.explode(F.array(*[F.lit(b).cast("long") for b in bounds_s])).alias("bound_s"), "hour_us").distinct().withColumns({"first_us": F.lit(None).cast("long"), "asked": F.lit(True)})
    both = firsts.withColumn("asked", F.lit(False)).unionByName(asked).groupBy("source_name", "bound_s", "hour_us").agg(F.max("asked").alias("asked"), F.min("first_us").alias("first_us"))
    after = F.min("first_us").over(W.partitionBy("source_name", "bound_s").orderBy("hour_us").rowsBetween(0, W.unboundedFollowing))
    due = F.col("hour_us") + HOUR + (F.col("bound_s") + idle_s) * US
    passed = both.withColumn("passed_us", F.least(after, due)).where("asked")
    if len(bounds_s) == 1:
        return passed.select("source_name", "hour_us", "passed_us")
    per = [F.max(F.when(F.col("bound_s") == b, F.col("passed_us"))) for b in bounds_s]
    return passed.groupBy("source_name", "hour_us").agg(F.array(*per).alias("passed_us"))


def live_hours(clock: DataFrame, bound_s: int, idle_s: int) -> DataFrame:
    """source_name, hour_us: the hours a live source is waited for, whether it has events in them or not.

    A source is live from its first ingestion until it has been silent for idle_s.
    """
    span = clock.groupBy("source_name").agg(F.min("ingest_us").alias("lo"), F.max("ingest_us").alias("hi")).where(F.col("lo").isNotNull())
    first = _next_bound(F.col("lo"), bound_s) + HOUR
    last = (F.floor((F.col("hi") + (idle_s - bound_s) * US) / HOUR) - 1).cast("long") * HOUR
    return span.where(last >= first).select("source_name", F.explode(F.sequence(first, last, F.lit(HOUR))).alias("hour_us"))


def closings(clock: DataFrame, bound_s: int = 600, idle_s: int = 3600) -> DataFrame:
    """hour_us, closed_us, n_sources, n_idle: an hour closes when its last live source passes it, by a record or its idle timeout."""
    p = punctuations(clock, live_hours(clock, bound_s, idle_s), [bound_s], idle_s)
    idle = F.col("passed_us") == _due(F.col("hour_us"), bound_s + idle_s)
    return p.groupBy("hour_us").agg(F.max("passed_us").alias("closed_us"), F.count("*").alias("n_sources"), F.count_if(idle).alias("n_idle"))


def _hour_of(event_us: Column) -> Column:
    return (F.floor(event_us / HOUR) * HOUR).cast("long")


def classify(times: DataFrame, clock: DataFrame | None = None, bound_s: int = 600, cutoff_s: int = 21_600, idle_s: int = 3600) -> DataFrame:
    """Adds hour_us, passed_us and kind (on_time, late, expired) to events with event_us, ingest_us and source_name.

    clock: the deliveries that move the sources' watermarks (source_name, ingest_us), the events'
    own if it is not given. Punctuations, one row per source and hour, are broadcast while they
    are few, as counted; else both sides are shuffled by source and hour.
    """
    events = times.where(F.col("event_us").isNotNull()).drop("passed_us", "kind").withColumn("hour_us", _hour_of(F.col("event_us")))
    moved = times.select("source_name", "ingest_us") if clock is None else clock.select("source_name", "ingest_us")
    both = punctuations(moved, events.select("source_name", "hour_us").distinct(), [bound_s, cutoff_s], idle_s)
    marks = stored(both.select(F.col("source_name").alias("_s"), F.col("hour_us").alias("_h"), F.col("passed_us")[0].alias("passed_us"), F.col("passed_us")[1].alias("gone_us")), "marks")
    small = marks.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS
    own = events["source_name"].eqNullSafe(F.col("_s")) & (events["hour_us"] == F.col("_h"))
    at = F.col("ingest_us")
    kind = F.when(at.isNull() | (at < F.col("passed_us")), "on_time").when(at < F.col("gone_us"), "late").otherwise("expired")
    return events.join(F.broadcast(marks) if small else marks, own, "left").withColumn("kind", kind).drop("_s", "_h", "gone_us")


def classify_arrivals(times: DataFrame, clocks: DataFrame, bound_s: int = 600, cutoff_s: int = 21_600) -> DataFrame:
    """The same of the records of one micro-batch, against the watermarks that earlier batches left.

    clocks: source_name, clock_us. A record moves its own source's clock before it is judged, so
    it is held against the later of that clock and its own ingestion.
    """
    events = times.where(F.col("event_us").isNotNull()).withColumn("hour_us", _hour_of(F.col("event_us")))
    c = clocks.select(F.col("source_name").alias("_s"), F.col("clock_us").alias("_c"))
    clock, hour = F.greatest("_c", "ingest_us"), F.col("hour_us")
    kind = F.when(F.col("ingest_us").isNull() | (clock <= _due(hour, bound_s)), "on_time").when(clock <= _due(hour, cutoff_s), "late").otherwise("expired")
    return events.join(c, events["source_name"].eqNullSafe(F.col("_s")), "left").withColumn("kind", kind).drop("_s", "_c")


def moved(clocks: DataFrame, times: DataFrame) -> DataFrame:
    """source_name, clock_us: every source's clock after a micro-batch."""
    new = times.where(F.col("ingest_us").isNotNull()).select("source_name", F.col("ingest_us").alias("clock_us"))
    return clocks.select("source_name", "clock_us").unionByName(new).groupBy("source_name").agg(F.max("clock_us").alias("clock_us"))


def low_watermark(clocks: DataFrame, bound_s: int = 600, idle_s: int = 3600) -> DataFrame:
    """low_us, in one row: hours ended before it are closed, every source having passed them or been silent for idle_s."""
    now = clocks.agg(F.max("clock_us")).first()[0]
    live = clocks.where(F.col("clock_us") >= F.lit(now).cast("long") - idle_s * US)
    return live.agg((F.min("clock_us") - bound_s * US).alias("low_us"))


def hourly(classified: DataFrame) -> DataFrame:
    """source_name, hour, n_closed (as first published), n_late (corrections), n_final, n_expired (diverted)."""
    n = lambda k: F.count_if(F.col("kind") == k)
    return classified.groupBy("source_name", F.timestamp_micros("hour_us").alias("hour")).agg(
        n("on_time").alias("n_closed"), n("late").alias("n_late"), (n("on_time") + n("late")).alias("n_final"), n("expired").alias("n_expired")
    )
