"""Exactly one copy of each message: an upsert store, hash-bucketed and sorted by identifier.

A batch is collapsed to its first copy per identifier (on the map side first, so an identifier
with very many copies moves as one row per task) and written as one sorted run: a bucketed table
with one sorted file per bucket, so a run knows its order. Compaction merges two runs at a time,
the smallest first, by a merge join of equal buckets: both sides stream in order, neither is
shuffled nor sorted again, and equal identifiers meet and collapse into the copy with the earliest
ingestion (then the smallest row). Applying a batch again changes nothing that a compaction returns.

Defined results: a null or unreadable identifier is no event and is left out; null ingestion
sorts last; an empty batch adds nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.ids import event_key, ingest_us
from millrace.session import new_path

LAST = 2**63 - 1


def copies(telemetry: DataFrame) -> DataFrame:
    return telemetry.select(
        event_key(F.col("event_id")).alias("event_key"), F.coalesce(ingest_us(F.col("ingested_at_unix_utc")), F.lit(LAST)).alias("ingest_us"), "row_id"
    ).where(F.col("event_key").isNotNull())


#: Identifiers in a bucket of the largest run, about: what a task merges, in a stream.
BUCKET_ROWS = 4_000_000
_ORDER = "spark.sql.legacy.bucketedTableScan.outputOrdering"


class BucketStore:
    """Sorted runs of (event_key, ingest_us, row_id), each a table bucketed by event_key under the shared folder."""

    def __init__(self, spark: SparkSession, buckets: int | None = None, rows: int = 0) -> None:
        """rows: about how many copies the store will see; the buckets follow them."""
        self.spark = spark
        self.partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.buckets = buckets or max(self.partitions, -(-rows // BUCKET_ROWS))
        self.runs: list[tuple[int, str]] = []

    def _write(self, run: DataFrame) -> None:
        name = f"run_{uuid.uuid4().hex}"
        run.write.format("parquet").bucketBy(self.buckets, "event_key").sortBy("event_key").option("path", new_path(self.spark, name)).saveAsTable(name)
        self.runs.append((self.spark.table(name).count(), name))

    def upsert(self, batch: DataFrame) -> None:
        """batch: event_key, ingest_us, row_id; may hold copies, of its own and of earlier batches."""
        run = batch.groupBy("event_key").agg(F.min(F.struct("ingest_us", "row_id")).alias("f")).select("event_key", "f.*")
        # the collapse's own exchange is the bucketing if it has as many partitions; one task writes all of a bucket
        self._write(run if self.buckets == self.partitions else run.repartition(self.buckets, "event_key"))

    def _merged(self, a: str, b: str) -> DataFrame:
        """Both runs as one, in order: equal identifiers meet in a merge join of equal buckets."""
        one, two = self.spark.table(a).alias("a"), self.spark.table(b).alias("b")
        both = one.hint("merge").join(two, F.col("a.event_key") == F.col("b.event_key"), "full")
        copy = lambda s: F.when(F.col(f"{s}.event_key").isNotNull(), F.struct(F.col(f"{s}.ingest_us").alias("ingest_us"), F.col(f"{s}.row_id").alias("row_id")))
        return both.select(F.coalesce("a.event_key", "b.event_key").alias("event_key"), F.least(copy("a"), copy("b")).alias("f")).select("event_key", "f.*")

    def compact(self) -> DataFrame:
        """Merge runs until one is left, switch to it and return it. A run that was merged is dropped after its successor stands."""
        if not self.runs:
            return self.spark.createDataFrame([], "event_key binary, ingest_us bigint, row_id bigint")
        before = self.spark.conf.get(_ORDER, "false")
        self.spark.conf.set(_ORDER, "true")
        try:
            while len(self.runs) > 1:
                self.runs.sort()
                (_, a), (_, b) = self.runs[:2]
                self._write(self._merged(a, b))
                self.runs = self.runs[2:]
                for old in (a, b):
                    self.spark.sql(f"DROP TABLE IF EXISTS {old}")
        finally:
            self.spark.conf.set(_ORDER, before)
        return self.spark.table(self.runs[0][1])


def repeats(telemetry: DataFrame, runs: int = 2) -> DataFrame:
    """event_key, row_id of every copy but the first.

    The table goes into the store in as many runs as given, by ranges of row_id, as deliveries
    would. The last step is an anti-join on row_id, which is unique: no identifier can skew it.
    """
    rows = copies(telemetry)
    lo, hi = telemetry.agg(F.min("row_id"), F.max("row_id")).first()
    if lo is None:
        return rows.select("event_key", "row_id")
    store = BucketStore(telemetry.sparkSession, rows=hi - lo + 1)
    step = (hi - lo) // runs + 1
    for i in range(runs):
        store.upsert(rows.where(F.col("row_id").between(lo + i * step, lo + (i + 1) * step - 1)))
    kept = store.compact().select("row_id")
    return rows.select("event_key", "row_id").join(kept, "row_id", "left_anti")
