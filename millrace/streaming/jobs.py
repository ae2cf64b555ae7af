"""The pipeline as streaming queries: a checkpoint replaces queues, partitions replace threads."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.config import Config, secret
from millrace.operators import late
from millrace.plans.pipeline import parse_events, placed_id
from millrace.sources import sinks
from millrace.sources.readers import listen, number_lines, stream_files


def target_of(cfg: Config) -> sinks.Target | None:
    """The target a configuration names; None for the spool."""
    s = cfg.siem
    kind = s.get("type", "spool")
    if kind == "syslog":
        return sinks.syslog(s["host"], int(s["port"]), s.get("transport", "udp"), s.get("tag", "millrace"), int(s.get("pri", 134)))
    if kind == "qradar":
        return sinks.qradar(s["host"], int(s["port"]), s.get("transport", "tcp"))
    if kind == "elastic":
        password = secret(s, "password")
        basic = (s["username"], password) if s.get("username") and password is not None else None
        return sinks.elastic(s["url"], s.get("index_prefix", "millrace"), secret(s, "api_key"), basic)
    return None


def run(messages: DataFrame, cfg: Config, spool_path: str, checkpoint: str, outcome_path: str | None = None, once: bool = False, each: Callable[[DataFrame], None] | None = None) -> StreamingQuery:
    """Parse a stream of messages and deliver each batch.

    The parse is part of the stream's own plan, which is analysed once; a batch's events are kept
    while it is delivered. Lines of files get their numbers, and identifiers that derive from them,
    in the batch, which holds whole files.
    """
    target = target_of(cfg)
    events = parse_events(messages, cfg)
    of_files = "file_block_start" in messages.columns

    def batch(df: DataFrame, n: int) -> None:
        kept = df.persist()
        try:
            out = kept
            if of_files:
                out = number_lines(kept.drop("file_line_number")).where(F.col("raw_message").isNotNull()).withColumn("event_id", F.coalesce(placed_id(), "event_id"))
            if target is None:
                sinks.spool(out, spool_path)
            else:
                sinks.deliver_or_spool(out, target, spool_path, f"{outcome_path or spool_path + '-outcomes'}/batch={n}", cfg.limits)
            if each:
                each(out)
        finally:
            kept.unpersist()

    writer = events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()


def counters(query: StreamingQuery) -> dict[str, int]:
    """What a stream has turned away, by counter, over the progress that Spark remembers."""
    out: dict[str, int] = {}
    for p in query.recentProgress:
        for row in p.observedMetrics.values():
            for k, v in row.asDict().items():
                k = k.replace("error_", "error.", 1)
                out[k] = out.get(k, 0) + (v or 0)
    return out


def listeners(spark: SparkSession, cfg: Config) -> list[DataFrame]:
    """A stream for each configured listener."""
    out = []
    for x in cfg.listeners:
        if x["type"] == "file":
            out.append(stream_files(spark, x["path"], limit=cfg.limits.max_message_bytes))
        else:
            out.append(listen(spark, x["type"], int(x["port"]), x.get("host", "127.0.0.1"), limit=cfg.limits.max_message_bytes, maxConnections=cfg.limits.max_connections))
    return out


def hourly_counts(times: DataFrame, table_path: str, checkpoint: str, bound_s: int = 600, cutoff_s: int = 21_600, idle_s: int = 3600, once: bool = True) -> StreamingQuery:
    """Counts per source and hour as changes: each batch appends (batch, source_name, hour_us, kind, n).

    times: event_us, ingest_us, source_name. A late record is a correction of its hour: reading the
    sum over batches gives the corrected count, a replayed batch overwrites its own rows only.
    The sources' clocks are carried from batch to batch as a table of one row per source
    (table_path-clocks/batch=n), beside it the low watermark below which every hour is closed
    (table_path-low/batch=n).
    """

    def batch(df: DataFrame, n: int) -> None:
        spark = df.sparkSession
        clocks = spark.createDataFrame([], "source_name string, clock_us bigint") if n == 0 else spark.read.schema("source_name string, clock_us bigint").parquet(f"{table_path}-clocks/batch={n - 1}")
        df = df.persist()
        try:
            now = f"{table_path}-clocks/batch={n}"
            late.moved(clocks, df).write.mode("overwrite").parquet(now)
            late.low_watermark(spark.read.parquet(now), bound_s, idle_s).write.mode("overwrite").parquet(f"{table_path}-low/batch={n}")
            c = late.classify_arrivals(df, clocks, bound_s, cutoff_s)
            c.groupBy("source_name", "hour_us", "kind").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{table_path}/batch={n}")
        finally:
            df.unpersist()

    writer = times.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
