"""The queries on training text, each over its whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import leakage, packing, truncation
from millrace.session import table


def _sizes(spark: SparkSession, d: str) -> list[int]:
    return packing.capacities(table(spark, d, "pack_sizes"))


def _packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"), _sizes(spark, d))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    sizes = _sizes(spark, d)
    return packing.exceeding(packing.pack(table(spark, d, "documents"), sizes), sizes)


def p8_placed(spark: SparkSession, d: str) -> DataFrame:
    """Per text: its tokens and pieces as they stand in the containers, and whether a container of theirs is overfull."""
    one = _packed(spark, d)
    held = one.groupBy("shard", "container").agg(F.sum("size").alias("held"))
    placed = one.join(held, ["shard", "container"])
    bad = (F.col("held") != F.col("filled")) | (F.col("held") > F.col("capacity"))
    return placed.groupBy("doc_id").agg(F.sum("size").alias("n_tokens"), F.count_distinct("piece").alias("n_pieces"), F.count("*").alias("n_places"), F.max("size").alias("largest"), F.count_if(bad).alias("n_overfull"))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d)


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """Per capacity: containers, items and the share of room in use."""
    one = _packed(spark, d).groupBy("shard", "container", "capacity").agg(F.max("filled").alias("filled"), F.count("*").alias("n"))
    return one.groupBy("capacity").agg(F.count("*").alias("n_containers"), F.sum("n").alias("n_items"), (F.sum("filled") / F.sum("capacity")).alias("fill"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p9_runs(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.judged(table(spark, d, "documents")).where(F.col("posterior") >= truncation.CUT).select("doc_id")


def p10_sources(spark: SparkSession, d: str) -> DataFrame:
    return truncation.rates(truncation.judged(table(spark, d, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p8_found, p8_placed, p8_containers, p8_fill, p9_found, p9_runs, p10_found, p10_sources)
}

_SIZED = r"sized AS (SELECT doc_id, len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\x{1c}-\x{1f}\x{85}\p{Z}]+')) AS n FROM documents WHERE text IS NOT NULL)"

ORACLES: dict[str, str] = {
    "p8_found": f"WITH {_SIZED} SELECT DISTINCT capacity, doc_id FROM sized JOIN pack_sizes ON n > capacity",
    "p8_placed": f"""WITH {_SIZED}, top AS (SELECT max(capacity) AS m FROM pack_sizes)
 SELECT doc_id, n AS n_tokens, (n + m - 1) // m AS n_pieces, (n + m - 1) // m AS n_places, least(n, m) AS largest, 0::BIGINT AS n_overfull FROM sized, top WHERE n > 0""",
}
