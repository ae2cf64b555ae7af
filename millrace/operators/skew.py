"""Per-key results where a few keys own most rows: value-frequency compression.

Rows are first counted per (key, value), which spreads a hot key over as many groups as it has
values and combines on the map side; per-key results then come from the weighted values, which
combine on the map side again. No task ever sees the rows of a key.

Defined results: a null key is a key of its own in the table of counts and never heavy; null
values count as rows but not as distinct values; an empty table gives no keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def compress(df: DataFrame, keys: list[str], value: str, last: str | None = None) -> DataFrame:
    """field, key_value, value, n, last: one row per key and value. One pass over df for all key columns."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("field"), F.col(k).cast("string").alias("key_value")) for k in keys]))
    rows = df.select(pairs.alias("_p"), F.col(value).alias("value"), (F.col(last) if last else F.lit(None).cast("long")).alias("last"))
    return rows.select("_p.*", "value", "last").groupBy("field", "key_value", "value").agg(F.count("*").alias("n"), F.max("last").alias("last"))


def per_key(compressed: DataFrame) -> DataFrame:
    """field, key_value, n_rows, n_values (exact distinct), last."""
    return compressed.groupBy("field", "key_value").agg(F.sum("n").alias("n_rows"), F.count("value").alias("n_values"), F.max("last").alias("last"))


def modes(compressed: DataFrame) -> DataFrame:
    """field, key_value, mode, mode_rows: the most frequent value of each key, the smallest of equals."""
    top = F.max_by(F.struct("value", "n"), F.struct(F.col("n")))
    ranked = compressed.where(F.col("value").isNotNull()).groupBy("field", "key_value", "n").agg(F.min("value").alias("value"))
    return ranked.groupBy("field", "key_value").agg(top.alias("t")).select("field", "key_value", F.col("t.value").alias("mode"), F.col("t.n").alias("mode_rows"))


def percentiles(compressed: DataFrame, at: list[float]) -> DataFrame:
    """field, key_value, percentiles: exact, from the weighted values (a numeric value of bounded domain)."""
    return compressed.where(F.col("value").isNotNull()).groupBy("field", "key_value").agg(F.expr(f"percentile(value, array({', '.join(map(str, at))}), n)").alias("percentiles"))


def heavy(keys: DataFrame, total_rows: int, share: float) -> DataFrame:
    """Keys that hold at least share of all rows."""
    return keys.where(F.col("key_value").isNotNull() & (F.col("n_rows") >= F.lit(share) * total_rows) & F.lit(total_rows > 0))
