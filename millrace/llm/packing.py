"""Filling fixed-capacity containers with texts: hierarchical multi-length packing.

Each text is sized in tokens of the public WordPunct tokenizer and routed to the smallest
context size that holds it; a text longer than the largest size is split into pieces of that
size and a rest. The tiers are packed from the largest down, best fit first; gaps that long
windows keep are filled from the shorter tiers before those are packed themselves. Containers
of a tier are then dealt into step groups of nearly equal token counts.

Packing runs on shards of a bounded number of pieces (a hash of the text's id and the piece picks the shard),
so no task ever holds an unbounded group; each shard leaves at most a few containers half full.

Defined results: a null text is no item; an empty text has 0 tokens and takes no container
room; repeated rows are items of their own only if their ids differ; null or non-positive
capacities are no containers; without containers nothing is packed or found.
"""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.session import stored

#: Word characters are letters, numbers and the underscore, as in the tokenizer's Unicode classes.
WORDPUNCT = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\x{1c}-\x{1f}\x{85}\p{Z}]+"
#: Pieces in a shard: what one task packs at once.
SHARD = 20_000
STEP = 8


def tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORDPUNCT))


def capacities(pack_sizes: DataFrame) -> list[int]:
    """The context sizes, ascending. Their table is a fixed configuration; reading it is bounded."""
    rows = pack_sizes.select(F.col("capacity").cast("long").alias("c")).where("c > 0").distinct().orderBy("c").limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("more than 1000 container sizes: that is no configuration")
    return [r[0] for r in rows]


def route(documents: DataFrame, sizes: list[int]) -> DataFrame:
    """doc_id, n_tokens, tier (the smallest size that holds the text, the largest if none does).

    Row-local and JVM-side: only doc_id and text are read.
    """
    sized = documents.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", tokens(F.col("text")).cast("long").alias("n_tokens"))
    all_sizes = F.array(*[F.lit(c).cast("long") for c in sizes])
    n = F.col("n_tokens")
    return sized.withColumn("tier", F.coalesce(F.array_min(F.filter(all_sizes, lambda c: c >= n)), F.array_max(all_sizes)))


def pieces(routed: DataFrame, sizes: list[int]) -> DataFrame:
    """doc_id, piece, size, tier: a text in one piece, or split because it exceeds the largest size."""
    top = sizes[-1]
    n = F.col("n_tokens")
    parts = F.when(n <= top, F.array(n)).otherwise(
        F.concat(F.array_repeat(F.lit(top).cast("long"), F.floor(n / top).cast("int")), F.when(n % top > 0, F.array(n % top)).otherwise(F.array().cast("array<bigint>")))
    )
    cut = routed.where(n > 0).select("doc_id", F.posexplode(parts).alias("piece", "size"))
    tiers = F.array(*[F.lit(c).cast("long") for c in sizes])
    return cut.withColumn("tier", F.array_min(F.filter(tiers, lambda c: c >= F.col("size"))))


def pack_shard(sizes: np.ndarray, tiers: np.ndarray, caps: list[int]) -> tuple[np.ndarray, list[int], list[int]]:
    """(container of each piece, capacity of each container, tokens in each container)."""
    where = np.full(len(sizes), -1, dtype=np.int64)
    capacity: list[int] = []
    filled: list[int] = []
    for cap in reversed(caps):
        room: list[tuple[int, int]] = []  # (room left, container), sorted

        def put(i: int) -> bool:
            k = bisect.bisect_left(room, (int(sizes[i]), -1))
            if k == len(room):
                return False
            left, c = room.pop(k)
            where[i] = c
            filled[c] += int(sizes[i])
            if left > sizes[i]:
                bisect.insort(room, (left - int(sizes[i]), c))
            return True

        own = np.flatnonzero((tiers == cap) & (where < 0))
        for i in own[np.argsort(-sizes[own], kind="stable")]:
            if not put(i):
                where[i] = len(capacity)
                capacity.append(cap)
                filled.append(int(sizes[i]))
                if cap > sizes[i]:
                    bisect.insort(room, (cap - int(sizes[i]), int(where[i])))
        shorter = np.flatnonzero((tiers < cap) & (where < 0))
        for i in shorter[np.argsort(-sizes[shorter], kind="stable")]:
            if not room:
                break
            put(i)
    return where, capacity, filled


def steps(capacity: list[int], filled: list[int], group: int = STEP) -> list[int]:
    """A step group for each container: groups of one capacity get nearly equal token counts."""
    out = [0] * len(capacity)
    base = 0
    for cap in sorted(set(capacity), reverse=True):
        own = sorted((i for i, c in enumerate(capacity) if c == cap), key=lambda i: -filled[i])
        n = -(-len(own) // group)
        for r, i in enumerate(own):
            lap, at = divmod(r, n)
            out[i] = base + (at if lap % 2 == 0 else n - 1 - at)
        base += n
    return out


def pack(documents: DataFrame, sizes: list[int]) -> DataFrame:
    """shard, container, capacity, filled, step, doc_id, piece, size, tier: every piece in exactly one container.

    Texts are sized once, into a table of ids and sizes; what is shuffled are its pieces.
    """
    out_type = "shard bigint, container bigint, capacity bigint, filled bigint, step bigint, doc_id bigint, piece int, size bigint, tier bigint"
    spark = documents.sparkSession
    if not sizes:
        return spark.createDataFrame([], out_type)
    cut = pieces(stored(route(documents, sizes), "sizes"), sizes)
    shards = max(1, -(-cut.count() // SHARD))
    items = cut.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "piece"], kind="stable").reset_index(drop=True)
        where, capacity, filled = pack_shard(pdf["size"].to_numpy(), pdf["tier"].to_numpy(), sizes)
        group = steps(capacity, filled)
        return pd.DataFrame(
            {
                "shard": pdf["shard"], "container": where, "capacity": [capacity[c] for c in where], "filled": [filled[c] for c in where],
                "step": [group[c] for c in where], "doc_id": pdf["doc_id"], "piece": pdf["piece"], "size": pdf["size"], "tier": pdf["tier"],
            }
        )

    return items.groupBy("shard").applyInPandas(fill, out_type)


def exceeding(packed: DataFrame, sizes: list[int]) -> DataFrame:
    """capacity, doc_id of every text that the packing did not leave whole for a container of that capacity.

    A text was routed above every capacity that can't hold it whole; one that was split exceeds them all.
    """
    out = packed.groupBy("doc_id").agg(F.max("tier").alias("tier"), F.count("*").alias("n"))
    all_sizes = F.array(*[F.lit(c).cast("long") for c in sizes])
    return out.select(F.explode(F.filter(all_sizes, lambda c: (c < F.col("tier")) | (F.col("n") > 1))).alias("capacity"), "doc_id")
