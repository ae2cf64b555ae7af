"""Evaluation texts that leaked into training text: rare n-gram seeds, then Smith-Waterman alignment.

The items' word n-grams are seeds. One pass over all documents reads each text once into word
hashes, tells which seeds it holds, and keeps the words of those with NEED places of seeds within
SPAN. How many documents hold a seed tells how rare it is: of the RARE rarest n-grams of each
window of RUN item words at least one must be held, and only those rare seeds join documents to
items. Where a document's seeds of an item lie that close, the two word sequences are aligned by a
local alignment without gaps in the item, which finds the longest run of successive item words
with each number of edits.

No leak is lost. A run of RUN words with one in ten edited keeps NEED of its n-grams whole (the
q-gram bound), within SPAN places as at most one word in ten is put in. A longer run holds such a
window of RUN words, or else (30 to 39 words with all three edits so far inside that every window
has them) begins with ten words in a row unedited, which are NEED n-grams as well. Seeds are
counted by place, so repeated wording counts as often as it stands.

Words are casefolded letters and digits; case, punctuation, spacing and markup (tags, entities,
list numbers, quote marks) do not count. Words are compared by 64-bit hashes.

Defined results: null or empty texts have no words; an item of fewer than RUN words can't leak;
repeated documents each count; without items nothing is found. Items are a stated evaluation set,
sent to the tasks in blocks of at most about BLOCK_CHARS characters; with several blocks the
documents are still read once, into a table of word hashes that each block scans.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.session import stored

N = 5
RUN = 20
NEED = RUN - N + 1 - N * (RUN // 10)
RARE = RUN - N + 1 - NEED + 1
#: Places of n-grams over which those NEED are spread: the window and the words put into it.
SPAN = RUN - N + 1 + RUN // 10
#: Characters of items whose words and seeds (8 bytes each) go to the driver and the tasks at once.
BLOCK_CHARS = 12_000_000

#: A tag: a name, attributes whose values may be quoted and of any length, the end.
_TAG = re.compile(r"""</?[A-Za-z][\w:.-]*(?:\s+[\w:.@-]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'<>=]+))?)*\s*/?>|<!--.*?-->""", re.S)
_MARK = re.compile(r"^[ \t]*(?:(?:>|[-*+•]|\d{1,4}[.)]|#{1,6})[ \t]+)+|^[ \t]*>+", re.M)
_WORD = re.compile(r"[^\W_]+")
_INVISIBLE = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")


def words_of(text: str | None) -> list[str]:
    if not text:
        return []
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = _INVISIBLE.sub("", unicodedata.normalize("NFKC", text))
    return _WORD.findall(_MARK.sub("", text).casefold())


_KNOWN: dict[str, int] = {}
_BASE = [pow(0x9E3779B97F4A7C15, N - 1 - i, 1 << 64) for i in range(N)]


def hashes_of(words: list[str]) -> np.ndarray:
    """A 64-bit hash of each word; a worker remembers the words it has met, up to a million."""
    if len(_KNOWN) > 1_000_000:
        _KNOWN.clear()
    out = []
    for w in words:
        h = _KNOWN.get(w)
        if h is None:
            h = _KNOWN[w] = xxhash.xxh64_intdigest(w)
        out.append(h)
    return np.array(out, dtype=np.uint64)


def grams(words: np.ndarray) -> np.ndarray:
    """A hash of each n-gram of word hashes."""
    if len(words) < N:
        return np.zeros(0, dtype=np.uint64)
    n = len(words) - N + 1
    out = np.zeros(n, dtype=np.uint64)
    for i, b in enumerate(_BASE):
        out += words[i : i + n] * np.uint64(b)
    return out


def _held(of: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values stand in a sorted array."""
    if not len(known):
        return np.zeros(len(of), dtype=bool)
    at = np.searchsorted(known, of)
    return known[np.minimum(at, len(known) - 1)] == of


def close(places: np.ndarray) -> bool:
    """Whether NEED of the sorted places lie within SPAN."""
    return len(places) >= NEED and bool((places[NEED - 1 :] - places[: len(places) - NEED + 1] < SPAN).any())


_DEAD = -(1 << 20)


def align(doc: np.ndarray, item: np.ndarray) -> tuple[int, int]:
    """(length, edits) of the best run of successive item words in doc, (0, 0) if none is long enough.

    Smith-Waterman over levels of edits: run[e, i] is the longest run that ends in item word i at
    the present word of doc with e edited words, held[e, i] the same with one foreign word put in
    after it; level 0 of both arrays is a dead one, so that levels shift by slices. A run begins
    and ends with equal words. Of runs that satisfy the bound, the longest.
    """
    m, levels = len(item), len(item) // 10 + 1
    equal = item == np.arange(item.max(initial=0) + 1)[:, None]
    where = [np.flatnonzero(e) for e in equal]
    least = np.maximum(RUN, 10 * np.arange(levels + 1))[:, None]
    run = np.full((levels + 2, m + 1), _DEAD, dtype=np.int32)
    new, held = run.copy(), run.copy()
    best, edits, foreign = 0, 0, levels + 2
    for w in doc.tolist():
        if not 0 <= w < len(where):
            foreign += 1
            if foreign > levels + 1:  # every run has spent its edits by now
                if foreign == levels + 2:
                    run[:], held[:] = _DEAD, _DEAD
                continue
            new[1:, 1:] = run[:-1, :-1]
            new[1:, 1:] += 1
        else:
            foreign = 0
            at = where[w]
            new[1:, 1:] = run[:-1, :-1]
            met = np.maximum(run[1:, at], held[1:, at])
            met[0] = np.maximum(met[0], 0)
            new[1:, at + 1] = met
            new[1:, 1:] += 1
            met += 1
            if met.max() >= RUN:
                ok = np.where(met >= least, met, 0)
                e, i = divmod(int(ok.argmax()), len(at))
                if ok[e, i] > best:
                    best, edits = int(ok[e, i]), e
        held[2:] = run[1:-1]
        run, new = new, run
    return best, edits


def rare_seeds(item: np.ndarray, spread: dict[int, int]) -> np.ndarray:
    """Which of an item's n-grams are, in some window of RUN words, among the RARE that the fewest documents hold."""
    gs = [int(g) for g in grams(item)]
    order = [(spread.get(g, 0), g) for g in gs]
    out = np.zeros(len(gs), dtype=bool)
    width = RUN - N + 1
    for lo in range(len(gs) - width + 1):
        out[sorted(range(lo, lo + width), key=order.__getitem__)[:RARE]] = True
    return out


class Seeds:
    """The items of a block, by number, with the places of their n-grams sorted by hash."""

    def __init__(self, items: dict[int, np.ndarray], spread: dict[int, int] | None = None) -> None:
        self.ids = list(items)
        self.words = list(items.values())
        gs = [grams(w) for w in self.words]
        every = np.concatenate([*gs, np.zeros(0, dtype=np.uint64)])
        owner = np.repeat(np.arange(len(gs)), [len(g) for g in gs])
        rare = np.concatenate([*[rare_seeds(w, spread) for w in self.words], np.zeros(0, dtype=bool)]) if spread is not None else np.ones(len(every), dtype=bool)
        order = np.argsort(every, kind="stable")
        self.gram, self.owner, self.rare = every[order], owner[order], rare[order]
        self.known = np.unique(every)


def leaked_in(words: np.ndarray, seeds: Seeds) -> list[tuple[int, int, int]]:
    """(item_id, length, edits) of every item that leaked into a document of these word hashes."""
    gs = grams(words)
    places = np.flatnonzero(_held(gs, seeds.known))
    lo, hi = np.searchsorted(seeds.gram, gs[places], "left"), np.searchsorted(seeds.gram, gs[places], "right")
    if not len(places):
        return []
    # every (place, item) whose n-gram is the same
    n = hi - lo
    at = np.repeat(places, n)
    which = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    owner, rare = seeds.owner[which], seeds.rare[which]
    out = []
    for k in np.unique(owner[rare]):
        got = np.unique(at[owner == k])
        if not close(got):
            continue
        item = seeds.words[k]
        vocabulary = np.unique(item)
        numbers = np.searchsorted(vocabulary, item).astype(np.int32)
        reach = len(item) + len(item) // 10 + N  # a run through a seed lies within so many words of it
        best = (0, 0)
        for part in np.split(got, np.flatnonzero(np.diff(got) > reach) + 1):
            if close(part):
                own = words[max(0, part[0] - reach) : part[-1] + reach + N]
                code = np.where(_held(own, vocabulary), np.searchsorted(vocabulary, own), -1).astype(np.int32)
                best = max(best, align(code, numbers))
        if best[0]:
            out.append((seeds.ids[k], *best))
    return out


_LEAKS = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("run_words", T.IntegerType()), T.StructField("edits", T.IntegerType())]))
_WORDS = T.ArrayType(T.LongType())
_FOUND = T.StructType([T.StructField("seeds", _WORDS), T.StructField("words", _WORDS)])
_RESULT = "doc_id bigint, item_id bigint, run_words int, edits int"


@F.pandas_udf(_WORDS)
def _hashed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([hashes_of(words_of(t)).view(np.int64) for t in texts], dtype=object)


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, run_words, edits of every leak."""
    held = items.where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select("item_id", "text")
    docs = documents.where(F.col("text").isNotNull()).select("doc_id", "text")
    blocks = max(1, -(-(held.agg(F.sum(F.length("text"))).first()[0] or 0) // BLOCK_CHARS))
    if blocks > 1:
        docs = stored(docs.select("doc_id", _hashed("text").alias("words")), "words")
    out = None
    for b in range(blocks):
        own = held.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b) if blocks > 1 else held
        part = _leaks_of_block(docs, {r[0]: hashes_of(words_of(r[1])) for r in own.collect()})
        out = part if out is None else out.unionByName(part)
    return out


def _leaks_of_block(docs: DataFrame, items: dict[int, np.ndarray]) -> DataFrame:
    spark = docs.sparkSession
    sc = spark.sparkContext
    items = {k: v for k, v in items.items() if len(v) >= RUN}
    if not items:
        return spark.createDataFrame([], _RESULT)
    known = sc.broadcast(Seeds(items).known)
    hashed = "words" in docs.columns

    @F.pandas_udf(_FOUND)
    def seeds(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        """The seeds of each text, and its words if enough of them lie close together."""
        for texts in batches:
            held, kept = [], []
            for t in texts:
                words = np.asarray(t, dtype=np.int64).view(np.uint64) if hashed else hashes_of(words_of(t))
                gs = grams(words)
                at = np.flatnonzero(_held(gs, known.value))
                held.append(np.unique(gs[at]).view(np.int64))
                kept.append(words.view(np.int64) if close(at) else None)
            yield pd.DataFrame({"seeds": held, "words": kept})

    # the one pass over all texts; written, so that texts without enough seeds are never read again
    found = stored(docs.select("doc_id", seeds("words" if hashed else "text").alias("s")).select("doc_id", "s.*"), "seeds")
    # documents per seed, over all documents: as many rows as the block has seeds
    spread = found.select(F.explode("seeds").alias("g")).groupBy("g").agg(F.count("*").alias("n")).toArrow()
    counts = dict(zip(spread.column("g").to_numpy().view(np.uint64).tolist(), spread.column("n").to_pylist()))
    shared = sc.broadcast(Seeds(items, counts))

    @F.pandas_udf(_LEAKS)
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[dict(zip(("item_id", "run_words", "edits"), x)) for x in leaked_in(np.asarray(w, dtype=np.int64).view(np.uint64), shared.value)] for w in texts], dtype=object)

    candidates = found.where(F.col("words").isNotNull()).select("doc_id", "words")
    return candidates.select("doc_id", F.explode(find("words")).alias("l")).select("doc_id", "l.*")
