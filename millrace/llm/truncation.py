"""Texts that were cut: right-censored length distributions per source, and how a text ends.

Per source and unit (characters, UTF-8 bytes) the lengths are compressed to a histogram and a
log-normal is fitted by maximum likelihood in which lengths at a candidate limit are censored
there. Candidate limits are all lengths with more texts on them than on those around; one is a
limit if the fit does not allow as many either. The limit that holds most texts comes first, then
those that the other texts show, so a source may have several, in both units. A value's censoring
posterior is the share of the values on its own limit that the fit does not explain; a text longer
than that was not cut there. In bytes, a replacement character stands for one to three bytes. How
a text ends (mid-word, mid-sentence, an open code block, a broken character, a sign-off, a full
stop...) is the other evidence. Some endings mean what they are in any data (nobody ends inside a
word, an end mark of whatever script ends a text); the likelihood of the others among cut and whole
texts is learned by EM from all texts, with the censored values and those endings as anchors. Both
are combined into the posterior that a text is cut.

Whether a last word is whole is told by the corpus: a part of a word begins many words and is
hardly one itself. A source that ends without an end mark after whole words far more often than
its cuts inside words go with writes in that style, and is not cut.

Short closing lines (signatures, references, list items, catch phrases) are whole if they recur
as they are: a closing line that is the beginning of a much more frequent one is a cut of it.
A line that ends in dots is a phrase only if it closes more texts than cuts at that very place
would, given how many texts have a line with that beginning: a line that closes one text never
is. What recurs is counted in texts that differ in more than digits, so copies of a cut text
and the size of the corpus have no say.

Defined results: a null text is not judged; an empty text or one of white space is whole; a
null source is a source of its own; equal texts under several ids get equal verdicts if their
sources are equal; a source of few texts has no limit; texts that differ in digits only count
once for the limits.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.session import stored

CUT = 0.5
#: A limit needs this many values on it, and this many times what the fit expects there.
MIN_AT_LIMIT, EXCESS = 3, 10.0
#: And the fit must be this unlikely to put them there, over all lengths of the source.
UNLIKELY = 1e-3
#: Bytes of a character that a cut may have lost, or that its replacement may have added.
LOST, ADDED = 3, 2
#: A closing line is a cut of another if that one is this many times as frequent.
RATIO = 3
#: Dots close a text only as a phrase whose recurrence cuts don't explain: this unlikely over all dotted
#: lines, where a cut may fall on one place of a text this many times as often as on the average place.
CHANCE, UNEVEN = 0.01, 10.0
#: A closing line of more characters is a sentence like others unless it recurs as dotted ones must.
KEY_CHARS = 80
#: A text's last word is whole if of the words that begin like it at least this share are that word.
WHOLE_WORD = 0.02
#: Rows of a side that is broadcast, as counted; beyond it is joined by shuffle.
MAX_BROADCAST_ROWS = 100_000

#: What ends a sentence in any script, behind it what may close around it.
_STOP = regex.compile(r"[\p{Sentence_Terminal}][\p{Pe}\p{Pf}\p{Pi}\p{M}\"'*_`]*$")
_GREETING = re.compile(r"^\w[\w ]*,$")
_SPEAKER = re.compile(r"^[\w.-]+: ")
_ITEM = re.compile(r"^([-*•] |[A-Z]\w+: )")
_LAST = re.compile(r"[^\W\d_]+$")
#: Endings: what a text's last line looks like.
ENDINGS = ["broken", "open_block", "open", "open_word", "open_odd", "style", "closing", "stop", "block", "empty"]


def ending_of(text: str) -> tuple[str, str]:
    """(ending, key): key is what only recurrence can judge, the closing line with its numbers folded (how long a number is says nothing) or an open text's last word."""
    t = text.rstrip()
    if not t:
        return "empty", ""
    if t[-1] in "�\\" or t.endswith(("[...", "[…", "=")) or "\ud800" <= t[-1] <= "\udfff":
        return "broken", ""
    if t.count("```") % 2:
        return "open_block", ""
    if t.endswith("```"):
        return "block", ""
    at = t.rfind("\n")
    last, above = t[at + 1 :].strip(), t[t.rfind("\n", 0, max(at, 0)) + 1 : at].strip() if at >= 0 else ""
    dots = last.endswith(("...", "…"))
    if _STOP.search(last) and not dots:
        return "stop", ""
    key = re.sub(r"\d+", "9", _SPEAKER.sub("", last))
    if dots or above == "--" or _GREETING.match(above) or _ITEM.match(last):
        return "closing", key
    word = _LAST.search(last)
    return "open", word[0].lower() if word else ""


_END = T.StructType([T.StructField("ending", T.StringType()), T.StructField("key", T.StringType())])


@F.pandas_udf(_END)
def _ending_udf(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        yield pd.DataFrame([ending_of(t) for t in texts], columns=["ending", "key"])


_SPEAKER_SQL, _DIGIT_SQL = r"(?U)^[\w.-]+: ", r"(?U)\d+"


def _fold() -> Column:
    """Equal for texts that differ in digits only."""
    return F.xxhash64(F.regexp_replace("text", "[0-9]", "9"))


def _dotted(key: Column) -> Column:
    return key.endswith("...") | key.endswith("…")


def _doubtful(key: Column) -> Column:
    return _dotted(key) | (F.length(key) > KEY_CHARS)


@F.pandas_udf(T.DoubleType())
def _by_chance(n: pd.Series, mean: pd.Series) -> pd.Series:
    """P(at least n | at least 1) of a Poisson variable."""
    return pd.Series([1.0 if k <= 1 else min(1.0, poisson_tail(int(k), m) / -math.expm1(-m)) for k, m in zip(n, mean)], dtype=float)


def poisson_tail(k: int, mean: float) -> float:
    """P(at least k)."""
    if mean <= 0:
        return float(k <= 0)
    if k <= mean:  # not small: the complement is exact enough
        return max(0.0, 1 - sum(math.exp(i * math.log(mean) - mean - math.lgamma(i + 1)) for i in range(k)))
    total, term, i = 0.0, math.exp(k * math.log(mean) - mean - math.lgamma(k + 1)), k
    while term > total * 1e-16 and term > 0:
        total, i = total + term, i + 1
        term *= mean / i
    return min(1.0, total)


def phrases(documents: DataFrame, keys: DataFrame, measured: DataFrame) -> DataFrame | None:
    """key of every dotted or long closing line that is a phrase; None where no such line closes two texts.

    keys: key, n (texts it closes). The texts that have a line with that beginning, whether it goes
    on or not, are the chances of a cut there; they and n grow alike with the corpus.
    """
    doubtful = keys.where(_doubtful(F.col("key")))
    n_keys, n_texts = doubtful.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    several = stored(doubtful.where("n > 1").select("key", "n", F.regexp_replace("key", r"[.…]+$", "").alias("begin")), "dotted")
    lengths = sorted(r[0] for r in several.select(F.length("begin")).distinct().collect())  # of lines that recur
    if not lengths:
        return None
    chars = measured.select("fold", "chars").distinct().agg(F.sum("chars")).first()[0]
    lines = documents.where(F.col("text").isNotNull()).select(_fold().alias("fold"), F.explode(F.split("text", "\n")).alias("line"))
    line = F.trim("line")
    lines = lines.select("fold", F.when(line.contains(": "), F.regexp_replace(line, _SPEAKER_SQL, "")).otherwise(line).alias("line"))
    lines = lines.withColumn("line", F.when(F.col("line").rlike("(?U)\\d"), F.regexp_replace("line", _DIGIT_SQL, "9")).otherwise(F.col("line")))
    # most lines begin like none of them; a list of heads too long to test is not tested
    heads = [r[0] for r in several.select(F.substring("begin", 1, min(3, lengths[0]))).distinct().limit(1001).collect()]
    if len(heads) <= 1000:
        lines = lines.where(F.substring("line", 1, min(3, lengths[0])).isin(heads))
    begins = F.array_distinct(F.transform(F.array(*[F.lit(n) for n in lengths]), lambda n: F.col("line").substr(F.lit(1), n)))
    held = lines.select("fold", F.explode(begins).alias("begin")).join(several.select("begin").distinct(), "begin").distinct().groupBy("begin").agg(F.count("*").alias("texts"))
    mean = F.greatest(F.col("n"), F.coalesce("texts", F.lit(0))) * F.lit(UNEVEN * n_texts / max(1, chars))
    tried = several.join(held, "begin", "left").select("key", _by_chance(F.col("n"), mean).alias("p"))
    return tried.where(F.col("p") * n_keys < CHANCE).select("key")


def _small(side: DataFrame) -> DataFrame:
    return F.broadcast(side) if side.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS else side


def last_words(documents: DataFrame, measured: DataFrame) -> DataFrame:
    """key, open_as of the last words of open texts: open_word, or open_odd if nothing in the corpus begins like it; others are parts of words.

    A part of a word begins many words and is hardly one itself, in whatever language. The corpus is
    its own vocabulary; last words themselves have no say. Words combine to their counts before they move.
    """
    last = stored(measured.where("ending = 'open' AND key != ''").groupBy("key").agg(F.count("*").alias("n_last")), "last")
    words = documents.where(F.col("text").isNotNull()).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), 0)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    begins = words.select("word", "n", F.explode(F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.col("word").substr(F.lit(1), i))).alias("key"))
    n = begins.join(_small(last), "key").groupBy("key").agg(F.sum("n").alias("all"), F.sum(F.when(F.col("word") == F.col("key"), F.col("n")).otherwise(0)).alias("same"), F.max("n_last").alias("n_last"))
    others, same = F.col("all") - F.col("n_last"), F.col("same") - F.col("n_last")
    return n.select("key", F.when(others <= 0, "open_odd").when(same >= others * WHOLE_WORD, "open_word").alias("open_as")).where(F.col("open_as").isNotNull())


def _phi(z: np.ndarray | float) -> np.ndarray | float:
    return np.exp(-0.5 * np.square(z)) / np.sqrt(2 * np.pi)


def _upper(z: float) -> float:
    from math import erfc, sqrt

    return max(1e-300, 0.5 * erfc(z / sqrt(2)))


def censored_fit(x: np.ndarray, n: np.ndarray, limit: float | np.ndarray | None) -> tuple[float, float]:
    """Maximum-likelihood mean and deviation of log lengths, by EM.

    limit: a length, where values at or above it are censored; or which of the values are, each where it stands.
    """
    logs = np.log(x)
    if isinstance(limit, np.ndarray):
        cens, at = limit, logs[limit]
    else:
        cens = x >= limit if limit else np.zeros(len(x), dtype=bool)
        at = np.full(int(cens.sum()), np.log(limit) if limit else 0.0)
    seen, w, k, total = logs[~cens], n[~cens], n[cens], n.sum()
    if w.sum() < 2:
        return float(np.average(logs, weights=n)) if isinstance(limit, np.ndarray) else float(logs.mean()), 1.0
    mu, sd = float(np.average(seen, weights=w)), max(0.05, float(np.sqrt(np.cov(seen, fweights=w.astype(int), ddof=0))) if len(seen) > 1 else 0.5)
    for _ in range(60 if k.sum() else 0):
        z = (at - mu) / sd
        h = _phi(z) / np.array([_upper(v) for v in z])
        m1, m2 = mu + sd * h, mu**2 + sd**2 + sd * h * (at + mu)
        mu_new = (np.sum(w * seen) + np.sum(k * m1)) / total
        sd = max(0.05, float(np.sqrt(max(1e-6, (np.sum(w * seen**2) + np.sum(k * m2)) / total - mu_new**2))))
        mu = float(mu_new)
    return mu, sd


def _around(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Values per length in the neighbourhood of each of the sorted lengths, itself left out."""
    reach = np.maximum(5, np.floor(x / 20))
    sums = np.concatenate([[0.0], np.cumsum(n)])
    return (sums[np.searchsorted(x, x + reach, "right")] - sums[np.searchsorted(x, x - reach, "left")] - n) / (2 * reach)


def _peak(x: np.ndarray, n: np.ndarray, gone: tuple[np.ndarray, np.ndarray]) -> tuple[float, float, float, float, float] | None:
    """(texts, limit, posterior, mu, sigma) of the limit that holds most texts; gone: lengths and numbers on limits known before."""
    around = _around(x, n)
    likely = (n >= MIN_AT_LIMIT) & (n > EXCESS * around)
    if not likely.any():
        return None
    every, each = np.concatenate([x, gone[0]]), np.concatenate([n, gone[1]])
    mu, sd = censored_fit(every, each, np.concatenate([likely, np.ones(len(gone[0]), dtype=bool)]))
    # expected on the limit itself, were it no limit: density of the uncensored fit at that length
    expected = np.maximum(each.sum() * _phi((np.log(x) - mu) / sd) / (sd * x), around)
    best = None
    for i in np.flatnonzero(likely & (n > EXCESS * expected)):
        if poisson_tail(int(n[i]), float(expected[i])) * len(x) < UNLIKELY and (best is None or (n[i], x[i]) > best[:2]):
            best = (float(n[i]), float(x[i]), max(0.0, 1 - float(expected[i] / n[i])), mu, sd)
    return best


def fit_source(pdf: pd.DataFrame) -> pd.DataFrame:
    """One row per source: its limits, the one that holds most texts first, and what the fit says of that one."""
    source = pdf["source"].iloc[0]
    rest = pdf[pdf["chars"] > 0]
    on: dict[str, list[pd.DataFrame]] = {"chars": [], "bytes": []}
    limits: list[dict] = []
    first = (None, None)
    while True:
        best, unit = None, ""
        for u in ("chars", "bytes"):
            own = rest if u == "chars" else rest[~rest["replaced"]]
            h = own.groupby(u)["n"].sum()
            if h.empty:
                continue
            past = [g.groupby(u)["n"].sum() for g in on["chars"] + on["bytes"]]
            known = pd.concat(past) if past else h[:0]
            p = _peak(h.index.to_numpy(float), h.to_numpy(float), (known.index.to_numpy(float), known.to_numpy(float)))
            if p and (best is None or p[0] > best[0]):
                best, unit = p, u
        if best is None:
            break
        limit = best[1]
        if not limits:
            first = best[3:]
        limits.append({"limit": limit, "unit": unit, "at_limit": best[2]})
        at = rest[unit]
        taken = at == limit if unit == "chars" else at.between(limit - LOST, limit) | (rest["replaced"] & at.between(limit, limit + ADDED))
        on[unit].append(rest[taken])
        rest = rest[~taken]
    if not limits and len(pdf[pdf["chars"] > 0]):
        h = pdf[pdf["chars"] > 0].groupby("chars")["n"].sum()
        first = censored_fit(h.index.to_numpy(float), h.to_numpy(float), None)
    top = limits[0] if limits else {"limit": None, "unit": None, "at_limit": 0.0}
    return pd.DataFrame([{"source": source, **top, "mu": first[0], "sigma": first[1], "limits": limits}])


_FIT = "source string, limit double, unit string, at_limit double, mu double, sigma double, limits array<struct<limit: double, unit: string, at_limit: double>>"


def source_fits(measured: DataFrame) -> DataFrame:
    """The fit of every source, from its histogram of lengths in both units: as many rows as pairs of them."""
    once = measured.select(F.coalesce("source", F.lit("")).alias("source"), "fold", "chars", "bytes", "replaced").distinct()
    hist = once.groupBy("source", "chars", "bytes", "replaced").agg(F.count("*").alias("n"))
    return hist.groupBy("source").applyInPandas(fit_source, _FIT)


#: How sure an ending alone is that the text is cut. A full stop or a closed block is an end even
#: where the text fills its field to the last character, and nobody ends inside a word, a character,
#: a block, or with dots that are no phrase: what these say is not up to the data. Of the others it is the EM's prior.
SURE = {
    "broken": 0.99, "open_block": 0.98, "open": 0.97, "open_word": 0.9, "open_odd": 0.9, "closing_cut": 0.95, "dots": 0.9,
    "style": 0.05, "closing": 0.01, "stop": 1e-5, "block": 1e-5, "empty": 1e-9,
}
MEANT = {"broken", "open_block", "open", "dots", "stop", "block", "empty"}
#: That prior counts as so many texts of each ending, whatever the number of texts.
PRIOR_TEXTS = 50.0
#: Of cut texts without an end mark, how many are cut inside a word, after one, in none that is known; with the texts' own counts from the limits added.
CUT_IN = {"open": 14.0, "open_word": 4.0, "open_odd": 2.0}


def ending_weights(counts: list[tuple[str, float, int]]) -> tuple[dict[str, float], float]:
    """(likelihood ratio cut : whole of each ending, share of cut texts off the limits), by EM.

    counts: (ending, censoring posterior, number of texts). A handful of rows whatever the input.
    """
    ratio: dict[str, float] = {}
    base = 0.05
    sure = lambda e, c: c + (1 - c) * SURE[e] if SURE[e] > 1e-3 else SURE[e]
    resp = {(e, c): sure(e, c) for e, c, _ in counts}
    for _ in range(20):
        cut, whole = {e: PRIOR_TEXTS * p for e, p in SURE.items()}, {e: PRIOR_TEXTS * (1 - p) for e, p in SURE.items()}
        off_cut, off_all = 0.5, 10.0
        for e, c, n in counts:
            r = resp[e, c]
            cut[e] += n * r
            whole[e] += n * (1 - r)
            if c < CUT:
                off_cut, off_all = off_cut + n * r, off_all + n
        zc, zw = sum(cut.values()), sum(whole.values())
        ratio = {e: (cut[e] / zc) / (whole[e] / zw) for e in SURE}
        base = off_cut / off_all
        for e, c, _ in counts:
            prior = c + (1 - c) * base
            odds = prior / max(1e-9, 1 - prior) * ratio[e]
            resp[e, c] = sure(e, c) if e in MEANT else odds / (1 + odds)
    return ratio, base


def habits(rows: DataFrame, counts: list[tuple[str, float, int]]) -> DataFrame:
    """_source, as_cut map of ending -> share of a source's texts with that open ending that cuts explain.

    Cuts fall inside words as often as the texts on the limits tell; a source that ends without an
    end mark after whole words much more often than its cuts inside words go with writes that way:
    that is its style.
    """
    at_limit = {e: p + sum(n for x, c, n in counts if x == e and c >= 0.9) for e, p in CUT_IN.items()}
    total = sum(at_limit.values())
    n = {e: F.count_if((F.col("ending") == e) & (F.col("censored") < CUT)) for e in CUT_IN}
    per = rows.groupBy(F.coalesce("source", F.lit("")).alias("_source")).agg(*[c.alias(e) for e, c in n.items()])
    cuts = (F.col("open") + 1) / (at_limit["open"] / total)
    share = lambda e: F.least(F.lit(1.0), (cuts * (at_limit[e] / total) + 1) / (F.col(e) + 1))
    return per.select("_source", F.create_map(F.lit("open_word"), share("open_word"), F.lit("open_odd"), share("open_odd")).alias("as_cut"))


def judged(documents: DataFrame) -> DataFrame:
    """doc_id, source, chars, limit and unit (the source's foremost), ending, censored (posterior by length), posterior (that the text is cut)."""
    base_rows = documents.where(F.col("text").isNotNull()).select(
        "doc_id", "source", F.length("text").cast("long").alias("chars"), F.octet_length("text").cast("long").alias("bytes"), _fold().alias("fold"), F.endswith("text", F.lit("\ufffd")).alias("replaced"), _ending_udf("text").alias("e")
    )
    measured = stored(base_rows.select("doc_id", "source", "chars", "bytes", "fold", "replaced", "e.*"), "endings")
    # closing lines that begin a much more frequent one; both sides combine to distinct lines before they move
    keys = measured.where("ending = 'closing'").select("key", "fold").distinct().groupBy("key").agg(F.count("*").alias("n"))
    shorter = F.sequence(F.lit(1), F.greatest(F.least(F.length("key") - 1, F.lit(KEY_CHARS)), F.lit(1)))
    longer = keys.select(F.explode(F.transform(shorter, lambda i: F.col("key").substr(F.lit(1), i))).alias("key"), F.col("n").alias("m"), F.length("key").alias("len"))
    longer = longer.where("length(key) < len").groupBy("key").agg(F.max("m").alias("m"))
    kept = phrases(documents, keys, measured)
    keys = keys.withColumn("phrase", F.lit(None).cast("boolean")) if kept is None else keys.join(kept.withColumn("phrase", F.lit(True)), "key", "left")
    verdict = F.when(_doubtful(F.col("key")) & F.col("phrase").isNull(), F.when(_dotted(F.col("key")), "dots").otherwise("open")).when(F.col("m") >= RATIO * F.col("n"), "closing_cut")
    odd_keys = keys.join(longer, "key", "left").select(F.lit("closing").alias("ending"), "key", verdict.alias("verdict")).where(F.col("verdict").isNotNull())
    odd_keys = odd_keys.unionByName(last_words(documents, measured).select(F.lit("open").alias("ending"), "key", F.col("open_as").alias("verdict")))
    own = F.coalesce("source", F.lit(""))
    fits = source_fits(measured).withColumnRenamed("source", "_source")

    def censored(lim: Column) -> Column:
        """The posterior of a limit if the text stands on it: a cut may have lost part of a character, or replaced it."""
        n, at = F.col("bytes"), lim["limit"]
        on_bytes = F.when((n == at) | (F.col("replaced") & n.between(at, at + ADDED)), lim["at_limit"]).when(n.between(at - LOST, at), lim["at_limit"] / 2)
        return F.coalesce(F.when(lim["unit"] == "bytes", on_bytes).when(F.col("chars") == at, lim["at_limit"]), F.lit(0.0))

    # texts that have no key get one of their own, or they would all meet in one task; the verdicts, a row per key, are broadcast if few
    keyed = measured.withColumn("key", F.when(F.col("key") != "", F.col("key")).otherwise(F.concat(F.lit("\u0000"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    rows = keyed.join(_small(stored(odd_keys, "verdicts")), ["ending", "key"], "left").join(fits, own == F.col("_source"), "left").select(
        "doc_id", "source", "chars", "limit", "unit", F.coalesce("verdict", "ending").alias("ending"),
        F.coalesce(F.array_max(F.transform("limits", censored)), F.lit(0.0)).alias("censored"),
    )
    rows = stored(rows, "judged")
    tally = lambda df: [(r[0], r[1], r[2]) for r in df.groupBy("ending", F.round("censored", 2).alias("c")).count().collect()]  # noqa: E731  endings x 101 at most
    by_habit = F.element_at("as_cut", F.col("ending")) < CUT
    rows = rows.join(habits(rows, tally(rows)), own == F.col("_source"), "left").withColumn("ending", F.when(by_habit, "style").otherwise(F.col("ending"))).drop("_source", "as_cut")
    ratio, base = ending_weights(tally(rows))
    of = lambda values: F.element_at(F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(float(v)))]), F.col("ending"))
    prior = F.col("censored") + (1 - F.col("censored")) * F.lit(float(base))
    odds = prior / F.greatest(F.lit(1e-9), 1 - prior) * of(ratio)
    sure = of({k: SURE[k] for k in sorted(MEANT)})
    meant = F.when(sure > 1e-3, F.col("censored") + (1 - F.col("censored")) * sure).otherwise(sure)
    return rows.withColumn("posterior", F.coalesce(meant, odds / (1 + odds)))


def rates(judgement: DataFrame) -> DataFrame:
    """source, n_docs, n_cut, rate, limit, unit: how often each source cuts."""
    return judgement.groupBy("source").agg(
        F.count("*").alias("n_docs"), F.count_if(F.col("posterior") >= CUT).alias("n_cut"), (F.count_if(F.col("posterior") >= CUT) / F.count("*")).alias("rate"),
        F.max("limit").alias("length_limit"), F.max("unit").alias("unit"),
    )
