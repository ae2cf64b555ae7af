"""Physical lines of several programs into entries with timestamp, level, component and message.

Literals that anchor a layout are found with one Aho-Corasick pass over a line and route it to
the parsers that need them; each of those verifies its anchored expression and extracts the
fields. A line that no parser accepts joins the entry above it.

Defined results: a line read twice counts once, in its longest reading; lines before the first header of a file have no
entry; blank lines are continuation lines; a null message counts as a blank line; a null file
path, or line number, is no line of a file. Equal headers are entries of their own. Very long
lines are read whole. An entry's message is one value of the result: its own lines meet in one
row, while the lines of a file never do.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from millrace.session import stored

#: Lines of a file that one task numbers; a file of any length is spread over its blocks.
BLOCK = 4096

_SEVERITY = ["emerg", "alert", "crit", "err", "warning", "notice", "info", "debug"]
_LEVELS = {
    "emerg": "emerg", "emergency": "emerg", "panic": "emerg", "alert": "alert", "crit": "crit", "critical": "crit", "fatal": "crit",
    "err": "err", "error": "err", "severe": "err", "warning": "warning", "warn": "warning", "notice": "notice",
    "info": "info", "information": "info", "informational": "info", "debug": "debug", "trace": "debug", "verbose": "debug",
    "i": "info", "w": "warning", "e": "err", "f": "crit", "d": "debug", "v": "debug",
}


def level_of(word: object) -> str:
    if word is None or isinstance(word, bool):
        return ""
    s = str(word).strip().lower()
    if s.isdigit():
        return _SEVERITY[int(s)] if int(s) < 8 else ""
    return _LEVELS.get(s, "")


_MON = "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
_ISO = r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?(?:Z|[+-]\d{2}:?\d{2})?"
_WORD = "|".join(sorted((w for w in _LEVELS if len(w) > 1), key=len, reverse=True))
_SD = r'(?:-|(?:\[[^\s=\]"]+(?: [^\s=\]"]+="(?:[^"\\\]]|\\.)*")*\])+)'
_RX = {
    "rfc5424": re.compile(rf"<(?P<pri>\d{{1,3}})>\d{{1,2}} (?P<ts>{_ISO}) \S+ (?P<comp>\S+) \S+ \S+ {_SD}(?: (?P<msg>.*))?$", re.S),
    "bsd": re.compile(rf"(?:<(?P<pri>\d{{1,3}})>)?(?P<ts>{_MON} [ \d]\d \d{{2}}:\d{{2}}:\d{{2}}) \S+ (?P<comp>[^\s:\[\]]+)(?:\[\d+\])?: ?(?P<msg>.*)$", re.S),
    "logger": re.compile(rf"(?P<ts>{_ISO}) +(?P<lvl>{_WORD}) +\[[^\]]*\] (?P<comp>\S+) +- ?(?P<msg>.*)$", re.S | re.I),
    "channel": re.compile(rf"\[(?P<ts>{_ISO})\] (?P<comp>[^\s/\]]+)[./](?P<lvl>{_WORD}): ?(?P<msg>.*)$", re.S | re.I),
    "semicolon": re.compile(rf"(?P<ts>\d{{1,2}}/\d{{1,2}}/\d{{4}} \d{{1,2}}:\d{{2}}:\d{{2}}(?: [AP]M)?);(?P<lvl>{_WORD});(?P<comp>[^;]*);(?P<msg>.*)$", re.S | re.I),
    "letter": re.compile(r"(?P<lvl>[IWEFDV])(?P<ts>\d{4} \d{2}:\d{2}:\d{2}(?:\.\d+)?) +\d+ (?P<comp>[^\s:\]]+):\d+\] ?(?P<msg>.*)$", re.S),
    "bracket": re.compile(rf"(?P<ts>\d{{4}}/\d{{2}}/\d{{2}} \d{{2}}:\d{{2}}:\d{{2}}(?:\.\d+)?) \[(?P<lvl>{_WORD})\] (?P<comp>[^\s:]+): ?(?P<msg>.*)$", re.S | re.I),
    "epoch": re.compile(rf"(?P<ts>\d{{9,10}}(?:\.\d+)?) \[(?P<lvl>{_WORD})\](?: \((?P<comp>[^)]*)\))?(?: (?P<msg>.*))?$", re.S | re.I),
}
_PAIR = re.compile(r'([A-Za-z@_][\w.@-]*)=("(?:[^"\\]|\\.)*"|\S*)(?: +|$)')
_TS_KEYS = ("@timestamp", "timestamp", "time", "ts")
_LVL_KEYS = ("level", "severity", "lvl", "loglevel")
_COMP_KEYS = ("component", "logger", "mod", "module", "app", "program")
_MSG_KEYS = ("message", "msg", "event")
_ESC = {"n": "\n", "t": "\t", "r": "\r", '"': '"', "\\": "\\"}

Entry = tuple[str, str, str, str]


def _by_regex(name: str) -> Callable[[str], Entry | None]:
    rx = _RX[name]

    def parse(line: str) -> Entry | None:
        m = rx.match(line)
        if not m:
            return None
        g = m.groupdict()
        if g.get("pri"):
            level = _SEVERITY[int(g["pri"]) & 7]
        else:
            level = level_of(g.get("lvl"))
        return g["ts"], level, "" if g["comp"] in (None, "-") else g["comp"], g["msg"] or ""

    return parse


def _pick(obj: dict, keys: tuple[str, ...]) -> object:
    return next((obj[k] for k in keys if k in obj and obj[k] is not None), None)


def _by_members(obj: dict) -> Entry | None:
    ts, msg = _pick(obj, _TS_KEYS), _pick(obj, _MSG_KEYS)
    if ts is None or msg is None or isinstance(ts, (dict, list)):
        return None
    comp = _pick(obj, _COMP_KEYS)
    return str(ts), level_of(_pick(obj, _LVL_KEYS)), comp if isinstance(comp, str) else "", msg if isinstance(msg, str) else json.dumps(msg, ensure_ascii=False)


def _json(line: str) -> Entry | None:
    if line[0] != "{" or line.rstrip()[-1] != "}":
        return None
    try:
        obj = json.loads(line, parse_float=str)
    except (ValueError, RecursionError):
        return None
    return _by_members(obj)


def _pairs(line: str) -> Entry | None:
    obj, at = {}, 0
    while m := _PAIR.match(line, at):
        v = m[2]
        if v[:1] == '"' and len(v) > 1:
            v = re.sub(r"\\(.)", lambda e: _ESC.get(e[1], e[0]), v[1:-1], flags=re.S)
        obj.setdefault(m[1], v)
        at = m.end()
    return _by_members(obj) if at == len(line) and obj else None


#: Parsers in order of trial, each with the literals of which a line of its layout holds one.
PARSERS: list[tuple[str, Callable[[str], Entry | None], tuple[str, ...]]] = [
    ("rfc5424", _by_regex("rfc5424"), (">1 ", ">2 ")),
    ("bsd", _by_regex("bsd"), tuple(f"{m} " for m in "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split())),
    ("logger", _by_regex("logger"), ("] ",)),
    ("channel", _by_regex("channel"), ("] ",)),
    ("semicolon", _by_regex("semicolon"), (";",)),
    ("letter", _by_regex("letter"), ("] ",)),
    ("bracket", _by_regex("bracket"), (" [",)),
    ("epoch", _by_regex("epoch"), ("]",)),
    ("json", _json, tuple(f'"{k}"' for k in _TS_KEYS)),
    ("pairs", _pairs, tuple(f"{k}=" for k in _TS_KEYS)),
]


def _automaton() -> ahocorasick.Automaton:
    masks: dict[str, int] = {}
    for i, (_, _, anchors) in enumerate(PARSERS):
        for a in anchors:
            masks[a] = masks.get(a, 0) | 1 << i
    auto = ahocorasick.Automaton()
    for a, mask in masks.items():
        auto.add_word(a, mask)
    auto.make_automaton()
    return auto


_AUTO = _automaton()


def parse_line(line: str | None) -> Entry | None:
    """(timestamp as written, level, component, message) of a line with a header of its own, else None."""
    if not line or line[0].isspace():
        return None
    line = line.rstrip("\r\n")
    if not line:
        return None
    found = 0
    for _, mask in _AUTO.iter(line):
        found |= mask
    i = 0
    while found:
        if found & 1 and (got := PARSERS[i][1](line)):
            return got
        found >>= 1
        i += 1
    return None


_ENTRY = T.StructType([T.StructField(x, T.StringType()) for x in ("entry_ts", "level", "component", "text")])


@F.pandas_udf(_ENTRY)
def _entry_udf(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for lines in batches:
        yield pd.DataFrame([parse_line(x) or (None, None, None, None if x is None else str(x)) for x in lines], columns=["entry_ts", "level", "component", "text"])


def parsed_lines(lines: DataFrame) -> DataFrame:
    """file_path, n, entry_ts (null for a continuation line), level, component, text: each line once."""
    once = (
        lines.where(F.col("file_path").isNotNull() & F.col("file_line_number").isNotNull())
        .groupBy("file_path", F.col("file_line_number").alias("n"))
        .agg(F.max(F.struct(F.length("raw_message").alias("size"), F.coalesce("raw_message", F.lit("")).alias("raw")))["raw"].alias("raw"))
    )
    return once.withColumn("e", _entry_udf("raw")).select("file_path", "n", "e.*")


def with_entry(parsed: DataFrame) -> DataFrame:
    """Adds first_line: the number of the header at or above each line; null above the first header.

    A running maximum in two levels: within blocks of a file's lines, and over the blocks' own
    maxima (one row each), so that no task holds more than BLOCK lines of a file.
    """
    head = F.when(F.col("entry_ts").isNotNull(), F.col("n"))
    rows = parsed.withColumn("block", F.floor(F.col("n") / BLOCK))
    tops = rows.groupBy("file_path", "block").agg(F.max(head).alias("top"))
    carry = tops.select("file_path", "block", F.max("top").over(W.partitionBy("file_path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)).alias("carry"))
    inner = rows.withColumn("own", F.max(head).over(W.partitionBy("file_path", "block").orderBy("n").rowsBetween(W.unboundedPreceding, 0)))
    return inner.join(carry, ["file_path", "block"]).withColumn("first_line", F.coalesce("own", "carry")).drop("own", "carry", "block")


def entries(lines: DataFrame) -> DataFrame:
    """file_path, first_line, entry_ts, level, component, message."""
    rows = with_entry(stored(parsed_lines(lines), "lines")).where(F.col("first_line").isNotNull())
    parts = F.sort_array(F.collect_list(F.struct("n", "text")))
    head = lambda c: F.max(F.when(F.col("entry_ts").isNotNull(), F.col(c)))
    grouped = rows.groupBy("file_path", "first_line").agg(head("entry_ts").alias("entry_ts"), head("level").alias("level"), head("component").alias("component"), parts.alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: p["text"]), "\n")
    return grouped.select("file_path", "first_line", "entry_ts", "level", "component", F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "").alias("message"))
