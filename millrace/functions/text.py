"""Scalar functions over columns: everything here stays in the JVM."""

from __future__ import annotations


from pyspark.sql import Column
from pyspark.sql import functions as F

#: Separates the groups of a header after one pass of its expression; a private-use character.
SEP = "\ue000"


def pace() -> Column:
    """An argument that a UDF over rows that are mostly null takes and gives back, so that each row has bytes both ways.

    Rows wait in the JVM until Python's answers are read, and Spark reads none while the socket takes
    more input. Nulls are 4 bytes a row: the sockets' buffers hold those of a million rows, and as many
    wide rows wait, on disk when memory is short. With these bytes it is some 10,000s, however long the input.
    """
    return F.lit(" " * 256)


def groups(text: Column, rx: str, n: int) -> Column:
    """The n groups of rx, which must match the whole text, as an array; one element if it doesn't match."""
    marked = F.regexp_replace(text, rx, SEP.join(f"${i + 1}" for i in range(n)))
    return F.when(text.rlike(rx), F.split(marked, SEP, n)).otherwise(F.array(text))


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def is_digits(c: Column) -> Column:
    return c.rlike("^[0-9]{1,18}$")


def to_long(c: Column) -> Column:
    return F.when(is_digits(c), c.try_cast("bigint"))


def rfc3339_utc(c: Column) -> Column:
    """ISO text in UTC with Z of an RFC 3339 stamp: no fraction if it is 0, else six digits; null if invalid."""
    shape = c.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,6})?(Z|[+-]\d{2}:\d{2})$")
    return iso_utc(F.when(shape, c).try_cast("timestamp"))


def iso_utc(ts: Column) -> Column:
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    return F.concat(whole, F.when(F.unix_micros(ts) % 1_000_000 == 0, F.lit("Z")).otherwise(F.concat(F.lit("."), F.date_format(ts, "SSSSSS"), F.lit("Z"))))


def is_iso8601(c: Column) -> Column:
    """ISO-8601 with an offset."""
    shape = c.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}([.,]\d{1,9})?)?(Z|[+-]\d{2}:?\d{2})$")
    return shape & F.regexp_replace(F.regexp_replace(c, ",", "."), r"(\.\d{6})\d+", "$1").try_cast("timestamp").isNotNull()


def pri_parts(pri: Column) -> tuple[Column, Column]:
    """(facility, severity) of a syslog priority."""
    return F.floor(pri / 8).cast("bigint"), F.pmod(pri, F.lit(8)).cast("bigint")


def unquote(c: Column) -> Column:
    quoted = (F.length(c) >= 2) & c.startswith('"') & c.endswith('"')
    return F.when(quoted, F.replace(F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\"))).otherwise(c)


def cef_unescape(c: Column) -> Column:
    r"""\= \\ \n \r; other escapes stay as they are."""
    hidden = F.replace(c, F.lit("\\\\"), F.lit(SEP))
    for mark, to in (("\\=", "="), ("\\n", "\n"), ("\\r", "\r")):
        hidden = F.replace(hidden, F.lit(mark), F.lit(to))
    return F.when(F.contains(c, F.lit("\\")), F.replace(hidden, F.lit(SEP), F.lit("\\"))).otherwise(c)


def split_unescaped(c: Column, sep: str = r"\|") -> Column:
    """Split at separators that no odd run of backslashes escapes."""
    return F.regexp_extract_all(F.concat(F.lit(sep[-1]), c), F.lit(rf"(?s){sep}((?:[^\\{sep[-1]}]++|\\.|\\$)*+)"), 1)


def cef_severity(c: Column) -> Column:
    """0..10; words as their lower bound; null if neither."""
    word = F.lower(F.trim(c))
    words = {"unknown": 0, "low": 1, "medium": 4, "high": 8, "very-high": 10}
    by_word = F.element_at(F.create_map(*[x for k, v in words.items() for x in (F.lit(k), F.lit(v).cast("bigint"))]), word)
    return F.when(is_digits(F.trim(c)), F.least(F.lit(10).cast("bigint"), to_long(F.trim(c)))).otherwise(by_word)


def delimiter(c: Column) -> Column:
    """The character that a delimiter field means: itself, or a code point in hex."""
    code = F.regexp_extract(c, "^0?x([0-9A-Fa-f]{1,4})$", 1)
    return F.when(code != "", F.decode(F.unhex(F.lpad(code, 4, "0")), "UTF-16BE")).when(F.length(c) >= 1, F.substring(c, 1, 1))


def duration_seconds(c: Column) -> Column:
    p = F.split(c, ":")
    n = lambda i: F.get(p, F.lit(i)).try_cast("bigint")
    return F.when(c.rlike(r"^\d+:\d{2}:\d{2}$"), n(0) * 3600 + n(1) * 60 + n(2))


def leef_key(c: Column) -> Column:
    return F.regexp_replace(c, "[^A-Za-z0-9_.-]", "_")


def leef_value(c: Column) -> Column:
    for a, b in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def decode_bytes(b: Column) -> tuple[Column, Column, Column]:
    """(text, base64 of the bytes if they aren't UTF-8, note): Latin-1 maps such bytes without loss."""
    text = b.cast("string")
    good = F.is_valid_utf8(text)
    return (
        F.when(good, text).otherwise(F.decode(b, "ISO-8859-1")),
        F.when(~good, F.base64(b)),
        F.when(~good, F.lit("DECODE:invalid utf-8; latin-1 lossless byte mapping used")),
    )


# entries: array<struct<k string, v variant>>, the form that layers have until they become maps

ENTRY = "array<struct<k:string,v:variant>>"
TEXT_ENTRY = "array<struct<k:string,v:string>>"


def entry(k: Column | str, v: Column) -> Column:
    return F.struct((F.lit(k) if isinstance(k, str) else k).alias("k"), v.cast("variant").alias("v"))


def text_entry(k: Column | str, v: Column) -> Column:
    return F.struct((F.lit(k) if isinstance(k, str) else k).alias("k"), v.alias("v"))


def entries(*items: tuple[Column | str, Column, Column | None]) -> Column:
    """Entries of (key, value, condition or None): those whose condition holds; a null value stays as null."""
    always = [entry(k, v) for k, v, c in items if c is None]
    out = F.array(*always).cast(ENTRY)
    some = [F.when(c, entry(k, v)) for k, v, c in items if c is not None]
    return F.concat(out, F.filter(F.array(*some), lambda e: e.isNotNull()).cast(ENTRY)) if some else out


def text_entries(*items: tuple[Column | str, Column, Column | None]) -> Column:
    made = [F.when(c, text_entry(k, v)) if c is not None else text_entry(k, v) for k, v, c in items]
    return F.filter(F.array(*made), lambda e: e.isNotNull()).cast(TEXT_ENTRY)


def no_entries() -> Column:
    return F.array().cast(ENTRY)


def no_text_entries() -> Column:
    return F.array().cast(TEXT_ENTRY)


def notes(*items: tuple[Column | str, Column | None]) -> Column:
    made = [(F.lit(t) if isinstance(t, str) else t) if c is None else F.when(c, F.lit(t) if isinstance(t, str) else t) for t, c in items]
    return F.array_compact(F.array(*made)).cast("array<string>")


def last_wins(e: Column) -> Column:
    """Entries with the last value of each key."""
    keys = F.transform(e, lambda x: x["k"])
    kept = F.filter(e, lambda x, i: ~F.exists(F.slice(e, i + 2, F.size(e)), lambda y: y["k"] == x["k"]))
    return F.when(F.size(F.array_distinct(keys)) == F.size(e), e).otherwise(kept)


def literal_map(m: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in m.items() for x in kv])


def numbered(keys: Column) -> Column:
    """For each key how often it has come up so far, itself included."""
    dup = F.size(F.array_distinct(keys)) < F.size(keys)
    counts = F.transform(keys, lambda k, i: F.size(F.filter(F.slice(keys, 1, i + 1), lambda x: x == k)))
    return F.when(dup, counts).otherwise(F.transform(keys, lambda k: F.lit(1)))
