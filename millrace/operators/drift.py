"""Schemas that drift between files: rescue-column ingestion and a report of every change.

Each layer of a row is a JSON object in text. Its top-level members are cells (field, kind,
value). A target schema is enforced on them: what it knows and what casts without loss goes to a
typed column, everything else stays as JSON in a rescue column. Fields that are approved later
are promoted, and rescued values are replayed into the typed columns.

The report is read off that ingestion. Every file is held against the schema of the file before
it in its stream: a field all of whose cells are rescued because the schema doesn't know it is
added; one whose values are rescued for their type, more of one type than the schema takes, is
retyped; one that the schema leaves without a cell is removed. What was added or retyped is
promoted into the schema the next file meets. Renames come from values that stood under a lost
name in the file before.

Cells are read by built-in functions. Only objects whose members those change (repeated keys,
numbers of more digits than a double holds, exponents, NaN) are read in Python.

Defined results: a null layer or no JSON object: no cells; a duplicate key: its last value; null
values: the field is there but has no say in its type; a field of nulls only has type '' and is
never retyped; equal majorities: the type first in TYPES; a file without rows has no fields; text
after the object does not count; half a surrogate pair is read as U+FFFD; rows of no known file
meet no schema and are in no report or table.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from millrace.session import stored

TYPES = ["text", "whole", "decimal", "boolean", "array", "object"]
LAYERS = ["vendor_fields", "unknown_fields"]
#: Changed fields are broadcast up to this many, as counted; beyond they are joined by shuffle.
MAX_BROADCAST_ROWS = 100_000

_CELL = T.ArrayType(
    T.StructType([T.StructField("field", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("value", T.StringType())])
)
_CELL_SQL = "array<struct<field:string,kind:string,value:string>>"


class _Number(str):
    """A number as it is written."""


class _Decimal(str):
    """A number written with a fraction or an exponent."""


def _dump(v: object) -> str:
    if isinstance(v, (_Number, _Decimal)):
        return str(v)
    if isinstance(v, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{_dump(v[k])}" for k in sorted(v)) + "}"
    if isinstance(v, list):
        return "[" + ",".join(map(_dump, v)) + "]"
    return json.dumps(v, ensure_ascii=False)


_READ = json.JSONDecoder(parse_int=_Number, parse_float=_Decimal)


def _whole_pairs(text: str) -> str:
    return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def cells_of(text: str | None) -> list[tuple[str, str | None, str | None]]:
    """(field, kind, value) of each member of a JSON object: a text as it reads, anything else as JSON; both None for null."""
    try:
        obj = _READ.raw_decode(text.lstrip(" \t\r\n"))[0] if text else None
    except (ValueError, RecursionError):
        return []
    if not isinstance(obj, dict):
        return []
    out = []
    for k, v in obj.items():
        if v is None:
            kind = None
        elif isinstance(v, _Number):
            kind = "whole"
        elif isinstance(v, (_Decimal, float)):
            kind = "decimal"
        else:
            kind = {str: "text", bool: "boolean", list: "array", dict: "object"}[type(v)]
        said = None if v is None else v if kind == "text" else _dump(v)
        out.append((_whole_pairs(k), kind, said and _whole_pairs(said)))
    return out


@F.pandas_udf(_CELL)
def _cells_udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([None if t is None else [dict(zip(("field", "kind", "value"), c)) for c in cells_of(t)] for t in texts], dtype=object)


#: Reading options: limits of the parser are no limits of the data.
_JSON = {"allowSingleQuotes": "false", "maxNumLen": "2147483647", "maxStringLen": "2147483647"}
#: Numbers that a double does not keep, exponents and what is no JSON number, wherever they may stand.
_INEXACT = r"[:\[,]\s*-?(?:[0-9.]*[eE]|NaN|Inf|(?=[0-9.]{16})[0-9]*\.)"


def _kind(shape: Column, said: Column) -> Column:
    number = F.when(said.rlike(r"^-?[0-9]+$"), "whole").otherwise("decimal")
    return F.when(shape == "STRING", "text").when(shape == "BOOLEAN", "boolean").when(shape == "ARRAY", "array").when(shape == "OBJECT", "object").when(shape != "VOID", number)


def _value(shape: Column, said: Column, meant: Column) -> Column:
    return F.when(shape.isin("ARRAY", "OBJECT"), F.to_json(meant)).when(shape != "VOID", said)


def _shape(meant: Column) -> Column:
    return F.substring_index(F.schema_of_variant(meant), "<", 1)


def _pairs(rows: DataFrame, text: Column) -> DataFrame:
    """Adds _pairs array<struct<k, s, v>> of the objects that built-in functions read exactly, and _read, the cells of the others.

    Each reading is a column of its own before it is used: an expression inside a lambda is
    computed as often as it stands there.
    """
    out = rows.withColumns({"_said": F.from_json(text, "map<string,string>", _JSON), "_meant": F.from_json(text, "map<string,variant>", _JSON)})
    keys = F.map_keys("_said")
    exact = ~text.rlike(_INEXACT) & F.col("_meant").isNotNull() & (F.size(keys) == F.size(F.array_distinct(keys))) & ~text.contains("\\ud") & ~text.contains("\\uD")
    out = out.withColumn("_exact", F.coalesce(exact, F.lit(False)))
    pairs = F.when(F.col("_exact"), F.arrays_zip(keys.alias("k"), F.map_values("_said").alias("s"), F.map_values("_meant").alias("v")))
    out = out.withColumn("_read", _cells_udf(F.when(~F.col("_exact") & text.isNotNull(), text)))
    return out.withColumn("_pairs", pairs).drop("_said", "_meant", "_exact")


def _cells(rows: DataFrame, json_column: str, name: str) -> DataFrame:
    """rows with the cells of a column of JSON objects."""
    out = _pairs(rows, F.col(json_column))
    shaped = F.transform("_pairs", lambda x: F.struct(x["k"].alias("k"), x["s"].alias("s"), x["v"].alias("v"), _shape(x["v"]).alias("shape")))
    out = out.withColumn("_shaped", shaped)
    built_in = F.transform("_shaped", lambda x: F.struct(x["k"].alias("field"), _kind(x["shape"], x["s"]).alias("kind"), _value(x["shape"], x["s"], x["v"]).alias("value")))
    return out.withColumn(name, F.coalesce(built_in, "_read")).drop("_shaped", "_pairs", "_read")


def cells(rows: DataFrame, keep: list[str], layers: list[str] = LAYERS) -> DataFrame:
    """keep..., layer, field, kind, value: one row per top-level member of each layer."""
    layer = F.explode(F.array(*[F.struct(F.lit(x).alias("layer"), F.col(x).alias("json")) for x in layers]))
    flat = rows.select(*keep, layer.alias("_l")).select(*keep, "_l.layer", F.col("_l.json").alias("_json"))
    out = _pairs(flat, F.col("_json"))
    # one list of both readings; what was read in Python has its kind already
    both = F.coalesce(
        F.transform("_pairs", lambda x: F.struct(x["k"].alias("k"), x["s"].alias("s"), x["v"].alias("v"), F.lit(None).cast("string").alias("kind"))),
        F.transform("_read", lambda x: F.struct(x["field"].alias("k"), x["value"].alias("s"), F.lit(None).cast("variant").alias("v"), F.coalesce(x["kind"], F.lit("")).alias("kind"))),
    )
    out = out.select(*keep, "layer", F.explode(both).alias("_c")).select(*keep, "layer", "_c.*").withColumn("_shape", F.when(F.col("kind").isNull(), _shape(F.col("v"))))
    kind = F.when(F.col("kind").isNull(), _kind(F.col("_shape"), F.col("s"))).when(F.col("kind") != "", F.col("kind"))
    value = F.when(F.col("kind").isNull(), _value(F.col("_shape"), F.col("s"), F.col("v"))).otherwise(F.col("s"))
    return out.select(*keep, "layer", F.col("k").alias("field"), kind.alias("kind"), value.alias("value"))


def as_json(kind: Column, value: Column) -> Column:
    """A cell's value as JSON text."""
    quoted = F.to_json(F.array(value))
    return F.when(kind == "text", F.substring(quoted, F.lit(2), F.length(quoted) - 2)).otherwise(value)


def ordered_files(files: DataFrame) -> DataFrame:
    """file_id, stream_id, ord: the place of each file in its stream. One row per file, so the window is small."""
    return files.select("file_id", "stream_id", F.row_number().over(W.partitionBy("stream_id").orderBy("opened_at", "file_id")).alias("ord"))


def _types(per_kind: DataFrame) -> DataFrame:
    """stream_id, ord, layer, field, kind: the type that most non-null values have, '' if there is none."""
    rank = F.element_at(F.create_map(*[x for i, k in enumerate(TYPES) for x in (F.lit(k), F.lit(-i))]), F.col("kind"))
    best = F.max(F.when(F.col("kind").isNotNull(), F.struct(F.col("n"), rank.alias("r"), F.col("kind").alias("k"))))
    return per_kind.groupBy("stream_id", "ord", "layer", "field").agg(F.coalesce(best["k"], F.lit("")).alias("kind"))


def knows(target: Column, kind: Column) -> Column:
    """Whether a schema takes a cell of that kind: null values always, others if they are of the field's own type or the field has none yet."""
    return target.isNotNull() & (kind.isNull() | (target == "") | (kind == target))


def _met(files: DataFrame, now: DataFrame) -> DataFrame:
    """file_id, layer, field, target: the schema each file meets, which is what the file before it promoted."""
    before = now.select("stream_id", (F.col("ord") + 1).alias("ord"), "layer", "field", F.col("kind").alias("target"))
    return before.join(files, ["stream_id", "ord"]).select("file_id", "layer", "field", "target")


def _joined(df: DataFrame, side: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join with a small stored side, broadcast if its count allows it."""
    small = side.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS
    return df.join(F.broadcast(side) if small else side, on, how)


def changes(files: DataFrame, rows: DataFrame) -> DataFrame:
    """file_id, layer, change, field, old_field for every file against the one before it in its stream.

    The first pass moves counts per file, field and kind, combined on the map side: as many rows
    as the files' schemas have. Values are compared in a second pass over the files that both
    lost and gained fields, and only the values of those fields move, as hashes, combined per file.
    """
    ordered = ordered_files(files)
    counted = stored(cells(rows, ["file_id"]).groupBy("file_id", "layer", "field", "kind").agg(F.count("*").alias("n")), "cells")
    now = _types(counted.join(ordered, "file_id"))
    # ingestion of each file under the schema of the file before; the first file of a stream is its baseline
    later = ordered.where("ord > 1").select("file_id")
    met = _met(ordered, now)
    got = counted.join(later, "file_id").withColumn("_there", F.lit(True)).join(met, ["file_id", "layer", "field"], "full")
    rescued = F.col("_there") & ~F.coalesce(knows(F.col("target"), F.col("kind")), F.lit(False))
    rank = F.element_at(F.create_map(*[x for i, k in enumerate(TYPES) for x in (F.lit(k), F.lit(-i))]), F.col("kind"))
    weight = F.struct(F.col("n"), rank.alias("r"))
    held = got.groupBy("file_id", "layer", "field", "target").agg(
        F.max("_there").alias("there"), F.max(F.when(rescued & F.col("kind").isNotNull(), weight)).alias("most_rescued"),
        F.max(F.when(~rescued & F.col("kind").isNotNull(), weight)).alias("most_taken"),
    )
    outvoted = F.col("most_rescued").isNotNull() & (F.col("most_taken").isNull() | (F.col("most_rescued") > F.col("most_taken")))
    change = F.when(F.col("target").isNull(), "added").when(F.col("there").isNull(), "removed").when((F.col("target") != "") & outvoted, "retyped")
    marked = stored(held.select("file_id", "layer", "field", change.alias("change")).where(F.col("change").isNotNull()), "marked")
    rest, renamed = _renames(ordered, rows, marked)
    return rest.select("file_id", "layer", "change", "field", F.lit("").alias("old_field")).unionByName(renamed)


def _renames(ordered: DataFrame, rows: DataFrame, marked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What of marked is left, and the renamed fields: a new field most of whose values stood under a lost name in the file before."""
    at = ["file_id", "layer"]
    moves = marked.where("change != 'retyped'").groupBy(*at).agg(F.max(F.col("change") == "added").alias("a"), F.max(F.col("change") == "removed").alias("r")).where("a AND r").select(*at)
    before = ordered.select(F.col("file_id").alias("prev"), "stream_id", (F.col("ord") + 1).alias("ord")).join(ordered.select("file_id", "stream_id", "ord"), ["stream_id", "ord"]).select("prev", "file_id")
    asked = marked.where("change != 'retyped'").join(moves, at).join(before, "file_id")
    # place: the file whose values are asked for; file_id: the file that changed
    asked = stored(asked.select(F.when(F.col("change") == "added", F.col("file_id")).otherwise(F.col("prev")).alias("place"), "file_id", "layer", "field", "change"), "asked")
    small = asked.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS
    side = F.broadcast if small else (lambda df: df)
    own = rows.select(F.col("file_id").alias("place"), *LAYERS).join(side(asked.select("place").distinct()), "place")
    values = cells(own, ["place"]).where(F.col("kind").isNotNull())
    h = F.xxhash64(F.col("kind") == "text", "value").alias("h")
    # a field may be new in its file and lost in the next one: counted once, then joined with what is asked
    seen = values.join(side(asked.select("place", "layer", "field").distinct()), ["place", "layer", "field"]).groupBy("place", "layer", "field", h).agg(F.count("*").alias("n"))
    seen = stored(seen.join(asked, ["place", "layer", "field"]).select(*at, "field", "change", "h", "n"), "values")
    new = seen.where("change = 'added'").drop("change")
    lost = seen.where("change = 'removed'").select(*at, F.col("field").alias("old_field"), "h")
    total = new.groupBy(*at, "field").agg(F.sum("n").alias("total"))
    share = (
        new.join(lost, [*at, "h"]).groupBy(*at, "field", "old_field").agg(F.sum("n").alias("same"))
        .join(total, [*at, "field"]).where(F.col("same") * 2 > F.col("total"))
        .withColumn("share", F.col("same") / F.col("total"))
    )
    # the best partner on both sides; fields of one file, so these windows are small
    best = share.withColumn("a", F.row_number().over(W.partitionBy(*at, "field").orderBy(F.desc("share"), F.desc("same"), "old_field"))).where("a = 1")
    best = best.withColumn("b", F.row_number().over(W.partitionBy(*at, "old_field").orderBy(F.desc("share"), F.desc("same"), "field"))).where("b = 1")
    renamed = stored(best.select(*at, "field", "old_field"), "renamed")
    gone = renamed.select(*at, "field", F.lit("added").alias("change")).union(renamed.select(*at, "old_field", F.lit("removed")))
    rest = marked.join(gone, [*at, "field", "change"], "left_anti")
    return rest, renamed.select(*at, F.lit("renamed").alias("change"), "field", "old_field")


#: What a target type accepts of a cell, as a Spark type.
_CAST = {"text": "string", "whole": "decimal(38,0)", "decimal": "double", "boolean": "boolean", "array": "string", "object": "string"}


def _exact(value: Column) -> Column:
    """The number as a double, or null if the double does not keep all its digits: 15 always are, more if it prints as they stand."""
    x = value.try_cast("double")
    digits = F.length(F.regexp_replace(F.regexp_replace(value, r"[eE].*$|[-.]", ""), r"^0+|0+$", ""))
    kept = (digits == 0) | ((digits <= 15) & F.abs(x).between(2.3e-308, 1.7e308)) | (x.cast("string") == value)
    return F.when(kept, x)


def _typed(kind: str, have: Column, value: Column) -> Column:
    """The value as the target type, or null if it can't be cast without loss."""
    if kind == "decimal":
        return F.when(have.isin("decimal", "whole"), _exact(value))
    return F.when(have == kind, value.try_cast(_CAST[kind]))


AS = ["as_text", "as_whole", "as_decimal", "as_boolean", "as_json"]


def enforce(cells: DataFrame, keep: list[str]) -> DataFrame:
    """keep..., target, as_... (a column per type), rescued of cells with their target type: a value is in one column or rescued as JSON.

    The same casts as in ingest, for cells of many schemas at once. A cell without a target is rescued.
    """
    target, have, value = F.col("target"), F.col("kind"), F.col("value")
    json_value = F.coalesce(*[F.when(target == k, _typed(k, have, value)) for k in ("array", "object")])
    columns = {f"as_{k}": F.when(target == k, _typed(k, have, value)) for k in ("text", "whole", "decimal", "boolean")} | {"as_json": json_value}
    out = cells.select(*keep, "target", "kind", "value", *[c.alias(k) for k, c in columns.items()])
    held = F.coalesce(*[F.col(k).cast("string") for k in columns]).isNotNull()
    return out.withColumn("rescued", F.when(~held, as_json(have, value))).drop("kind", "value")


def typed(files: DataFrame, rows: DataFrame, keep: list[str]) -> DataFrame:
    """keep..., stream_id, layer, field, target, as_..., rescued, how: one consistent table of all rows.

    Each file's cells are ingested under the schema of the file before (a stream's first file under
    its own). Then the fields of the stream are approved with the type that most values of all its
    files have, and replayed: what was rescued, or held as another type, is cast again. how is held,
    replayed or rescued; null for a null value.
    """
    ordered = ordered_files(files)
    counted = stored(cells(rows, ["file_id"]).groupBy("file_id", "layer", "field", "kind").agg(F.count("*").alias("n")), "kinds")
    counted = counted.join(ordered, "file_id")
    now = _types(counted)
    met = _met(ordered, now).unionByName(now.where("ord = 1").join(ordered, ["stream_id", "ord"]).select("file_id", "layer", "field", F.col("kind").alias("target")))
    approved = _types(counted.withColumn("ord", F.lit(0)).groupBy("stream_id", "ord", "layer", "field", "kind").agg(F.sum("n").alias("n"))).select("stream_id", "layer", "field", F.col("kind").alias("target"))
    fields = counted.select("file_id", "stream_id", "layer", "field").distinct()
    # both targets of every field of a file, in one table of the schemas' size
    both = fields.join(met.withColumnRenamed("target", "_met"), ["file_id", "layer", "field"], "left").join(approved, ["stream_id", "layer", "field"])
    c = _joined(cells(rows, keep + [k for k in ("file_id",) if k not in keep]), stored(both, "schemas"), ["file_id", "layer", "field"])
    first = F.when(F.col("kind").isNull(), None).when(knows(F.col("_met"), F.col("kind")) & (F.col("_met") == F.col("target")), "held").otherwise("replayed")
    out = enforce(c.withColumn("_how", first), [*keep, "stream_id", "layer", "field", "_how"])
    return out.withColumn("how", F.when(F.col("rescued").isNotNull(), "rescued").otherwise(F.col("_how"))).drop("_how")


def ingest(rows: DataFrame, target: dict[str, str], keep: list[str], layer: str = "vendor_fields") -> DataFrame:
    """keep..., a column per field of target (field -> kind), _rescued: JSON of all other members.

    Row-local: no shuffle. Nothing is lost: a member is either in its column or in _rescued,
    which is null where there is none. Names that clash with keep get a trailing '_'.
    """
    c = F.col("_cells")
    out = _cells(rows.select(*keep, F.col(layer).alias("_json")), "_json", "_cells")

    def named(field: str) -> Column:
        return F.get(F.filter(c, lambda x: x["field"] == field), F.lit(0))

    def taken(x: Column) -> Column:
        """Whether a cell has a column that holds all of it."""
        fits = F.lit(False)
        for field, kind in target.items():
            fits = F.when(x["field"] == field, x["kind"].isNull() | _typed(kind, x["kind"], x["value"]).isNotNull()).otherwise(fits)
        return fits

    def member(x: Column) -> Column:
        return F.concat(as_json(F.lit("text"), x["field"]), F.lit(":"), F.coalesce(as_json(x["kind"], x["value"]), F.lit("null")))

    out = out.withColumns({f"{field}_" if field in keep else field: _typed(kind, named(field)["kind"], named(field)["value"]) for field, kind in target.items()})
    rest = F.transform(F.filter(c, lambda x: ~taken(x)), member)
    return out.withColumn("_rest", rest).withColumn("_rescued", F.when(F.size("_rest") > 0, F.concat(F.lit("{"), F.array_join("_rest", ","), F.lit("}")))).drop("_cells", "_rest", "_json")


def replay(table: DataFrame, approved: dict[str, str]) -> DataFrame:
    """Promote fields: their rescued values move into typed columns, the rest stays rescued."""
    kept = [c for c in table.columns if c != "_rescued"]
    return ingest(table, approved, kept, "_rescued")
