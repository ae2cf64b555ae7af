"""Deeply nested records into flat tables that keep their parent-child links: shared inlining.

A first pass analyses the schema graph: which kinds stand at each path (array positions folded,
keys escaped as in JSON pointers). Singleton descendants are inlined into the row of the nearest
enclosing array element or, outside all arrays, of the record's root. Repeated elements get a
table of their own. Tables are shared as the graph says: an element nested in itself, at whatever
depth, is of one table (the path up to its first occurrence), and elements of equal name and equal
members under several parents are of one table, named by the element alone. A row's node is its
JSON pointer, its foreign key the pointer of the nearest enclosing element.

Irregularities the graph settles: an object where other records have an array counts as the
array's element 0; JSON kept as text counts as what it says; null elements are no nodes but
keep their index.

Defined results: null, empty or unreadable JSON: no nodes and no root row; a repeated event: its
first copy's nodes; a null element of the problems array is no node; null members are absent;
scalars of an array are one list member of the enclosing row, nulls among them kept.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.ids import event_key, ingest_us
from millrace.session import stored

#: The schema graph goes to the driver and the conflicting paths to the tasks; more paths than this mean that keys are data, which is refused.
MAX_PATHS = 100_000
ROOT = "(root)"

def _loads(text: object) -> object:
    try:
        return json.loads(text) if text else None
    except (ValueError, RecursionError, TypeError):
        return None


def _untext(v: object) -> object:
    """JSON kept as text counts as what it says, if that is an object or an array."""
    while isinstance(v, str) and v[:1] in ("[", "{", " ", "\n", "\t"):
        inner = _loads(v)
        if not isinstance(inner, (dict, list)):
            return v
        v = inner
    return v


def shapes_of(root: object, path: str = "", members: bool = False) -> set[tuple[str, str]]:
    """(path without array positions, kind) of every array, and of every object that is no array's element; of scalars too if members are asked for."""
    out: set[tuple[str, str]] = set()
    todo = [(path, root, False)]
    while todo:
        p, v, element = todo.pop()
        v = _untext(v)
        if isinstance(v, dict):
            if not element:
                out.add((p, "object"))
            elif members:
                out.add((p, "element"))
            todo += [(f"{p}/{_esc(k)}", x, False) for k, x in v.items()]
        elif isinstance(v, list):
            out.add((p, "array"))
            todo += [(p, x, True) for x in v]
        elif members and v is not None:
            out.add((p, "list" if element else "boolean" if isinstance(v, bool) else "text" if isinstance(v, str) else "whole" if isinstance(v, int) else "decimal"))
    return out


def _esc(key: str) -> str:
    return key.replace("~", "~0").replace("/", "~1")


def nodes_of(root: object, arrays: frozenset[str], with_attrs: bool = False) -> list[tuple[str, str | None, str, str | None]]:
    """(node, parent, path, attrs JSON) of every object that is an element of an array; with attrs also of the root, whose node is ''."""
    out: list[tuple[str, str | None, str, dict | None]] = []
    top: dict | None = {} if with_attrs and isinstance(root, (dict, list)) else None
    if top is not None:
        out.append(("", None, ROOT, top))
    # value, pointer, path, enclosing node, attrs of that node, name within it
    todo: list[tuple] = [(root, "", "", "", top, "")]
    while todo:
        v, at, path, parent, attrs, name = todo.pop()
        v = _untext(v)
        if isinstance(v, dict) and path in arrays:
            v = [v]
        if isinstance(v, list):
            scalars, below = [], []
            for i, x in enumerate(v):
                x, here = _untext(x), f"{at}/{i}"
                if isinstance(x, dict):
                    own: dict | None = {} if with_attrs else None
                    out.append((here, parent, path, own))
                    below += [(y, f"{here}/{_esc(k)}", f"{path}/{_esc(k)}", here, own, _esc(k)) for k, y in x.items()]
                elif isinstance(x, list):
                    below.append((x, here, path, parent, attrs, name))
                else:
                    scalars.append(x)
            if attrs is not None and any(x is not None for x in scalars):
                attrs.setdefault(name, []).extend(scalars)
            todo += reversed(below)
        elif isinstance(v, dict):
            todo += [(y, f"{at}/{_esc(k)}", f"{path}/{_esc(k)}", parent, attrs, f"{name}/{_esc(k)}" if name else _esc(k)) for k, y in v.items()][::-1]
        elif attrs is not None and v is not None:
            attrs[name] = v
    return [(n, p, t, None if a is None else json.dumps(a, sort_keys=True, ensure_ascii=False)) for n, p, t, a in out]


def _problems(items: object) -> list:
    """The problems array as JSON would say it; value is JSON text."""
    if items is None:
        return []
    out = []
    for x in items:
        if x is None:
            out.append(None)
            continue
        v = x["value"]
        inner = _loads(v)
        out.append({"field": x["field"], "problem": x["problem"], "value": inner if inner is not None else v})
    return out


_SHAPES = T.ArrayType(T.StructType([T.StructField("path", T.StringType()), T.StructField("kind", T.StringType())]))
_NODES = T.ArrayType(T.StructType([T.StructField(x, T.StringType()) for x in ("field", "node", "parent", "path", "attrs")]))
FIELDS = ("vendor_fields", "validation_problems")


def schema_graph(records: DataFrame, members: bool = False) -> DataFrame:
    """field, path (array positions folded), kinds: the kinds that stand there in any record, sorted."""

    @F.pandas_udf(_SHAPES)
    def shapes(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        """The distinct shapes of a whole batch, on its first row: what moves is schema, not data."""
        for vendor, problems in batches:
            found: set[tuple[str, str]] = set()
            for v, p in zip(vendor, problems):
                if v:
                    found |= shapes_of(_loads(v), "vendor_fields:", members)
                if p is not None and len(p):
                    found |= shapes_of(_problems(p), "validation_problems:", members)
            first = [{"path": a, "kind": b} for a, b in found]
            yield pd.Series([first if i == 0 else [] for i in range(len(vendor))], dtype=object)

    rows = records.select(F.explode(shapes(*FIELDS)).alias("s")).select("s.*").distinct()
    place = F.instr("path", ":")
    return rows.groupBy("path").agg(F.sort_array(F.collect_set("kind")).alias("kinds")).select(F.expr("substring(path, 1, instr(path, ':') - 1)").alias("field"), F.col("path").substr(place + 1, F.length("path")).alias("path"), "kinds")


def _collected(graph: DataFrame) -> "Graph":
    rows = graph.limit(MAX_PATHS + 1).collect()
    if len(rows) > MAX_PATHS:
        raise ValueError(f"more than {MAX_PATHS} paths: these keys are data, not a schema")
    return [(r["field"], r["path"], frozenset(r["kinds"])) for r in rows]


Graph = list[tuple[str, str, frozenset[str]]]


def _conflicts(graph: Graph) -> dict[str, frozenset[str]]:
    return {f: frozenset(p for g, p, k in graph if g == f and {"array", "object"} <= k) for f in FIELDS}


def conflicts(records: DataFrame) -> dict[str, frozenset[str]]:
    """Per field the paths where some records have an array and others an object."""
    return _conflicts(_collected(schema_graph(records).where(F.array_contains("kinds", "array") & F.array_contains("kinds", "object"))))


def tables_of(graph: list[tuple[str, frozenset[str]]]) -> tuple[dict[str, str], dict[str, dict[str, str]]]:
    """(table of each array path, members of each table with their kinds) of one field's schema graph.

    A member is named by its pointer within the element and of the kind its scalars have; 'json' if
    they have several.
    """
    kinds = dict(graph)
    arrays = {p for p, k in kinds.items() if "array" in k and k & {"element", "object"}}

    def above(path: str) -> list[str]:
        steps = path.split("/")
        return [p for i in range(1, len(steps)) if (p := "/".join(steps[:i])) in arrays]

    def folded(path: str) -> str:
        """The first place at which an element of that name stands on the way to it."""
        name = path.rsplit("/", 1)[-1]
        return next((p for p in above(path) if p.rsplit("/", 1)[-1] == name), path)

    of = {p: folded(p) for p in arrays}
    members: dict[str, dict[str, set[str]]] = {ROOT: {}} | {t: {} for t in of.values()}
    for p, k in kinds.items():
        scalars = k - {"array", "object", "element"}
        if not scalars:
            continue
        held = above(p)
        owner = of[held[-1]] if held else ROOT
        name = p[len(held[-1]) if held else 0 :].lstrip("/")
        members[owner].setdefault(name, set()).update(scalars)
    one = {t: {m: next(iter(k)) if len(k) == 1 else "decimal" if k == {"whole", "decimal"} else "json" for m, k in ms.items()} for t, ms in members.items()}
    # equal name and equal members under several parents: one table, named by the element
    alike: dict[tuple, list[str]] = {}
    for t, ms in one.items():
        if t != ROOT:
            alike.setdefault((t.rsplit("/", 1)[-1], tuple(sorted(ms.items()))), []).append(t)
    renamed = {t: name for (name, _), ts in alike.items() if len(ts) > 1 and sum(n == name for n, _ in alike) == 1 for t in ts}
    return {p: renamed.get(t, t) for p, t in of.items()}, {renamed.get(t, t): ms for t, ms in one.items()}


def nodes(records: DataFrame, with_attrs: bool = False, graph: Graph | None = None) -> DataFrame:
    """event_key, field, node, parent, path, attrs: one row per array element that is an object, and with attrs one per root.

    records: event_id, ingested_at_unix_utc, row_id, vendor_fields, validation_problems. JSON is
    read where it lies; what is shuffled per event is its list of nodes, combined to the first
    copy on the map side.
    """
    own = conflicts(records) if graph is None else _conflicts(graph)

    @F.pandas_udf(_NODES)
    def read(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        names = ("field", "node", "parent", "path", "attrs")
        for vendor, problems in batches:
            rows = []
            for v, p in zip(vendor, problems):
                got = []
                if v:
                    got += [("vendor_fields", *n) for n in nodes_of(_loads(v), own["vendor_fields"], with_attrs)]
                if p is not None and len(p):
                    got += [("validation_problems", *n) for n in nodes_of(_problems(p), own["validation_problems"], with_attrs)]
                rows.append([dict(zip(names, g)) for g in got])
            yield pd.Series(rows, dtype=object)

    order = F.struct(F.coalesce(ingest_us(F.col("ingested_at_unix_utc")), F.lit(2**63 - 1)).alias("i"), F.col("row_id"))
    per_row = records.select(event_key(F.col("event_id")).alias("event_key"), order.alias("o"), read(*FIELDS).alias("nodes")).where(F.col("event_key").isNotNull())
    first = per_row.groupBy("event_key").agg(F.min_by("nodes", "o").alias("nodes"))
    return first.select("event_key", F.explode("nodes").alias("n")).select("event_key", "n.*")


Layout = dict[str, tuple[dict[str, str], dict[str, dict[str, str]]]]


def _laid_out(records: DataFrame) -> tuple[Graph, Layout]:
    """The schema graph with all members, and the tables it makes, from one pass."""
    graph = _collected(schema_graph(records, members=True))
    return graph, {f: tables_of([(p, k) for g, p, k in graph if g == f]) for f in FIELDS}


def _table_column(layout: Layout) -> Column:
    """The table of a row by its field and path: a map of the schema's size."""
    pairs = [x for f, (of, _) in layout.items() for p, t in of.items() for x in (F.lit(f"{f}:{p}"), F.lit(t))]
    if not pairs:
        return F.col("path")
    return F.coalesce(F.element_at(F.create_map(*pairs), F.concat_ws(":", "field", "path")), F.col("path"))


def rows(records: DataFrame) -> DataFrame:
    """event_key, field, table, node, parent, attrs: the rows of all tables, their members as JSON."""
    graph, layout = _laid_out(records)
    return nodes(records, True, graph).select("event_key", "field", _table_column(layout).alias("table"), "node", "parent", "attrs")


_SQL = {"text": "string", "whole": "decimal(38,0)", "decimal": "double", "boolean": "boolean", "list": "string", "json": "string"}


def flat_tables(records: DataFrame) -> dict[tuple[str, str], DataFrame]:
    """(field, table) -> event_key, node, parent and a typed column per member; lists and members of mixed kinds are JSON text.

    The rows are written once and each table reads its own partition of them.
    """
    graph, layout = _laid_out(records)
    all_rows = stored(nodes(records, True, graph).withColumn("table", _table_column(layout)), "nodes", by=["field", "table"])
    out = {}
    for field, (_, tables) in layout.items():
        for name, members in tables.items():
            own = all_rows.where((F.col("field") == field) & (F.col("table") == name))
            v = F.from_json("attrs", "map<string,string>", {"maxNumLen": "2147483647", "maxStringLen": "2147483647"})
            typed = [F.col("_m")[m].try_cast(_SQL[k]).alias(f"{m}_" if m in ("event_key", "node", "parent") else m) for m, k in sorted(members.items())]
            out[field, name] = own.withColumn("_m", v).select("event_key", "node", "parent", *typed)
    return out
