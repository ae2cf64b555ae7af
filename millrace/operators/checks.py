"""Checks that annotate and never change a value: types, limits, validation."""

from __future__ import annotations

import ipaddress
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.config import Limits
from millrace.functions import text as X

_OCTET = r"(?:0|[1-9][0-9]?|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
IPV4 = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"


@F.pandas_udf(T.StructType([T.StructField("bad", T.ArrayType(T.StringType())), T.StructField("pace", T.StringType())]))
def _bad_ipv6(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:

    def bad(v: str) -> bool:
        try:
            ipaddress.ip_address(v)
        except ValueError:
            return True
        return False

    for lists, pace in batches:
        yield pd.DataFrame({"bad": pd.Series([None if x is None else [v for v in x if bad(v)] for x in lists], dtype=object), "pace": pace})


def bad_ipv6(values: Column) -> Column:
    """Of each list of values with a colon, those that are no IPv6 address."""
    return _bad_ipv6(values, X.pace())["bad"]


def _text(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def _is_null(v: Column) -> Column:
    return v.isNull() | F.is_variant_null(v)


def _ends(k: Column, *ends: str) -> Column:
    out = F.lit(False)
    for e in ends:
        out = out | k.endswith(e)
    return out


def ipv6_values(fields: Column) -> Column:
    """Values of address fields that hold a colon: the only ones that Python has to look at."""
    own = F.filter(fields, lambda e: _ends(e["k"], ".ip", ".address") & ~_is_null(e["v"]) & F.contains(F.coalesce(_text(e["v"]), F.lit("")), F.lit(":")))
    return F.when(F.size(own) > 0, F.transform(own, lambda e: _text(e["v"])))


def problems(fields: Column, bad_ipv6: Column) -> Column:
    """array<struct<field, problem, value>> of normalised fields whose value isn't of its type; nulls are not judged."""
    why = lambda e: (
        F.when(_is_null(e["v"]), None)
        .when(
            _ends(e["k"], ".ip", ".address"),
            F.when(
                ~F.coalesce(_text(e["v"]).rlike(IPV4), F.lit(False))
                & (~F.contains(F.coalesce(_text(e["v"]), F.lit("")), F.lit(":")) | F.coalesce(F.array_contains(bad_ipv6, F.coalesce(_text(e["v"]), F.lit(""))), F.lit(False))),
                "not a valid IP address; original value preserved",
            ),
        )
        .when(
            e["k"].endswith(".port"),
            F.when(
                ~F.coalesce(F.schema_of_variant(e["v"]).isin("BIGINT", "BOOLEAN") & F.try_variant_get(e["v"], "$", "bigint").between(0, 65_535), F.lit(False)),
                "port out of range or not integer; value preserved",
            ),
        )
        .when(
            e["k"] == "@timestamp",
            F.when(~F.coalesce((F.schema_of_variant(e["v"]) == "STRING") & X.is_iso8601(_text(e["v"])), F.lit(False)), "timestamp not ISO-8601; value preserved"),
        )
    )
    suspects = F.filter(fields, lambda e: _ends(e["k"], ".ip", ".address", ".port") | (e["k"] == "@timestamp"))
    judged = F.transform(suspects, lambda e: F.struct(e["k"].alias("field"), why(e).alias("problem"), F.to_json(e["v"]).alias("value")))
    return F.filter(judged, lambda p: p["problem"].isNotNull())


def oversized(layers: Column, limits: Limits) -> Column:
    """Notes of text values over the byte limit; the values stay."""
    size = lambda e: F.octet_length(_text(e["v"]))
    big = F.filter(layers, lambda e: (size(e) > limits.max_field_bytes) & (F.schema_of_variant(e["v"]) == "STRING"))
    return F.transform(big, lambda e: F.concat(F.lit("FIELD_LIMIT_EXCEEDED:"), e["k"], F.lit(":"), size(e).cast("string"), F.lit(f">{limits.max_field_bytes}")))


def too_many(n: Column, limits: Limits) -> Column:
    return F.when(n > limits.max_field_count, F.concat(F.lit("FIELD_COUNT_LIMIT_EXCEEDED:"), (n - limits.max_field_count).cast("string"), F.lit(f"_beyond_{limits.max_field_count}")))
