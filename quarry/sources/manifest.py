"""Connectors as configuration: paths, route predicates and field maps compiled to columns."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Limits of one payload, in bytes and numbers; a payload over any is quarantined.
VALUE_BYTES, OUTPUT_BYTES, PRINCIPALS = 64 << 10, 512 << 10, 1024


@dataclass(frozen=True)
class Manifest:
    source: str
    route: str
    primary_key: str
    valid_from: str | None
    fields: dict[str, str]
    content: str | None = None
    principals: str | None = None
    limits: tuple[int, int, int] = field(default=(VALUE_BYTES, OUTPUT_BYTES, PRINCIPALS))


def path(expression: str, body: str = "body") -> Column:
    """``a.b[0].c``: the value as text, null where it is missing."""
    return F.get_json_object(body, "$." + expression)


def paths(expression: str, body: str = "body") -> Column:
    """``a[].b``: all values as an array of text, empty where there are none."""
    head, _, tail = expression.partition("[]")
    rows = F.from_json(F.get_json_object(body, "$." + head), "array<string>")
    each = F.transform(rows, lambda x: F.get_json_object(x, "$" + tail) if tail else x)
    return F.coalesce(F.filter(each, lambda x: x.isNotNull()), F.array().cast("array<string>"))


_TERM = re.compile(r"^\s*(\S+?)\s*(!=|=|in)\s*(.+?)\s*$")


def _literal(text: str) -> str:
    return text.strip().strip("\"'")


def route(predicate: str) -> Column:
    """``path = lit``, ``path != lit`` and ``path in [a, b]`` joined by ``and``; a missing path never matches."""
    terms = []
    for part in re.split(r"\s+and\s+", predicate):
        m = _TERM.match(part)
        if not m:
            raise ValueError(f"not a predicate: {part}")
        value = path(m[1])
        if m[2] == "in":
            test = value.isin(*[_literal(x) for x in m[3].strip("[]").split(",")])
        else:
            test = value == _literal(m[3]) if m[2] == "=" else value != _literal(m[3])
        terms.append(F.coalesce(test, F.lit(False)))
    return reduce(lambda a, b: a & b, terms)


def apply(manifest: Manifest, payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(writes, quarantined) of payloads (id, body). writes: id, entity_id, field, value, valid_from, principals."""
    key = path(manifest.primary_key)
    principals = paths(manifest.principals) if manifest.principals else F.array().cast("array<string>")
    value_bytes, output_bytes, most = manifest.limits
    values = F.create_map(*[x for n, e in manifest.fields.items() for x in (F.lit(n), path(e))])
    rows = payloads.select("id", "body", key.alias("entity_id"), principals.alias("principals"), (path(manifest.valid_from) if manifest.valid_from else F.lit(None).cast("string")).alias("valid_from"), values.alias("values"), route(manifest.route).alias("routed"))
    largest = F.array_max(F.transform(F.map_values("values"), lambda v: F.coalesce(F.octet_length(v), F.lit(0))))
    total = F.aggregate(F.map_values("values"), F.lit(0), lambda s, v: s + F.coalesce(F.octet_length(v), F.lit(0)))
    reason = (
        F.when(F.get_json_object("body", "$").isNull(), "malformed")
        .when(~F.col("routed"), "unrouted")
        .when(F.col("entity_id").isNull(), "no_key")
        .when(F.lit(bool(manifest.principals)) & (F.size("principals") == 0), "no_acl")
        .when(F.size("principals") > most, "too_many_principals")
        .when((largest > value_bytes) | (total > output_bytes), "too_large")
    )
    rows = rows.withColumn("reason", reason)
    writes = rows.where("reason IS NULL").select("id", "entity_id", F.explode("values").alias("field", "value"), "valid_from", "principals").where("value IS NOT NULL")
    return writes, rows.where("reason IS NOT NULL").select("id", "reason")
