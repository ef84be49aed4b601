"""JSON texts of any shape, each row its own: the plain values by path, what is found in them, and values replaced by path.

A path is written like `$.user.mails[0]`; to choose, `[*]` stands for every element of an array. Keys with a dot, a bracket
or a quote are written `['such.a key']`. Texts are read as VARIANT values, so that rows need no common schema.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .analyze import analyze
from .scan import let

LEAVES = "array<struct<path:string,value:string>>"


def _step(key: Column) -> Column:
    return F.when(key.rlike(r"^[^.\[\]']+$"), F.concat(F.lit("."), key)).otherwise(F.concat(F.lit("['"), F.replace(key, F.lit("'"), F.lit("\\'")), F.lit("']")))


def leaves(text: Column, depth: int = 32) -> Column:
    """Array of (path, value) of the plain values of a JSON text, as strings; null for JSON's null. Empty for null texts and for what is no JSON.

    Objects and arrays deeper than `depth` are given as JSON text, so nothing is lost.
    """

    def opened(x: Column) -> Column:
        kind = F.schema_of_variant(x["v"])
        members = F.transform(F.map_entries(x["v"].cast("map<string,variant>")), lambda e: F.struct(F.concat(x["path"], _step(e["key"])).alias("path"), e["value"].alias("v")))
        elements = F.transform(x["v"].cast("array<variant>"), lambda e, i: F.struct(F.concat(x["path"], F.lit("["), i.cast("string"), F.lit("]")).alias("path"), e.alias("v")))
        return F.when(kind.startswith("OBJECT"), members).when(kind.startswith("ARRAY"), elements).otherwise(F.array(x))

    def walked(v: Column) -> Column:
        root = F.array(F.struct(F.lit("$").alias("path"), v.alias("v")))
        deep = F.aggregate(F.sequence(F.lit(1), F.lit(depth)), root, lambda a, _: F.when(F.exists(a, lambda x: F.schema_of_variant(x["v"]).rlike("^(OBJECT|ARRAY)")), F.flatten(F.transform(a, opened))).otherwise(a))
        shown = lambda x: F.when(F.schema_of_variant(x["v"]).rlike("^(OBJECT|ARRAY)"), F.to_json(x["v"])).otherwise(F.try_variant_get(x["v"], "$", "string"))
        return F.transform(deep, lambda x: F.struct(x["path"].alias("path"), shown(x).alias("value")))

    return let(F.try_parse_json(text), lambda v: F.when(v.isNotNull(), walked(v)).otherwise(F.array().cast(LEAVES)))


def json_findings(df: DataFrame, column: str, keys: list[str], skip: list[str] = (), depth: int = 32, **options) -> DataFrame:
    """keys, path, entity_type, start, end, score, recognizer: what analyze() finds in each plain value, with places in it.

    skip: paths, with [*] for any element, under which nothing is looked for. A row for each finding.
    """
    gone = "|".join(pattern(p) for p in skip)
    rows = df.select(*keys, F.explode(leaves(F.col(column), depth)).alias("l")).select(*keys, "l.path", "l.value").where("value is not null")
    rows = rows.where(~F.col("path").rlike(f"^(?:{gone})(?:[.\\[].*)?$")) if gone else rows
    return rows.select(*keys, "path", F.explode(analyze(F.col("value"), **options)).alias("s")).select(*keys, "path", "s.*")


def parts(path: str) -> list[str | int | None]:
    """The keys (text), elements (numbers) and any-element marks (None) of a path; raises ValueError if it is none."""
    found = list(re.finditer(r"\.([^.\[\]']+)|\[(\d+)\]|\[(\*)\]|\['((?:[^'\\]|\\.)+)'\]", path))
    if not path.startswith("$") or "".join(m[0] for m in found) != path[1:]:
        raise ValueError(f"no path: {path!r}")
    return [int(m[2]) if m[2] else None if m[3] else m[1] or m[4].replace("\\'", "'") for m in found]


def pattern(path: str) -> str:
    """A pattern of the paths that leaves() writes for a path."""
    plain = re.compile(r"[^.\[\]']+")
    steps = ["\\[\\d+\\]" if p is None else f"\\[{p}\\]" if isinstance(p, int) else re.escape(f".{p}" if plain.fullmatch(p) else "['" + p.replace("'", "\\'") + "']") for p in parts(path)]
    return "\\$" + "".join(steps)


def replaced(text: Column, changes: dict[str, Callable[[Column], Column]]) -> Column:
    """The JSON text with the plain values at some paths changed: fn gets the value as a string and gives the new string.

    Paths that a row doesn't have, and values that are null, objects or arrays, stay as they are. Null texts stay null, and
    what is no JSON stays itself. Object keys come in the order of the VARIANT type, sorted.
    """

    def at(v: Column, path: list, fn: Callable[[Column], Column]) -> Column:
        kind = F.schema_of_variant(v)
        if not path:
            new = F.to_variant_object(F.array(fn(F.try_variant_get(v, "$", "string")).cast("string")))
            return F.when(kind.rlike("^(OBJECT|ARRAY|VOID)"), v).otherwise(F.try_variant_get(new, "$[0]", "variant"))
        head, rest = path[0], path[1:]
        if isinstance(head, str):
            entries = F.transform(F.map_entries(v.cast("map<string,variant>")), lambda e: F.struct(e["key"].alias("key"), F.when(e["key"] == head, at(e["value"], rest, fn)).otherwise(e["value"]).alias("value")))
            return F.when(kind.startswith("OBJECT"), F.to_variant_object(F.map_from_entries(entries))).otherwise(v)
        here = (lambda i: F.lit(True)) if head is None else (lambda i: i == head)
        elements = F.transform(v.cast("array<variant>"), lambda e, i: F.when(here(i), at(e, rest, fn)).otherwise(e))
        return F.when(kind.startswith("ARRAY"), F.to_variant_object(elements)).otherwise(v)

    def changed(path: str, fn: Callable[[Column], Column]) -> Callable[[Column], Column]:
        return lambda v: at(v, parts(path), fn)

    value = F.try_parse_json(text)
    for path, fn in changes.items():
        value = let(value, changed(path, fn))
    return F.coalesce(F.to_json(value), text)
