"""Detection in nested rows: each field by its dotted path, its key as context, and an entity type for each path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .analyze import analyze, spread
from .scan import SPAN

SIMPLE = (T.StringType, T.IntegralType, T.BooleanType, T.FractionalType)


def fields(kind: T.DataType, value: Column, path: tuple[str, ...], skip: list[str]) -> list[tuple[tuple[str, ...], Column, bool, bool]]:
    """(path, value, whether it is an array, whether it is skipped) of each field that holds plain values.

    A key to skip names a field of the outermost level, or begins with the key of a struct and a dot.
    """
    out = []
    for f in kind.fields:
        here, v, gone = (*path, f.name), value[f.name] if value is not None else F.col(f"`{f.name}`"), f.name in skip
        if isinstance(f.dataType, T.StructType):
            inner = [k.replace(f"{f.name}.", "") for k in skip if k.startswith(f.name)]
            out += [(p, x, many, lost or gone) for p, x, many, lost in fields(f.dataType, v, here, inner)]
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, SIMPLE):
            out.append((here, v, True, gone))
        elif isinstance(f.dataType, SIMPLE):
            out.append((here, v, False, gone))
        elif not gone:
            raise ValueError(f"{'.'.join(here)} holds neither plain values, nor arrays of them, nor fields")
    return out


def filled(v: Column) -> Column:
    """The value as text; null where it is null, empty, zero or false."""
    text = v.cast("string")
    return F.when(~text.isin("", "0", "0.0", "false"), text)


def field_findings(df: DataFrame, keys: list[str], skip: list[str] = (), context: list[str] = (), **options) -> DataFrame:
    """keys, path, element (its number in an array, else null), spans: a row for each plain value of df but the keys.

    A single value has its own key as context, values of an array all keys on the way and `context`. Skipped and empty
    values have no spans.
    """
    def spans(x: Column, words: list[str], gone: bool) -> Column:
        none = F.array().cast(SPAN)
        return none if gone else F.coalesce(analyze(filled(x), context=words, **options), none)

    def row(path: tuple[str, ...], v: Column, many: bool, gone: bool) -> Column:
        name = F.lit(".".join(path)).alias("path")
        if many:
            return F.transform(v, lambda x, i: F.struct(name, i.alias("element"), spans(x, [*context, *path], gone).alias("spans")))
        return F.array(F.struct(name, F.lit(None).cast("int").alias("element"), spans(v, [path[-1]], gone).alias("spans")))

    rows = [row(*f) for f in fields(T.StructType([f for f in df.schema.fields if f.name not in keys]), None, (), list(skip))]
    kind = f"array<struct<path:string,element:int,spans:{SPAN}>>"
    every = F.concat(*[F.coalesce(r.cast(kind), F.array().cast(kind)) for r in rows])
    return spread(df).select(*keys, F.explode(every).alias("f")).select(*keys, "f.*")


def field_entities(df: DataFrame, keys: list[str], **options) -> DataFrame:
    """keys, path, entity_type: for each single value in which anything is found the type of its best span."""
    found = field_findings(df, keys, **options).where("element is null and size(spans) > 0")
    return found.select(*keys, "path", F.col("spans")[0]["entity_type"].alias("entity_type"))


def entity_scores(findings: DataFrame, keys: list[str] = ()) -> DataFrame:
    """keys, entity_type, scores (sorted) of findings (entity_type, score): a group has the scores of one text or column."""
    return findings.groupBy(*keys, "entity_type").agg(F.sort_array(F.collect_list("score")).alias("scores"))
