"""Tables and JSON: one entity type for each column, chosen from what its cells hold, and whole cells rewritten."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .analyze import analyze, spread
from .rewrite import Op, applied

STRATEGIES = ("most_common", "highest_confidence", "mixed")


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def sampled(df: DataFrame, rows: int | None, seed: int = 123) -> DataFrame:
    """`rows` rows chosen by a hash of their content (all if None), the same ones on every run; each task keeps that many at most."""
    if not rows:
        return df
    return df.orderBy(F.xxhash64(F.lit(seed), *df.columns), *df.columns).limit(rows)


def column_entities(df: DataFrame, rows: int | None = None, strategy: str = "most_common", mixed_threshold: float = 0.5, **options) -> DataFrame:
    """column, entity_type, score of each column in which anything is found; ties go to the first type by name.

    Values that repeat in a column are analyzed once and counted.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}")
    if not 0 <= mixed_threshold <= 1:
        raise ValueError("a threshold lies between 0 and 1")
    cells = sampled(df, rows).select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in df.columns])).alias("c")).select("c.*")
    values = spread(cells.where("value is not null").groupBy("column", "value").agg(F.count(F.lit(1)).alias("times")))
    by_score = values.select("column", "times", F.explode(analyze(F.col("value"), **options)).alias("s")).groupBy("column", "s.entity_type", "s.score").agg(F.sum("times").alias("n"))
    spans = by_score.groupBy("column", "entity_type").agg(F.sum("n").alias("n"), F.max("score").alias("top"), F.max_by("n", "score").alias("n_top"))
    common = F.min(F.struct((-F.col("n")).alias("a"), F.col("entity_type").alias("entity_type"))).alias("common")
    best = F.min(F.struct((-F.col("top")).alias("a"), (-F.col("n_top")).alias("b"), F.col("entity_type").alias("entity_type"))).alias("best")
    per = spans.groupBy("column").agg(common, best, F.sum("n").alias("total"))
    by_count = F.struct(F.col("common.entity_type").alias("entity_type"), (-F.col("common.a") / F.col("total")).alias("score"))
    by_top = F.struct(F.col("best.entity_type").alias("entity_type"), (-F.col("best.a")).alias("score"))
    chosen = {"most_common": by_count, "highest_confidence": by_top, "mixed": F.when(-F.col("best.a") > mixed_threshold, by_top).otherwise(by_count)}[strategy]
    return per.select("column", chosen.alias("c")).select("column", "c.*")


def anonymize_columns(df: DataFrame, mapping: dict[str, str], ops: dict[str, Op] | None = None) -> DataFrame:
    """Whole cells of the mapped columns (name to entity type) rewritten; nulls stay null, other columns as they are."""
    ops = ops or {}
    out = {}
    for c, kind in mapping.items():
        op = ops.get(kind) or ops.get("DEFAULT") or Op("replace")
        out[c] = F.when(F.col(f"`{c}`").isNotNull(), applied(op, F.col(f"`{c}`").cast("string"), F.lit(kind)))
    return df.withColumns(out)


def anonymize_struct(value: Column, kind: T.DataType, path: list[str], change) -> Column:
    """value with `change` applied at the dotted path; arrays on the way are changed element by element."""
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: anonymize_struct(x, kind.elementType, path, change))
    if not path:
        return F.when(value.isNotNull(), change(value.cast("string")))
    inner = kind[path[0]].dataType
    return F.when(value.isNotNull(), value.withField(path[0], anonymize_struct(value[path[0]], inner, path[1:], change)))


def anonymize_paths(df: DataFrame, mapping: dict[str, str], ops: dict[str, Op] | None = None) -> DataFrame:
    """Nested fields of the mapping (dotted path to entity type) rewritten."""
    ops = ops or {}
    for path, kind in mapping.items():
        top, *rest = path.split(".")
        op = ops.get(kind) or ops.get("DEFAULT") or Op("replace")
        df = df.withColumn(top, anonymize_struct(F.col(f"`{top}`"), df.schema[top].dataType, rest, lambda v, op=op, kind=kind: applied(op, v, F.lit(kind))))
    return df


def pseudonyms(findings: DataFrame, keys: list[str]) -> DataFrame:
    """findings with a pseudonym <TYPE_n> for each distinct text of a type, numbered by first place within keys."""
    from pyspark.sql import Window

    first = findings.groupBy(*keys, "entity_type", "found").agg(F.min("start").alias("first"))
    numbered = first.withColumn("n", F.row_number().over(Window.partitionBy(*keys, "entity_type").orderBy("first", "found")) - 1)
    return findings.join(numbered.drop("first"), [*keys, "entity_type", "found"]).withColumn("pseudonym", F.format_string("<%s_%d>", "entity_type", "n"))
