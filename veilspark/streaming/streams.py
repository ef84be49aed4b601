"""The same transforms over streams: detection and rewriting keep no state, counts use watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.analyze import analyze
from ..operators.rewrite import Op, anonymize


def anonymize_stream(df: DataFrame, column: str, ops: dict[str, Op] | None = None, **options) -> DataFrame:
    """df with `column` rewritten; works alike on streams and tables."""
    return df.withColumn(column, anonymize(F.col(column), analyze(F.col(column), **options), ops)["text"])


def windowed_counts(df: DataFrame, column: str, time: str, window: str = "10 minutes", late: str = "10 minutes", **options) -> DataFrame:
    """window_start, entity_type, n of findings; rows later than `late` are dropped on streams."""
    rows = df.withWatermark(time, late).select(time, F.explode(analyze(F.col(column), **options)).alias("s"))
    return rows.groupBy(F.window(time, window).alias("w"), "s.entity_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), "entity_type", "n")
