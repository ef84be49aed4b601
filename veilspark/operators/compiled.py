"""Expressions kept as SQL text: built once from Column functions, which takes a call to the JVM for each node, then parsed whole."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Analysis goes one level of nested lambdas deeper with each round.
ROUNDS = "500"
_PARTS = re.compile(r"""'(?:[^'\\]|\\.)*'|`[^`]*`|[-+*/%=<>!&|^~]+(?=\()""", re.DOTALL)


def sql(column: Column) -> str:
    """The column as SQL text. Operators are named like functions there, so they get quotes."""
    return _PARTS.sub(lambda m: m[0] if m[0][0] in "'`" else f"`{m[0]}`", column._jc.node().sql())


def literal(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def deep() -> None:
    """Lets the session analyze deeply nested lambdas."""
    spark = SparkSession.getActiveSession()
    if spark is not None and int(spark.conf.get("spark.sql.analyzer.maxIterations")) < int(ROUNDS):
        spark.conf.set("spark.sql.analyzer.maxIterations", ROUNDS)


def given(value: Column, body: str) -> Column:
    """What a lambda, as SQL text, makes of a value."""
    deep()
    return F.call_function("aggregate", F.array().cast("array<int>"), value, F.expr("(a, x) -> a"), F.expr(body))


def applied(text: str, /, **values: Column) -> Column:
    """What the SQL text, in which values have their names in a struct `v`, gives for them."""
    return given(F.struct(*[c.alias(k) for k, c in values.items()]), f"v -> {text}")


def compiled(names: tuple[str, ...]) -> Callable:
    """Makes of fn(columns named so, hashable options) a function that builds its expression once for each set of options."""

    def of(fn: Callable[..., Column]) -> Callable[..., Column]:
        @lru_cache(maxsize=64)
        def text(options: tuple) -> str:
            return sql(fn(*[F.col(f"v.{n}") for n in names], **dict(options)))

        def call(*columns: Column, **options) -> Column:
            return applied(text(tuple(sorted(options.items()))), **dict(zip(names, columns, strict=True)))

        call.__doc__, call.__name__, call.plain = fn.__doc__, fn.__name__, fn
        return call

    return of
