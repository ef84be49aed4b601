"""Pseudonyms that hold for a session: one value has one number in all its turns, over tables and over streams."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import DataType, StructType
from pyspark.sql.window import Window

from ..operators.analyze import analyze
from ..operators.rewrite import Op, rewrite
from ..operators.scan import SPAN, cut, let, pages, sweep
from ..operators.spans import resolve

#: What a turn's findings are: their places, in order, with the value and the number that it has in its session.
NUMBERED = "array<struct<entity_type:string,start:int,end:int,score:double,found:string,n:int>>"


def findings_of(text: Column, **options) -> Column:
    """The spans of a text, none over another, by place, with n null yet."""

    def of(t: Column, spans: Column) -> Column:
        one = lambda p, s: F.struct(s["entity_type"].alias("entity_type"), s["start"].alias("start"), s["end"].alias("end"), s["score"].alias("score"), cut(p, s["start"], s["end"]).alias("found"), F.lit(None).cast("int").alias("n"))
        return let(F.when(F.size(spans) > 0, pages(t)).otherwise(F.array().cast("array<string>")), lambda p: F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("k"), one(p, s).alias("f")))))

    ready = let(text, lambda t: let(resolve(t, analyze(t, **options), "remove_intersections"), lambda s: F.transform(of(t, s), lambda x: x["f"])))
    return F.when(text.isNotNull(), ready).otherwise(F.array().cast(NUMBERED))


def name_of(kind: Column, n: Column) -> Column:
    return F.concat(F.lit("<"), kind, F.lit("_"), n.cast("string"), F.lit(">"))


def replaced(text: Column, numbered: Column) -> Column:
    """The text with <TYPE_n> for each finding of NUMBERED."""
    spans = F.transform(numbered, lambda f: F.struct(F.concat(f["entity_type"], F.lit("_"), f["n"].cast("string")).alias("entity_type"), f["start"].alias("start"), f["end"].alias("end"), f["score"].alias("score"), F.lit("session").alias("recognizer"))).cast(SPAN)
    return rewrite(text, spans, {"DEFAULT": Op("replace")})["text"]


def session_pseudonyms(df: DataFrame, session: str, order: str, column: str, **options) -> DataFrame:
    """df with `numbered` (NUMBERED) and the text replaced, of a whole table.

    The values of a type are numbered from 0 within a session by first turn (order) and place. Rows of a session without
    an order come first; a null session is one. Only distinct values are ranked, so that turns don't meet in one task.
    """
    rows = df.withColumn("_found", findings_of(F.col(column), **options))
    seen = rows.select(session, order, F.explode("_found").alias("f")).select(session, "f.entity_type", "f.found", F.struct(F.col(order).alias("turn"), F.col("f.start").alias("start")).alias("at"))
    firsts = seen.groupBy(session, "entity_type", "found").agg(F.min("at").alias("at"))
    rank = F.row_number().over(Window.partitionBy(session, "entity_type").orderBy("at", "found")) - 1
    known = firsts.withColumn("n", rank).groupBy(F.col(session).alias("_session")).agg(F.map_from_entries(F.collect_list(F.struct(F.struct("entity_type", "found"), F.col("n")))).alias("_known"))
    joined = rows.join(known, rows[session].eqNullSafe(known["_session"]), "left").drop("_session")
    number = lambda f: f.withField("n", F.try_element_at(F.col("_known"), F.struct(f["entity_type"].alias("entity_type"), f["found"].alias("found"))).cast("int"))
    out = joined.withColumn("numbered", F.transform("_found", number).cast(NUMBERED)).drop("_found", "_known")
    return out.withColumn(column, F.when(F.col(column).isNotNull(), replaced(F.col(column), F.col("numbered"))))


def numberer(names: list[str], order: str, idle_ms: int | None):
    """What goes over the turns that a batch has of one session; its state is the list of (type, value), each numbered within its type."""

    def run(key: tuple, turns: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kinds, values = state.get if state.exists else ([], [])
        known: dict[tuple[str, str], int] = {}
        sizes: Counter[str] = Counter()

        def number(kind: str, found: str) -> int:
            if (kind, found) not in known:
                known[kind, found] = sizes[kind]
                sizes[kind] += 1
            return known[kind, found]

        for pair in zip(kinds, values, strict=True):
            number(*pair)
        rows = pd.concat([t.set_axis([*names, "_found"], axis=1) for t in turns]).sort_values(order, kind="stable")  # what one batch has of one session
        found = [[{**f, "n": number(f["entity_type"], f["found"])} for f in map(dict, fs)] for fs in rows["_found"]]
        state.update(([k for k, _ in known], [v for _, v in known]))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield rows[names].assign(numbered=found)

    return run


def session_stream(df: DataFrame, session: str, order: str, column: str, idle_minutes: float | None = 60.0, **options) -> DataFrame:
    """session_pseudonyms() of a stream (append mode): a value keeps its number over batches until its session was idle so long.

    Within a batch turns are numbered in order; a turn that comes in a later batch than its order says has later numbers.
    The state of a session is its distinct values. None keeps sessions for good; a query that ends when it has read all
    needs that, as waiting for idle sessions has no end.
    """
    names = df.columns
    rows = df.withColumn("_found", findings_of(F.col(column), **options))
    schema = StructType([df.schema[n] for n in names]).add("numbered", DataType.fromDDL(NUMBERED))
    run = numberer(names, order, None if idle_minutes is None else int(idle_minutes * 60_000))
    timeout = GroupStateTimeout.NoTimeout if idle_minutes is None else GroupStateTimeout.ProcessingTimeTimeout
    out = rows.groupBy(session).applyInPandasWithState(run, schema, "kinds array<string>, found array<string>", "append", timeout)
    return out.withColumn(column, F.when(F.col(column).isNotNull(), replaced(F.col(column), F.col("numbered"))))


def restored(text: Column, numbered: Column) -> Column:
    """The text before session_pseudonyms() or session_stream(): the names of NUMBERED in it give way to their values."""
    size = lambda f: F.length(name_of(f["entity_type"], f["n"]))

    def step(gained: Column, f: Column) -> Column:
        begin = f["start"] + gained
        return F.struct((gained + size(f) - (f["end"] - f["start"])).alias("state"), F.struct(begin.alias("start"), (begin + size(f)).alias("end")).alias("value"))

    def plain(p: Column, ns: Column, at: Column) -> Column:
        parts = F.transform(ns, lambda f, i: F.concat(cut(p, F.coalesce(F.get(at, i - 1)["end"], F.lit(0)), F.get(at, i)["start"]), f["found"]))
        return F.concat(F.array_join(parts, ""), cut(p, F.coalesce(F.element_at(at, -1)["end"], F.lit(0)), F.length(text)))

    places = lambda ns: sweep(ns, F.lit(0), step, "struct<start:int,end:int>")["out"]
    whole = let(pages(text), lambda p: let(numbered, lambda ns: let(places(ns), lambda at: plain(p, ns, at))))
    return F.when(F.size(numbered) > 0, whole).otherwise(text)
