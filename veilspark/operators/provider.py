"""Spans from outside: a Python function that gets batches of texts, as a model or a remote service does."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from .scan import SPAN

#: Texts and characters in one call, at most (a longer text has a call of its own).
TEXTS, CHARACTERS = 64, 200_000
FIELDS = ("entity_type", "start", "end", "score")

Provider = Callable[[list[str]], list[list[dict]]]


def calls(texts: list[str], most: int, characters: int) -> Iterator[list[int]]:
    """Places of the texts of each call."""
    part, held = [], 0
    for k, t in enumerate(texts):
        if part and (len(part) >= most or held + len(t) > characters):
            yield part
            part, held = [], 0
        part.append(k)
        held += len(t)
    if part:
        yield part


def checked(text: str, spans: list[dict], name: str) -> list[dict]:
    """Spans of one text with the fields of SPAN; raises ValueError if one doesn't fit it."""
    out = []
    for s in spans:
        if missing := [f for f in FIELDS if s.get(f) is None]:
            raise ValueError(f"a span has no {missing[0]}")
        if not 0 <= s["start"] <= s["end"] <= len(text) or not 0 <= s["score"] <= 1:
            raise ValueError(f"a span from {s['start']} to {s['end']} with score {s['score']} does not fit a text of {len(text)} characters")
        out.append({"entity_type": str(s["entity_type"]), "start": int(s["start"]), "end": int(s["end"]), "score": float(s["score"]), "recognizer": name})
    return out


def answers(fn: Provider, texts: list[str], name: str, most: int = TEXTS, characters: int = CHARACTERS) -> tuple[list[list[dict]], list[str | None]]:
    """(spans, error) of each text. A call that fails is tried again text by text; a text that fails alone has no spans and its error."""
    spans, errors = [[] for _ in texts], [None] * len(texts)

    def ask(places: list[int]) -> None:
        found = fn([texts[k] for k in places])
        if len(found) != len(places):
            raise ValueError(f"{len(found)} answers to {len(places)} texts")
        ready = [checked(texts[k], f or [], name) for k, f in zip(places, found, strict=True)]
        for k, f in zip(places, ready, strict=True):
            spans[k] = f

    for places in calls(texts, most, characters):
        try:
            ask(places)
        except Exception:  # whatever the function raises: each text is tried alone
            for k in places:
                try:
                    ask([k])
                except Exception as e:
                    errors[k] = f"{type(e).__name__}: {e}"[:500]
    return spans, errors


def provided(df: DataFrame, column: str, fn: Provider, name: str, open_: Callable[[], Provider] | None = None, most: int = TEXTS, characters: int = CHARACTERS) -> DataFrame:
    """df with `spans` (SPAN) that fn finds in a text column, and `error`, null unless fn failed on the row.

    fn maps texts to a list of spans (dicts with entity_type, start, end, score) for each; open_, if given, makes fn once
    a task, as a client or a model. Null texts are not asked about and have no spans. Rows that repeat are asked about
    each. Columns of df named spans or error are left out. Results of analyze() and these go together by concat().
    """
    rows = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in ("spans", "error")])
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask, at = open_() if open_ else fn, [c.lower() for c in names].index(column.lower())
        kind = pa.list_(pa.struct([("entity_type", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("recognizer", pa.string())]))
        for b in batches:
            texts = b.column(at).to_pylist()
            there = [k for k, t in enumerate(texts) if t is not None]
            found, failed = answers(ask, [texts[k] for k in there], name, most, characters)
            spans, errors = [[] for _ in texts], [None] * len(texts)
            for k, f, e in zip(there, found, failed, strict=True):
                spans[k], errors[k] = f, e
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(spans, kind), pa.array(errors, pa.string())], [*names, "spans", "error"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields]).add("spans", DataType.fromDDL(SPAN)).add("error", "string"))
