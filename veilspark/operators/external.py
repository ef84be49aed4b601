"""What other services found, made fit for use: span arrays filtered by position, label, score and entity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Entity type of findings whose own type has no mapping.
GENERIC = "GENERIC_PII_ENTITY"
RAW = "array<struct<entity_type:string,start:int,end:int,score:double,recognizer:string,original:string>>"


def with_places(spans: Column) -> Column:
    """Spans that have both a start and an end."""
    return F.filter(spans, lambda s: s["start"].isNotNull() & s["end"].isNotNull())


def without_labels(spans: Column, ignored: list[str]) -> Column:
    """Spans with an entity type that is not among the ignored ones, in any case."""
    low = [x.lower() for x in ignored]
    return F.filter(spans, lambda s: (F.coalesce(s["entity_type"], F.lit("")) != "") & (~F.lower(s["entity_type"]).isin(low) if low else F.lit(True)))


def scored(spans: Column, least: float) -> Column:
    return F.filter(spans, lambda s: s["score"] >= least)


def of_entities(spans: Column, wanted: list[str]) -> Column:
    """Spans of the wanted entity types; all if none are named."""
    return F.filter(spans, lambda s: s["entity_type"].isin(wanted)) if wanted else spans


def mapped(spans: Column, known: list[str], consolidate: bool = True) -> Column:
    """Spans (RAW) of known entity types, with the type they came with in `original`; others become GENERIC ones, or go."""
    same = lambda s: s["entity_type"].isin(known) if known else F.lit(False)
    kept = spans if consolidate else F.filter(spans, same)
    one = lambda s: F.struct(F.when(same(s), s["entity_type"]).otherwise(GENERIC).alias("entity_type"), s["start"].alias("start"), s["end"].alias("end"), s["score"].alias("score"), s["recognizer"].alias("recognizer"), F.when(~same(s), s["entity_type"]).alias("original"))
    return F.transform(kept, one).cast(RAW)


def adopt(spans: Column, known: list[str], ignored: list[str] = (), least: float = 0.0, wanted: list[str] = (), consolidate: bool = True) -> Column:
    """All of these one after the other: places, labels, mapping, score, wanted entities (GENERIC counts as one)."""
    return of_entities(scored(mapped(without_labels(with_places(spans), list(ignored)), known, consolidate), least), list(wanted))
