"""Pattern scans: a text column becomes an array of (start, end) of a pattern's matches, in code points."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .compiled import given, literal, sql

SPAN = "array<struct<entity_type:string,start:int,end:int,score:double,recognizer:string>>"
EXPLAINED = SPAN[:-2] + ",pattern:string,original_score:double,valid:boolean>>"
PLACES = "array<struct<start:int,end:int>>"
FLAGS = "(?imsU)"  # case-insensitive, ^ and $ at lines, dot matches all, Unicode classes


@dataclass(frozen=True)
class Recognizer:
    """What finds one entity type: patterns with scores, context words, and checks on the matched text.

    validate: true makes the score 1, false drops the match, null keeps the pattern's score; invalidate: true
    drops it whatever validate says. trim, before the checks, gives the length of the match to keep. span_fn, for
    other kinds of recognizers, maps the text to a span array. enhance, of the text, one of the recognizer's spans and the
    spans of all, gives the span's score; where it changes it, context words don't count any more.
    """

    name: str
    entity: str
    patterns: tuple[tuple[str, float], ...] = ()
    context: tuple[str, ...] = ()
    validate: Callable[[Column], Column] | None = None
    invalidate: Callable[[Column], Column] | None = None
    languages: tuple[str, ...] = ("en",)
    country: str | None = None
    enabled: bool = True
    thresholds: dict = field(default_factory=dict, hash=False)
    span_fn: Callable[[Column], Column] | None = None
    gate: str = r"\p{Nd}"  # a cheap pattern that any text with a match has
    trim: Callable[[Column], Column] | None = None
    enhance: Callable[[Column, Column, Column], Column] | None = None


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once a row.

    An aggregate over nothing, of which body is the finish: unlike a transform of one element it copies no result.
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda a, _: a, body)


#: Elements of a block of sweep(), and characters of a page (a power of two).
BLOCK, PAGE = 256, 1024


def sweep(items: Column, begin: Column, step: Callable[[Column, Column], Column], out: str) -> Column:
    """struct(state, out): goes once over items; step(state, item) is struct(state, value), and out has the values in order.

    Values gather in blocks and blocks in the whole, as each step copies what has gathered: that is up to 256 values for each
    item, and all for each block, so time is in proportion to the items for all but enormous arrays. Values should be
    numbers, with which the caller finds the rest.
    """

    def one(a: Column, x: Column) -> Column:
        return let(step(a["state"], x), lambda r: F.struct(r["state"].alias("state"), F.concat(a["out"], F.array(r["value"])).alias("out")))

    def block(a: Column, part: Column) -> Column:
        done = F.aggregate(part, F.struct(a["state"].alias("state"), F.array().cast(f"array<{out}>").alias("out")), one)
        return let(done, lambda r: F.struct(r["state"].alias("state"), F.concat(a["out"], F.array(r["out"])).alias("out")))

    def whole(xs: Column) -> Column:
        first = F.struct(begin.alias("state"), F.array().cast(f"array<array<{out}>>").alias("out"))
        numbers = F.when(F.size(xs) > 0, F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / BLOCK).cast("int"))).otherwise(F.array().cast("array<int>"))
        blocks = F.transform(numbers, lambda k: F.slice(xs, k * BLOCK + 1, BLOCK))
        return let(F.aggregate(blocks, first, block), lambda r: F.struct(r["state"].alias("state"), F.flatten(r["out"]).alias("out")))

    return let(items, whole)


def pages(text: Column) -> Column:
    """The text in parts of PAGE characters, so that a cut needn't walk from its begin."""
    return F.when(F.length(text) <= PAGE, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PAGE}}}"), F.lit(0)))


def cut(paged: Column, start: Column, end: Column) -> Column:
    """The characters from start to end of a text in pages()."""
    first = F.shiftright(start, PAGE.bit_length() - 1)
    n = F.shiftright(end - 1, PAGE.bit_length() - 1) - first + 1
    part = F.when(n > 1, F.array_join(F.slice(paged, first + 1, n), "")).otherwise(F.get(paged, first))
    return F.when(end > start, F.substring(part, start.bitwiseAND(PAGE - 1) + 1, end - start)).otherwise("")


#: Stands for a match while a text is cut at its matches; texts that hold it are cut by the pattern itself, which is slower.
MARK = "\ue000"


def matches(text: Column, marked: Column, pattern: str, flags: str = FLAGS) -> Column:
    """struct(hits, gaps): the matches of a pattern, and the lengths of what lies before, between and after them.

    Matches and what lies between them come from the same scan order, so their lengths add up to the places. The
    pattern is a literal: a task compiles it once. marked: whether the text has a MARK.
    """
    full = F.lit(flags + pattern)

    def with_gaps(hits: Column) -> Column:
        parts = F.when(marked, F.split(text, full, -1)).otherwise(F.split(F.regexp_replace(text, full, F.lit(MARK)), MARK, -1))
        return F.struct(hits.alias("hits"), F.when(F.size(hits) > 0, F.transform(parts, F.length)).otherwise(F.array().cast("array<int>")).alias("gaps"))

    return let(F.regexp_extract_all(text, full, F.lit(0)), with_gaps)


def starts(gaps: Column, lengths: Column) -> Column:
    """Where each match begins: sums of the gaps and lengths before it; for the last gap, the text's end."""

    def step(at: Column, x: Column) -> Column:
        return F.struct((at + x["gap"] + F.coalesce(x["n"], F.lit(0))).alias("state"), (at + x["gap"]).alias("value"))

    return sweep(F.zip_with(gaps, lengths, lambda g, n: F.struct(g.alias("gap"), n.alias("n"))), F.lit(0), step, "int")["out"]


def placed(found: Column) -> Column:
    """Array of (start, end, hit) of the non-empty matches of matches(), left to right."""
    one = lambda h, at: F.struct(at.alias("start"), (at + F.length(h)).alias("end"), h.alias("hit"))
    return F.when(F.size(found["hits"]) > 0, F.filter(F.zip_with(found["hits"], starts(found["gaps"], F.transform(found["hits"], F.length)), one), lambda x: x["end"] > x["start"])).otherwise(F.array().cast("array<struct<start:int,end:int,hit:string>>"))


def hits(text: Column, pattern: str, flags: str = FLAGS) -> Column:
    """Array of (start, end, hit) of the non-empty matches, left to right."""
    return let(matches(text, F.contains(text, F.lit(MARK)), pattern, flags), placed)


def places(text: Column, pattern: str, flags: str = FLAGS) -> Column:
    """Array of (start, end) of the non-empty matches, left to right."""
    return F.transform(hits(text, pattern, flags), lambda h: F.struct(h["start"].alias("start"), h["end"].alias("end")))


def surface(text: Column, span: Column) -> Column:
    """The text of a span, by a walk from the text's begin; of many spans, cut() the pages()."""
    return F.substring(text, span["start"] + 1, span["end"] - span["start"])


RAW = "array<struct<entity:string,name:string,pattern:string,score:double,gaps:array<int>,hits:array<struct<n:int,keep:int,verdict:double>>>>"


def _verdict(r: Recognizer, hit: Column) -> Column:
    """Length of the match, of what is kept of it, and what the checks say of that: 1, 0 or null."""

    def judged(keep: Column) -> Column:
        def of(found: Column) -> Column:
            value = F.lit(None) if r.validate is None else r.validate(found)
            value = value.cast("double") if r.invalidate is None else F.when(r.invalidate(found), F.lit(0).cast("double")).otherwise(value.cast("double"))
            return F.struct(F.length(hit).alias("n"), keep.alias("keep"), value.alias("verdict"))

        return of(hit) if r.trim is None else let(F.substring(hit, F.lit(1), keep), of)

    return judged(F.length(hit)) if r.trim is None else let(r.trim(hit), judged)


def _spans(x: Column, explained: bool) -> Column:
    """The spans of what one pattern found (an element of RAW)."""

    def span(h: Column, at: Column) -> Column:
        made = [x["entity"].alias("entity_type"), at.alias("start"), (at + h["keep"]).alias("end"), F.coalesce(h["verdict"], x["score"]).alias("score"), x["name"].alias("recognizer")]
        if explained:
            made += [x["pattern"].alias("pattern"), x["score"].alias("original_score"), h["verdict"].cast("boolean").alias("valid")]
        return F.when(h["n"] > 0, F.struct(*made))

    return F.filter(F.zip_with(x["hits"], starts(x["gaps"], x["hits"]["n"]), span), lambda s: s.isNotNull())


@lru_cache(maxsize=1024)
def _recognizer_sql(r: Recognizer, flags: str) -> str:
    """What a recognizer's patterns find in the text t, as RAW."""
    empty = _template()
    found = ", ".join(f"struct({literal(p)} AS pattern, {float(score)}D AS score, {empty.replace(literal(_HERE), literal(flags + p))} AS m)" for p, score in r.patterns)
    verdict = sql(_verdict(r, F.col("h")))
    some = f"filter(array({found}), z -> size(z.m.hits) > 0)"
    return f"transform({some}, z -> struct({literal(r.entity)} AS entity, {literal(r.name)} AS name, z.pattern AS pattern, z.score AS score, z.m.gaps AS gaps, transform(z.m.hits, h -> {verdict}) AS hits))"


_HERE = "the pattern"


@lru_cache(maxsize=1)
def _template() -> str:
    return sql(matches(F.col("t"), F.col("g.marked"), _HERE, ""))


@lru_cache(maxsize=64)
def _scan_sql(use: tuple[Recognizer, ...], flags: str, explained: bool) -> str:
    gates, kind, none = sorted({r.gate for r in use}), EXPLAINED if explained else SPAN, f"CAST(array() AS {RAW})"
    found = ", ".join(f"CASE WHEN get(g.able, {gates.index(r.gate)}) THEN {_recognizer_sql(r, flags)} ELSE {none} END" for r in use)
    seen = f"struct(array({', '.join(f'rlike(t, {literal(g)})' for g in gates)}) AS able, contains(t, {literal(MARK)}) AS marked)"
    spans = f"CAST(flatten(transform(concat({none}, {found}), x -> {sql(_spans(F.col('x'), explained))})) AS {kind})"
    return f"t -> aggregate(CAST(array() AS ARRAY<INT>), {seen}, (g, w) -> g, g -> {spans})"


def scan(text: Column, use: list[Recognizer], flags: str = FLAGS, explained: bool = False) -> Column:
    """Scored spans of all recognizers, zero scores dropped; explained ones are EXPLAINED, and all of them.

    Gates, each tested once, leave out the patterns that a text can't match. Every pattern is a literal; checks run on
    what it found. Where the matches lie is worked out for all patterns by one expression. The expression is kept as
    text for each choice of recognizers.
    """
    mine, kind = tuple(r for r in use if r.span_fn is None and r.patterns), EXPLAINED if explained else SPAN
    parts = [given(text, _scan_sql(mine, flags, explained))] if mine else []
    if explained:
        return F.concat(F.array().cast(kind), *parts)
    parts += [r.span_fn(text).cast(SPAN) for r in use if r.span_fn is not None]
    return F.filter(F.concat(*parts), lambda s: s["score"] > 0)


def deny_list(name: str, entity: str, terms: list[str], score: float = 1.0, **more) -> Recognizer:
    """A recognizer of the terms where they stand between non-word characters or text edges."""
    joined = "|".join(re.sub(r"([^\w\s])", r"\\\1", t) for t in sorted(set(terms), key=lambda t: (-len(t), t)))
    return Recognizer(name, entity, ((rf"(?<=^|\W)(?:{joined})(?=\W|$)", score),), gate=r"\S", **more)
