"""Set algebra over one text's spans, as array expressions; span arrays have the type scan.SPAN.

Each works by a sort and one sweep, so that its time is that of a sort unless spans lie in heaps over each other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .compiled import compiled
from .scan import SPAN, cut, let, pages, sweep

ONE = SPAN[6:-1]


def _ordered(spans: Column, *keys) -> Column:
    """spans sorted by the key columns that each of keys makes of a span, ascending; equal ones as given."""
    return F.transform(F.array_sort(F.transform(spans, lambda s, i: F.struct(*[k(s).alias(f"k{n}") for n, k in enumerate(keys)], i.alias("i"), s.alias("s")))), lambda x: x["s"])


@compiled(("spans",))
def by_place(spans: Column) -> Column:
    return _ordered(spans, lambda s: s["start"], lambda s: s["end"])


def by_score(spans: Column) -> Column:
    """Score descending, start ascending, length descending."""
    return _ordered(spans, lambda s: -s["score"], lambda s: s["start"], lambda s: s["start"] - s["end"], lambda s: s["entity_type"])


def _there(values: Column) -> Column:
    return F.filter(values, lambda x: x.isNotNull())


def _stepped(state: Column, value: Column) -> Column:
    return F.struct(state.alias("state"), value.alias("value"))


def _numbered(spans: Column) -> Column:
    return F.transform(spans, lambda s, i: F.struct(i.alias("at"), s.alias("s")))


def _apart(spans: Column) -> Column:
    """Whether no span is empty and no two overlap: nothing is left to resolve by a sweep then, as is so in most texts."""
    sorted_ = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    clear = lambda o, x, i: (x["start"] < x["end"]) & F.coalesce(x["end"] <= F.get(o, i + 1)["start"], F.lit(True))
    return let(sorted_, lambda o: F.forall(F.transform(o, lambda x, i: clear(o, x, i)), lambda fine: fine))


def _kept(ordered: Column, begin: Column, step: Callable[[Column, Column], Column]) -> Column:
    """The items for which a sweep's value is true."""
    return let(ordered, lambda o: _there(F.zip_with(o, sweep(o, begin, step, "boolean")["out"], lambda x, keep: F.when(keep, x))))


@compiled(("spans",))
def without_contained(spans: Column) -> Column:
    """Spans that no other of their type contains with at least their score; of equal ones the first by recognizer; no zero scores."""
    ordered = lambda all_: _ordered(all_, lambda s: s["entity_type"], lambda s: s["start"], lambda s: -s["end"], lambda s: -s["score"], lambda s: s["recognizer"])

    def step(active: Column, s: Column) -> Column:  # those kept that reach this far
        def judged(near: Column) -> Column:
            beaten = F.exists(near, lambda a: (a["end"] >= s["end"]) & (a["score"] >= s["score"]))
            return let(beaten, lambda b: _stepped(F.when(b, near).otherwise(F.concat(near, F.array(s))), ~b))

        return let(F.filter(active, lambda a: (a["end"] >= s["start"]) & (a["entity_type"] == s["entity_type"])), judged)

    there = F.filter(spans, lambda s: s["score"] > 0)
    swept = lambda all_: by_score(_kept(ordered(all_), F.array().cast(SPAN), step))
    return let(there, lambda all_: F.when(F.size(all_) == 0, all_).when(_apart(all_), by_score(all_)).otherwise(swept(all_)))


def moved(s: Column, start: Column | None = None, end: Column | None = None, score: Column | None = None) -> Column:
    """The span with another place or score."""
    return F.struct(s["entity_type"].alias("entity_type"), (s["start"] if start is None else start).alias("start"), (s["end"] if end is None else end).alias("end"), (s["score"] if score is None else score).alias("score"), s["recognizer"].alias("recognizer"))


def _groups(found: Column, made: Callable[[Column, Column], Column]) -> Column:
    """made(place of the first item, the sweep's value at the last one, which is there too) of each run of items that have one `first`."""

    def last(r: Column, i: Column) -> Column:
        return F.when(F.coalesce(F.get(found, i + 1)["first"] != r["first"], F.lit(True)), made(r, i))

    return _there(F.transform(found, last))


@compiled(("spans",))
def merge_same_type(spans: Column) -> Column:
    """Overlapping (not touching) spans of one type become one: smallest start, largest end, highest score; in the order
    given, a merged span at the place of the last one in it."""

    def step(a: Column, x: Column) -> Column:
        s = x["s"]["s"]
        joins = F.coalesce((a["type"] == s["entity_type"]) & (s["start"] < a["end"]) & (a["start"] < s["end"]), F.lit(False))

        def of(j: Column) -> Column:
            grown = lambda old, new: F.when(j, F.greatest(old, new)).otherwise(new)
            first, at, end, score = F.when(j, a["first"]).otherwise(x["i"]), grown(a["at"], x["s"]["at"]), grown(a["end"], s["end"]), grown(a["score"], s["score"])
            state = F.struct(s["entity_type"].alias("type"), F.when(j, a["start"]).otherwise(s["start"]).alias("start"), first.alias("first"), at.alias("at"), end.alias("end"), score.alias("score"))
            return _stepped(state, F.struct(first.alias("first"), at.alias("at"), end.alias("end"), score.alias("score")))

        return let(joins, of)

    def swept(ordered: Column) -> Column:
        begin = F.lit(None).cast("struct<type:string,start:int,first:int,at:int,end:int,score:double>")
        items = F.transform(ordered, lambda s, i: F.struct(s.alias("s"), i.alias("i")))
        made = lambda r, _: F.struct(r["at"].alias("at"), moved(F.get(ordered, r["first"])["s"], end=r["end"], score=r["score"]).alias("s"))
        return let(sweep(items, begin, step, "struct<first:int,at:int,end:int,score:double>")["out"], lambda found: _groups(found, made))

    ordered = _ordered(_numbered(spans.cast(SPAN)), lambda x: x["s"]["entity_type"], lambda x: x["s"]["start"], lambda x: x["s"]["end"])
    return F.transform(F.array_sort(let(ordered, swept)), lambda x: x["s"])


@compiled(("spans",))
def without_covered(spans: Column) -> Column:
    """Spans that no other, of any type, contains; of spans at the same place the highest score, then the last one given. In the order given."""
    ordered = _ordered(_numbered(spans), lambda x: x["s"]["start"], lambda x: -x["s"]["end"], lambda x: -x["s"]["score"], lambda x: -x["at"])

    def step(seen: Column, x: Column) -> Column:  # greatest end of what lies at other places before, and the place just met
        s = x["s"]
        same = (s["start"] == seen["start"]) & (s["end"] == seen["end"])

        def judged(most: Column) -> Column:
            keep = ~F.coalesce(same, F.lit(False)) & F.coalesce(most < s["end"], F.lit(True))
            return _stepped(F.struct(most.alias("most"), s["start"].alias("start"), s["end"].alias("end")), keep)

        return let(F.when(same, seen["most"]).otherwise(F.greatest(seen["most"], seen["end"])), judged)

    first = F.struct(*[F.lit(None).cast("int").alias(c) for c in ("most", "start", "end")])
    return F.transform(F.array_sort(_kept(ordered, first, step)), lambda x: x["s"])


@compiled(("spans",))
def trim_intersections(spans: Column) -> Column:
    """Neighbours that overlap: the one with the lower score gives way (on equal scores the later), after which all are
    put in order again; what is left empty goes. By place.

    A sweep by place keeps the spans that later ones may still meet, in order; what begins before the next one is settled.
    """
    kind = "array<struct<start:int,end:int,score:double,i:int>>"
    with_place = lambda s, start=None, end=None: F.struct((s["start"] if start is None else start).alias("start"), (s["end"] if end is None else end).alias("end"), s["score"].alias("score"), s["i"].alias("i"))
    place = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))

    def settle(held: Column, until: Column) -> Column:
        """struct(out, held): spans that are done and those that must wait for what lies at `until` (null: nothing comes)."""

        def turn(a: Column) -> Column:
            x, y, tail = F.get(a["held"], 0), F.get(a["held"], 1), F.slice(a["held"], 3, F.greatest(F.size(a["held"]) - 2, F.lit(0)))
            apart = F.struct(F.concat(a["out"], F.array(x)).alias("out"), F.slice(a["held"], 2, F.greatest(F.size(a["held"]) - 1, F.lit(0))).alias("held"))
            back = lambda m: F.concat(F.array(x), F.filter(tail, lambda t: place(t) < place(m)), F.array(m), F.filter(tail, lambda t: place(t) >= place(m)))
            cut_ = F.when(x["score"] >= y["score"], let(with_place(y, start=x["end"]), back)).otherwise(F.concat(F.array(with_place(x, end=y["start"]), y), tail))
            waits = (F.size(a["held"]) < 2) | F.coalesce(place(y) > until, F.lit(False))
            return F.when(waits, a).when(x["end"] <= y["start"], apart).otherwise(F.struct(a["out"].alias("out"), cut_.alias("held")))

        turns = F.sequence(F.lit(0), F.floor(F.size(held) * (F.size(held) + 1) / 2).cast("int"))  # one cut for two spans at most
        return F.aggregate(turns, F.struct(F.array().cast(kind).alias("out"), held.alias("held")), lambda a, _: turn(a))

    def step(held: Column, x: Column) -> Column:
        s = x["s"]
        more = F.concat(F.filter(held, lambda h: place(h) <= place(s)), F.array(s), F.filter(held, lambda h: place(h) > place(s)))
        slow = let(let(more, lambda m: settle(m, x["until"])), lambda r: _stepped(r["held"], r["out"]))
        apart = F.coalesce(F.get(held, 0)["end"] <= s["start"], F.lit(True)) & (F.size(held) < 2)
        return F.when(apart, _stepped(F.array(s), held)).otherwise(slow)

    def swept(ordered: Column) -> Column:
        number = lambda s, i: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["score"].alias("score"), i.alias("i"))
        items = F.transform(ordered, lambda s, i: F.struct(number(s, i).alias("s"), F.when(i + 1 < F.size(ordered), place(F.get(ordered, i + 1))).alias("until")))
        left = let(sweep(items, F.array().cast(kind), step, kind), lambda r: F.filter(F.concat(F.flatten(r["out"]), r["state"]), lambda s: s["start"] < s["end"]))
        return F.transform(left, lambda s: moved(F.get(ordered, s["i"]), s["start"], s["end"]))

    return let(by_place(spans.cast(SPAN)), swept)


@compiled(("text", "spans"))
def merge_over_blanks(text: Column, spans: Column) -> Column:
    """Spans that follow each other, in the order given, with one type and only blanks between become one, with the later one's score."""

    def of(paged: Column, all_: Column) -> Column:
        def step(a: Column, x: Column) -> Column:
            s = x["s"]
            near = (a["type"] == s["entity_type"]) & (s["start"] > a["end"])
            joins = F.when(near, cut(paged, a["end"], s["start"]).rlike(r"\A +\n?\z")).otherwise(False)
            return let(F.when(joins, a["first"]).otherwise(x["i"]), lambda first: _stepped(F.struct(s["entity_type"].alias("type"), s["end"].alias("end"), first.alias("first")), F.struct(first.alias("first"))))

        items = F.transform(all_, lambda s, i: F.struct(s.alias("s"), i.alias("i")))
        made = lambda r, i: moved(F.get(all_, i), start=F.get(all_, r["first"])["start"])
        swept = let(sweep(items, F.lit(None).cast("struct<type:string,end:int,first:int>"), step, "struct<first:int>")["out"], lambda found: _groups(found, made))
        pairs = F.filter(F.transform(all_, lambda s, i: F.struct(s["end"].alias("from"), F.when(F.get(all_, i + 1)["entity_type"] == s["entity_type"], F.get(all_, i + 1)["start"]).alias("to"))), lambda p: p["to"] > p["from"])
        return F.when(F.exists(pairs, lambda p: cut(paged, p["from"], p["from"] + 1) == " "), swept).otherwise(all_)

    return let(spans.cast(SPAN), lambda all_: let(F.when(F.size(all_) > 1, pages(text)).otherwise(F.array().cast("array<string>")), lambda paged: of(paged, all_)))


POLICIES = ("merge_similar_or_contained", "remove_intersections")


@compiled(("text", "spans"))
def _resolved(text: Column, spans: Column, policy: str, merge_blanks: bool) -> Column:
    plain, out = spans.cast(SPAN), without_covered(merge_same_type(spans))
    if policy == POLICIES[1]:
        plain, out = by_place(plain), trim_intersections(out)
    out = F.when(_apart(spans), plain).otherwise(out)
    return let(out, lambda o: merge_over_blanks(text, o)) if merge_blanks else out


def resolve(text: Column, spans: Column, policy: str = POLICIES[0], merge_blanks: bool = True) -> Column:
    """Spans ready for rewriting."""
    if policy not in POLICIES:
        raise ValueError(f"unknown conflict policy {policy!r}")
    return _resolved(text, spans, policy=policy, merge_blanks=merge_blanks)
