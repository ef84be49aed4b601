"""Detection in windows of long texts: windows by characters or by tokens, and findings of overlapping windows united."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .analyze import analyze, chunks
from .scan import PLACES, SPAN, let, places

KEPT = f"array<struct<s:{SPAN[6:-1]},begins:boolean,ends:boolean>>"


def token_chunks(text: Column, size: int = 400, overlap: int = 40, token: str = r"\w+|[^\w\s]") -> Column:
    """Array of (start, end): windows of `size` tokens, each `size - overlap` tokens after the one before, until a window
    reaches the last token; from its first token's begin to its last one's end."""
    if not 0 <= overlap < size:
        raise ValueError("windows overlap by less than their size")

    def windows(found: Column) -> Column:
        n = F.size(found)
        begins = F.sequence(F.lit(0), F.greatest(F.ceil((n - size) / (size - overlap)), F.lit(0)).cast("int"))
        one = lambda k: F.struct(F.get(found, k * (size - overlap))["start"].alias("start"), F.get(found, F.least(k * (size - overlap) + size, n) - 1)["end"].alias("end"))
        return F.when(n > 0, F.transform(begins, one)).otherwise(F.array().cast(PLACES))

    return F.when(text.isNotNull(), let(places(text, token), windows)).otherwise(F.array().cast(PLACES))


CHUNKERS: dict[str, Callable[..., Column]] = {"character": chunks, "tokenizer": token_chunks}


def chunker(kind: str, **options) -> Callable[[Column], Column]:
    """What cuts a text column into windows, by name."""
    if kind not in CHUNKERS:
        raise ValueError(f"unknown kind of windows {kind!r}")
    return lambda text: CHUNKERS[kind](text, **options)


def unite(found: Column) -> Column:
    """Spans of overlapping windows (KEPT: the span, and whether only blanks lie between it and an inner edge of its
    window in front and behind) without duplicates, by start.

    Two spans of one type are duplicates if they share more than half of the shorter one; the higher score stays. A
    span that an edge cut gives way to its only duplicate so far if that contains it and goes on beyond this edge.
    """

    def fold(kept: Column, x: Column) -> Column:
        def twin(k: Column) -> Column:
            a, b = k["s"], x["s"]
            shared = F.least(a["end"], b["end"]) - F.greatest(a["start"], b["start"])
            return (a["entity_type"] == b["entity_type"]) & (shared > 0) & (shared > F.least(a["end"] - a["start"], b["end"] - b["start"]) / 2)

        def completes(k: Column) -> Column:
            a, b = k["s"], x["s"]
            front = k["begins"] & ~x["begins"] & (b["start"] < a["start"])
            back = k["ends"] & ~x["ends"] & (b["end"] > a["end"])
            return (b["start"] <= a["start"]) & (b["end"] >= a["end"]) & (front | back)

        twins = F.size(F.filter(kept, twin))
        swapped = F.transform(kept, lambda k: F.when(twin(k) & completes(k), x).otherwise(k))
        return F.when(twins == 0, F.concat(kept, F.array(x))).when(twins == 1, swapped).otherwise(kept)

    best = F.transform(F.array_sort(F.transform(found, lambda x, i: F.struct((-x["s"]["score"]).alias("k"), i.alias("i"), x.alias("x")))), lambda y: y["x"])
    united = F.transform(F.aggregate(best.cast(KEPT), F.array().cast(KEPT), lambda kept, x: fold(kept, x).cast(KEPT)), lambda k: k["s"])
    return F.transform(F.array_sort(F.transform(united, lambda s, i: F.struct(s["start"].alias("k"), i.alias("i"), s.alias("s")))), lambda x: x["s"])


def analyze_chunks(text: Column, kind: str = "character", size: int = 250, overlap: int = 50, **options) -> Column:
    """Spans of analyze() run on each window, at their places in the text; a text of one window is analyzed whole."""

    def found(t: Column, windows: Column) -> Column:
        def of(w: Column, i: Column) -> Column:
            def shifted(part: Column) -> Column:
                def one(s: Column) -> Column:
                    before, after = F.substring(part, F.lit(1), s["start"]), F.substring(part, s["end"] + 1, F.length(part))
                    place = F.struct(s["entity_type"].alias("entity_type"), (s["start"] + w["start"]).alias("start"), (s["end"] + w["start"]).alias("end"), s["score"].alias("score"), s["recognizer"].alias("recognizer"))
                    return F.struct(place.alias("s"), ((i > 0) & ~before.rlike(r"\S")).alias("begins"), ((i < F.size(windows) - 1) & ~after.rlike(r"\S")).alias("ends"))

                return F.transform(analyze(part, **options), one).cast(KEPT)

            return let(F.substring(t, w["start"] + 1, w["end"] - w["start"]), shifted)

        many = unite(F.flatten(F.transform(windows, of)))
        return F.when(F.size(windows) == 0, F.array().cast(SPAN)).when(F.size(windows) == 1, analyze(t, **options)).otherwise(many)

    return F.when(text.isNotNull(), let(text, lambda t: let(chunker(kind, size=size, overlap=overlap)(t), lambda w: found(t, w)))).otherwise(F.array().cast(SPAN))
