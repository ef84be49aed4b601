"""The words of a text with their places: an index built once a text, in which a span's neighbours are found by binary search."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scan import hits, let

# Words that are no keywords, so neither help nor count in the window around a span.
STOP = ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "have", "he", "her", "his", "i", "in", "is", "it", "its", "me", "my", "of", "on", "or", "our", "she", "that", "the", "their", "this", "to", "was", "we", "were", "will", "with", "you", "your"]
#: What a word is made of; what counts as a token where punctuation does too.
WORD, TOKEN = r"[\p{L}\p{N}#']+", r"\w[\w'’]*|[^\w\s]"
INDEX = "array<struct<start:int,end:int,word:string>>"


def tokens(text: Column, pattern: str = WORD, stop: list[str] = ()) -> Column:
    """Array of (start, end, word): the words in lower case, in order, without stop words."""
    found = F.transform(hits(text, pattern, "(?U)"), lambda h: F.struct(h["start"].alias("start"), h["end"].alias("end"), F.lower(h["hit"]).alias("word")))
    return F.filter(found, lambda t: ~t["word"].isin(list(stop))) if stop else found


def keywords(text: Column, stop: list[str] = STOP) -> Column:
    return tokens(text, WORD, stop)


def count_before(index: Column, at: Column, side: str = "start") -> Column:
    """How many tokens begin (or, by side, end) before a place."""

    def turn(a: Column, _: Column) -> Column:
        middle = F.shiftright(a["lo"] + a["hi"], 1)
        less = F.get(index, middle)[side] < at
        return F.when(a["lo"] >= a["hi"], a).otherwise(F.struct(F.when(less, middle + 1).otherwise(a["lo"]).alias("lo"), F.when(less, a["hi"]).otherwise(middle).alias("hi")))

    turns = F.sequence(F.lit(0), F.ceil(F.log2(F.size(index) + 1)).cast("int"))
    return F.aggregate(turns, F.struct(F.lit(0).alias("lo"), F.size(index).alias("hi")), turn, lambda a: a["lo"])


def part(index: Column, begin: Column, n: Column) -> Column:
    """n tokens from the begin-th (from 0), fewer at the index's ends."""
    first = F.greatest(begin, F.lit(0))
    return F.slice(index, first + 1, F.greatest(F.least(begin + n, F.size(index)) - first, F.lit(0)))


def around(index: Column, span: Column, before: int, after: int) -> Column:
    """Words of the index around a span: `before` that end before it, the one in which it begins, `after` that begin after it."""

    def of(k: Column) -> Column:  # tokens that begin before the span
        last = F.get(index, k - 1)
        inside = (k > 0) & (last["end"] > span["start"])
        found = part(index, k - before - F.when(inside, 1).otherwise(0), F.lit(before) + F.when(inside, 1).otherwise(0))
        if after:
            found = F.concat(found, part(index, count_before(index, span["end"]), F.lit(after)))
        return F.transform(found, lambda t: t["word"])

    return let(count_before(index, span["start"]), of)
