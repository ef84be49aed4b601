"""Detection: text column to scored spans, with context, thresholds, allow lists and span algebra."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .compiled import compiled
from .recognizers import Registry
from .scan import FLAGS, SPAN, Recognizer, cut, let, pages, scan
from .spans import moved, without_contained
from .words import INDEX, TOKEN, around, count_before, keywords, part, tokens

#: Keywords before and after a span that are its context; what a score gains by it, and has then at least.
BEFORE, AFTER, RAISE, LEAST = 5, 0, 0.35, 0.4
#: What may lie between the words of a phrase.
GAP = r"(?:\s+|\s*[-/]\s*)"


def phrase_pattern(terms: list[str], whole_word: bool = False) -> str | None:
    """A pattern of the terms of several words, each beginning at a word's begin; None if there are none."""
    cut = [[w for w in re.split(r"[\s\-/]+", t.lower().replace("’", "'")) if w] for t in terms]
    joined = [GAP.join(re.escape(w).replace("'", "['’]") for w in words) for words in cut if len(words) > 1]
    return rf"(?iU)(?<!\w)(?:{'|'.join(joined)})" + (r"(?!\w)" if whole_word else "") if joined else None


def with_context(text: Column, spans: Column, terms: dict[str, list[str]], whole_word: bool = False, given: list[str] = (), before: int = BEFORE, after: int = AFTER) -> Column:
    """Scores raised where a term of the span's recognizer is in one of the `before` keywords before it, the `after` ones behind it, the word
    in which it begins, its own text or the given words, or, if it has several words, stands in the `before` tokens before the span or
    the `after` ones behind it.

    Spans of recognizers without terms stay as they are. The text's words are looked up in one index, which only texts
    with a span that can gain have.
    """
    held = tuple(sorted((name, tuple(sorted({w for w in words if w}))) for name, words in terms.items()))
    return _raised(text, spans, terms=held, whole_word=whole_word, given=tuple(given), before=before, after=after) if any(words for _, words in held) else spans


@compiled(("text", "spans"))
def _raised(text: Column, spans: Column, terms: tuple, whole_word: bool, given: tuple, before: int, after: int) -> Column:
    terms = dict(terms)
    patterns = {name: p for name, words in terms.items() if (p := phrase_pattern(list(words), whole_word))}
    terms = {name: sorted({w.lower() for w in words if w}) for name, words in terms.items()}
    terms = {name: words for name, words in terms.items() if words}
    table = F.create_map(*[F.lit(x) for name, words in terms.items() for x in (name, words)])
    gains = lambda s: (s["score"] < 1) & s["recognizer"].isin(list(terms))
    phrased = lambda s: (s["score"] < 1) & s["recognizer"].isin(list(patterns))

    def raised(all_: Column, words: Column, every: Column, paged: Column) -> Column:
        def window(s: Column) -> Column:
            """The tokens before the span, and those behind it after a line's end, which no phrase crosses."""

            def of(k: Column) -> Column:
                front = cut(paged, F.coalesce(F.get(part(every, k - before, F.lit(before)), 0)["start"], s["start"]), s["start"])
                if not after:
                    return front
                last = F.element_at(F.concat(F.array(s["end"]), part(every, count_before(every, s["end"]), F.lit(after))["end"]), -1)
                return F.concat(front, F.lit(" \u2029. "), cut(paged, s["end"], last))

            return let(count_before(every, s["start"]), of)

        def one(s: Column) -> Column:
            def scored(own: Column) -> Column:
                near = F.concat(around(words, s, before, after), F.array(F.lower(cut(paged, s["start"], s["end"])), *[F.lit(w.lower()) for w in given]))
                test = lambda w: F.exists(own, lambda t: (w == t) if whole_word else w.contains(t))
                met = F.exists(near, test)
                if patterns:
                    met = met | F.when(phrased(s), let(window(s), lambda w: found_phrase(s, w))).otherwise(False)
                return F.when(met, F.least(F.lit(1.0), F.greatest(s["score"] + RAISE, F.lit(LEAST)))).otherwise(s["score"])

            score = F.when(gains(s), let(F.try_element_at(table, s["recognizer"]), scored)).otherwise(s["score"])
            return F.struct(s["entity_type"].alias("entity_type"), s["start"].alias("start"), s["end"].alias("end"), score.alias("score"), s["recognizer"].alias("recognizer"))

        return F.transform(all_, one)

    def found_phrase(s: Column, w: Column) -> Column:
        found = F.lit(False)
        for name, p in patterns.items():
            found = F.when(s["recognizer"] == name, F.rlike(w, F.lit(p))).otherwise(found)
        return found

    def of(all_: Column) -> Column:
        none = F.array().cast(INDEX)
        words = F.when(F.exists(all_, gains), keywords(text)).otherwise(none)
        every = F.when(F.exists(all_, phrased), tokens(text, TOKEN)).otherwise(none) if patterns else none
        paged = F.when(F.exists(all_, gains), pages(text)).otherwise(F.array().cast("array<string>"))
        return let(F.struct(words.alias("words"), every.alias("every"), paged.alias("paged")), lambda i: raised(all_, i["words"], i["every"], i["paged"]))

    return let(spans, of)


def with_hooks(text: Column, spans: Column, use: list[Recognizer], rest: Callable[[Column], Column]) -> Column:
    """Spans with the scores that their recognizers' own hooks give them; the others as `rest` (which keeps their order) makes them."""
    hooked = [r for r in use if r.enhance is not None]
    if not hooked:
        return rest(spans)

    def own(s: Column, all_: Column) -> Column:
        score = s["score"]
        for r in hooked:
            score = F.when(s["recognizer"] == r.name, r.enhance(text, s, all_)).otherwise(score)
        return score

    def both(all_: Column) -> Column:
        scores = F.transform(all_, lambda s: F.least(F.greatest(own(s, all_), F.lit(0).cast("double")), F.lit(1).cast("double")))
        others = F.zip_with(rest(all_), scores, lambda s, x: F.struct(s.alias("s"), x.alias("x")))
        return F.zip_with(others, all_, lambda o, s: F.when(o["x"] == s["score"], o["s"]).otherwise(moved(s, score=o["x"])))

    return let(spans, both)


def analyze(
    text: Column,
    registry: Registry | None = None,
    entities: list[str] | None = None,
    threshold: float | None = None,
    context: list[str] = (),
    allow: list[str] = (),
    allow_match: str = "exact",
    ad_hoc: list[Recognizer] = (),
    flags: str = FLAGS,
    before: int = BEFORE,
    after: int = AFTER,
) -> Column:
    """Array of spans (entity_type, start, end, score, recognizer), best score first; empty for null text.

    threshold, if given, overrules recognizers' own thresholds. allow: texts that are no findings, compared
    exactly or as regular expressions found within them. ad_hoc recognizers join for this call only. context: words
    that count as standing around every span, to be met by the recognizers' own terms. before, after: keywords around a
    span that are its context.
    """
    if threshold is not None and not 0 <= threshold <= 1:
        raise ValueError("a threshold lies between 0 and 1")
    if allow_match not in ("exact", "regex"):
        raise ValueError(f"unknown way to match allowed texts: {allow_match!r}")
    reg = registry or Registry()
    use = Registry.chosen(type("Both", (), {"recognizers": [*reg.recognizers, *ad_hoc]})(), entities) if ad_hoc else reg.chosen(entities)

    def found(t: Column) -> Column:
        spans = scan(t, use, flags)
        spans = with_hooks(t, spans, use, lambda spans: with_context(t, spans, {r.name: list(r.context) for r in use}, given=list(context), before=before, after=after))
        least = {r.name: threshold if threshold is not None else r.thresholds.get(r.entity, r.thresholds.get("default", 0.0)) for r in use}
        if len(set(least.values())) == 1:
            spans = F.filter(spans, lambda s: s["score"] >= next(iter(least.values())))
        else:
            table = F.create_map(*[F.lit(x) for k, v in least.items() for x in (k, float(v))])
            spans = F.filter(spans, lambda s: s["score"] >= F.coalesce(F.try_element_at(table, s["recognizer"]), F.lit(0.0)))
        terms = [a for a in allow if a]
        if terms:
            allowed = (lambda x: x.isin(terms)) if allow_match == "exact" else (lambda x: x.rlike(flags + "|".join(f"(?:{a})" for a in terms)))
            spans = let(spans, lambda all_: let(F.when(F.size(all_) > 0, pages(t)).otherwise(F.array().cast("array<string>")), lambda paged: F.filter(all_, lambda s: ~allowed(cut(paged, s["start"], s["end"])))))
        return without_contained(spans)

    return F.when(text.isNotNull(), let(text, found)).otherwise(F.array().cast(SPAN))


def spread(df: DataFrame) -> DataFrame:
    """df dealt evenly: short values take little room in files, so that few tasks would read, and then analyze, all of them."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism))


def explanations(df: DataFrame, column: str, keys: list[str], registry: Registry | None = None, entities: list[str] | None = None, context: list[str] = (), flags: str = FLAGS) -> DataFrame:
    """Why each span has its score: keys, entity_type, start, end, recognizer, pattern, original_score, valid (true, false or null, if
    no check spoke), validated_score, score (with context). Spans that a check dropped are there too, with score 0."""
    use = (registry or Registry()).chosen(entities)

    def of(t: Column) -> Column:
        def joined(found: Column) -> Column:
            plain = F.transform(found, lambda x: F.struct(*[x[k].alias(k) for k in ("entity_type", "start", "end", "score", "recognizer")])).cast(SPAN)
            raised = with_context(t, plain, {r.name: list(r.context) for r in use}, given=list(context))
            return F.zip_with(found, raised, lambda x, y: F.struct(x.alias("x"), F.when(x["score"] > 0, y["score"]).otherwise(0.0).alias("score")))

        return let(scan(t, use, flags, explained=True), joined)

    rows = df.where(F.col(column).isNotNull()).select(*keys, F.explode(let(F.col(column), of)).alias("e"))
    return rows.select(*keys, "e.x.entity_type", "e.x.start", "e.x.end", "e.x.recognizer", "e.x.pattern", "e.x.original_score", "e.x.valid", F.col("e.x.score").alias("validated_score"), "e.score")


def findings(df: DataFrame, column: str, keys: list[str], **options) -> DataFrame:
    """One row a span: keys, entity_type, start, end, score, recognizer, found (the text of the span)."""

    def with_text(t: Column, spans: Column) -> Column:
        one = lambda paged, s: F.struct(s["entity_type"].alias("entity_type"), s["start"].alias("start"), s["end"].alias("end"), s["score"].alias("score"), s["recognizer"].alias("recognizer"), cut(paged, s["start"], s["end"]).alias("found"))
        return let(F.when(F.size(spans) > 0, pages(t)).otherwise(F.array().cast("array<string>")), lambda paged: F.transform(spans, lambda s: one(paged, s)))

    rows = df.select(*keys, let(F.col(column), lambda t: let(analyze(t, **options), lambda s: with_text(t, s))).alias("_spans"))
    return rows.select(*keys, F.explode_outer("_spans").alias("s")).where("s is not null").select(*keys, "s.*")


def chunks(text: Column, size: int = 250, overlap: int = 50) -> Column:
    """Array of (start, end): windows over a text; each ends at the next blank after `size` characters and the next begins at the first blank of its last `overlap` characters, or at its end."""
    if overlap >= size:
        raise ValueError("windows overlap by less than their size")
    kind = "array<struct<start:int,end:int>>"

    def windows(d: Column) -> Column:
        def blank(at: Column) -> Column:  # the first blank from there, or the text's end
            return F.coalesce(F.nullif(F.call_function("locate", F.lit(" "), d["flat"], at + 1), F.lit(0)) - 1, d["n"])

        def step(a: Column, _: Column) -> Column:
            def add(end: Column) -> Column:
                nxt = F.when(end >= d["n"], d["n"]).otherwise(F.least(blank(end - overlap), end))
                return F.struct(nxt.alias("at"), F.concat(a["out"], F.array(F.struct(a["at"].alias("start"), end.alias("end")))).alias("out"))

            return F.when(a["at"] >= d["n"], a).otherwise(let(blank(F.least(a["at"] + size, d["n"])), add))

        start = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))
        most = F.sequence(F.lit(0), F.floor(d["n"] / (size - overlap)).cast("int") + 1)
        return F.aggregate(most, start, step, lambda a: a["out"])

    flat = F.struct(F.translate(text, "\n", " ").alias("flat"), F.length(text).alias("n"))
    return F.when(F.length(text) > 0, let(flat, windows)).otherwise(F.array().cast(kind))


def sanitize(text: Column, pairs: list[tuple[str, str]]) -> Column:
    """text with each first string replaced by its second, one pair after the other, letter by letter."""
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text
