"""Quality rules under weak supervision.

Every rule votes good (1), bad (-1) or abstains (0) on a document. Votes are reduced to counts of vote
patterns (at most 3 ** number of rules rows, whatever the input's size), expectation-maximisation on those
counts estimates the share of good documents and how often each rule is right about each class, and the posterior probability of
being good replaces all-must-pass filtering. Everything up to the pattern counts, and the posterior, are
DataFrame expressions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blank_words, let, materialize

WINDOW = 8


def repeated_words(words: Column, width: int = WINDOW) -> Column:
    """Words that lie in a window of `width` (a power of two) words found twice or more in the text.

    Window hashes come from doubling: two words, four, eight. Texts without an equal pair end there. Else the
    hashes are sorted with their places, and equal neighbours give the windows whose union is counted.
    """

    def joined(a: Column, step: int) -> Column:  # hashes over `step` words become hashes over twice as many
        return F.zip_with(a, F.slice(a, step + 1, F.size(a)), lambda x, y: F.xxhash64(x, y))

    def doubling(step: int):
        return lambda a: joined(a, step)

    def covered(places: Column) -> Column:
        gaps = F.zip_with(places, F.slice(places, 2, F.size(places)), lambda a, b: F.least(F.lit(width), F.coalesce(b - a, F.lit(width))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda acc, x: acc + x)

    def among(s: Column) -> Column:
        same = F.filter(s, lambda e, k: F.coalesce(e.h == F.get(s, k - 1).h, F.lit(False)) | F.coalesce(e.h == F.get(s, k + 1).h, F.lit(False)))
        return let(F.sort_array(F.transform(same, lambda e: e.i)), covered)

    def heavy(h: Column) -> Column:
        return let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), among)

    def checked(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(heavy(h))

    def hashed(w: Column) -> Column:
        h, step = joined(w, 1), 2
        while step < width:
            h, step = let(h, doubling(step)), step * 2
        return let(F.slice(h, 1, F.size(w) - (width - 1)), checked)

    return let(words, lambda w: F.when(F.size(w) <= width, F.lit(0).cast("long")).otherwise(hashed(w)))


def features(docs: DataFrame) -> DataFrame:
    """doc_id and the counts that rules vote on; a null text counts as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeated_words(w).alias("n_repeat_words"),
        )

    def of_lines(x: Column) -> Column:
        return F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))

    return docs.select(
        "doc_id",
        let(blank_words(text), of_words).alias("w"),
        let(lines, of_lines).alias("l"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit("[!-/:-@\\[-`{-~]")).cast("long").alias("n_punct"),
        F.regexp_count(text, F.lit("[A-ZÀ-Þ]")).cast("long").alias("n_upper"),
    ).select("doc_id", "w.*", "l.*", "n_symbols", "n_punct", "n_upper")


def votes() -> dict[str, Column]:
    """Rule name -> 1 good, -1 bad, 0 abstains; over the columns of features()."""

    def rule(bad: Column, good: Column) -> Column:
        return F.when(bad, -1).when(good, 1).otherwise(0)

    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    share = lambda c: F.col(c) / chars
    return {
        "length": rule(F.col("n_words") < 20, F.col("n_words") >= 50),
        "symbols": rule(share("n_symbols") > 0.04, share("n_symbols") < 0.01),
        "punctuation": rule(share("n_punct") > 0.15, share("n_punct") < 0.08),
        "upper": rule(share("n_upper") > 0.4, share("n_upper") < 0.15),
        "lines": rule(F.col("n_dup_lines") > 0.3 * F.greatest(F.col("n_lines"), F.lit(1)), F.col("n_dup_lines") <= 0.1 * F.col("n_lines")),
        "repeats": rule(100 * F.col("n_repeat_words") > 30 * F.col("n_words"), 100 * F.col("n_repeat_words") <= 10 * F.col("n_words")),
        "word_length": rule((chars / words < 2.5) | (chars / words > 14), (chars / words).between(3.5, 10)),
    }


def fit(patterns: list[tuple[tuple[int, ...], int]], rules: int, rounds: int = 200) -> tuple[float, list[dict[int, float]]]:
    """(log odds of good before any vote, per rule the log odds that a vote of 1 or -1 adds) by expectation-maximisation on counted patterns.

    A rule's accuracy is how often it casts each vote on good and on bad documents. The first guess is that a
    document with a bad vote is bad; from there both classes' vote shares and the share of good documents are
    re-estimated until they stay. A vote never weighs against its own meaning, and abstaining weighs nothing,
    which keeps the classes from changing places.
    """
    guess = [0.1 if -1 in p else 0.9 for p, _ in patterns]
    prior, weights = math.log(9), [{1: 0.0, -1: 0.0} for _ in range(rules)]
    for _ in range(rounds):
        good = sum(n * g for (_, n), g in zip(patterns, guess, strict=True)) + 1.0
        bad = sum(n * (1 - g) for (_, n), g in zip(patterns, guess, strict=True)) + 1.0
        prior = math.log(good / bad)
        for r in range(rules):
            for v in (1, -1):
                in_good = sum(n * g for (p, n), g in zip(patterns, guess, strict=True) if p[r] == v) + 0.5
                in_bad = sum(n * (1 - g) for (p, n), g in zip(patterns, guess, strict=True) if p[r] == v) + 0.5
                odds = math.log(in_good / good) - math.log(in_bad / bad)
                weights[r][v] = max(0.0, odds) if v > 0 else min(0.0, odds)
        old, guess = guess, [posterior(p, prior, weights) for p, _ in patterns]
        if not patterns or max(abs(a - b) for a, b in zip(old, guess, strict=True)) < 1e-7:
            break
    return prior, weights


def posterior(pattern: tuple[int, ...], prior: float, weights: list[dict[int, float]]) -> float:
    z = prior + sum(w.get(v, 0.0) for v, w in zip(pattern, weights, strict=True))
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def quality_rules(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per row of docs (doc_id, text, ...): its counts, base_failed, p_good and kept.

    Null or empty text: no words, so base_failed. Repeated rows are judged each on its own and count each in
    the fit. An empty table gives an empty result. Columns other than doc_id and text are not looked at.
    The features are written once to the shared folder, as both the fit and the verdict read them.
    """
    rules = votes()
    table = materialize(features(docs.select("doc_id", "text")), "quality")
    voted = table.select(*[v.alias(k) for k, v in rules.items()])
    counts = [(tuple(r)[:-1], r["n"]) for r in voted.groupBy(*rules).agg(F.count(F.lit(1)).alias("n")).collect()]  # at most 3 ** rules rows
    prior, weights = fit(sorted(counts), len(rules))
    z = F.lit(prior)
    for (_, vote), w in zip(rules.items(), weights, strict=True):
        z = z + F.when(vote == 1, w[1]).when(vote == -1, w[-1]).otherwise(0.0)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return table.withColumn("p_good", 1 / (1 + F.exp(-z))).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & (F.col("p_good") >= threshold)).alias("kept"), "p_good",
    )
