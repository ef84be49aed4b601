"""Registered queries of term tables, providers, sessions and word indexes, with their SQL."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..operators import json_paths, lists
from ..operators.analyze import analyze
from ..operators.provider import provided
from ..operators.scan import PAGE, Recognizer, hits, let, places
from ..operators.words import around, tokens
from ..streaming import sessions

#: A word in both engines.
WORD = r"[\p{L}\p{N}_]+"


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def term_table_counts(spark, d):
    """Places in each document of a list of terms: all words of five letters or more of the benchmark."""
    terms = _t(spark, d, "benchmark").select(F.explode(tokens(F.col("text"), WORD)).alias("w")).where(F.length("w.word") >= 5).select(F.col("w.word").alias("term"))
    return lists.list_findings(_t(spark, d, "documents"), "text", ["doc_id"], terms, "TERM").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


def pair_table_counts(spark, d):
    """The same for every two words with one blank between, by the join that lists of any length take."""

    def pairs(found):
        both = F.transform(found, lambda x, i: F.struct(F.concat_ws(" ", x["hit"], F.get(found, i + 1)["hit"]).alias("term"), (F.get(found, i + 1)["start"] - x["end"]).alias("gap")))
        return F.filter(both, lambda p: p["gap"] == 1)

    terms = _t(spark, d, "benchmark").select("text", F.explode(let(hits(F.col("text"), WORD), pairs)).alias("p")).where(F.contains("text", F.col("p.term"))).select("p.term")
    return lists.list_findings(_t(spark, d, "documents"), "text", ["doc_id"], terms, "PAIR", few=0).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


def capitals(texts: list[str]) -> list[list[dict]]:
    """Stands for a service that finds runs of capitals, and fails on texts with `zz`."""
    if any("zz" in t for t in texts):
        raise RuntimeError("no answer")
    return [[{"entity_type": "CAPITALS", "start": m.start(), "end": m.end(), "score": 0.5} for m in re.finditer("[A-Z]{2,}", t)] for t in texts]


def provider_findings(spark, d):
    t = provided(_t(spark, d, "documents").select("doc_id", "text"), "text", capitals, "Capitals")
    return t.select("doc_id", F.size("spans").cast("long").alias("n"), F.aggregate("spans", F.lit(0), lambda a, s: a + s["end"] - s["start"]).cast("long").alias("size"), F.col("error").isNotNull().alias("failed"))


NAMES = Recognizer("Names", "NAME", (("[A-Z][a-z]+", 0.6),), gate="[A-Z]")


def session_names(spark, d):
    """Words with a capital as names, numbered within a conversation."""
    out = sessions.session_pseudonyms(_t(spark, d, "conversations"), "conv_id", "turn", "text", entities=["NAME"], ad_hoc=[NAMES], flags="(?U)")
    return out.select("conv_id", "turn", F.explode("numbered").alias("f")).select("conv_id", "turn", "f.start", "f.found", "f.n")


def session_restored(spark, d):
    """Conversations after session_names() and back."""
    out = sessions.session_pseudonyms(_t(spark, d, "conversations").select("conv_id", "turn", "text"), "conv_id", "turn", "text", entities=["NAME"], ad_hoc=[NAMES], flags="(?U)")
    return out.select("conv_id", "turn", F.length("text").alias("n_hidden"), sessions.restored(F.col("text"), F.col("numbered")).alias("text"))


def words_around(spark, d):
    """Two words before and one behind each `the`."""
    t = _t(spark, d, "conversations")

    def near(index, found):
        return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.array_join(around(index, s, 2, 1), " ").alias("words")))

    found = places(F.col("text"), r"(?<![\p{L}\p{N}#'])the(?![\p{L}\p{N}#'])", "(?U)")
    rows = t.select("conv_id", "turn", F.explode(let(tokens(F.col("text")), lambda i: let(found, lambda f: near(i, f)))).alias("w"))
    return rows.select("conv_id", "turn", "w.start", "w.words")


def page_cuts(spark, d):
    """Texts cut into pages and joined again, with the number of pages."""
    from ..operators.scan import cut, pages

    t = _t(spark, d, "documents").select("doc_id", "text", pages(F.col("text")).alias("p"))
    return t.select("doc_id", F.size("p").alias("n_pages"), F.sha2(cut(F.col("p"), F.lit(1), F.length("text") - 1), 256).alias("inner_sha256"))


def json_numbers(spark, d):
    """Two-digit values found in the properties of events, whatever fields they have."""
    two = Recognizer("TwoDigits", "TWO_DIGITS", ((r"\b[0-9]{2}\b", 0.5),))
    return json_paths.json_findings(_t(spark, d, "events"), "props", ["event_id"], entities=["TWO_DIGITS"], ad_hoc=[two]).select("event_id", "path", "entity_type", "start", "end")


def json_masked(spark, d):
    """The properties of events with the value of `k` replaced by its length in a nested object of another shape for each type."""
    shaped = F.when(F.col("event_type") == "click", F.concat(F.lit('{"in": ['), F.col("props"), F.lit("]}"))).otherwise(F.col("props"))
    hide = lambda v: F.concat(F.lit("#"), F.length(v).cast("string"))
    return _t(spark, d, "events").select("event_id", json_paths.replaced(shaped, {"$.k": hide, "$.in[*].k": hide}).alias("props"))


def raised_by_others(spark, d):
    """Names in each document, raised where the recognizer's hook sees an e-mail address among all spans."""

    def hook(text, span, spans):
        return F.when(F.exists(spans, lambda o: o["entity_type"] == "EMAIL_ADDRESS"), 0.9).otherwise(span["score"])

    names = Recognizer("Names", "NAME", (("[A-Z][a-z]+", 0.3),), gate="[A-Z]", enhance=hook)
    found = analyze(F.col("text"), entities=["NAME", "EMAIL_ADDRESS"], ad_hoc=[names], flags="(?U)")
    return _t(spark, d, "documents").select("doc_id", F.filter(found, lambda s: s["entity_type"] == "NAME").alias("s")).select("doc_id", F.size("s").cast("long").alias("n"), F.size(F.filter("s", lambda s: s["score"] > 0.8)).cast("long").alias("n_raised"))


QUERIES = {f.__name__: f for f in (raised_by_others, json_numbers, json_masked, term_table_counts, pair_table_counts, provider_findings, session_names, session_restored, words_around, page_cuts)}
_START = "coalesce(list_sum(list_transform(g[1:k], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(h[1:k-1], lambda x: length(x))), 0)"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
ORACLES = {
    "raised_by_others": f"SELECT doc_id, n, CASE WHEN mail THEN n ELSE 0 END AS n_raised FROM (SELECT doc_id, CAST(len(regexp_extract_all(text, '[A-Z][a-z]+')) AS BIGINT) AS n, regexp_matches(text, '{EMAIL}') AS mail FROM documents)",
    "json_numbers": """SELECT event_id, '$.k' AS path, 'TWO_DIGITS' AS entity_type, 0 AS start, 2 AS "end" FROM events WHERE length(json_extract_string(props, '$.k')) = 2""",
    "json_masked": """
        SELECT event_id, CASE WHEN event_type = 'click' THEN '{"in":[' || p || ']}' ELSE p END AS props
        FROM (SELECT event_id, event_type, '{"k":"#' || length(json_extract_string(props, '$.k')) || '"}' AS p FROM events)""",
    "term_table_counts": rf"""
        WITH t AS (SELECT DISTINCT lower(w) AS term FROM (SELECT unnest(regexp_extract_all(text, '{WORD}')) AS w FROM benchmark) WHERE length(w) >= 5),
        d AS (SELECT doc_id, lower(unnest(regexp_extract_all(text, '{WORD}'))) AS term FROM documents)
        SELECT doc_id, count(*) AS n FROM d JOIN t USING (term) GROUP BY doc_id""",
    "pair_table_counts": rf"""
        WITH b AS (SELECT regexp_extract_all(text, '{WORD}') AS h, regexp_split_to_array(text, '{WORD}') AS g FROM benchmark),
        t AS (SELECT DISTINCT lower(h[k] || ' ' || h[k + 1]) AS term FROM b, unnest(range(1, len(h))) u(k) WHERE g[k + 1] = ' '),
        w AS (SELECT doc_id, regexp_extract_all(text, '{WORD}') AS h, regexp_split_to_array(text, '{WORD}') AS g FROM documents),
        d AS (SELECT doc_id, lower(h[k] || ' ' || h[k + 1]) AS term FROM w, unnest(range(1, len(h))) u(k) WHERE g[k + 1] = ' ')
        SELECT doc_id, count(*) AS n FROM d JOIN t USING (term) GROUP BY doc_id""",
    "provider_findings": """
        SELECT doc_id, CASE WHEN contains(text, 'zz') THEN 0 ELSE len(h) END AS n, CAST(CASE WHEN contains(text, 'zz') THEN 0 ELSE coalesce(list_sum(list_transform(h, lambda x: length(x))), 0) END AS BIGINT) AS size, contains(text, 'zz') AS failed
        FROM (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Z]{2,}') AS h FROM documents)""",
    "session_names": f"""
        WITH w AS (SELECT conv_id, turn, regexp_extract_all(text, '[A-Z][a-z]+') AS h, regexp_split_to_array(text, '[A-Z][a-z]+') AS g FROM conversations),
        f AS (SELECT conv_id, turn, h[k] AS found, {_START} AS start FROM w, unnest(range(1, len(h) + 1)) u(k)),
        r AS (SELECT conv_id, found, row_number() OVER (PARTITION BY conv_id ORDER BY min(struct_pack(turn := turn, start := start)), found) - 1 AS n FROM f GROUP BY conv_id, found)
        SELECT conv_id, turn, CAST(start AS INTEGER) AS start, found, CAST(n AS INTEGER) AS n FROM f JOIN r USING (conv_id, found)""",
    "session_restored": """
        WITH w AS (SELECT conv_id, turn, text, regexp_extract_all(text, '[A-Z][a-z]+') AS h FROM conversations),
        f AS (SELECT conv_id, turn, k, h[k] AS found FROM w, unnest(range(1, len(h) + 1)) u(k)),
        r AS (SELECT conv_id, found, row_number() OVER (PARTITION BY conv_id ORDER BY min(struct_pack(turn := turn, k := k)), found) - 1 AS n FROM f GROUP BY conv_id, found),
        g AS (SELECT conv_id, turn, sum(length('<NAME_' || n || '>') - length(found)) AS gained FROM f JOIN r USING (conv_id, found) GROUP BY conv_id, turn)
        SELECT conv_id, turn, CAST(length(text) + coalesce(gained, 0) AS INTEGER) AS n_hidden, text FROM w LEFT JOIN g USING (conv_id, turn)""",
    "words_around": rf"""
        WITH w AS (SELECT conv_id, turn, regexp_extract_all(text, '[\p{{L}}\p{{N}}#'']+') AS h, regexp_split_to_array(text, '[\p{{L}}\p{{N}}#'']+') AS g FROM conversations)
        SELECT conv_id, turn, CAST({_START} AS INTEGER) AS start, lower(array_to_string(h[greatest(k - 2, 1):k - 1] || h[k + 1:k + 1], ' ')) AS words FROM w, unnest(range(1, len(h) + 1)) u(k) WHERE h[k] = 'the'""",
    "page_cuts": f"SELECT doc_id, CAST(greatest(ceil(length(text) / {PAGE}.0), 1) AS INTEGER) AS n_pages, sha256(text[2:length(text) - 1]) AS inner_sha256 FROM documents",
}
