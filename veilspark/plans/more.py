"""Registered queries of windows, nested rows, outside findings and boxes, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import boxes, external, nested
from ..operators.chunked import analyze_chunks, token_chunks
from ..operators.scan import SPAN

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def chunked_email_counts(spark, d):
    t = _t(spark, d, "documents")
    return t.select("doc_id", F.size(analyze_chunks(F.col("text"), entities=["EMAIL_ADDRESS"])).cast("long").alias("n_email"))


def token_windows(spark, d):
    """Windows of 30 words, 10 in common."""
    t = _t(spark, d, "conversations")
    return t.select("conv_id", "turn", F.posexplode(token_chunks(F.col("text"), 30, 10, r"[^ \n]+")).alias("n", "w")).select("conv_id", "turn", "n", "w.start", "w.end")


def external_findings(spark, d):
    """Findings of another service, one for each event: labels by event type, without the ignored ones."""
    kind = F.col("event_type")
    span = F.struct(F.upper(kind).alias("entity_type"), F.when(F.col("user_id") % 7 != 0, 0).alias("start"), F.length(kind).alias("end"), (F.col("value") % 1).alias("score"), F.lit("outside").alias("recognizer"))
    t = _t(spark, d, "events").select("event_id", external.adopt(F.array(span).cast(SPAN), ["CLICK", "VIEW"], ["purchase"], 0.25).alias("s"))
    return t.select("event_id", F.explode("s").alias("s")).select("event_id", "s.entity_type", "s.original")


def nested_findings(spark, d):
    user = F.struct(F.concat(F.lit("u"), F.col("user_id"), F.lit("@example.com")).alias("mail"), F.array(F.col("event_type"), F.concat(F.lit("v"), F.col("event_id"), F.lit("@example.org"))).alias("tags"), F.concat(F.lit("x@example.com")).alias("hidden"))
    t = _t(spark, d, "events").select("event_id", user.alias("user"), F.col("event_type").alias("kind"))
    found = nested.field_findings(t, ["event_id"], skip=["user.hidden"], entities=["EMAIL_ADDRESS"])
    return found.where("size(spans) > 0").select("event_id", "path", F.coalesce("element", F.lit(-1)).alias("element"), F.col("spans")[0]["end"].alias("end"), F.col("spans")[0]["score"].alias("score"))


def nested_entities(spark, d):
    t = _t(spark, d, "customer").select("c_custkey", F.struct(F.struct(F.concat("c_name", F.lit("@example.com")).alias("mail")).alias("contact"), F.col("c_mktsegment").alias("segment"), F.lit("10.0.0.1").alias("host")).alias("body"))
    return nested.field_entities(t, ["c_custkey"], entities=["EMAIL_ADDRESS", "IP_ADDRESS"])


def entity_score_lists(spark, d):
    found = _t(spark, d, "events").select(F.upper("event_type").alias("entity_type"), (F.col("event_id") % 3 / 4).alias("score")).distinct()
    return nested.entity_scores(found).select("entity_type", F.array_join(F.col("scores").cast("array<string>"), " ").alias("scores"))


def box_matches(spark, d):
    """Line items as boxes, each order an image: the true boxes are those of odd lines, moved by up to 70."""
    t = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("image"), F.col("l_linenumber").alias("line"), (F.col("l_partkey") % 400).cast("int").alias("left"), (F.col("l_suppkey") % 300).cast("int").alias("top"), F.lit(40).alias("width"), F.lit(12).alias("height"))
    truth = t.where("line % 2 = 1").withColumn("left", F.col("left") + F.col("image").cast("int") % 71)
    return boxes.rates(t, truth).select("image", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


def box_words(spark, d):
    """Words of all turns, as if read from images, that the span of the first word covers."""
    t = _t(spark, d, "conversations").where("length(text) > 0")
    words = F.transform(F.split("text", " "), lambda w, i: F.struct(w.alias("text"), F.lit(90.0).alias("conf"), (i * 10).alias("left")))
    t = t.select("conv_id", "turn", boxes.read_words(words, 50).alias("words")).where("size(words) > 0").withColumn("joined", boxes.joined_words(F.col("words")))
    span = F.array(F.struct(F.lit("FIRST").alias("entity_type"), F.lit(0).alias("start"), F.length(F.col("words")[0]["text"]).alias("end"), F.lit(0.5).alias("score"), F.lit("r").alias("recognizer"))).cast(SPAN)
    found = boxes.covered_words(F.col("words"), F.col("joined.places"), F.col("joined.text"), span)
    return t.select("conv_id", "turn", F.explode(found).alias("f")).select("conv_id", "turn", "f.entity_type", F.col("f.word.text").alias("word"))


QUERIES = {f.__name__: f for f in (chunked_email_counts, token_windows, external_findings, nested_findings, nested_entities, entity_score_lists, box_matches, box_words)}
ORACLES = {
    "chunked_email_counts": f"SELECT doc_id, CAST(len(regexp_extract_all(text, '{EMAIL}')) AS BIGINT) AS n_email FROM documents",
    "token_windows": r"""
        WITH w AS (SELECT conv_id, turn, regexp_extract_all(text, '[^ \n]+') AS h, regexp_split_to_array(text, '[^ \n]+') AS g FROM conversations),
        p AS (SELECT conv_id, turn, len(h) AS m, list_transform(range(1, len(h) + 1), lambda k: list_sum(list_transform(g[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:k-1], lambda x: length(x))), 0)) AS s, h FROM w WHERE len(h) > 0)
        SELECT conv_id, turn, CAST(n AS INT) AS n, CAST(s[n * 20 + 1] AS INT) AS start, CAST(s[least(n * 20 + 30, m)] + length(h[least(n * 20 + 30, m)]) AS INT) AS "end"
        FROM p, unnest(range(0, CAST(greatest(ceil((m - 30) / 20.0), 0) AS BIGINT) + 1)) u(n)""",
    "external_findings": """SELECT event_id, CASE WHEN upper(event_type) IN ('CLICK', 'VIEW') THEN upper(event_type) ELSE 'GENERIC_PII_ENTITY' END AS entity_type,
        CASE WHEN upper(event_type) NOT IN ('CLICK', 'VIEW') THEN upper(event_type) END AS original
        FROM events WHERE user_id % 7 <> 0 AND lower(event_type) <> 'purchase' AND value % 1 >= 0.25""",
    "nested_findings": """SELECT event_id, 'user.mail' AS path, -1 AS element, CAST(length('u' || user_id || '@example.com') AS INT) AS "end", 1.0::DOUBLE AS score FROM events
        UNION ALL SELECT event_id, 'user.tags', 1, CAST(length('v' || event_id || '@example.org') AS INT), 1.0 FROM events""",
    "nested_entities": "SELECT c_custkey, 'body.contact.mail' AS path, 'EMAIL_ADDRESS' AS entity_type FROM customer UNION ALL SELECT c_custkey, 'body.host', 'IP_ADDRESS' FROM customer",
    "entity_score_lists": "SELECT entity_type, array_to_string(list_sort(list(CAST(score AS VARCHAR))), ' ') AS scores FROM (SELECT DISTINCT upper(event_type) AS entity_type, event_id % 3 / 4 AS score FROM events) GROUP BY 1",
    "box_matches": """
        WITH f AS (SELECT row_number() OVER () AS rn, l_orderkey AS image, l_linenumber AS line, l_partkey % 400 AS x, l_suppkey % 300 AS y FROM lineitem), t AS (SELECT rn, image, line, x + image % 71 AS x, y FROM f WHERE line % 2 = 1),
        m AS (SELECT f.image, count(DISTINCT f.rn) AS tf, count(DISTINCT t.rn) AS tt FROM f JOIN t ON f.image = t.image AND abs(f.x - t.x) <= 50 AND abs(f.y - t.y) <= 50 GROUP BY 1),
        n AS (SELECT image, count(*) AS n, count(*) FILTER (line % 2 = 1) AS m FROM f GROUP BY 1)
        SELECT n.image, round(coalesce(tf, 0) / n.n, 9) AS precision, round(CASE WHEN n.m > 0 THEN coalesce(tt, 0) / n.m ELSE 0 END, 9) AS recall FROM n LEFT JOIN m ON n.image = m.image""",
    "box_words": """SELECT conv_id, turn, 'FIRST' AS entity_type, list_filter(string_split(text, ' '), lambda w: trim(w) <> '')[1] AS word FROM conversations WHERE length(text) > 0 AND len(list_filter(string_split(text, ' '), lambda w: trim(w) <> '')) > 0""",
}
