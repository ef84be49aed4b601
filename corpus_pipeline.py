"""A training corpus from raw documents: language, near-duplicates, repeated passages, benchmarks, token ids.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but the last return
the columns of documents. docs has doc_id, text and lang; further columns, whatever their names, are carried along.
An empty table gives an empty result in every stage, very long texts are treated whole, and rows that repeat an id
with another text are other documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm import decontam, langid, pieces, simhash, suffix
from veilspark.llm.common import drop_table, materialize, table

#: Documents whose language is less certain than this go.
CERTAIN = 0.5


def shielded(docs: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with names that no operator uses for its own columns, and what gives a result the columns of docs again."""
    names = docs.columns
    safe = [c.lower() if c.lower() in ("doc_id", "text", "lang", "n_chars") else f"column_{k}" for k, c in enumerate(names)]
    return docs.toDF(*safe), lambda out: out.select(*safe).toDF(*names)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a letter and a language of which the model is CERTAIN; learns from the labelled ones among docs.

    Null and empty texts have no letter and go. Without any label nothing can be learned; then documents with a
    letter stay. Rows that repeat are judged, and stay or go, alike. doc_id and the other columns may be null.
    """
    rows, restore = shielded(docs)
    model = langid.learn(rows)
    if model is None:
        return restore(rows.where(F.col("text").rlike("\\p{L}")))
    return restore(langid.predict(rows, model).where((F.col("lang_pred") != "und") & (F.col("score") >= CERTAIN)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near-duplicates (fingerprints of 4-word shingles within 4 bits, chained) one row.

    That is the row with the smallest doc_id, one without doc_id only if no other is there; of several with this id
    that with the smallest text hash; of equal ones any. Null and empty texts are one group.
    """
    rows, restore = shielded(docs)
    return restore(simhash.representatives(rows))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 200 bytes that also start elsewhere; documents of which nothing is left go.

    Every copy is cut, so rows that repeat a text of 200 bytes or more all go. Null, empty and shorter texts stay as
    they are. A character of which only some bytes are left goes whole. n_chars, where it is there, is counted again.
    """
    rows, restore = shielded(docs)
    others = [c for c in rows.columns if c != "text"]
    cut = suffix.dedup(rows, keep=[*others, "n_removed", "kept_text"]).where((F.col("n_removed") == 0) | (F.length("kept_text") > 0))
    cut = cut.withColumnRenamed("kept_text", "text")
    if "n_chars" in others:
        kind = rows.schema["n_chars"].dataType
        cut = cut.withColumn("n_chars", F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("text").cast(kind)))
    return restore(cut)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window (10 words, or a shorter item whole) go.

    Null and empty texts hold none and stay, whatever the items; without items all stay. Rows that repeat go or stay alike;
    of rows with one doc_id and different texts only those that hold a window go.
    """
    rows, restore = shielded(docs)
    th = F.xxhash64(F.coalesce("text", F.lit("")))
    key = F.struct(F.col("doc_id").alias("id"), th.alias("th"))
    bad = decontam.contaminated(rows.select(key.alias("doc_id"), "text"), table(spark, sf_dir, "benchmark")).where("n_hit > 0").select("doc_id.*").distinct()
    bad = materialize(bad, "pipeline-contaminated")  # Spark then knows its size, and broadcasts it if it is small
    return restore(rows.join(bad, rows["doc_id"].eqNullSafe(bad["id"]) & (th == bad["th"]), "left_anti"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their SentencePiece ids, the ids' digest, whether they decode to the text and whether the library agrees.

    Null texts are empty: no ids. Columns of docs that have the names of the new ones are left out.
    """
    return pieces.encode(docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontaminate", decontaminate),
    ("token_ids", token_ids),
]
#: Fingerprints by XXH64, components and trained models are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            drop_table(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
