"""Readers and writers."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str, encoding: str = "UTF-8", **options) -> DataFrame:
    return spark.read.options(header=True, encoding=encoding, **options).csv(path)


def read_json(spark: SparkSession, path: str, encoding: str = "UTF-8", **options) -> DataFrame:
    """Whole-file JSON, one document or a list of documents a file."""
    return spark.read.options(multiLine=True, encoding=encoding, **options).json(path)


def wildcard(pattern: str) -> str:
    """The regular expression of a path pattern as version control's ignore files have it: * within a folder's names, **
    across folders, ? one character, a slash in front or within ties it to the top, one at the end means what lies in a folder."""
    folder, body = pattern.endswith("/"), pattern.strip("/")
    top = "/" in body or pattern.startswith("/")
    parts = re.split(r"(\*\*/|/\*\*|\*|\?|\[[^]]*\])", body)
    forms = {"**/": "(?:.*/)?", "/**": "(?:/.*)?", "*": "[^/]*", "?": "[^/]"}
    made = "".join(forms.get(p) or (p if p[:1] == "[" and p[-1:] == "]" else re.escape(p)) for p in parts if p)
    return ("^" if top else "^(?:.*/)?") + made + ("/.*$" if folder else "(?:/.*)?$")


def ignored(path: Column, patterns: list[str]) -> Column:
    """Whether a relative path is ignored: the last pattern that fits decides, and one after ! takes back."""
    out = F.lit(False)
    for p in patterns:
        out = F.when(F.rlike(path, F.lit(wildcard(p.removeprefix("!")))), not p.startswith("!")).otherwise(out)
    return out


def read_lines(spark: SparkSession, path: str, glob: str | None = None, ignore: list[str] = ()) -> DataFrame:
    """path, line_no (from 1), line of text files under path; carriage returns before a line's end are cut. ignore: see ignored()."""
    options = {"recursiveFileLookup": True} | ({"pathGlobFilter": glob} if glob else {})
    files = spark.read.options(**options).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    if ignore:
        base = re.sub("^[a-z]+:/*", "/", path).rstrip("/") + "/"
        files = files.where(~ignored(F.regexp_replace("path", "^[a-z]+:/*" + re.escape(base.lstrip("/")), ""), list(ignore)))
    return files.select("path", F.posexplode(F.split("value", "\r?\n")).alias("n", "line")).select("path", (F.col("n") + 1).alias("line_no"), "line")


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """path, text of the files under path that are text: UTF-8 without control bytes in the first 1024."""
    files = spark.read.option("recursiveFileLookup", True).format("binaryFile").load(path).select("path", "content")
    head = F.decode(F.substring("content", 1, 1024), "ISO-8859-1")
    return files.where(F.is_valid_utf8(F.col("content").cast("string")) & ~head.rlike(r"[\x00-\x08\x0e-\x1a\x1c-\x1f]")).select("path", F.decode("content", "UTF-8").alias("text"))


def to_json(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.to_json(F.col(column)))


def report(findings: DataFrame, style: str = "parsable") -> DataFrame:
    """One line for each finding (path, line_no, start, entity_type, score, found)."""
    level = F.when(F.col("score") >= 1.0, "error").otherwise("warning")
    formats = {
        "parsable": F.format_string("%s:%d:%d: [%s] %s (%.2f)", "path", "line_no", F.col("start") + 1, level, "entity_type", "score"),
        "standard": F.format_string("  %d:%d  %s  %s  (%.2f)", "line_no", F.col("start") + 1, level, "entity_type", "score"),
        "github": F.format_string("::%s file=%s,line=%d,col=%d::%d:%d [%s] %.2f", level, "path", "line_no", F.col("start") + 1, "line_no", F.col("start") + 1, "entity_type", "score"),
    }
    return findings.select(formats[style].alias("line"))


def problems(findings: DataFrame) -> DataFrame:
    """path, n: findings of each file; a run without any row has exit status 0, else 1."""
    return findings.groupBy("path").agg(F.count(F.lit(1)).alias("n"))
