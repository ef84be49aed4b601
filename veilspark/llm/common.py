"""What the operators share: tables in the shared folder, words as columns, access to shared files."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import shutil
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that end a word where a contract says `[^\x20\x09-\x0D]+`.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_own: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one only where the setting is absent (local runs)."""
    global _own
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _own is None:
        _own = tempfile.mkdtemp(prefix="veilspark-")
        atexit.register(shutil.rmtree, _own, ignore_errors=True)
    return f"file://{_own}"


def own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/veilspark/{spark.sparkContext.applicationId}"


def new_dir(spark: SparkSession, tag: str) -> str:
    return f"{own_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def clean(spark: SparkSession) -> None:
    """Deletes what this application's operators keep in the shared folder. Results are read from there: write them first."""
    delete(spark, own_dir(spark))


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """df written to the shared folder and read again: cuts lineage, and a lost executor costs no recomputation."""
    path = new_dir(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settle(df: DataFrame, tag: str) -> DataFrame:
    """materialize(), after which shuffle files that nothing refers to can go."""
    out = materialize(df, tag)
    for _ in range(2):  # what the first round frees holds what the second one does
        gc.collect()
        df.sparkSession.sparkContext._jvm.System.gc()
        time.sleep(0.2)  # Spark deletes the files of what is freed in a thread of its own
    return out


def drop_table(df: DataFrame) -> None:
    """Deletes the files of a materialized table that nothing reads any more."""
    spark = df.sparkSession
    for f in {x.rpartition("/")[0] for x in df.inputFiles()}:
        delete(spark, f)


#: Most rows and bytes in an Arrow batch that goes to a worker: memory is bounded however long the texts are.
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20


def give_back() -> None:
    """Returns the memory that a finished step freed to the system; a worker lives on, idle, beside others."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def bounded_threads(most: int = 2) -> None:
    """Limits the tokenizers library's threads in this process, each of which holds memory of its own; call before it is imported."""
    os.environ.setdefault("RAYON_NUM_THREADS", str(most))


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """df.mapInArrow(run, schema) with small batches; sets the session's limits for them, unless they are smaller already."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = df.sparkSession.conf.get(key).removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            df.sparkSession.conf.set(key, str(most))

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return df.mapInArrow(tidy, schema)


def slices(batch: pa.RecordBatch, column: int, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in parts with about `most` bytes of the text column, one row at least; a batch without rows as it is."""
    begin = held = 0
    for k, v in enumerate(batch.column(column)):
        size = v.as_buffer().size if v.is_valid else 0
        if held + size > most and k > begin:
            yield batch.slice(begin, k - begin)
            begin, held = k, 0
        held += size
    yield batch.slice(begin)


def filesystem(uri: str):
    """(pyarrow file system, path in it) of a folder in the shared store, for Python workers."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once per row, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; pure ASCII texts take the quicker built-in."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def blank_words(text: Column) -> Column:
    """Array of the words `[^\\x20\\x09-\\x0D]+`."""
    return F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")


def alnum_words(text: Column) -> Column:
    """Array of the words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lower-cased."""
    return F.array_remove(F.split(ascii_lower(text), "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"), "")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
