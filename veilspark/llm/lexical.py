"""Ranked search over bit-sliced Bloom signatures.

The index holds blocks of documents of like size. Of a block, a document is a column and a signature bit a row, a slice
over its documents. A term with frequency tf in a document sets bits for each level of LEVELS up to tf. The slices of a
term's bits at one level, met by and, overestimate which documents have it so often. For an item, the weights of its
terms summed over these slices, times what a level adds to a term's score in a document of known length, give an upper
bound of the document's score. The best bounds are scored exactly first; that gives each item the score that the last
of its list has at least. Every document whose bound reaches it is then scored exactly from its whole text.

No document is looked at twice but those; copies of a text give an item no more than as many as its list has places.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import delete, drop_table, map_arrow, materialize, new_dir, slices

#: Frequencies at which a term sets further bits; bits for each of these (term, level) entries of a document; bits that an entry sets.
LEVELS, BITS, PROBES = (1, 2, 3, 5, 9, 17), 16, 5
#: Cells (bits x documents) of a block, most documents in it, and hashed terms that a worker remembers.
CELLS, COLUMNS, KEEP = 1 << 22, 1024, 400_000
#: Characters of items that are looked for in one pass over the index, more only by what one item has.
PASS = 1 << 20
#: What a score has besides weights: 10 ** 9 * tf div (1000 * tf + 12 * m), m = 100 - B + B * n * N div L.
B, TENS = 25, 10**9
#: Bytes of a row group of the index, which a reading task holds at once.
GROUP = 16 << 20
# Bytes that end a term; A-Z become a-z, and bytes over 127 belong to terms.
_SPLIT = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))

INDEX = "ids array<{id}>, shas array<binary>, sizes array<bigint>, width int, slices binary, term binary, df bigint, n bigint, total bigint"


def terms(data: bytes) -> list[bytes]:
    """The terms of a text's UTF-8 bytes."""
    return data.translate(_SPLIT).split()


def spots(hashes: np.ndarray, level: int, width: int) -> np.ndarray:
    """The bits of hashed terms at a level, PROBES each, in signatures of `width` bits, a power of two."""
    with np.errstate(over="ignore"):
        x = (hashes + np.uint64(2 * level + 1) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        step = (x >> np.uint64(17)) * np.uint64(0x94D049BB133111EB) | np.uint64(1)
        return ((x[:, None] + np.arange(PROBES, dtype=np.uint64)[None, :] * step[:, None]) >> np.uint64(7)).astype(np.int64) & (width - 1)


def hashed(words: list[bytes], known: dict[bytes, int]) -> np.ndarray:
    out = np.empty(len(words), np.uint64)
    for k, w in enumerate(words):
        h = known.get(w)
        if h is None:
            if len(known) > KEEP:
                known.clear()
            h = known[w] = xxhash.xxh3_64_intdigest(w)
        out[k] = h
    return out


class Shelf:
    """Documents of like size that wait for their block."""

    def __init__(self, width: int):
        self.width, self.most = width, max(1, min(COLUMNS, CELLS // width))
        self.ids, self.shas, self.sizes, self.hashes, self.counts = [], [], [], [], []

    def block(self) -> dict:
        """The block as a row of the index; the shelf is empty then."""
        n = len(self.ids)
        bits = np.zeros((self.width, n), np.bool_)
        column = np.repeat(np.arange(n), [len(h) for h in self.hashes])
        hashes, counts = np.concatenate(self.hashes), np.concatenate(self.counts)
        for level, least in enumerate(LEVELS):
            there = counts >= least
            if there.any():
                bits[spots(hashes[there], level, self.width), column[there][:, None]] = True
        row = {"ids": self.ids, "shas": self.shas, "sizes": self.sizes, "width": self.width, "slices": np.packbits(bits, axis=1).tobytes()}
        self.ids, self.shas, self.sizes, self.hashes, self.counts = [], [], [], [], []
        return row


def index(docs: DataFrame) -> DataFrame:
    """The index of docs (doc_id, text): rows that are blocks, rows (term, df) of which each task gives a part, and rows (n, total),
    how many documents with a term and how many terms a task met. Documents without a term are in no block."""
    kind = INDEX.format(id=docs.schema["doc_id"].dataType.simpleString())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shelves: dict[int, Shelf] = {}
        known: dict[bytes, int] = {}
        df: Counter[bytes] = Counter()
        n = total = 0
        fields = None

        def rows(**columns) -> pa.RecordBatch:
            size = len(next(iter(columns.values())))
            return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in fields], schema=fields)

        def counted() -> pa.RecordBatch:
            row = rows(term=list(df), df=list(df.values()))
            df.clear()
            return row

        def blocks(row: dict) -> pa.RecordBatch:
            return rows(**{k: [v] for k, v in row.items()})

        for whole in batches:
            if fields is None:
                types = {"ids": pa.list_(whole.schema.field(0).type), "shas": pa.list_(pa.binary()), "sizes": pa.list_(pa.int64()), "width": pa.int32(), "slices": pa.binary(), "term": pa.binary(), "df": pa.int64(), "n": pa.int64(), "total": pa.int64()}
                fields = pa.schema(list(types.items()))
            for b in slices(whole, 1):
                for i, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    words = terms(data)
                    if not words:
                        continue
                    found = Counter(words)
                    n, total = n + 1, total + len(words)
                    df.update(found.keys())
                    counts = np.fromiter(found.values(), np.int64, len(found))
                    entries = int(sum((counts >= least).sum() for least in LEVELS))
                    width = 1 << max(6, (BITS * entries - 1).bit_length())
                    shelf = shelves.setdefault(width, Shelf(width))
                    shelf.ids.append(i)
                    shelf.shas.append(hashlib.sha256(data).digest())
                    shelf.sizes.append(len(words))
                    shelf.hashes.append(hashed(list(found), known))
                    shelf.counts.append(counts)
                    if len(shelf.ids) >= shelf.most:
                        yield blocks(shelf.block())
                    if len(df) > KEEP:
                        yield counted()
        for shelf in shelves.values():
            if shelf.ids:
                yield blocks(shelf.block())
        if n:
            yield counted()
            yield rows(n=[n], total=[total])

    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("_data"))
    return map_arrow(texts, run, kind)


@dataclass(frozen=True)
class Wanted:
    """Items of one pass: weights[k][t], w times occurrences of term t in item k; N and L of the corpus."""

    names: list[bytes]
    weights: list[dict[int, int]]
    n: int
    total: int

    def lengths(self, sizes: np.ndarray) -> np.ndarray:
        """m of documents with so many terms."""
        return 100 - B + (B * sizes * self.n) // self.total


def bounds(row: dict, wanted: Wanted, hashes: np.ndarray) -> np.ndarray:
    """Upper bounds of the scores of a block's documents, one line an item."""
    count, width = len(row["ids"]), row["width"]
    table = np.frombuffer(row["slices"], np.uint8).reshape(width, -1)
    m = wanted.lengths(np.array(row["sizes"], np.int64))
    best = np.zeros((len(wanted.weights), count), np.int64)
    alive, gained, held = np.arange(len(hashes)), np.zeros(count, np.int64), None
    for level in range(len(LEVELS)):
        met = np.bitwise_and.reduce(table[spots(hashes[alive], level, width)], axis=1)
        if held is not None:
            met &= held  # who has a term three times has it twice
        there = met.any(axis=1)
        alive, held = alive[there], met[there]
        if not len(alive):
            break
        # what a term can have added by the last frequency before the next level; beyond all levels a term gives less than 10 ** 6
        upto = LEVELS[level + 1] - 1 if level + 1 < len(LEVELS) else None
        gain = TENS * upto // (1000 * upto + 12 * m) if upto else np.full(count, TENS // 1000)
        bits = np.unpackbits(held, axis=1, count=count)
        place = {int(t): k for k, t in enumerate(alive)}
        more = gain - gained
        for k, weights in enumerate(wanted.weights):
            mine = [(place[t], w) for t, w in weights.items() if t in place]
            if mine:
                at, w = zip(*mine, strict=True)
                best[k] += (np.array(w, np.float64) @ bits[list(at)]).astype(np.int64) * more
        gained = gain
    return best


def exact(data: bytes, items: list[int], wanted: Wanted) -> list[int]:
    """The scores of a text for some items."""
    words = terms(data)
    found, m = Counter(words), 100 - B + (B * len(words) * wanted.n) // wanted.total if words else 0
    part: dict[int, int] = {}
    out = []
    for k in items:
        score = 0
        for t, w in wanted.weights[k].items():
            if t not in part:
                tf = found[wanted.names[t]]
                part[t] = TENS * tf // (1000 * tf + 12 * m) if tf else 0
            score += w * part[t]
        out.append(score)
    return out


def candidates(blocks: DataFrame, wanted, top: int, least: dict[int, int] | None) -> DataFrame:
    """item, doc_id, sha of the documents whose bound reaches the item's `least`; without these, of its `top` best bounds.

    Of equal texts only the `top` smallest doc_ids count, as all of them have the same score.
    """
    id_ = blocks.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        want = wanted.value
        hashes = hashed(want.names, {})
        heaps: list[list] = [[] for _ in want.weights]
        kind = None

        def out(rows: list[tuple]) -> pa.RecordBatch:
            item, bound, i, sha = zip(*rows, strict=True) if rows else ((), (), (), ())
            return pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(bound, pa.int64()), pa.array(i, kind), pa.array(sha, pa.binary())], ["item", "bound", "doc_id", "sha"])

        for batch in batches:
            kind = batch.schema.field(0).type.value_type
            for row in (r for k in range(len(batch)) for r in batch.slice(k, 1).to_pylist()):
                best, met = bounds(row, want, hashes), []
                for k in range(len(want.weights)):
                    line = best[k]
                    if least is not None:
                        if k in least:
                            met += [(k, int(line[d]), row["ids"][d], row["shas"][d]) for d in np.flatnonzero(line >= least[k])]
                        continue
                    heap = heaps[k]
                    floor = heap[0][0] if len(heap) >= top else 1
                    for d in np.flatnonzero(line >= floor):
                        entry = (int(line[d]), row["shas"][d], repr(row["ids"][d]), row["ids"][d])
                        if len(heap) < top:
                            heapq.heappush(heap, entry)
                        elif entry > heap[0]:
                            heapq.heapreplace(heap, entry)
                if met:
                    yield out(met)
        if least is None and kind is not None:
            yield out([(k, bound, i, sha) for k, heap in enumerate(heaps) for bound, sha, _, i in heap])

    found = map_arrow(blocks.select("ids", "shas", "sizes", "width", "slices"), run, f"item int, bound bigint, doc_id {id_}, sha binary")
    # of an item's best bounds any `top` will do; of a text's copies those that its list would name
    order = [F.desc("bound"), F.asc("sha")] if least is None else []
    keys = ["item"] if least is None else ["item", "sha"]
    return found.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order, F.asc_nulls_last("doc_id")))).where(F.col("_place") <= top).select("item", "doc_id", "sha")


def scored(docs: DataFrame, found: DataFrame, wanted) -> DataFrame:
    """item, doc_id, score of the documents that `found` (item, doc_id, sha) names."""
    asked = found.groupBy(F.col("doc_id").alias("_id"), F.col("sha").alias("_sha")).agg(F.collect_set("item").alias("items"))  # no more than the items of a pass
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("_data"))
    met = rows.join(asked, rows["doc_id"].eqNullSafe(asked["_id"]) & (F.unhex(F.sha2("_data", 256)) == asked["_sha"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        want = wanted.value
        for whole in batches:
            for b in slices(whole, 1):
                ids, item, score = [], [], []
                for i, data, items in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    ids += [i] * len(items)
                    item += items
                    score += exact(data, items, want)
                yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(ids, b.column(0).type), pa.array(score, pa.int64())], ["item", "doc_id", "score"])

    return map_arrow(met.select("doc_id", "_data", "items"), run, f"item int, doc_id {docs.schema['doc_id'].dataType.simpleString()}, score bigint")


def best(rows: DataFrame, top: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return rows.where("score > 0").withColumn("rank", place.cast("int")).where(F.col("rank") <= top)


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def search(docs: DataFrame, items: DataFrame, top: int = 20) -> DataFrame:
    """item_id, rank, doc_id, score: for each row of items (item_id, text) the `top` documents with the highest scores above 0.

    Equal scores rank by ascending doc_id, null last. Null texts and texts without a term have no terms and are on no
    list. Each row counts: of items that repeat each has its list, documents that repeat take a place each. Very long
    texts are treated whole; an empty table on either side gives an empty result. Other columns are not looked at.
    Tables that results are read from stay in the shared folder.
    """
    spark = docs.sparkSession
    path = new_dir(spark, "signatures")
    index(docs).write.option("parquet.block.size", GROUP).parquet(path)
    table = spark.read.schema(INDEX.format(id=docs.schema["doc_id"].dataType.simpleString())).parquet(path)
    n, total = table.where("n is not null").agg(F.sum("n"), F.sum("total")).first()
    shape = f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id {docs.schema['doc_id'].dataType.simpleString()}, score bigint"
    if not n:
        return spark.createDataFrame([], shape)
    blocks = table.where("slices is not null")
    asked = items.select("item_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    passes = max(1, -(-(asked.agg(F.sum(F.length("text"))).first()[0] or 0) // PASS))
    asked = materialize(asked.withColumn("part", F.pmod(F.xxhash64("text", F.col("item_id").cast("string")), F.lit(passes))), "items")
    lists = new_dir(spark, "lists")
    for part in range(passes):
        rows = [(r.item_id, Counter(terms(r.text.encode()))) for r in asked.where(F.col("part") == part).collect()]  # about PASS characters
        names = sorted({t for _, found in rows for t in found})
        if not names:
            continue
        held = spark.createDataFrame([(t,) for t in names], "term binary")
        df = {bytes(r.term): r.df for r in table.where("term is not null").join(F.broadcast(held), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df")).collect()}  # a row for each of names
        place = {t: k for k, t in enumerate(t for t in names if t in df)}
        wanted = spark.sparkContext.broadcast(Wanted(list(place), [{place[t]: weight(n, df[t]) * c for t, c in found.items() if t in place} for _, found in rows], n, total))
        first = materialize(candidates(blocks, wanted, top, None), "first")
        seen = best(scored(docs, first, wanted), top)
        least = {r.item: r.score if r.n >= top else 1 for r in seen.groupBy("item").agg(F.count("*").alias("n"), F.min("score").alias("score")).collect()}  # a row an item
        least = {k: least.get(k, 1) for k in range(len(rows))}
        found = materialize(candidates(blocks, wanted, top, least), "second")
        ids = spark.createDataFrame([(k, i) for k, (i, _) in enumerate(rows)], f"item int, item_id {items.schema['item_id'].dataType.simpleString()}")
        best(scored(docs, found, wanted), top).join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score").write.mode("append").parquet(lists)
        for done in (first, found):
            drop_table(done)
    delete(spark, path)
    spark.createDataFrame([], shape).write.mode("append").parquet(lists)
    return spark.read.schema(shape).parquet(lists)
