"""Benchmark decontamination as a prefix-filtered set join.

A window of a benchmark item is a set of word shingles; a document holds the window only if it holds all of
them, so the overlap asked for equals the window's size and the prefix that must be joined is one shingle:
the rarest in one order of all shingles. A first pass over the documents counts how often they have each shingle
of the benchmark; the fewer, the rarer. Windows that overlap mostly share their prefix, so the index has fewer keys
than windows. Document shingles meet the index by hash; place and length bounds drop matches whose window
would begin before the text or end after it; what is left is compared word by word with the window. Hashes
only find candidates. Items join last, by the words of the windows found.

While the index has at most MAX_BROADCAST rows (counted first) it is broadcast, and shingling, join and
comparison are one pass over the documents that shuffles only what was found. Beyond that, document shingles
are shuffled by hash to meet it, which adaptive execution splits where a shingle is frequent, and the candidates
go back to their documents to be compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import alnum_words, drop_table, let, materialize

WINDOW, SHINGLE, MAX_BROADCAST = 10, 5, 200_000
#: The key that every document has once; it finds the index row without a window and so yields the document's word count.
COUNT_KEY = -1
SPANS = "array<struct<start:int,len:int>>"


def item_windows(items: DataFrame, width: int = WINDOW) -> DataFrame:
    """item_id, win (its words): each run of `width` consecutive words; a shorter item that has words is one window."""
    words = items.select("item_id", alnum_words(F.coalesce("text", F.lit(""))).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (width - 1), F.lit(1)))
    return words.select("item_id", "w", F.explode(starts).alias("at")).select("item_id", F.slice("w", F.col("at"), width).alias("win")).distinct()


def shingles(words: Column, width: int) -> Column:
    """Array with one hash for each word: of the `width` (1 to 5) words from there, or of what the end leaves of them."""
    if width not in range(1, SHINGLE + 1):
        raise ValueError(f"shingles have 1 to {SHINGLE} words")
    if width == 1:
        return F.transform(words, lambda a: F.xxhash64(a))

    def pair(a: Column, b: Column, step: int) -> Column:
        return F.zip_with(a, F.slice(b, step + 1, F.size(b)), lambda x, y: F.xxhash64(x, y))

    def wider(two: Column) -> Column:  # four words are two pairs; three or five end in a pair that overlaps
        if width == 3:
            return pair(two, two, 1)
        return pair(two, two, 2) if width == 4 else let(pair(two, two, 2), lambda four: pair(four, two, 3))

    return let(words, lambda w: pair(w, w, 1)) if width == 2 else let(words, lambda w: let(pair(w, w, 1), wider))


def windows_by_shingle(windows: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """win, width (words in its shingles), off and key of each shingle: windows shorter than a shingle are one of their own length."""
    width = F.least(F.size("win"), F.lit(shingle))
    keys = F.coalesce(*[F.when(width == k, shingles(F.col("win"), k)) for k in range(1, shingle + 1)])
    return windows.withColumn("width", width).select("win", "width", F.posexplode(keys).alias("off", "key")).where("off <= size(win) - width")


def index(keyed: DataFrame, in_documents: DataFrame) -> DataFrame:
    """One row per window: width, key (hash of its prefix shingle), off (the shingle's place in the window), win.

    The prefix is the shingle that the documents have least often (in_documents: key, n), then that which the fewest
    windows hold; ties go to the smaller hash, so every window that holds both prefers the same one.
    """
    rarity = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("held_by")).join(in_documents, "key", "left")
    best = Window.partitionBy("win").orderBy(F.coalesce("n", F.lit(0)), "held_by", "key", "off")  # a partition has one window's shingles
    ranked = keyed.join(rarity, "key").withColumn("rank", F.row_number().over(best))
    return ranked.where("rank = 1").select("width", "key", "off", "win")


def matches(docs: DataFrame, items: DataFrame, width: int = WINDOW) -> DataFrame:
    """Per row of docs (doc_id, text): rid (its number), doc_id, n_words, found (start and len of each occurring window), hit_items."""
    windows = materialize(item_windows(items.select("item_id", "text"), width), "decontam-windows")
    keyed = materialize(windows_by_shingle(windows.select("win").distinct()), "decontam-shingles")
    sizes = {r.width: r.n for r in keyed.groupBy("width").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most SHINGLE rows
    widths, small = sorted(sizes), sum(sizes.values()) <= MAX_BROADCAST
    own = F.array(F.lit(COUNT_KEY).cast("bigint"))
    source = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", alnum_words(F.coalesce("text", F.lit(""))).alias("w"))
    if not small:
        source = materialize(source, "decontam-words")  # read three times: rows keep their numbers
    # Never empty, so _outer adds no rows; without it Spark filters on the array first and makes it twice.
    shingled = source.select("rid", "doc_id", "w", F.size("w").alias("n"), let(F.col("w"), lambda w: F.concat(own, *[shingles(w, k) for k in widths])).alias("keys"))

    known = keyed.select("key").distinct()
    counted = shingled.select(F.explode_outer("keys").alias("key")).join(F.broadcast(known) if small else known, "key").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    prefix = materialize(index(keyed, counted), "decontam-index")
    none = prefix.sparkSession.range(1).select(F.lit(0).alias("width"), F.lit(COUNT_KEY).cast("bigint").alias("key"), F.lit(0).alias("off"), F.array().cast("array<string>").alias("win"))
    posts = prefix.unionByName(none).select("key", "off", "win")

    pos = F.when(F.col("p") == 0, 0).otherwise((F.col("p") - 1) % F.greatest(F.col("n"), F.lit(1)))
    if small:
        met = shingled.select("rid", "doc_id", "w", "n", F.posexplode_outer("keys").alias("p", "key")).join(F.broadcast(posts), "key")
        met = met.select("rid", "doc_id", "w", "n", pos.alias("pos"), "off", "win")
    else:
        far = shingled.select("rid", "n", F.posexplode_outer("keys").alias("p", "key")).where(F.col("key") != COUNT_KEY).join(posts, "key")
        once = source.select("rid", F.lit(0).alias("pos"), F.lit(0).alias("off"), F.array().cast("array<string>").alias("win"))
        met = source.withColumn("n", F.size("w")).join(far.select("rid", pos.alias("pos"), "off", "win").unionByName(once), "rid")
    start, length = F.col("pos") - F.col("off"), F.size("win")
    fits = (start >= 0) & (start + length <= F.col("n")) & (F.slice("w", start + 1, length) == F.col("win"))
    hit = F.when(length > 0, F.struct(start.alias("start"), length.alias("len")))
    held = materialize(met.where((length == 0) | fits).select("rid", "doc_id", "n", hit.alias("hit"), F.when(length > 0, F.col("win")).alias("win")), "decontam-hits")
    named = held.where("win is not null").select("rid", "win").distinct().join(windows, "win").groupBy("rid").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("hit_items"))
    found = held.groupBy("rid").agg(F.max("doc_id").alias("doc_id"), F.max("n").cast("long").alias("n_words"), F.collect_set("hit").alias("found"))
    for t in (keyed, prefix, *([] if small else [source])):
        drop_table(t)
    return found.join(named, "rid", "left").withColumn("hit_items", F.coalesce("hit_items", F.array().cast("array<string>")))


def union_length(spans: Column) -> Column:
    """Words in the union of spans sorted by start: what each adds beyond the furthest end so far."""
    begin = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))

    def add(a: Column, s: Column) -> Column:
        end = s["start"] + s["len"]
        return F.struct(F.greatest(a["end"], end).alias("end"), (a["n"] + F.greatest(F.lit(0), end - F.greatest(a["end"], s["start"]))).alias("n"))

    return F.aggregate(spans, begin, add, lambda a: a["n"].cast("long"))


def contaminated(docs: DataFrame, items: DataFrame, width: int = WINDOW) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit (words inside any occurring window), hit_items (ids of the items with
    occurring windows, as strings, distinct and sorted), spans (start and length of the occurring windows, in words).

    Null or empty texts have no words. Items without a word match nothing; items with one text each count.
    Rows that repeat are judged each on its own, whatever their doc_id, which may be null. Empty tables give no
    rows or no hits. Columns other than doc_id, item_id and text are not looked at.
    """
    found = matches(docs.select("doc_id", "text"), items, width)
    return found.select("doc_id", "n_words", F.array_sort("found").cast(SPANS).alias("spans"), "hit_items").select("doc_id", "n_words", union_length(F.col("spans")).alias("n_hit"), "hit_items", "spans")


def digest(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The contract's columns of contaminated()."""
    out = contaminated(docs, items)
    return out.select("doc_id", "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"), F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
