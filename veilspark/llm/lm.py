"""Scoring by an interpolated modified Kneser-Ney model.

The model has order 2 or 3, with begin and end of text. Counting runs in Spark: tasks count what they read,
pack the distinct keys of each hash bucket into one sorted array, and only those arrays are shuffled; a bucket's
task merges its arrays and stores them, sorted, as files in the shared folder. Buckets are cut by hash, so no
frequent word makes one heavy, and their number follows the input. Workers map the files into memory and look
keys up by binary search; the driver holds sizes and counts of counts alone.

Passes over the texts: word counts (their order gives each word its number), bigram counts (their order gives
each bigram its place), trigram counts, scores. A trigram's key joins the places of its two bigrams, so that it
leads to the bigram before its last word and to that after its first. At order 3 a bigram counts as often as
different words precede it; one at the begin of a text, which nothing precedes, as often as it occurs, and a
text's first token is scored by bigrams.
"""

from __future__ import annotations

import mmap
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_table, filesystem, give_back, map_arrow, new_dir, settle
from .hashing import Prefixes, mixed, random_bases

#: Bytes of text to a bucket; rows, and words, bigrams or trigrams, that a worker handles at once; bytes that it hashes at once.
BUCKET_BYTES, ROWS, HELD, PIECE = 64_000_000, 1000, 1_000_000, 1 << 18
#: Bigrams for which one sum of followers is kept.
BLOCK = 16
#: Keys in a packed row: rows stay under half a megabyte, which the JVM's collector moves easily.
PACKED = 40_000
#: Smaller files are read and not mapped, as a process can hold some 65,000 maps.
SMALL = 1 << 16
UNKNOWN = np.int64(-1)
#: Stands for a key with an unknown part; numbers stay below 2 ** 32 - 1, so no key equals it.
NO_KEY = np.uint64((1 << 64) - 1)


#: Which bytes are blank, and bytes with A-Z lower-cased.
BLANK = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
#: Hash of a text's last token, which no word has: words' hashes come from numbers below 2 ** 62.
END = mixed(np.array([1 << 63], np.uint64))[0]


def tokens(texts: pa.Array, bases: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each token: the words `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased and an end for each text; where each text begins).

    Words are found and hashed from the column's bytes, PIECE of them at a time.
    """
    texts = texts.cast(pa.string()).fill_null("")
    ends_at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends_at[0] : ends_at[-1]]
    ends_at = ends_at - ends_at[0]
    first, last = np.ones(len(data), bool), np.ones(len(data), bool)  # after a blank or at a text's begin, before a blank or at a text's end
    word = ~BLANK[data]
    first[1:], last[:-1] = ~word[:-1], ~word[1:]
    inner = ends_at[(ends_at > 0) & (ends_at < len(data))]
    first[inner] = last[inner - 1] = True
    starts, ends = np.flatnonzero(word & first), np.flatnonzero(word & last) + 1
    h, i = np.empty(len(starts), np.uint64), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + PIECE, "right")))
        part = LOWER[data[starts[i] : ends[j - 1]]]
        a, b = starts[i:j] - starts[i], ends[i:j] - starts[i]
        one, two = (Prefixes(part, base).of(a, b) for base in bases)
        h[i:j] = mixed((one << np.uint64(31)) | two)
        i = j
    of = np.searchsorted(ends_at[1:], starts, "right")  # the text of each word
    n = np.bincount(of, minlength=len(texts)) + 1
    out = np.full(len(starts) + len(texts), END)
    out[np.arange(len(starts)) + of] = h
    return out, np.cumsum(n) - n


def pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys as differences, and counts, byte plane by byte plane: most planes are zero, which the shuffle's codec removes."""
    gaps = np.diff(keys, prepend=np.uint64(0))
    return gaps.view(np.uint8).reshape(-1, 8).T.tobytes() + counts.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes()


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(data) // 12
    planes = np.frombuffer(data, np.uint8)
    gaps = np.ascontiguousarray(planes[: 8 * n].reshape(8, n).T).view(np.uint64).ravel()
    return np.cumsum(gaps, dtype=np.uint64), np.ascontiguousarray(planes[8 * n :].reshape(4, n).T).view(np.uint32).ravel()


def merged(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """(keys, columns...) of all parts with equal keys' columns added."""
    keys = np.concatenate([p[0] for p in parts])
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    sums = [np.add.reduceat(np.concatenate([p[k] for p in parts])[order].astype(np.int64), starts) if len(keys) else np.zeros(0, np.int64) for k in range(1, len(parts[0]))]
    return (keys[starts], *sums)


def mix(keys: np.ndarray) -> np.ndarray:
    h = (keys ^ (keys >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(32))


def save(folder: str, name: str, *arrays: np.ndarray) -> None:
    """Each array as a file of its own; written beside and renamed, so that a task that runs again does no harm."""
    store, root = filesystem(folder)
    store.create_dir(root, recursive=True)
    for k, a in enumerate(arrays):
        tag = uuid.uuid4().hex
        with store.open_output_stream(f"{root}/{name}.{k}.{tag}", compression=None) as f:
            f.write(a.tobytes())
        store.move(f"{root}/{name}.{k}.{tag}", f"{root}/{name}.{k}")


def load(folder: str, name: str, k: int, kind) -> np.ndarray:
    """The file as an array mapped into memory; a store that the system can't map is copied to a local file without a name first."""
    store, root = filesystem(folder)
    path = f"{root}/{name}.{k}"
    if store.type_name == "local":
        with open(path, "rb") as f:
            if f.seek(0, 2) < SMALL:
                f.seek(0)
                return np.frombuffer(f.read(), kind)
            return np.frombuffer(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, trackfd=False), kind)
    with tempfile.TemporaryFile() as f, store.open_input_stream(path, compression=None) as source:
        while part := source.read(1 << 24):
            f.write(part)
        f.flush()
        return np.frombuffer(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, trackfd=False), kind) if f.tell() else np.zeros(0, kind)


def narrow(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts in a byte each; where they are 255 or more, their places and values beside."""
    big = np.flatnonzero(counts > 254)
    return np.minimum(counts, 255).astype(np.uint8), big.astype(np.int64), counts[big].astype(np.uint32)


def records(columns: list[np.ndarray]) -> list[np.ndarray]:
    """Columns of counts as one array with a byte for each, side by side, then places and values of what is 255 or more in each."""
    each = [narrow(c) for c in columns]
    return [np.stack([x[0] for x in each], axis=1), *[y for x in each for y in x[1:]]]


@dataclass
class Grams:
    """Keys in buckets, sorted in each, with narrow columns; a key's place counts through the buckets.

    Buckets are cut by the keys' hash or, where `lowest` is given, by their upper 32 bits; then only the lower halves of keys
    are stored, and the records of the upper half's context say how many there are.
    """

    folder: str
    name: str
    sizes: list[int]  # keys in each bucket
    lowest: np.ndarray | None = None  # of each bucket, and one more that ends the last

    def __post_init__(self):
        self.begin = np.cumsum([0, *self.sizes])
        self.arrays: dict[tuple, np.ndarray] = {}

    def __getstate__(self):
        return {"folder": self.folder, "name": self.name, "sizes": self.sizes, "lowest": self.lowest}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.__post_init__()

    def array(self, name: str, bucket: int, k: int, kind) -> np.ndarray:
        if (name, bucket, k) not in self.arrays:
            self.arrays[name, bucket, k] = load(self.folder, f"{name}-{bucket}", k, kind)
        return self.arrays[name, bucket, k]

    def places(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key (keys in order), UNKNOWN where absent."""
        out = np.full(len(keys), UNKNOWN)
        if self.lowest is not None:
            cuts = np.searchsorted(keys, self.lowest.astype(np.uint64) << np.uint64(32))
            for b in np.flatnonzero(np.diff(cuts)).tolist():
                if self.sizes[b]:
                    upper, lower = halves(keys[cuts[b] : cuts[b + 1]])
                    out[cuts[b] : cuts[b + 1]] = within(*self.ranges(b, upper - self.lowest[b]), self.array(self.name, b, 0, np.uint32), lower, self.begin[b])
            return out
        for b, at in split(hashed(keys, len(self.sizes))):
            if self.sizes[b]:
                out[at] = found(self.array(self.name, b, 0, np.uint64), keys[at], self.begin[b])
        return out

    def column(self, places: np.ndarray) -> np.ndarray:
        """Counts at the places; 0 where UNKNOWN."""
        out = np.zeros(len(places), np.int64)
        for b, at in self.where(places):
            row = places[at] - self.begin[b]
            value = self.array(self.name, b, 1, np.uint8)[row].astype(np.int64)
            big = np.flatnonzero(value == 255)
            if len(big):
                value[big] = self.array(self.name, b, 3, np.uint32)[np.searchsorted(self.array(self.name, b, 2, np.int64), row[big])]
            out[at] = value
        return out

    def ranges(self, bucket: int, upper: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(Begin, end) of the keys of each upper half in the bucket, from the followers that its context has once, twice, more often.

        Sums up to every BLOCK-th upper half are made once and kept; from there on the few that remain are added.
        """
        held = self.array("context", bucket, 0, np.uint8)
        if ("begins", bucket, 0) not in self.arrays:
            big = np.concatenate([self.array("context", bucket, 1 + 2 * k, np.int64) for k in range(3)])
            more = np.concatenate([self.array("context", bucket, 2 + 2 * k, np.uint32).astype(np.int64) - 255 for k in range(3)])
            order = np.argsort(big, kind="stable")
            starts = np.arange(0, len(held), 3 * BLOCK)
            sums = np.add.reduceat(held, starts, dtype=np.int64) if len(held) else np.zeros(0, np.int64)
            self.arrays["begins", bucket, 0] = np.concatenate([[0], np.cumsum(sums)[:-1]])
            self.arrays["begins", bucket, 1] = big[order]
            self.arrays["begins", bucket, 2] = np.concatenate([[0], np.cumsum(more[order])])
        sums, big, more = (self.arrays["begins", bucket, k] for k in range(3))
        block = upper // BLOCK
        at = 3 * BLOCK * block[:, None] + np.arange(3 * BLOCK)
        near = np.where(at < 3 * upper[:, None], held[np.minimum(at, len(held) - 1)], 0).sum(axis=1, dtype=np.int64)
        begin = sums[block] + near + more[np.searchsorted(big, upper)]
        own = held.reshape(-1, 3)[upper].sum(axis=1, dtype=np.int64)
        return begin, begin + own + more[np.searchsorted(big, upper, "right")] - more[np.searchsorted(big, upper)]

    def records(self, places: np.ndarray, name: str, width: int) -> np.ndarray:
        """The records() of that name at the places, a column for each; 0 where UNKNOWN.

        Places are those of keys, or, where buckets are cut by the upper bits, these bits.
        """
        out, begin = np.zeros((len(places), width), np.int64), self.begin if self.lowest is None else self.lowest
        for b, at in split(np.searchsorted(begin, places, "right") - 1):
            if b < 0 or not self.sizes[b]:
                continue
            row = places[at] - begin[b]
            value = self.array(name, b, 0, np.uint8).reshape(-1, width)[row].astype(np.int64)
            for k in range(width):
                big = np.flatnonzero(value[:, k] == 255)
                if len(big):
                    value[big, k] = self.array(name, b, 2 + 2 * k, np.uint32)[np.searchsorted(self.array(name, b, 1 + 2 * k, np.int64), row[big])]
            out[at] = value
        return out.T

    def where(self, places: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """Each bucket with the places that lie in it, in order."""
        return [(b, at) for b, at in split(np.searchsorted(self.begin, places, "right") - 1) if b >= 0]


@dataclass
class Vocabulary:
    """Words in the order of their hashes, in buckets by the hash's highest bits; a word's number is its place."""

    folder: str
    sizes: list[int]  # words in each bucket
    tokens: int  # N
    bases: tuple[int, int]  # of the hashes

    def __post_init__(self):
        self.begin = np.cumsum([0, *self.sizes])
        self.arrays: dict[tuple[int, int], np.ndarray] = {}

    def __getstate__(self):
        return {"folder": self.folder, "sizes": self.sizes, "tokens": self.tokens, "bases": self.bases}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.__post_init__()

    def __len__(self) -> int:
        return int(self.begin[-1])

    def array(self, bucket: int, k: int, kind) -> np.ndarray:
        if (bucket, k) not in self.arrays:
            self.arrays[bucket, k] = load(self.folder, f"words-{bucket}", k, kind)
        return self.arrays[bucket, k]

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each token, UNKNOWN where the vocabulary has it not."""
        h, at = np.unique(hashes, return_inverse=True)
        out, bucket = np.full(len(h), UNKNOWN), bucket_of(h, len(self.sizes))
        cuts = np.flatnonzero(np.diff(bucket, prepend=-1)) if len(h) else []
        for i, j in zip(cuts, [*cuts[1:], len(h)], strict=True):
            b = int(bucket[i])
            out[i:j] = found(self.array(b, 0, np.uint64), h[i:j], self.begin[b])
        return out[at]

    def counts(self, numbers: np.ndarray) -> np.ndarray:
        out = np.zeros(len(numbers), np.int64)
        bucket = np.searchsorted(self.begin, numbers, "right") - 1
        for b in np.unique(bucket[numbers >= 0]):
            at = np.flatnonzero(bucket == b)
            out[at] = self.array(int(b), 1, np.uint32)[numbers[at] - self.begin[b]]
        return out


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of hashes by their highest 32 bits: buckets follow each other in the order of the hashes."""
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def hashed(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(keys) % np.uint64(buckets)).astype(np.int64)


def split(bucket: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Each bucket with the places where it stands, in order."""
    if not len(bucket):
        return []
    order = np.argsort(bucket.astype(np.int16) if bucket.max() < 1 << 15 else bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    return [(int(bucket[at[0]]), at) for at in np.split(order, cuts)]


def found(keys: np.ndarray, wanted: np.ndarray, begin: int = 0) -> np.ndarray:
    """Places of wanted in the sorted keys, plus begin; UNKNOWN where absent."""
    if not len(keys):
        return np.full(len(wanted), UNKNOWN)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at + begin, UNKNOWN)


def within(low: np.ndarray, end: np.ndarray, lower: np.ndarray, wanted: np.ndarray, begin: int = 0) -> np.ndarray:
    """Places of wanted among the numbers from low to end - 1, which are sorted, plus begin; UNKNOWN where absent."""
    low = low.copy()
    high, todo = end.copy(), np.flatnonzero(low < end)
    while len(todo):
        mid = (low[todo] + high[todo]) >> 1
        less = lower[mid] < wanted[todo]
        low[todo[less]] = mid[less] + 1
        high[todo[~less]] = mid[~less]
        todo = todo[low[todo] < high[todo]]
    hit = low < end
    hit[hit] = lower[low[hit]] == wanted[hit]
    return np.where(hit, low + begin, UNKNOWN)


def packed(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "data"])


def by_bucket(bucket: np.ndarray, *columns: np.ndarray) -> list[tuple[int, bytes]]:
    """Rows for each bucket with its keys (in order) and counts packed, PACKED at most in a row."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.append(True, np.diff(bucket[order]) != 0)) if len(order) else []
    pieces = [part[i : i + PACKED] for part in np.split(order, cuts[1:]) for i in range(0, len(part), PACKED)] if len(order) else []
    return [(int(bucket[part[0]]), pack(columns[0][part], columns[1][part])) for part in pieces]


def count_words(texts: DataFrame, buckets: int, folder: str) -> Vocabulary:
    bases = random_bases()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            h, n = merged(held)
            held.clear()
            return packed(by_bucket(bucket_of(h, buckets), h, n))

        for b in batches:
            for i in range(0, b.num_rows, ROWS):
                held.append(np.unique(tokens(b.column(0).slice(i, ROWS), bases)[0], return_counts=True))
                size += len(held[-1][0])
                if size > HELD:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    def reduce(key: tuple, group: pa.Table) -> pa.Table:
        keys, counts = merged([unpack(x) for x in group.column("data").to_pylist()])
        save(folder, f"words-{key[0].as_py()}", keys, counts.astype(np.uint32))
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "n": [len(keys)], "total": [int(counts.sum())]})

    parts = map_arrow(texts.select("text"), run, "bucket int, data binary")
    rows = parts.groupBy("bucket").applyInArrow(reduce, "bucket int, n long, total long").collect()  # a row for each BUCKET_BYTES of text
    sizes = {r.bucket: r.n for r in rows}
    for b in range(buckets):
        if b not in sizes:
            save(folder, f"words-{b}", np.zeros(0, np.uint64), np.zeros(0, np.uint32))
    return Vocabulary(folder, [sizes.get(b, 0) for b in range(buckets)], sum(r.total for r in rows), bases)


def events(vocabulary: Vocabulary, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the token before, number of the token, where each text begins); before the first token stands number V."""
    hashes, begin = tokens(texts, vocabulary.bases)
    now = vocabulary.numbers(hashes)
    before = np.empty_like(now)
    before[1:] = now[:-1]
    before[begin] = len(vocabulary)
    return before, now, begin


def joined(before: np.ndarray, now: np.ndarray) -> np.ndarray:
    return (before.astype(np.uint64) << np.uint64(32)) | now.astype(np.uint64)


STATISTICS = "kind string, part int, data binary"


def table_of(rows: list[tuple[str, int, bytes]]) -> pa.Table:
    return pa.table({"kind": pa.array([r[0] for r in rows], pa.string()), "part": pa.array([r[1] for r in rows], pa.int32()), "data": pa.array([r[2] for r in rows], pa.binary())})


def sizes_of(bucket: int, counts: np.ndarray) -> tuple[str, int, bytes]:
    """How many keys a bucket has, and how many of them occur once, twice, three and four times."""
    return ("of", bucket, np.array([len(counts), *((counts == k).sum() for k in (1, 2, 3, 4))], np.int64).tobytes())


def ranked(before: np.ndarray, after: np.ndarray, counts: np.ndarray, begin: np.ndarray, total: bool = False, kinds: tuple[str, ...] = ("one", "two", "more", "after")) -> list[tuple[str, int, bytes]]:
    """Statistics by number, packed by the ranges that begin holds: as context, followers seen once, twice, more often
    (and, with total, the sum of their counts); as what comes after, how many different ones precede."""
    rows, cuts = [], begin[1:-1]

    def add(kind: str, ids: np.ndarray, n: np.ndarray) -> None:
        rows.extend((kind, b, data) for b, data in by_bucket(np.searchsorted(cuts, ids, "right"), ids.astype(np.uint64), n))

    for kind, which, chosen in (("one", before, counts == 1), ("two", before, counts == 2), ("more", before, counts > 2), ("after", after, counts > 0)):
        if kind not in kinds:
            continue
        add(kind, *np.unique(which[chosen], return_counts=True))
    if total:
        ids, at = np.unique(before, return_inverse=True)
        add("total", ids, np.bincount(at, counts, len(ids)))
    return rows


def summed(group: pa.Table, kind: str, begin: int, n: int) -> np.ndarray:
    out = np.zeros(n, np.uint32)
    for k, data in zip(group.column("kind"), group.column("data"), strict=True):
        if k.as_py() == kind:
            ids, counts = unpack(data.as_py())
            out[ids.astype(np.int64) - begin] += counts.astype(np.uint32)
    return out


def sizes_in(stats: DataFrame, buckets: int, kind: str = "of") -> tuple[list[int], list[int]]:
    """(Keys in each bucket, how many keys occur once, twice, three and four times.)"""
    sizes, occur = [0] * buckets, np.zeros(4, np.int64)
    for r in stats.where(F.col("kind") == kind).select("part", "data").collect():  # a row for each bucket
        n, *of = np.frombuffer(r.data, np.int64)
        sizes[r.part] = int(n)
        occur += of
    return sizes, occur.tolist()


def count_grams(texts: DataFrame, name: str, bucket_of, folder: str, keys_of, statistics, form=lambda keys: keys) -> DataFrame:
    """Stores the keys that keys_of(texts) gives, as form(keys), and their counts, by bucket_of(keys), when the rows that it returns are read: those of statistics(bucket, keys, counts) and of sizes_of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            rows = by_bucket(bucket_of(keys), keys, n)
            del keys, n
            give_back()
            return packed(rows)

        for b in batches:
            for i in range(0, b.num_rows, ROWS):
                held.append(keys_of(b.column(0).slice(i, ROWS)))
                size += len(held[-1])
                if size > HELD:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    def reduce(key: tuple, group: pa.Table) -> pa.Table:
        keys, counts = merged([unpack(x) for x in group.column("data").to_pylist()])
        save(folder, f"{name}-{key[0].as_py()}", form(keys), *narrow(counts))
        rows = [sizes_of(key[0].as_py(), counts), *statistics(key[0].as_py(), keys, counts)]
        del keys, counts, group
        give_back()
        return table_of(rows)

    parts = map_arrow(texts.select("text"), run, "bucket int, data binary")
    return parts.groupBy("bucket").applyInArrow(reduce, STATISTICS)


def halves(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)


def count_bigrams(texts: DataFrame, vocabulary: Vocabulary, buckets: int, folder: str, order: int) -> tuple[Grams, list[int], DataFrame]:
    """Stores the bigrams; (they, how many occur once, twice, three and four times, parts of the statistics by word)."""
    if len(vocabulary) >= (1 << 32) - 1:
        raise ValueError("more words than 32 bits can number")
    statistics = lambda bucket, keys, counts: ranked(*halves(keys), counts, vocabulary.begin) if order == 2 else []
    stats = settle(count_grams(texts, "pairs", lambda keys: hashed(keys, buckets), folder, lambda rows: joined(*events(vocabulary, rows)[:2]), statistics), "lm-pairs")
    sizes, occur = sizes_in(stats, buckets)
    return Grams(folder, "pairs", sizes), occur, stats


def count_trigrams(texts: DataFrame, vocabulary: Vocabulary, pairs: Grams, buckets: int, folder: str) -> tuple[np.ndarray, DataFrame]:
    """Stores, when the rows that it returns are read, the trigrams and, by their first bigram, followers seen once, twice, more
    often; (the lowest place of a first bigram in each bucket, parts of the statistics by last bigram).

    Buckets are ranges of the first bigram's place, which hashes dealt out, so a bigram's followers lie in one bucket.
    """
    total = int(pairs.begin[-1])
    if total >= (1 << 32) - 1:
        raise ValueError("more bigrams than 32 bits can number")
    lowest = np.arange(buckets + 1) * total // buckets

    def keys_of(rows: pa.Array) -> np.ndarray:
        before, now, begin = events(vocabulary, rows)
        keys, at = np.unique(joined(before, now), return_inverse=True)
        place = pairs.places(keys)[at]
        return np.delete(joined(np.roll(place, 1), place), begin)

    def statistics(bucket: int, keys: np.ndarray, counts: np.ndarray) -> list[tuple[str, int, bytes]]:
        left, right = halves(keys)
        left -= lowest[bucket]
        n = int(lowest[bucket + 1] - lowest[bucket])
        save(folder, f"context-{bucket}", *records([np.bincount(left[chosen], minlength=n) for chosen in (counts == 1, counts == 2, counts > 2)]))
        return ranked(left, right, counts, pairs.begin, kinds=("after",))

    bucket_of = lambda keys: np.searchsorted(lowest, (keys >> np.uint64(32)).astype(np.int64), "right") - 1

    return lowest, count_grams(texts, "triples", bucket_of, folder, keys_of, statistics, lambda keys: halves(keys)[1].astype(np.uint32))


def bigram_statistics(stats: DataFrame, vocabulary: Vocabulary, pairs: Grams, folder: str) -> DataFrame:
    """Stores, by bigram, its count at order 3; parts of the statistics by word that come from it, sizes_of
    the counts at order 3, and sizes_of the trigrams under the kind 'triples'. Nothing of stats is kept: its tasks hand on
    to the shuffle what they count."""

    def reduce(key: tuple, group: pa.Table) -> pa.Table:
        b = key[0].as_py()
        if b < 0:
            return group.set_column(0, "kind", pa.array(["triples"] * len(group), pa.string())).select(["kind", "part", "data"])
        if not pairs.sizes[b]:
            return table_of([])
        n, begin = pairs.sizes[b], int(pairs.begin[b])
        before, now = halves(load(folder, f"pairs-{b}", 0, np.uint64))
        counts = summed(group, "after", begin, n).astype(np.int64)
        first = np.flatnonzero(before == len(vocabulary))
        counts[first] = pairs.column(first + begin)
        save(folder, f"after-{b}", *records([counts]))
        rows = [sizes_of(b, counts), *ranked(before, now, counts, vocabulary.begin, True)]
        del before, now, counts, group
        give_back()
        return table_of(rows)

    each = stats.sparkSession.range(len(pairs.sizes)).select(F.lit("none").alias("kind"), F.col("id").cast("int").alias("part"), F.lit(b"").alias("data"))
    parts = stats.unionByName(each).groupBy(F.when(F.col("kind") == "of", -1).otherwise(F.col("part")).alias("to"))
    return settle(parts.applyInArrow(reduce, STATISTICS), "lm-after")


def word_statistics(stats: DataFrame, vocabulary: Vocabulary, folder: str) -> tuple[list[int], int]:
    """Stores, by word number, followers seen once, twice, more often, predecessors, and at order 3 the sum of the bigrams'
    counts; (counts of counts, and sum, of the predecessors)."""

    def reduce(key: tuple, group: pa.Table) -> pa.Table:
        part = key[0].as_py()
        begin = int(vocabulary.begin[part])
        n = int(vocabulary.begin[part + 1]) - begin + (part == len(vocabulary.sizes) - 1)  # the last has the begin of text too
        out = [summed(group, kind, begin, n) for kind in ("one", "two", "more", "after", "total")]
        save(folder, f"stats-{part}", *out)
        return pa.table({"part": pa.array([part], pa.int32()), "of": pa.array([np.array([(out[3] == k).sum() for k in (1, 2, 3, 4)], np.int64).tobytes()]), "total": [int(out[3].sum())], "more": [int((out[3] > 2).sum())]})

    rows = stats.where("kind not in ('of', 'triples')").groupBy("part").applyInArrow(reduce, "part int, of binary, total long, more long").collect()  # a row for each bucket
    have = {r.part for r in rows}
    for b in range(len(vocabulary.sizes)):
        if b not in have:
            save(folder, f"stats-{b}", *[np.zeros(vocabulary.sizes[b] + (b == len(vocabulary.sizes) - 1), np.uint32)] * 5)
    of = sum((np.frombuffer(r.of, np.int64) for r in rows), np.zeros(4, np.int64))
    return [*of.tolist(), sum(r.more for r in rows)], sum(r.total for r in rows)


def discounts(of: list[int]) -> np.ndarray:
    """Discounts of counts 0, 1, 2 and more, from how many keys have the counts 1 to 4; usual values where too few have."""
    n1, n2, n3, n4 = (float(x) for x in of[:4])
    if min(n1, n2, n3, n4) <= 0:
        return np.array([0.0, 0.5, 1.0, 1.5])
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return np.array([0.0, *(min(k - 0.05, max(0.05, x)) for k, x in zip((1, 2, 3), d, strict=True))])


@dataclass
class Model:
    vocabulary: Vocabulary
    pairs: Grams
    triples: Grams | None  # at order 3
    of_triples: list[int]
    of_pairs: list[int]
    of_after: list[int]
    total_after: int

    def mapped(self) -> Model:
        self.stats: dict[tuple[int, int], np.ndarray] = {}
        self.d_triple, self.d_pair, self.d_word = discounts(self.of_triples), discounts(self.of_pairs), discounts(self.of_after)
        return self

    def statistic(self, k: int, numbers: np.ndarray) -> np.ndarray:
        """Statistic k (see word_statistics) by word number; 0 for unknown ones."""
        out, v = np.zeros(len(numbers), np.int64), self.vocabulary
        part = np.minimum(np.searchsorted(v.begin, numbers, "right") - 1, len(v.sizes) - 1)
        for b in np.unique(part[numbers >= 0]):
            if (int(b), k) not in self.stats:
                self.stats[int(b), k] = load(v.folder, f"stats-{b}", k, np.uint32)
            at = np.flatnonzero((part == b) & (numbers >= 0))
            out[at] = self.stats[int(b), k][numbers[at] - v.begin[b]]
        return out

    def log10(self, before: np.ndarray, now: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """log10 of the probability of each token after the one before it, or the two; begin: where each text begins."""
        v = len(self.vocabulary)
        words, word_at = np.unique(now, return_inverse=True)
        after = self.statistic(3, words)
        total = max(1, self.total_after)
        spare = (self.d_word[1] * self.of_after[0] + self.d_word[2] * self.of_after[1] + self.d_word[3] * self.of_after[4]) / total if self.total_after else 1.0
        lower = ((after - self.d_word[np.minimum(after, 3)]) / total + spare / (v + 1))[word_at]
        contexts, context_at = np.unique(before, return_inverse=True)
        seen = [self.statistic(k, contexts) for k in range(3)]
        mass = sum(self.d_pair[k + 1] * s for k, s in enumerate(seen))
        if self.triples:
            held = self.statistic(4, contexts)
        else:
            held = self.vocabulary.counts(np.where(contexts == v, UNKNOWN, contexts))
            if v in contexts:  # texts, so ends, are as many as begins
                held = np.where(contexts == v, self.vocabulary.counts(self.vocabulary.numbers(np.array([END])))[0], held)
        gamma = np.where(held > 0, mass / np.maximum(held, 1), 1.0)[context_at]
        held = np.maximum(held, 1)[context_at]
        keys, key_at = np.unique(np.where((before < 0) | (now < 0), NO_KEY, joined(before, now)), return_inverse=True)
        place = self.pairs.places(keys)
        if self.triples:
            n, occur = self.pairs.records(place, "after", 1)[0], self.pairs.column(place)
            seen = self.triples.records(place, "context", 3)
        else:
            n = self.pairs.column(place)
        n = n[key_at]
        lower = (n - self.d_pair[np.minimum(n, 3)]) / held + gamma * lower
        if not self.triples:
            return np.log10(lower)
        mass = sum(self.d_triple[k + 1] * x for k, x in enumerate(seen))
        context_at = np.roll(key_at, 1)  # a token's context is the bigram that ends before it; the first of a text has none
        held = occur[context_at]
        held[begin] = 0
        gamma = np.where(held > 0, mass[context_at] / np.maximum(held, 1), 1.0)
        left, right = place[context_at], place[key_at]
        keys, key_at = np.unique(np.where((held == 0) | (right < 0), NO_KEY, joined(left, right)), return_inverse=True)
        n = self.triples.column(self.triples.places(keys))[key_at]
        return np.log10((n - self.d_triple[np.minimum(n, 3)]) / np.maximum(held, 1) + gamma * lower)


def train(texts: DataFrame, order: int = 2) -> Model:
    """A model from all rows of texts (text)."""
    if order not in (2, 3):
        raise ValueError("order 2 or 3")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    folder, buckets = new_dir(texts.sparkSession, "lm"), max(1, -(-size // BUCKET_BYTES))
    vocabulary = count_words(texts, buckets, folder)
    if order == 2:
        pairs, of_pairs, stats = count_bigrams(texts, vocabulary, buckets, folder, order)
        return Model(vocabulary, pairs, None, [0] * 4, of_pairs, *word_statistics(stats, vocabulary, folder))
    pairs, _, stats = count_bigrams(texts, vocabulary, 4 * buckets, folder, order)
    drop_table(stats)
    lowest, by_pair = count_trigrams(texts, vocabulary, pairs, 8 * buckets, folder)
    by_word = bigram_statistics(by_pair, vocabulary, pairs, folder)
    sizes, of_triples = sizes_in(by_word, 8 * buckets, "triples")
    of_pairs = sizes_in(by_word, len(pairs.sizes))[1]
    out = Model(vocabulary, pairs, Grams(folder, "triples", sizes, lowest), of_triples, of_pairs, *word_statistics(by_word, vocabulary, folder))
    drop_table(by_word)
    return out


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score of each row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.mapped()
        v, n = len(m.vocabulary), m.vocabulary.tokens
        for b in batches:
            for i in range(0, b.num_rows, ROWS):
                part = b.slice(i, ROWS)
                before, now, begin = events(m.vocabulary, part.column(1))
                words, at = np.unique(now, return_inverse=True)
                c = m.vocabulary.counts(words)[at]
                base = np.log10((c + 0.5) / (n + 0.5 * (v + 1)))
                sums = [np.add.reduceat(x, begin) for x in (np.ones(len(now), np.int64), (c > 0).astype(np.int64), base, m.log10(before, now, begin))]
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, sums)], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, n_tokens long, n_known long, base_score double, score double")


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 1


def score_documents(docs: DataFrame, order: int = 2) -> DataFrame:
    """Per row of docs (doc_id, text, ...): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Null texts are empty: one token, the end. A null doc_id counts as the empty string for the fold. Rows that
    repeat count, and are scored, each. Without training texts every token has probability 1 and score 0. An
    empty table gives an empty result. Other columns are not looked at.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    model = train(rows.where(~held_out(F.col("doc_id"))).select("text"), order)
    return score(rows, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(model.vocabulary.tokens).cast("long").alias("train_tokens"), "base_score", "score")
