"""Removal of repeated passages by a sparse suffix sort that compares by hashes.

A byte goes if a string of `length` bytes that also starts elsewhere covers it. Sorting every suffix of the corpus
would move each byte many times over (a row of 16 bytes for each suffix is 16 times the text), so the suffixes
that are sorted are sampled, without losing any match: two equal strings of `length` bytes contain the same
anchor, the GRAM bytes whose prefix polynomial hash is the smallest of the string's (a window minimum).

1. Each document gives its anchors, about one for 60 bytes, and for each the run of starts that choose it. The bytes
   these starts reach are the anchor's block; a 128-bit BLAKE2b digest stands for them, so blocks of equal digests
   are equal. Anchors found once are done; blocks found twice or more go whole.
2. Where different blocks share an anchor (the ends of shared passages), one of each travels there with its bytes.
   Two mergesorts put the block's texts after the anchor, and those before it (backwards), in order. A comparison
   finds the common extension of two suffixes by binary search over prefix polynomial hashes, so it takes a
   logarithmic number of steps. Neighbours are then verified byte by byte: that they agree as far as their common
   extension says and are in order after it proves the whole order, collisions or not; else the bytes are sorted.
3. A string that begins i bytes before the anchor also starts elsewhere if another block shares i bytes before and
   `length` - i bytes after it: both orders, cut where the common extension is shorter, give classes of blocks,
   and two blocks in the same two classes share the string.
4. Where more than CROWD different blocks share an anchor, they are dealt out to parts instead. Each part gives the
   BLAKE2b digests of its strings, packed into one row for each bucket of digests; buckets answer which of them
   occur twice. Exact too, and no anchor is one task's work.
5. Runs are united for each document and its bytes cut.

Nothing gathers by key without a bound: a passage in a third of all documents is one pre-aggregated row for each
block; joins on anchors are plain sort-merge joins, whose heavy partitions adaptive execution splits.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import drop_table, map_arrow, settle, slices
from .hashing import Prefixes, mixed, random_bases

LENGTH, GRAM, PIECE, CROWD, BLOCKS, PART = 200, 64, 1 << 18, 512, 3000, 500
POS = np.uint64((1 << 20) - 1)
NO_ID = -(1 << 63)


def window_minima(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` neighbours, from running minima within blocks from both sides."""
    n = len(v) - width + 1
    padded = np.concatenate([v, np.full(-len(v) % width, ~np.uint64(0))]).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def pieces(rows: list[bytes], length: int) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, row, its first byte here, place of that byte in the row) of groups of short rows and parts of long ones.

    Parts of one row overlap by length - 1 bytes, so that each start lies in one of them.
    """
    held, at, size = [], [], 0

    def group():
        return b"".join(held), np.array([x[0] for x in at]), np.cumsum([0, *map(len, held)]), np.array([x[1] for x in at])

    for k, row in enumerate(rows):
        for i in range(0, max(1, len(row) - length + 1), PIECE):
            part = row[i : i + PIECE + length - 1]
            if len(part) < length:
                continue
            if size + len(part) > PIECE and held:
                yield group()
                held, at, size = [], [], 0
            held.append(part)
            at.append((k, i))
            size += len(part)
    if held:
        yield group()


def digest128(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


#: A block: starts first to first + n - 1 of the document choose the anchor, `lead` bytes after the first; d1, d2: its digest.
FOUND = [("first", pa.int32()), ("n", pa.int32()), ("lead", pa.int32()), ("anchor", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64())]


def anchors(rows: list[bytes], bases: tuple[int, int], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Arrays row and FOUND of the blocks in rows."""
    out = [[np.zeros(0, np.int64)] * 7]
    for joined, row, begin, place in pieces(rows, length):
        data = np.frombuffer(joined, np.uint8)
        h = Prefixes(data, bases[0]).of(np.arange(len(data) - gram + 1), np.arange(gram, len(data) + 1))
        chosen = window_minima((mixed(h) & ~POS) | np.arange(len(h), dtype=np.uint64), length - gram + 1) & POS
        part = np.repeat(np.arange(len(row)), np.diff(begin))
        starts = np.flatnonzero(begin[part + 1] - np.arange(len(data)) >= length)
        new = np.ones(len(starts), bool)
        new[1:] = (chosen[starts[1:]] != chosen[starts[:-1]]) | (part[starts[1:]] != part[starts[:-1]])
        first = starts[new]
        n = np.diff(np.append(np.flatnonzero(new), len(starts)))
        at, p = chosen[first].astype(np.int64), part[first]
        anchor = (h[at] << np.uint64(31)) | Prefixes(data, bases[1]).of(at, at + gram)
        digests = b"".join([digest128(joined[i:j]) for i, j in zip(first.tolist(), (first + n - 1 + length).tolist(), strict=True)])
        d = np.frombuffer(digests, np.int64).reshape(-1, 2)
        out.append([row[p], first - begin[p] + place[p], n, at - first, anchor.view(np.int64), d[:, 0], d[:, 1]])
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id and th (with it the key of a row's content) and text, null texts empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))


def repeated_runs(docs: DataFrame, length: int = LENGTH, crowd: int = CROWD) -> DataFrame:
    """doc_id, th, runs: array of (first, end), byte ranges to remove, of every text that has any."""
    source, bases = keyed(docs), random_bases()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 2):
                row, *cols = anchors([t.encode() for t in b.column(2).to_pylist()], bases, length)
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), *[pa.array(c.astype(k.to_pandas_dtype())) for c, (_, k) in zip(cols, FOUND, strict=True)]], ["doc_id", "th", *[x for x, _ in FOUND]])

    found = settle(map_arrow(source, find, "doc_id long, th long, first int, n int, lead int, anchor long, d1 long, d2 long"), "suffix-anchors")
    differ = (F.min("d1") != F.max("d1")) | (F.min("d2") != F.max("d2"))
    groups = settle(found.groupBy("anchor").agg(F.count(F.lit(1)).alias("c"), differ.alias("differ")).where("c > 1").select("anchor", "differ"), "suffix-groups")
    shared = settle(found.join(groups, "anchor"), "suffix-shared")
    drop_table(found)
    drop_table(groups)

    block = ["anchor", "d1", "d2"]
    counts = settle(shared.where("differ").groupBy(*block).agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("doc_id", "th", "first", "n", "lead")).alias("one")), "suffix-blocks")
    alike = shared.where("not differ").select("doc_id", "th", "first", "n")
    twice = shared.where("differ").join(counts.where("c > 1").select(*block), block).select("doc_id", "th", "first", "n")
    whole = alike.unionByName(twice).select("doc_id", "th", "first", (F.col("first") + F.col("n") - 1 + length).alias("end"))

    crowded = settle(counts.groupBy("anchor").agg(F.count(F.lit(1)).alias("blocks")).where(F.col("blocks") > crowd).select("anchor", F.lit(True).alias("hot")), "suffix-crowded")
    opened = counts.join(crowded, "anchor", "left").select("one.*", "anchor", F.col("hot").isNotNull().alias("hot"), (F.col("c") > 1).alias("done"))
    opened = settle(opened.withColumn("block_no", F.monotonically_increasing_id()), "suffix-opened")  # numbered once, as it is written
    wanted = opened.groupBy("doc_id", "th").agg(F.collect_list(F.struct("block_no", "anchor", "hot", "first", "n", "lead")).alias("blocks"))  # a document's

    def open_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in batches:
            rows: list[tuple] = []
            for doc_id, th, text, blocks in zip(*(b.column(k) for k in range(4)), strict=True):
                key = (doc_id.as_py(), th.as_py())
                if key == last:  # a row that repeats
                    continue
                data, last = text.as_py().encode(), key
                rows += [(x["block_no"], x["anchor"], x["hot"], x["lead"], data[x["first"] : x["first"] + x["n"] - 1 + length]) for x in blocks.as_py()]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["block_no", "anchor", "hot", "lead", "data"])

    sent = settle(map_arrow(source.join(wanted, ["doc_id", "th"]).select("doc_id", "th", "text", "blocks"), open_blocks, "block_no long, anchor long, hot boolean, lead int, data binary"), "suffix-sent")
    cold = sent.where("not hot").select("anchor", "block_no", "lead", "data").repartition("anchor").sortWithinPartitions("anchor", "block_no")
    ends = map_arrow(cold, lambda batches: compared(batches, bases, length), "block_no long, s int, e int")
    n_hot = sent.where("hot").count()
    if n_hot:
        ends = ends.unionByName(met_by_digest(sent.where("hot").select("block_no", "data"), -(-n_hot // PART), length))
    far = opened.where("not done").join(ends, "block_no").select("doc_id", "th", (F.col("first") + F.col("s")).alias("first"), (F.col("first") + F.col("e") + length).alias("end"))
    out = settle(whole.unionByName(far).groupBy("doc_id", "th").agg(F.sort_array(F.collect_set(F.struct("first", "end"))).alias("runs")), "suffix-runs")
    for t in (shared, counts, crowded, opened, sent):
        drop_table(t)
    return out


def common(one: Prefixes, two: Prefixes, x: np.ndarray, y: np.ndarray, most: np.ndarray, step: int) -> np.ndarray:
    """How far the texts after (step 1) or before (step -1) places x and y agree, `most` at most, by binary search over hashes."""
    low, high = np.zeros_like(most), most.copy()
    todo = np.flatnonzero(low < high)
    while len(todo):
        mid = (low[todo] + high[todo] + 1) >> 1
        a, b = x[todo], y[todo]
        (i, j), (k, m) = ((a, a + mid), (b, b + mid)) if step > 0 else ((a - mid, a), (b - mid, b))
        same = one.of(i, j) == one.of(k, m)
        same[same] = two.of(i[same], j[same]) == two.of(k[same], m[same])
        low[todo[same]] = mid[same]
        high[todo[~same]] = mid[~same] - 1
        todo = todo[low[todo] < high[todo]]
    return low


def mergesort(group: np.ndarray, precedes) -> np.ndarray:
    """Members sorted within each group (group: non-decreasing numbers) by precedes(x, y): x goes before y, where neither, as given.

    Runs of 1, 2, 4, ... members are merged, all of them at once: a member's place is its own plus the number of
    members of the other run that go before it, found by binary search.
    """
    n = len(group)
    order, begin = np.arange(n), np.searchsorted(group, group)  # begin: first place of the member's group
    end, width = np.searchsorted(group, group, "right"), 1
    longest = int((end - begin).max()) if n else 0
    while width < longest:
        place = np.arange(n)
        run = (place - begin) // width
        left = run % 2 == 0
        other = np.where(left, begin + (run + 1) * width, begin + (run - 1) * width)
        low = np.minimum(other, end)
        high, first = np.minimum(other + width, end), low.copy()
        todo = np.flatnonzero(low < high)
        while len(todo):
            mid = (low[todo] + high[todo]) >> 1
            me, it = order[todo], order[mid]
            mine = left[todo]
            # of the left run, equal members stay in front of those of the right one
            before = np.empty(len(todo), bool)
            before[mine] = precedes(it[mine], me[mine])
            before[~mine] = ~precedes(me[~mine], it[~mine])
            low[todo[before]] = mid[before] + 1
            high[todo[~before]] = mid[~before]
            todo = todo[low[todo] < high[todo]]
        pair = begin + (run - run % 2) * width
        to = pair + (place - (begin + run * width)) + (low - first)
        new = order.copy()
        new[to] = order
        order, width = new, width * 2
    return order


def classes(data: np.ndarray, place: np.ndarray, reach: np.ndarray, group: np.ndarray, one: Prefixes, two: Prefixes, step: int) -> tuple[np.ndarray, np.ndarray]:
    """(members sorted by their text after, or for step -1 before, their place; how far each agrees with the one in front of it, -1 where a group begins)."""

    def precedes(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        most = np.minimum(reach[x], reach[y])
        n = common(one, two, place[x], place[y], most, step)
        at = np.where(n < most, n if step > 0 else -n - 1, 0)
        return np.where(n < most, data[place[x] + at] < data[place[y] + at], reach[x] < reach[y])

    order = mergesort(group, precedes)
    whole = bool((np.bincount(order, minlength=len(order)) == 1).all())  # else comparisons contradicted each other
    x, y = order[:-1], order[1:]
    most = np.where(group[x] == group[y], np.minimum(reach[x], reach[y]), 0)
    n = common(one, two, place[x], place[y], most, step)
    if not whole or not verified(data, place, reach, x, y, n, most, group[x] == group[y], step):
        text = [data[p : p + r].tobytes() if step > 0 else data[p - r : p].tobytes()[::-1] for p, r in zip(place.tolist(), reach.tolist(), strict=True)]
        order = np.array(sorted(range(len(group)), key=lambda k: (group[k], text[k])), np.int64)
        x, y = order[:-1], order[1:]
        n = np.array([next((k for k, (a, b) in enumerate(zip(text[i], text[j], strict=False)) if a != b), min(len(text[i]), len(text[j]))) for i, j in zip(x.tolist(), y.tolist(), strict=True)], np.int64)
    return order, np.append(-1, np.where(group[x] == group[y], n, -1))


def verified(data: np.ndarray, place: np.ndarray, reach: np.ndarray, x: np.ndarray, y: np.ndarray, n: np.ndarray, most: np.ndarray, same: np.ndarray, step: int) -> bool:
    """Whether the neighbours x, y agree in n bytes and are in order after them, byte by byte: then all are in order."""
    for i in range(0, len(x), 4096):
        k = np.flatnonzero(same[i : i + 4096]) + i
        if not len(k):
            continue
        a, b, m = place[x[k]], place[y[k]], n[k]
        reached = np.arange(int(m.max()) if len(m) else 0)
        far = reached if step > 0 else -reached - 1
        inside = reached[None, :] < m[:, None]
        if (inside & (data[np.where(inside, a[:, None] + far, 0)] != data[np.where(inside, b[:, None] + far, 0)])).any():
            return False
        at = np.where(m < most[k], m if step > 0 else -m - 1, 0)
        if not np.where(m < most[k], data[a + at] < data[b + at], reach[x[k]] <= reach[y[k]]).all():
            return False
    return True


def repeated_starts(anchor: np.ndarray, blocks: list[bytes], lead: np.ndarray, bases: tuple[int, int], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(block, first and last start of each run of starts whose `length` bytes also start elsewhere in a block of its anchor).

    anchor: non-decreasing; lead: where the anchor begins in each block.
    """
    data = np.frombuffer(b"".join(blocks) + bytes(1), np.uint8)
    begin = np.cumsum([0, *map(len, blocks)])
    n = np.diff(begin) - (length - 1)
    place, nearest = begin[:-1] + lead, lead - (n - 1)  # a block's starts lie `nearest` to `lead` bytes before its anchor
    group = np.cumsum(np.append(0, anchor[1:] != anchor[:-1]))
    one, two = (Prefixes(data, b) for b in bases)
    after, after_n = classes(data, place, length - nearest, group, one, two, 1)
    before, before_n = classes(data, place, lead, group, one, two, -1)
    m = len(blocks)
    again = np.zeros((m, int(lead.max()) + 1), bool)  # by block and bytes before the anchor
    right, left = np.empty(m, np.int64), np.empty(m, np.int64)
    for i in range(int(nearest.min()), int(lead.max()) + 1):
        active = np.flatnonzero((nearest <= i) & (i <= lead))
        right[after] = np.cumsum(after_n < length - i)
        left[before] = np.cumsum(before_n < i)
        key = right[active] * (m + 1) + left[active]
        order = np.argsort(key)
        same = key[order[1:]] == key[order[:-1]]
        again[active[order[1:][same]], i] = again[active[order[:-1][same]], i] = True
    b, i = np.nonzero(again[:, ::-1])
    s = lead[b] - (again.shape[1] - 1 - i)  # starts of each block, ascending
    new = np.append(True, (b[1:] != b[:-1]) | (s[1:] != s[:-1] + 1)) if len(b) else np.zeros(0, bool)
    return b[new], s[new], s[np.append(new[1:], True)] if len(b) else s


def compared(batches: Iterator[pa.RecordBatch], bases: tuple[int, int], length: int) -> Iterator[pa.RecordBatch]:
    """Runs of repeated starts by block, from blocks (anchor, block_no, lead, data) sorted by anchor and block_no."""
    anchor, number, lead, blocks = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), []

    def work(upto: int) -> pa.RecordBatch:
        chosen = np.flatnonzero(np.append(True, number[1:upto] != number[: upto - 1]))  # each block once
        b, s, e = repeated_starts(anchor[chosen], [blocks[k] for k in chosen], lead[chosen], bases, length)
        return pa.RecordBatch.from_arrays([pa.array(number[chosen][b]), pa.array(s.astype(np.int32)), pa.array(e.astype(np.int32))], ["block_no", "s", "e"])

    for b in batches:
        if not b.num_rows:
            continue
        anchor, number, lead = (np.append(x, b.column(k).to_numpy()) for k, x in enumerate((anchor, number, lead)))
        blocks += b.column(3).to_pylist()
        last = int(np.searchsorted(anchor, anchor[-1]))  # that anchor may go on
        if last >= BLOCKS:
            yield work(last)
            anchor, number, lead, blocks = anchor[last:], number[last:], lead[last:], blocks[last:]
    if blocks:
        yield work(len(blocks))


def met_by_digest(blocks: DataFrame, parts: int, length: int) -> DataFrame:
    """block_no, s, e: runs of starts whose `length` bytes also start elsewhere in blocks (block_no, data), in `parts` parts."""
    dealt = blocks.select(F.pmod(F.xxhash64("block_no"), F.lit(parts)).cast("int").alias("part"), "block_no", "data")

    def strings(group: pa.Table) -> dict[int, list[bytes]]:
        return {k: [digest128(x[i : i + length]) for i in range(len(x) - length + 1)] for k, x in zip(group.column("block_no").to_pylist(), group.column("data").to_pylist(), strict=True)}

    def pack(key: tuple, group: pa.Table) -> pa.Table:
        seen = Counter(d for x in strings(group).values() for d in x)
        once, more = ({}, {})
        for d, c in seen.items():
            (once if c == 1 else more).setdefault(int.from_bytes(d[:8], "little") % parts, []).append(d)
        rows = [(b, key[0].as_py(), b"".join(once.get(b, [])), b"".join(more.get(b, []))) for b in once.keys() | more.keys()]
        return pa.table({k: pa.array([r[i] for r in rows], t) for i, (k, t) in enumerate((("bucket", pa.int32()), ("part", pa.int32()), ("once", pa.binary()), ("more", pa.binary())))})

    cut = lambda x: [x[i : i + 16] for i in range(0, len(x), 16)]

    def answer(key: tuple, group: pa.Table) -> pa.Table:
        rows = [(p, cut(a), cut(b)) for p, a, b in zip(*(group.column(k).to_pylist() for k in ("part", "once", "more")), strict=True)]
        seen = Counter(d for _, a, b in rows for d in (*a, *b, *b))
        out = [(p, b"".join([d for d in (*a, *b) if seen[d] > 1])) for p, a, b in rows]
        return pa.table({"part": pa.array([p for p, x in out if x], pa.int32()), "found": pa.array([x for _, x in out if x], pa.binary())})

    def runs(key: tuple, group: pa.Table, found: pa.Table) -> pa.Table:
        again = {d for x in found.column("found").to_pylist() for d in cut(x)}
        out: list[list[int]] = []
        for k, x in strings(group).items():
            for s, d in enumerate(x):
                if d not in again:
                    continue
                if out and out[-1][0] == k and out[-1][2] == s - 1:
                    out[-1][2] = s
                else:
                    out.append([k, s, s])
        return pa.table({n: pa.array([r[i] for r in out], t) for i, (n, t) in enumerate((("block_no", pa.int64()), ("s", pa.int32()), ("e", pa.int32())))})

    found = settle(dealt.groupBy("part").applyInArrow(pack, "bucket int, part int, once binary, more binary").groupBy("bucket").applyInArrow(answer, "part int, found binary"), "suffix-met")
    return dealt.groupBy("part").cogroup(found.groupBy("part")).applyInArrow(runs, "block_no long, s int, e int")


def cut(data: bytes, runs: list[dict] | None) -> tuple[bytes, int]:
    """(what is left of data, number of maximal removed runs)."""
    kept, at, n = [], 0, 0
    for r in runs or []:  # sorted by first
        if n == 0 or r["first"] > at:
            kept.append(data[at : r["first"]])
            n += 1
        at = max(at, r["end"])
    kept.append(data[at:])
    return b"".join(kept), n


NEW = {"n_bytes": "long", "n_removed": "long", "n_spans": "long", "kept_sha256": "string", "kept_text": "string"}


def dedup(docs: DataFrame, length: int = LENGTH, keep: list[str] | None = None) -> DataFrame:
    """The columns of docs (doc_id, text and any others) with n_bytes, n_removed, n_spans, kept_sha256 and kept_text;
    with `keep` only the columns it names.

    Texts are judged as UTF-8 bytes; kept_text drops a character of which only some bytes are left. A null text
    is empty and stays null in kept_text. Texts shorter than `length` are never cut. Repeated rows are each
    other's repetition, so long ones go whole. An empty table gives an empty result. Columns of docs that have
    the names of new ones are left out; any other names are safe.
    """
    names = [c for c in docs.columns if c.lower() not in NEW]
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)])
    id_, text = (next(f"c{k}" for k, c in enumerate(names) if c.lower() == name) for name in ("doc_id", "text"))
    runs = repeated_runs(docs.select("doc_id", "text"), length).withColumnsRenamed({"doc_id": "run_id", "th": "run_th"})
    content = F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))
    joined = rows.join(runs, (F.coalesce(F.col(id_).cast("long"), F.lit(NO_ID)) == F.col("run_id")) & (content == F.col("run_th")), "left")
    wanted = [f"c{k}" for k, c in enumerate(names) if keep is None or c in keep]
    made = [c for c in NEW if keep is None or c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 0):
                data = [t.encode() if t is not None else None for t in b.column(0).to_pylist()]
                left = [cut(d or b"", r) for d, r in zip(data, b.column(1).to_pylist(), strict=True)]
                size = [len(d or b"") for d in data]
                values = {
                    "n_bytes": lambda: pa.array(size, pa.int64()),
                    "n_removed": lambda: pa.array([s - len(x[0]) for s, x in zip(size, left, strict=True)], pa.int64()),
                    "n_spans": lambda: pa.array([x[1] for x in left], pa.int64()),
                    "kept_sha256": lambda: pa.array([hashlib.sha256(x[0]).hexdigest() for x in left], pa.string()),
                    "kept_text": lambda: pa.array([None if d is None else x[0].decode("utf-8", "ignore") for d, x in zip(data, left, strict=True)], pa.string()),
                }
                yield pa.RecordBatch.from_arrays([*b.columns[2:], *[values[c]() for c in made]], [*wanted, *made])

    schema = StructType([rows.schema[c] for c in wanted])
    for c in made:
        schema = schema.add(c, NEW[c])
    out = map_arrow(joined.select(F.col(text).cast("string").alias("t"), "runs", *wanted), run, schema)
    return out.toDF(*[names[int(c[1:])] for c in wanted], *made)


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns of dedup()."""
    return dedup(docs.select("doc_id", "text"), keep=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
