"""Near-duplicates by SimHash and vantage-point trees.

Fingerprints partition by Hamming distance to vantage points and branches are pruned by the triangle bound
|d(x, v) - d(y, v)| <= d(x, y). In the whole 64-bit space distances gather at 32 +- 4, so with a bound of 4 a
median split leaves one side with 0.5 and the other, which must repeat its neighbour's edge, with 0.84 of the
points: work grows as N ** 1.85. The trees are therefore grown on masked distances, one for each of bits + 1 masks
that share the 64 bits out: two fingerprints within `bits` differ in none of the bits of at least one mask, so in
that mask's tree the bound is 0, and no boundary overlaps.

1. A bounded sample of distinct fingerprints (SAMPLE) grows the trees on the driver: each node's vantage point is
   the candidate whose median cut divides best, until a leaf holds about SHARD of all fingerprints.
2. Leaves too crowded for the sample to divide go on with the mask's unit vectors as vantage points, to the end.
3. Shards with more than CROWDED members branch once more on the whole distance to a vantage point, into rings
   bits + 1 wide; there boundaries do overlap, and each ring is queried with its own members and its lower
   neighbour's. Rings still over CROWDED members are dealt out as a grid of parts, each pair of parts one task's work.
4. In a task, members sorted by distance to the vantage point are compared only while the triangle bound holds.

All levels are exact; they only say which fingerprints meet. Only distinct fingerprints enter the trees. A task
returns its links as a star per group found (no group is expanded into pairs), and components come from
contracting links in rounds of DataFrame joins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, map_arrow, materialize

BITS, SHINGLE, SEED = 4, 4, 42
#: Members wanted in a leaf; of a shard that branches once more; fingerprints that grow the trees, and of a node that the sample divides.
SHARD, CROWDED, SAMPLE, LEAST, CANDIDATES = 256, 1024, 1 << 14, 16, 6
#: Any point can be the rings' vantage point; this one has 32 bits set.
VANTAGE = 0x6A95A96A_D2B42D4B


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of the shingles (repeats included) of the words `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased; 0 without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]).tolist()
    starts, n = [0, *ends[:-1]], max(1, len(words) - shingle + 1)
    last = ends[min(shingle, len(words)) - 1 :]
    hashes = np.fromiter((xxhash.xxh64_intdigest(joined[a : b - 1], SEED) for a, b in zip(starts[:n], last, strict=True)), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for i in range(0, n, 65536):  # very long texts in pieces
        counts += np.unpackbits(hashes[i : i + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long), and the columns named."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py()) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64)), *b.columns[2:]], ["doc_id", "fp", *more])

    return map_arrow(rows, run, ", ".join(["doc_id long, fp long", *[f"{c} {rows.schema[c].dataType.simpleString()}" for c in more]]))


def masks(bits: int = BITS) -> list[int]:
    """bits + 1 masks that share the 64 bits out."""
    bounds = [64 * i // (bits + 1) for i in range(bits + 2)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(bounds, bounds[1:], strict=False)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def groups_of(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of n members the smallest member that links a-b reach from it."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def linked(shard: np.ndarray, side: np.ndarray, near: np.ndarray, fp: np.ndarray, node: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Links between members of the same shard within `bits`, as stars: (the group's smallest node, another member's node).

    side: 0 members meet all; members of sides 1 and 2 meet only the other side. near: distance to the vantage
    point; a shard's members are sorted by it. Member i meets i + 1, i + 2, ... until the shard ends or the
    triangle bound is passed; all members take their next step together.
    """
    n, label, found, held = len(fp), None, [], 0
    i = np.arange(n)
    for step in range(1, n):
        i = i[i < n - step]
        j = i + step
        go = (shard[i] == shard[j]) & (near[j] - near[i] <= bits)
        i, j = i[go], j[go]
        if not len(i):
            break
        close = (np.bitwise_count(fp[i] ^ fp[j]) <= bits) & ((side[i] != side[j]) | (side[i] == 0))
        if close.any():
            found.append((i[close], j[close]))
            held += len(found[-1][0])
        if held > 1_000_000:  # keep groups, not pairs
            label = groups_of(*map(np.concatenate, zip(*found, strict=True)), n)
            found, held = [(label, np.arange(n))], 0
    if not found:
        return node[:0], node[:0]
    label = groups_of(*map(np.concatenate, zip(*found, strict=True)), n)
    other = np.flatnonzero(label != np.arange(n))
    a, b = node[label[other]], node[other]
    return np.minimum(a, b), np.maximum(a, b)


@dataclass
class Tree:
    """Nodes in arrays: at a node, members whose masked distance to `vantage` is at most `cut` go to `near`, others to `far`.

    Leaves have -1 there. Crowded leaves branch on by all bits of the mask.
    """

    mask: int
    vantage: np.ndarray
    cut: np.ndarray
    near: np.ndarray
    far: np.ndarray
    crowded: np.ndarray

    def leaf(self, fp: np.ndarray) -> np.ndarray:
        """Node of the leaf of each fingerprint."""
        at, todo = np.zeros(len(fp), np.int64), np.arange(len(fp))
        while len(todo := todo[self.near[at[todo]] >= 0]):
            node = at[todo]
            close = np.bitwise_count((fp[todo] ^ self.vantage[node]) & np.uint64(self.mask)) <= self.cut[node]
            at[todo] = np.where(close, self.near[node], self.far[node])
        return at

    def cell(self, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(leaf, bits of the mask where it is crowded, else 0)."""
        leaf = self.leaf(fp)
        return leaf, np.where(self.crowded[leaf], fp & np.uint64(self.mask), np.uint64(0))


def grow(sample: np.ndarray, total: int, mask: int, shard: int = SHARD) -> Tree:
    """A vantage-point tree on the distance within mask, for `total` fingerprints of which sample is a part."""
    rng, m = np.random.default_rng(mask & 0xFFFF), np.uint64(mask)
    nodes: list[list] = [[0, 0, -1, -1, False]]
    todo = [(0, sample)]
    while todo:
        node, held = todo.pop()
        size = total * len(held) / max(1, len(sample))
        if size <= shard:
            continue
        best = None
        if len(held) >= LEAST:
            for v in rng.choice(held, CANDIDATES):
                d = np.bitwise_count((held ^ v) & m)
                cut = int(np.sort(d)[(len(d) - 1) // 2])
                share = abs(0.5 - (d <= cut).mean())
                below = abs(0.5 - (d < cut).mean())
                cut, share = (cut, share) if share <= below else (cut - 1, below)
                if share < 0.4 and (best is None or share < best[0]):
                    best = (share, v, cut, d <= cut)
        if best is None:
            nodes[node][4] = True
            continue
        _, v, cut, close = best
        nodes[node][:4] = [v, cut, len(nodes), len(nodes) + 1]
        todo += [(len(nodes), held[close]), (len(nodes) + 1, held[~close])]
        nodes += [[0, 0, -1, -1, False], [0, 0, -1, -1, False]]
    v, cut, near, far, crowded = zip(*nodes, strict=True)
    return Tree(mask, np.array(v, np.uint64), np.array(cut, np.int64), np.array(near, np.int64), np.array(far, np.int64), np.array(crowded, bool))


def planted(points: DataFrame, bits: int = BITS, shard: int = SHARD) -> list[Tree]:
    """The trees, grown on about SAMPLE of the fingerprints, chosen by hash (twice that at most)."""
    total = points.count()
    part = points.where(F.pmod(F.xxhash64("fp", F.lit("sample")), F.lit(1 << 30)) < F.lit(int(min(1.0, SAMPLE / max(1, total)) * (1 << 30))))
    sample = np.array([r.fp for r in part.select("fp").limit(2 * SAMPLE).collect()], np.int64).view(np.uint64)
    return [grow(np.sort(sample), total, m, shard) for m in masks(bits)]


def placed(points: DataFrame, trees: list[Tree]) -> DataFrame:
    """node, fp, near (distance to VANTAGE), tree and cell (the shard there) of each point in each tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(1).to_numpy().view(np.uint64)
            near = pa.array(np.bitwise_count(fp ^ np.uint64(VANTAGE)).astype(np.int32))
            for t, tree in enumerate(trees):
                leaf, bits = tree.cell(fp)
                # a mask's bits are neighbours and 63 at most, leaves few: both fit in one number
                low = np.uint64((tree.mask & -tree.mask).bit_length() - 1)
                cell = ((bits >> low) << np.uint64(20)) | leaf.astype(np.uint64)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), near, pa.array(np.full(len(fp), t, np.int32)), pa.array(cell.view(np.int64))], ["node", "fp", "near", "tree", "cell"])

    return map_arrow(points.select(F.col("node").cast("long"), F.col("fp").cast("long")), run, "node long, fp long, near int, tree int, cell long")


def links(points: DataFrame, bits: int = BITS, shard: int = SHARD, crowded: int = CROWDED) -> DataFrame:
    """a, b: links (as stars, see above) between the nodes of points (node, fp; fp distinct) within `bits` bits (1 to 15)."""
    if not 1 <= bits <= 15:
        raise ValueError("1 to 15 bits")
    held_by = materialize(placed(points, planted(points, bits, shard)), "simhash-placed")
    big = held_by.groupBy("tree", "cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowded)  # crowded leaves and, for 4 bits, 5 * 2 ** 13 cells at most
    marked = held_by.join(big.select("tree", "cell", F.lit(True).alias("hot")), ["tree", "cell"], "left")
    width = bits + 1
    rings = F.when(F.col("hot"), F.array(F.struct(F.floor(F.col("near") / width).alias("ring"), F.lit(1).alias("home")), F.struct((F.floor(F.col("near") / width) + 1).alias("ring"), F.lit(0).alias("home")))).otherwise(F.array(F.struct(F.lit(-1).cast("bigint").alias("ring"), F.lit(1).alias("home"))))
    ringed = marked.select("node", "fp", "near", "tree", "cell", F.explode(rings).alias("r")).select("node", "fp", "near", "tree", "cell", "r.*")
    held = ringed.where("ring >= 0").groupBy("tree", "cell", "ring").agg(F.ceil(F.count(F.lit(1)) / crowded).cast("int").alias("parts")).where("parts > 1")  # at most 14 for each row of big
    ringed = ringed.join(held, ["tree", "cell", "ring"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    to = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda q: F.struct(F.least(own, q).alias("lo"), F.greatest(own, q).alias("hi"), F.when(own < q, 1).when(own > q, 2).otherwise(0).alias("side")))
    dealt = ringed.select("node", "fp", "near", "tree", "cell", "ring", F.explode(to).alias("g")).select(F.xxhash64("tree", "cell", "ring", "g.lo", "g.hi").alias("shard"), "g.side", "near", "fp", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None

        def work(cols: list[np.ndarray]) -> pa.RecordBatch:
            a, b = linked(cols[0], cols[1], cols[2], cols[3].view(np.uint64), cols[4], bits)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if not len(cols[0]):
                continue
            if rest is not None:
                cols = [np.concatenate(x) for x in zip(rest, cols, strict=True)]
            cut = int(np.searchsorted(cols[0], cols[0][-1]))  # the last shard may go on in the next batch
            if cut:
                yield work([c[:cut] for c in cols])
            rest = [c[cut:] for c in cols]
        if rest is not None:
            yield work(rest)

    spread = dealt.repartition("shard").sortWithinPartitions("shard", "near")
    out = materialize(map_arrow(spread, run, "a long, b long").distinct(), "simhash-links")
    drop_table(held_by)
    return out


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) of every node with a link.

    Each round sends every node to the smallest of itself and its neighbours and contracts the links by that;
    the maps, composed, give each node's component. Rounds go on until no link is left; each is written to the
    shared folder. Sums and minima are pre-aggregated, so a node with very many links is no heavy group.
    """
    maps, own = [], False
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = materialize(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("low")).select(F.col("a").alias("node"), "low"), "simhash-map")
        maps.append(low)
        x, y = low.select(F.col("node").alias("a"), F.col("low").alias("x")), low.select(F.col("node").alias("b"), F.col("low").alias("y"))
        new = edges.join(x, "a").join(y, "b").where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        old, edges = edges, materialize(new, "simhash-links")
        if own:
            drop_table(old)
        own = True
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out = maps[0].withColumnRenamed("low", "component")
    for m in maps[1:]:
        out = out.join(m.select(F.col("node").alias("component"), "low"), "component", "left").select("node", F.coalesce("low", "component").alias("component"))
    return out


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text, ...): doc_id, fingerprint (16 hex digits), component_id.

    Null texts and texts without words have fingerprint zero and link like any other. Rows that repeat an id or
    a text share what is computed for it. A row without doc_id has a fingerprint but takes no part in linking;
    its component_id is null. An empty table gives an empty result. Other columns are not looked at.
    """
    fps = materialize(fingerprints(docs), "simhash-fps")
    points = materialize(fps.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node")), "simhash-points")
    joined = points.join(components(links(points)), "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    # The side of fps may hold a third of its rows under one fp; adaptive execution splits such partitions.
    out = fps.join(joined, "fp", "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def representatives(docs: DataFrame) -> DataFrame:
    """Of each group of near-duplicates among the rows of docs (doc_id, text, ...) one row, with all its columns.

    Rows are told apart by doc_id and text, so repeated ids do no harm, and rows without doc_id link like others.
    The row with the smallest doc_id stays (one without doc_id only if no other is there), then that with the
    smallest text hash; of equal ones any.
    """
    marked = docs.withColumn("_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))).withColumn("_th", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    fps = materialize(fingerprints(marked, "_id", "_th"), "simhash-fps")
    points = materialize(fps.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "_id", "_th")).alias("best")), "simhash-points")
    found = points.join(components(links(points.select(F.col("fp").alias("node"), "fp"))).withColumnRenamed("node", "fp"), "fp", "left")
    best = found.groupBy(F.coalesce("component", "fp").alias("component")).agg(F.min("best").alias("best")).select("best._id", "best._th")
    # Equal rows are reduced before the shuffle, so that a text in a third of all rows is no heavy group.
    return marked.dropDuplicates(["_id", "_th"]).join(best, ["_id", "_th"], "left_semi").select(*docs.columns)
