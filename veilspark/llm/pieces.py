"""SentencePiece encoding and decoding on the tokenizers library.

The model file is parsed as protobuf: pieces, scores and types, the normaliser's settings, byte fallback and
the model's kind. The tokenizer is rebuilt from them: for a unigram model from the scores, for a BPE model from
merges that every way of cutting a piece in two gives, ranked by score. Spaces become the metaspace marker.
No piece has a marker after another character, so text may be cut before each run of markers: that bounds what
one call holds for very long texts, and lets segments that repeat be encoded once. For the same reason segments that are new
can be joined to strings, which both libraries take in a third of the time, and their ids told apart by the pieces' lengths.
parity() compares with the sentencepiece library.
"""

from __future__ import annotations

import hashlib
import re
import struct
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from .common import bounded_threads, map_arrow, slices

MARK, CALL, CUT = "▁", 1 << 17, 1 << 16  # characters in one call to the library, and in one piece of a long text
JOINED = 512  # characters of new segments in one string
REMEMBER = 1_500_000  # characters of segments after which a worker forgets those that it has not met since the last time


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message."""
    i = 0

    def varint() -> int:
        nonlocal i
        out = shift = 0
        while True:
            byte = data[i]
            i += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while i < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        n = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield tag >> 3, data[i : i + n]
        i += n


@dataclass
class Spec:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)  # text, score, type: 1 normal, 2 unknown, 3 control, 4 user, 6 byte
    kind: int = 1  # 1 unigram, 2 BPE
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True
    suffix: bool = False


def parse(data: bytes) -> Spec:
    spec = Spec()
    for k, v in fields(data):
        if k == 1:
            p = dict(fields(v))
            spec.pieces.append((p[1].decode(), struct.unpack("<f", p[2])[0] if 2 in p else 0.0, p.get(3, 1)))
        elif k == 2:
            t = dict(fields(v))
            spec.kind, spec.byte_fallback, spec.suffix = t.get(3, 1), bool(t.get(35, 0)), bool(t.get(24, 0))
        elif k == 3:
            n = dict(fields(v))
            spec.charsmap, spec.dummy_prefix, spec.squeeze, spec.escape = n.get(2, b""), bool(n.get(3, 1)), bool(n.get(4, 1)), bool(n.get(5, 1))
    return spec


def merges(spec: Spec) -> list[tuple[str, str]]:
    rank = {p: i for i, (p, _, kind) in enumerate(spec.pieces) if kind == 1}
    score = {p: s for p, s, _ in spec.pieces}
    found = [(-score[p], rank[p], rank[p[:i]], rank[p[i:]], p[:i], p[i:]) for p in rank for i in range(1, len(p)) if p[:i] in rank and p[i:] in rank]
    return [x[-2:] for x in sorted(found)]


class Pieces:
    def __init__(self, path: str):
        bounded_threads(1)  # a task has one core; a second thread takes more of it and ends no sooner
        from tokenizers import Tokenizer, decoders, models, normalizers

        with open(path, "rb") as f:
            self.spec = spec = parse(f.read())
        if any(kind == 4 for _, _, kind in spec.pieces) or spec.suffix or not spec.escape:
            raise ValueError("user-defined symbols, markers after words and unescaped blanks are not supported")
        unk = next((i for i, p in enumerate(spec.pieces) if p[2] == 2), None)
        if spec.kind == 2:
            model = models.BPE({p: i for i, (p, _, _) in enumerate(spec.pieces)}, merges(spec), unk_token=None if unk is None else spec.pieces[unk][0], fuse_unk=True, byte_fallback=spec.byte_fallback)
        elif spec.kind == 1:
            model = models.Unigram([(p, s) for p, s, _ in spec.pieces], unk, spec.byte_fallback)
        else:
            raise ValueError("neither a unigram nor a BPE model")
        self.library = Tokenizer(model)
        self.library.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()])
        self.charsmap = normalizers.Precompiled(spec.charsmap) if spec.charsmap else None
        self.plain = spec.dummy_prefix and not spec.charsmap and not spec.squeeze
        self.segment = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        self.known: dict[str, bytes] = {}  # ids as 32-bit numbers
        self.before: dict[str, bytes] = {}  # what was known when it became too much
        self.odd: dict[str, str] = {}  # what segments that don't decode to themselves decode to
        self.held, self.bad = 0, set()  # characters of known; segments that the other library encodes otherwise
        self.theirs, self.whole = None, False
        self.cut = re.compile(f"(?<=[^{MARK}])(?={MARK})")
        self.inner = any(MARK in p.lstrip(MARK) for p, _, kind in spec.pieces if kind == 1)  # then text can't be cut
        # A unigram model adds up scores, whose rounding depends on what stands before; an unknown piece has no length of its own.
        self.joins = spec.kind == 2 and not self.inner and spec.byte_fallback and sum(kind == 6 for _, _, kind in spec.pieces) == 256
        # The characters that a piece stands for; of a character's bytes the first one counts.
        self.lengths = np.array([len(p) if kind != 6 else int(int(p[3:5], 16) >> 6 != 2) for p, _, kind in spec.pieces], np.int64)

    def compare(self, path: str) -> Pieces:
        """From now on the sentencepiece library encodes too: each new segment, or, where normalising may change what lies around it, whole texts."""
        from sentencepiece import SentencePieceProcessor

        self.theirs, self.whole = SentencePieceProcessor(model_file=path), bool(self.charsmap or self.spec.squeeze or self.inner)
        return self

    def normalise(self, text: str) -> str:
        if self.charsmap:
            text = self.charsmap.normalize_str(text)
        if self.spec.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        return (MARK if self.spec.dummy_prefix and text else "") + text.replace(" ", MARK)

    def parts(self, text: str) -> Iterator[str]:
        """The normalised text in parts of about CUT characters that can be encoded alone."""
        at, text = 0, self.normalise(text)
        while len(text) - at > CUT and not self.inner and (m := self.cut.search(text, at + CUT)):
            yield text[at : m.start()]
            at = m.start()
        yield text[at:]

    def segments(self, text: str) -> list[str]:
        """The normalised text in segments that can be encoded alone."""
        if self.inner:
            return list(self.parts(text))
        if self.plain and text and "  " not in text and MARK not in text and text[0] != " " != text[-1]:
            return [MARK + x for x in text.split(" ")]
        return [x for p in self.parts(text) for x in self.segment.findall(p)]

    def learn(self, segments: list[str]) -> None:
        """Encodes, and decodes again, segments not met before: one call for about CALL characters."""
        if self.held > REMEMBER:
            self.before, self.known, self.held = {x: i for x, i in self.known.items() if len(x) <= CUT}, {}, 0  # whole texts without blanks go
            self.odd, self.bad = {x: t for x, t in self.odd.items() if x in self.before}, self.bad & self.before.keys()
        new = list(dict.fromkeys([x for x in segments if x not in self.known]))
        self.held += sum(map(len, new))
        again = [x for x in new if x in self.before]
        self.known.update((x, self.before[x]) for x in again)
        if again:
            new = [x for x in new if x not in self.before]
        alone = [x for x in new if not self.joins or x[:1] != MARK or x[-1] == MARK]  # a marker at the end would join the next segment's
        if alone and self.joins:
            apart = set(alone)
            new = [x for x in new if x not in apart]
        for part in self.calls(alone):
            self.add(part, *self.both_ways(part))
        for part in self.calls(new) if self.joins else ():
            self.learn_joined(part)

    @staticmethod
    def calls(segments: list[str]) -> Iterator[list[str]]:
        sizes, begin = np.cumsum([len(x) for x in segments]), 0
        while begin < len(segments):
            end = max(begin + 1, int(np.searchsorted(sizes, (sizes[begin - 1] if begin else 0) + CALL, "right")))
            yield segments[begin:end]
            begin = end

    def both_ways(self, texts: list[str]) -> tuple[list[list[int]], list[str], list[list[int]] | None]:
        """(ids, what they decode to, the other library's ids if it compares segments) of normalised texts."""
        ids = [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        back, other = self.library.decode_batch(ids, skip_special_tokens=False), None
        if self.theirs and not self.whole:
            begins = int(self.spec.dummy_prefix)
            other = self.theirs.encode([x[begins:].replace(MARK, " ") for x in texts], num_threads=1)
            if begins and MARK in texts:  # a blank at a text's end, which without the text would be the empty text
                word, both = self.theirs.encode(["a", "a "], num_threads=1)
                other[texts.index(MARK)] = both[len(word) :] if both[: len(word)] == word else both
        return ids, back, other

    def add(self, segments: list[str], ids: list[list[int]], back: list[str], other: list[list[int]] | None) -> None:
        self.known.update((x, array("i", i).tobytes()) for x, i in zip(segments, ids, strict=True))
        self.odd.update((x, t) for x, t in zip(segments, back, strict=True) if t != x.replace(MARK, " "))
        if other is not None:
            self.bad.update(x for x, a, b in zip(segments, ids, other, strict=True) if a != b)

    def learn_joined(self, part: list[str]) -> None:
        """The same for segments that begin with a marker and end with none, joined to strings of about JOINED characters.

        No piece goes over a segment's begin, so the pieces that end where a segment ends are its last. Where a string
        doesn't decode to itself, or the libraries differ in it, its segments are taken one by one.
        """
        ends = np.cumsum([len(x) for x in part])
        cuts = [0, *(np.flatnonzero(np.diff(ends // JOINED)) + 1).tolist(), len(part)]
        texts = ["".join(part[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
        ids, back, other = self.both_ways(texts)
        flat = np.fromiter(chain.from_iterable(ids), np.int32)
        at = np.cumsum(self.lengths[flat])
        stops = np.searchsorted(at, ends, "right")  # after a character's last byte
        if not np.array_equal(at[stops - 1], ends) or stops[-1] != len(flat):
            return self.add(part, *self.both_ways(part))
        raw, stops = flat.tobytes(), (4 * stops).tolist()
        self.known.update((x, raw[a:b]) for x, a, b in zip(part, [0, *stops], stops, strict=False))
        for k, text in enumerate(texts):
            if back[k] != text.replace(MARK, " ") or (other is not None and other[k] != ids[k]):
                few = part[cuts[k] : cuts[k + 1]]
                self.add(few, *self.both_ways(few))

    def encode_both(self, texts: list[str]) -> tuple[list[np.ndarray], list[str], list[bool]]:
        """(ids of each text, what they decode to, whether the sentencepiece library gives its segments the same ids).

        Segments that repeat, as words do, are encoded, decoded and compared once. No piece goes over a segment's begin,
        so a text's ids are its segments' ids in a row; a segment holds whole characters, so its bytes never wait for
        another's. A segment decodes to itself with blanks for markers, or is one of the odd ones.
        """
        cut = [self.segments(t) for t in texts]
        self.learn(list(chain.from_iterable(cut)))
        ids = [np.frombuffer(b"".join([self.known[x] for x in c]), np.int32) for c in cut]
        strange = [bool(self.odd) and not self.odd.keys().isdisjoint(c) for c in cut]
        back = ["".join([self.odd[x] if x in self.odd else x.replace(MARK, " ") for x in c] if o else c).replace(MARK, MARK if o else " ") for c, o in zip(cut, strange, strict=True)]
        if self.theirs and self.whole:
            same = [a.tolist() == b for a, b in zip(ids, self.theirs.encode(texts, num_threads=1), strict=True)]
        else:
            same = [not self.bad or self.bad.isdisjoint(c) for c in cut]
        return ids, [self.unmarked(t) for t in back], same

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return self.encode_both(texts)[0]

    def unmarked(self, text: str) -> str:
        return text[1:] if self.spec.dummy_prefix and text.startswith(" ") else text

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        """Texts of the ids, without the blank that encoding put in front."""
        texts = self.library.decode_batch([x.tolist() for x in ids], skip_special_tokens=False)
        return [self.unmarked(t) for t in texts]


def parity(path: str, texts: list[str]) -> list[int]:
    """Places of the texts that the sentencepiece library encodes otherwise."""
    from sentencepiece import SentencePieceProcessor

    own, theirs = Pieces(path).encode(texts), SentencePieceProcessor(model_file=path).encode(texts, num_threads=1)
    return [i for i, (a, b) in enumerate(zip(own, theirs, strict=True)) if a.tolist() != b]


_pieces: dict[tuple[str, bool], Pieces] = {}


def pieces_of(path: str, check: bool) -> Pieces:
    """This process's tokenizer; another takes the place of the one before."""
    if (path, check) not in _pieces:
        _pieces.clear()
        _pieces[path, check] = Pieces(path).compare(path) if check else Pieces(path)
    return _pieces[path, check]


NEW = ["n_tokens", "ids_sha256", "round_trip", "parity", "ids"]


def encode(docs: DataFrame, path: str | None = None, keep_ids: bool = True, check: bool = True) -> DataFrame:
    """All columns of docs (text among them), then n_tokens, ids_sha256 (of the ids as little-endian 32-bit numbers),
    round_trip (the ids decode to the text), with `check` parity (the sentencepiece library gives every segment of the
    text the same ids; each worker compares a segment when it meets it. With a normaliser, or markers inside of pieces, whole
    texts are compared) and, with keep_ids, ids.

    Null texts are empty: no ids, and round_trip and parity hold. A text that the normaliser changes doesn't decode
    to itself; with the 32k BPE file none is changed, but for texts with the marker character. Very long texts are
    encoded in parts. Rows that repeat are encoded each; an empty table gives an empty result. Columns of docs that
    have the names of new ones are left out.
    """
    path = path or model_path()
    rows = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in NEW])
    names, at = list(rows.columns), [c.lower() for c in docs.columns if c.lower() not in NEW].index("text")
    new = [c for c in NEW if (c != "ids" or keep_ids) and (c != "parity" or check)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, at, 1 << 19):
                texts = [t or "" for t in b.column(at).to_pylist()]
                ids, decoded, same = pieces_of(path, check).encode_both(texts)
                made = {
                    "n_tokens": pa.array([len(x) for x in ids], pa.int64()),
                    "ids_sha256": pa.array([hashlib.sha256(x.astype("<i4").tobytes()).hexdigest() for x in ids], pa.string()),
                    "round_trip": pa.array([a == t for a, t in zip(decoded, texts, strict=True)], pa.bool_()),
                    "parity": pa.array(same, pa.bool_()),
                }
                if keep_ids:
                    ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                    made["ids"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))
                yield pa.RecordBatch.from_arrays([*b.columns, *[made[c] for c in new]], [*names, *new])

    kinds = {"n_tokens": "long", "ids_sha256": "string", "round_trip": "boolean", "parity": "boolean", "ids": ArrayType(IntegerType())}
    schema = StructType([*rows.schema.fields])
    for c in new:
        schema = schema.add(c, kinds[c])
    return map_arrow(rows, run, schema)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """All columns of encoded (ids among them), then decoded; null ids give null. A column `decoded` is replaced."""
    path = path or model_path()
    rows = encoded.select(*[F.col(f"`{c}`") for c in encoded.columns if c.lower() != "decoded"])
    names = list(rows.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = [c.lower() for c in names].index("ids")
        for whole in batches:
            for i in range(0, whole.num_rows, 100):
                b = whole.slice(i, 100)
                ids = b.column(at).to_pylist()
                texts = pieces_of(path, False).decode([np.array(x or [], np.int32) for x in ids])
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([t if x is not None else None for x, t in zip(ids, texts, strict=True)], pa.string())], [*names, "decoded"])

    return map_arrow(rows, run, StructType([*rows.schema.fields]).add("decoded", "string"))


def round_trip(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, round_trip, parity and ids of every document."""
    return encode(docs.select("doc_id", F.col("text").cast("string").alias("text"))).drop("text")
