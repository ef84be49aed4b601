"""Byte-level BPE: merges compiled into a lazily determinised transducer, and a streaming decoder.

A pre-token's bytes are read one by one. After each, the tokens of every prefix are known (each prefix has one
encoding), and those prefixes at which the final encoding may still have a boundary are its live hypotheses: their
encodings beyond what was written, and the bytes since. What all of them begin with is written at once; so a token
comes out after a bounded lookahead. A set of hypotheses is a state, made when first met; states and steps are
remembered up to a bound.

Two neighbouring tokens can stand next to each other exactly if no merge crosses their border while they grow, and
an encoding is right exactly if all its neighbours can. Both need a vocabulary in which merges run by rising rank:
each token's last merge joins tokens of lower rank, and each encodes to itself. compile_ranks() proves this for every
token, before any text is read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filesystem, map_arrow, slices

#: States that a worker remembers before it starts afresh, characters of pre-tokens whose ids it remembers, and of the longest of them.
STATES, KEEP, LONG = 300_000, 4_000_000, 100
ONE = [bytes([i]) for i in range(256)]
#: For each class of characters in the pattern, one that all libraries put there; the last is in none.
STANDS_FOR = {r"\p{L}": "é", r"\p{N}": "²", r"\s": " ", "": ""}


def rank_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load_ranks(path: str) -> dict[bytes, int]:
    """Rank, which is the id, of each token: lines of base64 and a number. path: local or a URI."""
    fs, inner = filesystem(path)
    with fs.open_input_stream(inner) as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f.read().splitlines() if line.strip())}


def merged(ranks: dict[bytes, int], data: bytes) -> tuple[list[bytes], bytes]:
    """(tokens, first part of the last merge): the merges one by one, lowest rank and then leftmost first. Slow: for single tokens."""
    parts, first = [data[i : i + 1] for i in range(len(data))], b""
    while pairs := [(ranks[x + y], i) for i, (x, y) in enumerate(zip(parts, parts[1:], strict=False)) if x + y in ranks]:
        i = min(pairs)[1]
        first = parts[i]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts, first


def compile_ranks(ranks: dict[bytes, int]) -> dict[int, tuple[int, int]]:
    """The ids that each token's last merge joins; raises ValueError unless merges run by rising rank and each token encodes to itself."""
    if missing := [i for i in range(256) if bytes([i]) not in ranks]:
        raise ValueError(f"the vocabulary has no token for byte {missing[0]}")
    halves = {}
    for token, rank in ranks.items():
        if len(token) > 1:
            parts, first = merged(ranks, token)
            if parts != [token]:
                raise ValueError(f"{token!r} does not encode to itself")
            a, b = first, token[len(first) :]
            if any(len(x) > 1 and ranks[x] >= rank for x in (a, b)):
                raise ValueError(f"{token!r} has a lower rank than what it is merged of")
            halves[rank] = ranks[a], ranks[b]
    return halves


def stand_ins(classes: tuple[str, ...] = (r"\p{L}", r"\p{N}", r"\s")) -> dict[int, str]:
    """Characters that the two pattern libraries class differently (Unicode versions), found by trying all of them, and one that stands for each."""
    import tiktoken

    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    single, theirs, odd = {bytes([i]): i for i in range(256)}, {}, set()
    for c in classes:
        library = tiktoken.Encoding(c, pat_str=c, mergeable_ranks=single, special_tokens={})
        theirs[c] = set(library.decode_bytes(library.encode_ordinary(every)).decode())
        odd |= theirs[c] ^ set(regex.findall(c, every))
    return {ord(x): STANDS_FOR[next((c for c in classes if x in theirs[c]), "")] for x in odd}


class Transducer:
    """Bytes of a pre-token to ids."""

    def __init__(self, ranks: dict[bytes, int], halves: dict[int, tuple[int, int]], most: int = STATES):
        self.ranks, self.halves, self.most = ranks, halves, most
        self.bytes = {i: t for t, i in ranks.items()}
        self.prefixes = {t[:n] for t in ranks for n in range(1, len(t))}
        self.forget()

    def forget(self) -> None:
        #: Of each state: last id written, if a border check needs it, or -1; hypotheses (ids not written, bytes since), longest bytes first; what the text's end writes.
        self.keys: list[tuple[int, tuple]] = []
        self.ends: list[tuple[int, ...]] = []
        self.numbers: dict[tuple, int] = {}
        self.steps: dict[int, tuple[int, tuple[int, ...]]] = {}
        self.able: dict[tuple[int, int], bool] = {}
        self.state(-1, (((), b""),))

    def state(self, last: int, live: tuple) -> int:
        key = (last, live)
        if key not in self.numbers:
            self.numbers[key] = len(self.keys)
            self.keys.append(key)
            self.ends.append(next(ids for ids, since in live if not since))
        return self.numbers[key]

    def formed(self, i: int) -> int:
        """When a token comes to be: with its merge, single bytes before all."""
        return i if i in self.halves else -1

    def neighbours(self, a: int, b: int) -> bool:
        """Whether no merge crosses the border of a and b: one does if it comes before the tokens at the border are merged into others."""
        if a < 0:
            return True
        if (known := self.able.get((a, b))) is not None:
            return known
        x, x_goes, able = a, float("inf"), True
        while able:
            y, y_goes = b, float("inf")
            while able:
                r = self.ranks.get(self.bytes[x] + self.bytes[y])
                able = r is None or not (max(self.formed(x), self.formed(y)) < r < x_goes and r <= y_goes)  # on equal ranks the left one is merged first
                if y not in self.halves:
                    break
                y, y_goes = self.halves[y][0], y
            if x not in self.halves:
                break
            x, x_goes = self.halves[x][1], x
        self.able[a, b] = able
        return able

    def step(self, s: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """(next state, ids written) of a step that was not met before."""
        last, live = self.keys[s]
        if len(self.keys) > self.most:
            self.forget()
            s = self.state(last, live)
        one, whole, grown = ONE[byte], None, []
        for ids, since in live:
            since += one
            if whole is None and (t := self.ranks.get(since)) is not None and self.neighbours(ids[-1] if ids else last, t):
                whole = (*ids, t)
            if since in self.prefixes:
                grown.append((ids, since))
        grown.append((whole, b""))  # each prefix has one encoding
        if not grown[0][0]:
            done = self.steps[s << 8 | byte] = self.state(last, tuple(grown)), ()
            return done
        n, shortest = 0, min(len(ids) for ids, _ in grown)
        while n < shortest and all(ids[n] == whole[n] for ids, _ in grown):
            n += 1
        before = whole[n - 1] if n else last
        done = self.steps[s << 8 | byte] = self.state(before if n == shortest else -1, tuple((ids[n:], since) for ids, since in grown)), whole[:n]
        return done

    def encode(self, data: bytes) -> list[int]:
        """The ids of a pre-token; one that is a token is that token."""
        if (whole := self.ranks.get(data)) is not None:
            return [whole]
        out, s = [], 0
        for byte in data:
            s, written = self.steps.get(s << 8 | byte) or self.step(s, byte)
            if written:
                out += written
        return [*out, *self.ends[s]]


class Utf8:
    """UTF-8 as a state machine over bytes: a state is the bytes of an unfinished character, no more than three."""

    @staticmethod
    def wanted(begun: bytes) -> tuple[int, int, int] | None:
        """(continuation bytes that are missing, least and greatest next one) after `begun`; None if it begins no character."""
        lead = begun[0]
        n = 1 if 0xC2 <= lead < 0xE0 else 2 if 0xE0 <= lead < 0xF0 else 3 if 0xF0 <= lead < 0xF5 else 0
        if not n:
            return None
        least, most = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(lead, (0x80, 0xBF)) if len(begun) == 1 else (0x80, 0xBF)
        return n - len(begun) + 1, least, most

    @classmethod
    def feed(cls, begun: bytes, data: bytes) -> tuple[str, bytes]:
        """(text, new state) after more bytes; each longest begin of a character that goes wrong becomes U+FFFD."""
        out = bytearray()
        for byte in data:
            if begun:
                missing, least, most = cls.wanted(begun)
                if least <= byte <= most:
                    begun += bytes([byte])
                    if missing == 1:
                        out += begun
                        begun = b""
                    continue
                out += "�".encode()
                begun = b""
            if byte < 0x80:
                out.append(byte)
            elif cls.wanted(bytes([byte])):
                begun = bytes([byte])
            else:
                out += "�".encode()
        return out.decode(), begun


class Decoder:
    """Ids to text, as they come; steps of (state, id) are remembered."""

    def __init__(self, tokens: dict[int, bytes]):
        self.tokens, self.states, self.numbers, self.steps = tokens, [b""], {b"": 0}, [{}]

    def step(self, s: int, i: int) -> tuple[str, int]:
        text, begun = Utf8.feed(self.states[s], self.tokens[i])
        if begun not in self.numbers:
            self.numbers[begun] = len(self.states)
            self.states.append(begun)
            self.steps.append({})
        done = self.steps[s][i] = text, self.numbers[begun]
        return done

    def stream(self, ids: list[int], some: int = 4096) -> Iterator[str]:
        """The text in pieces of `some` ids each; a character that the ids leave unfinished becomes U+FFFD."""
        s, out = 0, []
        for i in ids:
            text, s = self.steps[s].get(i) or self.step(s, i)
            out.append(text)
            if len(out) >= some:
                yield "".join(out)
                out = []
        yield "".join(out) + ("�" if s else "")


class Codec:
    """A worker's encoder and decoder."""

    def __init__(self, ranks: dict[bytes, int], halves: dict[int, tuple[int, int]], odd: dict[int, str], pattern: str):
        self.transducer = Transducer(ranks, halves)
        self.decoder = Decoder(self.transducer.bytes)
        self.pattern, self.odd = regex.compile(pattern), odd
        self.known: dict[str, tuple[int, ...]] = {}
        self.held = 0

    def pieces(self, text: str) -> list[str]:
        if text.isascii() or not (odd := self.odd.keys() & set(map(ord, set(text)))):
            return self.pattern.findall(text)
        shown = text.translate({c: self.odd[c] for c in odd})  # same length, classed as the other library does
        return [text[m.start() : m.end()] for m in self.pattern.finditer(shown)]

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for p in self.pieces(text):
            ids = self.known.get(p)
            if ids is None:
                ids = tuple(self.transducer.encode(p.encode()))
                if len(p) <= LONG:
                    if self.held > KEEP:
                        self.known, self.held = {}, 0
                    self.known[p] = ids
                    self.held += len(p)
            out += ids
        return out


_codecs: dict[tuple, Codec] = {}


def codec(key: tuple, parts) -> Codec:
    """This process's codec; that of another vocabulary takes the place of the one before."""
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(*parts.value)
    return _codecs[key]


def _prepared(spark: SparkSession, path: str | None, pattern: str | None):
    """(key, broadcast parts of a codec): ranks, halves and stand-ins, none larger than the vocabulary or the differences of Unicode versions."""
    import public_tokenizers

    path, pattern = path or rank_path(), pattern or public_tokenizers.PATTERN
    ranks = load_ranks(path)
    return (path, pattern), spark.sparkContext.broadcast((ranks, compile_ranks(ranks), stand_ins(), pattern))


def _texts(docs: DataFrame, keys: list[str]) -> DataFrame:
    return docs.select(*keys, F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("_data"))


def _strings(column: pa.Array) -> list[str]:
    return [b.decode(errors="replace") for b in column.to_pylist()]


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, ids (array) of each row's whole text, without special tokens.

    Null and empty texts have no ids. Bytes that are no UTF-8 count as U+FFFD. A pre-token of any length takes time in
    proportion to its length. Rows that repeat are encoded each; an empty table gives an empty one. Columns besides
    doc_id (which may be null) and text are not looked at.
    """
    key, parts = _prepared(docs.sparkSession, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 1):
                c = codec(key, parts)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.encode(t) for t in _strings(b.column(1))], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return map_arrow(_texts(docs, ["doc_id"]), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(rows: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text of rows (doc_id, ids), as the reverse of encode(). Null ids give a null text; an id without a token raises KeyError."""
    key, parts = _prepared(rows.sparkSession, path, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = codec(key, parts)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if ids is None else "".join(c.decoder.stream(ids)) for ids in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return map_arrow(rows.select("doc_id", F.col("ids").cast("array<int>").alias("ids")), run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")


def digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row: encode() and decode() in one pass, so that ids of long texts are not kept. Odd inputs as in encode()."""
    key, parts = _prepared(docs.sparkSession, path, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(key, parts)
        names = {i: str(i) for i in c.transducer.bytes}
        for whole in batches:
            for b in slices(whole, 1):
                n, ids_sha, text_sha = [], [], []
                for text in _strings(b.column(1)):
                    ids, decoded = c.encode(text), hashlib.sha256()
                    for part in c.decoder.stream(ids):
                        decoded.update(part.encode())
                    n.append(len(ids))
                    ids_sha.append(hashlib.sha256(" ".join(map(names.__getitem__, ids)).encode()).hexdigest())
                    text_sha.append(decoded.hexdigest())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_arrow(_texts(docs, ["doc_id"]), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
