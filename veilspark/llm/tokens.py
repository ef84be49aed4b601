"""Token counts with a whole-token shortcut.

Before any document is read, every vocabulary string that encodes alone as exactly one token is proved to do
so by encoding it. A document is cut into pre-tokens; those in the proved set count one each, and only the rest
go through the library's merges, each distinct one once for some texts. A worker process has one library, with
few threads, and remembers merged pre-tokens up to a bound on their characters.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_threads, map_arrow, slices

# Characters, in hexadecimal, that the two pattern libraries class differently (Unicode versions),
# found by trying all of them; texts with one are left to the library whole.
UNSURE = """
558 58b-58c 88f c5c cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf 10940-10959
10ec5-10ec7 10ed9-10eee 11b0a 11db0-11ddb 11de0-11de9 11df1 1246f 12475-1247f 12550-12686 16ea0-16eb8 16ebb-16ed3
16ff2-16ff6 187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 1b168 1d6a6
1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4
1e6fe-1e6ff 2b73a-2b73f 2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f
"""
#: Pre-tokens in one call to the library; characters of merged pre-tokens that a worker remembers before it starts afresh,
#: and of the longest that it remembers.
CALL, KEEP, LONG = 2000, 2_000_000, 100


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def unsure() -> str:
    """The pattern of one UNSURE character."""
    ranges = [(r.split("-") * 2)[:2] for r in UNSURE.split()]
    return "[" + "".join(f"\\U{int(a, 16):08x}-\\U{int(b, 16):08x}" for a, b in ranges) + "]"


def prove(path: str) -> tuple[frozenset[str], str, list[str]]:
    """(strings that are one pre-token and encode alone as one token, the pre-token pattern, strings of special tokens)."""
    bounded_threads()
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        special = [a["content"] for a in json.load(f)["added_tokens"]]
    pattern = regex.compile(public_tokenizers.PATTERN)
    texts = [t for i in range(library.get_vocab_size()) if (t := library.decode([i], skip_special_tokens=False)) and "�" not in t and t not in special]
    texts = [t for t in texts if pattern.fullmatch(t) and len(pattern.findall(t)) == 1]
    return frozenset(t for t, e in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True) if len(e.ids) == 1), public_tokenizers.PATTERN, special


class Counter:
    """Counts tokens of texts as the library does."""

    def __init__(self, path: str, proof: tuple[frozenset[str], str, list[str]]):
        bounded_threads()
        from tokenizers import Tokenizer

        self.library, (self.whole, pattern, special) = Tokenizer.from_file(path), proof
        self.pattern = regex.compile(pattern)
        self.special = regex.compile("|".join(regex.escape(s) for s in special)) if special else None
        self.unsure = regex.compile(unsure())
        self.merged: dict[str, int] = {}
        self.held = 0  # characters of merged

    def sizes(self, texts: list[str]) -> Iterator[int]:
        """Tokens of each text, from the library."""
        for i in range(0, len(texts), CALL):
            for e in self.library.encode_batch_fast(texts[i : i + CALL], add_special_tokens=False):
                yield len(e.ids)

    def counts(self, texts: list[str]) -> list[int]:
        out, todo, rest = [], [], {}
        for k, text in enumerate(texts):
            if self.unsure.search(text):
                out += self.sizes([text])
                continue
            parts, n = [text], 0
            if self.special and (found := self.special.findall(text)):
                parts, n = self.special.split(text), len(found)
            missing = []
            for part in parts:
                pre = self.pattern.findall(part)
                other = [t for t in pre if t not in self.whole]
                n += len(pre) - len(other)
                missing += other
            out.append(n)
            if missing:
                todo.append((k, missing))
                rest.update(dict.fromkeys(t for t in missing if t not in self.merged))
        rest = dict(zip(rest, self.sizes(list(rest)), strict=True))
        for k, missing in todo:
            out[k] += sum(self.merged[t] if t in self.merged else rest[t] for t in missing)
        if self.held > KEEP:
            self.merged, self.held = {}, 0
        short = {t: n for t, n in rest.items() if len(t) <= LONG}
        self.merged.update(short)
        self.held += sum(map(len, short))
        return out


_counters: dict[str, Counter] = {}


def counter(path: str, proof) -> Counter:
    """This process's counter; another vocabulary takes the place of the one before."""
    if path not in _counters:
        _counters.clear()
        _counters[path] = Counter(path, proof.value)
    return _counters[path]


def count(docs: DataFrame, path: str | None = None, limit: int = 512) -> DataFrame:
    """Per row of docs (doc_id, text, ...): doc_id, n_bytes, n_tokens, over_limit (more than `limit` tokens).

    Null and empty texts have no tokens. Strings of special tokens inside a text are one token each, the
    library's default. Very long texts are cut into pre-tokens like others. Rows that repeat are counted each; an
    empty table gives an empty result. Other columns are not looked at.
    """
    path = path or vocabulary_path()
    proof = docs.sparkSession.sparkContext.broadcast(prove(path))  # no larger than the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 1):
                n = counter(path, proof).counts([t or "" for t in b.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).select("doc_id", "text", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"))
    return map_arrow(rows, run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def count_documents(docs: DataFrame) -> DataFrame:
    return count(docs)
