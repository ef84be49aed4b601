import codecs
import hashlib
import random

import pytest

from veilspark.llm import bpe

TEXTS = [None, "", "a", "  It's 12 o'clock\n\n", "naïve Ünïcode – “quotes” 日本語 😀😀", "a" * 3000, "x՘y Ᲊ 9\U00016ebb", "<|endoftext|> tail", " " * 400 + "b", "\u0000 \t é"]


def library(path):
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})


@pytest.fixture(scope="module")
def parts():
    ranks = bpe.load_ranks(bpe.rank_path())
    return ranks, bpe.compile_ranks(ranks)


def test_bpe_queries_against_library(spark):
    rng = random.Random(5)
    texts = TEXTS + ["".join(rng.choice("aehinrst ,.'é0") for _ in range(rng.randint(1, 80))) for _ in range(200)]
    rows = [(None if k == 2 else k, t, "x", k) for k, t in enumerate(texts)] + [(1, "again", "x", 0)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int")
    own = library(bpe.rank_path())
    want = []
    for i, t, *_ in rows:
        ids = own.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, bpe.digest(docs).collect()), key=key) == sorted(want, key=key)
    back = bpe.decode(bpe.encode(docs)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in back) == sorted((r[0] is None, r[0] or 0, r[1] or "") for r in rows)
    assert bpe.digest(docs.limit(0)).collect() == []


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def test_transducer_on_joined_tokens(name):
    ranks = bpe.load_ranks(bpe.rank_path(name))
    t, own, rng = bpe.Transducer(ranks, bpe.compile_ranks(ranks), most=50), library(bpe.rank_path(name)), random.Random(3)
    tokens = list(ranks)
    for _ in range(1500):  # far more states than are remembered
        data = b"".join(rng.choice(tokens) for _ in range(rng.randint(1, 9)))
        assert t.encode(data) == own._encode_single_piece(data)
        assert len(t.keys) <= 53
    assert t.encode(b"") == []


def test_long_pre_tokens_in_linear_time(parts):
    t = bpe.Transducer(*parts)
    n = {k: len(t.encode(b"ab" * k + b"!")) for k in (1000, 200_000)}
    assert n[200_000] == pytest.approx(200 * n[1000], rel=0.02)


def test_improper_vocabularies_are_refused():
    single = {bytes([i]): i for i in range(256)}
    assert bpe.compile_ranks(single | {b"ab": 256, b"abc": 257}) == {256: (97, 98), 257: (256, 99)}
    with pytest.raises(ValueError, match="lower rank"):
        bpe.compile_ranks(single | {b"ab": 257, b"abc": 256})
    with pytest.raises(ValueError, match="itself"):
        bpe.compile_ranks(single | {b"abc": 256})
    with pytest.raises(ValueError, match="byte 0"):
        bpe.compile_ranks({b"a": 0})


def test_streaming_decoder_like_the_standard_one():
    rng = random.Random(7)
    leads = [0x41, 0x80, 0x9F, 0xA0, 0xBF, 0xC0, 0xC2, 0xDF, 0xE0, 0xE1, 0xED, 0xEF, 0xF0, 0xF1, 0xF4, 0xF5, 0xFF, 0x90, 0x8F]
    d = bpe.Decoder({i: bytes([i]) for i in range(256)})
    for _ in range(4000):
        data = bytes(rng.choice(leads) for _ in range(rng.randint(0, 9)))
        want = codecs.getincrementaldecoder("utf-8")("replace").decode(data, final=True)
        assert "".join(d.stream(list(data), some=2)) == want
    assert len(d.states) < 300
