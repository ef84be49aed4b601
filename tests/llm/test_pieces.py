"""New segments are encoded joined, those that are still met aren't forgotten, and results are those of single segments."""

import random

import numpy as np

from tests.llm.test_operators import unigram_model
from veilspark.llm import pieces


class Counting:
    """A library whose calls are noted."""

    def __init__(self, library):
        self.library, self.taken = library, []

    def encode_batch_fast(self, texts, **kw):
        self.taken += texts
        return self.library.encode_batch_fast(texts, **kw)

    def decode_batch(self, *a, **kw):
        return self.library.decode_batch(*a, **kw)


class Differing:
    """The sentencepiece library, but for texts with this word."""

    def __init__(self, library, word):
        self.library, self.word = library, word

    def encode(self, texts, **kw):
        return [[*ids, 5] if self.word in t else ids for t, ids in zip(texts, self.library.encode(texts, **kw), strict=True)]


def made_words(n, letters="abcdeéñ\n.中😀ﷺ"):
    rng = random.Random(9)
    return ["".join(rng.choices(letters, k=rng.randrange(1, 12))) for _ in range(n)]


def made_texts(n):
    words, blanks = made_words(n), random.Random(3)
    texts = ["".join(w + blanks.choice([" "] * 8 + ["  ", "   "]) for w in words[k : k + 40]) for k in range(0, n, 40)]
    return [*texts, "", " ", "   ", " a", "a ", "  a  b  ", "\n", "x" * 2000, "a▁b ▁ c▁", "▁", *[t.rstrip() for t in texts[:9]]]


def test_new_segments_are_joined():
    own = pieces.Pieces(pieces.model_path())
    own.library = Counting(own.library)
    words = [f"wörd{k}x" for k in range(5000)]
    ids, back, _ = own.encode_both([" ".join(words)])
    assert back == [" ".join(words)] and len(own.library.taken) < 200
    assert all(own.known["▁" + w] for w in words)


def test_joined_as_single():
    path, texts = pieces.model_path(), made_texts(20_000)
    joined, single = pieces.Pieces(path).compare(path), pieces.Pieces(path).compare(path)
    assert joined.joins
    single.joins = False
    a, b = joined.encode_both(texts), single.encode_both(texts)
    assert all(np.array_equal(x, y) for x, y in zip(a[0], b[0], strict=True)) and a[1:] == b[1:] and all(a[2])
    assert (joined.known, joined.odd) == (single.known, single.odd)
    assert [x.tolist() for x in a[0]] == joined.theirs.encode(texts)
    assert [t == x for t, x in zip(a[1], texts, strict=True)] == ["▁" not in t for t in texts]


def test_a_blank_at_the_end_is_no_difference(tmp_path):
    for path in (pieces.model_path(), unigram_model(tmp_path / "u.model")):
        texts = ["the ", "a  ", " ", "  ", "", "the they "]
        own = pieces.Pieces(path).compare(path)
        ids, _, same = own.encode_both(texts)
        assert [x.tolist() for x in ids] == own.theirs.encode(texts) and same == [True] * 6


def test_a_difference_is_told_of_its_segment_alone():
    own = pieces.Pieces(pieces.model_path()).compare(pieces.model_path())
    own.theirs = Differing(own.theirs, "qqz")
    assert own.encode_both(["one two", "three qqz four", "four five", "qqz"])[2] == [True, False, True, False]
    assert own.bad == {"▁qqz"}


def test_an_odd_decoding_is_told_of_its_segment_alone():
    own = pieces.Pieces(pieces.model_path())
    decode = own.library.decode_batch
    own.library = Counting(own.library)
    own.library.decode_batch = lambda ids, **kw: [t.replace("qqz", "?") for t in decode(ids, **kw)]
    assert own.encode_both(["one two", "three qqz four", "qqz"])[1] == ["one two", "three ? four", "?"] and list(own.odd) == ["▁qqz"]


def test_what_is_still_met_is_not_forgotten(monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBER", 3000)
    own = pieces.Pieces(pieces.model_path()).compare(pieces.model_path())
    own.theirs, own.library = Differing(own.theirs, "qqz"), Counting(own.library)
    for k in range(60):
        ids, back, same = own.encode_both([f"often met {' '.join(f'{k}n{j}' for j in range(100))} ▁ qqz"])
        assert same == [False] and back[0].endswith("   qqz")
        assert len(own.known) + len(own.before) < 2000
        first = first if k else len(own.library.taken)
    assert not any("often" in x or "qqz" in x for x in own.library.taken[first:])


def test_long_segments_are_not_kept(monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBER", 3000)
    monkeypatch.setattr(pieces, "CUT", 100)
    own = pieces.Pieces(pieces.model_path())
    for text in ("short " + "x" * 5000, "next one", "short"):
        assert own.encode_both([text])[1] == [text]
    assert max(map(len, [*own.known, *own.before])) <= 100 and "▁short" in own.before


def test_models_that_are_not_joined(tmp_path):
    own = pieces.Pieces(unigram_model(tmp_path / "u.model"))
    assert not own.joins and own.encode_both(["the they a", "a  b "])[1] == ["the they a", "a  b "]
