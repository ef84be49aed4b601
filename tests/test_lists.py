import random
import re

import pytest
from pyspark.sql import functions as F

from veilspark.operators import lists
from veilspark.operators.provider import answers, provided

TERMS = ["new york", "York", "c++", "a", "b-a", "é a", "nowhere", "a b", "İx", "a", None, "", "b's"]


def brute(rows, terms):
    out = []
    for k, text in rows:
        for t in {x.lower() for x in terms if x}:
            for at in range(len(text or "")):
                if text[at : at + len(t)].lower() == t and not (at and re.match(r"\w", text[at - 1])) and not re.match(r"\w", text[at + len(t) : at + len(t) + 1]):
                    out.append((k, t, at, at + len(t)))
    return sorted(out, key=str)


@pytest.mark.parametrize("few", [1000, 0])
def test_terms_of_a_table(spark, few):
    rng = random.Random(4)
    rows = [(k, "".join(rng.choice(["a", "b", " ", "-", "New York", "york", "C++", "é", "'s", "_", "\n"]) for _ in range(rng.choice([0, 3, 40, 900])))) for k in range(60)]
    rows += [(100, None), (None, "a new YORK b"), (101, "a " * 2000)]
    terms = [t for t in TERMS if t != "İx"]
    df = spark.createDataFrame([(k, t, "x") for k, t in rows], "k int, text string, term string").repartition(3)
    got = lists.list_findings(df, "text", ["k"], spark.createDataFrame([(t,) for t in terms], "term string"), "NAME", 0.5, few=few)
    assert sorted(((r.k, r.term, r.start, r.end) for r in got.collect()), key=str) == brute(rows, terms)
    assert {(r.entity_type, r.score) for r in got.collect()} == {("NAME", 0.5)}
    none = lists.list_findings(df, "text", ["k"], spark.createDataFrame([], "term string"), "NAME", few=few)
    assert none.count() == 0


LISTS = [["a", "b c", "B  c, d", "𐐀 a", "c++", "é-a b", "οδος", "οδοσ'a b", "a" * 12 + " b", "d e f g h i", "d e f", "d οδοσ'a b c", "abc οδοσ'ab c", "d e f g h j"], ["- a", "(a) b", "..b", "b", "a b c"], ["a b", "b a", "a-b"], ["a", "é"], []]


@pytest.mark.parametrize("words", [500_000, 0])
@pytest.mark.parametrize("size", [5, 64, 256])
def test_terms_at_the_borders_of_pieces(spark, monkeypatch, size, words):
    """Broadcast or shuffled, with terms of one word and of more, that begin with other characters than words' and that are too long for pieces."""
    monkeypatch.setattr(lists, "PIECE", size)
    monkeypatch.setattr(lists, "SHORT", 10)
    monkeypatch.setattr(lists, "WORDS", words)
    rng = random.Random(size)
    some = ["a", "b", "B", "c", "A", "é", "𐐀", " ", " ", " ", "-", "- ", ", ", "++", "(", ") ", "..", "\n", "d e f g h i", "ΟΔΟΣ", "ΟΔΟΣ'A", "a" * 12 + " ", ""]
    rows = [(k, "".join(rng.choice(some) for _ in range(rng.choice([1, 2, 7, 60, 500])))) for k in range(40)]
    rows += [(100, None), (101, ""), (102, "a"), (None, "a b a b"), (103, "a" * size + " b " + "a" * (size - 1) + " b c"), (104, "x" * 700 + " a b"), (105, " " * (size - 1) + "a b"), (106, "d ΟΔΟΣ'A b c, abc ΟΔΟΣ'Ab c")]
    df = spark.createDataFrame(rows, "k int, text string").repartition(3)
    for terms in LISTS:
        got = lists.list_findings(df, "text", ["k"], spark.createDataFrame([(t,) for t in terms], "term string"), "X", few=0)
        assert sorted(((r.k, r.term, r.start, r.end) for r in got.collect()), key=str) == brute(rows, terms)


def test_texts_and_candidates_are_not_shuffled(spark):
    """Of a list that is broadcast only findings leave their tasks; the candidates of frequent words, and the texts, once took many times the input's room."""
    df = spark.createDataFrame([(1, "a b a c a d " * 50), (2, "A B")], "k int, text string")
    terms = spark.createDataFrame([(f"a {w}",) for w in ("b", "x", "y", "z")], "term string")
    got = lists.list_findings(df, "text", ["k"], terms, "X", few=0).groupBy("k").count()
    assert sorted(map(tuple, got.collect())) == [(1, 50), (2, 1)]
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning(k#") == 1 and "partial_count" in plan and "collect_list" not in plan and "SortMergeJoin" not in plan


def test_long_terms_are_looked_for_by_their_beginnings(spark):
    """Words of the texts were shuffled for terms of more than SHORT characters, if their list was not broadcast."""
    long = "one two three " * 12 + "end"
    df = spark.createDataFrame([(1, "x " + long.upper() + " one"), (2, long + "s"), (3, "one two three")], "k int, text string")
    got = lists.list_findings(df, "text", ["k"], spark.createDataFrame([(long,), ("One two",)], "term string"), "X", few=0)
    assert sorted((r.k, r.start, r.end) for r in got.collect() if r.term == long) == [(1, 2, 2 + len(long))]
    assert sum(r.term == "one two" for r in got.collect()) == 12 + 12 + 1
    assert "row_number" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_terms_without_a_word(spark):
    df = spark.createDataFrame([(1, "a")], "k int, text string")
    with pytest.raises(Exception, match="no word"):
        lists.list_findings(df, "text", ["k"], spark.createDataFrame([("$$",)], "term string"), "X").count()


def test_allowed_findings(spark):
    found = spark.createDataFrame([(1, "a@b.org"), (2, "C@d.org"), (3, "e@f.org")], "k int, found string")
    allowed = spark.createDataFrame([("c@d.org",), ("a@b.org",), (None,)], "term string")
    assert sorted(r.k for r in lists.without_allowed(found, allowed).collect()) == [2, 3]
    assert [r.k for r in lists.without_allowed(found, allowed, any_case=True).collect()] == [3]


def capitals(texts):
    if any("BOOM" in t for t in texts):
        raise RuntimeError("no answer")
    return [[{"entity_type": "CAPS", "start": m.start(), "end": m.end(), "score": 0.6} for m in re.finditer("[A-Z]{2,}", t)] for t in texts]


def test_provider(spark):
    rows = [(1, "an IBM box"), (2, "BOOM"), (3, None), (4, ""), (5, "x" * 3000 + " NASA")]
    df = spark.createDataFrame([(k, t, "old") for k, t in rows], "k int, text string, error string").coalesce(1)
    got = {r.k: r for r in provided(df, "text", capitals, "caps").collect()}
    assert [(s.entity_type, s.start, s.end, s.recognizer) for s in got[1].spans] == [("CAPS", 3, 6, "caps")]
    assert got[2].spans == [] and got[2].error == "RuntimeError: no answer" and all(got[k].error is None for k in (1, 3, 4, 5))
    assert got[3].spans == [] and got[5].spans[0].start == 3001
    opened = provided(df, "text", None, "caps", open_=lambda: capitals)
    assert opened.where("error is not null").count() == 1


def test_provider_calls():
    asked = []

    def fn(texts):
        asked.append(len(texts))
        return [[{"entity_type": "A", "start": 0, "end": 99 if t == "bad" else 1, "score": 1}] for t in texts]

    spans, errors = answers(fn, ["aa", "bb", "bad", "cc"], "r", most=3)
    assert asked == [3, 1, 1, 1, 1] and [len(s) for s in spans] == [1, 1, 0, 1] and "does not fit" in errors[2]
    assert answers(lambda t: [], ["a"], "r")[1] == ["ValueError: 0 answers to 1 texts"]
    assert answers(lambda t: [[{"start": 0}]], ["a"], "r")[1] == ["ValueError: a span has no entity_type"]


def test_checks_of_three_recognizers(spark):
    from veilspark.operators.analyze import analyze
    from veilspark.operators.recognizers import Registry

    def of(text, kind):
        return [(s.start, s.end, round(s.score, 6)) for s in spark.createDataFrame([(text,)], "t string").select(analyze(F.col("t"), registry=Registry(all_of_them=True), entities=[kind]).alias("s")).first().s]

    assert of("1234567893", "US_NPI") == [(0, 10, 1.0)] and of("1234567890", "US_NPI") == [] and of("1111111112", "US_NPI") == []
    assert of("1245-319-599", "US_NPI") == [(0, 12, 1.0)]
    assert of("A12345678", "ZA_PASSPORT") == [(0, 9, 1.0)] and of("B12345678", "ZA_PASSPORT") == []
    assert of("DE136695976", "DE_VAT_ID") == [(0, 11, 1.0)] and of("DE136695977", "DE_VAT_ID")[0][2] == 0.5
