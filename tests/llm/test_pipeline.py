import random

import pytest

import corpus_pipeline
from veilspark.llm import decontam
from veilspark.llm.common import materialize, table

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, DATA, "documents")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, DATA), name)
        n = docs.count()
        assert 0 < n <= before
        before = n
        if name != "token_ids":
            assert docs.columns == columns
        if name == "decontaminate":
            assert decontam.digest(docs, table(spark, DATA, "benchmark")).where("contaminated").count() == 0
    assert docs.where("not round_trip or not parity").count() == 0


def test_near_duplicates_of_repeated_and_null_ids(spark):
    a, b, c, d, e = (" ".join(f"{w}{i}" for i in range(40)) for w in "abcde")
    rows = [(1, a), (1, b), (2, b), (3, a), (1, c), (None, d), (None, d), (None, c), (4, e), (4, e), (None, None)]
    got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), DATA).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, a), (1, b), (1, c), (None, d), (4, e), (None, None)], key=str)


def prose(seed, n=60):
    """English-like words that no other seed has."""
    rng = random.Random(seed)
    return " ".join(rng.choice(["the", "of", "and", "to", "in"]) if k % 2 else "".join(rng.choices("etaoinshr", k=6)) for k in range(n))


#: The names operators use inside or give to their own columns, in other cases too.
CLASHING = ["score", "LANG_PRED", "run_id", "runs", "c0", "Kept_Text", "n_removed", "_id", "_th", "fp", "id", "th", "w", "n_tokens", "ids", "found", "best_id", "held_out"]


@pytest.fixture
def awkward(spark):
    """Rows of every awkward kind, with columns of clashing names, null everywhere in some."""
    item = table(spark, DATA, "benchmark").where("text is not null").first().text
    rows = [(i, prose(i), "en") for i in range(20)]
    rows += [(20, None, "en"), (21, "", "en"), (22, "12 345", None), (None, prose(22), None), (None, None, None)]
    rows += [(1, prose(1), "en"), (1, prose(23), "en"), (24, prose(24, 20_000), "en"), (25, prose(25) + " " + item, "en")]
    kinds = "doc_id long, text string, lang string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), *[None if r[0] is None else c for c in CLASHING]) for r in rows], kinds), item


def key(r):
    return (str(r.doc_id), str(r.text))


def test_stages_on_awkward_rows(spark, awkward):
    docs, item = awkward
    rows = docs.collect()
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        kept[name] = materialize(out, name).collect()
        for r in kept[name]:
            assert [r[c] for c in CLASHING] == [None if r.doc_id is None else c for c in CLASHING]
        assert stage(spark, docs.limit(0), DATA).count() == 0
    has_letter = [r for r in rows if r.text and any(x.isalpha() for x in r.text)]
    assert sorted(map(key, kept["language_id"])) == sorted(map(key, has_letter))
    near = {key(r) for r in rows} - {("20", "None"), ("None", "None")} - {("21", ""), ("22", "12 345")}
    assert {("20", "None")} | near <= {key(r) for r in kept["near_duplicates"]} and len(kept["near_duplicates"]) == len({key(r) for r in kept["near_duplicates"]})
    twice = prose(1)
    assert sorted(map(key, kept["repeated_passages"])) == sorted(key(r) for r in rows if r.text != twice)
    assert sorted(map(key, kept["decontaminate"])) == sorted(key(r) for r in rows if not r.text or item not in r.text)
    out = materialize(corpus_pipeline.token_ids(spark, docs, DATA), "ids")
    assert out.count() == len(rows) and out.where("not round_trip or not parity").count() == 0
    assert corpus_pipeline.token_ids(spark, docs.limit(0), DATA).count() == 0


def test_language_id_without_labels(spark):
    df = spark.createDataFrame([(1, "abc", None), (2, "½ ²", None), (3, None, None)], "doc_id long, text string, lang string")
    assert [r.doc_id for r in corpus_pipeline.language_id(spark, df, DATA).collect()] == [1]
