"""What a model learns from, and is compared on, whatever ids and normalisers are like."""

import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import field, unigram_model
from veilspark.llm import langid, pieces


@pytest.mark.parametrize("doc_id", ["cast(null as long)", "cast(3 as long)", "cast(7 as long)", "doc_id"])
def test_language_sample_with_any_ids(spark, doc_id):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("doc_id", F.expr(doc_id))
    model = langid.learn(df, rows=60)  # far fewer than there are of any language
    got = langid.predict(df, model).where("lang is not null and lang_pred <> 'und'").groupBy("lang").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("right")).collect()
    assert len(got) == 4 and all(r.right > 0.97 for r in got)


def test_language_sample_with_many_copies(spark):
    rows = [(None, "the of and to", "en")] * 3000 + [(1, "le la des que", "fr")] * 3000 + [(k, f"der die das {k}", "de") for k in range(9)]
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), rows=20)
    assert model.langs == ["de", "en", "fr"]
    got = langid.predict(spark.createDataFrame([(1, "la que"), (2, "of the"), (3, "die das")], "doc_id long, text string"), model).collect()
    assert [r.lang_pred for r in sorted(got)] == ["fr", "en", "de"]


def test_parity_of_models_with_a_normaliser_is_tested(spark, tmp_path, monkeypatch):
    path = tmp_path / "s.model"
    unigram_model(path)
    path.write_bytes(path.read_bytes() + field(3, field(4, 1)))  # blanks are squeezed
    texts = ["the  they ", "  a", "ab", "", "they"]
    own = pieces.Pieces(str(path)).compare(str(path))
    assert own.spec.squeeze and own.encode_both(texts)[2] == [True] * 5
    monkeypatch.setattr(pieces.Pieces, "normalise", lambda self, t: "▁" + t.replace(" ", "▁"))  # what it must not do
    assert own.encode_both(texts)[2] == [False, False, True, False, True]
