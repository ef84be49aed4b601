"""Queries over small tables that differ from the given ones, against their SQL."""

import random
from dataclasses import replace

import duckdb
from pyspark.sql import functions as F

from veilspark import catalog
from veilspark.operators import lists
from veilspark.operators.countries import CRYPTO
from veilspark.operators.nested import field_findings
from veilspark.operators.recognizers import Registry
from veilspark.operators.scan import FLAGS, scan
from veilspark.operators.structured import column_entities


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def oracle(query, **tables):
    with duckdb.connect() as c:
        for name, path in tables.items():
            c.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}/*.parquet')")
        return sorted(c.execute(catalog.ORACLES[query]).fetchall(), key=str)


def test_emails_next_to_each_other(spark, tmp_path):
    rng = random.Random(1)
    parts = ["ab.1@mail.example.com", "c@d-e.org", "F_g+h@i.co.uk", " ", "  ", "\n", ", ", " é ", " word ", "\U0001f600 "]
    texts = ["a@b.com c@d.com", "a@b.com  a@b.com\nc@d.com", "", None, "x " * 511 + "a@b.com c@d.com " + "y" * 900]
    texts += [" ".join(rng.choice(parts) for _ in range(rng.choice([3, 9, 300]))) for _ in range(60)]
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(path)
    assert rows(catalog.QUERIES["email_replaced"](spark, str(tmp_path))) == oracle("email_replaced", documents=path)


def tasks(frame, found):
    """How many tasks make rows of a frame that has a column by which they are told apart."""
    return frame.select(F.spark_partition_id().alias("p"), found).distinct().select("p").distinct().count()


def test_short_values_of_one_file_are_spread(spark):
    one = spark.createDataFrame([(i, f"u{i}@example.com") for i in range(200)], "id int, mail string").coalesce(1)
    assert tasks(field_findings(one, ["id"], entities=["EMAIL_ADDRESS"]), "id") > 4


def test_cells_that_repeat_are_counted(spark):
    cells = [("10.0.0.1",)] * 50 + [(f"u{i}@example.com",) for i in range(60)] + [(None,)] * 200
    df = spark.createDataFrame(cells, "c string").coalesce(1)
    got = column_entities(df, entities=["EMAIL_ADDRESS", "IP_ADDRESS"])
    assert [tuple(r) for r in got.collect()] == [("c", "EMAIL_ADDRESS", 60 / 110)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan or "Repartition " in plan


def found(spark, name, texts, flags=FLAGS):
    r = next(r for r in Registry(all_of_them=True).recognizers if r.name == name)
    df = spark.createDataFrame(list(enumerate(texts)), "n int, text string")
    both = df.select("n", F.size(scan(F.col("text"), [r], flags)).alias("gated"), F.size(scan(F.col("text"), [replace(r, gate="")], flags)).alias("plain")).collect()
    return {x.n: x.gated for x in both if x.gated == x.plain}


def test_gates_leave_out_no_match(spark):
    rng = random.Random(5)
    dates = ["1/2/2020", "2020-01-02", "1.2.20", "3-JAN-2020", "jan-20", "12-dec", "1/20", "x", " ", "٣/٤/2020", "."]
    texts = ["".join(rng.choice(dates) for _ in range(rng.choice([1, 2, 6]))) for _ in range(300)]
    assert len(found(spark, "DateRecognizer", texts)) == len(texts)
    letters = spark.createDataFrame([(chr(c) * 26,) for c in range(0x3000)], "t string")
    assert letters.where(F.rlike("t", F.lit("(?iU)[a-z0-9]{26}")) & ~F.rlike("t", F.lit(CRYPTO.gate))).count() == 0
    claims = ["claim # 1234567 x", "claim number: CLM-123456", "CLM-123456", "claim 12345", "claims 1234567", "medical  claim 123456789012"]
    assert found(spark, "UsClaimNumberRecognizer", claims) == {0: 1, 1: 2, 2: 1, 3: 0, 4: 0, 5: 1}


def test_dear_patterns_are_tried_at_numbers_only():
    named = {r.name: r for r in Registry(all_of_them=True).recognizers}
    for name in ("UsPriorAuthorizationNumberRecognizer", "UsClaimNumberRecognizer", "UsPrescriptionNumberRecognizer", "UsReferralNumberRecognizer", "UsProviderTaxIdRecognizer"):
        assert named[name].gate != r"\p{Nd}"
        assert all(p.startswith("(?=") for p, _ in named[name].patterns if "(?<=" in p)


def test_words_of_texts_stay_where_they_are_for_short_lists(spark):
    df = spark.createDataFrame([(1, "New York, new york"), (2, "york new")], "k int, text string")
    got = lists.by_rare_word(df, "text", ["k"], spark.createDataFrame([("new york",)], "term string"))
    assert rows(got) == [(1, "new york", 0, 8), (1, "new york", 10, 18)]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("strategy=broadcast") == 2 + 1  # the counts are also part of the second side
