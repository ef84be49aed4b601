import pytest
from pyspark.sql import functions as F

from veilspark.operators.analyze import analyze
from veilspark.operators.phones import REGIONS, phone_recognizer
from veilspark.operators.recognizers import Registry

CASES = [
    ("My US number is (415) 555-0132, and my international one is +1 415 555 0132", [(16, 30), (60, 75)]),
    ("My Israeli number is 09-7625400", [(21, 31)]),
    ("United States: (415)555-0132", [(15, 28)]),
    ("Brazil: +55 11 98456 5666", [(8, 25)]),
    ("My UK number is 020 7946 0958", [(16, 29)]),
    ("ring +44 20 7946 0958 or 0151 496 0123", [(5, 21), (25, 38)]),
    ("Berlin 030 123456 and +49 30 123456", [(7, 17), (22, 35)]),
    ("Delhi 98765 43210", [(6, 17)]),
    ("415-555-0132 415-555-0133", [(0, 12), (13, 25)]),
    ("one is415-555-0132", []),
    ("at 2024-01-31 10:20", []),
    ("card 4012 8888 8888 1881, host 10.0.0.1, ssn 123-45-6789", []),
    ("call 115-555-013 or +1 015 555 0132", []),
    ("far +370 612 34567 and +999", [(4, 18)]),
]


@pytest.fixture(scope="module")
def found(spark):
    texts = [t for t, _ in CASES]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", analyze(F.col("t"), entities=["PHONE_NUMBER"]).alias("s"))
    return {r.k: sorted((s.start, s.end) for s in r.s) for r in df.collect()}


@pytest.mark.parametrize("k", range(len(CASES)))
def test_phone_numbers(found, k):
    assert found[k] == CASES[k][1], CASES[k][0]


def test_other_regions(spark):
    wide = Registry()
    wide.remove("PhoneRecognizer").add(phone_recognizer((*REGIONS, "JP", "CN")))
    of = lambda t, **o: [(s.start, s.end) for s in spark.createDataFrame([(t,)], "t string").select(analyze(F.col("t"), entities=["PHONE_NUMBER"], **o).alias("s")).first().s]
    assert of("Japan 090-1234-5678", registry=wide) == [(6, 19)] and of("China 13812345678", registry=wide) == [(6, 17)]
    assert of("Japan 090-123", registry=wide) == []
    with pytest.raises(ValueError, match="XX"):
        phone_recognizer(("XX",))
