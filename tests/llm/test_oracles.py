import duckdb
import pytest

from veilspark.llm.oracles import ORACLES
from veilspark.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.execute(ORACLES[name])
    columns = sorted(c[0] for c in want.description)
    got = QUERIES[name](spark, DATA)
    assert sorted(got.columns) == columns
    order = [[c[0] for c in want.description].index(c) for c in columns]
    key = lambda r: tuple((v is not None, v) for v in r)
    assert sorted((tuple(r) for r in got.select(*columns).collect()), key=key) == sorted((tuple(r[i] for i in order) for r in want.fetchall()), key=key)
