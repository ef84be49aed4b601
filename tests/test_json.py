import json

import pytest
from pyspark.sql import functions as F

from veilspark.operators import json_paths as J

ROWS = [
    '{"a": {"b": "bob@example.com", "n": 12}, "list": [{"m": "x@y.org"}, "z@y.org", null], "dotted.key": "k@y.org", "t": true}',
    '["eve@example.com", {"deep": [[["d@e.org"]]]}]', '"s@t.org"', "{}", "[]", "no json", None, '{"a": 5}', '{"a": "{\\"x\\": 1}"}',
]


def brute(v, path="$"):
    if isinstance(v, dict):
        return [x for k in v for x in brute(v[k], path + (f".{k}" if not set(k) & set(".[]'") else f"['{k}']"))]
    if isinstance(v, list):
        return [x for i, e in enumerate(v) for x in brute(e, f"{path}[{i}]")]
    return [(path, None if v is None else v if isinstance(v, str) else json.dumps(v))]


def test_leaves(spark):
    got = spark.createDataFrame(list(enumerate(ROWS)), "k int, t string").select("k", J.leaves(F.col("t")).alias("l")).collect()
    for r in got:
        try:
            want = brute(json.loads(ROWS[r.k])) if ROWS[r.k] is not None else []
        except ValueError:
            want = []
        assert sorted(((x.path, x.value) for x in r.l), key=str) == sorted(want, key=str)
    shallow = spark.createDataFrame([(ROWS[1],)], "t string").select(J.leaves(F.col("t"), depth=1).alias("l")).first().l
    assert [tuple(x) for x in shallow] == [("$[0]", "eve@example.com"), ("$[1]", '{"deep":[[["d@e.org"]]]}')]


def test_findings_in_json(spark):
    df = spark.createDataFrame(list(enumerate(ROWS)), "k int, t string")
    got = J.json_findings(df, "t", ["k"], skip=["$.list[*].m", "$[1].deep"], entities=["EMAIL_ADDRESS"])
    assert sorted((r.k, r.path) for r in got.collect()) == [(0, "$.a.b"), (0, "$.list[1]"), (0, "$['dotted.key']"), (1, "$[0]"), (2, "$")]


def test_values_replaced_by_path(spark):
    hide = lambda v: F.concat(F.lit("<"), F.length(v).cast("string"), F.lit(">"))
    changes = {"$.a.b": hide, "$.list[*].m": hide, "$['dotted.key']": hide, "$[1].deep[0][0][0]": hide, "$.none": hide, "$.a": hide}
    got = [r.t for r in spark.createDataFrame([(t,) for t in ROWS], "t string").select(J.replaced(F.col("t"), changes).alias("t")).collect()]
    want = [json.loads(t) if t and t != "no json" else t for t in ROWS]
    want[0]["a"]["b"], want[0]["list"][0]["m"], want[0]["dotted.key"] = "<15>", "<7>", "<7>"
    want[1][1]["deep"][0][0][0] = "<7>"
    want[7]["a"], want[8]["a"] = "<1>", "<8>"
    assert [json.loads(t) if t and t != "no json" else t for t in got] == want
    for bad in ("a.b", "$.", "$[x]", "$a"):
        with pytest.raises(ValueError, match="no path"):
            J.parts(bad)
