import pandas as pd
from pyspark.sql import functions as F

from veilspark.operators.scan import Recognizer
from veilspark.streaming.sessions import numberer, restored, session_pseudonyms, session_stream

NAMES = Recognizer("Names", "NAME", ((r"\b[A-Z][a-z]+\b", 0.6),), gate="[A-Z]")
OPTIONS = {"entities": ["NAME", "EMAIL_ADDRESS"], "ad_hoc": [NAMES], "flags": "(?U)"}
TURNS = [
    (1, 0, "Ann met Bob and Ann"), (1, 1, "bob@example.com is not Bob's, Cat"), (1, 2, "nothing"), (1, 3, "Cat, bob@example.com and Dan"),
    (2, 0, "Bob, Ann"), (2, 1, None), (2, 2, ""), (None, 0, "Eve and Ann"), (None, 1, "Eve"),
]
WANT = {
    (1, 0): "<NAME_0> met <NAME_1> and <NAME_0>", (1, 1): "<EMAIL_ADDRESS_0> is not <NAME_1>'s, <NAME_2>", (1, 2): "nothing", (1, 3): "<NAME_2>, <EMAIL_ADDRESS_0> and <NAME_3>",
    (2, 0): "<NAME_0>, <NAME_1>", (2, 1): None, (2, 2): "", (None, 0): "<NAME_0> and <NAME_1>", (None, 1): "<NAME_0>",
}


def test_sessions_of_a_table(spark):
    df = spark.createDataFrame([(*t, "x") for t in TURNS], "conv int, turn int, text string, n string")
    out = session_pseudonyms(df, "conv", "turn", "text", **OPTIONS)
    assert {(r.conv, r.turn): r.text for r in out.collect()} == WANT
    back = out.select("conv", "turn", restored(F.col("text"), F.col("numbered")).alias("text"))
    assert {(r.conv, r.turn): r.text for r in back.collect()} == {t[:2]: t[2] for t in TURNS}
    assert session_pseudonyms(df.limit(0), "conv", "turn", "text", **OPTIONS).count() == 0


def test_stream_equals_table(spark, tmp_path):
    """Conversations that come turn by turn, in batches, are numbered as the whole table is."""
    table = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").where("conv_id < 4")
    source = str(tmp_path / "in")
    for turns in ("turn < 2", "turn >= 2 and turn < 4", "turn >= 4"):
        table.where(turns).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(table.schema).parquet(source)
        out = session_stream(stream, "conv_id", "turn", "text", idle_minutes=None, **OPTIONS)
        q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
        assert q.awaitTermination(100) and q.exception() is None
    got = spark.read.parquet(str(tmp_path / "out"))
    want = session_pseudonyms(table, "conv_id", "turn", "text", **OPTIONS)
    key = lambda df: sorted((r.conv_id, r.turn, r.text) for r in df.collect())
    assert key(got) == key(want) and got.where("text like '%<NAME_1>%'").count() > 0
    back = got.select("conv_id", "turn", restored(F.col("text"), F.col("numbered")).alias("text"))
    assert key(back) == key(table)


class Session:
    """A session's state as the engine gives it."""

    hasTimedOut, exists, get, wait = False, False, None, None

    def update(self, value):
        self.exists, self.get = True, value

    def remove(self):
        self.exists, self.get = False, None

    def setTimeoutDuration(self, ms):  # noqa: N802
        self.wait = ms


def test_idle_sessions_are_forgotten():
    found = lambda *values: [{"entity_type": "A", "start": 0, "end": 1, "score": 1.0, "found": v} for v in values]
    run, state = numberer(["turn"], "turn", 5000), Session()
    turns = lambda *rows: iter([pd.DataFrame([{"turn": t, "_found": f} for t, f in rows])])
    numbers = lambda out: [[f["n"] for f in fs] for r in out for fs in r["numbered"]]
    assert numbers(run((1,), turns((2, found("y", "x")), (1, found("x"))), state)) == [[0], [1, 0]] and state.wait == 5000
    assert numbers(run((1,), turns((3, found("z", "y"))), state)) == [[2, 1]]
    state.hasTimedOut = True
    assert list(run((1,), iter([]), state)) == [] and not state.exists
    state.hasTimedOut = False
    assert numbers(run((1,), turns((4, found("y"))), state)) == [[0]]
