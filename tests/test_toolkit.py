import hashlib
import json
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tests import cases
from veilspark import catalog
from veilspark.functions import checksums as C
from veilspark.operators import boxes
from veilspark.operators.analyze import analyze, chunks, findings, sanitize
from veilspark.operators.nested import field_findings
from veilspark.operators.recognizers import Registry
from veilspark.operators.rewrite import Op, add_operator, anonymize, deanonymize_list, operators, ops_from, remove_operator, rewrite
from veilspark.operators.scan import SPAN, deny_list
from veilspark.operators.structured import column_entities
from veilspark.sources import readers
from veilspark.streaming.streams import anonymize_stream, windowed_counts

DATA = "/root/testdata/sf0.001"


def spans(spark, text, **options):
    return [tuple(s)[:4] for s in spark.createDataFrame([(text,)], "text string").select(analyze(F.col("text"), **options).alias("s")).first().s]


@pytest.mark.parametrize(
    "text, kind, start, end",
    [
        ("card 4012888888881881.", "CREDIT_CARD", 5, 21),
        ("é mail bob@example.co.uk", "EMAIL_ADDRESS", 7, 24),
        ("SSN 078-05-1126", "US_SSN", 4, 15),
        ("call +1 (212) 555-0123", "PHONE_NUMBER", 5, 22),
        ("IBAN GB82 WEST 1234 5698 7654 32", "IBAN_CODE", 5, 32),
        ("at 10.0.0.1 now", "IP_ADDRESS", 3, 11),
    ],
)
def test_found(spark, text, kind, start, end):
    assert (kind, start, end) in [s[:3] for s in spans(spark, text)]


@pytest.mark.parametrize(
    "text, kind, want",
    [
        ("at 2001:db8::1 now", "IP_ADDRESS", [(3, 14, 0.6)]),
        ("fe80::1%eth0", "IP_ADDRESS", [(0, 12, 0.6)]),
        ("::ffff:10.0.0.1", "IP_ADDRESS", [(0, 15, 0.6)]),
        ("64:ff9b::192.0.2.33", "IP_ADDRESS", [(0, 19, 0.6)]),
        ("net 2001:db8::/32", "IP_ADDRESS", [(4, 17, 0.6)]),
        ("1:2:3:4:5:6:7::", "IP_ADDRESS", [(0, 15, 0.6)]),
        ("1:2:3:4:5::1:2:3:10.0.0.1", "IP_ADDRESS", [(17, 25, 0.6)]),
        ("std::vector or 010.0.0.1", "IP_ADDRESS", []),
        ("see example.com/path now", "URL", [(4, 20, 0.5)]),
        ("bob@example.co.uk", "URL", [(4, 17, 0.5)]),
        ("go 'https://example.com/a' on", "URL", [(3, 26, 0.6)]),
        ('the "example.org" page', "URL", [(4, 17, 0.5)]),
        ("at https://www.example.com", "URL", [(3, 26, 0.6)]),
        ("no.9 or a.zzz", "URL", []),
    ],
)
def test_addresses(spark, text, kind, want):
    assert [s[1:] for s in spans(spark, text, entities=[kind])] == want


def test_not_found(spark):
    assert not [s for s in spans(spark, "card 4012888888881882") if s[0] == "CREDIT_CARD"]
    assert spans(spark, None) == [] and spans(spark, "") == []
    with pytest.raises(ValueError):
        Registry().chosen(["NO_SUCH"])


def test_threshold_and_context(spark):
    assert spans(spark, "my ssn 123-45-6780", entities=["US_SSN"])[0][3] == pytest.approx(0.85)
    assert spans(spark, "my number 123-45-6780", entities=["US_SSN"], threshold=0.6) == []


def test_checks(spark):
    row = spark.range(1).select(C.mod97(F.lit("GB82WEST12345698765432")).alias("a"), C.verhoeff(F.lit("2363")).alias("b"), C.verhoeff(F.lit("2364")).alias("c"), C.luhn(F.lit("79927398713")).alias("d")).first()
    assert tuple(row) == (True, True, False, True)


def test_rewrite(spark):
    df = spark.createDataFrame([("a bob@example.com b",), (None,)], "text string")
    out = [r.r for r in df.select(anonymize(F.col("text"), analyze(F.col("text")), {"EMAIL_ADDRESS": Op("mask", {"masking_char": "*", "chars_to_mask": 3, "from_end": False})}).alias("r")).collect()]
    assert out[0].text == "a ***@example.com b" and (out[0]["items"][0].start, out[0]["items"][0].end) == (2, 17) and out[1] is None


def test_chunks(spark):
    text = "word " * 200
    got = spark.createDataFrame([(text,)], "t string").select(chunks(F.col("t")).alias("c")).first().c
    assert got[0].start == 0 and got[-1].end == len(text) and all(a.end > b.start for a, b in zip(got, got[1:]))


def test_chunks_by_brute_force(spark):
    def slow(t, size, overlap):
        out, at = [], 0
        while at < len(t):
            end = next((i for i in range(min(at + size, len(t)), len(t)) if t[i] in " \n"), len(t))
            out.append((at, end))
            at = len(t) if end == len(t) else next((i for i in range(end - overlap, end) if t[i] in " \n"), end)
        return out

    texts = ["", "x" * 700, "ä€😀 bc\ndefgh i " * 40, " " * 300, "word " * 200, "y" * 250 + " z"]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    for size, overlap in ((250, 50), (10, 3), (7, 0)):
        got = [[tuple(c) for c in r.c] for r in df.select(chunks(F.col("t"), size, overlap).alias("c")).collect()]
        assert got == [*[slow(t, size, overlap) for t in texts], []]


def test_span_algebra(spark):
    rows = {r.name: r for r in cases.QUERIES["span_algebra"](spark, DATA).collect()}
    assert rows["contained"].contained == "A:2-5:0.9 A:0-10:0.5 B:2-5:0.1"
    assert rows["overlap"].merged == "A:0-8:0.7 A:8-9:0.2 B:6-12:0.6"
    assert rows["overlap"].remove_intersections == "A:0-8:0.7 B:8-12:0.6"
    assert rows["equal"].covered == "B:0-4:0.8"


@pytest.mark.parametrize("name", sorted(catalog.ORACLES | cases.ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "customer", "events", "conversations", "lineitem", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.execute((catalog.ORACLES | cases.ORACLES)[name]).fetchdf()
    got = (catalog.QUERIES | cases.QUERIES)[name](spark, DATA).toPandas()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    key = lambda df: sorted(map(str, df[cols].astype(str).itertuples(index=False)))
    assert key(got) == key(want)


def test_without_sql():
    assert set(catalog.QUERIES) - set(catalog.ORACLES) == {"anonymize_documents", "document_findings", "all_countries"}


def test_document_findings(spark):
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = catalog.QUERIES["document_findings"](spark, DATA).collect()
    assert got and all(text[r.doc_id][r.start : r.end] == r.found and 0 < r.score <= 1 for r in got)
    assert len({(r.doc_id, r.entity_type, r.start, r.end) for r in got}) == len(got)
    mails = {(i, m.start(), m.end()) for i, t in text.items() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", t)}
    assert {(r.doc_id, r.start, r.end) for r in got if r.entity_type == "EMAIL_ADDRESS"} == mails


def test_anonymize_documents(spark):
    """What is left between the replacements is the text's own, in order, and no address or number of the mapped types is."""
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = catalog.QUERIES["anonymize_documents"](spark, DATA).collect()
    assert len(got) == len(text) and sum(r.n_items for r in got) > 0
    for r in got:
        assert r.n_items or r.text == text[r.doc_id]
        assert not re.search(r"\w@[a-z]+\.[a-z]", r.text)


def test_all_countries(spark):
    kinds = {r.entity_type: r for r in catalog.QUERIES["all_countries"](spark, DATA).collect()}
    assert {"EMAIL_ADDRESS", "IP_ADDRESS"} <= set(kinds) and all(r.n > 0 and 0.3 <= r.top <= 1 for r in kinds.values())


def test_spans_that_do_not_fit(spark):
    for start, end in ((-1, 2), (3, 2), (0, 99)):
        df = spark.createDataFrame([("abc", [("A", start, end, 0.5, "r")])], f"text string, spans {SPAN}")
        with pytest.raises(Exception, match="does not fit"):
            df.select(rewrite(F.col("text"), F.col("spans"))).collect()


def test_sanitize(spark):
    got = spark.createDataFrame([("a.b-c$",)], "t string").select(sanitize(F.col("t"), [(".", "$1"), ("$", "\\")]).alias("t")).first().t
    assert got == "a\\1b-c\\"


def test_caller_context_needs_terms(spark):
    nothing = deny_list("Colours", "COLOUR", ["red"], 0.4)
    assert spans(spark, "red", entities=["COLOUR"], ad_hoc=[nothing], context=["colour"])[0][3] == pytest.approx(0.4)
    far = "ssn " + "word " * 300 + "123-45-6780"
    assert spans(spark, far, entities=["US_SSN"])[0][3] == pytest.approx(0.5)
    assert spans(spark, "ssn" + " of the" * 300 + " 123-45-6780", entities=["US_SSN"])[0][3] == pytest.approx(0.85)


def test_nested_values(spark):
    df = spark.createDataFrame([(1, ("a@b.org", [], None), 0, "a@b.org"), (2, None, None, "")], "id int, body struct<mail:string,tags:array<string>,n:int>, zero int, last string")
    found = {(r.id, r.path, r.element): len(r.spans) for r in field_findings(df, ["id"], skip=["last"], entities=["EMAIL_ADDRESS"]).collect()}
    assert found == {(i, p, None): int((i, p) == (1, "body.mail")) for i in (1, 2) for p in ("body.mail", "body.n", "zero", "last")}
    with pytest.raises(ValueError):
        field_findings(spark.createDataFrame([(1, [(2,)])], "id int, x array<struct<y:int>>"), ["id"])


def test_matching_boxes(spark):
    import random

    rng, kind = random.Random(1), "image int, left int, top int, width int, height int"
    made = [[(rng.randrange(3), rng.randrange(300), rng.randrange(300), rng.randrange(9, 70), 20) for _ in range(60)] for _ in range(2)]
    got = boxes.matched(*[spark.createDataFrame(m, kind) for m in made]).collect()
    want = sorted((a, b) for a in made[0] for b in made[1] if a[0] == b[0] and all(abs(x - y) <= 50 for x, y in zip(a[1:], b[1:], strict=True)))
    assert sorted((tuple(r.f), tuple(r.t)) for r in got) == want


def test_strategies(spark):
    """A column's entity by count, by best score, and mixed; ties go to the first by name."""
    low, high = deny_list("Low", "LOW", ["ann", "bob"], 0.4), deny_list("High", "HIGH", ["eve"], 0.9)
    df = spark.createDataFrame([("ann", "eve", "x"), ("bob", "ann", "y"), ("eve", None, "z")], "a string, b string, c string")
    got = lambda **k: {r.column: (r.entity_type, round(r.score, 6)) for r in column_entities(df, entities=["LOW", "HIGH"], ad_hoc=[low, high], **k).collect()}
    assert got() == {"a": ("LOW", 0.666667), "b": ("HIGH", 0.5)}
    assert got(strategy="highest_confidence") == {"a": ("HIGH", 0.9), "b": ("HIGH", 0.9)}
    assert got(strategy="mixed", mixed_threshold=0.95) == {"a": ("LOW", 0.666667), "b": ("HIGH", 0.5)}
    assert got(strategy="mixed") == got(strategy="highest_confidence")


def test_operators(spark):
    text = spark.createDataFrame([("call bob now", [("NAME", 5, 8, 0.5, "r")])], f"text string, spans {SPAN}")
    done = lambda op: text.select(rewrite(F.col("text"), F.col("spans"), {"NAME": op})["text"].alias("t")).first().t
    assert done(Op("keep")) == "call bob now" and done(Op("redact")) == "call  now" and done(Op("replace", {"new_value": "X"})) == "call X now"
    assert done(Op("custom", {"fn": F.upper})) == "call BOB now"
    salt = "0123456789abcdef"
    assert done(Op("hash", {"salt": salt, "hash_type": "sha512"})) == "call " + hashlib.sha512(b"bob" + salt.encode()).hexdigest() + " now"
    assert re.fullmatch("call [0-9a-f]{64} now", done(Op("hash"))) and done(Op("hash")) != done(Op("hash"))
    add_operator("twice", lambda text, kind: F.concat(text, text))
    assert done(Op("twice")) == "call bobbob now"
    remove_operator("twice")
    for bad in (lambda: done(Op("twice")), lambda: remove_operator("twice"), lambda: done(Op("hash", {"salt": "short"})), lambda: done(Op("mask", {"masking_char": "**", "chars_to_mask": 1, "from_end": True})), lambda: done(Op("encrypt", {"key": "short"}))):
        with pytest.raises(ValueError):
            bad()


def test_ignored_paths(spark, tmp_path):
    fits = lambda path, *patterns: spark.range(1).select(readers.ignored(F.lit(path), list(patterns)).alias("x")).first().x
    assert fits("a/b.log", "*.log") and fits("b.log", "*.log") and not fits("a/b.txt", "*.log")
    assert fits("build/x/y", "build/") and not fits("build", "build/") and fits("a/build/x", "build")
    assert fits("doc/a", "/doc/*") and not fits("x/doc/a", "/doc/*") and fits("x/doc/a", "**/doc/*") and fits("a/b/c/z", "a/**/z")
    assert not fits("keep.log", "*.log", "!keep.log") and fits("a1", "a?") and fits("a1", "a[0-9]") and not fits("ab", "a[0-9]")
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.log").write_text("one")
    (tmp_path / "x" / "a.txt").write_text("two")
    assert [r.line for r in readers.read_lines(spark, str(tmp_path), ignore=["*.log"]).collect()] == ["two"]
    assert [r.line for r in readers.read_lines(spark, str(tmp_path), ignore=["/x/*.txt"]).collect()] == ["one"]


def test_settings(spark, tmp_path):
    entries = [{"name": "Zip", "supported_entity": "ZIP", "patterns": [{"name": "zip", "regex": r"\b\d{5}\b", "score": 0.2}], "context": ["zip"], "score_thresholds": {"ZIP": 0.3}}, {"name": "Titles", "supported_entity": "TITLE", "deny_list": ["Mr.", "Mrs."], "supported_language": "en"}]
    (tmp_path / "r.json").write_text(json.dumps({"recognizers": entries}))
    reg = Registry().load_file(str(tmp_path / "r.json"))
    assert {"ZIP", "TITLE"} <= set(reg.entities()) and {"Zip", "Titles"} <= set(reg.names()) and "us" in reg.countries()
    assert [s[:3] for s in spans(spark, "Mr. X, zip 12345", registry=reg, entities=["ZIP", "TITLE"])] == [("TITLE", 0, 3), ("ZIP", 11, 16)]
    assert spans(spark, "code 12345", registry=reg, entities=["ZIP"]) == []
    with pytest.raises(ValueError):
        Registry().load([{**entries[0], "supported_language": "English"}])
    ops = ops_from({"NAME": {"type": "encrypt", "key": "a key of 16 byte"}})
    df = spark.createDataFrame([(["a bob", "none"], [[("NAME", 2, 5, 0.5, "r")], []])], f"texts array<string>, spans array<{SPAN}>")
    hidden = df.select(F.zip_with("texts", "spans", lambda t, s: rewrite(t, s, ops)).alias("h")).select(F.transform("h", lambda x: x["text"]).alias("texts"), F.array(F.col("h")[0]["items"], F.lit(None)).alias("items"))
    back = hidden.select("texts", deanonymize_list(F.col("texts"), F.col("items"), ops_from({"NAME": {"type": "decrypt", "key": "a key of 16 byte"}})).alias("b")).first()
    assert back.texts[0] != "a bob" and [x.text for x in back.b] == ["a bob", "none"]
    assert "mask" in operators() and "decrypt" in operators(reverse=True)


def test_streams(spark, tmp_path):
    """A stream of files gives what the table gives."""
    t = spark.createDataFrame([(f"u{i}@example.com", f"2024-01-01 0{i % 3}:00:00") for i in range(9)], "text string, ts string").select("text", F.col("ts").cast("timestamp").alias("ts"))
    t.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(t.schema).parquet(str(tmp_path / "in"))
    q = anonymize_stream(stream, "text", entities=["EMAIL_ADDRESS"]).writeStream.format("memory").queryName("hidden").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.text for r in spark.table("hidden").collect()} == {"<EMAIL_ADDRESS>"} and spark.table("hidden").count() == 9
    q = windowed_counts(stream, "text", "ts", "1 hour", entities=["EMAIL_ADDRESS"]).writeStream.outputMode("complete").format("memory").queryName("counted").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = windowed_counts(t, "text", "ts", "1 hour", entities=["EMAIL_ADDRESS"])
    assert sorted(map(tuple, spark.table("counted").collect())) == sorted(map(tuple, want.collect())) and want.count() == 3


def test_readers(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"one\r\ntwo bob@example.com\n")
    (tmp_path / "b.bin").write_bytes(bytes(range(32)))
    (tmp_path / "c.csv").write_text("name,mail\nAnn,a@b.org\n")
    (tmp_path / "d.json").write_text('[{"a": {"b": 1}}, {"a": {"b": 2}}]')
    lines = readers.read_lines(spark, str(tmp_path), "a.txt").orderBy("line_no").collect()
    assert [(r.line_no, r.line) for r in lines] == [(1, "one"), (2, "two bob@example.com"), (3, "")]
    assert {r.path.rsplit("/", 1)[1] for r in readers.read_text_files(spark, str(tmp_path)).collect()} == {"a.txt", "c.csv", "d.json"}
    assert [tuple(r) for r in readers.read_csv(spark, str(tmp_path / "c.csv")).collect()] == [("Ann", "a@b.org")]
    assert [r.a.b for r in readers.read_json(spark, str(tmp_path / "d.json")).collect()] == [1, 2]
    found = findings(readers.read_lines(spark, str(tmp_path), "a.txt"), "line", ["path", "line_no"], entities=["EMAIL_ADDRESS"])
    assert readers.report(found, "standard").first().line == "  2:5  error  EMAIL_ADDRESS  (1.00)"


CHECKED = [
    ("CryptoRecognizer", "1BvBMSEYstWetqTFn5Au4m4GFg7xJaNVN2", "1BvBMSEYstWetqTFn5Au4m4GFg7xJaNVN3"),
    ("CryptoRecognizer", "3J98t1WpEZ73CNmQviecrnyiWrnqRhWNLy", "3J98t1WpEZ73CNmQviecrnyiWrnqRhWNLz"),
    ("CryptoRecognizer", "bc1qar0srrr7xfkvy5l643lydnw9re59gtzzwf5mdq", "bc1qar0srrr7xfkvy5l643lydnw9re59gtzzwf5mdp"),
    ("ItFiscalCodeRecognizer", "RSSMRA80A01H501U", "RSSMRA80A01H501A"),
    ("ItVatCodeRecognizer", "00743110157", "00743110158"),
    ("DeHealthInsuranceRecognizer", "A123456780", "A123456781"),
    ("DeSocialSecurityRecognizer", "15070649C103", "15070649C104"),
    ("KrBrnRecognizer", "124-81-00998", "124-81-00997"),
    ("SgUenRecognizer", "53125226D", "53125226A"),
    ("SePersonnummerRecognizer", "811218-9876", "811218-9875"),
    ("MedicalLicenseRecognizer", "BB1388568", "BB1388567"),
    ("InGstinRecognizer", "27AAPFU0939F1ZV", "99AAPFU0939F1ZV"),
    ("ZaDriverLicenseRecognizer", "12345678AB", "123456789012"),
    ("ZaCompanyRegistrationRecognizer", "2010/123456/07", "2099/123456/07"),
    ("UkVehicleRegistrationRecognizer", "AB51 CDE", "AB45 CDE"),
    ("KrDriverLicenseRecognizer", "11-20-123456-78", "27-20-123456-78"),
    ("ZaIdNumberRecognizer", "8001015009087", "8013015009085"),
]


def test_national_checks(spark):
    from veilspark.operators.recognizers import GENERIC, NATIONAL

    by_name = {r.name: r for r in [*GENERIC, *NATIONAL]}
    texts = [(n, t, want) for n, good, bad in CHECKED for t, want in ((good, True), (bad, False)) if t]
    row = spark.createDataFrame([tuple(t for _, t, _ in texts)], ", ".join(f"c{i} string" for i in range(len(texts)))).select(*[by_name[n].validate(F.col(f"c{i}")).alias(f"r{i}") for i, (n, _, _) in enumerate(texts)]).first()
    assert [(n, t, got) for (n, t, _), got in zip(texts, row, strict=True)] == texts


def test_address_of_a_coin(spark):
    assert [s[:4] for s in spans(spark, "pay 1BvBMSEYstWetqTFn5Au4m4GFg7xJaNVN2 now", entities=["CRYPTO"])] == [("CRYPTO", 4, 38, 1.0)]
    assert spans(spark, "pay 1BvBMSEYstWetqTFn5Au4m4GFg7xJaNVN3 now", entities=["CRYPTO"]) == []


def test_every_pattern_compiles(spark):
    from veilspark.operators.recognizers import NATIONAL
    from veilspark.operators.scan import FLAGS

    spark.createDataFrame([("a 1 ä",)], "text string").select(*[F.rlike(F.col("text"), F.lit(FLAGS + p)) for r in NATIONAL for p, _ in r.patterns]).collect()


def test_labelled_numbers(spark):
    reg = Registry(all_of_them=True)
    found = spans(spark, "Rx #: 12345678 and claim no. CLM-1234567", registry=reg, entities=["US_PRESCRIPTION_NUMBER", "US_CLAIM_NUMBER"])
    assert {s[:3] for s in found} == {("US_PRESCRIPTION_NUMBER", 6, 14), ("US_CLAIM_NUMBER", 29, 40)}
