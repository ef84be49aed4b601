"""Cases over stated texts and their expected rows, one family each; the SQL of a family lists its rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilspark.operators.analyze import explanations, findings
from veilspark.operators.recognizers import Registry
from veilspark.operators.rewrite import anonymize
from veilspark.operators.scan import SPAN
from veilspark.operators import boxes
from veilspark.operators.chunked import KEPT, unite
from veilspark.operators.spans import POLICIES, merge_over_blanks, merge_same_type, resolve, trim_intersections, without_contained, without_covered

Case = tuple[str, list[tuple[str, int, int, float]]]

#: family: (entities, whether national recognizers join, options, texts with (entity, start, end, score) of what is found)
DETECTION: dict[str, tuple[list[str], bool, dict, list[Case]]] = {
    "iban_cases": (["IBAN_CODE"], False, {}, [
        ("AL47212110090000000235698741 2 days", [("IBAN_CODE", 0, 28, 1.0)]),
        ("IBAN GB82 WEST 1234 5698 7654 32", [("IBAN_CODE", 5, 32, 1.0)]),
        ("pay to de89370400440532013000 now", [("IBAN_CODE", 7, 29, 0.5)]),
        ("pay to DE89370400440532013001 now", []),
        ("FR7630006000011234567890189 9 ABC", [("IBAN_CODE", 0, 27, 1.0)]),
        ("DE8937040044053201300", []),
    ]),
    "date_cases": (["DATE_TIME"], False, {}, [
        ("on 2024-05-06T10:20:30Z sharp", [("DATE_TIME", 3, 23, 0.8)]),
        ("at 2021-05-21T21:07:10.123+03:30", [("DATE_TIME", 3, 32, 0.8)]),
        ("from 5/21/2021", [("DATE_TIME", 5, 14, 0.6)]),
        ("24.12.99 and 2024-01-31", [("DATE_TIME", 0, 8, 0.6), ("DATE_TIME", 13, 23, 0.6)]),
        ("in 21-MAY-2021", [("DATE_TIME", 3, 14, 0.6)]),
        ("99.99.99", []),
    ]),
    "card_cases": (["CREDIT_CARD"], False, {}, [
        ("pay 4012888888881881 now", [("CREDIT_CARD", 4, 20, 1.0)]),
        ("pay 4012-8888-8888-1881 now", [("CREDIT_CARD", 4, 23, 1.0)]),
        ("pay 4012888888881882 now", []),
        ("371449635398431", [("CREDIT_CARD", 0, 15, 1.0)]),
    ]),
    "address_cases": (["IP_ADDRESS", "MAC_ADDRESS", "URL", "EMAIL_ADDRESS"], False, {}, [
        ("host 192.168.0.1 up", [("IP_ADDRESS", 5, 16, 0.6)]),
        ("host 999.168.0.1 up", []),
        ("at 2001:db8::1 now", [("IP_ADDRESS", 3, 14, 0.6)]),
        ("nic 00:1B:44:11:3A:B7", [("MAC_ADDRESS", 4, 21, 0.6)]),
        ("nic FF:FF:FF:FF:FF:FF", []),
        ("https://www.example.com/a", [("URL", 0, 25, 0.6)]),
        ("write to bob@example.org", [("EMAIL_ADDRESS", 9, 24, 1.0), ("URL", 13, 24, 0.5)]),
    ]),
    "german_cases": (["DE_TAX_ID", "DE_VAT_ID", "DE_HANDELSREGISTER", "DE_PASSPORT"], True, {}, [
        ("86095742719", [("DE_TAX_ID", 0, 11, 1.0)]),
        ("11111234566", []),
        ("HRB 12345", [("DE_HANDELSREGISTER", 0, 9, 0.85)]),
        ("Amtsgericht Berlin HRB 12345", [("DE_HANDELSREGISTER", 19, 28, 0.85)]),
    ]),
    "american_cases": (["US_SSN", "US_ITIN", "US_PASSPORT", "ABA_ROUTING_NUMBER"], True, {"threshold": 0.05}, [
        ("my ssn is 123-45-6780", [("US_SSN", 10, 21, 0.85)]),
        ("000-12-3456", []),
        ("911-701234", [("US_ITIN", 0, 10, 0.05), ("US_SSN", 0, 10, 0.05)]),
        ("911-70-1234", [("US_ITIN", 0, 11, 0.5), ("US_SSN", 0, 11, 0.5)]),
        ("routing number 1210-0035-8", [("ABA_ROUTING_NUMBER", 15, 26, 1.0)]),
    ]),
    "indian_cases": (["IN_PAN", "IN_AADHAAR"], True, {"threshold": 0.01}, [
        ("AAASA1111R", [("IN_PAN", 0, 10, 0.1)]),
        ("ABCPD1234Z", [("IN_PAN", 0, 10, 0.5)]),
        ("aB#1234xyz", [("IN_PAN", 0, 10, 0.01)]),
        ("no numbers", []),
    ]),
    "european_cases": (["FI_PERSONAL_IDENTITY_CODE", "SE_ORGANISATIONSNUMMER", "ES_NIF", "PL_PESEL"], True, {"threshold": 0.1}, [
        ("010594Y9032", [("FI_PERSONAL_IDENTITY_CODE", 0, 11, 1.0)]),
        ("010594Y9033", []),
        ("556703-7485", [("SE_ORGANISATIONSNUMMER", 0, 11, 1.0)]),
        ("55555555-K", [("ES_NIF", 0, 10, 1.0)]),
        ("55555555-A", []),
        ("11111111116", [("PL_PESEL", 0, 11, 1.0)]),
    ]),
    "british_cases": (["UK_NHS", "UK_NINO", "UK_POSTCODE"], True, {"threshold": 0.01}, [
        ("401-023-2137", [("UK_NHS", 0, 12, 1.0)]),
        ("401-023-2138", []),
        ("AB 12 34 56 C", [("UK_NINO", 0, 13, 0.5)]),
        ("BG 12 34 56 C", []),
    ]),
    "australian_cases": (["AU_ABN", "AU_ACN", "AU_TFN", "AU_MEDICARE"], True, {"threshold": 0.01}, [
        ("51 824 753 556", [("AU_ABN", 0, 14, 1.0)]),
        ("52 824 753 556", []),
        ("000 000 019", [("AU_ACN", 0, 11, 1.0), ("AU_TFN", 0, 11, 1.0)]),
        ("876 543 210", [("AU_TFN", 0, 11, 1.0)]),
        ("2123 45670 1", [("AU_MEDICARE", 0, 12, 1.0)]),
        ("2123 45671 1", []),
    ]),
    "asian_cases": (["TH_TNIN", "SG_NRIC_FIN", "SG_UEN", "KR_BRN", "PH_UMID"], True, {"threshold": 0.01}, [
        ("1123456789014", [("TH_TNIN", 0, 13, 1.0)]),
        ("1123456789015", []),
        ("G1122144L", [("SG_NRIC_FIN", 0, 9, 0.5)]),
        ("53125226D", [("SG_UEN", 0, 9, 1.0)]),
        ("124-81-00998", [("KR_BRN", 0, 12, 1.0)]),
        ("1234-1234567-1", [("PH_UMID", 0, 14, 0.5)]),
    ]),
    "other_cases": (["ES_NIE", "TR_NATIONAL_ID", "ZA_ID_NUMBER", "CA_SIN", "IT_FISCAL_CODE", "CRYPTO", "US_MBI"], True, {"threshold": 0.01}, [
        ("Z8078221M", [("ES_NIE", 0, 9, 1.0)]),
        ("Z8078221A", []),
        ("10000000146", [("TR_NATIONAL_ID", 0, 11, 1.0)]),
        ("10000000145", []),
        ("8001015009087", [("ZA_ID_NUMBER", 0, 13, 1.0)]),
        ("130-692-544", [("CA_SIN", 0, 11, 0.5)]),
        ("130-692-545", []),
        ("RSSMRA80A01H501U", [("IT_FISCAL_CODE", 0, 16, 1.0)]),
        ("1BvBMSEYstWetqTFn5Au4m4GFg7xJaNVN2", [("CRYPTO", 0, 34, 1.0)]),
        ("1EG4-TE5-MK73", [("US_MBI", 0, 13, 0.5)]),
        ("1SG4-TE5-MK73", []),
    ]),
    "phrase_cases": (["UK_PASSPORT", "CA_SIN", "AU_ABN"], True, {"threshold": 0.01}, [
        ("travel document AB1234567", [("UK_PASSPORT", 16, 25, 0.45)]),
        ("Travel-document no. AB1234567", [("UK_PASSPORT", 20, 29, 0.45)]),
        ("travel the document AB1234567", [("UK_PASSPORT", 20, 29, 0.1)]),
        ("travel document of the man who left AB1234567", [("UK_PASSPORT", 36, 45, 0.1)]),
        ("numéro d’assurance sociale: 130-692-544", [("CA_SIN", 28, 39, 0.85)]),
        ("51 824 753 556 is an Australian business number", [("AU_ABN", 0, 14, 1.0)]),
    ]),
    "caller_context_cases": (["US_SSN", "CREDIT_CARD"], False, {"context": ["ssn"]}, [
        ("123-45-6780", [("US_SSN", 0, 11, 0.85)]),
        ("4012888888881881", [("CREDIT_CARD", 0, 16, 1.0)]),
    ]),
}


def detection(name: str):
    entities, national, options, cases = DETECTION[name]

    def query(spark, d):
        rows = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "n int, text string")
        found = findings(rows, "text", ["n"], registry=Registry(all_of_them=national), entities=entities, **options)
        return found.select("n", "entity_type", "start", "end", F.round("score", 6).alias("score"))

    rows = [(k, *f) for k, (_, found) in enumerate(cases) for f in found]
    values = ", ".join(f"({n}, '{e}', {a}, {b}, {s}::DOUBLE)" for n, e, a, b, s in rows)
    return query, f'SELECT * FROM (VALUES {values}) t(n, entity_type, start, "end", score)'


#: name of a case: (text, spans given, expected text by policy merge_similar_or_contained, and by remove_intersections)
CONFLICTS: dict[str, tuple[str, list[tuple[str, int, int, float]], str, str]] = {
    "apart": ("I am Ann, 32", [("NAME", 5, 8, 0.8), ("AGE", 10, 12, 0.8)], "I am <NAME>, <AGE>", "I am <NAME>, <AGE>"),
    "same place, higher score": ("I am Ann", [("NAME", 5, 8, 0.8), ("WORD", 5, 8, 0.9)], "I am <WORD>", "I am <WORD>"),
    "same place and score, last": ("I am Ann", [("WORD", 5, 8, 0.8), ("NAME", 5, 8, 0.8)], "I am <NAME>", "I am <NAME>"),
    "contained": ("I am Ann Lee", [("NAME", 5, 12, 0.5), ("WORD", 9, 12, 0.9)], "I am <NAME>", "I am <NAME>"),
    "same type overlaps": ("I am Ann Lee", [("NAME", 5, 10, 0.5), ("NAME", 8, 12, 0.9)], "I am <NAME>", "I am <NAME>"),
    "two types overlap": ("0123456789", [("A", 0, 6, 0.8), ("B", 4, 10, 0.6)], "<A><B>", "<A><B>"),
    "trimmed by the later": ("0123456789 x", [("A", 0, 6, 0.6), ("B", 4, 8, 0.8)], "<A><B>89 x", "<A><B>89 x"),
    "three overlap": ("0123456789", [("A", 0, 5, 0.9), ("B", 2, 7, 0.5), ("C", 4, 9, 0.5)], "<A><B><C>9", "<A><B><C>9"),
    "blanks between": ("Ann  Lee x", [("NAME", 0, 3, 0.8), ("NAME", 5, 8, 0.6)], "<NAME> x", "<NAME> x"),
    "tab between": ("Ann\tLee", [("NAME", 0, 3, 0.8), ("NAME", 4, 7, 0.6)], "<NAME>\t<NAME>", "<NAME>\t<NAME>"),
    "touching": ("AnnLee", [("NAME", 0, 3, 0.8), ("NAME", 3, 6, 0.6)], "<NAME><NAME>", "<NAME><NAME>"),
    "none": ("nothing", [], "nothing", "nothing"),
}


def conflict_cases(spark, d):
    rows = [(name, text, [(*x, "r") for x in spans]) for name, (text, spans, _, _) in CONFLICTS.items()]
    t = spark.createDataFrame(rows, f"name string, text string, spans {SPAN}")
    return t.select("name", *[anonymize(F.col("text"), F.col("spans"), policy=p)["text"].alias(p) for p in POLICIES])


#: (text, entities, recognizer, start, original score, valid, validated score, score) of each place that a pattern matches
WHY = [
    ("card 4012888888881881", "CREDIT_CARD", "CreditCardRecognizer", 5, 0.3, True, 1.0, 1.0),
    ("num 4012888888881882", "CREDIT_CARD", "CreditCardRecognizer", 4, 0.3, False, 0.0, 0.0),
    ("ip 10.0.0.1", "IP_ADDRESS", "IpRecognizer", 3, 0.6, None, 0.6, 0.95),
    ("mail bob@example.org", "EMAIL_ADDRESS", "EmailRecognizer", 5, 0.5, True, 1.0, 1.0),
]


def explanation_cases(spark, d):
    t = spark.createDataFrame([(k, x[0]) for k, x in enumerate(WHY)], "n int, text string")
    got = explanations(t, "text", ["n"], entities=["CREDIT_CARD", "IP_ADDRESS", "EMAIL_ADDRESS"])
    rounded = [F.round(c, 6).alias(c) for c in ("original_score", "validated_score", "score")]
    return got.select("n", "entity_type", "recognizer", "start", F.coalesce(F.col("valid").cast("string"), F.lit("unknown")).alias("valid"), *rounded).distinct()


def literal(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


QUERIES = {name: detection(name)[0] for name in DETECTION} | {"conflict_cases": conflict_cases, "explanation_cases": explanation_cases}
ORACLES = {name: detection(name)[1] for name in DETECTION}
ORACLES["conflict_cases"] = f"SELECT * FROM (VALUES {', '.join(f'({literal(n)}, {literal(a)}, {literal(b)})' for n, (_, _, a, b) in CONFLICTS.items())}) t(name, {', '.join(POLICIES)})"
ORACLES["explanation_cases"] = f"""SELECT * FROM (VALUES {', '.join(f"({n}, '{e}', '{r}', {a}, '{'unknown' if v is None else str(v).lower()}', {o}::DOUBLE, {w}::DOUBLE, {s}::DOUBLE)" for n, (_, e, r, a, o, v, w, s) in enumerate(WHY))}) t(n, entity_type, recognizer, start, valid, original_score, validated_score, score)"""


SPANS = {
    "contained": [("A", 0, 10, 0.5), ("A", 2, 5, 0.4), ("A", 2, 5, 0.9), ("B", 2, 5, 0.1), ("A", 0, 10, 0.5), ("C", 1, 2, 0.0)],
    "overlap": [("A", 0, 4, 0.5), ("A", 3, 8, 0.7), ("A", 8, 9, 0.2), ("B", 6, 12, 0.6)],
    "equal": [("A", 0, 4, 0.5), ("B", 0, 4, 0.8), ("C", 1, 3, 0.9)],
}
TEXT = "ab cd ef gh ij kl"


def span_algebra(spark, d):
    rows = [(k, TEXT, [(*s, "r") for s in v]) for k, v in SPANS.items()]
    t = spark.createDataFrame(rows, f"name string, text string, spans {SPAN}")
    made = {
        "contained": without_contained(F.col("spans")), "merged": merge_same_type(F.col("spans")), "covered": without_covered(F.col("spans")),
        "trimmed": trim_intersections(merge_same_type(F.col("spans"))), "blanks": merge_over_blanks(F.col("text"), F.col("spans")), **{p: resolve(F.col("text"), F.col("spans"), p) for p in POLICIES},
    }
    shown = lambda c: F.array_join(F.transform(c, lambda s: F.format_string("%s:%d-%d:%.1f", s["entity_type"], s["start"], s["end"], s["score"])), " ")
    return t.select("name", *[shown(c).alias(k) for k, c in made.items()])


#: (entity, start, end, score, cut by an inner edge in front, behind)
FOLDS = {
    "best score": ([("A", 0, 10, 0.5, False, False), ("A", 2, 10, 0.8, False, False)], "A:2-10"),
    "half is not more than half": ([("A", 0, 10, 0.9, False, False), ("A", 5, 15, 0.8, False, False)], "A:0-10 A:5-15"),
    "cut behind": ([("A", 0, 10, 0.9, False, True), ("A", 0, 14, 0.8, False, False)], "A:0-14"),
    "cut in front": ([("A", 5, 10, 0.9, True, False), ("A", 2, 10, 0.8, False, False)], "A:2-10"),
    "not cut": ([("A", 0, 10, 0.9, False, False), ("A", 0, 14, 0.8, False, False)], "A:0-10"),
    "other type": ([("A", 0, 10, 0.9, False, True), ("B", 0, 14, 0.8, False, False)], "A:0-10 B:0-14"),
    "both cut": ([("A", 0, 10, 0.9, False, True), ("A", 0, 14, 0.8, False, True)], "A:0-10"),
}


def chunk_unions(spark, d):
    rows = [(name, [((e, a, b, s, "r"), x, y) for e, a, b, s, x, y in found]) for name, (found, _) in FOLDS.items()]
    t = spark.createDataFrame(rows, f"name string, found {KEPT}")
    return t.select("name", F.array_join(F.transform(unite(F.col("found")), lambda s: F.format_string("%s:%d-%d", s["entity_type"], s["start"], s["end"])), " ").alias("united"))


def box_cases(spark, d):
    kind = "array<struct<left:int,top:int,width:int,height:int,score:double,label:string>>"
    rows = [(1, [(0, 0, 10, 10, 0.5, "a"), (3, 4, 12, 9, 0.9, "b"), (40, 0, 10, 10, 0.2, "c")]), (2, [(0, 0, 10, 10, 0.5, "a"), (5, 5, 10, 10, 0.5, "b"), (6, 0, 10, 10, 0.5, "c")]), (3, [])]
    t = spark.createDataFrame(rows, f"image int, boxes {kind}")
    return t.select("image", F.array_join(F.transform(boxes.without_duplicates(F.col("boxes")), lambda b: b["label"]), "").alias("kept"))


def box_shapes(spark, d):
    t = spark.createDataFrame([(1, [(1.0, 2.0), (5.0, 1.0), (6.0, 7.0)], 2.0, 10)], "n int, points array<struct<x:double,y:double>>, factor double, padding int")
    p = boxes.from_polygon(F.col("points"))
    r = boxes.rescaled(F.struct(F.lit(30).alias("left"), F.lit(50).alias("top"), F.lit(21).alias("width"), F.lit(8).alias("height")), 2.0, 10)
    shown = lambda b: F.concat_ws(" ", *[b[s].cast("int") for s in boxes.SIDES])
    return t.select("n", shown(p).alias("box"), shown(r).alias("rescaled"), F.array_join(boxes.spellings(F.array(F.lit("ann LEE"))), "|").alias("spellings"))


QUERIES |= {f.__name__: f for f in (span_algebra, chunk_unions, box_cases, box_shapes)}
ORACLES |= {
    "span_algebra": """SELECT * FROM (VALUES
        ('contained', 'A:2-5:0.9 A:0-10:0.5 B:2-5:0.1', 'B:2-5:0.1 A:0-10:0.9 C:1-2:0.0', 'A:0-10:0.5', 'A:0-10:0.9', 'A:0-10:0.5 A:2-5:0.4 A:2-5:0.9 B:2-5:0.1 A:0-10:0.5 C:1-2:0.0', 'A:0-10:0.9', 'A:0-10:0.9'),
        ('overlap', 'A:3-8:0.7 B:6-12:0.6 A:0-4:0.5 A:8-9:0.2', 'A:0-8:0.7 A:8-9:0.2 B:6-12:0.6', 'A:0-4:0.5 A:3-8:0.7 B:6-12:0.6', 'A:0-8:0.7 B:8-12:0.6', 'A:0-4:0.5 A:3-8:0.7 A:8-9:0.2 B:6-12:0.6', 'A:0-8:0.7 B:6-12:0.6', 'A:0-8:0.7 B:8-12:0.6'),
        ('equal', 'C:1-3:0.9 B:0-4:0.8 A:0-4:0.5', 'A:0-4:0.5 B:0-4:0.8 C:1-3:0.9', 'B:0-4:0.8', 'B:0-1:0.8 C:1-3:0.9', 'A:0-4:0.5 B:0-4:0.8 C:1-3:0.9', 'B:0-4:0.8', 'B:0-4:0.8')
        ) t(name, contained, merged, covered, trimmed, blanks, merge_similar_or_contained, remove_intersections)""",
    "chunk_unions": f"SELECT * FROM (VALUES {', '.join(f'({chr(39)}{n}{chr(39)}, {chr(39)}{w}{chr(39)})' for n, (_, w) in FOLDS.items())}) t(name, united)",
    "box_cases": "SELECT * FROM (VALUES (1, 'bc'), (2, 'c'), (3, '')) t(image, kept)",
    "box_shapes": "SELECT 1 AS n, '1 1 5 6' AS box, '10 20 10 4' AS rescaled, 'ANN LEE|Ann Lee|ann LEE|ann lee' AS spellings",
}
