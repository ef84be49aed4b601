"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies are counted over every training document. Weights are fitted with
follow-the-regularised-leader under elastic-net penalties, on a bounded sample of labelled rows (ROWS for each
language; the bound on what the driver holds). A part of the sample that takes no part in fitting sets
the temperature by which probabilities are calibrated. Prediction reads whole texts in one pass, Arrow batch by
batch; a text's score is a sum over its n-grams, so memory doesn't grow with its length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import map_arrow, slices

DIMS, ORDERS, ROWS, EPOCHS, SCALE, PIECE = 1 << 15, (1, 2, 3), 1200, 3, 64.0, 1 << 16
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.05, 0.05
NEW = {"lang_pred": "string", "score": "double"}


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # DIMS x languages, with IDF and SCALE multiplied in
    bias: np.ndarray
    temperature: float


_letters: np.ndarray | None = None


def grams(text: str) -> Iterator[np.ndarray]:
    """Feature numbers of the character n-grams, in pieces; letters are lower-cased, all else counts as a blank."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    overlap = max(ORDERS) - 1
    for i in range(0, len(text), PIECE):
        part = text[max(0, i - overlap) : i + PIECE].lower()
        new = min(i, overlap)  # characters of the piece before
        codes = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        codes = np.where(_letters[codes], codes, 32)
        for n in ORDERS:
            if len(codes) < n:
                continue
            h = np.full(len(codes) - n + 1, n, np.uint64)
            for k in range(n):
                h = (h ^ codes[k : len(codes) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            yield (h[max(0, new - n + 1) :] & np.uint64(DIMS - 1)).astype(np.int64)


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(features, their shares of all n-grams of the text)."""
    total = np.zeros(DIMS, np.int64)
    for f in grams(text):
        total += np.bincount(f, minlength=DIMS)
    at = np.flatnonzero(total)
    return at, total[at] / max(1, total.sum())


def document_frequencies(texts: DataFrame) -> tuple[int, np.ndarray]:
    """(documents, documents that have each feature), over all rows of texts (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, seen, n = np.zeros(DIMS + 1, np.int64), np.zeros(DIMS, bool), 0
        for b in batches:
            for t in b.column(0):
                n += 1
                seen[:] = False
                for f in grams(t.as_py() or ""):
                    seen[f] = True
                df[:DIMS] += seen
        df[DIMS] = n
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], ["feature", "n"])

    rows = map_arrow(texts.select(F.col("text").cast("string")), run, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()  # at most DIMS + 1 rows
    df = np.zeros(DIMS + 1, np.int64)
    for r in rows:
        df[r.feature] = r.n
    return int(df[DIMS]), df[:DIMS]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(sample: list[tuple[str, str]], langs: list[str], idf: np.ndarray) -> Model:
    """sample: (text, lang). Every fifth row calibrates; the others are fitted."""
    rows = [(*counted(t), langs.index(lang)) for t, lang in sample]
    rows = [(np.append(at, DIMS), np.append(share * idf[at] * SCALE, 1.0), y) for at, share, y in rows]
    train = [r for i, r in enumerate(rows) if i % 5 != 4 or len(rows) < 20]
    held = [r for i, r in enumerate(rows) if i % 5 == 4] or rows
    z, n = np.zeros((DIMS + 1, len(langs))), np.zeros((DIMS + 1, len(langs)))

    def weights(at) -> np.ndarray:
        za, na = z[at], n[at]
        w = -(za - np.sign(za) * L1) / ((BETA + np.sqrt(na)) / ALPHA + L2)
        return np.where(np.abs(za) <= L1, 0.0, w)

    order = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for i in order.permutation(len(train)):
            at, x, y = train[i]
            w = weights(at)
            p = softmax(x @ w)
            p[y] -= 1.0
            g = np.outer(x, p)
            new = n[at] + g * g
            z[at] += g - (np.sqrt(new) - np.sqrt(n[at])) / ALPHA * w
            n[at] = new
    w = weights(slice(None))
    logits, y = np.array([x @ w[at] for at, x, _ in held]), np.array([r[2] for r in held])
    loss = lambda t: -np.log(softmax(logits / t)[np.arange(len(y)), y] + 1e-12).mean() + 1e-3 * np.log(t) ** 2
    temperature = min(np.exp(np.linspace(-3, 3, 121)), key=loss)
    return Model(langs, (w[:DIMS] * idf[:, None] * SCALE).astype(np.float32), w[DIMS].astype(np.float32), float(temperature))


def learn(labelled: DataFrame, rows: int = ROWS) -> Model | None:
    """A model from the rows of labelled (doc_id, text, lang) that have both a text and a lang; None if there are none."""
    train = labelled.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null")
    # equal rows have one draw, so each text with a doc_id of its own counts once, and all of them have the same chance
    train = train.withColumn("draw", F.xxhash64(F.coalesce("doc_id", F.lit(-1)), "text", F.lit("langid")))
    sizes = {r.lang: r.n for r in train.groupBy("lang").agg(F.approx_count_distinct("draw").alias("n")).collect()}  # one row a language
    if not sizes:
        return None
    documents, df = document_frequencies(train)
    rate: Column = F.element_at(F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, 3 * rows / n))]), F.col("lang"))
    # about 3 * rows of each language, or all that it has; of these the smallest draws
    some = train.where(F.shiftrightunsigned("draw", 34).cast("double") / (1 << 30) < rate).dropDuplicates(["lang", "draw"])
    place = F.row_number().over(Window.partitionBy("lang").orderBy("draw"))
    sample = some.withColumn("place", place).where(F.col("place") <= rows).orderBy("draw", "lang").collect()
    return fit([(r.text, r.lang) for r in sample], sorted(sizes), np.log((1 + documents) / (1 + df)) + 1.0)


def has_letter(text: str) -> bool:
    """Whether any character is of a category L; numerals and digits are none."""
    return any(map(str.isalpha, text))


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """All columns of docs, then lang_pred and score. Predictions see only text.

    Null texts and texts without a letter are und with score 0. Columns of docs that have the names of new ones
    are left out.
    """
    rows = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in NEW])
    names, held = list(rows.columns), docs.sparkSession.sparkContext.broadcast(model)  # DIMS floats a language

    def of(text: str | None, m: Model | None) -> tuple[str, float]:
        if m is None or text is None or not has_letter(text):
            return "und", 0.0
        total, n = np.zeros(len(m.langs)), 0
        for f in grams(text):
            total += m.weights[f].sum(axis=0, dtype=np.float64)
            n += len(f)
        p = softmax((total / max(1, n) + m.bias) / m.temperature)
        return m.langs[int(p.argmax())], float(p.max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, at = held.value, [c.lower() for c in names].index("text")
        for whole in batches:
            for b in slices(whole, at):
                found = [of(t.as_py(), m) for t in b.column(at)]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], [*names, *NEW])

    return map_arrow(rows, run, StructType([*rows.schema.fields]).add("lang_pred", "string").add("score", "double"))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def predict_documents(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text, lang, ...): doc_id, held_out, lang_pred, score (0 to 1, calibrated).

    und with score 0 where the text is null or has no letter, or where nothing could be learned from. A null
    doc_id counts as the empty string for the fold. Rows that repeat are predicted each. Rows without lang are
    predicted but not learned from. An empty table gives an empty result.
    """
    fold = held_out(F.col("doc_id"))
    model = learn(docs.select("doc_id", "text", "lang").where(~fold))
    rows = docs.select("doc_id", fold.alias("held_out"), F.col("text").cast("string").alias("text"))
    return predict(rows, model).select("doc_id", "held_out", "lang_pred", "score")
