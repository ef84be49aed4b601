"""Boxes of words in images: boxes from polygons, words that spans cover, matches within a tolerance, precision and recall.

A box is struct(left, top, width, height) and whatever else; no pixel is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIDES = ("left", "top", "width", "height")


def from_polygon(points: Column) -> Column:
    """The box around an array of (x, y)."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    left, top = F.array_min(xs), F.array_min(ys)
    return F.struct(left.alias("left"), top.alias("top"), (F.array_max(xs) - left).alias("width"), (F.array_max(ys) - top).alias("height"))


def rescaled(box: Column, factor: float, padding: int = 0) -> Column:
    """The box of an image that was enlarged by `factor` and then padded on all sides, in the image as it was; whole numbers, cut down."""
    part = lambda side: F.floor((box[side] - (padding if side in ("left", "top") else 0)) / factor).cast("int").alias(side)
    return F.struct(*[part(side) for side in SIDES])


def near(a: Column, b: Column, tolerance: float) -> Column:
    """Whether all four sides differ by `tolerance` at most."""
    out = F.lit(True)
    for side in SIDES:
        out = out & (F.abs(a[side] - b[side]) <= tolerance)
    return out


def without_duplicates(boxes: Column, tolerance: float = 5) -> Column:
    """Boxes (with a score) of an image without those that another of a higher score, or of the same score and given later, is near to."""

    def beaten(s: Column, i: Column) -> Column:
        others = F.transform(boxes, lambda o, k: F.struct(o.alias("o"), k.alias("k")))
        return F.exists(others, lambda x: (x["k"] != i) & near(x["o"], s, tolerance) & ((x["o"]["score"] > s["score"]) | ((x["o"]["score"] == s["score"]) & (x["k"] > i))))

    return F.filter(boxes, lambda s, i: ~beaten(s, i))


def matched(found: DataFrame, truth: DataFrame, image: str = "image", tolerance: float = 50) -> DataFrame:
    """All columns of found and of truth (found.*, truth.* as structs f, t) for boxes of one image that are near.

    Boxes meet by cells of the tolerance's size and their neighbours, so no box is compared with all of its image.
    """
    cell = lambda side: F.floor(F.col(side) / tolerance)
    beside = lambda side: F.array(*[F.floor(F.col(side) / tolerance) + k for k in (-1, 0, 1)])
    a = found.select(F.col(image).alias("image"), F.struct("*").alias("f"), cell("left").alias("x"), cell("top").alias("y"))
    b = truth.select(F.col(image).alias("image"), F.struct("*").alias("t"), F.explode(beside("left")).alias("x"), beside("top").alias("ys")).select("image", "t", "x", F.explode("ys").alias("y"))
    return a.join(b, ["image", "x", "y"]).where(near(F.col("f"), F.col("t"), tolerance)).select("image", "f", "t")


def rates(found: DataFrame, truth: DataFrame, image: str = "image", tolerance: float = 50) -> DataFrame:
    """image, precision, recall: the share of found boxes near a true one, and of true ones near a found one; 0 where there are none."""
    one = found.withColumn("_f", F.monotonically_increasing_id())
    two = truth.withColumn("_t", F.monotonically_increasing_id())
    hits = matched(one, two, image, tolerance).groupBy("image").agg(F.countDistinct("f._f").alias("tf"), F.countDistinct("t._t").alias("tt"))
    sizes = found.select(F.col(image).alias("image"), F.lit(1).alias("n"), F.lit(0).alias("m")).unionByName(truth.select(F.col(image).alias("image"), F.lit(0).alias("n"), F.lit(1).alias("m"))).groupBy("image").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    share = lambda part, whole: F.when(F.col(whole) > 0, F.coalesce(F.col(part), F.lit(0)) / F.col(whole)).otherwise(0.0)
    return sizes.join(hits, "image", "left").select("image", share("tf", "n").alias("precision"), share("tt", "m").alias("recall"))


def read_words(words: Column, least: float = -1) -> Column:
    """Words (text, conf, box) as read from an image without blank ones and those below a confidence."""
    return F.filter(words, lambda w: (F.trim(w["text"]) != "") & (w["conf"] >= least))


def joined_words(words: Column) -> Column:
    """The text of words with blanks between, and each word's place in it: struct(text, places)."""
    places = "array<struct<start:int,end:int>>"
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(places).alias("out"))
    step = lambda a, w: F.struct((a["at"] + F.length(w["text"]) + 1).alias("at"), F.concat(a["out"], F.array(F.struct(a["at"].alias("start"), (a["at"] + F.length(w["text"])).alias("end")))).alias("out"))
    return F.struct(F.array_join(F.transform(words, lambda w: w["text"]), " ").alias("text"), F.aggregate(words, begin, step, lambda a: a["out"]).alias("places"))


def covered_words(words: Column, places: Column, text: Column, spans: Column) -> Column:
    """(entity_type, score, word) for each word that a span overlaps and whose text holds the span's or is held by it."""

    def of(s: Column) -> Column:
        found = F.substring(text, s["start"] + 1, s["end"] - s["start"])
        pairs = F.zip_with(words, places, lambda w, p: F.struct(w.alias("w"), p.alias("p")))
        meets = F.filter(pairs, lambda x: (x["p"]["start"] < s["end"]) & (x["p"]["end"] > s["start"]) & (F.contains(x["w"]["text"], found) | F.contains(found, x["w"]["text"])))
        return F.transform(meets, lambda x: F.struct(s["entity_type"].alias("entity_type"), s["score"].alias("score"), x["w"].alias("word")))

    return F.flatten(F.transform(spans, of))


def spellings(words: Column) -> Column:
    """Each word as it is and in capitals, small letters and with a capital at each begin; distinct, sorted."""
    return F.array_sort(F.array_distinct(F.flatten(F.transform(words, lambda w: F.array(w, F.upper(w), F.lower(w), F.initcap(w))))))
