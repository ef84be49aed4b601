import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from veilspark.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, items, top):
    words = [(i, TERM.findall((t or "").translate(LOWER))) for i, t in docs]
    words = [(i, w) for i, w in words if w]
    n, total = len(words), sum(len(w) for _, w in words)
    df = Counter(t for _, w in words for t in set(w))
    out = []
    for item, text in items:
        asked, found = TERM.findall((text or "").translate(LOWER)), []
        for i, w in words:
            tf, m, score = Counter(w), 75 + 25 * len(w) * n // total, 0
            for t in asked:
                if tf[t]:
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 12 * m))
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, k + 1, i, -s) for k, (s, _, _, i) in enumerate(sorted(found)[:top])]
    return out


def ordered(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize(("part", "seed"), [(lexical.PASS, 1), (300, 2)])
def test_search(spark, part, seed, monkeypatch):
    monkeypatch.setattr(lexical, "PASS", part)
    rng = random.Random(seed)
    vocabulary = [f"W{k}é" if k % 7 == 0 else f"w{k}" for k in range(120)]
    text = lambda n: " ".join(rng.choices(vocabulary, [1 / (k + 1) for k in range(120)], k=n))
    docs = [(k, text(rng.choice([1, 3, 20, 60, 400]))) for k in range(160)]
    docs += [(1000 + k, docs[5][1]) for k in range(50)] + [docs[6]] * 30 + [(None, docs[7][1]), (None, None), (3, ""), (4, " -- "), (7, "w1"), (7, "w1 w2 " * 9000)]
    items = [(k, text(12)) for k in range(15)] + [(3, docs[5][1]), (4, None), (5, "!"), (6, "nowhere"), (None, "w1 W1"), (6, "w3"), (6, "w3"), (8, docs[6][1])]
    d = spark.createDataFrame([(i, t, "x", 1, b"") for i, t in docs], "doc_id long, text string, item string, score int, sha binary").repartition(3)
    q = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id int")
    assert ordered(map(tuple, lexical.search(d, q, top=10).collect())) == ordered(brute(docs, items, 10))


def test_search_edges(spark):
    d = spark.createDataFrame([(1, "one two")], "doc_id long, text string")
    q = spark.createDataFrame([("a", "two")], "item_id string, text string")
    assert [tuple(r)[:3] for r in lexical.search(d, q).collect()] == [("a", 1, 1)]
    assert lexical.search(d.limit(0), q).collect() == []
    assert lexical.search(d, q.limit(0)).collect() == []
    assert lexical.search(d.select("doc_id", lexical.F.lit(None).cast("string").alias("text")), q).collect() == []


def test_bounds_are_never_too_low_and_leave_most_out():
    rng = random.Random(8)
    texts = [" ".join(f"t{int(rng.paretovariate(0.4)) % 3000}" for _ in range(200)).encode() for _ in range(300)]
    words = [lexical.terms(t) for t in texts]
    n, total = len(texts), sum(map(len, words))
    df = Counter(t for w in words for t in set(w))
    asked = [Counter(rng.sample(w, 25)) for w in words[:8]]
    names = sorted({t for a in asked for t in a})
    wanted = lexical.Wanted(names, [{names.index(t): lexical.weight(n, df[t]) * c for t, c in a.items()} for a in asked], n, total)
    shelf = lexical.Shelf(8192)
    for k, w in enumerate(words):
        found = Counter(w)
        shelf.ids.append(k)
        shelf.shas.append(b"")
        shelf.sizes.append(len(w))
        shelf.hashes.append(lexical.hashed(list(found), {}))
        shelf.counts.append(np.array(list(found.values())))
    most = lexical.bounds(shelf.block(), wanted, lexical.hashed(names, {}))
    real = np.array([lexical.exact(t, list(range(8)), wanted) for t in texts]).T
    assert (most >= real).all()
    assert sum((most[k] >= np.sort(real[k])[-20]).sum() for k in range(8)) < 8 * 60
