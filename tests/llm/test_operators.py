"""Operators against brute force on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from veilspark.llm import decontam, langid, licenses, lm, pieces, quality, simhash, suffix, tokens, warc

BLANK = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TEXTS = [None, "", " \n\t", "One line.", "A b c d e f g h A b c d e f g h x", "same\nsame\n \nsame", "É é #*$ | <x>", "word " * 3000, "one two three four five six seven eight nine ten eleven " * 3, "All Rights Reserved. cc BY all rights reserved", "Licensed under the GNU General Public License, version 3.", "Released under the MIT License"]


def docs(spark, rows, extra=True):
    """rows of (doc_id, text), with columns whose names operators use inside."""
    kinds = "doc_id long, text string" + (", score double, n_words string, key int, w string" if extra else "")
    return spark.createDataFrame([(*r, 0.5, "x", 1, None)[: 6 if extra else 2] for r in rows], kinds)


ROWS = [*enumerate(TEXTS), (3, "One line."), (4, TEXTS[4]), (None, "null id"), (None, None)]


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_quality(spark):
    def brute(i, text):
        w = BLANK.findall(text or "")
        windows = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        covered = {k + j for k in range(len(w) - 7) if windows[tuple(w[k : k + 8])] > 1 for j in range(8)}
        lines = [x for x in (text or "").split("\n") if BLANK.search(x)]
        failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
        return (i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), failed)

    got = quality.quality_rules(docs(spark, ROWS))
    assert rows(got.select(*got.columns[:7])) == sorted((brute(*r) for r in ROWS), key=str)
    assert all(not r.kept for r in got.collect() if r.base_failed)
    assert quality.quality_rules(docs(spark, [])).count() == 0


def test_quality_posterior_by_formula(spark):
    """p_good and kept from votes and the rounds of expectation-maximisation written out over documents, not patterns."""
    rng = random.Random(9)
    made = [(i, " ".join(rng.choices(["alpha", "beta", "gamma", "#*", "OK!"], [5, 5, 5, rng.random() * 6, 1], k=rng.randint(1, 120)))) for i in range(150)]
    df = docs(spark, [*made, (None, None), (7, made[7][1])])
    rules = quality.votes()
    votes = [tuple(r) for r in quality.features(df.select("doc_id", "text")).select("doc_id", *[v.alias(k) for k, v in rules.items()]).collect()]
    good, log = [0.1 if -1 in v[1:] else 0.9 for v in votes], math.log
    for _ in range(200):
        n = [sum(good) + 1, len(votes) - sum(good) + 1]
        odds = []
        for r in range(1, len(rules) + 1):
            share = {v: [sum(g for x, g in zip(votes, good, strict=True) if x[r] == v) + 0.5, sum(1 - g for x, g in zip(votes, good, strict=True) if x[r] == v) + 0.5] for v in (1, -1)}
            w = {v: log(a / n[0]) - log(b / n[1]) for v, (a, b) in share.items()}
            odds.append({1: max(0, w[1]), -1: min(0, w[-1]), 0: 0})
        new = [1 / (1 + math.exp(-(log(n[0] / n[1]) + sum(o[v] for o, v in zip(odds, x[1:], strict=True))))) for x in votes]
        done, good = max(abs(a - b) for a, b in zip(good, new, strict=True)) < 1e-7, new
        if done:
            break
    got = sorted((str(r.doc_id), round(r.p_good, 6)) for r in quality.quality_rules(df).collect())
    assert got == sorted((str(v[0]), round(g, 6)) for v, g in zip(votes, good, strict=True))
    assert all(r.kept == (not r.base_failed and r.p_good >= 0.5) for r in quality.quality_rules(df).collect())


def test_quality_fit_prefers_agreement():
    patterns = [((1, 1, 0), 90), ((-1, -1, 0), 10), ((1, -1, 1), 3)]
    prior, weights = quality.fit(patterns, 3)
    assert quality.posterior((1, 1, 0), prior, weights) > 0.9 > 0.1 > quality.posterior((-1, -1, 0), prior, weights)


def fingerprint(text):
    w = (text or "").encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(points, bits=4):
    label = dict(enumerate(range(len(points))))
    for i in range(len(points)):
        for j in range(i):
            if (points[i] ^ points[j]).bit_count() <= bits:
                a, b = sorted((label[i], label[j]))
                label = {k: a if v == b else v for k, v in label.items()}
    return label


def test_simhash(spark):
    base = " ".join(f"w{i}" for i in range(300))
    some = [(i, t) for i, t in ROWS if i is not None] + [(50, base), (51, base + " end"), (52, base.upper())]
    got = simhash.near_duplicates(docs(spark, [*some, (None, "x")])).collect()
    points = [fingerprint(t) for _, t in some]
    label = classes(points)
    low = defaultdict(lambda: 1 << 60)
    for k, (i, _) in enumerate(some):
        low[label[k]] = min(low[label[k]], i)
    want = sorted((i, f"{p:016x}", low[label[k]]) for k, ((i, _), p) in enumerate(zip(some, points, strict=True)))
    assert sorted(tuple(r) for r in got if r.doc_id is not None) == want
    assert [r.component_id for r in got if r.doc_id is None] == [None]
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def clusters(seed, n=60):
    rng, points = random.Random(seed), {0, (1 << 64) - 1}
    for _ in range(6):
        base = rng.getrandbits(64)
        for _ in range(n):
            points.add(base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))))
    return sorted(points)


@pytest.mark.parametrize("shard, crowded, bits", [(256, 1024, 4), (20, 40, 4), (1, 3, 4), (20, 1024, 1), (20, 40, 6)])
def test_simhash_links(spark, shard, crowded, bits):
    """Uncrowded, crowded and very crowded shards, and other radii than 4."""
    points = clusters(1)
    df = spark.createDataFrame([(i, simhash.signed(p)) for i, p in enumerate(points)], "node long, fp long")
    got = {r.node: r.component for r in simhash.components(simhash.links(df, bits, shard, crowded)).collect()}
    assert {i: got.get(i, i) for i in range(len(points))} == classes(points, bits)


def test_simhash_partitions_by_vantage_point_trees(spark):
    """Shards come from the trees and stay small, and points within the radius share one in some tree."""
    rng = random.Random(6)
    points = clusters(2, 20) + [rng.getrandbits(64) for _ in range(3000)]
    df = spark.createDataFrame([(i, simhash.signed(p)) for i, p in enumerate(points)], "node long, fp long")
    trees = simhash.planted(df, shard=128)
    assert len(trees) == 5 and all(len(t.near) > 40 and not t.crowded.any() for t in trees)
    cells, members = defaultdict(set), Counter()
    for r in simhash.placed(df, trees).collect():
        cells[r.node].add((r.tree, r.cell))
        members[r.tree, r.cell] += 1
    assert sum(members.values()) == 5 * len(points) and max(members.values()) < 400
    for i, p in enumerate(points):
        for j in range(i):
            if (p ^ points[j]).bit_count() <= 4:
                assert cells[i] & cells[j]


def test_licenses(spark):
    whole = next(t for label, t, _ in licenses.TEMPLATES if label == "mit" and len(t) > 200)
    cut = " ".join(whole.split()[20:])
    some = [*ROWS, (90, "x " * 500 + whole + " y" * 500 + " MIT license"), (91, whole.replace("restriction", "regret")), (92, cut), (93, "the " * 900 + "reserved " * 5000 + "all rights reserved"), (94, "mit license " * 3), (95, "Licensed under the Apache License, Version 2.0 (the License)")]
    texts = [ALNUM.findall((t or "").translate(LOWER)) for _, t in some]
    known = licenses.licence_words()
    df = Counter(x for w in texts for x in set(w) & set(known))
    idf = {x: math.log(1 + len(some) / max(1, df[x])) for x in known}

    def stands(w, phrase):
        return [k for k in range(len(w)) if w[k : k + len(phrase)] == phrase]

    def brute(i, w):
        found = sorted((k, label) for p, label in licenses.BASE.items() for k in stands(w, p.split()))
        own, score = {label for _, label in found}, 1.0 if found else 0.0
        for label, text, phrase in licenses.TEMPLATES:
            t, key = text.split(), phrase.split()
            at = stands(t, key)[0]
            places = {*range(at, at + len(key)), *sorted(range(len(t)), key=lambda k: (-idf[t[k]], k))[: licenses.RAREST]}
            for k in stands(w, key):
                share = sum(idf[t[p]] for p in places if 0 <= k - at + p < len(w) and w[k - at + p] == t[p]) / sum(idf[t[p]] for p in places)
                if round(share, 6) >= licenses.SHARE:
                    own.add(label)
                    score = max(score, round(share, 6))
        return (i, len(w), len(found), found[0][0] if found else None, found[-1][0] if found else None, ",".join(sorted({x for _, x in found})), ",".join(sorted(own)), pytest.approx(score, abs=2e-6))

    got = licenses.scan(docs(spark, some))
    want = sorted((brute(i, w) for (i, _), w in zip(some, texts, strict=True)), key=lambda r: str(r[:-1]))
    assert sorted((tuple(r) for r in got.collect()), key=lambda r: str(r[:-1])) == want
    assert {"mit", "gpl,gpl-3.0", "apache-2.0"} <= {r[6] for r in want}
    assert licenses.scan(docs(spark, [])).count() == 0


def words(text):
    return [*BLANK.findall((text or "").translate(LOWER)), " end"]


def test_tokens_from_bytes():
    import pyarrow as pa

    texts = ["", None, "a  b", " É Ab", "x" * 9, "\n", "a", "ab\x0bAB \u3000z"] * 3
    h, begin = lm.tokens(pa.array(texts).slice(2), (12345678, 87654321))
    cut = [h[i:j].tolist() for i, j in zip(begin, [*begin[1:], len(h)], strict=True)]
    names = {}
    for own, text in zip(cut, texts[2:], strict=True):
        assert len(own) == len(words(text))
        for a, b in zip(own, words(text), strict=True):
            assert names.setdefault(a, b) == b
    assert len(names) == len(set(names.values()))


def test_kneser_ney(spark):
    texts = [(i, t) for i, t in enumerate(["a b c a b", "A b", None, "", "c c c c", "x y z x y z a b", "b a", "q", "a b c d e f"])] + [(None, "a"), (3, "a b"), (3, "a b")]
    out = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1
    uni, bi = Counter(), Counter()
    for i, t in texts:
        if not out(i):
            w = words(t)
            uni.update(w)
            bi.update(zip(["begin "] + w[:-1], w, strict=True))
    n, v = sum(uni.values()), len(uni)
    held, followers, after = Counter(), defaultdict(Counter), Counter()
    for (a, b), c in bi.items():
        held[a] += c
        followers[a][min(c, 3)] += 1
        after[b] += 1
    d, e = (lm.discounts([list(x.values()).count(k) for k in (1, 2, 3, 4)]) for x in (bi, after))
    spare = sum(e[min(c, 3)] for c in after.values()) / len(bi)

    def p(a, b):
        low = (after[b] - e[min(after[b], 3)]) / len(bi) + spare / (v + 1)
        return (bi[a, b] - d[min(bi[a, b], 3)]) / held[a] + sum(d[k] * c for k, c in followers[a].items()) / held[a] * low if held[a] else low

    assert sum(p("a", x) for x in uni) + p("a", "? ?") == pytest.approx(1)
    want = []
    for i, t in texts:
        w = words(t)
        want.append((i, out(i), len(w), sum(x in uni for x in w), n, sum(math.log10((uni[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), sum(math.log10(p(a, b)) for a, b in zip(["begin "] + w[:-1], w, strict=True))))
    got = rows(lm.score_documents(docs(spark, texts)))
    for a, b in zip(got, sorted(want, key=str), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:])
    assert lm.score_documents(docs(spark, [])).count() == 0


def test_kneser_ney_of_order_3(spark):
    rng = random.Random(4)
    made = [" ".join(rng.choices("abcdef", [9, 6, 4, 2, 1, 1], k=rng.randrange(12))) for _ in range(60)]
    made += ["a b c " * 300 + "x", None, "", "a", "unseen", "a b unseen a b c"]
    texts = [*enumerate(made), (None, "a"), (3, "a b"), (3, "a b")]
    begin, uni, bi, tri = "begin ", Counter(), Counter(), Counter()
    for i, t in texts:
        if zlib.crc32(b"" if i is None else str(i).encode()) % 5 != 1:
            w = [begin, *words(t)]
            uni.update(w[1:])
            bi.update(zip(w, w[1:]))
            tri.update(zip(w, w[1:], w[2:]))
    assert max(tri.values()) > 254
    n, v, two, after = len(bi), len(uni), Counter({k: c for k, c in bi.items() if k[0] == begin}), Counter(b for _, b in bi)
    two.update((b, c) for _, b, c in tri)
    f, d, e = (lm.discounts([list(x.values()).count(k) for k in (1, 2, 3, 4)]) for x in (tri, two, after))
    assert len({tuple(x) for x in (f, d, e)}) == 3

    def step(counts, d, context, x, low):
        mine = {k[-1]: c for k, c in counts.items() if k[:-1] == context}
        held = sum(mine.values())
        return (mine.get(x, 0) - d[min(mine.get(x, 0), 3)] + sum(d[min(c, 3)] for c in mine.values()) * low) / held if held else low

    def p(context, x):
        low = (after[x] - e[min(after[x], 3)]) / n + sum(e[min(c, 3)] for c in after.values()) / n / (v + 1)
        low = step(two, d, context[-1:], x, low)
        return step(tri, f, context, x, low) if len(context) == 2 else low

    for context in ((begin,), (begin, "a"), ("a", "b"), ("c", "unseen")):
        assert sum(p(context, x) for x in [*uni, "? ?"]) == pytest.approx(1)
    known, want = {}, []
    for i, t in texts:
        w = [begin, *words(t)]
        for k in range(1, len(w)):
            c = tuple(w[max(0, k - 2) : k])
            if (c, w[k]) not in known:
                known[c, w[k]] = math.log10(p(c, w[k]))
        want.append((i or -1, len(w) - 1, sum(known[tuple(w[max(0, k - 2) : k]), w[k]] for k in range(1, len(w)))))
    got = sorted((r.doc_id or -1, r.n_tokens, r.score) for r in lm.score_documents(docs(spark, texts), order=3).collect())
    for a, b in zip(got, sorted(want), strict=True):
        assert a == pytest.approx(b)
    assert lm.score_documents(docs(spark, []), order=3).count() == 0
    assert {r.score for r in lm.score_documents(docs(spark, [(i, "a b") for i in range(99) if zlib.crc32(str(i).encode()) % 5 == 1]), order=3).collect()} == {0.0}


def test_language_id_has_letters():
    assert not langid.has_letter("½ ² Ⅷ ١٢ 12 _") and langid.has_letter("12 ª") and langid.has_letter("ไ")


def test_language_id_fit_by_formula():
    """The weights against follow-the-regularised-leader written out for each coordinate."""
    rng = random.Random(8)
    words = {"en": "the of and".split(), "fr": "le la des".split(), "de": "der und ein".split()}
    sample = [(" ".join(rng.choices(words[lang], k=6)), lang) for lang in rng.choices(list(words), k=40)]
    langs, idf = sorted(words), 1 + np.arange(langid.DIMS) % 7 / 7
    got = langid.fit(sample, langs, idf)
    x = []
    for text, lang in sample:
        f = Counter(int(k) for g in langid.grams(text) for k in g)
        x.append(({k: c / sum(f.values()) * idf[k] * langid.SCALE for k, c in f.items()} | {langid.DIMS: 1.0}, langs.index(lang)))
    train = [r for i, r in enumerate(x) if i % 5 != 4]
    z, n = Counter(), Counter()

    def weight(k):
        if abs(z[k]) <= langid.L1:
            return 0.0
        return -(z[k] - math.copysign(langid.L1, z[k])) / ((langid.BETA + math.sqrt(n[k])) / langid.ALPHA + langid.L2)

    order = np.random.default_rng(7)
    for _ in range(langid.EPOCHS):
        for i in order.permutation(len(train)):
            row, y = train[i]
            score = [sum(v * weight((k, c)) for k, v in row.items()) for c in range(3)]
            p = [math.exp(s - max(score)) for s in score]
            step = {}
            for c in range(3):
                for k, v in row.items():
                    step[k, c] = v * (p[c] / sum(p) - (c == y))
            for at, g in step.items():
                sigma = (math.sqrt(n[at] + g * g) - math.sqrt(n[at])) / langid.ALPHA
                z[at] += g - sigma * weight(at)
                n[at] += g * g
    for k in {k for row, _ in x for k in row if k < langid.DIMS}:
        for c in range(3):
            assert got.weights[k, c] == pytest.approx(weight((k, c)) * idf[k] * langid.SCALE, rel=1e-4, abs=1e-5)
    assert got.bias.tolist() == pytest.approx([weight((langid.DIMS, c)) for c in range(3)], rel=1e-4, abs=1e-6)


def test_language_id_of_held_out_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.predict_documents(df).where("held_out").join(df.select("doc_id", "lang"), "doc_id").where("lang is not null and lang_pred <> 'und'").collect()
    assert len(got) > 200 and sum(r.lang_pred == r.lang for r in got) / len(got) > 0.98


def test_language_id(spark):
    words = {"en": "the of and to in that was".split(), "fr": "le la des que dans pour était".split()}
    rng = random.Random(2)
    made = [(i, " ".join(rng.choice(words[lang]) for _ in range(20)), lang) for i in range(120) for lang in [rng.choice(["en", "fr"])]]
    made += [(500, None, "en"), (501, "12 + 3", "en"), (502, "the of", None), (None, "la des que", None), (503, "the " * 40000, "en")]
    df = spark.createDataFrame(made, "doc_id long, text string, lang string")
    got = langid.predict_documents(df).collect()
    assert len(got) == len(made) and all(0 <= r.score <= 1 for r in got)
    lang = {i: x for i, _, x in made if x}
    assert {r.lang_pred for r in got if r.doc_id in (500, 501)} == {"und"}
    assert all(r.lang_pred == lang[r.doc_id] for r in got if r.doc_id in lang and r.doc_id < 500)
    assert langid.predict_documents(df.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.predict_documents(df.where("lang is null")).collect()} == {"und"}


@pytest.mark.parametrize("small", [True, False])
def test_decontamination(spark, monkeypatch, small):
    if not small:
        monkeypatch.setattr(decontam, "MAX_BROADCAST", 0)
    items = [(7, "one two three four five six seven eight nine ten eleven"), (8, None), (9, "rights"), (10, "..."), (11, "all RIGHTS reserved"), (7, "null id")]
    windows = defaultdict(set)
    for i, t in items:
        w = ALNUM.findall((t or "").translate(LOWER))
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k : k + 10])].add(i)

    def brute(i, text):
        w, hit, found = ALNUM.findall((text or "").translate(LOWER)), set(), set()
        for k in range(len(w)):
            for q, ids in windows.items():
                if tuple(w[k : k + len(q)]) == q:
                    hit |= set(range(k, k + len(q)))
                    found |= ids
        names = sorted(map(str, found))
        return (i, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit))

    bench = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc_id int")
    assert rows(decontam.digest(docs(spark, ROWS), bench)) == sorted((brute(*r) for r in ROWS), key=str)
    assert decontam.digest(docs(spark, []), bench).count() == 0
    assert decontam.digest(docs(spark, ROWS[:3]), bench.limit(0)).where("contaminated").count() == 0


def test_warc(spark):
    pages = [(1, "http://a", "x"), (2, "http://b\r\nX: y", "x"), (3, None, None), (4, "u", ""), (None, "u", "x"), (5, "u", "é" * 50000), (5, "v", "é" * 50000), (6, "u", "q\r\n\r\nz"), (None, "u", "n"), (None, "u", "n")]
    by, want, none = defaultdict(list), [], -(1 << 63)
    for k, (i, _, h) in enumerate(pages):
        by[(h or "").encode()].append((none if i is None else i, k))
    for data, held in by.items():
        top = max(held)
        for x in held:
            want.append((None if x[0] == none else x[0], len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if x == top else "revisit", None if x == top or top[0] == none else top[0]))
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, digest int")
    assert rows(warc.round_trip(df)) == sorted(want, key=str)
    assert warc.round_trip(df.limit(0)).count() == 0
    assert warc.round_trip(df, min_bytes=2).where("record_type = 'revisit'").count() == 1


def removed(texts, length=200):
    """Per text what the contract asks for, from a count of all strings of `length` bytes."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(hashlib.md5(b[p : p + length]).digest() for b in data for p in range(len(b) - length + 1))
    for b in data:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if seen[hashlib.md5(b[p : p + length]).digest()] > 1:
                gone[p : p + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        yield len(b), int(gone.sum()), int((gone & ~np.append(False, gone[:-1])).sum()) if len(b) else 0, hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("crowd, bases", [(512, None), (1, None), (512, (1, 1))])
def test_suffix_dedup(spark, monkeypatch, crowd, bases):
    """Few and many blocks to an anchor; with base 1 a hash is the sum of the bytes, so that very many collide."""
    whole = suffix.repeated_runs
    monkeypatch.setattr(suffix, "repeated_runs", lambda d, length=200: whole(d, length, crowd))
    if bases:
        monkeypatch.setattr(suffix, "random_bases", lambda: bases)
    rng = random.Random(3)
    text = lambda n: " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(n))
    shared = [text(80) for _ in range(4)]
    made = [(i, text(rng.randint(0, 60)) + " ".join(rng.choice([x, x[rng.randint(0, 100) :], x[: rng.randint(150, 300)]]) for x in rng.sample(shared, 2)) + text(20)) for i in range(40)]
    made += [(900, "a" * 1000), (901, "ab" * 300), (902, None), (903, ""), (904, "x" * 199), (905, "y" * 200), (906, "y" * 200), (None, shared[0]), (907, shared[0]), (907, shared[0])]
    made += [(908, "".join(sorted(shared[1]))), (909, shared[1][::-1]), (910, text(60000) + shared[2] + text(60000))]
    want = [(i, *x) for (i, _), x in zip(made, removed([t for _, t in made]), strict=True)]
    assert rows(suffix.digest(docs(spark, made))) == sorted(want, key=str)
    assert suffix.digest(docs(spark, [])).count() == 0


def test_suffix_dedup_of_columns_with_its_own_names(spark):
    names = ["runs", "run_id", "RUN_TH", "c0", "t", "doc_id", "text", "n_bytes", "Kept_Text"]
    df = spark.createDataFrame([("a", 1, 2, 3, "x", 7, "y" * 300, 5, "z"), ("b", 1, 2, 3, "x", 8, "y" * 300 + "q", 5, None)], names)
    got = suffix.dedup(df)
    assert got.columns == [*names[:7], *suffix.NEW]
    assert sorted((r.runs, r.c0, r.kept_text) for r in got.collect()) == [("a", 3, ""), ("b", 3, "q")]


def test_mergesort_by_hashes():
    rng = random.Random(5)
    texts = ["".join(rng.choices("ab", k=rng.randint(0, 40))) for _ in range(300)]
    group = np.sort(np.array([rng.randrange(7) for _ in texts]))
    data = np.frombuffer("".join(texts).encode() + bytes(1), np.uint8)
    reach = np.array([len(t) for t in texts])
    begin = np.cumsum(np.append(0, reach[:-1]))
    for bases in ((1, 1), suffix.random_bases()):
        one, two = (suffix.Prefixes(data, b) for b in bases)
        for step, place in ((1, begin), (-1, begin + reach)):
            order, n = suffix.classes(data, place, reach, group, one, two, step)
            keys = [(group[k], texts[k][::step]) for k in order]
            assert keys == sorted(keys)
            for (g, a), (h, b), m in zip(keys, keys[1:], n[1:], strict=False):
                assert m == (-1 if g != h else next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b))))


ODD = ["", "  ", " a", "a  b   c", "\n\n\nx", "it's we'll I'D 's", "<|endoftext|>", "a<|endoftext|> b<|endoftext|>", "日本語 한국어 ไทย", "x y　z", "a\x1cb\x85c", "12 ½ ² Ⅷ ١٢", "🙂🙂 x🙂", "x" * 5000, " " * 3000, "a\r\nb"]


def test_token_counts(spark):
    from tokenizers import Tokenizer

    texts = [t or "" for t in TEXTS] + ODD
    library = Tokenizer.from_file(tokens.vocabulary_path())
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    got = {r.doc_id: tuple(r)[1:] for r in tokens.count_documents(docs(spark, list(enumerate(texts)))).collect()}
    assert [got[i] for i in range(len(texts))] == [(len(t.encode()), n, n > 512) for t, n in zip(texts, want, strict=True)]
    assert tokens.count_documents(docs(spark, [(None, None), (1, "a"), (1, "a")])).count() == 3
    assert tokens.count_documents(docs(spark, [])).count() == 0


def test_unsure_characters_are_all_that_differ():
    """Every character between others, by both pattern libraries."""
    import public_tokenizers
    import regex
    from tokenizers import Tokenizer

    cut = Tokenizer.from_file(tokens.vocabulary_path()).pre_tokenizer.pre_tokenize_str
    own, unsure = regex.compile(public_tokenizers.PATTERN), regex.compile(tokens.unsure())
    for c in [*range(0xD800), *range(0xE000, 0x110000, 1 if len(tokens.UNSURE) < 10 else 3)]:
        text = f"a{chr(c)}a1{chr(c)}1 {chr(c)} !{chr(c)}"
        assert unsure.search(text) or [m.span() for m in own.finditer(text)] == [o for _, o in cut(text)], hex(c)


def field(number, value):
    """A field of a protobuf message."""
    import struct

    def varint(n):
        return bytes([n & 127 | 128]) + varint(n >> 7) if n > 127 else bytes([n])

    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    return varint(number << 3 | 2) + varint(len(value)) + value


def unigram_model(path, more=(), **normaliser):
    """A small model file, its scores given."""
    scored = [("▁", -2.0), ("▁the", -1.5), ("▁they", -2.5), ("▁a", -2.2), ("th", -3.0), ("e", -3.1), ("y", -3.5), ("he", -2.9), ("▁t", -3.2), ("hey", -3.3), ("a", -3.4), ("b", -4.0), ("ab", -3.9), *more]
    kinds = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *[(f"<0x{i:02X}>", 0.0, 6) for i in range(256)], *[(p, s, 1) for p, s in scored]]
    data = b"".join(field(1, field(1, p.encode()) + field(2, s) + field(3, k)) for p, s, k in kinds)
    data += field(2, field(3, 1) + field(35, 1) + field(4, len(kinds))) + field(3, field(3, 1) + field(4, 0) + field(5, 1))
    path.write_bytes(data)
    return str(path)


def test_unigram_model(tmp_path):
    path = unigram_model(tmp_path / "u.model")
    texts = ["", "the they a", "they", "thea b", "ab", "  the", "x the é", "theythey", "b a  a"]
    assert pieces.Pieces(path).spec.kind == 1 and pieces.parity(path, texts) == []
    made = pieces.Pieces(path).compare(path)
    ids, back, same = made.encode_both(texts)
    assert back == texts and all(same) and made.decode(ids) == texts


def test_unsupported_models(tmp_path):
    path = tmp_path / "m.model"
    for data in (field(1, field(1, b"x") + field(3, 4)) + field(2, field(3, 1)), field(2, field(3, 1) + field(24, 1)), field(2, field(3, 1)) + field(3, field(5, 0)), field(2, field(3, 3))):
        path.write_bytes(data)
        with pytest.raises(ValueError):
            pieces.Pieces(str(path))


def test_sentencepiece(spark, monkeypatch):
    texts = [t or "" for t in TEXTS] + ODD + ["▁ a▁b ▁▁ c"]
    assert pieces.parity(pieces.model_path(), texts) == []
    monkeypatch.setattr(pieces, "CUT", 10)
    assert pieces.parity(pieces.model_path(), texts) == []
    got = pieces.decode(pieces.encode(docs(spark, list(enumerate(texts[:-1])), extra=False))).collect()
    assert all(r.round_trip and r.decoded == texts[r.doc_id] and r.n_tokens == len(r.ids) for r in got)
    assert pieces.round_trip(docs(spark, ROWS)).where("not round_trip").count() == 0
    assert pieces.round_trip(docs(spark, [])).count() == 0
