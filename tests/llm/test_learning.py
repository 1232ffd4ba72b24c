"""Bounds of the fit, and whole scores against plain Python that goes from texts and labels to a number."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftstone.llm import learning
from siftstone.llm import quality_classifier as q
from siftstone.llm import toxicity as t


def test_sample_of_many_labels_is_never_empty(spark):
    labels = spark.range(20_000).selectExpr("id as doc_id", "int(id % 2) as toxic")
    for rows in (1, 40, 400, 30_000):
        n = learning.labelled_sample(labels, "toxic", rows).count()
        assert n == 0 if rows == 1 and not n else abs(n - min(rows, 16_000)) < 300, (rows, n)
    # A share below one in 2**20 still leaves a bound above zero.
    assert (1 << 62) * 8000 // 10**13 > 0


def examples(spark, sizes):
    rows = []
    for i, n in enumerate(sizes):
        at = np.arange(1, n + 1, dtype="<i4")
        rows.append((i, i % 2, bytearray(at.tobytes()), bytearray(np.full(n, 1 + i % 3, "<f4").tobytes())))
    return spark.createDataFrame(rows, "__id long, label int, at binary, x binary")


def test_fit_holds_a_bounded_number_of_bytes(spark):
    """Few very long examples: the sample ends before the bound, in the order of the ids' hash."""
    sizes = [5000] * 12
    df = examples(spark, sizes)
    order = [r["__id"] for r in df.orderBy(F.xxhash64("__id", F.lit("order"))).collect()]
    rates = {"alpha": 0.3, "beta": 1.0, "l2": 0.01}
    held = learning.fit(df, 6000, 2, l1=0.0, sample_bytes=3 * 40_000, **rates)
    only = learning.fit(df.where(F.col("__id").isin(order[:3])), 6000, 2, l1=0.0, **rates)
    assert held == only != learning.fit(df, 6000, 2, l1=0.0, **rates)
    one = learning.fit(df, 6000, 2, l1=0.0, sample_bytes=1, **rates)
    assert one == learning.fit(df.where(F.col("__id") == order[0]), 6000, 2, l1=0.0, **rates)


def ftrl(rows, epochs, alpha, l1, l2):
    """Weights by the definition, coordinate by coordinate."""
    z, n = {}, {}

    def weight(i):
        zi = z.get(i, 0.0)
        return 0.0 if abs(zi) <= l1 else -(zi - math.copysign(l1, zi)) / ((1 + math.sqrt(n[i])) / alpha + l2)

    for _ in range(epochs):
        for x, y in rows:
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-max(-30, min(30, sum(w[i] * v for i, v in x.items())))))
            for i, v in x.items():
                g = (p - y) * v
                z[i] = z.get(i, 0.0) + g - (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / alpha * w[i]
                n[i] = n.get(i, 0.0) + g * g
    return {i: w for i in z if (w := weight(i))}


def learning_order(spark, ids):
    frame = spark.createDataFrame([(i,) for i in ids], "__id long")
    return [r["__id"] for r in frame.orderBy(F.xxhash64("__id", F.lit("order"))).collect()]


def corpus(n=70):
    r = random.Random(21)
    rows, labels = [], []
    for i in range(n):
        words = ["".join(r.choices("abdeiklmnorst", k=r.randint(2, 8))) for _ in range(r.choice([3, 30, 80]))]
        bad = i % 3 == 0
        if bad:
            words = [w.upper() + "!" * (k % 4) for k, w in enumerate(words)] + ["idiot", "1d10t"]
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return rows, labels


def taught(labels):
    return {i: y for i, y in labels if zlib.crc32(str(i).encode()) % 5}


def test_quality_score_by_brute_force(spark):
    rows, labels = corpus()
    text, known = dict(rows), taught(labels)

    def shape(word):
        signs = ["A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word]
        return "".join(s for s, before in zip(signs, ["", *signs]) if s != before)

    def vector(x):
        from xxhash import xxh3_64_intdigest as digest

        words = x.split()
        lower = [digest(w.lower()) >> 32 for w in words]
        shapes = [digest(shape(w)) >> 32 for w in words]
        shapes = [12345 if k and words[k].lower() == words[k - 1].lower() and shape(words[k]) == shape(words[k - 1]) else s for k, s in enumerate(shapes)]
        out = {q.CONSTANT: 1.0}
        for k, (stream, n) in enumerate(((lower, 1), (lower, 2), (shapes, 1), (shapes, 2), (shapes, 3)), 1):
            grams = []
            for i in range(len(stream) - n + 1):
                h = k
                for s in stream[i : i + n]:
                    h = (h ^ s) * 0x9E3779B97F4A7C15 % 2**64
                    h ^= h >> 29
                grams.append(2 + (h >> 20) % (q.SIZE - 2))
            for g in grams:
                out[g] = out.get(g, 0.0) + q.SCALE / len(grams)
        return out

    learned = [(vector(text[i]), known[i]) for i in learning_order(spark, known)]
    w = ftrl(learned, q.EPOCHS, 0.1, 0.03, 0.01)
    got = q.classify(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    for x in got:
        want = 1 / (1 + math.exp(-sum(w.get(i, 0.0) * v for i, v in vector(x.text).items())))
        assert x.score == pytest.approx(want, abs=1e-4), x.doc_id


def test_toxicity_score_by_brute_force(spark):
    rows, labels = corpus()
    text, known = dict(rows), taught(labels)
    total = np.zeros(t.SYMBOLS**4, np.int64)
    for _, x in rows:
        np.add.at(total, t.grams(x.encode(), t.codes()), 1)
    read = t.ready(t.costs([(i, total[i]) for i in np.flatnonzero(total)]))

    def vector(x):
        out = {t.CONSTANT: 1.0}
        for word in t.restored(x, read):
            data, h = word.encode(), 0xCBF29CE484222325
            hashes = []
            for n, byte in enumerate(data, 1):
                h = (h ^ byte) * 0x100000001B3 % 2**64
                if 3 <= n <= 7:
                    hashes.append(h)
            hashes.append((h ^ ord(" ")) * 0x100000001B3 % 2**64)
            for h in hashes:
                at = 1 + (h * 0x9E3779B97F4A7C15 % 2**64 >> 40) % (t.SIZE - 1)
                out[at] = out.get(at, 0.0) + 1
        return out

    learned = [(vector(text[i]), known[i]) for i in learning_order(spark, known)]
    chosen = ftrl(learned, t.EPOCHS, 0.3, 3.0, 0.01)
    w = ftrl([({i: v for i, v in x.items() if i in chosen}, y) for x, y in learned], t.EPOCHS, 0.3, 0.1, 0.01)
    got = t.score_toxicity(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert {x.predicted for x in got} == {0, 1}
    for x in got:
        want = 1 / (1 + math.exp(-sum(w.get(i, 0.0) * v for i, v in vector(x.text).items())))
        assert x.score == pytest.approx(want, abs=1e-4), x.doc_id


def test_bulk_reading_equals_word_by_word():
    raws = ["Idiot!", "1d10t", "çà", "ÉTÉ", "aaa", "aab", "a.b.c", "(x)", "!!", "", "Straße", "İx", "日本語", "x" * 90, "id", "t,", "5", "ﬁn", "été"]
    total = np.bincount(t.grams(" ".join(raws * 3).encode(), t.codes()), minlength=t.SYMBOLS**4)
    cost = t.costs([(i, total[i]) for i in np.flatnonzero(total)])
    many = t.ready(cost)
    many.learn(set(raws))
    for raw in raws:
        core = raw.strip(t.EDGE)
        want = t.TWICE.sub(r"\1", t.decode(core, many.cost).lower()) if core else ""
        assert many[raw] == t.ready(cost)[raw] == want, raw
    words = ["a", "ab", "idiot", "idiots", "é", "日本語の文章", "y" * 64, "y" * 65, "z" * 200]
    for word, row in zip(words, t.coordinates(words).tolist()):
        assert [v for v in row if v] == t.features(word), word


def test_shapes_of_any_length():
    assert q.shape("a-b-c-d-e-f-g-h") != q.shape("a-b-c-d-e-f-G!!!")
