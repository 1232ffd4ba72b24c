import math
import os
import random
import zlib

import numpy as np
import pytest

from siftstone.llm import learning
from siftstone.llm import quality_classifier as q


def fixture(n=300):
    r = random.Random(11)
    word = lambda: "".join(r.choices("abcdefghinost", k=r.randint(2, 7)))
    rows, labels = [], []
    for i in range(n):
        w = [word() for _ in range(r.choice([1, 5, 60, 200]))]
        good = r.random() < 0.8
        if not good:
            w = r.choice([lambda w: [x.upper() + "!!" for x in w], lambda w: [x + "###" for x in w], lambda w: [x for x in w for _ in range(9)]])(w * 5)
        rows.append((i, " ".join(w)))
        labels.append((i, int(good)))
    return rows, labels


def test_held_out_accuracy_and_odd_rows(spark):
    rows, labels = fixture()
    odd = [(1000, None), (1001, ""), (1002, "x " * 50_000), (None, rows[0][1]), rows[1], rows[1]]
    docs = spark.createDataFrame([(*x, "clash") for x in rows + odd], "doc_id long, text string, Score string")
    known = spark.createDataFrame([*labels, labels[0], (None, 1), (5000, 0), (7, None)], "doc_id long, quality int")
    out = q.classify(docs, known).collect()
    assert len(out) == len(rows) + len(odd) and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.3) for x in out)
    truth, seen = dict(labels), 0
    for x in out:
        assert x.held_out == (x.doc_id is None or zlib.crc32(str(x.doc_id).encode()) % 5 == 0)
        if x.held_out and x.doc_id in truth:
            seen += x.predicted == truth[x.doc_id]
    total = sum(x.held_out and x.doc_id in truth for x in out)
    assert total > 30 and seen / total > 0.95
    assert sorted(map(str, out)) == sorted(map(str, q.classify(docs, known).collect()))


def test_no_labels_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [(x.score, x.predicted) for x in q.classify(docs, none).collect()] == [(0.5, 1)]
    assert q.classify(docs.limit(0), none).count() == 0


def test_score_is_a_sparse_dot_product():
    r = np.random.default_rng(1)
    w = r.normal(size=q.SIZE).astype("<f4")
    for text in (b"", b"one", b"Two two two", " ".join(["Één", "twee!!", "3", "a"] * 40).encode()):
        at, x = q.example(text, q.Words())
        want = 1 / (1 + math.exp(-float(w[at].astype(float) @ x)))
        assert abs(q.score(text, w, q.Words()) - want) < 1e-4


def test_ftrl_follows_its_definition():
    r = random.Random(2)
    model, z, n = learning.Ftrl(6, 0.3, 1.0, 0.2, 0.1), [0.0] * 6, [0.0] * 6

    def weight(i):
        return 0.0 if abs(z[i]) <= 0.2 else -(z[i] - math.copysign(0.2, z[i])) / ((1 + math.sqrt(n[i])) / 0.3 + 0.1)

    for _ in range(80):
        at, y = sorted(r.sample(range(6), 3)), r.randrange(2)
        x = [r.random() for _ in at]
        model.learn(np.array(at), np.array(x), y)
        w = [weight(i) for i in at]
        p = 1 / (1 + math.exp(-sum(a * b for a, b in zip(w, x))))
        for i, wi, xi in zip(at, w, x):
            g = (p - y) * xi
            z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / 0.3 * wi
            n[i] += g * g
    assert np.allclose(model.weights(), [weight(i) for i in range(6)])


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the tables")
def test_tables(spark):
    sf = "/root/testdata/sf0.01"
    out = q.op7_quality_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out")
    right, total = out.selectExpr("sum(int(predicted = quality))", "count(*)").first()
    assert right / total > 0.97
