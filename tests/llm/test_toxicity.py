import itertools
import os
import random
import zlib

import numpy as np
import pytest

from siftstone.llm import toxicity as t

BAD = ["idiot", "moron", "worthless", "scum", "loser"]


def fixture(n=1500):
    r = random.Random(3)
    parts = ["on", "ing", "er", "th", "re", "le", "sa", "mo", "ti", "en", "wor", "los", "id", "ess"]
    word = lambda: "".join(r.choices(parts, k=r.randint(1, 3)))
    rows, labels = [], []
    for i in range(n):
        w = [word() for _ in range(r.choice([8, 40, 90]))]
        bad = r.random() < 0.3
        for _ in range(r.randint(1, 3) if bad else 0):
            w.insert(r.randrange(len(w)), r.choice(BAD))
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    return rows, labels


def table_of(texts):
    of, total = t.codes(), np.zeros(t.SYMBOLS**4, np.int64)
    for x in texts:
        total += np.bincount(t.grams(x.encode(), of), minlength=len(total))
    return t.costs([(i, total[i]) for i in np.flatnonzero(total)])


def test_planted_and_clean_documents(spark):
    rows, labels = fixture()
    read = t.ready(table_of([x for _, x in rows]))
    for raw in ("1d10t", "i d i o t", "IDIOT!!", "m0r0n", "mooooroooon", "w0rthl3ss", "l.o.s.e.r", "5cum", "$cum", "lo-ser", "m 0 r 0 n"):
        assert t.restored(f"the {raw} on", read) & {"idiot", "moron", "worthles", "scum", "loser"}, raw
    odd = ["on the th 1d10t ing", "this i d i o t er", "a mooooron le", "w0rthl3ss re on", "er th on ing 2024 re 7th", "", None, " \n", "x " * 30_000 + "moron"]
    extra = [(1000 + i, x) for i, x in enumerate(odd)] + [rows[0], rows[0], (None, rows[1][1])]
    docs = spark.createDataFrame([(*x, 1) for x in rows + extra], "doc_id long, text string, predicted int")
    known = spark.createDataFrame([*labels, (None, 1), (4, None)], "doc_id long, toxic int")
    out = t.score_toxicity(docs, known).collect()
    assert len(out) == len(rows) + len(extra) and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.5) for x in out)
    got = {x.doc_id: x.predicted for x in out}
    assert [got[1000 + i] for i in range(9)] == [1, 1, 1, 1, 0, 0, 0, 0, 1]
    held = [x for x in out if x.held_out and x.doc_id is not None and x.doc_id < 1000]
    assert all(zlib.crc32(str(x.doc_id).encode()) % 5 == 0 for x in held)
    assert sum(x.predicted == dict(labels)[x.doc_id] for x in held) / len(held) > 0.95


def test_no_labels_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [(x.score, x.predicted) for x in t.score_toxicity(docs, none).collect()] == [(0.5, 1)]
    assert t.score_toxicity(docs.limit(0), none).count() == 0


def test_search_finds_the_cheapest_reading():
    cost = np.frombuffer(table_of([x for _, x in fixture()[0]]), "<f4").reshape((t.SYMBOLS,) * 4)

    def price(choice):
        total, context = sum(extra for _, extra in choice), [0, 0, 0]
        for s in [t.symbol(c) for letters, _ in choice for c in letters] + [0]:
            total += float(cost[(*context, s)])
            context = [*context[1:], s]
        return total

    for raw in ("1d10t", "m0r0n", "s7er", "t11on"):
        options = [[(c, 0.0)] if c.isalpha() else None for c in raw]
        runs = [("".join(g)) for _, g in itertools.groupby(raw)]
        options = []
        for run in runs:
            c, n = run[0], len(run)
            if c.isalpha():
                options.append([(c, 0.0)])
            else:
                own = [(x * k, t.LOOK_COST + (t.RUN_COST if n > 2 or k != n else 0.0)) for x in t.LOOKS[c] for k in {1, min(n, 2)}]
                options.append([*own, ("", t.DROP_LOOK_COST)])
        best = min(itertools.product(*options), key=price)
        assert t.decode(raw, cost.tolist()) == "".join(x for x, _ in best)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the tables")
def test_tables(spark):
    sf = "/root/testdata/sf0.01"
    out = t.op4_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out")
    right, total = out.selectExpr("sum(int(predicted = toxic))", "count(*)").first()
    assert right / total > 0.9
