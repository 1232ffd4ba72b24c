import collections
import random

import duckdb
import numpy as np

from siftstone.llm import quality_rules as q


def brute(text):
    text = text or ""
    raw = text.encode().split()
    words = [w.decode() for w in raw]
    again = collections.Counter(zip(words, words[1:], words[2:]))
    covered = {i + o for i in range(len(words) - 2) if again[tuple(words[i : i + 3])] > 1 for o in range(3)}
    lines = [x for x in text.split("\n") if x.encode().split()]
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))


def rows():
    r = random.Random(4)
    vocabulary = ["".join(r.choices("abcdefghijklmnop", k=r.randint(2, 8))) for _ in range(600)]
    prose = lambda n: " ".join(r.choices(vocabulary, k=n))
    out = []
    for i in range(150):
        n = r.choice([60, 90, 200, 500])
        text = "\n".join(prose(n // 3) for _ in range(3))
        if i % 12 == 0:
            text = " ".join(w + "###" for w in text.split())
        out.append((i, text, r.choice(["en", "de", None]), r.choice(["a", "b", None])))
    odd = [None, "", " \n\t", "a b", "x y z " * 80, prose(80) + "\n" + prose(30), "one\x1cword here " * 60, "é ü " * 40 + prose(100), prose(20000)]
    twice = "same line of words\n" * 2 + prose(70)
    return out + [(200 + i, t, "en", "a") for i, t in enumerate([*odd, twice, twice])] + [(210, twice, "en", "a"), (None, prose(70), "en", "a")]


def test_counts_and_verdict(spark, tmp_path):
    data = rows()
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = q.op2_quality_rules(spark, str(tmp_path)).collect()
    text = collections.defaultdict(list)
    for d, t, *_ in data:
        text[d].append(t)
    assert len(got) == len(data)
    for x in got:
        assert tuple(x)[1:6] == brute(text[x.doc_id][0]), x.doc_id
        assert x.base_failed == (x.n_words < 50 or 2 * x.n_repeat_words > x.n_words)
        assert not (x.base_failed and x.kept)
    kept = {x.doc_id: x.kept for x in got}
    assert not any(kept[i] for i in range(0, 150, 12)) and all(kept[i] for i in range(150) if i % 12)
    one = [x for x in data if x[0] is not None and x[0] not in (209, 210)]
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, lang varchar, source varchar)")
    con.executemany("insert into documents values (?, ?, ?, ?)", one)
    want = con.sql(q.op2_sql()).fetchall()
    spark.createDataFrame(one, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{tmp_path}/two/documents.parquet")
    assert sorted(map(tuple, q.op2_quality_rules(spark, f"{tmp_path}/two").collect())) == sorted(want)


def test_operator_keeps_other_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b " * 60, "en", "a", "x")], "doc_id long, text string, lang string, source string, KEPT string")
    out = q.judge(df)
    assert out.columns == ["doc_id", "text", "lang", "source", *q.STATS[:5], "base_failed", "kept", "distance"]
    assert q.judge(df.limit(0)).count() == 0
    assert [x.kept for x in q.judge(spark.createDataFrame([(1, " ".join(map(str, range(60))), "en", "a")], df.schema[:4])).collect()] == [True]


def moments(x):
    m = x.mean(axis=0)
    return m, (x - m).T @ (x - m) / len(x) * q.SCALE + np.diag([(f * k) ** 2 for f, k in zip(q.FLOORS, q.STEPS)])


def least_determinant(x, starts, seed):
    """Smallest determinant of the floored covariance of half the points, from random starts run to their end."""
    r, best, half = np.random.default_rng(seed), np.inf, -(-len(x) // 2)
    for _ in range(starts):
        m, c = moments(x[r.choice(len(x), 5, replace=False)])
        for _ in range(40):
            y = x - m
            near = np.argsort(np.einsum("ij,jk,ik->i", y, np.linalg.inv(c), y), kind="stable")[:half]
            m, new = moments(x[near])
            if np.allclose(new, c, rtol=1e-12):
                break
            c = new
        best = min(best, np.linalg.det(c))
    return best


def test_determinants_are_minimal(spark):
    r, rows = np.random.default_rng(3), []
    for g in range(6):
        for i in range(60 + 50 * g):
            odd = r.random() < 0.3
            n = int(r.integers(60, 900))
            rows.append((f"{g}", n, int(n * r.normal(5 + 2 * odd, 0.4)), int(n * max(0, r.normal(0.3 * odd, 0.1))), int(r.integers(0, 3 + 5 * odd)), int(n * r.random() * 0.4 * odd), 20))
    counted = spark.createDataFrame([(None, "en", *x) for x in rows], f"__row string, lang string, source string, {', '.join(f'{c} long' for c in q.STATS)}")
    vectors = q.vectors_of(counted)
    x = {}
    for v in vectors.select("source", "q1", "q2", "q3", "q4").collect():
        x.setdefault(v.source, []).append(v[1:])
    found = q.robust_estimates(vectors.drop("__row")).collect()
    assert {e.lv for e in found} == {2} and len(found) == 6
    for e in found:
        det = (e.l11 * e.l22 * e.l33 * e.l44) ** 2
        best = least_determinant(np.array(x[e.k.split(":")[-1]], float), 100, 1)
        assert det < 1.001 * best, (e.k, det / best)


def test_small_groups_use_their_language(spark):
    r = random.Random(8)
    rows = [(i, " ".join(f"w{r.randrange(400)}" for _ in range(80)), "en" if i < 60 else "de", f"s{i % 9}" if i < 60 else "t") for i in range(66)]
    rows += [(100, " ".join(f"w{i}" + "#" * 4 for i in range(80)), "de", "t"), (101, " ".join(f"w{i}" + "#" * 4 for i in range(80)), "en", "s1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    levels = {(e.lv, e.k) for e in q.robust_estimates(q.vectors_of(q.with_counts(df))).collect()}
    assert levels == {(1, "2:en"), (0, "all")}
    assert {x.doc_id for x in q.judge(df).collect() if not x.kept} == {100, 101}


def test_each_part_can_reject_alone(spark):
    r = random.Random(2)
    prose = lambda n: " ".join(f"{r.choice('abcdefgh')}{r.randrange(900):03d}x" for _ in range(n))
    phrase = prose(6)
    bad = {
        "lines": "\n".join(["one", *["one"] * 30, *(prose(12) for _ in range(10))]),
        "words": f"{prose(33)} {phrase} {prose(33)} {' '.join([phrase] * 8)}",
        "symbols": "\n".join([prose(12), *(prose(12) + " ##" * 6 for _ in range(9))]),
        "length": " ".join("antidisestablishment" + str(i) for i in range(120)),
    }
    rows = [(i, "\n".join(prose(12) for _ in range(10)), "en", what) for what in bad for i in range(30)]
    rows += [(99, text, "en", what) for what, text in bad.items()]
    for x in q.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect():
        assert not x.base_failed and x.kept == (x.doc_id != 99), x
