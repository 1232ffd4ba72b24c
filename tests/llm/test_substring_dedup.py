import hashlib
import random

from siftstone.llm import substring_dedup as s


def brute(rows):
    order = lambda d: (d is None, d or 0)
    first, texts = {}, [(d, (t or "").encode().split()) for d, t in rows]
    for d, w in texts:
        for i in range(len(w) - 19):
            k = tuple(w[i : i + 20])
            first[k] = min(first.get(k, (order(d), i)), (order(d), i))
    out = []
    for d, w in texts:
        gone = {i + o for i in range(len(w) - 19) if first[tuple(w[i : i + 20])] != (order(d), i) for o in range(20)}
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def rows():
    r = random.Random(3)
    prose = lambda n: [r.choice(["alpha", "Beta", "é", "x", "y", "zeta", "eta", "theta"]) + str(r.randrange(30)) for _ in range(n)]
    passages = [prose(n) for n in (19, 20, 21, 35, 60)]
    out = []
    for i in range(60):
        w = prose(r.choice([0, 5, 19, 20, 21, 80]))
        for _ in range(r.randint(0, 3)):
            at = r.randint(0, len(w))
            p = r.choice(passages)
            a = r.randint(0, 5)
            w[at:at] = p[a:] if r.random() < 0.5 else p
        out.append((i, r.choice([" ", "\n", " \t"]).join(w)))
    out += [(100 + i, out[i][1]) for i in range(10)] + [out[3], (3, out[4][1])]
    return [*out, (200, None), (201, ""), (202, "a " * 500), (203, "a b " * 30), (204, "one\x1cword " * 25), (None, out[5][1]), (205, " ".join(prose(20000)))]


def test_matches_brute_force(spark, tmp_path):
    data = rows()
    spark.createDataFrame([(*x, 1) for x in data], "doc_id long, text string, n_Words int").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, s.op8_substring_dedup(spark, str(tmp_path)).collect()), key=str)
    assert got == brute(data)
    out = s.dedup_substrings(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    assert out.columns == ["doc_id", "text", "kept_text", "n_words", "n_removed"]


def test_empty_table(spark):
    assert s.dedup_substrings(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_repeats_of_a_slice_need_no_probes():
    import numpy as np

    r = np.random.default_rng(1)
    for n in (0, 1, 300):
        h = r.integers(0, 80, n).astype(np.uint64) << np.uint64(40)
        anchor = r.random(n) < 0.2
        sole, settled, anchors = s.own_repeats(h, anchor)
        groups = {x: np.flatnonzero(h == x) for x in set(h.tolist())}
        want = sorted(i for g in groups.values() if len(g) > 1 and anchor[g].any() for i in g.tolist())
        assert settled.tolist() == want and sole.tolist() == sorted(set(range(n)) - set(want))
        assert sorted(h[anchors].tolist()) == sorted(x for x, g in groups.items() if anchor[g].any()) and anchor[anchors].all()


def test_many_shards_give_the_same(spark, monkeypatch):
    data = [x for x in rows() if x[0] is not None]
    df = spark.createDataFrame(data, "doc_id long, text string")
    want = sorted((x.doc_id, x.kept_text) for x in s.dedup_substrings(df).collect())
    monkeypatch.setattr(s, "SHARD_ANCHORS", 20)
    assert sorted((x.doc_id, x.kept_text) for x in s.dedup_substrings(df).collect()) == want


def test_ids_are_whole_numbers(spark):
    import pytest

    with pytest.raises(TypeError):
        s.dedup_substrings(spark.createDataFrame([("a", "b")], "doc_id string, text string"))
