import hashlib
import random

import numpy as np

from siftstone.llm import line_dedup as d


def brute(rows, min_docs=5, min_chars=40):
    blank = " \t\n\r\x0b\x0c"

    def key(x):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(blank))

    holders = {}
    for i, (doc, text) in enumerate(rows):
        for x in (text or "").split("\n"):
            if len(key(x)) >= min_chars:
                holders.setdefault(key(x), set()).add(doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [
            x
            for x in lines
            if len(holders.get(key(x), ())) < min_docs or doc is not None and doc == max(h for h in holders[key(x)] if h is not None)
        ]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def rows():
    r = random.Random(2)
    lines = [" ".join(r.choices(["Alpha", "beta", "É", "gamma", "|"], k=k)) for k in (1, 5, 8, 9, 12, 30) for _ in range(6)]
    out = []
    for i in range(120):
        text = "\n".join(r.choice([lambda x: x, str.upper, lambda x: f" \t{x}\r"])(r.choice(lines)) for _ in range(r.randint(0, 7)))
        out.append((i, text))
    hot = "the very same line stands in each of these documents, again and again"
    out += [(200 + i, f"{hot}\n{i}\n\n{hot} ") for i in range(300)]
    return [*out, (900, None), (901, ""), (902, "\n\n"), (None, hot), (None, hot), (903, "x" * 100_000 + "\n" + hot), (903, hot), (903, hot)]


def collect(df):
    return sorted(((x.doc_id, x.n_lines, x.n_dropped, x.kept_text) for x in df.collect()), key=str)


def test_matches_brute_force(spark):
    data = rows()
    df = spark.createDataFrame([(i, t, "clash") for i, t in data], "doc_id long, text string, N_lines string")
    assert collect(d.dedup_lines(df)) == brute(data)
    assert collect(d.dedup_lines(df, shard_keys=8)) == brute(data)


def test_empty_table(spark):
    assert d.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_perfect_hash_is_minimal():
    r = np.random.default_rng(0)
    a, b = (r.integers(0, 2**64, 5000, dtype=np.uint64) for _ in range(2))
    h = d.PerfectHash.build(a, b)
    assert sorted(h.slots(a, b)) == list(range(5000)) and h.size == 5000


def test_query_digest(spark, tmp_path):
    data = [x for x in rows() if x[0] is not None][:60]
    spark.createDataFrame(data, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(x) for x in d.op3_line_dedup(spark, str(tmp_path)).collect())
    assert got == sorted((i, n, m, hashlib.sha256(t.encode()).hexdigest()) for i, n, m, t in brute(data))
