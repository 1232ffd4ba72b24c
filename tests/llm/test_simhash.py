import random

import pytest
import xxhash

from siftstone.llm import simhash_dedup as s

WORDS = [f"w{i}" for i in range(400)]


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hs) > len(hs))


def brute(rows):
    fps = [brute_print(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            r = find(i)
            least[r] = min(least.get(r, d), d)
    return sorted(((d, f"{f:016x}", least.get(find(i))) for i, ((d, _), f) in enumerate(zip(rows, fps))), key=str)


def rows():
    r = random.Random(5)
    base = [" ".join(r.choices(WORDS, k=k)) for k in (1, 2, 3, 60, 300, 900)]
    out = [(i, t) for i, t in enumerate(base)]
    for n in range(60):
        words = base[r.choice([3, 4, 5])].split()
        for _ in range(r.randint(0, 4)):
            words[r.randrange(len(words))] = r.choice(WORDS)
        out.append((100 + n, (" \t" if n % 2 else "\n").join(words).upper()))
    return [*out, (7, None), (8, ""), (9, " \n"), (10, "É\x1cé " * 30), (None, base[3]), (50, base[4]), (50, base[4]), (51, "x " * 20000)]


def test_matches_brute_force(spark):
    data = rows()
    got = s.near_duplicates(spark.createDataFrame([(d, t, 1) for d, t in data], "doc_id long, text string, fingerprint int")).collect()
    assert sorted((tuple(x) for x in got), key=str) == brute(data)


@pytest.mark.parametrize("hot", [2, 8192])
def test_hot_buckets_lose_no_link(spark, hot):
    r = random.Random(1)
    centre = r.getrandbits(64)
    fps = {centre}
    for _ in range(150):
        x = r.choice(sorted(fps))
        for b in r.sample(range(64), r.randint(1, 3)):
            x ^= 1 << b
        fps.add(x)
    fps |= {r.getrandbits(64) for _ in range(100)}
    fps = sorted(fps)
    edges = s.links(spark.createDataFrame([(s.signed(x),) for x in fps], "__fp long"), hot_bucket=hot)
    got = {n: m for n, m in s.components(edges).collect()}
    root = {x: x for x in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in fps:
        for y in fps:
            if (x ^ y).bit_count() <= 3:
                root[find(x)] = find(y)
    assert {frozenset(g) for g in _groups({x: find(x) for x in fps})} == {
        frozenset(g) for g in _groups({x: got.get(s.signed(x), s.signed(x)) for x in fps})
    }


def _groups(of):
    by = {}
    for x, r in of.items():
        by.setdefault(r, set()).add(x)
    return by.values()


def test_probing_equals_comparing(monkeypatch):
    import numpy as np

    r = random.Random(3)
    mask = s.masks()[4]
    free = [i for i in range(64) if not mask >> i & 1]
    centre = r.getrandbits(64)
    some = np.array(sorted({centre ^ sum(1 << b for b in r.sample(free, r.randint(0, 4))) for _ in range(200)}), np.uint64)
    want = s.local_edges(some, ~mask, 3)
    monkeypatch.setattr(s, "PROBE_FROM", 0)
    got = s.local_edges(some, ~mask & ((1 << 64) - 1), 3)
    assert [x.tolist() for x in got] == [x.tolist() for x in want]


def test_empty_table(spark):
    got = s.near_duplicates(spark.createDataFrame([], "doc_id long, text string"))
    assert got.columns == ["doc_id", "fingerprint", "component_id"] and got.count() == 0


def test_masks_cover():
    for bad in [(0, 1, 2), (3, 18, 33), (5, 20, 63), (15, 30, 45)]:
        assert any(not any(m >> b & 1 for b in bad) for m in s.masks())
