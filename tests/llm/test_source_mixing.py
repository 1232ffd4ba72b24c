import random

from siftstone.llm import source_mixing as m


def brute_targets(sizes):
    """Cap, give the excess to the others by weight, and again until no source is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, free, out = 1.5 * sum(sizes.values()), set(names), {}
    while free:
        whole = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / whole > 2 * sizes[s]}
        if not over:
            return out | {s: left * weight[s] / whole for s in free}
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        free -= over
    return out


def rows():
    r = random.Random(9)
    out = [(i, "src" + str(min(r.randrange(12), 6)), "word " * r.choice([0, 1, 7, 40, 300])) for i in range(600)]
    out += [(1000 + i, s, "a\x1cb c " * 5) for i, s in enumerate([None, None, "ä", "Z", "tiny"])]
    return [*out, (2000, "Z", None), (2001, "Z", ""), (5, "Z", "x y"), (5, "Z", "x y"), (None, "Z", "p q r"), (None, "ä", "p"), (2002, "big", "w " * 50_000)]


def test_contract(spark):
    data = rows()
    df = spark.createDataFrame([(*x, "clash") for x in data], "doc_id long, source string, text string, Taken string")
    got = m.mix(df).collect()
    assert len(got) == len(data)
    sizes, taken = {}, {}
    size = lambda t: len((t or "").encode().split())
    for _, s, t in data:
        sizes[s] = sizes.get(s, 0) + size(t)
    want = brute_targets(sizes)
    assert sorted(((x.doc_id, x.size) for x in got), key=str) == sorted(((d, size(t)) for d, _, t in data), key=str)
    by_id = {d: s for d, s, _ in data}
    for x in got:
        assert 0 <= x.taken <= 2 * x.size
        if x.doc_id not in (None, 5):
            s = by_id[x.doc_id]
            assert x.source_size == sizes[s] and abs(x.target - want[s]) < 1e-6
            taken[s] = taken.get(s, 0) + x.taken
    for s, n in taken.items():
        if s not in {s for d, s, _ in data if d in (None, 5)}:  # these ids are left out above
            assert 0.99 * int(want[s] + 1e-6) <= n <= want[s] + 1e-6, s
    whole = {}
    for x in m.mix(df, keep=True).collect():
        whole[x.source] = whole.get(x.source, 0) + x.taken
    assert all(0.99 * int(t + 1e-6) <= whole[s] <= t + 1e-6 for s, t in want.items())
    assert sorted(map(str, m.mix(df).collect())) == sorted(map(str, got))


def test_schedule_is_even(spark):
    df = spark.createDataFrame([(i, f"s{i % 4}", "w " * 50) for i in range(400)], "doc_id long, source string, text string")
    goals = m.targets(df.select(df.source.alias("__source"), m.size_of(df.text).alias("size")))
    share = {x["__source"]: x.target for x in goals.collect()}
    plan = sorted(map(tuple, m.schedule(goals, 3000, 10, stretch=128).collect()))
    assert [x[0] for x in plan] == list(range(3000))
    seen = {}
    for i, (_, s, rank) in enumerate(plan):
        assert rank == seen.get(s, 0)
        seen[s] = rank + 1
        if i > 100:
            assert all(abs(seen[k] / (i + 1) - share[k] / sum(share.values())) < 0.05 for k in share)


def test_points_decide_what_is_taken(spark):
    """Each source takes as many blocks as points of frac(i * step) fall on its stretch, up to its target."""
    df = spark.createDataFrame([(i, f"s{i * i % 5}", "w " * (7 + i % 90)) for i in range(900)], "doc_id long, source string, text string")
    goals = {x["__source"]: x for x in m.targets(df.select(df.source.alias("__source"), m.size_of(df.text).alias("size"))).collect()}
    words, seen = sum(x.aim for x in goals.values()), {}
    for step in (m.GOLDEN, 1779033703, 1):
        block = -(-words // 4096)
        slots = -(-words // block)
        want = {}
        for s, x in goals.items():
            n = sum(x.low <= i * step % m.POINTS < x.high for i in range(slots))
            want[s] = x.aim if n * block < x.aim - x.aim // 100 else min(n * block, x.aim)
        got, slot = {}, {}
        for x in m.mix(df, keep=True, slot_words=1 << 40, min_slots=4096, step=step).collect():
            got[x.source] = got.get(x.source, 0) + x.taken
            assert (x.first_slot is None) == (x.taken == 0)
            slot[x.doc_id] = x.first_slot
        assert got == want, step
        seen[step] = (got, slot)
    assert seen[m.GOLDEN][0] != seen[1779033703][0] and seen[m.GOLDEN][1] != seen[1779033703][1]


def test_sizes_beyond_memory(spark):
    """Sizes near 2**45 words a document: whole numbers stay exact."""
    sizes = [(i, f"s{i % 3}", (1 << 45) - 12345 * i, i * 1234567 + (i << 52)) for i in range(12)]
    sized = spark.createDataFrame([((i,), i, s, n, o) for i, s, n, o in sizes], "__row struct<doc_id: long>, __id long, __source string, size long, __order long")
    got = m.mix_sized(sized, slot_words=1 << 33).collect()
    total = {}
    for x in got:
        assert 0 <= x.taken <= 2 * x.size
        total[x["__source"]] = total.get(x["__source"], 0) + x.taken
    want = brute_targets({s: sum(n for _, t, n, _ in sizes if t == s) for s in ("s0", "s1", "s2")})
    assert all(0.99 * want[s] <= total[s] <= want[s] for s in want)


def test_rows_under_one_id_are_shuffled_by_their_texts(spark):
    rows = [(None, "a", f"w{i} " * 5) for i in range(50)] + [(7, "a", f"v{i} " * 5) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    orders = df.select(m.order_of("doc_id", "text")).distinct().count()
    assert orders == 100
    key = lambda x: (x.doc_id or 0, x.text)
    one, two = (sorted(m.mix(d, keep=True).collect(), key=key) for d in (df, df.repartition(3)))
    assert one == two and sum(x.taken for x in one) == 750


def test_empty_and_wordless(spark):
    df = spark.createDataFrame([], "doc_id long, source string, text string")
    assert m.mix(df).count() == 0
    got = m.mix(spark.createDataFrame([(1, "a", None), (2, None, " ")], df.schema)).collect()
    assert sorted(map(tuple, got), key=str) == [(1, 0, 0, 0.0, 0, None), (2, 0, 0, 0.0, 0, None)]
