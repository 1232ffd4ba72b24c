import random
import re

from siftstone.llm import decontaminate as d


def distance(item, text):
    """Plain dynamic programme: the item against any substring."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, x in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != x)))
        row = new
    return min(row)


def fixture():
    r = random.Random(6)
    word = lambda: "".join(r.choices("abcdéfg", k=r.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(i, prose(r.choice([6, 12, 25])).capitalize() + ".") for i in range(12)]
    docs = []
    for n in range(80):
        text = prose(40)
        if n % 2:
            passage = list(r.choice(items)[1])
            for _ in range(r.randint(0, max(1, len(passage) // 12))):
                at = r.randrange(len(passage))
                passage[at : at + 1] = r.choice([[], ["z"], [passage[at], "q"]])
            text += "\n " + "".join(passage).upper() + " \t" + prose(20)
            if n % 7 == 0:
                text += " " + text
        docs.append((n, text))
    items += [(50, None), (51, " \n"), (52, "cab"), (53, items[0][1])]
    docs += [(90, None), (91, ""), (92, "a cab, indeed"), (93, "scabs"), (None, items[1][1]), (1, docs[1][1]), (94, "x" * 200_000 + " " + items[2][1])]
    return docs, items


def test_matches_brute_force(spark):
    docs, items = fixture()
    df = spark.createDataFrame([(*x, 1.0) for x in docs], "doc_id long, text string, distance double")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = []
    for i, t in docs:
        for k, item in items:
            a, b = d.folded(item), d.folded(t)
            if len(b) > 10_000:
                b = b[-1000:]
            if not a:
                continue
            if len(a) < d.CHARS_PER_ERROR:
                if i == 92 and k == 52:
                    want.append((i, k, 0))
                continue
            n = distance(a, b)
            if n <= len(a) // d.CHARS_PER_ERROR:
                want.append((i, k, n))
    for size in (d.BLOCK_CHARS, 100):
        got = d.contaminated(df, bench, block_chars=size).collect()
        assert sorted(((x.doc_id, x.item_id, x.distance) for x in got), key=str) == sorted(want, key=str)
    assert len(want) > 20


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a text")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a text")], "item_id long, text string")
    assert d.contaminated(docs.limit(0), bench).count() == 0
    assert d.contaminated(docs, bench.limit(0)).columns == ["doc_id", "item_id", "distance", "found_end"]
    assert d.contaminated(docs, bench.limit(0)).count() == 0


def test_bit_parallel_distance():
    r = random.Random(8)
    for _ in range(300):
        a, b = ("".join(r.choices("abc", k=r.randint(1, n))) for n in (90, 120))
        masks = {}
        for i, c in enumerate(a):
            masks[c] = masks.get(c, 0) | 1 << i
        assert d.nearest(masks, len(a), b)[0] == distance(a, b)


def test_index_of_a_slice_against_every_pair(monkeypatch):
    """Texts side by side, cut into small chunks, under several budgets of errors."""
    monkeypatch.setattr(d, "CHUNK", 64)
    docs, items = fixture()
    items = [(i, d.folded(t)) for i, t in items if d.folded(t)]
    texts = [d.folded(t)[-1500:] for _, t in docs]
    for chars, border in ((12, None), (7, 0), (25, 30), (1000, 0)):
        matcher = d.Matcher(d.Pieces(items, chars, border))
        want = set()
        for n, text in enumerate(texts):
            for i, (_, item) in enumerate(items):
                errors = len(item) // chars
                if not errors:
                    edge = f"(?<![^\\W_]){re.escape(item)}(?![^\\W_])" if len(item) < (chars if border is None else border) else re.escape(item)
                    if re.search(edge, text):
                        want.add((n, i, 0))
                elif (k := distance(item, text)) <= errors:
                    want.add((n, i, k))
        got = list(matcher.hits(texts))
        assert {x[:3] for x in got} == want and len(got) == len(want)
        assert {x[0] for x in matcher.hits(texts, one_each=True)} == {x[0] for x in want}
        for n, i, k, end in got:
            item = items[i][1]
            assert distance(item[::-1], texts[n][max(0, end - 2 * len(item)) : end][::-1]) == k


def test_a_large_benchmark_costs_little_more():
    """Twenty times the items: probes cost less than twice as much where they hit nothing more."""
    import time

    r = random.Random(1)
    word = lambda a: "".join(r.choices(a, k=r.randint(3, 9)))
    texts = [" ".join(word("abcdefghij") for _ in range(150)) for _ in range(400)]

    def seconds(n):
        items = [(i, " ".join(word("klmnopqrst") for _ in range(30))) for i in range(n)]
        matcher = d.Matcher(d.Pieces(items))
        assert not list(matcher.hits(texts))
        took = []
        for _ in range(5):
            began = time.process_time()
            list(matcher.hits(texts))
            took.append(time.process_time() - began)
        return min(took)

    assert seconds(4000) < 2 * seconds(200)
