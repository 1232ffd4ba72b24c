import random

import pytest

from siftstone.plans import queries


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    at, r = str(tmp_path_factory.mktemp("sf")), random.Random(5)
    vectors = [(n, [r.gauss(0, 1) for _ in range(64)], n % 3) for n in range(430)]
    texts = [(n, "\n".join(" ".join(r.choices(["ab", "cde", "fghi", "j"], k=r.randint(0, 4))) for _ in range(r.randint(0, 30)))) for n in range(60)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<double>, label int").write.parquet(f"{at}/embeddings.parquet")
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(n, f"ab cde{n}") for n in range(50)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at, vectors, dict(texts)


def nearest(vectors, q, k, same=False):
    score = lambda v: sum(a * b for a, b in zip(q[1], v[1]))
    return [v[0] for v in sorted((v for v in vectors if not same or v[2] == q[2]), key=lambda v: (-score(v), v[0]))[:k]]


def test_every_hundredth_vector_asks_all_vectors(spark, sf):
    at, vectors, _ = sf
    for name, same in (("knn_cosine_topk", False), ("knn_filtered", True)):
        got = sorted((x.qid, x["rank"], x.chunk_id) for x in queries.QUERIES[name](spark, at).collect())
        assert got == [(q[0] // 100, n, c) for q in vectors[::100] for n, c in enumerate(nearest(vectors, q, 10, same), 1)]
    assert {x.qid for x in queries.QUERIES["relevance"](spark, at).collect()} == set(range(5))
    fused = queries.QUERIES["rrf_fused_top20"](spark, at).collect()
    assert {x.qid for x in fused} == set(range(50))
    assert all(v in {x.chunk_id for x in fused if x.qid == 3} for v in nearest(vectors, vectors[300], 5))


def test_every_line_is_a_claim(spark, sf):
    at, _, texts = sf
    want, verdicts = [], []
    for doc, text in texts.items():
        pairs = [(len(x) % 9, (len(x) + 3 * n) % 8) for n, x in enumerate(text.split("\n"))] if doc % 5 else []
        good = [[p for p in pair if 1 <= p <= 6] for pair in pairs]
        want += [(doc, n, g) for n, g in enumerate(good)]
        bad = sorted({p for pair in pairs for p in pair if not 1 <= p <= 6})
        verdicts.append((doc, bad, doc % 7 == 0 or bool(pairs) and not any(good)))
    assert max(n for _, n, _ in want) > 20
    assert sorted((x.qid, x.idx, x.passages) for x in queries.QUERIES["claim_validation"](spark, at).collect()) == want
    assert sorted((x.qid, sorted(x.invalid_citations), x.refused) for x in queries.QUERIES["refusal_decision"](spark, at).collect()) == verdicts
