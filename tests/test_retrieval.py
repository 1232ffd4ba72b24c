import math

import pytest
from pyspark.sql import functions as F

from siftstone.operators import bm25, evaluate, fusion, scorers, vectors
from siftstone.plans.retrieve import Retriever
from siftstone.streaming import incremental


@pytest.fixture
def chunks(spark):
    return spark.createDataFrame([("A", "x x y"), ("B", "x z"), ("C", "z")], "chunk_id string, embed_text string")


def test_bm25(spark, chunks):
    index = bm25.build_index(chunks)
    ask = lambda q: bm25.search(index, spark.createDataFrame([(1, q)], "qid long, question string")).orderBy("rank").collect()
    assert [(r.chunk_id, r.score) for r in ask("x x")] == [("A", 1.156932), ("B", 0.940007)]
    assert [(r.chunk_id, r.score) for r in ask("x")] == [("A", 0.578466), ("B", 0.470004)]
    assert ask("nothing") == [] and ask("the") == []
    assert bm25.build_index(chunks.limit(0)).totals.first() == (0, 0.0)


def test_index_round_trip_and_stream(spark, chunks, tmp_path):
    bm25.build_index(chunks).save(str(tmp_path / "index"))
    back = bm25.SparseIndex.load(spark, str(tmp_path / "index"))
    questions = spark.createDataFrame([(1, "x z")], "qid long, question string")
    want = sorted(map(tuple, bm25.search(bm25.build_index(chunks), questions).collect()))
    assert sorted(map(tuple, bm25.search(back, questions).collect())) == want
    for part in ("chunk_id = 'A'", "chunk_id <> 'A'"):
        chunks.where(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "new"))
        incremental.follow(spark, str(tmp_path / "new"), chunks.schema, str(tmp_path / "live"), str(tmp_path / "state")).awaitTermination()
    assert sorted(map(tuple, bm25.search(incremental.load(spark, str(tmp_path / "live")), questions).collect())) == want


def test_vectors(spark):
    rows = [(1, [1.0, 0.0], "a"), (2, [0.6, 0.8], "b"), (3, [0.0, 1.0], "a"), (4, [0.6, 0.8], "a")]
    v = spark.createDataFrame(rows, "chunk_id long, embedding array<float>, spec string")
    q = spark.createDataFrame([(1, [0.6, 0.8], []), (2, [1.0, 0.0], ["a"])], "qid long, embedding array<float>, specs array<string>")
    got = sorted((r.qid, r["rank"], r.chunk_id) for r in vectors.search(v, q, 2, dimensions=2, filtered=True).collect())
    assert got == [(1, 1, 2), (1, 2, 4), (2, 1, 1), (2, 2, 4)]
    assert sorted((r.qid, r["rank"], r.chunk_id) for r in vectors.search(v, q, 2, block_rows=1, filtered=True).collect()) == got
    with pytest.raises(Exception, match="wrong dimension"):
        vectors.search(v, q, 2, dimensions=3).collect()
    assert vectors.get(v, v.limit(0)).count() == 0


def ranked(spark, ids):
    return spark.createDataFrame([(1, c, i + 1) for i, c in enumerate(ids)], "qid long, chunk_id string, rank int")


def test_fusion_ties(spark):
    got = fusion.fused_top(fusion.rrf(ranked(spark, ["d1", "d2", "d3"]), ranked(spark, ["b1", "d2"]))).orderBy("rank").collect()
    assert [(r.chunk_id, round(r.rrf_score, 8)) for r in got] == [("d2", 0.03225806), ("d1", 0.01639344), ("b1", 0.01639344), ("d3", 0.01587302)]


def test_funnel_and_gate(spark):
    schema = "chunk_id string, spec string, clause_id string, part int, order int, text string"
    chunks = spark.createDataFrame(
        [("a", "38.331", "5.3", 2, 0, "alpha beta"), ("b", "38.331", "5.3", 1, 1, "gamma"), ("c", "23.501", "5.3", 1, 2, "alpha beta gamma delta")], schema
    )
    questions = spark.createDataFrame(
        [(1, "alpha beta gamma delta"), (2, "TS 38.331 clause 5.3 alpha"), (3, "clause 99.1 delta"), (4, "zeta"), (5, "alpha zeta")], "qid long, question string"
    )
    index = bm25.build_index(chunks, text="text")
    decisions, hits = Retriever(chunks, index).retrieve(questions)
    got = {r.qid: r for r in decisions.collect()}
    order = lambda q: [r.chunk_id for r in hits.where(f"qid = {q}").orderBy("position").collect()]
    assert not got[1].refused and order(1)[0] == "c"
    assert order(2)[:2] == ["b", "a"] and not got[2].refused  # pinned, in part order
    assert not got[3].refused and got[3].n_hits == 1  # names a clause that doesn't exist
    assert got[4].refused and got[4].reason == "nothing retrieved"
    assert got[5].refused and got[5].n_hits == 2 and got[5].reason == "best rerank score 0.50 < threshold 0.9"
    free = Retriever(chunks, index, use_gate=False).retrieve(questions)[0]
    assert {r.qid for r in free.where("refused").collect()} == {4}
    plain = Retriever(chunks, index, use_reranker=False, use_query_understanding=False).retrieve(questions)[0]
    assert {r.qid for r in plain.where("refused").collect()} == {4}


def test_gate_borders(spark):
    top = spark.createDataFrame([(1, 0.95, 1), (2, 0.89, 1), (3, 0.9, 1), (4, 0.5, 1)], "qid long, rerank_score double, position int")
    asked = spark.createDataFrame([(1, False), (2, False), (3, False), (4, True), (5, False)], "qid long, is_pinpoint boolean")
    assert {r.qid for r in fusion.gate(asked, top).where("refused").collect()} == {2, 5}


def test_scorers(spark):
    row = spark.range(1).select(scorers.entailment(F.array(*map(F.lit, (2.0, 1.0, 0.0)))).alias("v")).first().v
    assert row.contradicted and abs(row.score - math.exp(1) / (1 + math.exp(1) + math.exp(2))) < 1e-9


def test_relevance_and_metrics(spark):
    rows = [("s", "5.3", []), ("s", "5.3.1", []), ("s", "5", ["5.3"]), ("s", "5.30", []), ("s", "5", []), ("t", "5.3", []), ("s", "9", None)]
    df = spark.createDataFrame(rows, "spec string, clause string, merged array<string>")
    gold = F.array(F.struct(F.lit("s").alias("spec"), F.lit("5.3").alias("clause")))
    got = [r.x for r in df.select(evaluate.is_relevant(F.col("spec"), F.col("clause"), F.col("merged"), gold).alias("x")).collect()]
    assert got == [True, True, True, False, False, False, False]
    hits = spark.createDataFrame([(1, i + 1, r) for i, r in enumerate((0, 1, 0, 1))] + [(2, 1, 0)], "qid long, rank int, rel int")
    got = {r.qid: tuple(r)[1:] for r in evaluate.rank_metrics(hits, spark.createDataFrame([(1,), (2,), (3,)], "qid long"), 4).collect()}
    assert got == {1: (1.0, 0.5, 0.650921), 2: (0.0, 0.0, 0.0), 3: (0.0, 0.0, 0.0)}


def test_sweep(spark):
    yes, no = (0.9, 0.8, 0.95, 0.99), (0.1, 0.85, 0.97)
    scores = spark.createDataFrame([(x, True) for x in yes] + [(x, False) for x in no], "top_score double, answerable boolean")
    swept = evaluate.sweep(scores)
    assert tuple(evaluate.choose(swept, 0.25).first()) == (0.9, 0.9)
    row = swept.where("threshold = 0.9").first()
    assert (row.false_refusal_rate, round(row.correct_refusal_rate, 4), round(row.youden_j, 4)) == (0.25, 0.6667, 0.4167)
    assert evaluate.choose(swept, -1.0).first().chosen is None
    odd = spark.createDataFrame([(0.896484375, False), (0.95, True)], "top_score double, answerable boolean")
    assert evaluate.sweep(odd).where("threshold = 0.8965").first().correct_refusal_rate == 1.0
    assert evaluate.balanced(spark.createDataFrame([(i, i % 3 == 0) for i in range(20)], "qid int, answerable boolean"), 6).count() == 6
    assert "| a |" in evaluate.markdown([{"a": 1.0}], ["a"])


def test_stored_index_follows_its_table(spark, tmp_path):
    from siftstone.plans import served

    at = str(tmp_path / "chunks.parquet")
    make = lambda rows: spark.createDataFrame(rows, "chunk_id long, embed_text string").write.mode("overwrite").parquet(at)
    questions = spark.createDataFrame([(1, "x x"), (2, "unknown"), (3, None)], "qid long, question string")
    make([(1, "x x y"), (2, "x z"), (3, "z"), (4, None)])
    first = served.served_index(spark.read.parquet(at))
    fresh = bm25.build_index(spark.read.parquet(at))
    key = lambda index: sorted(map(tuple, bm25.search(index, questions).collect()))
    assert key(first) == key(fresh) != []
    again = served.served_index(spark.read.parquet(at))
    assert sorted(again.postings.inputFiles()) == sorted(first.postings.inputFiles())
    make([(1, "y"), (2, "x")])
    changed = served.served_index(spark.read.parquet(at))
    assert sorted(changed.postings.inputFiles()) != sorted(first.postings.inputFiles())
    assert [r[:2] for r in key(changed)] == [(1, 2)]


def test_many_question_terms_give_the_same(spark, monkeypatch):
    chunks = spark.createDataFrame([(i, f"a{i} b{i % 3} c") for i in range(40)], "chunk_id long, embed_text string")
    questions = spark.createDataFrame([(i, f"b{i} a{i} c") for i in range(3)], "qid long, question string")
    index = bm25.build_index(chunks)
    want = sorted(map(tuple, bm25.search(index, questions).collect()))
    for scanned, sent in ((2, 100), (2, 1)):
        monkeypatch.setattr(bm25, "SCANNED_TERMS", scanned)
        monkeypatch.setattr(bm25, "BROADCAST_TERMS", sent)
        assert sorted(map(tuple, bm25.search(index, questions).collect())) == want
