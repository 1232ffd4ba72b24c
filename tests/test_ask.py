import json

import pytest
from pyspark.sql import functions as F

from siftstone.operators import bm25, retry, vectors
from siftstone.plans import ask
from siftstone.plans.retrieve import Retriever


@pytest.fixture
def retriever(spark):
    rows = [("a", "38.331", "5.3", 1, 0, "alpha beta"), ("b", "38.331", "6.1", 1, 1, "gamma delta"), ("c", "23.501", "5.3", 1, 2, "epsilon")]
    chunks = spark.createDataFrame(rows, "chunk_id string, spec string, clause_id string, part int, order int, text string")
    return Retriever(chunks, bm25.build_index(chunks, text="text"))


def test_stages(spark, retriever):
    asked = spark.createDataFrame([(1, "alpha beta"), (2, "alpha zeta"), (3, "gamma delta"), (4, "x"), (5, "zeta")], "qid long, question string")
    got = {r.qid: r for r in ask.ask(retriever, asked).collect()}
    assert {q: r.stage for q, r in got.items()} == {1: "answered", 2: "gate", 3: "answered", 5: "gate"}
    assert got[1].label == "grounded" and got[1].claims[0].citations == ["38.331, clause 5.3"]
    reply = F.lit(json.dumps({"answerable": True, "answer": "text", "claims": [{"text": "alpha", "passages": [1], "normative": "none"}, {"text": "omega", "passages": [1], "normative": "none"}], "missing": ""}))
    got = {r.qid: r for r in ask.ask(retriever, asked, reply=reply).collect()}
    assert got[1].stage == "answered" and got[1].label == "partial" and [c.text for c in got[1].claims] == ["alpha"]
    assert got[3].stage == "verification" and got[3].claims is None and got[3].reason == "groundedness 0.00 below 0.6"
    assert {r.qid: r.stage for r in ask.ask(retriever, asked, reply=reply, verified=False).collect()}[3] == "answered"
    refused = F.lit('{"answerable": false, "answer": "", "claims": [], "missing": "all"}')
    assert {r.qid: r.stage for r in ask.ask(retriever, asked, reply=refused).collect()}[1] == "generation"
    with pytest.raises(ValueError, match="top_k"):
        ask.ask(retriever, asked, top_k=21)


def letters():
    return lambda texts: [[t.count(c) + 0.0 for c in "abcdefgh"] for t in texts]


def test_embedder(spark):
    rows = spark.createDataFrame([("abba",), ("cede",), ("",), (None,)], "t string")
    got = [r.v for r in rows.select(vectors.embed_documents(letters, 8)("t").alias("v")).collect()]
    assert [round(sum(x * x for x in v), 6) for v in got] == [1.0, 1.0, 0.0, 0.0]
    assert rows.select(vectors.embed_queries(letters, 8)("t").alias("v")).first().v != got[0]
    with pytest.raises(Exception, match="dimensions"):
        rows.select(vectors.embed_documents(letters, 9)("t")).collect()


def test_retries():
    class Busy(Exception):
        code = 503

    calls, pauses = [], []

    def busy(error):
        calls.append(1)
        if len(calls) < 3:
            raise error
        return "done"

    assert retry.calling(lambda: busy(Busy()), sleep=pauses.append) == "done" and 2 <= pauses[0] < 2.6 and 4 <= pauses[1] < 4.6
    calls.clear()
    with pytest.raises(ValueError):
        retry.calling(lambda: busy(ValueError("404 NOT FOUND")), sleep=pauses.append)
    assert len(calls) == 1 and retry.status_of(ValueError("boom")) is None
