import os

import duckdb
import pytest

import corpus_pipeline
from siftstone.llm import decontaminate, quality_rules, source_mixing
from tests.llm.test_line_dedup import brute as dedup_lines
from tests.llm.test_simhash import brute as classes

SF = "/root/testdata/sf0.001"


def leaks(text, items):
    for item in items:
        masks = {}
        for i, c in enumerate(item):
            masks[c] = masks.get(c, 0) | 1 << i
        if decontaminate.nearest(masks, len(item), text)[0] <= len(item) // decontaminate.CHARS_PER_ERROR:
            return True
    return False


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the tables")
def test_pipeline_equals_brute_force(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    kept = {r[0] for r in con.sql(quality_rules.op2_sql()).fetchall() if r[-1]}
    rows = [r for r in con.sql("select doc_id, text, source from documents order by doc_id").fetchall() if r[0] in kept]
    source = {r[0]: r[2] for r in rows}
    rows = [(d, t) for d, _, _, t in dedup_lines([r[:2] for r in rows])]
    first = {d for d, _, c in classes(rows) if d == c}
    items = [decontaminate.folded(t) for (t,) in con.sql(f"select text from '{SF}/benchmark.parquet'").fetchall()]
    rows = [(d, t) for d, t in rows if d in first and not leaks(decontaminate.folded(t), items)]
    con.execute("create or replace view documents as select 1")
    con.execute("drop view documents")
    con.execute("create table documents (doc_id bigint, text varchar, source varchar)")
    con.executemany("insert into documents values (?, ?, ?)", [(d, t, source[d]) for d, t in rows])
    want = sorted(con.sql(source_mixing.OP6_SQL).fetchall())
    got = sorted(map(tuple, corpus_pipeline.run(spark, SF).collect()))
    assert got == want and 50 < len(got) < 180


def test_stages_with_odd_rows(spark, tmp_path):
    text = " ".join(f"word{i}" for i in range(80))
    other = " ".join(f"term{i}" for i in range(90))
    rows = [(1, text, "en", "a", 5), (2, text.upper(), "en", "a", 5), (2, text.upper(), "en", "a", 5), (None, other, None, None, None)]
    rows += [(None, other, None, None, None), (7, None, "en", "a", 0), (8, "", "en", "a", 0), (9, "too short", "en", None, 9)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "term5 term6 term7 term8 term9")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        empty = stage(spark, docs.limit(0), str(tmp_path))
        assert empty.columns == docs.columns and empty.count() == 0
    assert [(x.doc_id, x.size) for x in corpus_pipeline.run(spark, str(tmp_path)).collect()] == [(1, 80)]


def prose(word, n):
    return " ".join(f"{word}{i}" for i in range(n))


def test_nothing_is_lost_or_overwritten(spark, tmp_path):
    """Different texts under one id stay, columns named like the operators' own come out as they came, long texts go through."""
    shared = prose("shared", 12)
    texts = [(1, prose("a", 80)), (1, prose("b", 90)), (1, prose("b", 90)), (2, prose("c", 70)), (3, prose("c", 70)), (None, prose("d", 75)), (None, prose("e", 85))]
    texts += [(10 + i, shared + "\n" + prose(f"own{i}x", 60)) for i in range(6)]
    texts += [(30, prose("long", 60_000))]
    clash = ("n_lines", "n_dropped", "kept_text", "distance", "kept", "component_id", "fingerprint", "base_failed", "n_words", "target", "d2", "k2", "s")
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in clash)
    rows = [(d, t, "en", "a", len(t), *(f"{c} {d}" for c in clash)) for d, t in texts]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, prose("c", 70))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    after = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, str(tmp_path)), "test")
        assert docs.columns == schema.replace(" long", "").replace(" string", "").split(", ")
        got = docs.collect()
        assert all(x[c] == f"{c} {x.doc_id}" for x in got for c in clash)
        after[name] = sorted(((x.doc_id, x.text) for x in got), key=str)
    assert after["quality rules"] == sorted(texts, key=str)
    want = [(d, t if d is None or not 10 <= d < 15 else t.split("\n")[1]) for d, t in texts]
    assert after["line dedup"] == sorted(want, key=str)
    want = [(d, t) for i, (d, t) in enumerate(want) if i not in (2, 4)]  # repeated row, and the copy under a larger id
    assert after["near dedup"] == sorted(want, key=str)
    assert after["decontaminate"] == sorted(((d, t) for d, t in want if d != 2), key=str)
    final = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((x.doc_id, x.size) for x in final if x.doc_id) == sorted((d, len(t.split())) for d, t in want if d not in (2, None))


def test_intermediate_tables_are_deleted(spark, tmp_path):
    from siftstone.llm import common

    before = set(common._made)
    with common.discarding(spark):
        first = common.materialize(spark.range(5), "one")
        last = common.materialize(first.where("id > 2"), "two")
    left = [x for x in common._made if x not in before]
    assert len(left) == 1 and "two-" in left[0] and last.count() == 2
    assert not os.path.exists(first.inputFiles()[0].removeprefix("file://"))
