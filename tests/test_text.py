import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftstone.functions import text as tx
from siftstone.functions import versions


def one(spark, value, **columns):
    names = list(columns)
    row = spark.createDataFrame([tuple(columns.values())], ", ".join(f"{n} {'array<string>' if isinstance(columns[n], list) else 'string'}" for n in names))
    return row.select(value(*(F.col(n) for n in names)).alias("x")).first().x


def test_token_forms(spark):
    want = {
        "RRCReconfiguration": ["rrcreconfiguration", "rrc", "reconfiguration"],
        "gNB-DU": ["gnb-du", "gnb", "du"],
        "SS/PBCH": ["ss/pbch", "ss", "pbch"],
        "5G-AN": ["5g-an", "5g"],
        "a-b": ["a-b"],
        "x-FooBar": ["x-foobar", "foo", "bar"],
        "K_gNB_quantum": ["k_gnb_quantum", "gnb", "quantum"],
        "The": [],
        "shall may the": ["shall", "may"],
        "": [],
    }
    rows = spark.createDataFrame([(k,) for k in want], "q string").select("q", tx.tokenize(F.col("q")).alias("t")).collect()
    assert {r.q: r.t for r in rows} == want
    assert one(spark, tx.tokenize, q=None) == []


def restated(text):
    out = []
    for raw in re.findall(tx.TOKEN, text):
        low = raw.lower()
        forms = [] if low in tx.STOPWORDS else [low]
        parts = [p for p in re.split("[-_/]", raw) if len(p) > 1]
        more = parts if len(parts) > 1 else []
        for p in parts or [raw]:
            humps = [h for h in re.split(tx.CAMEL, p) if len(h) > 2]
            more = more + (humps if len(humps) > 1 else [])
        out += forms + [m.lower() for m in more if m.lower() != low and m.lower() not in tx.STOPWORDS]
    return out


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="aBcDE1._-/ XyZthe", max_size=40), min_size=1, max_size=40))
def test_tokens_equal_a_plain_restatement(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "q string").select("q", tx.tokenize(F.col("q")).alias("t")).collect()
    for r in rows:
        assert r.t == restated(r.q), r.q


def test_query_references(spark):
    plan = lambda q: one(spark, tx.query_plan, q=q)
    assert tuple(plan("What does TS 38.331 clause 5.3.3.7 say?")) == (["38.331"], ["5.3.3.7"], True)
    assert tuple(plan("§5.1 and section 6.2.1 of TS23.501 and 38.331")) == (["23.501", "38.331"], ["5.1", "6.2.1"], True)
    assert tuple(plan("clause A.2")) == ([], [], False)
    assert tuple(plan(None)) == ([], [], False)


def test_small_functions(spark):
    assert one(spark, tx.one_line, q="5.1\tTitle\n here ") == "5.1 Title here"
    assert one(spark, tx.one_line, q="\xa05.1\xa0Title\u2003here\u3000") == "5.1 Title here" and one(spark, tx.strip, q="\xa0 x y\u2009") == "x y"
    assert tuple(one(spark, tx.query_plan, q="TS\xa038.331 and x38.331, 38.3312, a 38.332: section\xa05.2")) == (["38.331", "38.332"], ["5.2"], True)
    assert one(spark, tx.has_normative, q="It SHALL be") and not one(spark, tx.has_normative, q="marshalled mayor")
    for reply, want in {"0.7 because": 0.7, "1.8": 1.0, "-2": 0.0, "no": 0.0, "nan": 0.0, "": 0.0}.items():
        assert one(spark, tx.judge_number, q=reply) == want
    assert one(spark, tx.error_status, q="503 UNAVAILABLE") == 503 and one(spark, tx.error_status, q="boom") is None
    head = tx.context_header(*map(F.lit, ("TS 38.331", "18.8.0", 18, "NR RRC", "5 Procedures", "5.3", "Setup", 2, 3)))
    assert one(spark, lambda q: head, q="") == "TS 38.331 v18.8.0 (Rel-18) - NR RRC\n5 Procedures\nClause 5.3: Setup [part 2/3]"
    head = tx.context_header(*map(F.lit, ("S", "1.0.0", 1, "", "", "Name", "Name", 1, 1)))
    assert one(spark, lambda q: head, q="") == "S v1.0.0 (Rel-1)\nClause Name"
    rows = spark.createDataFrame([([["a", "b|c"], ["", " "], ["x\ny"]],), ([],), ([[""]],)], "r array<array<string>>")
    got = [r.x for r in rows.select(tx.markdown_table(F.col("r")).alias("x")).collect()]
    assert got == ["| a | b\\|c |\n| --- | --- |\n| x<br>y |  |", "", ""]
    assert "QUESTION: why?\n\nPASSAGES:\n\n[1] c1\n    section: s\n    title:   t\nbody\n\n[2] c2\n    section: s\n    title:   t\nbody" == one(
        spark, lambda q: tx.prompt(q, F.array(*(F.struct(F.lit(c).alias("citation"), F.lit("s").alias("breadcrumb"), F.lit("t").alias("clause_title"), F.lit("body").alias("text")) for c in ("c1", "c2")))), q="why?"
    )


def test_versions(spark):
    version = lambda c: one(spark, versions.version_string, q=c)
    assert [version(c) for c in ("i80", "ia0", "I80", "i8", "i8?", "")] == ["18.8.0", "18.10.0", "18.8.0", None, None, None]
    assert tuple(one(spark, lambda q: versions.stem_parts(versions.stem(q)), q="38331-ia0.zip")) == ("38.331", "ia0", "18.10.0", 18)
    assert one(spark, lambda q: versions.series_folder(F.lit("base"), q), q="38.331") == "base/38_series/38.331/"
