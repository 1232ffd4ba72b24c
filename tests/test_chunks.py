import io
import zipfile

from pyspark.sql import functions as F

from siftstone.operators import chunking, splitting, tree
from siftstone.sources import catalog, docx


def units(spark, texts, tokens=None, atomic=None, kinds=None):
    rows = [("c", i, t, (kinds or {}).get(i, "prose"), (tokens or [1] * len(texts))[i], bool(atomic and i in atomic)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc string, pos int, text string, kind string, tokens int, atomic boolean")


def test_enclosing_conditions(spark):
    texts = ["Upon start the unit shall:", "1> if A:", "2> do B;", "NOTE2: remark", "3> do C;", "value = floor(y)", "2> do D;", "Then the unit shall:", "1> do E.", "Done."]
    got = chunking.with_ancestors(units(spark, texts), ["doc"]).orderBy("pos").collect()
    assert [r.ancestors for r in got] == [[], [], [1], [1, 2], [1, 2], [1, 2, 4], [1], [], [], []]


def test_quality_gates(spark):
    rows = spark.createDataFrame([("a", "3> x\n1> y\n2> z"), ("b", "1> a\n3> b"), ("c", "plain")], "chunk_id string, text string")
    assert [tuple(r) for r in chunking.orphans(rows).collect()] == [("a", 3, "3> x")]
    assert chunking.level_skips(rows).first().n_skips == 1
    assert chunking.level_skips(rows.where("chunk_id = 'a'")).first().n_skips == 0


def test_pack_and_overlap(spark):
    sizes = [300, 400, 200, 100, 700, 50]
    for atomic, carried in (((), [3]), ((3,), [])):
        df = units(spark, [f"line {i}" for i in range(6)], sizes, atomic).withColumn("ancestors", F.array().cast("array<int>"))
        got = chunking.pack(df, ["doc"]).collect()
        body = sorted((r.piece, r.pos) for r in got if r.role == "body")
        assert body == [(0, 0), (0, 1), (1, 2), (1, 3), (2, 4), (2, 5)]
        assert sorted(r.pos for r in got if r.role == "overlap") == carried
    df = chunking.with_ancestors(units(spark, ["1> if A:", "2> do B;", "2> do C;"], [10, 700, 700]), ["doc"])
    got = sorted((r.piece, r.pos, r.role) for r in chunking.pack(df, ["doc"]).collect())
    assert got == [(0, 0, "body"), (0, 1, "body"), (1, 0, "condition"), (1, 2, "body")]


def clause_rows(spark, rows):
    made = [("d", i, c, f"t{c}", lv, b, [("u", "x", n, False)] if n else []) for i, (c, lv, n, b) in enumerate(rows)]
    return spark.createDataFrame(made, f"doc string, order int, clause_id string, clause_title string, level int, breadcrumb string, units {chunking.UNIT}")


def test_merge_up(spark):
    into = lambda rows, **k: [r.into for r in chunking.merge_up(clause_rows(spark, rows), **k).orderBy("order").collect()]
    assert into([("1", 1, 500, ""), ("1.1", 2, 30, "1 t1"), ("1.2", 2, 60, "1 t1"), ("1.2.1", 3, 40, "1 t1 > 1.2 t1.2")]) == [0, 0, 0, 0]
    assert into([("3", 1, 970, ""), ("3.1", 2, 40, "3 t3")]) == [0, 1]
    lost = [("2.1", 2, 300, "2 t2"), ("2.2", 2, 0, "2 t2"), ("2.2.1", 3, 20, "2 t2 > 2.2 t2.2")]
    assert into(lost) == [0, 0] and into(lost, strict_ancestor=True) == [0, 2]


def test_splitters():
    table = "\n".join(["| h |", "| --- |", *(f"| row {i} with some words |" for i in range(5))])
    pieces = splitting.split_table(table, 20)
    assert len(pieces) > 1 and all(p.startswith("| h |\n| --- |\n") for p in pieces)
    assert [x for p in pieces for x in p.split("\n")[2:]] == table.split("\n")[2:]
    code = "A ::= SEQUENCE {\n  x y\n}\n-- note\nB ::= INTEGER\nmax INTEGER ::= 5"
    assert splitting.split_definitions(code, 4) == ["A ::= SEQUENCE {\n  x y\n}\n-- note", "B ::= INTEGER", "max INTEGER ::= 5"]
    assert splitting.split_lines("a b c d e", 2) == ["a b", "c d", "e"]
    assert splitting.split_lines("h\na b c d e\nt", 2) == ["h", "a b", "c d", "e", "t"]


def test_units(spark):
    long = "\n".join(["| h |", "| --- |", *(f"| {'w ' * 300}|" for _ in range(5))])
    blocks = [("prose", " one two \n\n three"), ("table", "| a |\n| --- |"), ("table", long), ("asn1", "X ::= " + "y " * 2500)]
    df = spark.createDataFrame([("d", blocks)], "doc string, blocks array<struct<type:string,text:string>>")
    got = chunking.with_units(df).first().units
    assert [(u.kind, u.tokens, u.atomic) for u in got[:3]] == [("prose", 2, False), ("prose", 1, False), ("table", 6, True)]
    assert [u.tokens for u in got if u.kind == "table"][1:] == [610, 610, 308] and [u.tokens for u in got if u.kind == "asn1"] == [800, 800, 800, 102]


ROWS = [
    ("d", 0, "Normal", "paragraph", "front matter"), ("d", 1, "toc 1", "paragraph", "1 Intro 3"), ("d", 2, "Heading 1", "paragraph", "5\tProcedures"),
    ("d", 3, "Normal", "paragraph", "body of 5"), ("d", 4, "Heading 2", "paragraph", "5.1 Setup"), ("d", 5, "Normal", "paragraph", "p1"), ("d", 6, "Normal", "paragraph", " p2 "),
    ("d", 7, None, "table", "| t |\n| --- |"), ("d", 8, "Normal", "paragraph", "p3"), ("d", 9, "PL", "paragraph", "A ::= B"), ("d", 10, "Heading 2", "paragraph", "5.2 Void"),
    ("d", 11, "Normal", "paragraph", "nothing"), ("d", 12, "Heading 3", "paragraph", "5.2.1 Deep"), ("d", 13, "Normal", "paragraph", "deep text"), ("d", 14, "Heading 8", "paragraph", "Annex B (Informative): More"),
    ("d", 15, "Normal", "paragraph", "annex text"), ("d", 16, "Heading 4", "paragraph", "– ServingCell"), ("d", 17, "Normal", "paragraph", "cell"), ("d", 18, "Heading 1", "paragraph", "Scope"),
    ("d", 19, "Normal", "paragraph", "scope text"), ("d", 20, "Heading 1", "paragraph", "6 Empty"), ("d", 21, "Heading 1", "paragraph", " "), ("d", 22, "Heading 1", "paragraph", "5 Again"), ("d", 23, "Normal", "paragraph", "<void>"),
    ("d", 24, "Heading 1", "paragraph", "5.1 Setup"), ("d", 25, "Normal", "paragraph", "second"),
]


def test_tree(spark):
    rows = tree.clauses(spark.createDataFrame(ROWS, "doc string, pos int, style string, kind string, text string"))
    got = {r.clause_uid: r for r in tree.with_uids(tree.keep_useful(rows)).collect()}
    assert set(got) == {"d::5", "d::5.1", "d::5.2.1", "d::Annex B", "d::ServingCell", "d::5.1#2"}
    assert got["d::5.2.1"].breadcrumb == "5 Procedures > 5.2 Void"
    assert got["d::ServingCell"].breadcrumb == "Annex B More" and got["d::Annex B"].breadcrumb == ""
    assert [tuple(b) for b in got["d::5.1"].blocks] == [("prose", "p1\np2"), ("table", "| t |\n| --- |"), ("prose", "p3"), ("asn1", "A ::= B")]
    assert got["d::5.1"].full_text == "p1\np2\n\n| t |\n| --- |\n\np3\n\nA ::= B"
    assert tree.find_clause(rows, "5.2.1").first().clause_title == "Deep"


def test_whole_chunking(spark):
    texts = "\n".join(["1> if A:", *(f"2> do {'w ' * 290}{i};" for i in range(5))])
    rows = [("d", 0, "5", "Proc", 1, "", [("prose", texts)]), ("d", 1, "5.1", "Small", 2, "5 Proc", [("prose", "tiny text")]), ("d", 2, "6", "Other", 1, "", [("prose", "It shall be.")]), ("d", 3, "6.1", "In", 2, "6 Other", [("prose", "more")])]
    df = spark.createDataFrame(rows, "doc string, order int, clause_id string, clause_title string, level int, breadcrumb string, blocks array<struct<type:string,text:string>>")
    df = df.withColumns({"clause_uid": F.concat(F.lit("d::"), "clause_id"), "spec": F.lit("38.331"), "spec_id": F.lit("TS 38.331"), "version": F.lit("18.8.0"), "release": F.lit(18)})
    titles = spark.createDataFrame([("38.331", "RRC")], "spec string, title string")
    got = {r.chunk_id: r for r in chunking.chunk(df, titles).collect()}
    assert set(got) == {"d::5::1", "d::5::2", "d::5::3", "d::5.1", "d::6"}
    assert got["d::5::2"].text.startswith("1> if A:") and got["d::5::2"].n_parts == 3
    assert got["d::6"].merged_clause_ids == ["6.1"] and got["d::6"].has_normative and got["d::6"].citation == "TS 38.331 v18.8.0, clause 6"
    assert got["d::6"].embed_text.startswith("TS 38.331 v18.8.0 (Rel-18) - RRC\nClause 6: Other\n\nIt shall be.")
    assert chunking.orphans(spark.createDataFrame(list(got.values()))).count() == 0


def test_summaries(spark):
    rows = spark.createDataFrame([(i, i) for i in range(100)], "chunk_id int, v int")
    got = chunking.index_percentiles(rows, "v", {"p05": (0.05, -1), "p50": (0.5, 0), "p95": (0.95, 0)}).first()
    assert (got.n, got.p05, got.p50, got.p95) == (100, 4, 50, 95)
    assert [r.chunk_id for r in chunking.systematic_sample(rows, ["chunk_id"], 4).collect()] == [0, 25, 50, 75]


def test_catalogue(spark, tmp_path):
    listing = spark.createDataFrame([("38.331", "38331-h90.zip 38331-I80.zip x 38331-ia0.zip 38331-ia0.ZIP 38331-j10.zip"), ("1.2", "none")], "spec string, listing string")
    found = catalog.listed_versions(listing)
    assert sorted(r.code for r in found.collect()) == ["h90", "i80", "ia0", "j10"]
    assert tuple(catalog.pick_versions(found, 18).select("code", "is_fallback").first()) == ("ia0", False)
    old = found.where("code = 'h90'")
    assert tuple(catalog.pick_versions(old, 18).select("code", "is_fallback").first()) == ("h90", True)
    catalog.write_manifest(catalog.pick_versions(found, 18), str(tmp_path / "m"))
    back = catalog.read_manifest(spark, str(tmp_path / "m"))
    assert tuple(back.first()) == ("38.331", "18.10.0", "Rel-18", "38331-ia0.zip")
    assert catalog.to_fetch(catalog.pick_versions(found, 18), back).count() == 0
    names = spark.createDataFrame([("a",), ("b",)], "spec string")
    assert catalog.select_specs(names, ["a"], ["b"]).count() == 1 and catalog.select_specs(names).count() == 2
    flat = names.select(catalog.from_flat_list(catalog.flat_list(F.array(F.lit("x"), F.lit(""), F.lit("y")))).alias("l")).first().l
    assert flat == ["x", "y"]


def docx_file():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda style, text: f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>'
    cell = lambda t: f"<w:tc><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    body = p("H1", "5 Setup") + p("Normal", "before") + f"<w:tbl><w:tr>{cell('a')}{cell('b')}</w:tr><w:tr>{cell('1')}{cell('2|3')}</w:tr></w:tbl>" + p("Normal", "after") + "<w:sectPr/>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
        z.writestr("word/styles.xml", f'<w:styles {w}><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style></w:styles>')
    return out.getvalue()


def test_word_files(spark, tmp_path):
    (tmp_path / "38331-ia0.docx").write_bytes(docx_file())
    rows = docx.read_docx(spark, str(tmp_path))
    got = tree.clauses(rows).first()
    assert (got.doc, got.clause_id, got.clause_title) == ("38331-ia0", "5", "Setup")
    assert [tuple(b) for b in got.blocks] == [("prose", "before"), ("table", "| a | b |\n| --- | --- |\n| 1 | 2\\|3 |"), ("prose", "after")]
    archive = io.BytesIO()
    with zipfile.ZipFile(archive, "w") as z:
        z.writestr("small.docx", b"x")
        z.writestr("large.DOCX", docx_file())
        z.writestr("notes.txt", b"y" * 9999)
    files = spark.createDataFrame([("a.zip", archive.getvalue()), ("b.zip", b"broken")], "path string, content binary")
    found = {r.path: r for r in catalog.largest_document(files).collect()}
    assert found["a.zip"].member == "large.DOCX" and found["b.zip"].error


def test_nesting_of_any_depth(spark):
    texts = [f"{k}> step {k}" for k in range(1, 16)] + ["an inner remark", "15> again", "20> deeper", "Done."]
    got = [r.ancestors for r in chunking.with_ancestors(units(spark, texts), ["doc"]).orderBy("pos").collect()]
    assert got[14] == list(range(14)) and got[15] == list(range(15)) and got[16] == list(range(14)) and got[17] == [*range(14), 16] and got[18] == []


def test_headings_of_any_level(spark):
    rows = [("d", 2 * k + j, f"Heading {k}" if not j else "Normal", "paragraph", f"{k} T{k}" if not j else "x") for k in [*range(1, 8), *range(9, 16), 13] for j in (0, 1)]
    rows = [(d, n, *r) for n, (d, _, *r) in enumerate(rows)]
    got = tree.clauses(spark.createDataFrame(rows, "doc string, pos int, style string, kind string, text string")).orderBy("order").collect()
    assert got[13].breadcrumb == " > ".join(f"{k} T{k}" for k in [*range(1, 8), *range(9, 15)])
    assert got[14].breadcrumb == " > ".join(f"{k} T{k}" for k in [*range(1, 8), *range(9, 13)])


def test_headings_with_no_break_spaces(spark):
    rows = [("d", 0, "Heading 1", "paragraph", "5.1\xa0General"), ("d", 1, "Normal", "paragraph", "x"), ("d", 2, "Heading 8", "paragraph", "Annex\u2003A\xa0(Normative):\xa0More\xa0")]
    got = tree.clauses(spark.createDataFrame(rows, "doc string, pos int, style string, kind string, text string")).orderBy("order").collect()
    assert [(r.clause_id, r.clause_title, r.level) for r in got] == [("5.1", "General", 1), ("Annex A", "More", 1)]


def test_merged_cells():
    import xml.etree.ElementTree as ET

    w = docx.W[1:-1]
    cell = lambda text, props="": f"<w:tc><w:tcPr>{props}</w:tcPr><w:p><w:r><w:t>{text}</w:t></w:r></w:p></w:tc>"
    down, on, wide = '<w:vMerge w:val="restart"/>', "<w:vMerge/>", '<w:gridSpan w:val="2"/>'
    rows = [cell("a", down) + cell("b", wide), cell("", on) + cell("c") + cell("d", down), cell("", on) + cell("e") + cell("", on), cell("f", wide) + cell("g")]
    table = ET.fromstring(f'<w:tbl xmlns:w="{w}">' + "".join(f"<w:tr>{r}</w:tr>" for r in rows) + "</w:tbl>")
    assert docx.table_cells(table) == [["a", "b"], ["a", "c", "d"], ["a", "e", "d"], ["f", "g"]]


def test_running_sums_and_samples_by_ranges(spark):
    import random

    r = random.Random(4)
    rows = [("ab"[r.randrange(2)], r.randrange(40), r.randrange(5)) for _ in range(500)] + [(None, 3, 2)]
    df = spark.createDataFrame(rows, "g string, v int, c int").groupBy("g", "v").agg(F.sum("c").alias("c"))
    for x in chunking.running_sum(df, ["v"], "c", "upto", ["g"]).collect():
        assert x.upto == sum(c for g, v, c in rows if g == x.g and v <= x.v)
    sample = chunking.systematic_sample(spark.range(100_003).selectExpr("(id * 7919) % 100003 as k"), ["k"], 9).orderBy("k").collect()
    assert [(x.k, x.place) for x in sample] == [(k * 11111, k * 11111) for k in range(9)]
