"""The driver's tables in the roles of this library: corpus, questions, vectors, styled rows, answers.

documents are chunks (source is the document, doc_id the clause), benchmark items are questions, and every embedding
whose id is divisible by 100 is a question vector, that of the benchmark item with a hundredth of its id. Rules that these tables never trigger get rows derived from them by arithmetic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    # A small file is one task; texts are worth spreading before they are taken apart.
    return rows.repartition(cores) if name == "documents" and rows.rdd.getNumPartitions() < cores else rows


def corpus(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("embed_text"))


def questions(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))


def question_vectors(spark, sf_dir) -> DataFrame:
    """(qid, embedding, specs): the stated set of questions, every row with an id divisible by 100."""
    asked = table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0")
    return asked.select(F.expr("vec_id div 100").alias("qid"), "embedding", F.array(F.col("label").cast("string")).alias("specs"))


def spec_chunks(spark, sf_dir) -> DataFrame:
    """chunk_id, spec 38.0nn from the source's number, clause_id from the id, part, order, text."""
    n = F.regexp_extract("source", "([0-9]+)$", 1)
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("chunk_id"), F.concat(F.lit("38."), F.lpad(n, 3, "0")).alias("spec"),
        F.format_string("%d.%d", F.col("doc_id") % 20 + 1, F.col("doc_id") % 7).alias("clause_id"),
        (F.col("doc_id") % 3 + 1).cast("int").alias("part"), F.col("doc_id").alias("order"), "text",
    )


SPEC_CHUNKS_SQL = r"""SELECT doc_id AS chunk_id, '38.' || lpad(regexp_extract(source, '([0-9]+)$', 1), 3, '0') AS spec,
 CAST(doc_id % 20 + 1 AS VARCHAR) || '.' || CAST(doc_id % 7 AS VARCHAR) AS clause_id, CAST(doc_id % 3 + 1 AS INTEGER) AS part,
 doc_id AS "order", text FROM documents"""


def lookup_questions(spark, sf_dir) -> DataFrame:
    """Benchmark items; every third names a document and a clause."""
    text = F.when(
        F.col("item_id") % 3 == 0,
        F.concat(
            F.format_string("What does TS 38.0%02d clause %d.%d say? ", F.col("item_id") % 20, F.col("item_id") % 20 + 1, F.col("item_id") % 7), F.col("text")
        ),
    ).otherwise(F.col("text"))
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), text.alias("question"))


LOOKUP_QUESTIONS_SQL = """SELECT item_id AS qid, CASE WHEN item_id % 3 = 0 THEN 'What does TS 38.0' || lpad(CAST(item_id % 20 AS VARCHAR), 2, '0')
 || ' clause ' || CAST(item_id % 20 + 1 AS VARCHAR) || '.' || CAST(item_id % 7 AS VARCHAR) || ' say? ' || text ELSE text END AS question FROM benchmark"""


def lines(spark, sf_dir) -> DataFrame:
    """(doc_id, pos, text): non-blank lines of the documents, trimmed."""
    split = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return split.select("doc_id", "pos", F.regexp_replace("line", r"^[ \t\r]+|[ \t\r]+$", "").alias("text")).where("text <> ''")


LINES_SQL = r"""SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, regexp_replace(l[i], '^[ \t\r]+|[ \t\r]+$', '', 'g') AS text
 FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) AS d, unnest(range(1, len(l) + 1)) AS u(i)
 WHERE regexp_replace(l[i], '^[ \t\r]+|[ \t\r]+$', '', 'g') <> ''"""


def nested_units(spark, sf_dir) -> DataFrame:
    """Lines with markers of depth length % 5 (0: none), a NOTE at every eleventh position, as units."""
    d = F.length("text") % 5
    text = F.when(F.col("pos") % 11 == 10, F.concat(F.lit("NOTE 1: "), F.col("text"))).when(d > 0, F.concat(d.cast("string"), F.lit("> "), F.col("text"))).otherwise(F.concat(F.lit("Zz "), F.col("text")))
    return lines(spark, sf_dir).select(
        "doc_id", "pos", text.alias("text"), F.lit("prose").alias("kind"), F.regexp_count("text", F.lit(r"[^ \t\n\x0B\f\r]+")).alias("tokens"),
        (F.length("text") % 13 == 0).alias("atomic"),
    )


NESTED_SQL = rf"""SELECT doc_id, pos, CASE WHEN pos % 11 = 10 THEN 'NOTE 1: ' || text WHEN length(text) % 5 > 0
 THEN CAST(length(text) % 5 AS VARCHAR) || '> ' || text ELSE 'Zz ' || text END AS text,
 CASE WHEN pos % 11 <> 10 AND length(text) % 5 > 0 THEN length(text) % 5 END AS depth, pos % 11 = 10 AS goes_on,
 CAST(len(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+')) AS INTEGER) AS tokens, length(text) % 13 = 0 AS atomic FROM ({LINES_SQL}) AS lines"""


def styled_rows(spark, sf_dir) -> DataFrame:
    """Lines as styled paragraphs: headings of three levels, code, tables, prose."""
    n = F.length("text")
    style = F.when((n % 4 == 0) | (F.col("pos") == 0), F.concat(F.lit("Heading "), (n % 3 + 1).cast("string"))).when(n % 7 == 1, "PL").when(n % 11 == 2, "toc 1").otherwise("Normal")
    return lines(spark, sf_dir).select(
        F.col("doc_id").cast("string").alias("doc"), "pos", style.alias("style"),
        F.when((n % 5 == 3) & ~((n % 4 == 0) | (F.col("pos") == 0)), "table").otherwise("paragraph").alias("kind"),
        F.when((n % 4 == 0) | (F.col("pos") == 0), F.concat((n % 9).cast("string"), F.lit(".1 Title "), (n % 6).cast("string"))).otherwise(F.col("text")).alias("text"),
    )


STYLED_SQL = rf"""SELECT CAST(doc_id AS VARCHAR) AS doc, pos, length(text) % 4 = 0 OR pos = 0 AS head, length(text) % 3 + 1 AS level,
 CAST(length(text) % 9 AS VARCHAR) || '.1' AS clause_id, 'Title ' || CAST(length(text) % 6 AS VARCHAR) AS title,
 CASE WHEN length(text) % 5 = 3 THEN 'table' WHEN length(text) % 7 = 1 THEN 'asn1' ELSE 'prose' END AS type, text
 FROM ({LINES_SQL}) AS lines WHERE length(text) % 4 = 0 OR pos = 0 OR length(text) % 7 = 1 OR length(text) % 11 <> 2"""


def answers(spark, sf_dir) -> DataFrame:
    """One model answer per document: claims from all its lines, passages by arithmetic, six hits."""
    claims = F.transform(
        F.split("text", "\n"),
        lambda x, i: F.struct(x.alias("text"), F.array((F.length(x) % 9).cast("int"), ((F.length(x) + i * 3) % 8).cast("int")).alias("passages"), F.lit("none").alias("normative")),
    )
    hits = F.transform(F.sequence(F.lit(1), F.lit(6)), lambda i: F.struct(F.format_string("doc %d, clause %d", F.col("doc_id"), i).alias("citation"), F.lit("").alias("text")))
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("qid"), (F.col("doc_id") % 7 != 0).alias("answerable"), F.lit("prose").alias("text"),
        F.when(F.col("doc_id") % 5 == 0, F.slice(claims, 1, 0)).otherwise(claims).alias("claims"), hits.alias("hits"),
    )


ANSWERS_SQL = r"""SELECT doc_id AS qid, doc_id % 7 <> 0 AS answerable, i - 1 AS idx, l[i] AS text,
 [CAST(length(l[i]) % 9 AS INTEGER), CAST((length(l[i]) + (i - 1) * 3) % 8 AS INTEGER)] AS passages
 FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) AS d, unnest(range(1, len(l) + 1)) AS u(i) WHERE doc_id % 5 <> 0"""


def judged(spark, sf_dir) -> DataFrame:
    """(qid, idx, judge, score, contradicted) by arithmetic: claims of every order, a row a passage and judge."""
    lineitem = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("long").alias("qid"), F.col("l_linenumber").cast("int").alias("idx"))
    each = lineitem.select(
        "*", F.explode(F.array(F.lit(0), F.lit(1))).alias("j")
    ).select("*", F.explode(F.sequence(F.lit(1), F.col("idx") % 3 + 1)).alias("p"))
    x = (F.col("qid") * 37 + F.col("idx") * 101 + F.col("j") * 7 + F.col("p") * 211) % 10007
    return each.where("(qid + idx) % 9 <> 0").select(
        "qid", "idx", F.when(F.col("j") == 0, "nli").otherwise("llm").alias("judge"), F.sqrt(x / 10007.0).alias("score"), (x % 6 == 0).alias("contradicted")
    )


JUDGED_SQL = """SELECT qid, idx, CASE j WHEN 0 THEN 'nli' ELSE 'llm' END AS judge, sqrt(x / 10007.0::DOUBLE) AS score, x % 6 = 0 AS contradicted FROM (
 SELECT *, (qid * 37 + idx * 101 + j * 7 + p * 211) % 10007 AS x FROM (SELECT CAST(l_orderkey AS BIGINT) AS qid, CAST(l_linenumber AS INTEGER) AS idx FROM lineitem) AS l,
 unnest([0, 1]) AS a(j), unnest(range(1, idx % 3 + 2)) AS b(p) WHERE (qid + idx) % 9 <> 0) AS s"""


def gate_scores(spark, sf_dir) -> DataFrame:
    """top_score and answerable of every labelled document, by arithmetic."""
    x = (F.col("doc_id") * 7919 + F.col("quality") * 2503) % 10007
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("qid"), (x / 10007.0).cast("double").alias("top_score"), (F.col("quality") == 1).alias("answerable"))


GATE_SQL = "SELECT doc_id AS qid, CAST((doc_id * 7919 + quality * 2503) % 10007 AS DOUBLE) / 10007.0::DOUBLE AS top_score, quality = 1 AS answerable FROM labels"
