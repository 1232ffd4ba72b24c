"""The registered queries of the library's own operators, each beside its SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftstone.functions import text as tx
from siftstone.functions import versions
from siftstone.operators import answers, bm25, chunking, evaluate, fusion, scorers, tree, vectors, verify
from siftstone.plans import ask
from siftstone.plans import inputs as i
from siftstone.plans.retrieve import Retriever
from siftstone.plans.served import served_index
from siftstone.sources import catalog

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return add


TOKEN = tx.TOKEN.replace("'", "''")
STOP = ", ".join(f"'{w}'" for w in tx.STOPWORDS)


def forms_sql(source: str, key: str, text: str) -> str:
    """(key, term) with repeats, in order as (t, f)."""
    hump = r"string_split(regexp_replace(regexp_replace(p, '([a-z0-9])([A-Z])', '\1~\2', 'g'), '([A-Z])([A-Z][a-z])', '\1~\2', 'g'), '~')"
    return rf"""SELECT {key}, t, f, forms[f] AS term FROM (SELECT {key}, t, list_concat(list_filter([low], lambda x: x NOT IN ({STOP})),
  list_filter(list_transform(list_concat(CASE WHEN len(parts) > 1 THEN parts ELSE [] END, flatten(list_filter(list_transform(
  CASE WHEN len(parts) > 0 THEN parts ELSE [raw] END, lambda p: list_filter({hump}, lambda x: length(x) >= 3)), lambda h: len(h) > 1))),
  lambda x: lower(x)), lambda x: x <> low AND x NOT IN ({STOP}))) AS forms
 FROM (SELECT {key}, t, raws[t] AS raw, lower(raws[t]) AS low, list_filter(string_split_regex(raws[t], '[-_/]'), lambda x: length(x) >= 2) AS parts
 FROM (SELECT {key}, regexp_extract_all(coalesce({text}, ''), '{TOKEN}') AS raws FROM {source}) AS s1, unnest(range(1, len(raws) + 1)) AS u1(t)) AS s2) AS s3,
 unnest(range(1, len(forms) + 1)) AS u2(f)"""


DOC_FORMS = forms_sql("documents", "doc_id", "text")
INDEX = f"""forms AS ({DOC_FORMS}), lens AS (SELECT d.doc_id, count(term) AS dl FROM documents AS d LEFT JOIN forms ON forms.doc_id = d.doc_id GROUP BY d.doc_id),
postings AS (SELECT term, doc_id, count(*) AS tf FROM forms GROUP BY term, doc_id), totals AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM lens),
terms AS (SELECT term, count(*) AS df, ln(1 + (any_value(n) - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf FROM postings, totals GROUP BY term)"""


def bm25_sql(question_source: str, question: str = "text", qid: str = "item_id", k: int = 30) -> str:
    """CTEs up to sparse(qid, chunk_id, score, rank)."""
    return f"""{INDEX}, asked AS (SELECT {qid} AS qid, term, count(*) AS qtf FROM ({forms_sql(question_source, qid, question)}) AS q GROUP BY 1, 2),
scored AS (SELECT qid, p.doc_id AS chunk_id, round(sum(qtf * idf * (tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)))), 6) AS score
 FROM asked JOIN terms USING (term) JOIN postings AS p USING (term) JOIN lens USING (doc_id), totals GROUP BY qid, p.doc_id),
sparse AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM scored) AS r WHERE rank <= {k})"""


# Text


@query(f"SELECT doc_id, len(w) AS n_tokens, len(list_distinct(list_transform(w, lambda x: lower(x)))) AS n_distinct FROM (SELECT doc_id, regexp_extract_all(text, '{TOKEN}') AS w FROM documents) AS d")
def tokens_basic(spark, sf_dir):
    raw = tx.raw_tokens(F.col("text"))
    return i.table(spark, sf_dir, "documents").select(
        "doc_id", F.size(raw).alias("n_tokens"), F.size(F.array_distinct(F.transform(raw, F.lower))).alias("n_distinct")
    )


@query(f"WITH f AS ({DOC_FORMS}) SELECT d.doc_id, count(term) AS n_forms, md5(coalesce(string_agg(term, ' ' ORDER BY t, f), '')) AS forms_md5 FROM documents AS d LEFT JOIN f ON f.doc_id = d.doc_id GROUP BY d.doc_id")
def tokens_multiform(spark, sf_dir):
    rows = i.table(spark, sf_dir, "documents").select("doc_id", tx.tokenize(F.col("text")).alias("t"))
    return rows.select("doc_id", F.size("t").alias("n_forms"), F.md5(F.array_join("t", " ").cast("binary")).alias("forms_md5"))


REFS = r"""SELECT {0} AS qid, list_sort(list_distinct(regexp_extract_all(question, '(?i)\b(?:TS\s*|TR\s*)?(\d{{2}}\.\d{{3}})\b', 1))) AS specs,
 list_sort(list_distinct(regexp_extract_all(question, '(?i)(?:clause|section|§)\s*([0-9]+(?:\.[0-9A-Za-z]+)*)', 1))) AS clauses"""


@query(f"SELECT *, len(clauses) > 0 AS is_pinpoint FROM ({REFS.format('qid')} FROM ({i.LOOKUP_QUESTIONS_SQL}) AS q) AS r")
def parse_query_refs(spark, sf_dir):
    return i.lookup_questions(spark, sf_dir).select("qid", tx.query_plan(F.col("question")).alias("p")).select("qid", "p.*")


@query("""SELECT c_custkey, 'C' || CAST(c_custkey AS VARCHAR) || ' v18.1.0, clause 5.' || CAST(c_custkey % 9 AS VARCHAR) AS citation,
 'C' || CAST(c_custkey AS VARCHAR) || ' v18.1.0 (Rel-18)' || CASE WHEN c_custkey % 3 = 0 THEN ' - ' || c_name ELSE '' END || chr(10)
 || CASE WHEN c_custkey % 2 = 0 THEN 'up > here' || chr(10) ELSE '' END || 'Clause 5.' || CAST(c_custkey % 9 AS VARCHAR)
 || CASE WHEN c_custkey % 5 = 0 THEN '' ELSE ': ' || c_name END || CASE WHEN c_custkey % 4 > 1 THEN ' [part 1/' || CAST(c_custkey % 4 AS VARCHAR) || ']' ELSE '' END AS header FROM customer""")
def context_headers(spark, sf_dir):
    c = F.col("c_custkey")
    clause = F.concat(F.lit("5."), (c % 9).cast("string"))
    name, spec = F.col("c_name"), F.concat(F.lit("C"), c.cast("string"))
    header = tx.context_header(
        spec, F.lit("18.1.0"), F.lit(18), F.when(c % 3 == 0, name).otherwise(""), F.when(c % 2 == 0, "up > here").otherwise(""),
        clause, F.when(c % 5 == 0, clause).otherwise(name), F.lit(1), (c % 4).cast("int"),
    )
    return i.table(spark, sf_dir, "customer").select("c_custkey", tx.citation(spec, F.lit("18.1.0"), clause).alias("citation"), header.alias("header"))


@query("""SELECT r_regionkey, '| ' || string_agg(n_name, ' | ' ORDER BY n_nationkey) || ' |' || chr(10) || '| ' || array_to_string(list_transform(range(count(*)), lambda x: '---'), ' | ') || ' |'
 || chr(10) || '| a\\|b |' || repeat('  |', CAST(count(*) - 1 AS INTEGER)) AS md FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey""".replace("\\\\", "\\"))
def markdown_tables(spark, sf_dir):
    nation = i.table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("n"))
    names = F.transform("n", lambda x: x["n_name"])
    rows = F.array(names, F.array(F.lit(" "), F.lit("")), F.array(F.lit("a|b")))
    return nation.join(i.table(spark, sf_dir, "region"), "r_regionkey").select("r_regionkey", tx.markdown_table(rows).alias("md"))


# Versions and catalogue

CODES = "SELECT p_brand AS spec, substr(md5(CAST(p_partkey AS VARCHAR)), 1, CASE WHEN p_partkey % 10 = 0 THEN 4 ELSE 3 END) AS code FROM part"
DIGIT = "strpos('0123456789abcdefghijklmnopqrstuvwxyz', lower(substr(code, {0}, 1))) - 1"


def codes(spark, sf_dir):
    n = F.when(F.col("p_partkey") % 10 == 0, 4).otherwise(3)
    return i.table(spark, sf_dir, "part").select(F.col("p_brand").alias("spec"), F.substring(F.md5(F.col("p_partkey").cast("string").cast("binary")), F.lit(1), n).alias("code"))


DECODED = f"SELECT spec, code, {DIGIT.format(1)} AS x, {DIGIT.format(2)} AS y, {DIGIT.format(3)} AS z FROM ({CODES}) AS c WHERE length(code) = 3"


@query(f"SELECT code, concat_ws('.', x, y, z) AS version, CAST(x AS INTEGER) AS release, count(*) AS n FROM ({DECODED}) AS d GROUP BY ALL")
def version_decode(spark, sf_dir):
    rows = codes(spark, sf_dir).select("code", versions.version_string(F.col("code")).alias("version"), versions.decode_version(F.col("code"))["x"].alias("release"))
    return rows.where("version is not null").groupBy("code", "version", "release").agg(F.count("*").alias("n"))


@query(f"SELECT spec, code, CAST(x AS INTEGER) AS release, x <> 11 AS is_fallback FROM (SELECT *, row_number() OVER (PARTITION BY spec ORDER BY x = 11 DESC, x DESC, y DESC, z DESC) AS n FROM (SELECT DISTINCT * FROM ({DECODED}) AS d) AS e) AS f WHERE n = 1")
def pick_versions(spark, sf_dir):
    rows = codes(spark, sf_dir).distinct().select("spec", "code", versions.decode_version(F.col("code"))["x"].alias("release")).where("release is not null")
    return catalog.pick_versions(rows, 11).select("spec", "code", "release", "is_fallback")


# Sparse index


@query(f"WITH {INDEX} SELECT term, doc_id AS chunk_id, tf FROM postings")
def postings(spark, sf_dir):
    return bm25.build_index(i.corpus(spark, sf_dir)).postings.select("term", "chunk_id", "tf")


@query(f"WITH {INDEX} SELECT doc_id AS chunk_id, dl FROM lens")
def doc_stats(spark, sf_dir):
    return bm25.tokenized(i.corpus(spark, sf_dir)).select("chunk_id", F.size("tokens").alias("dl"))


@query(f"WITH {INDEX} SELECT term, df, round(idf, 9) AS idf FROM terms")
def term_idf(spark, sf_dir):
    return bm25.build_index(i.corpus(spark, sf_dir)).terms.withColumn("idf", F.round("idf", 9))


def served(spark, sf_dir):
    return served_index(i.corpus(spark, sf_dir))


@query(f"WITH {INDEX} SELECT (SELECT count(*) FROM postings) AS n_postings, (SELECT CAST(sum(tf) AS BIGINT) FROM postings) AS n_tokens, (SELECT count(*) FROM terms) AS n_terms, n AS n_chunks, round(avgdl, 6) AS avgdl FROM totals")
def stored_index(spark, sf_dir):
    """What the stored index holds; builds it where there is none yet."""
    index = served(spark, sf_dir)
    held = index.postings.agg(F.count("*").alias("n_postings"), F.sum("tf").alias("n_tokens")).crossJoin(index.terms.agg(F.count("*").alias("n_terms")))
    return held.crossJoin(index.totals.select(F.col("n").alias("n_chunks"), F.round("avgdl", 6).alias("avgdl")))


@query(f"WITH {bm25_sql('benchmark', k=10)} SELECT qid, rank, chunk_id, score FROM sparse")
def bm25_topk(spark, sf_dir):
    found = bm25.search(served(spark, sf_dir), i.questions(spark, sf_dir), 10)
    return found.select("qid", "rank", "chunk_id", "score")


TWICE = "(SELECT item_id, text || ' ' || text AS text FROM benchmark) AS twice"


@query(f"WITH {bm25_sql(TWICE, k=5)} SELECT qid, rank, chunk_id, score FROM sparse")
def bm25_query_multiplicity(spark, sf_dir):
    asked = i.questions(spark, sf_dir).withColumn("question", F.concat_ws(" ", "question", "question"))
    return bm25.search(served(spark, sf_dir), asked, 5).select("qid", "rank", "chunk_id", "score")


# Vectors

DENSE = """pairs AS (SELECT q.vec_id // 100 AS qid, v.vec_id AS chunk_id, list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS score
 FROM embeddings AS q, embeddings AS v WHERE q.vec_id % 100 = 0{0}),
dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM pairs) AS r WHERE rank <= {1})"""


def dense(spark, sf_dir, k, filtered=False):
    v = i.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", F.col("label").cast("string").alias("spec"))
    return vectors.search(v, i.question_vectors(spark, sf_dir), k, dimensions=64, filtered=filtered)


@query(f"WITH {DENSE.format('', 10)} SELECT qid, rank, chunk_id, round(score, 6) AS score FROM dense")
def knn_cosine_topk(spark, sf_dir):
    return dense(spark, sf_dir, 10).select("qid", "rank", "chunk_id", F.round("score", 6).alias("score"))


@query(f"WITH {DENSE.format(' AND q.label = v.label', 10)} SELECT qid, rank, chunk_id, round(score, 6) AS score FROM dense")
def knn_filtered(spark, sf_dir):
    return dense(spark, sf_dir, 10, True).select("qid", "rank", "chunk_id", F.round("score", 6).alias("score"))


@query("SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm, 1.0::DOUBLE AS unit FROM embeddings")
def vector_norms(spark, sf_dir):
    e = F.col("embedding")
    twice = F.transform(e, lambda x: x.cast("double") * 2)
    return i.table(spark, sf_dir, "embeddings").select("vec_id", F.round(vectors.norm(e), 6).alias("norm"), F.round(vectors.norm(vectors.normalised(twice)), 6).alias("unit"))


# Fusion and the funnel

FUSED = """fused AS (SELECT qid, chunk_id, coalesce(1.0::DOUBLE / (60 + max(d)), 0) + coalesce(1.0::DOUBLE / (60 + max(s)), 0) AS rrf_score, max(d) AS dense_rank, max(s) AS bm25_rank FROM (
 SELECT qid, chunk_id, rank AS d, NULL AS s FROM dense UNION ALL SELECT qid, chunk_id, NULL, rank FROM sparse) AS b GROUP BY qid, chunk_id),
top20 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rrf_score DESC, dense_rank ASC NULLS LAST, bm25_rank ASC NULLS LAST) AS rank FROM fused) AS r WHERE rank <= 20)"""


@query(f"WITH {bm25_sql('benchmark')}, {DENSE.format('', 30)}, {FUSED} SELECT qid, rank, chunk_id, rrf_score FROM top20")
def rrf_fused_top20(spark, sf_dir):
    sparse = bm25.search(served(spark, sf_dir), i.questions(spark, sf_dir))
    fused = fusion.rrf(dense(spark, sf_dir, fusion.DENSE_TOP_K), sparse)
    return fusion.fused_top(fused).select("qid", "rank", "chunk_id", "rrf_score")


PINS = f"""chunks AS ({i.SPEC_CHUNKS_SQL}), plans AS ({REFS.format('qid')}, question FROM ({i.LOOKUP_QUESTIONS_SQL}) AS q),
pins AS (SELECT qid, chunk_id, row_number() OVER (PARTITION BY qid ORDER BY part, nth, n) AS pin_pos FROM (
 SELECT qid, chunk_id, part, nth, row_number() OVER (PARTITION BY qid, nth ORDER BY "order", chunk_id) AS n
 FROM (SELECT qid, specs, nth, clauses[nth] AS clause_id FROM plans, unnest(range(1, len(clauses) + 1)) AS u(nth)) AS p JOIN chunks USING (clause_id)
 WHERE len(specs) = 0 OR list_contains(specs, spec)) AS f WHERE n <= 20)"""


@query(f"WITH {PINS} SELECT qid, pin_pos, chunk_id FROM pins")
def pinpoint_lookup(spark, sf_dir):
    plans = i.lookup_questions(spark, sf_dir).select("qid", tx.query_plan(F.col("question")).alias("p")).select("qid", "p.*")
    return fusion.pinpoint(plans, i.spec_chunks(spark, sf_dir)).select("qid", "pin_pos", "chunk_id")


LOOKUP = f"({i.LOOKUP_QUESTIONS_SQL}) AS lookups"
ALONE = "top20 AS (SELECT * FROM (SELECT qid, chunk_id, row_number() OVER (PARTITION BY qid ORDER BY 1.0::DOUBLE / (60 + rank) DESC, rank) AS rank FROM sparse) AS r WHERE rank <= 20)"
HYBRID = f"""vecs AS (SELECT vec_id AS chunk_id, embedding, spec FROM embeddings JOIN chunks ON chunk_id = vec_id),
pairs AS (SELECT qid, chunk_id, list_dot_product(e.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS score FROM plans JOIN embeddings AS e ON e.vec_id = qid * 100, vecs AS v WHERE len(specs) = 0 OR list_contains(specs, spec)),
dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM pairs) AS r WHERE rank <= 30), {FUSED}"""


def funnel_sql(top20: str) -> str:
    return f"""WITH {bm25_sql(LOOKUP, 'question', 'qid')}, {PINS}, {top20},
cand AS (SELECT qid, chunk_id, pin_pos, CAST(NULL AS BIGINT) AS rank FROM pins UNION ALL SELECT qid, chunk_id, NULL, rank FROM top20 WHERE NOT EXISTS (SELECT 1 FROM pins WHERE pins.qid = top20.qid AND pins.chunk_id = top20.chunk_id)),
qsize AS (SELECT qid, count(DISTINCT term) AS size FROM asked GROUP BY qid),
both_have AS (SELECT c.qid, c.chunk_id, count(*) AS hit FROM cand AS c JOIN asked USING (qid) JOIN postings AS p ON p.term = asked.term AND p.doc_id = c.chunk_id GROUP BY 1, 2),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY pin_pos ASC NULLS LAST, rerank_score DESC, rank ASC NULLS FIRST, chunk_id) AS position
 FROM (SELECT cand.*, coalesce(CAST(hit AS DOUBLE) / size, 0) AS rerank_score FROM cand LEFT JOIN both_have USING (qid, chunk_id) LEFT JOIN qsize USING (qid)) AS s) AS o WHERE position <= 6)"""


FUNNEL = funnel_sql(ALONE)


def funnel(spark, sf_dir, **flags):
    return Retriever(i.spec_chunks(spark, sf_dir), served(spark, sf_dir), index_of_text=True, **flags).retrieve(i.lookup_questions(spark, sf_dir))


@query(f"{FUNNEL} SELECT qid, position, chunk_id, round(rerank_score, 9) AS rerank_score, pin_pos IS NOT NULL AS pinned FROM hits")
def funnel_hits(spark, sf_dir):
    hits = funnel(spark, sf_dir)[1]
    return hits.select("qid", "position", "chunk_id", F.round("rerank_score", 9).alias("rerank_score"), F.col("pin_pos").isNotNull().alias("pinned"))


@query(f"{funnel_sql(HYBRID)} SELECT qid, position, chunk_id, round(rerank_score, 9) AS rerank_score, pin_pos IS NOT NULL AS pinned FROM hits")
def hybrid_hits(spark, sf_dir):
    """Both arms: every question by its terms, those with a vector (ids divisible by 100) also by that."""
    chunks = i.spec_chunks(spark, sf_dir)
    vecs = i.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding").join(chunks.select("chunk_id", "spec"), "chunk_id")
    asked = i.lookup_questions(spark, sf_dir).join(i.question_vectors(spark, sf_dir).select("qid", "embedding"), "qid", "left")
    hits = Retriever(chunks, served(spark, sf_dir), dense=vecs, index_of_text=True).retrieve(asked)[1]
    return hits.select("qid", "position", "chunk_id", F.round("rerank_score", 9).alias("rerank_score"), F.col("pin_pos").isNotNull().alias("pinned"))


@query(f"""{FUNNEL}, best AS (SELECT qid, max(rerank_score) AS top_score, min_by(rerank_score, position) AS first_score, count(*) AS n_hits FROM hits GROUP BY qid)
SELECT plans.qid, round(top_score, 9) AS top_score, round(first_score, 9) AS first_score, coalesce(n_hits, 0) AS n_hits,
 n_hits IS NULL OR (top_score < 0.9 AND len(clauses) = 0) AS refused FROM plans LEFT JOIN best USING (qid)""")
def gate_decision(spark, sf_dir):
    rows = funnel(spark, sf_dir)[0]
    return rows.select("qid", F.round("top_score", 9).alias("top_score"), F.round("first_score", 9).alias("first_score"), "n_hits", "refused")


@query(f"""{FUNNEL}, best AS (SELECT qid, max(rerank_score) AS top_score FROM hits GROUP BY qid), lens_q AS (SELECT qid, length(question) AS n FROM plans)
SELECT plans.qid, CASE WHEN top_score IS NULL OR (top_score < 0.9 AND len(clauses) = 0) THEN 'gate' ELSE 'answered' END AS stage FROM plans LEFT JOIN best USING (qid) JOIN lens_q USING (qid) WHERE n BETWEEN 3 AND 2000""")
def ask_stages(spark, sf_dir):
    return ask.ask(Retriever(i.spec_chunks(spark, sf_dir), served(spark, sf_dir), index_of_text=True), i.lookup_questions(spark, sf_dir)).select("qid", "stage")


@query(f"""{FUNNEL}, best AS (SELECT qid, max(rerank_score) AS top_score FROM hits GROUP BY qid)
SELECT plans.qid, CASE WHEN top_score IS NULL OR (top_score < 0.9 AND len(clauses) = 0) THEN 'gate' WHEN qid % 5 IN (1, 3, 4) THEN 'generation' WHEN qid % 5 = 2 THEN 'verification' ELSE 'answered' END AS stage,
 CASE WHEN top_score IS NULL OR (top_score < 0.9 AND len(clauses) = 0) THEN NULL WHEN qid % 5 = 2 THEN 'refused' WHEN qid % 5 = 0 THEN 'grounded' END AS label
 FROM plans LEFT JOIN best USING (qid) WHERE length(question) BETWEEN 3 AND 2000""")
def ask_all_stages(spark, sf_dir):
    """Replies by arithmetic: the first passage, no answer, an unsupported claim, a claim without a valid passage, no JSON."""
    first, q = F.col("hits")[0]["text"], F.col("qid")
    made = lambda text, passage: F.to_json(F.struct(F.lit(True).alias("answerable"), text.alias("answer"), F.array(F.struct(text.alias("text"), F.array(F.lit(passage)).alias("passages"), F.lit("none").alias("normative"))).alias("claims"), F.lit("").alias("missing")))
    reply = F.when(q % 5 == 0, made(first, 1)).when(q % 5 == 1, '{"answerable": false, "answer": "", "claims": [], "missing": "all"}').when(q % 5 == 2, made(F.lit("qqqq zzzz"), 1)).when(q % 5 == 3, made(first, 9)).otherwise("no json")
    found = ask.ask(Retriever(i.spec_chunks(spark, sf_dir), served(spark, sf_dir), index_of_text=True), i.lookup_questions(spark, sf_dir), reply=reply)
    return found.select("qid", "stage", "label")


# Prompts, judges and replies

PASSAGE = """chr(10) || '[' || CAST(k AS VARCHAR) || '] doc ' || CAST(item_id AS VARCHAR) || chr(10) || '    section: ' || CASE WHEN k = 2 THEN '' ELSE 'up' END || chr(10) || '    title:   t'
 || chr(10) || substr(text, 1, 10 * k)"""


@query(f"SELECT item_id AS qid, 'QUESTION: ' || text || chr(10) || chr(10) || 'PASSAGES:' || (SELECT string_agg(chr(10) || {PASSAGE}, '' ORDER BY k) FROM unnest([1, 2, 3]) AS u(k)) AS prompt FROM benchmark")
def prompts(spark, sf_dir):
    hits = F.transform(F.array(*map(F.lit, (1, 2, 3))), lambda k: F.struct(
        F.format_string("doc %d", F.col("item_id")).alias("citation"), F.when(k != 2, "up").alias("breadcrumb"), F.lit("t").alias("clause_title"), F.substring(F.col("text"), F.lit(1), 10 * k).alias("text"),
    ))
    return i.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), tx.prompt(F.col("text"), hits).alias("prompt"))


REPLY = "CASE c_custkey % 6 WHEN 0 THEN '' WHEN 1 THEN 'no idea' WHEN 2 THEN 'nan' WHEN 3 THEN ' 0.' || CAST(c_custkey AS VARCHAR) || ' because' WHEN 4 THEN CAST(c_custkey AS VARCHAR) ELSE '-1' END"


@query(f"""SELECT c_custkey, x AS score, x = 0 AS contradicted FROM (SELECT c_custkey, CASE WHEN v IS NULL OR isnan(v) THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, v)) END AS x
 FROM (SELECT c_custkey, TRY_CAST(string_split(trim({REPLY}), ' ')[1] AS DOUBLE) AS v FROM customer) AS r) AS s""")
def judge_replies(spark, sf_dir):
    c = F.col("c_custkey")
    reply = F.when(c % 6 == 0, "").when(c % 6 == 1, "no idea").when(c % 6 == 2, "nan").when(c % 6 == 3, F.concat(F.lit(" 0."), c.cast("string"), F.lit(" because"))).when(c % 6 == 4, c.cast("string")).otherwise("-1")
    return i.table(spark, sf_dir, "customer").select("c_custkey", scorers.reply_verdict(tx.judge_number(reply)).alias("v")).select("c_custkey", "v.*")


@query("SELECT doc_id, length(text) AS n_chars, md5(substr(text, 1, 12000)) AS passage_md5 FROM documents WHERE text IS NOT NULL")
def judged_passages(spark, sf_dir):
    rows = i.table(spark, sf_dir, "documents").where("text is not null")
    return rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.md5(scorers.judged_passage(F.col("text")).cast("binary")).alias("passage_md5"))


LOGITS = "[CAST(c_custkey % 7 AS DOUBLE) / 2, CAST(c_custkey % 5 AS DOUBLE) / 3, CAST(c_custkey % 3 AS DOUBLE)]"


@query(f"""SELECT c_custkey, round(exp(l[2]) / (exp(l[1]) + exp(l[2]) + exp(l[3])), 9) AS score, l[1] >= l[2] AND l[1] >= l[3] AS contradicted FROM (SELECT c_custkey, {LOGITS} AS l FROM customer) AS s""")
def entailment_scores(spark, sf_dir):
    c = F.col("c_custkey")
    v = scorers.entailment(F.array((c % 7).cast("double") / 2, (c % 5).cast("double") / 3, (c % 3).cast("double")))
    return i.table(spark, sf_dir, "customer").select("c_custkey", v.alias("v")).select("c_custkey", F.round("v.score", 9).alias("score"), "v.contradicted")


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 400 + c_custkey % 100 WHEN 1 THEN 503 ELSE NULL END AS status FROM customer""")
def error_statuses(spark, sf_dir):
    c = F.col("c_custkey")
    message = F.when(c % 4 == 0, F.concat((400 + c % 100).cast("string"), F.lit(" gone"))).when(c % 4 == 1, "503 UNAVAILABLE").when(c % 4 == 2, "no 503").otherwise("")
    return i.table(spark, sf_dir, "customer").select("c_custkey", tx.error_status(message).cast("long").alias("status"))


# Trees and chunks

HEADING = """CASE p_partkey % 5 WHEN 0 THEN CAST(p_partkey % 9 + 1 AS VARCHAR) || '.' || CAST(p_partkey % 4 AS VARCHAR) || chr(160) || 'Title ' || CAST(p_partkey % 7 AS VARCHAR)
 WHEN 1 THEN '– ' || 'Cell' || chr(9) || 'of ' || CAST(p_partkey AS VARCHAR) WHEN 2 THEN 'Annex' || chr(8195) || chr(CAST(65 + p_partkey % 26 AS INTEGER)) || ' (Informative):' || chr(160) || 'Part ' || CAST(p_partkey AS VARCHAR)
 WHEN 3 THEN chr(160) || 'A.' || CAST(p_partkey % 3 AS VARCHAR) || chr(10) || ' Sub' ELSE '•lone' || CAST(p_partkey AS VARCHAR) END"""


@query(rf"""WITH h AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 2 THEN 8 ELSE p_partkey % 12 END AS style, trim(regexp_replace({HEADING}, '[\s\x{{a0}}\x{{2003}}]+', ' ', 'g')) AS t FROM part),
 m AS (SELECT *, regexp_matches(t, '^[A-Za-z0-9]+(\.[A-Za-z0-9]+)* .+$') AS numbered, regexp_matches(t, '^Annex [A-Z] \(') AS annex, regexp_replace(t, '^[–—•-] ?', '') AS bare FROM h)
SELECT p_partkey, CASE WHEN style = 8 AND annex THEN substr(t, 1, 7) WHEN style = 8 THEN t WHEN numbered THEN split_part(t, ' ', 1) ELSE bare END AS clause_id,
 CASE WHEN style = 8 AND annex THEN substr(t, strpos(t, ': ') + 2) WHEN style = 8 THEN t WHEN numbered THEN substr(t, strpos(t, ' ') + 1) ELSE bare END AS title,
 CAST(CASE WHEN style = 8 THEN 1 ELSE style END AS INTEGER) AS level, style = 8 AS is_annex_banner, CASE WHEN style = 8 AND annex THEN 'informative' ELSE '' END AS annex_kind FROM m""")
def parsed_headings(spark, sf_dir):
    n = F.col("p_partkey")
    text = lambda c: c.cast("string")
    raw = (
        F.when(n % 5 == 0, F.concat(text(n % 9 + 1), F.lit("."), text(n % 4), F.lit("\xa0Title "), text(n % 7))).when(n % 5 == 1, F.concat(F.lit("– Cell\tof "), text(n)))
        .when(n % 5 == 2, F.concat(F.lit("Annex\u2003"), F.char(65 + n % 26), F.lit(" (Informative):\xa0Part "), text(n))).when(n % 5 == 3, F.concat(F.lit("\xa0A."), text(n % 3), F.lit("\n Sub")))
        .otherwise(F.concat(F.lit("•lone"), text(n)))
    )
    style = F.concat(F.lit("Heading "), F.when(n % 5 == 2, 8).otherwise(n % 12).cast("string"))
    return i.table(spark, sf_dir, "part").select("p_partkey", tree.parse_heading(style, raw).alias("h")).select("p_partkey", "h.*")


BODY = "CASE p_partkey % 6 WHEN 0 THEN ' (Void) ' WHEN 1 THEN '' WHEN 2 THEN chr(8211) WHEN 3 THEN 'VOID' ELSE p_name END"
TITLE = "CASE p_partkey % 11 WHEN 0 THEN 'Scope ' WHEN 1 THEN 'Change HISTORY' WHEN 2 THEN 'void' WHEN 3 THEN 'Introduction to it' ELSE p_type END"


@query(f"""SELECT p_partkey FROM (SELECT p_partkey, lower(trim({TITLE})) AS t, lower(trim({BODY})) AS b FROM part) AS s WHERE b NOT IN ('', 'void', '<void>', '(void)', '-', chr(8211))
 AND t NOT IN ('foreword', 'scope', 'references', 'definitions of terms, symbols and abbreviations', 'change history', 'introduction', 'void')""")
def useful_clauses(spark, sf_dir):
    n = F.col("p_partkey")
    body = F.when(n % 6 == 0, " (Void) ").when(n % 6 == 1, "").when(n % 6 == 2, "–").when(n % 6 == 3, "VOID").otherwise(F.col("p_name"))
    title = F.when(n % 11 == 0, "Scope ").when(n % 11 == 1, "Change HISTORY").when(n % 11 == 2, "void").when(n % 11 == 3, "Introduction to it").otherwise(F.col("p_type"))
    return tree.keep_useful(i.table(spark, sf_dir, "part").select(n, body.alias("full_text"), title.alias("clause_title"))).select("p_partkey")


CLAUSES = f"""rows AS ({i.STYLED_SQL}), nthd AS (SELECT *, count(*) FILTER (head) OVER (PARTITION BY doc ORDER BY pos ROWS UNBOUNDED PRECEDING) AS nth FROM rows),
heads AS (SELECT *, coalesce((SELECT min(n.nth) FROM nthd AS n WHERE n.head AND n.doc = h.doc AND n.nth > h.nth AND n.level <= h.level), 1000000000) AS closed FROM nthd AS h WHERE head),
crumbs AS (SELECT h.doc, h.nth, h.clause_id, h.title, h.level, coalesce(string_agg(a.clause_id || ' ' || a.title, ' > ' ORDER BY a.nth), '') AS breadcrumb
 FROM heads AS h LEFT JOIN heads AS a ON a.doc = h.doc AND a.nth < h.nth AND h.nth < a.closed GROUP BY ALL),
runs AS (SELECT *, sum(new) OVER (PARTITION BY doc, nth ORDER BY pos) AS run FROM (SELECT *, CASE WHEN lag(type) OVER (PARTITION BY doc, nth ORDER BY pos) = type THEN 0 ELSE 1 END AS new FROM nthd WHERE NOT head) AS r),
blocks AS (SELECT doc, nth, run, any_value(type) AS type, string_agg(text, chr(10) ORDER BY pos) AS text FROM runs GROUP BY doc, nth, run),
bodies AS (SELECT doc, nth, count(*) AS n_blocks, string_agg(type, ',' ORDER BY run) AS types, string_agg(text, chr(10) || chr(10) ORDER BY run) AS body FROM blocks GROUP BY doc, nth)"""


@query(f"WITH {CLAUSES} SELECT doc, CAST(nth AS INTEGER) AS \"order\", clause_id, title AS clause_title, CAST(level AS INTEGER) AS level, breadcrumb FROM crumbs")
def breadcrumbs(spark, sf_dir):
    return tree.clauses(i.styled_rows(spark, sf_dir)).select("doc", "order", "clause_id", "clause_title", "level", "breadcrumb")


@query(f"WITH {CLAUSES} SELECT doc, CAST(nth AS INTEGER) AS \"order\", n_blocks, types, md5(body) AS body_md5 FROM bodies")
def merged_blocks(spark, sf_dir):
    rows = tree.clauses(i.styled_rows(spark, sf_dir)).where(F.size("blocks") > 0)
    return rows.select("doc", "order", F.size("blocks").alias("n_blocks"), F.array_join("blocks.type", ",").alias("types"), F.md5(F.col("full_text").cast("binary")).alias("body_md5"))


@query(f"""WITH {CLAUSES} SELECT doc, CAST(nth AS INTEGER) AS "order", doc || '::' || clause_id || CASE WHEN n > 1 THEN '#' || CAST(n AS VARCHAR) ELSE '' END AS clause_uid
 FROM (SELECT c.*, row_number() OVER (PARTITION BY c.doc, clause_id ORDER BY c.nth) AS n FROM crumbs AS c JOIN bodies AS b ON b.doc = c.doc AND b.nth = c.nth WHERE title <> 'Title 0') AS k""")
def useful_clause_uids(spark, sf_dir):
    rows = tree.keep_useful(tree.clauses(i.styled_rows(spark, sf_dir)).where("clause_title <> 'Title 0'"))
    return tree.with_uids(rows).select("doc", "order", "clause_uid")


@query(f"SELECT doc_id, count(*) AS n_units, sum(len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+'))) AS tokens, max(len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+'))) AS most FROM ({i.LINES_SQL}) AS l GROUP BY doc_id")
def lines_to_units(spark, sf_dir):
    blocks = F.array(F.struct(F.lit("prose").alias("type"), "text"))
    rows = chunking.with_units(i.table(spark, sf_dir, "documents").select("doc_id", blocks.alias("blocks"))).where(F.size("units") > 0)
    tokens = F.col("units.tokens")
    return rows.select("doc_id", F.size("units").alias("n_units"), F.aggregate(tokens, F.lit(0).cast("long"), lambda a, x: a + x).alias("tokens"), F.array_max(tokens).alias("most"))


PACK = f"""WITH RECURSIVE u AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i FROM ({i.NESTED_SQL}) AS n),
fold AS (SELECT doc_id, i, pos, CAST(tokens AS BIGINT) AS tok, 0 AS piece FROM u WHERE i = 1 UNION ALL
 SELECT u.doc_id, u.i, u.pos, CASE WHEN f.tok + u.tokens > 200 THEN u.tokens ELSE f.tok + u.tokens END, CASE WHEN f.tok + u.tokens > 200 THEN f.piece + 1 ELSE f.piece END
 FROM fold AS f JOIN u ON u.doc_id = f.doc_id AND u.i = f.i + 1)"""


@query(f"{PACK} SELECT doc_id, piece, count(*) AS n_units, min(pos) AS first_pos, max(pos) AS last_pos FROM fold GROUP BY doc_id, piece")
def greedy_pack(spark, sf_dir):
    units = i.nested_units(spark, sf_dir).withColumn("ancestors", F.array().cast("array<int>"))
    rows = chunking.pack(units, ["doc_id"], target=200).where("role = 'body'")
    return rows.groupBy("doc_id", "piece").agg(F.count("*").alias("n_units"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))


@query(f"""{PACK}, b AS (SELECT f.*, tokens, atomic, sum(tokens) OVER w AS back, bool_or(atomic) OVER w AS hard, max(piece) OVER (PARTITION BY f.doc_id) AS last FROM fold AS f JOIN u USING (doc_id, i)
 WINDOW w AS (PARTITION BY f.doc_id, piece ORDER BY i DESC ROWS UNBOUNDED PRECEDING)) SELECT doc_id, piece + 1 AS piece, count(*) AS n_carried FROM b WHERE back <= 40 AND NOT hard AND piece < last GROUP BY ALL""")
def overlap_tail(spark, sf_dir):
    units = i.nested_units(spark, sf_dir).withColumn("ancestors", F.array().cast("array<int>"))
    return chunking.pack(units, ["doc_id"], target=200, overlap=40).where("role = 'overlap'").groupBy("doc_id", "piece").agg(F.count("*").alias("n_carried"))


NESTED = f"""n AS ({i.NESTED_SQL}), nx AS (SELECT *, (SELECT arg_min(m.depth, m.pos) FROM n AS m WHERE m.doc_id = n.doc_id AND m.pos > n.pos AND m.depth IS NOT NULL) AS next_depth FROM n),
c AS (SELECT *, depth IS NULL AND NOT goes_on AND coalesce(next_depth, 1) = 1 AS closes FROM nx),
spans AS (SELECT a.doc_id, a.pos, a.depth, coalesce(min(b.pos), 1000000000) AS until FROM c AS a LEFT JOIN c AS b ON b.doc_id = a.doc_id AND b.pos > a.pos AND (b.depth <= a.depth OR b.closes) WHERE a.depth IS NOT NULL GROUP BY ALL),
anc AS (SELECT c.doc_id, c.pos, a.pos AS up FROM c JOIN spans AS a ON a.doc_id = c.doc_id AND a.pos < c.pos AND c.pos < a.until AND (c.depth IS NULL OR a.depth < c.depth) WHERE NOT c.closes)"""


@query(f"WITH {NESTED} SELECT doc_id, pos, up FROM anc")
def enclosing_lines(spark, sf_dir):
    return chunking.with_ancestors(i.nested_units(spark, sf_dir), ["doc_id"]).select("doc_id", "pos", F.explode("ancestors").alias("up"))


def nested_chunks(spark, sf_dir):
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n")
    return i.nested_units(spark, sf_dir).groupBy(F.col("doc_id").alias("chunk_id")).agg(texts.alias("text"))


SEEN = f"n AS ({i.NESTED_SQL}), d AS (SELECT *, min(depth) OVER w AS least, list(depth) OVER w AS seen FROM n WHERE depth IS NOT NULL WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"


@query(f"WITH {SEEN} SELECT doc_id AS chunk_id, CAST(depth AS INTEGER) AS depth, substr(text, 1, 100) AS line FROM d WHERE depth > 1 AND (least IS NULL OR least >= depth)")
def orphan_lines(spark, sf_dir):
    return chunking.orphans(nested_chunks(spark, sf_dir))


@query(f"WITH {SEEN} SELECT count(*) AS n_skips FROM d WHERE depth > 1 AND least < depth AND NOT list_contains(seen, depth - 1)")
def level_skips(spark, sf_dir):
    return chunking.level_skips(nested_chunks(spark, sf_dir))


#: The stack of a document as a list of structs; clauses of no unit never come in.
MERGED = f"""WITH RECURSIVE {CLAUSES},
sizes AS (SELECT c.doc, c.nth, level, len(regexp_extract_all(body, '[^ \\t\\n\\x0B\\f\\r]+')) AS tokens, row_number() OVER (PARTITION BY c.doc ORDER BY c.nth) AS i
 FROM crumbs AS c JOIN bodies AS b ON b.doc = c.doc AND b.nth = c.nth),
fold AS (SELECT doc, i, nth, nth AS into_, [{{'lv': level, 'tok': tokens, 'at': nth}}] AS stack FROM sizes WHERE i = 1 UNION ALL
 SELECT doc, i, nth, CASE WHEN fits THEN open[-1].at ELSE nth END, CASE WHEN fits THEN list_concat(open[:-2], [{{'lv': open[-1].lv, 'tok': open[-1].tok + tokens, 'at': open[-1].at}}])
  ELSE list_append(open, {{'lv': level, 'tok': tokens, 'at': nth}}) END FROM (
  SELECT *, len(open) > 0 AND tokens < 80 AND coalesce(open[-1].tok, 0) + tokens <= 1000 AS fits FROM (
   SELECT s.*, list_filter(f.stack, lambda x: x.lv < s.level) AS open FROM fold AS f JOIN sizes AS s ON s.doc = f.doc AND s.i = f.i + 1) AS o) AS t)"""


@query(f"{MERGED} SELECT doc, CAST(nth AS INTEGER) AS \"order\", CAST(into_ AS INTEGER) AS \"into\" FROM fold")
def merged_up(spark, sf_dir):
    rows = tree.keep_useful(tree.clauses(i.styled_rows(spark, sf_dir)))
    return chunking.merge_up(chunking.with_units(rows))


@query()
def chunked_clauses(spark, sf_dir):
    rows = tree.with_uids(tree.keep_useful(tree.clauses(i.styled_rows(spark, sf_dir))))
    rows = rows.select("*", F.col("doc").alias("spec"), F.col("doc").alias("spec_id"), F.lit("18.1.0").alias("version"), F.lit(18).alias("release"))
    return chunking.chunk(rows).select("chunk_id", "part", "n_parts", "token_count", "has_normative", F.md5(F.col("embed_text").cast("binary")).alias("embed_md5"))


@query("""SELECT lang, count(*) AS n, min(n_chars) AS min, max(n_chars) AS max, list_sort(list(n_chars))[greatest(0, CAST(floor(count(*) * 0.05) AS BIGINT) - 1) + 1] AS p05,
 list_sort(list(n_chars))[CAST(floor(count(*) * 0.5) AS BIGINT) + 1] AS median, list_sort(list(n_chars))[least(count(*) - 1, CAST(floor(count(*) * 0.95) AS BIGINT)) + 1] AS p95 FROM documents GROUP BY lang""")
def index_percentiles(spark, sf_dir):
    return chunking.index_percentiles(i.table(spark, sf_dir, "documents"), "n_chars", {"p05": (0.05, -1), "median": (0.5, 0), "p95": (0.95, 0)}, ["lang"])


@query("SELECT md5(text) AS chunk_id, count(*) AS \"count\" FROM documents GROUP BY md5(text) HAVING count(*) > 1")
def duplicate_texts(spark, sf_dir):
    return chunking.duplicate_ids(i.table(spark, sf_dir, "documents").select(F.md5(F.col("text").cast("binary")).alias("chunk_id")))


@query("SELECT count(*) AS n_over, max(n_chars) AS worst_tokens, max_by(doc_id, n_chars * 1000000000 + doc_id) AS worst_chunk FROM documents WHERE n_chars > 4000")
def oversize_report(spark, sf_dir):
    return chunking.oversize(i.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("n_chars").alias("token_count")), 4000)


@query("SELECT doc_id, place FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS place, count(*) OVER () // 25 AS step FROM documents) AS r WHERE place % step = 0 AND place < step * 25")
def systematic_sample(spark, sf_dir):
    return chunking.systematic_sample(i.table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], 25)


# Answers and verdicts

VALID = f"""a AS ({i.ANSWERS_SQL}), g AS (SELECT *, list_filter(passages, lambda p: p BETWEEN 1 AND 6) AS good, list_filter(passages, lambda p: p < 1 OR p > 6) AS bad FROM a)"""


@query(f"WITH {VALID} SELECT qid, idx, good AS passages, list_transform(good, lambda p: 'doc ' || CAST(qid AS VARCHAR) || ', clause ' || CAST(p AS VARCHAR)) AS citations FROM g")
def claim_validation(spark, sf_dir):
    rows = answers.validate(i.answers(spark, sf_dir)).select("qid", F.posexplode("claims").alias("idx", "c"))
    return rows.select("qid", "idx", "c.passages", "c.citations")


@query(f"""WITH {VALID}, q AS (SELECT qid, list_sort(list_distinct(flatten(list(bad)))) AS invalid_citations, bool_and(len(good) = 0) AS uncited FROM g GROUP BY qid)
SELECT doc_id AS qid, coalesce(invalid_citations, []) AS invalid_citations, doc_id % 7 = 0 OR coalesce(uncited, false) AS refused FROM documents LEFT JOIN q ON q.qid = doc_id""")
def refusal_decision(spark, sf_dir):
    return answers.validate(i.answers(spark, sf_dir)).select("qid", "invalid_citations", "refused")


CLAIMS = f"""j AS ({i.JUDGED_SQL}), e AS (SELECT qid, idx, judge, round(max(score), 4) AS score, bool_and(contradicted) AS contradicted FROM j GROUP BY ALL),
claims AS (SELECT DISTINCT CAST(l_orderkey AS BIGINT) AS qid, CAST(l_linenumber AS INTEGER) AS idx FROM lineitem),
s AS (SELECT claims.qid, claims.idx, coalesce(min(score), 0) AS score, coalesce(bool_or(contradicted), false) AS contradicted FROM claims LEFT JOIN e ON e.qid = claims.qid AND e.idx = claims.idx GROUP BY ALL)"""
VERDICTS = f"""{CLAIMS}, v AS (SELECT qid, avg(score) AS mean, bool_or(contradicted) AS contradicted, avg(score) FILTER (score >= 0.6) AS kept_mean, min(score) FILTER (score >= 0.6) AS kept_min,
 coalesce(list(idx ORDER BY idx) FILTER (score >= 0.6), []) AS kept, count(*) AS n, max(idx) AS last FROM s GROUP BY qid),
verdicts AS (SELECT qid, CASE WHEN contradicted OR len(kept) = 0 THEN 'refused' WHEN len(kept) = n AND kept_min >= 0.9 THEN 'grounded' ELSE 'partial' END AS label,
 CASE WHEN contradicted OR len(kept) = 0 THEN mean ELSE kept_mean END AS score, CASE WHEN contradicted THEN [] ELSE kept END AS kept, n, last FROM v)"""


def claim_rows(spark, sf_dir):
    claims = i.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("long").alias("qid"), F.col("l_linenumber").cast("int").alias("idx")).distinct()
    return claims, verify.claim_scores(claims, i.judged(spark, sf_dir))


@query(f"WITH {CLAIMS} SELECT * FROM s")
def claim_scores(spark, sf_dir):
    return claim_rows(spark, sf_dir)[1]


@query(f"WITH {VERDICTS} SELECT qid, label, round(score, 6) AS score, kept FROM verdicts")
def verdicts(spark, sf_dir):
    claims, scored = claim_rows(spark, sf_dir)
    return verify.verdicts(claims.select("qid").distinct(), scored).select("qid", "label", F.round("score", 6).alias("score"), "kept")


@query(f"WITH {VERDICTS} SELECT qid, label = 'refused' AS refused, CASE label WHEN 'refused' THEN 0 WHEN 'partial' THEN len(kept) ELSE last END AS n_claims FROM verdicts")
def applied_verdicts(spark, sf_dir):
    claims, scored = claim_rows(spark, sf_dir)
    # Claims are numbered from 1 here and from 0 inside an answer.
    shifted = scored.withColumn("idx", F.col("idx") - 1)
    rows = claims.groupBy("qid").agg(F.transform(F.sequence(F.lit(1), F.max("idx")), lambda k: F.struct(k.cast("string").alias("text"))).alias("claims")).withColumn("text", F.lit("prose"))
    return verify.apply_verdicts(rows, verify.verdicts(rows, shifted)).select("qid", "refused", F.size("claims").alias("n_claims"))


# Evaluation

RELEVANT = f"""{DENSE.format('', 20)}, hits AS (SELECT 'dense' AS arm, d.qid, d.chunk_id, d.rank, CASE WHEN v.label = q.label AND d.chunk_id % 10 < 7 THEN 1 ELSE 0 END AS rel
 FROM dense AS d JOIN embeddings AS v ON v.vec_id = d.chunk_id JOIN embeddings AS q ON q.vec_id = d.qid * 100 UNION ALL
 SELECT 'reversed', d.qid, d.chunk_id, 21 - d.rank, CASE WHEN v.label = q.label AND d.chunk_id % 10 < 7 THEN 1 ELSE 0 END
 FROM dense AS d JOIN embeddings AS v ON v.vec_id = d.chunk_id JOIN embeddings AS q ON q.vec_id = d.qid * 100)"""
METRICS = """SELECT arm, qid, CASE WHEN max(rel) = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS recall, coalesce(1.0::DOUBLE / min(CASE WHEN rel = 1 THEN rank END), 0.0::DOUBLE) AS mrr,
 CASE WHEN sum(rel) > 0 THEN round(sum(rel / log2(rank + 1)) / list_sum(list_transform(range(1, CAST(sum(rel) AS BIGINT) + 1), lambda x: 1 / log2(x + 1))), 6) ELSE 0.0::DOUBLE END AS ndcg FROM hits WHERE rank <= {0} GROUP BY arm, qid"""


def relevant(spark, sf_dir):
    """Clause 5.n holds clause 5 for n below 7; 50.n doesn't."""
    e = i.table(spark, sf_dir, "embeddings").select(F.col("vec_id"), F.col("label").cast("string").alias("label"))
    clause = F.when(F.col("chunk_id") % 10 < 7, F.concat(F.lit("5."), (F.col("chunk_id") % 10).cast("string"))).otherwise(F.lit("50.1"))
    rows = dense(spark, sf_dir, 20).withColumn("clause_id", clause)
    rows = rows.join(e.select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("spec")), "chunk_id")
    asked = e.where("vec_id % 100 = 0").select(F.expr("vec_id div 100").alias("qid"), F.array(F.struct(F.col("label").alias("spec"), F.lit("5").alias("clause"))).alias("gold"))
    rows = rows.join(asked, "qid")
    rel = evaluate.is_relevant(F.col("spec"), F.col("clause_id"), F.array().cast("array<string>"), F.col("gold")).cast("int")
    rows = rows.select(F.lit("dense").alias("arm"), "qid", "chunk_id", "rank", rel.alias("rel"))
    return rows.unionByName(rows.withColumn("arm", F.lit("reversed")).withColumn("rank", 21 - F.col("rank")))


@query(f"WITH {RELEVANT} SELECT * FROM hits")
def relevance(spark, sf_dir):
    return relevant(spark, sf_dir)


@query(f"WITH {RELEVANT} {METRICS.format(6)}")
def rank_metrics(spark, sf_dir):
    hits = relevant(spark, sf_dir)
    return evaluate.rank_metrics(hits, hits, 6, ["arm", "qid"])


@query(f"WITH {RELEVANT} SELECT arm, k, round(avg(recall), 9) AS recall, round(avg(mrr), 9) AS mrr, round(avg(ndcg), 9) AS ndcg FROM (SELECT 6 AS k, * FROM ({METRICS.format(6)}) AS m UNION ALL SELECT 20, * FROM ({METRICS.format(20)}) AS n) AS b GROUP BY arm, k")
def ablation_by_arm(spark, sf_dir):
    hits = relevant(spark, sf_dir)
    return evaluate.retrieval_ablation(hits, hits.select("qid").distinct())


ARMS = """SELECT arm, qid, answerable, CASE WHEN arm <> 'C' AND top_score < 0.3 THEN 'gate' WHEN qid % 11 = 0 THEN 'generation' WHEN arm = 'E' AND qid % 3 = 0 THEN 'verification' ELSE 'answered' END AS stage,
 qid % 4 <> 0 AS gold_cited, CASE WHEN arm = 'E' THEN top_score END AS faithfulness FROM ({0}) AS g, unnest(['C', 'D', 'E']) AS u(arm)"""


@query(f"""SELECT arm, coalesce(round(count(*) FILTER (stage = 'answered' AND NOT answerable)::DOUBLE / nullif(count(*) FILTER (NOT answerable), 0), 6), 0) AS hallucination_rate,
 coalesce(round(count(*) FILTER (stage = 'answered' AND answerable)::DOUBLE / nullif(count(*) FILTER (answerable), 0), 6), 0) AS coverage,
 coalesce(round(count(*) FILTER (stage = 'answered' AND answerable AND gold_cited)::DOUBLE / nullif(count(*) FILTER (stage = 'answered' AND answerable), 0), 6), 0) AS gold_citation_rate,
 round(avg(faithfulness) FILTER (stage = 'answered'), 6) AS faithfulness, count(*) FILTER (stage = 'gate') AS refused_by_gate, count(*) FILTER (stage = 'generation') AS refused_by_generation,
 count(*) FILTER (stage = 'verification') AS refused_by_verification FROM ({ARMS.format(i.GATE_SQL)}) AS d GROUP BY arm""")
def answer_ablation(spark, sf_dir):
    rows = i.gate_scores(spark, sf_dir).withColumn("arm", F.explode(F.array(*map(F.lit, "CDE"))))
    stage = verify.stage((F.col("arm") != "C") & (F.col("top_score") < 0.3), F.col("qid") % 11 == 0, (F.col("arm") == "E") & (F.col("qid") % 3 == 0))
    rows = rows.select("arm", "qid", "answerable", stage.alias("stage"), (F.col("qid") % 4 != 0).alias("gold_cited"), F.when(F.col("arm") == "E", F.col("top_score")).alias("faithfulness"))
    return evaluate.answer_ablation(rows)


SWEEP = f"""g AS ({i.GATE_SQL}), n AS (SELECT count(*) FILTER (answerable) AS yes, count(*) FILTER (NOT answerable) AS no FROM g), t AS (SELECT DISTINCT round(top_score, 4) AS threshold FROM g),
r AS (SELECT threshold, count(*) FILTER (answerable AND top_score < threshold) AS fr, count(*) FILTER (NOT answerable AND top_score < threshold) AS cr FROM t, g GROUP BY threshold),
sweep AS (SELECT threshold, fr / yes AS false_refusal_rate, cr / no AS correct_refusal_rate, no - cr AS answered_unanswerable, fr AS refused_answerable, cr / no - fr / yes AS youden_j FROM r, n)"""


@query(f"WITH {SWEEP} SELECT * FROM sweep")
def threshold_sweep(spark, sf_dir):
    return evaluate.sweep(i.gate_scores(spark, sf_dir))


@query(f"""WITH {SWEEP} SELECT (SELECT threshold FROM sweep WHERE false_refusal_rate <= 0.1 ORDER BY correct_refusal_rate DESC, threshold LIMIT 1) AS chosen,
 (SELECT threshold FROM sweep ORDER BY youden_j DESC, threshold LIMIT 1) AS youden_optimum""")
def chosen_threshold(spark, sf_dir):
    return evaluate.choose(evaluate.sweep(i.gate_scores(spark, sf_dir)))


@query(f"""SELECT answerable, count(*) AS n, min(top_score) AS min, max(top_score) AS max, list_sort(list(top_score))[greatest(0, CAST(floor(count(*) * 0.05) AS BIGINT) - 1) + 1] AS p05,
 list_sort(list(top_score))[CAST(floor(count(*) * 0.5) AS BIGINT) + 1] AS median, list_sort(list(top_score))[least(count(*) - 1, CAST(floor(count(*) * 0.95) AS BIGINT)) + 1] AS p95 FROM ({i.GATE_SQL}) AS g GROUP BY answerable""")
def score_distribution(spark, sf_dir):
    return evaluate.distribution(i.gate_scores(spark, sf_dir))


@query(f"""WITH g AS ({i.GATE_SQL}), s AS (SELECT min(top_score) - pad AS lo, (max(top_score) - min(top_score) + 2 * pad) / 24 AS width FROM g, (SELECT (max(top_score) - min(top_score)) * 0.02::DOUBLE AS pad FROM g) AS p GROUP BY pad)
SELECT CAST(floor((top_score - lo) / width) AS INTEGER) AS bin, round(any_value(lo + floor((top_score - lo) / width) * width), 9) AS low, count(*) FILTER (answerable) AS answerable, count(*) FILTER (NOT answerable) AS unanswerable FROM g, s GROUP BY 1""")
def score_histogram(spark, sf_dir):
    return evaluate.histogram(i.gate_scores(spark, sf_dir))
