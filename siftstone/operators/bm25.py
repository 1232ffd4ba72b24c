"""Sparse index as three tables and BM25 search, batched over questions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftstone.functions.text import tokenize

# Fixed values of the scoring formula.
K1 = 1.5
B = 0.75
#: Terms of questions that are broadcast at most, and terms that are also written into the scan of an index.
BROADCAST_TERMS = 100_000
SCANNED_TERMS = 500


@dataclass
class SparseIndex:
    """postings(term, chunk_id, tf, dl), terms(term, df, idf) and a row of (n, avgdl)."""

    postings: DataFrame
    terms: DataFrame
    totals: DataFrame

    def save(self, path: str) -> None:
        """Tables sorted by term over ranges of (term, chunk_id): a search reads the row groups of its terms, and a term
        of many chunks lies in several files. Statistics come from the postings as written."""
        spark = self.postings.sparkSession
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.totals.write.mode("overwrite").parquet(f"{path}/totals")
        rows = self.postings.repartitionByRange(n, "term", "chunk_id").sortWithinPartitions("term", "chunk_id")
        rows.write.mode("overwrite").parquet(f"{path}/postings")
        terms = term_stats(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/totals"))
        terms.repartitionByRange(n, "term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/terms")

    @classmethod
    def load(cls, spark, path: str) -> SparseIndex:
        return cls(*(spark.read.parquet(f"{path}/{name}") for name in ("postings", "terms", "totals")))


def tokenized(chunks: DataFrame, id_column: str = "chunk_id", text: str = "embed_text") -> DataFrame:
    return chunks.select(F.col(id_column).alias("chunk_id"), tokenize(F.col(text)).alias("tokens"))


def build_index(chunks: DataFrame, id_column: str = "chunk_id", text: str = "embed_text") -> SparseIndex:
    """One pass and one shuffle on (term, chunk): the length of a document rides along with its tokens."""
    rows = tokenized(chunks, id_column, text).select("chunk_id", F.size("tokens").alias("dl"), "tokens")
    totals = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl") / F.count("*"), F.lit(0.0)).alias("avgdl"))
    postings = (
        rows.select("chunk_id", "dl", F.explode("tokens").alias("term"))
        .groupBy("term", "chunk_id")
        .agg(F.count("*").cast("int").alias("tf"), F.first("dl").alias("dl"))
    )
    return SparseIndex(postings, term_stats(postings, totals), totals)


def term_stats(postings: DataFrame, totals: DataFrame) -> DataFrame:
    """Terms with df and ln(1 + (n - df + 0.5) / (df + 0.5)). totals is one row."""
    return (
        postings.groupBy("term")
        .agg(F.count("*").alias("df"))
        .crossJoin(F.broadcast(totals.select("n")))
        .select("term", "df", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    )


def query_terms(questions: DataFrame, qid: str = "qid", question: str = "question") -> DataFrame:
    """(qid, term, qtf): a question's terms with multiplicity."""
    return (
        questions.select(F.col(qid).alias("qid"), F.explode(tokenize(F.col(question))).alias("term"))
        .groupBy("qid", "term")
        .agg(F.count("*").alias("qtf"))
    )


def scores(index: SparseIndex, terms: DataFrame) -> DataFrame:
    """(qid, chunk_id, score, matched) for chunks that share a term; rounded to 6 places so that ties are ties.
    matched counts the question's distinct terms that the chunk has.

    Only what questions ask for is shuffled: their terms go to the index, as a broadcast up to a checked size.
    """
    postings, known = index.postings, index.terms
    asked = terms.select("term").distinct().limit(SCANNED_TERMS + 1).collect()
    if len(asked) <= SCANNED_TERMS:
        named = F.col("term").isin(*(r.term for r in asked)) if asked else F.lit(False)
        postings, known = postings.where(named), known.where(named)
    few = len(asked) <= SCANNED_TERMS or terms.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    sent = F.broadcast if few else lambda df: df
    weighted = known.join(sent(terms), "term")
    weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return (
        postings.join(sent(weighted), "term")
        .crossJoin(F.broadcast(index.totals.select("avgdl")))
        .groupBy("qid", "chunk_id")
        .agg(F.round(F.sum(F.col("qtf") * F.col("idf") * weight), 6).alias("score"), F.count("*").alias("matched"))
    )


def top_k(scored: DataFrame, k: int, by: str = "score") -> DataFrame:
    """The k best rows of each question, ranked from 1; equal scores by chunk_id."""
    order = Window.partitionBy("qid").orderBy(F.col(by).desc(), F.col("chunk_id").asc())
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(index: SparseIndex, questions: DataFrame, k: int = 30, qid: str = "qid", question: str = "question") -> DataFrame:
    return top_k(scores(index, query_terms(questions, qid, question)), k)
