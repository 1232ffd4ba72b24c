"""The corpus pipeline: rules, line dedup, near-duplicates, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. All but the last return
the columns of documents as they came, whatever their names; the last returns the mix, one row per remaining
document. Intermediate tables are deleted as soon as the next stage is written.

Defined results: a document without text fails the rules; one that loses all its lines stays, empty. Of a
near-duplicate group the document with the smallest doc_id stays, of several under that id the one whose text has the
smallest hash, once; different texts under one doc_id are documents of their own here, and documents without a doc_id
come after all others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftstone.llm.common import discarding, materialize, table
from siftstone.llm.decontaminate import clean
from siftstone.llm.line_dedup import dedup_lines
from siftstone.llm.quality_rules import counted_rows, verdicts
from siftstone.llm.simhash_dedup import near_duplicates
from siftstone.llm.source_mixing import mix


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return verdicts(counted_rows(docs)).where("kept").select("__row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # Other columns travel together, so that none can clash with the operator's.
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    out = dedup_lines(docs.select("doc_id", "text", F.struct(F.lit(0).alias("__"), *others).alias("__others")))
    made = {"doc_id": F.col("doc_id"), "text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return out.select(*[made.get(c, F.col("__others")[c]).alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    of = [F.xxhash64(F.lit(seed), F.coalesce("text", F.lit(""))).alias(f"__of{seed}") for seed in (1, 2)]
    keys = F.col("doc_id").isNull().alias("__none"), F.coalesce("doc_id", F.lit(0)).alias("__id"), *of
    keyed = docs.select(*keys, F.struct("*").alias("__row"), F.col("text").alias("__text"))
    names = keyed.columns[:4]
    found = near_duplicates(keyed.select(F.struct(*names).alias("__key"), "__text"), "__key", "__text")
    first = found.where("__key = component_id").select("__key.*").distinct()
    # Rows are dealt once, by the plain columns of the key, for the join and for the choice among equal rows.
    one = F.row_number().over(Window.partitionBy(*names).orderBy(F.xxhash64("__row")))
    kept = keyed.drop("__text").join(first, names, "left_semi").withColumn("__one", one).where("__one = 1")
    return kept.select("__row.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return clean(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mixing", mixing),
]

#: SQL has no XXH64, so the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with discarding(spark):
            docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
