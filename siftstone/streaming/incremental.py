"""Extension: the sparse index kept up to date as chunk files arrive.

Postings of new chunks are appended; document frequencies are summed when the index is read, so that a
batch writes only what it brings. Replayed batches overwrite their own folder, which makes them idempotent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone.operators.bm25 import SparseIndex, build_index, term_stats


def follow(spark: SparkSession, source: str, schema, index_path: str, checkpoint: str, id_column: str = "chunk_id", text: str = "embed_text"):
    """A streaming query that indexes every new Parquet file of a folder; start() has been called."""

    def write(batch: DataFrame, number: int) -> None:
        built = build_index(batch, id_column, text)
        built.postings.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{index_path}/postings/batch={number}")
        batch.select(F.col(id_column)).agg(F.count("*").alias("n")).crossJoin(
            built.postings.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("tokens"))
        ).write.mode("overwrite").parquet(f"{index_path}/totals/batch={number}")

    rows = spark.readStream.schema(schema).parquet(source)
    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def load(spark: SparkSession, index_path: str) -> SparseIndex:
    postings = spark.read.parquet(f"{index_path}/postings").drop("batch")
    totals = spark.read.parquet(f"{index_path}/totals").agg(
        F.sum("n").alias("n"), F.coalesce(F.sum("tokens") / F.sum("n"), F.lit(0.0)).alias("avgdl")
    )
    return SparseIndex(postings, term_stats(postings, totals), totals)
