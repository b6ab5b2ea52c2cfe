"""Documents to packed training sequences: classifier, near duplicates, decontamination, secrets, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from georeport.llm import leaks, near, packing, quality, secrets
from georeport.operators.common import written


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good ones; it learns from the labels of the documents at hand."""
    model = quality.train_on_labels(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality.score(docs, model, keep=tuple(docs.columns), name="__score")
    return scored.where(F.col("__score") >= 0.7).select(*docs.columns)


def keep_one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: five-word shingles, similarity of 0.8 or more.

    Rows are told apart by a number of their own, so null and repeated ids are like any others. Of a group the least id
    stays (null last, then by the hash of the row); rows without words all stay.
    """
    rows = written(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
    found = near.linked_classes(rows, near.Settings(width=5), doc_id="__row").select("id", "component_id")
    order = rows.select("__row", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64(*docs.columns).alias("hash"), "__row").alias("order"))
    first = found.join(order, found["id"] == order["__row"]).groupBy("component_id").agg(F.min("order").alias("least"))
    kept = written(first.select(F.col("least.__row").alias("__row")), "kept")
    return rows.join(kept, "__row", "left_semi").select(*docs.columns)


def drop_leaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a ten-word window of a benchmark item."""
    found = leaks.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("contaminated").select("row_id", "row_hash")
    return docs.join(found, docs["doc_id"].eqNullSafe(found["row_id"]) & (F.xxhash64(docs["text"]) == found["row_hash"]), "left_anti")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked, length counted anew."""
    masked = secrets.redacted(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else masked


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their place in sequences of 4096 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality classifier", keep_good), ("near duplicates", keep_one_of_near), ("decontamination", drop_leaked), ("secrets", mask_secrets), ("packing", pack)]

# A trained model and a tokenizer decide: tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
