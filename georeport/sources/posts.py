"""Channel settings and posts as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from georeport.functions.labels import utc_iso

CHANNEL_SCHEMA = "channel_name string, alias string, channel_lang string, active boolean"
MESSAGE_SCHEMA = "channel string, post_id long, published_at timestamp, message string, raw_text string"
POST_SCHEMA = ("source string, channel string, alias string, channel_lang string, post_id long, "
               "published_at timestamp, fetched_at timestamp, raw_text string, text string")


def channel_defaults(rows: DataFrame) -> DataFrame:
    return rows.select("channel_name", F.coalesce("alias", "channel_name").alias("alias"),
                       F.coalesce("channel_lang", F.lit("en")).alias("channel_lang"), F.coalesce("active", F.lit(False)).alias("active"))


def active_channels(rows: DataFrame, fallback: DataFrame) -> DataFrame:
    """Active channels of the settings; those of the fallback list only when there are none."""
    mine = channel_defaults(rows).filter("active")
    some = mine.limit(1).select(F.lit(True).alias("_some"))
    spare = channel_defaults(fallback).filter("active").join(F.broadcast(some), F.lit(True), "left_anti")
    return mine.unionByName(spare)


def read_channels(spark: SparkSession, path: str, fallback: DataFrame) -> DataFrame:
    return active_channels(spark.read.schema(CHANNEL_SCHEMA).json(path), fallback)


def read_posts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(POST_SCHEMA).json(path)


def post_records(posts: DataFrame) -> DataFrame:
    """Posts as written: times as UTC text, and the day that names the folder."""
    return (posts.withColumn("published_at", utc_iso(F.col("published_at"))).withColumn("fetched_at", utc_iso(F.col("fetched_at")))
            .withColumn("dt", F.left("published_at", F.lit(10))))


def write_posts(posts: DataFrame, path: str) -> None:
    post_records(posts).write.mode("append").partitionBy("dt").json(path)


def write_batch(posts: DataFrame, path: str, batch: str) -> None:
    """Posts by day and batch. A batch that is written again replaces what it wrote before."""
    rows = post_records(posts).withColumn("batch", F.lit(batch))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dt", "batch").json(path)
