"""Incremental intake: new message files become posts, each once."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from georeport.plans.intake import select_posts
from georeport.sources.posts import MESSAGE_SCHEMA, POST_SCHEMA, post_records, write_batch

KEY = ["channel", "post_id"]
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ON_DISK = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def message_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(MESSAGE_SCHEMA).option("maxFilesPerTrigger", files_per_batch).json(path)


def stream_posts(messages: DataFrame, channels: DataFrame, start, end=None, **filters) -> DataFrame:
    """Filtered posts of a message stream, repeats included."""
    return select_posts(messages, channels, start, end, **filters)


def known_posts(spark: SparkSession, path: str, days: list[str]) -> DataFrame | None:
    """Posts of these days that a folder of batches holds; other days are not read."""
    try:
        return spark.read.schema(f"{POST_SCHEMA}, dt string, batch string").json(path).filter(F.col("dt").isin(days))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def add_posts(posts: DataFrame, path: str) -> None:
    """Append the posts of a table that are not yet in a folder of batches, each (channel, post_id) once.

    A post's day never changes, so only the days at hand are read; there are no more than the calendar has.
    """
    rows = posts.dropDuplicates(KEY)
    days = [r["dt"] for r in post_records(rows).select("dt").distinct().collect()]
    known = known_posts(posts.sparkSession, path, days)
    if known is not None:
        rows = rows.join(known.select(*KEY), KEY, "left_anti")
    write_batch(rows, path, f"added-{uuid.uuid4().hex}")


def write_stream(posts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Add post records by day and batch; processes what is there and stops.

    Which posts are known is keyed state in the checkpoint folder, on disk, so a batch looks up its own keys and reads no output. Posts may
    come in any order and at any age. A batch that failed after it had written is run again from the state before it and replaces its own
    folders. The output folder belongs to the stream.
    """
    conf = posts.sparkSession.conf
    before = conf.get(_STORE, None)
    conf.set(_STORE, _ON_DISK)
    try:
        # The query keeps the settings that it starts with.
        return (posts.dropDuplicates(KEY).writeStream.foreachBatch(lambda rows, batch: write_batch(rows, path, str(batch)))
                .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    finally:
        conf.set(_STORE, before) if before else conf.unset(_STORE)
