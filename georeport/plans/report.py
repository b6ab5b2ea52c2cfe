"""From selected posts of many channels to located mentions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from georeport.operators.common import written
from georeport.params import Params
from georeport.plans.resolve import Gazetteer, resolve_mentions
from georeport.plans.text import TextTables, analyse_posts


@dataclass(frozen=True)
class Report:
    """Tables of one run. ``post_id`` in all of them is the post's key; ``posts`` has it beside source, channel and number."""

    posts: DataFrame
    text: TextTables
    mentions: DataFrame
    chosen: DataFrame


def post_key() -> Column:
    """A message number is unique within its channel only."""
    return F.concat_ws("/", "source", "channel", F.col("post_id").cast("string"))


def keyed_posts(posts: DataFrame) -> DataFrame:
    """Posts with ``post_key``, written; a key that occurs twice is an error."""
    rows = written(posts.withColumn("post_key", post_key()), "posts")
    twice = rows.groupBy("post_key").agg(F.count("*").alias("n")).where("n > 1").select("post_key").first()
    if twice:
        raise ValueError(f"post {twice[0]} occurs more than once")
    return rows


def report(posts: DataFrame, patterns: DataFrame, gaz: Gazetteer, segments: DataFrame, params: Params = Params(), partitions: int | None = None) -> Report:
    """``posts``: source, channel, post_id, text, as ``intake.select_posts`` and the stream make them."""
    rows = keyed_posts(posts)
    text = analyse_posts(rows.select(F.col("post_key").alias("post_id"), "text"), patterns, params, partitions)
    mentions, chosen = resolve_mentions(text.mentions, text.events, text.contexts, gaz, segments, params)
    return Report(rows, text, mentions, chosen)
