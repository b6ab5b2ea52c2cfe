"""Messages to posts: one filter chain for batch and stream."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from georeport.operators.filters import BLACKLIST, PHRASES, day_window, message_text, route
from georeport.params import Params


def select_posts(messages: DataFrame, channels: DataFrame, start: dt.date | str, end: dt.date | str | None = None,
                 phrases: Sequence[str] = PHRASES, words: Sequence[str] = BLACKLIST, blacklist_lang: str = "uk",
                 source: str = "telegram", params: Params = Params()) -> DataFrame:
    """Posts of active channels in the day window that pass the text filters.

    ``messages``: channel, post_id, published_at, message, raw_text. ``channels``: the
    active channels; a short list, so it is broadcast by Spark on its own statistics.
    One schema for all languages; text that still needs translation is told.
    """
    known = channels.select(F.col("channel_name").alias("channel"), "alias", "channel_lang")
    rows = messages.filter(day_window(F.col("published_at"), start, end)).withColumn("text", message_text(F.col("message"), F.col("raw_text")))
    rows = rows.filter("text <> ''").join(known, "channel")
    keep = route(F.col("text"), F.col("channel_lang"), phrases, words, blacklist_lang, params.min_translation_length)
    foreign = F.lower("channel_lang") != "en"
    return rows.filter(keep).select(
        F.lit(source).alias("source"), "channel", "alias", "channel_lang", "post_id", "published_at", F.current_timestamp().alias("fetched_at"),
        F.when(foreign, F.col("text")).alias("raw_text"), "text", foreign.alias("needs_translation"))
