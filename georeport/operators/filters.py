"""Post filters of the intake, and small table predicates."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from georeport.functions.geo import encode_cid
from georeport.functions.keys import strip

# Phrases that mark a report, and words that mark other posts of a channel.
PHRASES = (
    "Operational information as of",
    "on progress of special military operation as of",
    "Оперативна інформація станом на",
    "Coordinates:",
)
TRAINING_TAGS = ("#підготовказсу", "#підготовказсу2025")
TRAINING_WORDS = (
    "щодня вдосконалюють свої навички",
    "навички та вміння",
    "підготовка",
    "тренування",
    "як діяти в «урбані»",
    'як діяти в "урбані"',
    "як врятувати побратима",
    "відділення комунікацій",
    "пресслужба",
    "прес-служба",
)
RECRUITING_WORDS = ("приєднуйтесь до сил оборони", "разом переможемо", "слава україні")
BLACKLIST = RECRUITING_WORDS + TRAINING_WORDS + TRAINING_TAGS


def contains_any(text: Column, phrases: Sequence[str]) -> Column:
    """Case-insensitive; empty text holds nothing."""
    low = F.lower(F.coalesce(text, F.lit("")))
    hits = [low.contains(p.lower()) for p in phrases]
    return (low != "") & reduce(lambda a, b: a | b, hits, F.lit(False))


def day_window(ts: Column, start: dt.date | str, end: dt.date | str | None = None) -> Column:
    """Whole UTC days from start to end (both included); null times are outside."""
    def day(d: dt.date | str) -> dt.date:
        return d if isinstance(d, dt.date) else dt.date.fromisoformat(d)

    first = day(start)
    last = day(end) if end is not None else first
    if last < first:
        raise ValueError("end must not be before start")

    def micros(d: dt.date) -> Column:
        return F.timestamp_micros(F.lit((d - dt.date(1970, 1, 1)).days * 86_400_000_000))

    return F.coalesce((ts >= micros(first)) & (ts < micros(last + dt.timedelta(days=1))), F.lit(False))


def message_text(message: Column, raw: Column) -> Column:
    return strip(F.coalesce(F.nullif(message, F.lit("")), raw, F.lit("")))


def not_blacklisted(text: Column, lang: Column, words: Sequence[str] = BLACKLIST, only: str = "uk") -> Column:
    return (F.lower(lang) != only) | ~contains_any(text, words)


def route(text: Column, lang: Column, phrases: Sequence[str] = PHRASES, words: Sequence[str] = BLACKLIST,
          only: str = "uk", min_length: int = 40) -> Column:
    """English posts need a phrase; others also pass the blacklist and a minimum length."""
    english = F.lower(lang) == "en"
    return contains_any(text, phrases) & (english | (not_blacklisted(text, lang, words, only) & (F.length(text) >= min_length)))


# The box that valid coordinates lie in (lon, then lat).
BOX = (22.0, 41.0, 43.0, 53.0)


def repair_coordinates(rows: DataFrame, column: str = "coordinates") -> DataFrame:
    """Parse ``[a, b]`` as lon, lat, or swapped when only that fits the box.

    Missing or broken cells are dropped; pairs that fit neither way keep their order and
    are told by ``coord_status``.
    """
    w, e, s, n = BOX
    raw = strip(F.coalesce(F.col(column), F.lit("")))
    pair = F.from_json(raw, "array<double>")
    rows = rows.withColumn("_p", pair).filter((raw != "") & (F.size("_p") == 2)
                                              & F.get("_p", F.lit(0)).isNotNull() & F.get("_p", F.lit(1)).isNotNull())
    a, b = F.get("_p", F.lit(0)), F.get("_p", F.lit(1))
    fits = a.between(w, e) & b.between(s, n)
    swapped = ~fits & b.between(w, e) & a.between(s, n)
    return (rows.withColumn("lon", F.when(swapped, b).otherwise(a)).withColumn("lat", F.when(swapped, a).otherwise(b))
            .withColumn("coord_status", F.when(fits, "ok").when(swapped, "swapped").otherwise("outside")).drop("_p"))


def add_cid(rows: DataFrame) -> DataFrame:
    return rows.withColumn("cid", encode_cid(F.col("lat"), F.col("lon")))


def enabled_nodes(posts: DataFrame, sections: DataFrame, events: DataFrame, locations: DataFrame) -> tuple[DataFrame, ...]:
    """Nodes selected for processing; a disabled parent drops its children."""
    p = posts.filter("enabled")
    s = sections.filter("enabled").join(p.select("post_id"), "post_id", "left_semi")
    e = events.filter("enabled").join(s.select("post_id", "section_id"), ["post_id", "section_id"], "left_semi")
    x = locations.filter("enabled").join(e.select("event_id"), "event_id", "left_semi")
    return p, s, e, x


def event_mentions(direct: DataFrame, words: DataFrame, spans: DataFrame) -> DataFrame:
    """Mentions of events: spans inside the event first, then spans that an extracted word occurs in.

    ``direct``: post_id, event_id and span columns. ``words``: post_id, event_id, word_no,
    extracted_word. Each span counts once per event.
    """
    keys = ["event_id", "ts", "te", "label"]
    asked = words.filter(F.coalesce("extracted_word", F.lit("")) != "").select("post_id", "event_id", "word_no", F.lower("extracted_word").alias("_w"))
    places = spans.filter(F.col("label").isin("LOCALE", "REGION"))
    extracted = asked.join(places, "post_id").filter(F.contains(F.lower("surface"), F.col("_w")))
    both = (direct.select("post_id", *keys, "surface", F.lit(0).alias("_src"), F.lit(0).alias("word_no"))
            .unionByName(extracted.select("post_id", *keys, "surface", F.lit(1).alias("_src"), "word_no")))
    return both.groupBy("post_id", *keys).agg(F.min(F.struct("_src", "word_no", "surface")).alias("m")).select(
        "post_id", *keys, "m._src", "m.word_no", "m.surface")


def number_mentions(mentions: DataFrame) -> DataFrame:
    """``event:locN`` in order: direct mentions, then extracted ones."""
    w = W.partitionBy("event_id").orderBy("_src", "word_no", "ts", "te", "label")
    return (mentions.withColumn("loc_no", F.row_number().over(w) - 1)
            .withColumn("mention_id", F.concat("event_id", F.lit(":loc"), F.col("loc_no").cast("string"))).drop("_src", "word_no"))
