"""Short labels of review nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from georeport.functions.keys import strip
from georeport.functions.labels import snippet
from georeport.operators.lookup import resolve_anchors


def anchor_marks(contexts: DataFrame, directions: DataFrame, locales: DataFrame, keys: list[str]) -> DataFrame:
    """Mark of direction and proximity contexts: single anchor, several, or none.

    Anchors are looked up once per text, so a name with many places does not multiply with its contexts.
    """
    asked = contexts.filter(F.col("kind").isin("direction", "proximity")).select(*keys, "text")
    anchors = resolve_anchors(asked.select("text").distinct(), directions, locales).groupBy("text").agg(F.count("cid").alias("_of"))
    found = asked.join(anchors, asked["text"].eqNullSafe(anchors["text"])).groupBy(*keys).agg(F.sum("_of").alias("_n"))
    mark = F.when(F.col("_n") == 0, " (?)").when(F.col("_n") == 1, " ✓").otherwise(" (~)")
    return contexts.join(found, keys, "left").withColumn("mark", F.when(F.col("_n").isNull(), "").otherwise(mark)).drop("_n")


def context_labels(contexts: DataFrame, keys: list[str]) -> DataFrame:
    """``[Kind: text mark; ...]`` per owner, in order. Contexts: kind, text, ord, mark."""
    part = F.concat(F.initcap("kind"), F.lit(": "), "text", F.coalesce("mark", F.lit("")))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("ord", part.alias("p")))), lambda x: x["p"])
    return contexts.groupBy(*keys).agg(F.concat(F.lit("["), F.array_join(parts, "; "), F.lit("]")).alias("ctx_label"))


def _with_label(*parts: Column) -> Column:
    return strip(F.concat_ws(" ", *(F.coalesce(p, F.lit("")) for p in parts)))


def post_summary(posts: DataFrame) -> DataFrame:
    """``posts``: post_id, text, ctx_label."""
    return posts.withColumn("snippet", snippet(F.col("text"), 1000)).withColumn(
        "summary", _with_label(F.concat(F.lit("Post "), F.col("post_id").cast("string")), F.col("ctx_label")))


def section_summary(sections: DataFrame) -> DataFrame:
    return sections.withColumn("snippet", snippet(F.col("text"), 300)).withColumn(
        "summary", _with_label(F.concat(F.lit("Section "), "section_id"), F.col("ctx_label")))


def _tagged(kind: str, text: str) -> Column:
    joined = F.concat(F.coalesce(kind, F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.nullif(F.trim(joined, F.lit(":")), F.lit(""))


def event_summary(events: DataFrame) -> DataFrame:
    core = F.concat_ws(" | ", _tagged("actor_kind", "actor_text"), _tagged("action_kind", "action_text"))
    return events.withColumn("snippet", snippet(F.col("text"), 250)).withColumn("summary", _with_label(core, F.col("ctx_label")))


def location_summary(locations: DataFrame) -> DataFrame:
    """``locations``: text, candidate_texts (first four are enough), ctx_label."""
    some = F.coalesce("candidate_texts", F.array().cast("array<string>"))
    shown = F.concat(F.array_join(F.slice(some, 1, 3), ", "), F.when(F.size(some) > 3, ", …").otherwise(""))
    cands = F.when(F.size(some) > 0, F.concat(F.lit("("), shown, F.lit(")"))).otherwise("")
    return locations.withColumn("snippet", snippet(F.col("text"), 200)).withColumn("summary", _with_label(F.col("text"), cands, F.col("ctx_label")))
