"""Mentions to places: contexts, narrowing, axis, line distance, joint choice."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from georeport.operators import context, scoring
from georeport.operators.common import written
from georeport.operators.spatial import closest_on_lines
from georeport.params import Params


@dataclass(frozen=True)
class Gazetteer:
    locales: DataFrame
    regions: DataFrame
    groups: DataFrame
    directions: DataFrame


def event_contexts(events: DataFrame, contexts: DataFrame, gaz: Gazetteer) -> DataFrame:
    """Entities that hold for each event, with the anchor places of direction and proximity."""
    resolved = context.resolve_contexts(contexts, gaz.regions, gaz.groups, gaz.directions)
    merged = context.inherit_contexts(events, resolved)
    anchors = (gaz.directions.groupBy("name").agg(F.max_by("anchor_cid", "row_no").alias("cid"))
               .join(gaz.locales.groupBy("cid").agg(F.max_by("lat", "row_no").alias("lat"), F.max_by("lon", "row_no").alias("lon")), "cid").drop("cid"))
    for kind, lat, lon in (("direction", "dir_lat", "dir_lon"), ("proximity", "prox_lat", "prox_lon")):
        merged = merged.join(anchors.select(F.col("name").alias(f"ctx_{kind}"), F.col("lat").alias(lat), F.col("lon").alias(lon)),
                             f"ctx_{kind}", "left")
    return merged.withColumn("in_region", F.col("ctx_region")).withColumn("in_group", F.col("ctx_group"))


def with_axes(contexts: DataFrame, segments: DataFrame) -> DataFrame:
    """Region, group and direction axis of each event.

    The few anchors meet events, not candidates, and events without one stay out of the join: they would all be one key.
    """
    events = contexts.select("event_id", "ctx_region", "ctx_group", F.col("dir_lat").alias("axis_lat"), F.col("dir_lon").alias("axis_lon"))
    given = F.col("axis_lat").isNotNull() & F.col("axis_lon").isNotNull()
    anchors = events.select(F.col("axis_lat").alias("lat"), F.col("axis_lon").alias("lon")).dropna().distinct()
    axes = scoring.direction_axes(anchors, segments)
    none = F.lit(None).cast("double")
    return (events.filter(given).join(axes, ["axis_lat", "axis_lon"], "left")
            .unionByName(events.filter(~given).withColumn("axis_dlat", none).withColumn("axis_dlon", none)))


def score_wanted(mentioned: DataFrame, places: DataFrame, contexts: DataFrame, segments: DataFrame,
                 params: Params = Params()) -> tuple[DataFrame, DataFrame]:
    """Fail-safe narrowing, direction axis, line distance and unary score.

    ``mentioned`` and ``places`` as of ``context.narrow_wanted``. Mentions of a want whose events have the same region, group and axis have the
    same scores, so these are what mentions ask for from here on: mentions with their new ``want``, and its scored places.
    """
    near = written(closest_on_lines(places, segments).drop("line_lat", "line_lon"), "near-lines").withColumnRenamed("want", "_narrowed")
    asked = mentioned.dropna(subset=context.MENTION).withColumnRenamed("want", "_narrowed").join(with_axes(contexts, segments), "event_id", "left")
    # An event that is listed twice has its candidates twice.
    mentioned, wants = context.asked_once(written(asked.groupBy(*asked.columns).agg(F.count("*").cast("int").alias("_times")), "asked-axes"))
    wants = wants.select("*", F.explode(F.array_repeat(F.lit(0), F.col("_times"))).alias("_no")).drop("_times", "_no")
    rows = scoring.project_on_axis(context.keep_region_and_group(wants.join(near, "_narrowed").drop("_narrowed"), owner=["want"]))
    unary = scoring.unary_score(F.col("line_km"), F.col("dir_cross_km"), F.col("dir_along_km"), params.scoring)
    return mentioned, rows.withColumn("unary", unary)


def resolve_mentions(mentions: DataFrame, events: DataFrame, contexts: DataFrame, gaz: Gazetteer,
                     segments: DataFrame, params: Params = Params()) -> tuple[DataFrame, DataFrame]:
    """The whole resolution job: resolved mentions, and the assignment of each event.

    Steps that are read more than once are written to the shared folder, so nothing is
    computed twice and each join knows the size of its sides. Candidates are found, scored and searched once per name and contexts;
    they are never rows of mentions.
    """
    ctx = written(event_contexts(events, contexts, gaz), "contexts")
    mentioned, places = context.narrow_wanted(mentions, ctx, gaz.locales, params)
    mentioned, scored = score_wanted(mentioned, places, ctx, segments, params)
    chosen = written(scoring.choose_wanted(mentioned, scored, params), "chosen")
    return scoring.write_back(mentions, chosen, gaz.locales, params), chosen
