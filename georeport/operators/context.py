"""Contexts that hold for an event, and candidate places under them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from georeport.functions.geo import lookup_km
from georeport.functions.keys import location_key, plain_key
from georeport.operators.common import written
from georeport.operators.lookup import entity_index, expand_groups, locale_index, resolve_entities
from georeport.operators.spatial import polygon_reach
from georeport.params import Params

KINDS = ("region", "group", "direction", "proximity")
MENTION = ["event_id", "loc_no"]


def first_context(contexts: DataFrame, owner: Sequence[str] = ("event_id",)) -> DataFrame:
    """First context of each kind per owner."""
    return contexts.groupBy(*owner, "kind").agg(F.min_by("text", "ord").alias("text"))


def unique_places(candidates: DataFrame, owner: Sequence[str] = MENTION) -> DataFrame:
    """One row per mention (or other owner) and place: the first."""
    rest = [c for c in candidates.columns if c not in (*owner, "cid", "row_no")]
    return (candidates.groupBy(*owner, "cid").agg(F.min(F.struct("row_no", *rest)).alias("s"))
            .select(*owner, "cid", "s.*"))


def asked_once(asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mentions with what they ask for, ``want``, and the different wants with the columns of ``asked``.

    Mentions that ask for the same have the same places, so these are found once per want. A mention that is listed with
    different columns asks for all of them: such a want has several rows.
    """
    columns = [c for c in asked.columns if c not in MENTION]
    rows = asked.groupBy(*MENTION).agg(F.array_sort(F.collect_set(F.struct(*columns))).alias("_all"))
    rows = rows.withColumn("want", F.to_json("_all", {"ignoreNullFields": "false"}))
    wants = rows.groupBy("want").agg(F.first("_all").alias("_all"))
    return rows.select(*MENTION, "want"), wants.select("want", F.explode("_all").alias("_one")).select("want", "_one.*")


def resolve_contexts(contexts: DataFrame, regions: DataFrame, groups: DataFrame, directions: DataFrame) -> DataFrame:
    """Canonical entity of each context. Proximity texts use the direction entries."""
    def one(kinds: tuple[str, ...], table: DataFrame, kind: str) -> DataFrame:
        return resolve_entities(contexts.filter(F.col("kind").isin(*kinds)), entity_index(table), kind)

    return (one(("region",), regions, "region").unionByName(one(("group",), groups, "group"))
            .unionByName(one(("direction", "proximity"), directions, "direction")))


def inherit_contexts(events: DataFrame, resolved: DataFrame) -> DataFrame:
    """Region, group, direction and proximity entity of each event.

    The last resolved context of the event wins, then of its section, then of its post.
    At post level the last context counts even when it is unknown.
    """
    def by_kind(level: str, owner: list[str]) -> DataFrame:
        rows = resolved.filter(F.col("level") == level)
        if level != "post":
            rows = rows.filter("entity is not null")
        return rows.groupBy(*owner).agg(*(
            F.expr(f"max_by(entity, ord) FILTER (WHERE kind = '{k}')").alias(f"{level}_{k}") for k in KINDS))

    out = (events.select("post_id", "section_id", "event_id")
           .join(by_kind("post", ["post_id"]), "post_id", "left")
           .join(by_kind("section", ["post_id", "section_id"]), ["post_id", "section_id"], "left")
           .join(by_kind("event", ["event_id"]), "event_id", "left"))
    return out.select("post_id", "event_id", *(
        F.coalesce(f"event_{k}", f"section_{k}", f"post_{k}").alias(f"ctx_{k}") for k in KINDS))


def any_of(df: DataFrame, keys: list[str], flag: Column, name: str) -> DataFrame:
    """Does any row of the group have the flag? Combined before the shuffle, then joined back."""
    found = df.groupBy(*keys).agg(F.max(F.coalesce(flag, F.lit(False))).alias(name))
    return df.join(found, keys)


def narrow_candidates(mentions: DataFrame, contexts: DataFrame, locales: DataFrame,
                      params: Params = Params()) -> DataFrame:
    """Candidate places of each mention under region, group and proximity contexts: ``narrow_wanted`` as rows of mentions."""
    mentioned, rows = narrow_wanted(mentions, contexts, locales, params)
    return mentioned.join(rows, "want").drop("want")


def narrow_wanted(mentions: DataFrame, contexts: DataFrame, locales: DataFrame,
                  params: Params = Params()) -> tuple[DataFrame, DataFrame]:
    """Mentions with what they ask for, ``want``, and the candidate places of each want under region, group and proximity contexts.

    ``mentions``: event_id, loc_no, text. ``contexts``: event_id, in_region, in_group,
    prox_lat, prox_lon (nulls = none). Whether a region or group leaves anything for a name
    is read from small tables of the gazetteer, so no mention is gathered for it.
    """
    index = (locale_index(locales).drop("aliases")
             .withColumn("_rk", F.when(F.col("region") != "", location_key("region")))
             .withColumn("_gk", F.when(F.col("grp") != "", location_key("grp"))))

    def known(*keys: str) -> DataFrame:
        return index.select("key", *keys).dropna().distinct().withColumn("_has" + "".join(keys), F.lit(True))

    asked = (mentions.select(*MENTION, "text").join(contexts.select(
                "event_id", "in_region", "in_group", "prox_lat", "prox_lon"), "event_id", "left")
             .withColumn("key", location_key("text"))
             .withColumn("_rk", location_key("in_region")).withColumn("_gk", location_key("in_group")))
    for keys in (("_rk",), ("_gk",), ("_rk", "_gk")):
        asked = asked.join(known(*keys), ["key", *keys], "left")
    region_given = F.coalesce("in_region", F.lit("")) != ""
    group_given = F.coalesce("in_group", F.lit("")) != ""
    by_region = region_given & F.col("_has_rk").isNotNull()
    # With a region as well, the group only counts where it leaves something.
    joint = F.when(by_region, F.col("_has_rk_gk")).otherwise(F.col("_has_gk")).isNotNull()
    by_group = group_given & (~region_given | joint)
    asked = asked.select(*MENTION, "key", "in_region", "in_group", "prox_lat", "prox_lon",
                         F.when(by_region, F.col("_rk")).alias("_rw"), F.when(by_group, F.col("_gk")).alias("_gw"),
                         region_given.alias("_rg"), group_given.alias("_gg"))
    # From here on once per want: the same name under the same contexts.
    mentioned, asked = asked_once(written(asked, "asked"))
    rows = asked.join(index, "key").filter(
        (F.col("_rw").isNull() | (F.col("_rk") == F.col("_rw"))) & (F.col("_gw").isNull() | (F.col("_gk") == F.col("_gw"))))
    rows = unique_places(rows, ["want"])

    km = lookup_km(F.col("prox_lat"), F.col("prox_lon"), F.col("lat"), F.col("lon"))
    near = F.col("prox_lat").isNotNull()
    rows = rows.withColumn("prox_km", F.when(near, km))
    inside = F.col("prox_km") <= params.proximity_radius_km
    w = W.partitionBy("want").orderBy("prox_km", "row_no")
    # When nothing lies in the radius the nearest few stay; the limit is applied before the shuffle.
    few = (rows.filter(near).withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= params.proximity_keep)
           .withColumn("_any", F.max(inside).over(W.partitionBy("want"))).filter(~F.col("_any")).drop("_n", "_any"))
    rows = rows.filter(~near | inside).unionByName(few)

    conf = F.lit(0.0)
    same_region = F.coalesce(F.lower("region") == F.lower("in_region"), F.lit(False))
    same_group = F.coalesce(F.col("grp") == F.col("in_group"), F.lit(False))
    conf = conf + F.when(F.col("_rg"), F.when(same_region, F.lit(0.6)).otherwise(-0.5)).otherwise(0.0)
    conf = conf + F.when(F.col("_gg"), F.when(same_group, F.lit(0.6)).otherwise(-0.5)).otherwise(0.0)
    conf = conf + F.when(near, F.when(inside, F.lit(0.4)).otherwise(-0.2)).otherwise(0.0)
    rows = written(rows.withColumn("confidence", conf).select(
        "want", "cid", "row_no", "name", "lat", "lon", "region", "grp", "qid", "prox_km", "confidence"), "wanted")
    return mentioned, rows


def single_candidates(candidates: DataFrame) -> DataFrame:
    """Mentions that narrowing has left one place: resolved early, with that place and its confidence."""
    fields = ["cid", "row_no", "name", "lat", "lon", "confidence"]
    one = candidates.groupBy(*MENTION).agg(F.count("*").alias("_n"), F.min(F.struct("row_no", *(c for c in fields if c != "row_no"))).alias("s"))
    return one.filter("_n = 1").select(*MENTION, *(f"s.{c}" for c in fields))


def keep_matching(candidates: DataFrame, flag: Column, mark: str) -> DataFrame:
    """Keep flagged candidates of a mention, or all of them when none is flagged; ``mark`` tells misses."""
    ok = F.coalesce(flag, F.lit(False))
    return (any_of(candidates.withColumn(mark, ~ok), MENTION, ok, "_any")
            .filter(~F.col("_any") | ~F.col(mark)).drop("_any"))


def keep_region(candidates: DataFrame, region: str = "ctx_region") -> DataFrame:
    """Fail-safe narrowing to a canonical region name; null = no region."""
    return keep_matching(candidates, F.col(region).isNull() | (F.col("region") == F.col(region)), "region_mismatch")


def keep_group(candidates: DataFrame, group: str = "ctx_group") -> DataFrame:
    """Fail-safe narrowing to a canonical group name; null = no group."""
    return keep_matching(candidates, F.col(group).isNull() | (F.col("grp") == F.col(group)), "group_mismatch")


def keep_region_and_group(candidates: DataFrame, region: str = "ctx_region", group: str = "ctx_group", owner: Sequence[str] = MENTION) -> DataFrame:
    """``keep_region`` then ``keep_group`` with one aggregation for both, per mention (or other owner)."""
    r = F.coalesce(F.col(region).isNull() | (F.col("region") == F.col(region)), F.lit(False))
    g = F.coalesce(F.col(group).isNull() | (F.col("grp") == F.col(group)), F.lit(False))
    found = candidates.groupBy(*owner).agg(F.max(r).alias("_r"), F.max(g).alias("_g"), F.max(r & g).alias("_rg"))
    in_region = ~F.col("_r") | r
    any_group = F.when(F.col("_r"), F.col("_rg")).otherwise(F.col("_g"))
    return (candidates.join(found, [*owner]).filter(in_region & (~any_group | g))
            .withColumn("region_mismatch", ~r).withColumn("group_mismatch", ~g).drop("_r", "_g", "_rg"))


def _entries(table: DataFrame, *cols: Column) -> DataFrame:
    """Plain name or alias to entry; the first entry wins."""
    names = F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))
    rows = table.select(F.explode(F.transform(names, plain_key)).alias("_plain"), "row_no", *cols)
    rest = [c for c in rows.columns if c not in ("_plain", "row_no")]
    return rows.groupBy("_plain").agg(F.min_by(F.struct(*rest), "row_no").alias("_entry"))


def constrain_region(candidates: DataFrame, regions: DataFrame, text: str = "region_text") -> DataFrame:
    """Hard region filter: same region scores 1.0, neighbor region 0.25, others go.

    Rows whose context text is null or unknown pass unscored.
    """
    entries = _entries(regions, plain_key("name").alias("own"),
                                          F.transform("neighbors", plain_key).alias("near"))
    rows = (candidates.withColumn("_plain", plain_key(text)).join(entries, "_plain", "left")
            .withColumn("_region", plain_key("region")))
    same = F.col("_region") == F.col("_entry.own")
    near = F.array_contains("_entry.near", F.col("_region"))
    scored = rows.withColumn("region_score", F.when(same, F.lit(1.0)).when(near, F.lit(0.25)))
    return (scored.filter(F.col("_entry").isNull() | F.col("region_score").isNotNull())
            .drop("_plain", "_entry", "_region"))


# Fixed values of the group filter: metres and scores.
GROUP_BUFFER_M = 10_000.0
IN_AREA, IN_BUFFER, SAME_GROUP = 0.40, 0.10, 0.50


def constrain_group(candidates: DataFrame, groups: DataFrame, areas: DataFrame, text: str = "group_text") -> DataFrame:
    """Hard group filter by region membership and distance to the group's area.

    ``areas``: name, poly_no, polygons. Rows whose group is null, unknown or without an
    area pass unscored.
    """
    entries = _entries(groups, plain_key("name").alias("grp_key"))
    shapes = areas.select(plain_key("name").alias("grp_key"), "poly_no", "polygons")
    mapped = shapes.select("grp_key").distinct().withColumn("_area", F.lit(True))
    reach = expand_groups(groups).select("grp_key", F.col("region_key").alias("_region"), F.lit(True).alias("_near"))
    rows = (candidates.withColumn("_plain", plain_key(text)).join(entries, "_plain", "left")
            .withColumn("grp_key", F.col("_entry.grp_key")).drop("_plain", "_entry")
            .withColumn("_region", plain_key("region"))
            .join(mapped, "grp_key", "left").join(reach, ["grp_key", "_region"], "left"))
    # The search reads its points several times.
    held = polygon_reach(written(rows, "grouped"), shapes, ["grp_key"])
    active = F.coalesce("_area", F.lit(False))
    ok = F.coalesce("_near", F.lit(False)) & (F.coalesce(F.col("area_m"), F.lit(float("inf"))) <= GROUP_BUFFER_M)
    same = plain_key("grp") == F.col("grp_key")
    return (held.filter(~active | ok)
            .withColumn("area_score", F.when(active, F.when(F.col("inside"), F.lit(IN_AREA)).otherwise(IN_BUFFER)))
            .withColumn("group_score", F.when(active, F.when(same, F.lit(SAME_GROUP)).otherwise(0.0)))
            .drop("grp_key", "_region", "_area", "_near", "inside", "area_m"))
