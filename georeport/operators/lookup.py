"""Gazetteer indexes and lookups: equi-joins on normalized keys.

Spark broadcasts an index whose measured size is small, so the texts are not shuffled and a key that fills a
third of them does no harm. A larger index is joined by shuffle, where adaptive
execution splits hot keys. Only ``search_locale`` deals both sides out by name and scope.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from georeport.functions.keys import location_key, plain_key
from georeport.operators.common import dealt_join
from georeport.operators.spatial import nearest


def _names() -> Column:
    return F.concat(F.coalesce("aliases", F.array().cast("array<string>")), F.array("name"))


def locale_index(locales: DataFrame) -> DataFrame:
    """One row per place and name or alias; repeated keys of a place are kept."""
    return locales.select(F.explode(F.transform(_names(), location_key)).alias("key"), "*")


def first_places(index: DataFrame, n: int) -> DataFrame:
    """Of each name in a ``locale_index`` the first ``n`` places by ``row_no``; a place counts once per name."""
    rest = [c for c in index.columns if c not in ("key", "cid", "row_no")]
    each = index.groupBy("key", "cid").agg(F.min(F.struct("row_no", *rest)).alias("s")).select("key", "cid", "s.*")
    return each.withColumn("_n", F.row_number().over(W.partitionBy("key").orderBy("row_no"))).filter(F.col("_n") <= n).drop("_n")


def entity_index(entities: DataFrame) -> DataFrame:
    """Key to entity name; when several rows share a key the last row holds."""
    return (entities.select(F.explode(F.transform(_names(), location_key)).alias("key"),
                            "name", "row_no")
            .groupBy("key").agg(F.max_by("name", "row_no").alias("entity")))


def gather_keys(entities: DataFrame) -> DataFrame:
    """Distinct keys of all names and aliases."""
    return entities.select(F.explode(F.transform(_names(), location_key)).alias("key")).distinct()


def _tries(kind: str, key: Column) -> list[Column]:
    """Keys to try in order; null where a try does not apply."""
    def cut(suffix: str) -> Column:
        return F.when(key.endswith(suffix), F.left(key, F.length(key) - len(suffix)))

    if kind == "region":
        return [key, cut(" oblast"), cut(" region")]
    if kind == "direction":
        lead = "direction of "
        after = F.when(key.startswith(lead), F.right(key, F.length(key) - len(lead)))
        return [key, F.when(key.endswith(" direction"), cut(" direction")).otherwise(after)]
    return [key]


def resolve_entities(texts: DataFrame, index: DataFrame, kind: str,
                     text: str = "text", out: str = "entity") -> DataFrame:
    """Add the entity name that a text stands for; null when unknown.

    The index is unique per key, so each try is a left join without fan-out; with a
    small index nothing is shuffled.
    """
    index = index.select("key", "entity")
    found, hits = texts, []
    for no, key in enumerate(_tries(kind, location_key(text))):
        found = found.withColumn(f"_k{no}", key).join(
            index.select(F.col("key").alias(f"_k{no}"), F.col("entity").alias(f"_e{no}")), f"_k{no}", "left")
        hits.append(f"_e{no}")
    return found.select(*texts.columns, F.coalesce(*hits).alias(out))


def search_locale(texts: DataFrame, index: DataFrame, text: str = "text",
                  region: str | None = None, group: str | None = None) -> DataFrame:
    """All places a text may name, optionally within a region or group (null = anywhere).

    A text has all places of its name, so the result is texts times places: each task has an equal part of it (``dealt_join``).
    Texts with a scope meet the places of their name and scope only, by an equi-join, so a name with many places
    makes no rows that are dropped again; they are dealt by name and scope.
    """
    keyed = texts.withColumn("key", location_key(text))
    scopes = [(c, f"_s{no}", own) for no, (c, own) in enumerate(((region, "region"), (group, "grp"))) if c]
    if not scopes:
        return dealt_join(keyed, index, ["key"])
    columns = ["key", *(c for c in keyed.columns if c != "key"), *(c for c in index.columns if c != "key")]
    asked, places = keyed, index
    for c, key, own in scopes:
        asked = asked.withColumn(key, location_key(c))
        places = places.withColumn(key, F.when(F.col(own) != "", location_key(own)))
    out = None
    # One join for each choice of scopes that are given.
    for chosen in range(1 << len(scopes)):
        part, on = asked, ["key"]
        for no, (c, key, _) in enumerate(scopes):
            given = bool(chosen >> no & 1)
            part = part.filter(F.col(c).isNotNull() if given else F.col(c).isNull())
            on += [key] if given else []
        unused = [key for _, key, _ in scopes if key not in on]
        hits = dealt_join(part.drop(*unused), places.drop(*unused), on).select(columns)
        out = hits if out is None else out.unionByName(hits)
    return out


def place_by_cid(ids: DataFrame, locales: DataFrame, cid: str = "cid") -> DataFrame:
    """The place of each id, as columns of the gazetteer; when several rows share an id the last one holds. Unknown ids keep nulls."""
    rest = [c for c in locales.columns if c != "cid"]
    last = locales.groupBy("cid").agg(F.max_by(F.struct(*rest), "row_no").alias("_p")).select(F.col("cid").alias("_cid"), "_p.*")
    kept = [c for c in rest if c not in ids.columns]
    return ids.join(last.select("_cid", *kept), F.col(cid) == F.col("_cid"), "left").drop("_cid")


def locales_in_region(regions: DataFrame, locales: DataFrame, text: str = "text") -> DataFrame:
    placed = locales.filter(F.col("region") != "").withColumn("key", location_key("region"))
    return regions.withColumn("key", location_key(text)).join(placed, "key")


def has_name(texts: DataFrame, index: DataFrame, kind: str, text: str = "text") -> DataFrame:
    """Flag texts that name a known entity."""
    known = index.select("key").distinct().withColumn("entity", F.lit(True))
    return resolve_entities(texts, known, kind, text).withColumn("known", F.coalesce("entity", F.lit(False))).drop("entity")


def nearest_named(points: DataFrame, index: DataFrame, text: str = "text") -> DataFrame:
    """Nearest place with the given name; null when no place has it."""
    keyed = points.withColumn("key", location_key(text))
    places = index.select("key", "cid", "name", "lat", "lon", "row_no").distinct()
    return nearest(keyed, places, 1, by=("key",))


def nearest_same_name(locales: DataFrame, index: DataFrame) -> DataFrame:
    """Nearest other place that shares the name of a place.

    A place alone with its name matches itself at 0 km; if all holders of the name are
    the place itself under several entries there is no match.
    """
    counts = index.groupBy("key").agg(F.count("*").alias("n_key"))
    places = (index.groupBy("key", "cid")
              .agg(F.min(F.struct("row_no", "name", "lat", "lon")).alias("s"))
              .select("key", "cid", "s.*"))
    points = locales.select("cid", "name", "lat", "lon", "row_no").withColumn("key", location_key("name"))
    near = (nearest(points.select("key", F.col("cid").alias("src_cid"), "lat", "lon", "row_no"),
                    places, 2, by=("key",), prefix="m_")
            .filter(F.col("m_cid") != F.col("src_cid"))
            .groupBy("src_cid", "row_no").agg(F.min(F.struct("km", "m_row_no", "m_cid")).alias("s"))
            .select("src_cid", "row_no", F.col("s.m_cid").alias("near_cid"), F.col("s.km").alias("near_km")))
    alone = F.col("near_cid").isNull() & (F.col("n_key") == 1)
    return (points.join(near, (points.cid == near.src_cid) & (points.row_no == near.row_no), "left")
            .drop(near.row_no).drop("src_cid").join(counts, "key", "left")
            .withColumn("near_km", F.when(alone, F.lit(0.0)).otherwise(F.col("near_km")))
            .withColumn("near_cid", F.when(alone, F.col("cid")).otherwise(F.col("near_cid")))
            .drop("n_key"))


def resolve_anchors(contexts: DataFrame, directions: DataFrame, locales: DataFrame,
                    text: str = "text") -> DataFrame:
    """Anchor places of direction and proximity contexts, one row per candidate.

    A direction entry is trusted (1.0). Otherwise the text is tried as a place name
    (0.7 each, 1.0 when single). Unknown text or a stale anchor is a mismatch.
    """
    named = resolve_entities(contexts, entity_index(directions), "direction", text, "direction")
    anchor = directions.groupBy("name").agg(F.max_by("anchor_cid", "row_no").alias("anchor_cid"))
    known = locales.select(F.col("cid").alias("anchor_cid")).distinct().withColumn("_ok", F.lit(True))
    direct = (named.filter("direction is not null")
              .join(anchor.withColumnRenamed("name", "direction"), "direction", "left")
              .join(known, "anchor_cid", "left")
              .withColumn("cid", F.when(F.col("_ok"), F.col("anchor_cid")))
              .withColumn("score", F.when(F.col("_ok"), F.lit(1.0))))
    index = locale_index(locales)
    hits = index.groupBy("key").agg(F.count("*").alias("_n"))
    other = (named.filter("direction is null").withColumn("key", location_key(text))
             .join(hits, "key", "left")
             .join(index.select("key", "cid"), "key", "left")
             .withColumn("score", F.when(F.col("_n") == 1, 1.0).when(F.col("_n") > 1, 0.7)))
    cols = [*contexts.columns, "cid", "score"]
    return direct.select(cols).unionByName(other.select(cols)).withColumn("mismatch", F.col("cid").isNull())


def direction_anchors(contexts: DataFrame, directions: DataFrame, locales: DataFrame,
                      text: str = "text") -> DataFrame:
    """Direction entry by trimmed lower-case name or alias (first wins), then its places."""
    names = F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))
    index = (directions.select(F.explode(F.transform(names, plain_key)).alias("_plain"), "name", "row_no")
             .groupBy("_plain").agg(F.min_by("name", "row_no").alias("direction")))
    anchors = directions.select(F.col("name").alias("direction"), F.col("anchor_cid").alias("cid"))
    places = locales.select("cid", F.col("lat").alias("anchor_lat"), F.col("lon").alias("anchor_lon"))
    return (contexts.withColumn("_plain", plain_key(text)).join(index, "_plain")
            .join(anchors, "direction").join(places, "cid").drop("_plain"))


def expand_groups(groups: DataFrame) -> DataFrame:
    """Regions of a group (own) and of its neighbor groups (near)."""
    own = groups.select(plain_key("name").alias("grp_key"),
                        F.explode(F.transform("regions", plain_key)).alias("region_key"))
    pairs = groups.select(plain_key("name").alias("grp_key"),
                          F.explode(F.transform("neighbors", plain_key)).alias("near_key"))
    near = pairs.join(own.withColumnRenamed("grp_key", "near_key"), "near_key")
    return (own.withColumn("own", F.lit(True))
            .unionByName(near.select("grp_key", "region_key").withColumn("own", F.lit(False)))
            .groupBy("grp_key", "region_key").agg(F.max("own").alias("own")))
