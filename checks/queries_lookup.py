"""Gazetteer lookups."""

from pyspark.sql import functions as F

from checks.ctes import lockey, lookup_km
from checks.fixtures import Fixtures, word_at
from checks.registry import query
from georeport.functions.keys import plain_key
from georeport.operators import lookup


def _flat(df, *cols):
    return df.select(*cols)


@query("c01_alias_lookup", """SELECT text_id, cid, name, CAST(row_no AS BIGINT) AS row_no FROM fx_texts JOIN fx_index USING (key)""")
def _(fx: Fixtures):
    return lookup.search_locale(fx.texts, lookup.locale_index(fx.locales)).select("text_id", "cid", "name", "row_no")


REGION_TRY = """SELECT text_id, coalesce(a.entity, b.entity, c.entity) AS region FROM fx_texts t
  LEFT JOIN fx_region_index a ON a.key = t.key
  LEFT JOIN fx_region_index b ON t.key LIKE '% oblast' AND b.key = left(t.key, -7)
  LEFT JOIN fx_region_index c ON t.key LIKE '% region' AND c.key = left(t.key, -7)"""


@query("c02_region_lookup", REGION_TRY)
def _(fx):
    return lookup.resolve_entities(fx.texts, lookup.entity_index(fx.regions), "region", out="region").select("text_id", "region")


@query("c03_group_lookup", "SELECT text_id, entity AS grp FROM fx_texts LEFT JOIN fx_group_index USING (key)")
def _(fx):
    return lookup.resolve_entities(fx.texts, lookup.entity_index(fx.groups), "group", out="grp").select("text_id", "grp")


@query("c04_direction_lookup", """SELECT text_id, coalesce(a.entity, b.entity) AS direction FROM fx_texts t
  LEFT JOIN fx_direction_index a ON a.key = t.key
  LEFT JOIN fx_direction_index b ON b.key = CASE WHEN t.key LIKE '% direction' THEN left(t.key, -10)
    WHEN t.key LIKE 'direction of %' THEN substr(t.key, 14) END""")
def _(fx):
    return lookup.resolve_entities(fx.texts, lookup.entity_index(fx.directions), "direction", out="direction").select("text_id", "direction")


@query("c05_place_by_cid", """WITH last AS (SELECT cid, arg_max(row_no, row_no) AS row_no FROM fx_locales GROUP BY cid)
SELECT o_orderkey AS order_id, l.cid, p.name, p.lat, p.lon FROM orders JOIN fx_locales l ON l.row_no = o_custkey JOIN last ON last.cid = l.cid JOIN fx_locales p ON p.row_no = last.row_no""")
def _(fx):
    ids = fx.table("orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("row_no"))
    asked = ids.join(fx.locales.select("row_no", "cid"), "row_no").select("order_id", "cid")
    return lookup.place_by_cid(asked, fx.locales).select("order_id", "cid", "name", "lat", "lon")


@query("c06_places_in_region", f"""SELECT row_no AS region_no, l.cid FROM (SELECT row_no, unnest(list_append(aliases, name)) AS text FROM fx_regions) r
  JOIN (SELECT cid, {lockey('region')} AS rkey FROM fx_locales) l ON l.rkey = {lockey('r.text')}""")
def _(fx):
    texts = fx.regions.select(F.col("row_no").cast("long").alias("region_no"), F.explode(F.concat("aliases", F.array("name"))).alias("text"))
    return lookup.locales_in_region(texts, fx.locales).select(F.col("region_no").cast("int"), "cid")


def _scoped(fx):
    t = word_at(31 + F.col("ck") % 25, fx.vocab, fx.texts, "rw")
    t = word_at(56 + F.col("ck") % 5, fx.vocab, t, "gw")
    open_ = F.col("text_id") % 7 == 0
    return t.select("text_id", "text", F.when(~open_, F.upper(F.concat("rw", F.lit("  Oblast")))).alias("in_region"),
                    F.when(~open_, F.col("gw")).alias("in_group"))


_SCOPED = """WITH scoped AS (SELECT t.*, CASE WHEN text_id % 7 <> 0 THEN a.w || ' oblast' END AS in_region, CASE WHEN text_id % 7 <> 0 THEN b.w END AS in_group
  FROM fx_texts t JOIN fx_vocab a ON a.r = 31 + ck % 25 JOIN fx_vocab b ON b.r = 56 + ck % 5)"""


@query("c07_alias_in_region", _SCOPED + f"""
SELECT text_id, cid, row_no FROM scoped s JOIN fx_index i USING (key) WHERE in_region IS NULL OR {lockey('in_region')} = {lockey('region')}""")
def _(fx):
    return lookup.search_locale(_scoped(fx), lookup.locale_index(fx.locales), region="in_region").select("text_id", "cid", "row_no")


@query("c08_alias_in_group", _SCOPED + f"""
SELECT text_id, cid, row_no FROM scoped s JOIN fx_index i USING (key) WHERE in_group IS NULL OR {lockey('in_group')} = {lockey('grp')}""")
def _(fx):
    return lookup.search_locale(_scoped(fx), lookup.locale_index(fx.locales), group="in_group").select("text_id", "cid", "row_no")


@query("b13_known_names", """SELECT text_id, t.key IN (SELECT key FROM fx_index) AS is_place,
  (t.key IN (SELECT key FROM fx_region_index) OR (t.key LIKE '% oblast' AND left(t.key, -7) IN (SELECT key FROM fx_region_index))
   OR (t.key LIKE '% region' AND left(t.key, -7) IN (SELECT key FROM fx_region_index))) AS is_region FROM fx_texts t""")
def _(fx):
    a = lookup.has_name(fx.texts, lookup.locale_index(fx.locales), "locale").withColumnRenamed("known", "is_place")
    return lookup.has_name(a, lookup.entity_index(fx.regions), "region").select("text_id", "is_place", F.col("known").alias("is_region"))


@query("c12_nearest_named_place", f"""WITH asked AS (SELECT pid, lat, lon, r.w AS text FROM fx_points JOIN fx_vocab r ON r.r = 51 + k % 410),
d AS (SELECT a.pid, l.cid, {lookup_km('a.lat', 'a.lon', 'l.lat', 'l.lon')} AS d, l.row_no FROM asked a JOIN fx_index l ON l.key = {lockey('a.text')})
SELECT pid, cid, round(min_d, 4) AS km FROM asked LEFT JOIN (SELECT pid, arg_min(cid, (d, row_no)) AS cid, min(d) AS min_d FROM d GROUP BY pid) USING (pid)""")
def _(fx):
    asked = word_at(51 + F.col("k") % 410, fx.vocab, fx.points, "text")
    got = lookup.nearest_named(asked, lookup.locale_index(fx.locales))
    return got.select("pid", F.col("near_cid").alias("cid"), F.round("km", 4).alias("km"))


@query("c13_nearest_same_name", f"""WITH d AS (SELECT a.row_no, b.cid, {lookup_km('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS d, b.row_no AS b_no
  FROM fx_locales a JOIN fx_index b ON b.key = {lockey('a.name')} AND b.cid <> a.cid),
n AS (SELECT key, count(*) AS n FROM fx_index GROUP BY key),
best AS (SELECT row_no, arg_min(cid, (d, b_no)) AS cid, min(d) AS d FROM d GROUP BY row_no)
SELECT l.row_no, CASE WHEN b.cid IS NULL AND n.n = 1 THEN l.cid ELSE b.cid END AS near_cid,
  round(CASE WHEN b.cid IS NULL AND n.n = 1 THEN 0.0e0 ELSE b.d END, 4) AS near_km
FROM fx_locales l LEFT JOIN best b USING (row_no) LEFT JOIN n ON n.key = {lockey('l.name')}""")
def _(fx):
    got = lookup.nearest_same_name(fx.locales, lookup.locale_index(fx.locales))
    return got.select("row_no", "near_cid", F.round("near_km", 4).alias("near_km"))


@query("c20_anchor_resolution", """WITH d AS (SELECT text_id, t.key, coalesce(a.entity, b.entity) AS direction FROM fx_texts t
  LEFT JOIN fx_direction_index a ON a.key = t.key
  LEFT JOIN fx_direction_index b ON b.key = CASE WHEN t.key LIKE '% direction' THEN left(t.key, -10)
    WHEN t.key LIKE 'direction of %' THEN substr(t.key, 14) END),
stale AS (SELECT name, CASE WHEN row_no % 9 = 4 THEN -1 ELSE anchor_cid END AS anchor_cid FROM fx_directions)
SELECT text_id, CASE WHEN s.anchor_cid = -1 THEN NULL ELSE s.anchor_cid END AS cid,
  CASE WHEN s.anchor_cid = -1 THEN NULL ELSE 1.0e0 END AS score, s.anchor_cid = -1 AS mismatch
FROM d JOIN stale s ON s.name = d.direction WHERE direction IS NOT NULL
UNION ALL
SELECT text_id, i.cid, CASE WHEN i.cid IS NULL THEN NULL WHEN count(*) OVER (PARTITION BY text_id) = 1 THEN 1.0e0 ELSE 0.7e0 END, i.cid IS NULL
FROM d LEFT JOIN fx_index i USING (key) WHERE direction IS NULL""")
def _(fx):
    dirs = fx.directions.withColumn("anchor_cid", F.when(F.col("row_no") % 9 == 4, F.lit(-1)).otherwise(F.col("anchor_cid")))
    return lookup.resolve_anchors(fx.texts, dirs, fx.locales).select("text_id", "cid", "score", "mismatch")


@query("c25_neighbor_group_regions", """WITH g AS (SELECT lower(name) AS grp, regions, neighbors FROM fx_groups),
own AS (SELECT grp, unnest(regions) AS region FROM g),
pairs AS (SELECT grp, lower(unnest(neighbors)) AS near FROM g)
SELECT l.row_no, a.grp, CASE WHEN o.region IS NOT NULL THEN 1 ELSE 0 END AS own
FROM fx_locales l JOIN g a ON true LEFT JOIN own o ON o.grp = a.grp AND o.region = l.region
WHERE o.region IS NOT NULL OR EXISTS (SELECT 1 FROM pairs p JOIN own n ON n.grp = p.near WHERE p.grp = a.grp AND n.region = l.region)""")
def _(fx):
    reach = lookup.expand_groups(fx.groups)
    return fx.locales.withColumn("region_key", plain_key("region")).join(F.broadcast(reach), "region_key").select(
        "row_no", F.col("grp_key").alias("grp"), F.col("own").cast("int").alias("own"))


@query("c26_direction_anchors", f"""WITH idx AS (SELECT p, arg_min(name, row_no) AS direction FROM (SELECT lower(trim(unnest(list_prepend(name, aliases)))) AS p, name, row_no FROM fx_directions) GROUP BY p)
SELECT text_id, direction, l.cid, l.lat AS anchor_lat, l.lon AS anchor_lon FROM fx_texts t JOIN idx ON idx.p = lower(trim(t.text))
JOIN fx_directions d ON d.name = direction JOIN fx_locales l ON l.cid = d.anchor_cid""")
def _(fx):
    return lookup.direction_anchors(fx.texts, fx.directions, fx.locales).select("text_id", "direction", "cid", "anchor_lat", "anchor_lon")


_KINDS = (("locale", "fx_locales"), ("region", "fx_regions"), ("group", "fx_groups"), ("direction", "fx_directions"))


@query("d01_distinct_names", " UNION ALL ".join(
    f"SELECT DISTINCT '{k}' AS kind, {lockey('a')} AS key FROM (SELECT unnest(list_append(aliases, name)) AS a FROM {t})" for k, t in _KINDS))
def _(fx):
    parts = [lookup.gather_keys(df).select(F.lit(k).alias("kind"), "key") for k, df in (
        ("locale", fx.locales), ("region", fx.regions), ("group", fx.groups), ("direction", fx.directions))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy("kind", "key")


@query("d02_alias_index", """SELECT 'locale' AS kind, key, CAST(count(*) AS BIGINT) AS n, CAST(max(row_no) AS BIGINT) AS last_row FROM fx_index GROUP BY key
UNION ALL SELECT 'direction', i.key, 1, max(d.row_no) FROM fx_direction_index i JOIN fx_directions d ON d.name = i.entity GROUP BY i.key
UNION ALL SELECT 'region', i.key, 1, max(d.row_no) FROM fx_region_index i JOIN fx_regions d ON d.name = i.entity GROUP BY i.key
UNION ALL SELECT 'group', i.key, 1, max(d.row_no) FROM fx_group_index i JOIN fx_groups d ON d.name = i.entity GROUP BY i.key""")
def _(fx):
    out = lookup.locale_index(fx.locales).groupBy("key").agg(F.count("*").alias("n"), F.max("row_no").alias("last_row")).withColumn("kind", F.lit("locale"))
    for kind, df in (("region", fx.regions), ("group", fx.groups), ("direction", fx.directions)):
        last = df.select(F.col("name").alias("entity"), F.col("row_no").cast("long").alias("last_row"))
        out = out.unionByName(lookup.entity_index(df).join(last, "entity").select(
            "key", F.lit(1).cast("long").alias("n"), "last_row", F.lit(kind).alias("kind")))
    return out
