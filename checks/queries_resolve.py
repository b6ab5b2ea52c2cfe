"""Contexts of events, narrowing, scores and the joint choice of places."""

from pyspark.sql import functions as F

from checks.ctes import CTES, km, lockey, lookup_km
from checks.queries_spatial import EDGES_M, seg_sql
from checks.registry import query
from georeport.operators import context, scoring, spatial
from georeport.plans.resolve import resolve_mentions


def _entity(kind: str, t: str = "t") -> str:
    idx = {"region": "fx_region_index", "group": "fx_group_index", "direction": "fx_direction_index"}[kind]
    tries = {"region": [f"{t}.key", f"CASE WHEN {t}.key LIKE '% oblast' THEN left({t}.key, -7) END", f"CASE WHEN {t}.key LIKE '% region' THEN left({t}.key, -7) END"],
             "group": [f"{t}.key"],
             "direction": [f"{t}.key", f"CASE WHEN {t}.key LIKE '% direction' THEN left({t}.key, -10) WHEN {t}.key LIKE 'direction of %' THEN substr({t}.key, 14) END"]}[kind]
    return "coalesce(" + ", ".join(f"(SELECT entity FROM {idx} i WHERE i.key = {x})" for x in tries) + ")"


def _unary(line: str, cross: str, along: str) -> str:
    return f"""(CASE WHEN {line} IS NOT NULL THEN greatest(0.0e0, 50.0e0 - {line}) / 50.0e0 ELSE 0.0e0 END
      + CASE WHEN {cross} IS NULL THEN 0.0e0 ELSE (CASE WHEN {cross} <= 8 THEN 1.0e0 WHEN {cross} <= 20 THEN 1.0e0 - ({cross} - 8) / 12.0e0
        ELSE -least(({cross} - 20) / 20.0e0, 1.0e0) END) * (CASE WHEN {along} < -10 OR {along} > 60 THEN 0.3e0 ELSE 1.0e0 END) END)"""


def pair(a: str, b: str) -> str:
    d = km(f"{a}.lat", f"{a}.lon", f"{b}.lat", f"{b}.lon")
    return f"""(CASE WHEN {a}.region <> '' AND {b}.region <> '' THEN CASE WHEN {a}.region = {b}.region THEN 1.0e0 ELSE -1.0e0 END ELSE 0.0e0 END
      + CASE WHEN {a}.grp <> '' AND {b}.grp <> '' THEN CASE WHEN {a}.grp = {b}.grp THEN 0.5e0 ELSE -0.25e0 END ELSE 0.0e0 END
      + 2.0e0 * CASE WHEN {d} <= 15 THEN 1.0e0 WHEN {d} <= 50 THEN 1.0e0 - ({d} - 15) / 35.0e0 ELSE -least(({d} - 50) / 50.0e0, 1.0e0) END)"""


CTES.update({
    # Contexts of all levels: tx_ctx(level, post_id, section_id, event_id, ord, kind, text).
    "tx_ctx": f"""SELECT *, {lockey('text')} AS key FROM (
        SELECT 'post' AS level, post_id, NULL AS section_id, NULL AS event_id, ts AS ord, 0 AS pass, kind, text FROM tx_post_contexts
        UNION ALL SELECT 'section', post_id, section_id, NULL, ts, 0, kind, text FROM tx_section_contexts
        UNION ALL SELECT 'event', e.post_id, NULL, s.event_id, s.ts, s.pass, s.kind, s.text FROM tx_scoped s JOIN tx_events0 e USING (event_id) WHERE loc_no IS NULL)""",
    "tx_resolved": f"""SELECT t.*, CASE kind WHEN 'region' THEN {_entity('region')} WHEN 'group' THEN {_entity('group')} ELSE {_entity('direction')} END AS entity FROM tx_ctx t""",
    "tx_post_ctx": "SELECT post_id, kind, arg_max_null(entity, ord) AS entity FROM tx_resolved WHERE level = 'post' GROUP BY ALL",
    "tx_section_ctx": "SELECT post_id, section_id, kind, arg_max(entity, ord) AS entity FROM tx_resolved WHERE level = 'section' AND entity IS NOT NULL GROUP BY ALL",
    "tx_event_ctx": "SELECT event_id, kind, arg_max(entity, (pass, ord)) AS entity FROM tx_resolved WHERE level = 'event' AND entity IS NOT NULL GROUP BY ALL",
    "tx_merged": "SELECT e.post_id, e.event_id, " + ", ".join(
        f"""coalesce((SELECT entity FROM tx_event_ctx c WHERE c.event_id = e.event_id AND c.kind = '{k}'),
        (SELECT entity FROM tx_section_ctx c WHERE c.post_id = e.post_id AND c.section_id = e.section_id AND c.kind = '{k}'),
        (SELECT entity FROM tx_post_ctx c WHERE c.post_id = e.post_id AND c.kind = '{k}')) AS ctx_{k}""" for k in ("region", "group", "direction", "proximity"))
        + " FROM tx_events e",
    "tx_anchors": """SELECT d.name, l.lat, l.lon FROM (SELECT name, arg_max(anchor_cid, row_no) AS cid FROM fx_directions GROUP BY name) d JOIN fx_locales l USING (cid)""",
    "tx_event_anchor": """SELECT m.*, d.lat AS dir_lat, d.lon AS dir_lon, p.lat AS prox_lat, p.lon AS prox_lon FROM tx_merged m
        LEFT JOIN tx_anchors d ON d.name = m.ctx_direction LEFT JOIN tx_anchors p ON p.name = m.ctx_proximity""",
    # Plain candidates, and the narrowed ones.
    "tx_candidates": """SELECT DISTINCT m.event_id, m.loc_no, i.row_no, i.cid, i.name, i.lat, i.lon, i.region, i.grp, i.qid FROM tx_mentions m JOIN fx_index i USING (key)""",
    "tx_line_km": f"""SELECT row_no, min(m) / 1000.0e0 AS line_km FROM ({seg_sql('p.lat', 'p.lon', 'fx_locales')}) GROUP BY row_no""",
    "tx_scored": f"""SELECT c.*, line_km, {_unary('line_km', 'CAST(NULL AS DOUBLE)', 'CAST(NULL AS DOUBLE)')} AS unary FROM tx_candidates c JOIN tx_line_km USING (row_no)""",
    "tx_narrow0": f"""SELECT c.*, a.ctx_region, a.ctx_group, prox_lat, {lookup_km('prox_lat', 'prox_lon', 'lat', 'lon')} AS d,
        coalesce({lockey('c.region')} = {lockey('a.ctx_region')}, false) AS in_r, coalesce({lockey('c.grp')} = {lockey('a.ctx_group')}, false) AS in_g
        FROM tx_candidates c JOIN tx_event_anchor a USING (event_id)""",
    "tx_narrow1": """SELECT *, ctx_region IS NOT NULL AND bool_or(in_r) OVER m AS use_r FROM tx_narrow0 WINDOW m AS (PARTITION BY event_id, loc_no)""",
    "tx_narrow2": """SELECT *, bool_or(in_g AND (in_r OR NOT use_r)) OVER (PARTITION BY event_id, loc_no) AS any_both FROM tx_narrow1""",
    "tx_narrow3": """SELECT *, bool_or(d <= 50) OVER (PARTITION BY event_id, loc_no) AS any_near, row_number() OVER (PARTITION BY event_id, loc_no ORDER BY d, row_no) AS n FROM tx_narrow2
        WHERE (NOT use_r OR in_r) AND (ctx_group IS NULL OR in_g OR (ctx_region IS NOT NULL AND NOT any_both))""",
    "tx_narrowed": """SELECT *, CASE WHEN ctx_region IS NULL THEN 0.0e0 WHEN lower(region) = lower(ctx_region) THEN 0.6e0 ELSE -0.5e0 END
        + CASE WHEN ctx_group IS NULL THEN 0.0e0 WHEN grp = ctx_group THEN 0.6e0 ELSE -0.5e0 END
        + CASE WHEN prox_lat IS NULL THEN 0.0e0 WHEN d <= 50 THEN 0.4e0 ELSE -0.2e0 END AS confidence FROM tx_narrow3
        WHERE prox_lat IS NULL OR d <= 50 OR (NOT any_near AND n <= 5)""",
})

_BEAM_ORDER = "event_id, loc_no, row_no, cid, lat, lon, region, grp, qid, unary"


def beam_sql(table: str, prox: str = "0.0e0", width: int = 50) -> str:
    """Beam search as a recursive statement; ends in ``beam_done(event_id, score, picks)``."""
    picked = pair("c.p", "x.q")
    return f"""WITH RECURSIVE bs_in AS MATERIALIZED (SELECT event_id, loc_no, {{'loc_no': loc_no, 'row_no': row_no, 'cid': cid, 'lat': lat, 'lon': lon, 'region': region, 'grp': grp, 'qid': qid, 'unary': unary}} AS p,
    {prox} AS prox, row_no, count(*) OVER (PARTITION BY event_id, loc_no) > 1 AS open_ FROM {table}),
  bs_pos AS MATERIALIZED (SELECT *, dense_rank() OVER (PARTITION BY event_id ORDER BY open_, loc_no) AS pos FROM bs_in),
  bs_last AS MATERIALIZED (SELECT event_id, max(pos) AS last FROM bs_pos GROUP BY event_id),
  bs_beam AS (
    SELECT event_id, CAST(0 AS BIGINT) AS pos, CAST(1 AS BIGINT) AS rnk, 0.0e0 AS score, list_filter([first(p)], lambda q: false) AS picks FROM bs_pos GROUP BY event_id
    UNION ALL
    SELECT event_id, pos, rnk, score, picks FROM (
      SELECT event_id, pos, score, picks, row_number() OVER (PARTITION BY event_id ORDER BY -round(score, 9), parent, prox, row_no) AS rnk FROM (
        SELECT b.event_id, c.pos, b.rnk AS parent, c.prox, c.row_no, list_append(b.picks, c.p) AS picks,
          b.score + c.p.unary + coalesce((SELECT sum({picked}) FROM (SELECT unnest(b.picks) AS q) x), 0.0e0) AS score
        FROM bs_beam b JOIN bs_pos c ON c.event_id = b.event_id AND c.pos = b.pos + 1)) WHERE rnk <= {width}),
  beam_done AS MATERIALIZED (SELECT b.event_id, b.score, b.picks FROM bs_beam b JOIN bs_last l ON l.event_id = b.event_id AND l.last = b.pos WHERE b.rnk = 1),
  beam_picks AS MATERIALIZED (SELECT event_id, p.loc_no AS loc_no, p.row_no AS row_no, p.cid AS cid, p.lat AS lat, p.lon AS lon, p.region AS region, p.grp AS grp, p.qid AS qid, p.unary AS unary
    FROM (SELECT event_id, unnest(picks) AS p FROM beam_done))"""


# ------------------------------------------------------------------- contexts


@query("e01_first_context", """SELECT event_id, kind, arg_min(text, (pass, ord)) AS text FROM tx_ctx WHERE level = 'event' GROUP BY ALL""")
def _(fx):
    return context.first_context(fx.contexts.filter("level = 'event'"))


@query("e02_unique_places", "SELECT event_id, loc_no, cid, CAST(row_no AS BIGINT) AS row_no FROM tx_candidates")
def _(fx):
    return fx.candidates.select("event_id", "loc_no", "cid", "row_no")


@query("e07_inherited_contexts", "SELECT event_id, ctx_region, ctx_group, ctx_direction, ctx_proximity FROM tx_merged")
def _(fx):
    return fx.event_contexts.select("event_id", "ctx_region", "ctx_group", "ctx_direction", "ctx_proximity")


# ------------------------------------------------------------------ narrowing


@query("j01_narrowed_candidates", "SELECT event_id, loc_no, cid, round(confidence, 6) AS confidence, round(d, 4) AS prox_km FROM tx_narrowed")
def _(fx):
    got = context.narrow_candidates(fx.mentions, fx.event_contexts, fx.locales)
    return got.select("event_id", "loc_no", "cid", F.round("confidence", 6).alias("confidence"), F.round("prox_km", 4).alias("prox_km"))


@query("j01b_single_candidates", "SELECT event_id, loc_no, any_value(cid) AS cid, round(any_value(confidence), 6) AS confidence FROM tx_narrowed GROUP BY event_id, loc_no HAVING count(*) = 1")
def _(fx):
    got = context.single_candidates(context.narrow_candidates(fx.mentions, fx.event_contexts, fx.locales))
    return got.select("event_id", "loc_no", "cid", F.round("confidence", 6).alias("confidence"))


@query("e11_nearest_five", f"""WITH d AS (SELECT c.event_id, c.loc_no, c.cid, {lookup_km('48.0e0', '31.0e0', 'lat', 'lon')} AS d, row_no FROM tx_candidates c),
n AS (SELECT *, bool_or(d <= 50) OVER (PARTITION BY event_id, loc_no) AS any_near, row_number() OVER (PARTITION BY event_id, loc_no ORDER BY d, row_no) AS n FROM d)
SELECT event_id, loc_no, cid, round(d, 4) AS prox_km FROM n WHERE d <= 50 OR (NOT any_near AND n <= 5)""")
def _(fx):
    none = F.lit(None).cast("string")
    ctx = fx.report_events.select("event_id", none.alias("in_region"), none.alias("in_group"), F.lit(48.0).alias("prox_lat"), F.lit(31.0).alias("prox_lon"))
    return context.narrow_candidates(fx.mentions, ctx, fx.locales).select("event_id", "loc_no", "cid", F.round("prox_km", 4).alias("prox_km"))


_SCOPED = """WITH c AS (SELECT c.*, r.name AS want_region, g.name AS want_group FROM tx_candidates c
  JOIN fx_regions r ON r.row_no = c.loc_no % 25 JOIN fx_groups g ON g.row_no = c.loc_no % 5),
r AS (SELECT *, bool_or(region = want_region) OVER (PARTITION BY event_id, loc_no) AS any_r FROM c),
r1 AS (SELECT * FROM r WHERE NOT any_r OR region = want_region)"""


@query("g02_region_and_group", _SCOPED + """, g AS (SELECT *, bool_or(region = want_region AND grp = want_group) OVER (PARTITION BY event_id, loc_no) AS any_both FROM r1)
SELECT event_id, loc_no, cid FROM g WHERE NOT any_both OR (region = want_region AND grp = want_group)""")
def _(fx):
    rows = _wanted(fx)
    kept = context.keep_matching(rows, F.col("region") == F.col("want_region"), "_r")
    both = (F.col("region") == F.col("want_region")) & (F.col("grp") == F.col("want_group"))
    return context.keep_matching(kept, both, "_b").select("event_id", "loc_no", "cid")


def _wanted(fx):
    r = F.broadcast(fx.regions.select(F.col("row_no").alias("_r"), F.col("name").alias("want_region")))
    g = F.broadcast(fx.groups.select(F.col("row_no").alias("_g"), F.col("name").alias("want_group")))
    rows = fx.candidates.withColumn("_r", F.col("loc_no") % 25).withColumn("_g", F.col("loc_no") % 5)
    return rows.join(r, "_r").join(g, "_g").drop("_r", "_g")


@query("j02_region_narrowing", _SCOPED + """ SELECT event_id, loc_no, cid, coalesce(region <> want_region, true) AS region_mismatch FROM r1""")
def _(fx):
    return context.keep_region(_wanted(fx), "want_region").select("event_id", "loc_no", "cid", "region_mismatch")


@query("j03_group_narrowing", _SCOPED + """, g AS (SELECT *, bool_or(grp = want_group) OVER (PARTITION BY event_id, loc_no) AS any_g FROM r1)
SELECT event_id, loc_no, cid, coalesce(grp <> want_group, true) AS group_mismatch FROM g WHERE NOT any_g OR grp = want_group""")
def _(fx):
    rows = context.keep_region(_wanted(fx), "want_region")
    return context.keep_group(rows, "want_group").select("event_id", "loc_no", "cid", "group_mismatch")


@query("j04_region_constraint", """WITH e AS (SELECT p, arg_min(nm, row_no) AS own, arg_min(neighbors, row_no) AS near FROM (
  SELECT lower(trim(unnest(list_prepend(name, aliases)))) AS p, lower(name) AS nm, row_no, neighbors FROM fx_regions) GROUP BY p),
c AS (SELECT c.*, r.aliases[2] AS want FROM tx_candidates c JOIN fx_regions r ON r.row_no = c.loc_no % 25)
SELECT event_id, loc_no, cid, CASE WHEN lower(region) = own THEN 1.0e0 ELSE 0.25e0 END AS region_score FROM c JOIN e ON e.p = c.want
WHERE lower(region) = own OR list_contains(list_transform(near, lambda x: lower(trim(x))), lower(region))""")
def _(fx):
    r = F.broadcast(fx.regions.select(F.col("row_no").alias("_r"), F.upper(F.get("aliases", F.lit(1))).alias("region_text")))
    rows = fx.candidates.withColumn("_r", F.col("loc_no") % 25).join(r, "_r")
    return context.constrain_region(rows, fx.regions).select("event_id", "loc_no", "cid", "region_score")


@query("j05_group_constraint", f"""WITH g AS (SELECT row_no, lower(name) AS grp_key, regions, neighbors FROM fx_groups),
own AS (SELECT grp_key, unnest(regions) AS region FROM g), pairs AS (SELECT grp_key, lower(unnest(neighbors)) AS near FROM g),
reach AS (SELECT grp_key, region FROM own UNION SELECT p.grp_key, o.region FROM pairs p JOIN own o ON o.grp_key = p.near),
em AS ({EDGES_M}), c AS (SELECT c.*, g.grp_key, CAST(g.row_no AS INTEGER) AS want_no FROM tx_candidates c JOIN g ON g.row_no = c.loc_no % 5),
u AS (SELECT DISTINCT lat, lon, want_no FROM c),
d AS ({seg_sql('p.lat', 'p.lon', 'u', 'em', 'p.want_no = s.poly_no')}), b AS (SELECT lat, lon, want_no, min(m) AS m FROM d GROUP BY ALL),
i AS (SELECT u.lat, u.lon, u.want_no FROM u JOIN fx_edges e ON e.poly_no = u.want_no GROUP BY ALL HAVING
  count(*) FILTER (WHERE (y1 > u.lat) <> (y2 > u.lat) AND u.lon < (x2 - x1) * (u.lat - y1) / (y2 - y1) + x1) % 2 = 1)
SELECT event_id, loc_no, cid, CASE WHEN i.lat IS NOT NULL THEN 0.4e0 ELSE 0.1e0 END AS area_score, CASE WHEN lower(grp) = c.grp_key THEN 0.5e0 ELSE 0.0e0 END AS group_score
FROM c JOIN reach r ON r.grp_key = c.grp_key AND r.region = c.region LEFT JOIN b ON b.lat = c.lat AND b.lon = c.lon AND b.want_no = c.want_no
LEFT JOIN i ON i.lat = c.lat AND i.lon = c.lon AND i.want_no = c.want_no WHERE i.lat IS NOT NULL OR b.m <= 10000""")
def _(fx):
    g = F.broadcast(fx.groups.select(F.col("row_no").alias("_g"), F.col("name").alias("group_text")))
    asked = fx.mentioned.withColumn("_g", F.col("loc_no") % 5)
    # A place of a name is in a group's reach or not, whatever mention asks for it.
    rows = asked.select("want", "_g").distinct().join(g, "_g").join(fx.want_places, "want")
    areas = fx.polygons.join(F.broadcast(fx.groups.select(F.col("row_no").alias("poly_no"), "name")), "poly_no")
    got = context.constrain_group(rows, fx.groups, areas).select("want", "_g", "cid", "area_score", "group_score")
    return asked.join(fx.stored(got, "reached"), ["want", "_g"]).select("event_id", "loc_no", "cid", "area_score", "group_score")


# ---------------------------------------------------------------- axis, scores

CTES.update({
    "tx_axis": f"""WITH d AS ({seg_sql('p.lat', 'p.lon', 'fx_locales')}), b AS (SELECT row_no, lat, lon, arg_min(cx, (m, pt_no)) AS cx, arg_min(cy, (m, pt_no)) AS cy FROM d GROUP BY ALL),
      v AS (SELECT row_no, lat, lon, degrees(atan(sinh(cy / 6378137.0e0))) - lat AS a, degrees(cx / 6378137.0e0) - lon AS o FROM b)
      SELECT row_no, lat, lon, CASE WHEN sqrt(a * a + o * o) = 0 THEN 0.0e0 ELSE a / sqrt(a * a + o * o) END AS vlat, CASE WHEN sqrt(a * a + o * o) = 0 THEN 0.0e0 ELSE o / sqrt(a * a + o * o) END AS vlon FROM v""",
    "tx_offsets": f"""SELECT c.event_id, c.loc_no, c.cid, x.vlat, x.vlon, (CASE WHEN c.lat < x.lat THEN -1 ELSE 1 END) * {km('x.lat', 'x.lon', 'c.lat', 'x.lon')} AS north,
      (CASE WHEN c.lon < x.lon THEN -1 ELSE 1 END) * {km('x.lat', 'x.lon', 'x.lat', 'c.lon')} AS east FROM tx_candidates c JOIN tx_axis x ON x.row_no = c.loc_no * 37 % 100""",
    "tx_projected": """SELECT *, sqrt(pow(north - along * vlat, 2) + pow(east - along * vlon, 2)) AS crs FROM (SELECT *, north * vlat + east * vlon AS along FROM tx_offsets)""",
})


@query("j06_direction_axis", "SELECT row_no, round(vlat, 6) AS vlat, round(vlon, 6) AS vlon FROM tx_axis")
def _(fx):
    got = scoring.direction_axes(fx.locales.select("row_no", "lat", "lon"), fx.segments)
    return got.select("row_no", F.round("axis_dlat", 6).alias("vlat"), F.round("axis_dlon", 6).alias("vlon"))


def _projected(fx):
    axes = scoring.direction_axes(fx.locales.select("row_no", "lat", "lon"), fx.segments)
    axes = axes.withColumnRenamed("row_no", "_a")
    return scoring.project_on_axis(fx.candidates.withColumn("_a", F.col("loc_no").cast("long") * 37 % 100).join(axes, "_a"))


@query("j07_axis_projection", "SELECT event_id, loc_no, cid, round(along, 4) AS along_km, round(crs, 4) AS cross_km FROM tx_projected")
def _(fx):
    return _projected(fx).select("event_id", "loc_no", "cid", F.round("dir_along_km", 4).alias("along_km"), F.round("dir_cross_km", 4).alias("cross_km"))


@query("j08_direction_bonus", """SELECT event_id, loc_no, cid, CASE WHEN crs < 5 THEN 0.3e0 WHEN crs < 10 THEN 0.15e0 WHEN crs < 20 THEN 0.05e0 ELSE -0.05e0 END AS bonus FROM tx_projected""")
def _(fx):
    return _projected(fx).select("event_id", "loc_no", "cid", scoring.direction_bonus(F.col("dir_cross_km")).alias("bonus"))


@query("j09_candidate_line_distance", "SELECT event_id, loc_no, cid, round(line_km, 4) AS line_km FROM tx_scored")
def _(fx):
    return spatial.closest_on_lines(fx.candidates, fx.segments).select("event_id", "loc_no", "cid", F.round("line_km", 4).alias("line_km"))


@query("j10_unary_score", f"""SELECT p.event_id, p.loc_no, p.cid, round({_unary('s.line_km', 'p.crs', 'p.along')}, 6) AS unary
FROM tx_projected p JOIN tx_scored s USING (event_id, loc_no, cid)""")
def _(fx):
    rows = spatial.closest_on_lines(_projected(fx), fx.segments)
    score = scoring.unary_score(F.col("line_km"), F.col("dir_cross_km"), F.col("dir_along_km"))
    return rows.select("event_id", "loc_no", "cid", F.round(score, 6).alias("unary"))


CTES["tx_first"] = "SELECT * FROM tx_scored QUALIFY row_number() OVER (PARTITION BY event_id, loc_no ORDER BY row_no) = 1"


def _first(fx):
    """First candidate of each mention, gathered per event."""
    fields = ["loc_no", "row_no", "cid", "lat", "lon", "rlat", "rlon", "clat", "region", "grp", "qid", "unary"]
    rows = scoring.with_angles(fx.scored_first).groupBy("event_id", "loc_no").agg(F.min(F.struct("row_no", *[f for f in fields if f not in ("row_no", "loc_no")])).alias("s"))
    return rows.select("event_id", "loc_no", "s.*").groupBy("event_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("picks"))


@query("j11_pair_score", f"""SELECT a.event_id, a.loc_no AS loc_a, b.loc_no AS loc_b, round({pair('a', 'b')}, 6) AS score FROM tx_first a JOIN tx_first b
  ON b.event_id = a.event_id AND b.loc_no > a.loc_no""")
def _(fx):
    rows = _first(fx).select("event_id", F.explode("picks").alias("a"), "picks")
    rows = rows.select("event_id", "a", F.explode(F.filter("picks", lambda p: p["loc_no"] > F.col("a.loc_no"))).alias("b"))
    return rows.select("event_id", F.col("a.loc_no").alias("loc_a"), F.col("b.loc_no").alias("loc_b"),
                       F.round(scoring.pair_score(F.col("a"), F.col("b")), 6).alias("score"))


@query("j12_assignment_score", f"""SELECT event_id, round(u + coalesce(p, 0.0e0), 6) AS score FROM (SELECT event_id, sum(unary) AS u FROM tx_first GROUP BY event_id)
LEFT JOIN (SELECT a.event_id, sum({pair('a', 'b')}) AS p FROM tx_first a JOIN tx_first b ON b.event_id = a.event_id AND b.loc_no > a.loc_no GROUP BY a.event_id) USING (event_id)""")
def _(fx):
    return _first(fx).select("event_id", F.round(scoring.assignment_score(F.col("picks")), 6).alias("score"))


# ---------------------------------------------------------------- joint choice


@query("j13_beam_search", beam_sql("tx_scored") + " SELECT d.event_id, round(d.score, 6) AS score, p.loc_no, p.cid FROM beam_done d JOIN beam_picks p USING (event_id)")
def _(fx):
    return fx.chosen.select("event_id", F.round("score", 6).alias("score"), F.explode("picks").alias("p")).select("event_id", "score", "p.loc_no", "p.cid")


@query("e10_beam_over_rows", beam_sql("tx_scored") + " SELECT d.event_id, round(d.score, 6) AS score, p.loc_no, p.cid FROM beam_done d JOIN beam_picks p USING (event_id)")
def _(fx):
    got = scoring.choose_wanted(fx.mentioned, fx.want_scored)
    return got.select("event_id", F.round("score", 6).alias("score"), F.explode("picks").alias("p")).select("event_id", "score", "p.loc_no", "p.cid")


_DIAG = ", dp AS (SELECT event_id, a.loc_no AS la, b.loc_no AS lb, " + km("a.lat", "a.lon", "b.lat", "b.lon") + """ AS d FROM beam_picks a JOIN beam_picks b USING (event_id) WHERE a.loc_no < b.loc_no),
med AS (SELECT event_id, median(d) AS m FROM dp GROUP BY event_id),
cut AS (SELECT p.event_id, p.loc_no, median(d) AS m FROM beam_picks p JOIN dp ON dp.event_id = p.event_id AND la <> p.loc_no AND lb <> p.loc_no GROUP BY ALL),
nn AS (SELECT event_id, count(*) AS n, avg(lat) AS clat, avg(lon) AS clon, """ + km("min(lat)", "min(lon)", "max(lat)", "max(lon)") + """ AS bbox FROM beam_picks GROUP BY event_id),
so AS (SELECT c.event_id, string_agg(c.loc_no, ',' ORDER BY c.loc_no) AS s FROM cut c JOIN med USING (event_id) JOIN nn USING (event_id)
  WHERE n > 2 AND med.m > 0 AND med.m - c.m > 5 AND (med.m - c.m) / med.m > 0.35 GROUP BY c.event_id),
fo AS (SELECT p.event_id, string_agg(p.loc_no, ',' ORDER BY p.loc_no) AS s FROM beam_picks p JOIN nn USING (event_id) WHERE """ + km("p.lat", "p.lon", "clat", "clon") + """ > 30 GROUP BY p.event_id),
dq AS (SELECT event_id, string_agg(s, ';' ORDER BY qid) AS s FROM (SELECT event_id, qid, qid || ':' || string_agg(loc_no, ',' ORDER BY loc_no) AS s FROM beam_picks WHERE qid <> '' GROUP BY event_id, qid HAVING count(*) > 1) GROUP BY event_id)"""


def _join(c, sep=","):
    return F.array_join(F.array_sort(F.transform(c, lambda x: x)), sep)


@query("j14_cluster_diagnostics", beam_sql("tx_scored") + _DIAG + """
SELECT nn.event_id, round(bbox, 4) AS bbox_km, bbox > 30 AS bbox_is_large, coalesce(fo.s, '') AS outliers, coalesce(dq.s, '') AS duplicate_qids, coalesce(so.s, '') AS structural_outliers
FROM nn LEFT JOIN fo USING (event_id) LEFT JOIN dq USING (event_id) LEFT JOIN so USING (event_id)""")
def _(fx):
    d = scoring.diagnostics(fx.chosen)
    dupes = F.array_join(F.transform("duplicate_qids", lambda g: F.concat(g["qid"], F.lit(":"), _join(g["loc_nos"]))), ";")
    return d.select("event_id", F.round("bbox_km", 4).alias("bbox_km"), "bbox_is_large", _join(F.col("outliers")).alias("outliers"),
                    dupes.alias("duplicate_qids"), _join(F.col("structural_outliers")).alias("structural_outliers"))


@query("d06_bbox_diagonal", f"SELECT event_id, round({km('min(lat)', 'min(lon)', 'max(lat)', 'max(lon)')}, 4) AS bbox_km FROM tx_first GROUP BY event_id")
def _(fx):
    return _first(fx).select("event_id", F.round(scoring.bbox_km(F.col("picks")), 4).alias("bbox_km"))


@query("d07_centroid", "SELECT event_id, round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon FROM tx_first GROUP BY event_id")
def _(fx):
    c = scoring.centroid(F.col("picks"))
    return _first(fx).select("event_id", F.round(c["lat"], 6).alias("lat"), F.round(c["lon"], 6).alias("lon"))


@query("d08_median_pair_distance", f"""SELECT event_id, round(coalesce(m, 0.0e0), 4) AS median_km FROM (SELECT DISTINCT event_id FROM tx_first) LEFT JOIN
(SELECT a.event_id, median({km('a.lat', 'a.lon', 'b.lat', 'b.lon')}) AS m FROM tx_first a JOIN tx_first b ON b.event_id = a.event_id AND b.loc_no > a.loc_no GROUP BY a.event_id) USING (event_id)""")
def _(fx):
    return _first(fx).select("event_id", F.round(scoring.median_pair_km(F.col("picks")), 4).alias("median_km"))


@query("d09_duplicate_qids_in_event", """SELECT event_id, qid, string_agg(loc_no, ',' ORDER BY loc_no) AS loc_nos FROM tx_first WHERE qid <> '' GROUP BY event_id, qid HAVING count(*) > 1""")
def _(fx):
    return _first(fx).select("event_id", F.explode(scoring.duplicate_qids(F.col("picks"))).alias("g")).select("event_id", "g.qid", _join(F.col("g.loc_nos")).alias("loc_nos"))


_CONF = f""", cf AS (SELECT a.event_id, a.loc_no, a.unary + coalesce(sum({pair('a', 'b')}) FILTER (WHERE b.loc_no <> a.loc_no), 0.0e0) AS confidence
FROM beam_picks a JOIN beam_picks b USING (event_id) GROUP BY a.event_id, a.loc_no, a.unary)"""


@query("j15_confidence", beam_sql("tx_scored") + _CONF + " SELECT event_id, loc_no, round(confidence, 6) AS confidence FROM cf")
def _(fx):
    return scoring.assignments(fx.chosen).select("event_id", "loc_no", F.round("confidence", 6).alias("confidence"))


@query("j16_written_back", beam_sql("tx_scored") + _CONF + """ SELECT m.event_id, m.loc_no, m.text, p.cid AS final_cid, l.name AS final_name, round(confidence, 6) AS final_confidence
FROM tx_mentions m LEFT JOIN beam_picks p USING (event_id, loc_no) LEFT JOIN cf USING (event_id, loc_no) LEFT JOIN fx_locales l ON l.row_no = p.row_no""")
def _(fx):
    got = scoring.write_back(fx.mentions, fx.chosen, fx.locales)
    return got.select("event_id", "loc_no", "text", "final_cid", "final_name", F.round("final_confidence", 6).alias("final_confidence"))


CTES.update({
    "tx_failsafe0": "SELECT n.*, bool_or(ctx_region IS NULL OR region = ctx_region) OVER (PARTITION BY event_id, loc_no) AS any_r FROM tx_narrowed n",
    "tx_failsafe1": "SELECT *, bool_or(ctx_group IS NULL OR grp = ctx_group) OVER (PARTITION BY event_id, loc_no) AS any_g FROM tx_failsafe0 WHERE NOT any_r OR ctx_region IS NULL OR region = ctx_region",
    "tx_failsafe": "SELECT * FROM tx_failsafe1 WHERE NOT any_g OR ctx_group IS NULL OR grp = ctx_group",
    "tx_axed": f"""SELECT f.*, x.vlat, x.vlon, (CASE WHEN f.lat < x.lat THEN -1 ELSE 1 END) * {km('x.lat', 'x.lon', 'f.lat', 'x.lon')} AS north,
      (CASE WHEN f.lon < x.lon THEN -1 ELSE 1 END) * {km('x.lat', 'x.lon', 'x.lat', 'f.lon')} AS east FROM tx_failsafe f JOIN tx_event_anchor a USING (event_id)
      LEFT JOIN tx_axis x ON x.lat = a.dir_lat AND x.lon = a.dir_lon""",
    "tx_final": f"""SELECT event_id, loc_no, row_no, cid, lat, lon, region, grp, qid, d, {_unary('line_km', 'crs', 'along')} AS unary FROM (
      SELECT *, sqrt(pow(north - along * vlat, 2) + pow(east - along * vlon, 2)) AS crs FROM (SELECT *, north * vlat + east * vlon AS along FROM tx_axed)) JOIN tx_line_km USING (row_no)""",
})


@query("j17_resolved_mentions", beam_sql("tx_final", "coalesce(d, 0.0e0)") + _CONF + """ SELECT m.event_id, m.loc_no, m.text, p.cid AS final_cid, round(confidence, 6) AS final_confidence
FROM tx_mentions m LEFT JOIN beam_picks p USING (event_id, loc_no) LEFT JOIN cf USING (event_id, loc_no)""")
def _(fx):
    got, _ = resolve_mentions(fx.mentions, fx.report_events, fx.contexts, fx.gazetteer, fx.segments)
    return got.select("event_id", "loc_no", "text", "final_cid", F.round("final_confidence", 6).alias("final_confidence"))
