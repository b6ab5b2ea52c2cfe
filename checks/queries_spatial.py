"""Distances, nearest places, polygons and lines."""

from pyspark.sql import functions as F

from checks.ctes import cid, km, lookup_km
from checks.registry import query
from georeport.functions import geo
from georeport.operators import spatial

PLACES = ["cid", "lat", "lon", "row_no"]


@query("c09_nearest_place", f"""WITH d AS (SELECT s.lat, s.lon, l.cid, l.row_no, {lookup_km('s.lat', 's.lon', 'l.lat', 'l.lon')} AS d FROM fx_spots s, fx_locales l)
SELECT pid, cid, round(d, 4) AS km FROM fx_points JOIN (SELECT lat, lon, arg_min(cid, (d, row_no)) AS cid, min(d) AS d FROM d GROUP BY ALL) USING (lat, lon)""")
def _(fx):
    got = spatial.nearest(fx.points, fx.locales.select(*PLACES), 1)
    return got.select("pid", F.col("near_cid").alias("cid"), F.round("km", 4).alias("km"))


@query("c09b_nearest_place_of_cid", f"""WITH p AS (SELECT k, ((c >> 32) / 1000000.0e0 - 90.0e0) AS lat0, ((c & 4294967295) / 1000000.0e0 - 180.0e0) AS lon0 FROM
  (SELECT k, {cid('lat', 'lon')} AS c FROM (SELECT DISTINCT k, lat, lon FROM fx_points))),
r AS (SELECT k, round_even(lat0, 6) AS lat, round_even(lon0, 6) AS lon FROM p),
d AS (SELECT k, l.cid, l.row_no, {lookup_km('r.lat', 'r.lon', 'l.lat', 'l.lon')} AS d FROM r, fx_locales l)
SELECT k, arg_min(cid, (d, row_no)) AS cid, round(min(d), 4) AS km FROM d GROUP BY k""")
def _(fx):
    ids = fx.points.select("k", geo.encode_cid(F.col("lat"), F.col("lon")).alias("c")).distinct()
    points = ids.select("k", geo.decode_lat(F.col("c")).alias("lat"), geo.decode_lon(F.col("c")).alias("lon"))
    got = spatial.nearest(points, fx.locales.select(*PLACES), 1)
    return got.select("k", F.col("near_cid").alias("cid"), F.round("km", 4).alias("km"))


_TOP5 = f"""SELECT s.lat, s.lon, l.cid, {lookup_km('s.lat', 's.lon', 'l.lat', 'l.lon')} AS d,
  row_number() OVER (PARTITION BY s.lat, s.lon ORDER BY {lookup_km('s.lat', 's.lon', 'l.lat', 'l.lon')}, l.row_no) AS rk FROM fx_spots s, fx_locales l"""


@query("c10_nearest_places", f"""SELECT pid, CAST(rk AS INTEGER) AS rank, cid, round(d, 4) AS km FROM fx_points JOIN (SELECT * FROM ({_TOP5}) WHERE rk <= 5) USING (lat, lon)""")
def _(fx):
    got = spatial.nearest(fx.points, fx.locales.select(*PLACES), 5)
    return got.select("pid", "rank", F.col("near_cid").alias("cid"), F.round("km", 4).alias("km"))


_WITHIN = f"""SELECT * FROM (SELECT s.lat, s.lon, l.cid, {lookup_km('s.lat', 's.lon', 'l.lat', 'l.lon')} AS d FROM fx_spots s, fx_locales l) WHERE d <= 30"""


@query("c11_places_within_km", f"SELECT pid, cid, round(d, 4) AS km FROM fx_points JOIN ({_WITHIN}) USING (lat, lon)")
def _(fx):
    got = spatial.within_km(fx.points, fx.locales.select(*PLACES), 30.0, digits=4)
    return got.select("pid", F.col("near_cid").alias("cid"), "km")


# Every tenth point lies on another continent.
_FAR = """far AS (SELECT pid, k, CASE WHEN k % 10 = 0 THEN lat - 70.0e0 ELSE lat END AS lat, CASE WHEN k % 10 = 0 THEN lon - 85.0e0 ELSE lon END AS lon FROM fx_points),
  farspots AS (SELECT DISTINCT lat, lon FROM far)"""


def _far(fx):
    away = F.col("k") % 10 == 0
    return fx.points.select("pid", F.when(away, F.col("lat") - 70.0).otherwise(F.col("lat")).alias("lat"), F.when(away, F.col("lon") - 85.0).otherwise(F.col("lon")).alias("lon"))


@query("c09c_nearest_of_far_points", f"""WITH {_FAR}, d AS (SELECT s.lat, s.lon, l.cid, l.row_no, {lookup_km('s.lat', 's.lon', 'l.lat', 'l.lon')} AS d FROM farspots s, fx_locales l)
SELECT pid, cid, round(d, 4) AS km FROM far JOIN (SELECT lat, lon, arg_min(cid, (d, row_no)) AS cid, min(d) AS d FROM d GROUP BY ALL) USING (lat, lon)""")
def _(fx):
    got = spatial.nearest(_far(fx), fx.locales.select(*PLACES), 1)
    return got.select("pid", F.col("near_cid").alias("cid"), F.round("km", 4).alias("km"))


@query("f01_distance_list", f"""SELECT lat, lon, array_to_string(list(cid ORDER BY d, cid), ' ') AS cids, CAST(count(*) AS BIGINT) AS n FROM ({_WITHIN}) GROUP BY lat, lon""")
def _(fx):
    spots = fx.points.select("lat", "lon").distinct()
    got = spatial.within_km(spots, fx.locales.select(*PLACES), 30.0)
    lists = got.groupBy("lat", "lon").agg(F.sort_array(F.collect_list(F.struct("km", "near_cid"))).alias("l"))
    return lists.select("lat", "lon", F.array_join(F.transform("l", lambda x: x["near_cid"].cast("string")), " ").alias("cids"),
                        F.size("l").cast("long").alias("n"))


@query("c14_first_polygon", """WITH f AS (SELECT lat, lon, min(poly_no) AS no, arg_min(poly_name, poly_no) AS poly_name FROM fx_inside GROUP BY ALL)
SELECT pid, poly_name, no IS NOT NULL AS confirmed FROM fx_points LEFT JOIN f USING (lat, lon)""")
def _(fx):
    return spatial.assign_polygon(fx.points, fx.polygons).select("pid", "poly_name", "confirmed")


@query("c15_smallest_polygon", """WITH f AS (SELECT lat, lon, arg_min(poly_name, (area, poly_no)) AS poly_name FROM fx_inside JOIN fx_areas USING (poly_no, poly_name) GROUP BY ALL)
SELECT pid, poly_name, poly_name IS NOT NULL AS confirmed FROM fx_points LEFT JOIN f USING (lat, lon)""")
def _(fx):
    area = F.aggregate("polygons", F.lit(0.0), lambda a, p: a + spatial.polygon_area(p))
    return spatial.assign_polygon(fx.points, fx.polygons.withColumn("area", area), "area").select("pid", "poly_name", "confirmed")


def seg_sql(lat: str, lon: str, table: str, segments: str = "fx_segments", on: str = "true", keep: str = "") -> str:
    """Planar distance and closest point of every row to every segment."""
    return f"""SELECT *, sqrt(pow(cx - px, 2) + pow(cy - py, 2)) AS m FROM (SELECT *, x1 + t * (x2 - x1) AS cx, y1 + t * (y2 - y1) AS cy FROM (
      SELECT *, greatest(0.0e0, least(1.0e0, coalesce(((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1))
        / nullif(pow(x2 - x1, 2) + pow(y2 - y1, 2), 0), 0.0e0))) AS t FROM (
      SELECT p.*, s.* {keep}, radians({lon}) * 6378137.0e0 AS px, ln(tan(pi() / 4 + radians({lat}) / 2)) * 6378137.0e0 AS py
      FROM {table} p JOIN {segments} s ON {on})))"""


@query("c21_line_distance", f"""WITH d AS ({seg_sql('p.lat', 'p.lon', 'fx_locales')})
SELECT row_no, round(min(m) / 1000.0e0, 4) AS line_km FROM d GROUP BY row_no""")
def _(fx):
    got = spatial.closest_on_lines(fx.locales.select("row_no", "lat", "lon"), fx.segments)
    return got.select("row_no", F.round("line_km", 4).alias("line_km"))


@query("c22_closest_line_point", f"""WITH d AS ({seg_sql('p.lat', 'p.lon', 'fx_locales')}),
b AS (SELECT row_no, arg_min(cx, (m, pt_no)) AS cx, arg_min(cy, (m, pt_no)) AS cy FROM d GROUP BY row_no)
SELECT row_no, round(degrees(atan(sinh(cy / 6378137.0e0))), 6) AS line_lat, round(degrees(cx / 6378137.0e0), 6) AS line_lon FROM b""")
def _(fx):
    got = spatial.closest_on_lines(fx.locales.select("row_no", "lat", "lon"), fx.segments)
    return got.select("row_no", F.round("line_lat", 6).alias("line_lat"), F.round("line_lon", 6).alias("line_lon"))


# A wavy outline of 100,000 corners.
_WAVY = """corners AS (SELECT i, 31.00013e0 + r * cos(a) AS x, 48.00021e0 + 0.5e0 * r * sin(a) AS y FROM (
    SELECT i, a, 6.0e0 + sin(7 * a) + 0.2e0 * sin(900 * a) AS r FROM (SELECT range AS i, 2 * pi() * range / 100000 AS a FROM range(100000)))),
  edges AS (SELECT i, x AS x1, y AS y1, coalesce(lead(x) OVER (ORDER BY i), first(x) OVER (ORDER BY i)) AS x2, coalesce(lead(y) OVER (ORDER BY i), first(y) OVER (ORDER BY i)) AS y2 FROM corners)"""


@query("c14b_polygon_of_many_corners", f"""WITH {_WAVY}, inside AS (SELECT s.lat, s.lon FROM fx_spots s, edges e GROUP BY ALL HAVING
  count(*) FILTER (WHERE (y1 > s.lat) <> (y2 > s.lat) AND s.lon < (x2 - x1) * (s.lat - y1) / (y2 - y1) + x1) % 2 = 1)
SELECT pid, i.lat IS NOT NULL AS confirmed FROM fx_points p LEFT JOIN inside i ON i.lat = p.lat AND i.lon = p.lon""")
def _(fx):
    a = 2 * F.pi() * F.col("id") / 100000
    r = 6.0 + F.sin(7 * a) + 0.2 * F.sin(900 * a)
    corner = F.struct("id", F.struct((31.00013 + r * F.cos(a)).alias("lon"), (48.00021 + 0.5 * r * F.sin(a)).alias("lat")).alias("p"))
    ring = F.transform(F.sort_array(F.collect_list(corner)), lambda c: c["p"])
    wavy = fx.spark.range(100000).agg(F.array(F.array(ring)).alias("polygons")).select(F.lit(0).alias("poly_no"), F.lit("wavy").alias("poly_name"), "polygons")
    return spatial.assign_polygon(fx.points, wavy).select("pid", "confirmed")


EDGES_M = """SELECT poly_no, i, radians(x1) * 6378137.0e0 AS x1, ln(tan(pi() / 4 + radians(y1) / 2)) * 6378137.0e0 AS y1,
  radians(x2) * 6378137.0e0 AS x2, ln(tan(pi() / 4 + radians(y2) / 2)) * 6378137.0e0 AS y2 FROM fx_edges"""


@query("c23_polygon_reach", f"""WITH asked AS (SELECT pid, lat, lon, CAST(k % 9 AS INTEGER) AS area_no FROM fx_points),
em AS ({EDGES_M}), u AS (SELECT DISTINCT lat, lon, area_no FROM asked),
d AS ({seg_sql('p.lat', 'p.lon', 'u', 'em', 'p.area_no = s.poly_no')}),
b AS (SELECT lat, lon, area_no, min(m) AS m FROM d GROUP BY ALL)
SELECT pid, a.area_no, i.poly_no IS NOT NULL AS inside, CASE WHEN i.poly_no IS NOT NULL THEN 0.0e0 ELSE round(b.m, 2) END AS area_m
FROM asked a LEFT JOIN b USING (lat, lon, area_no) LEFT JOIN fx_inside i ON i.lat = a.lat AND i.lon = a.lon AND i.poly_no = a.area_no""")
def _(fx):
    asked = fx.points.select("pid", "lat", "lon", (F.col("k") % 9).cast("int").alias("area_no"))
    areas = fx.polygons.select(F.col("poly_no").alias("area_no"), "poly_no", "polygons")
    return spatial.polygon_reach(asked, areas, ["area_no"]).select("pid", "area_no", "inside", F.round("area_m", 2).alias("area_m"))


@query("h10_distance_km", f"""SELECT pid, round({km('lat', 'lon', '48.0e0', '31.0e0')}, 4) AS km, round({km('lat', 'lon', '48.0e0', '31.0e0')} * 1000, 1) AS m FROM fx_points""")
def _(fx):
    to = F.col("lat"), F.col("lon"), F.lit(48.0), F.lit(31.0)
    return fx.points.select("pid", F.round(geo.haversine_km(*to), 4).alias("km"), F.round(geo.haversine_m(*to), 1).alias("m"))


@query("h11_lookup_km", f"SELECT pid, round({lookup_km('lat', 'lon', '48.0e0', '31.0e0')}, 4) AS km FROM fx_points")
def _(fx):
    return fx.points.select("pid", F.round(geo.lookup_km(F.col("lat"), F.col("lon"), F.lit(48.0), F.lit(31.0)), 4).alias("km"))


@query("h12_coordinate_id", f"""SELECT pid, c AS cid, round_even((c >> 32) / 1000000.0e0 - 90.0e0, 6) AS lat2, round_even((c & 4294967295) / 1000000.0e0 - 180.0e0, 6) AS lon2
FROM (SELECT pid, {cid('lat', 'lon')} AS c FROM fx_points)""")
def _(fx):
    c = geo.encode_cid(F.col("lat"), F.col("lon"))
    return fx.points.select("pid", c.alias("cid"), geo.decode_lat(c).alias("lat2"), geo.decode_lon(c).alias("lon2"))


@query("h13_unit_vector", """SELECT pid, CASE WHEN m = 0 THEN 0.0e0 ELSE round(a / m, 9) END AS ulat, CASE WHEN m = 0 THEN 0.0e0 ELSE round(b / m, 9) END AS ulon
FROM (SELECT *, sqrt(a * a + b * b) AS m FROM (SELECT pid, CASE WHEN k % 10 = 0 THEN 0.0e0 ELSE lat - 48.0e0 END AS a, CASE WHEN k % 10 = 0 THEN 0.0e0 ELSE lon - 31.0e0 END AS b FROM fx_points))""")
def _(fx):
    zero = F.col("k") % 10 == 0
    a = F.when(zero, F.lit(0.0)).otherwise(F.col("lat") - 48.0)
    b = F.when(zero, F.lit(0.0)).otherwise(F.col("lon") - 31.0)
    return fx.points.select("pid", F.round(geo.unit_lat(a, b), 9).alias("ulat"), F.round(geo.unit_lon(a, b), 9).alias("ulon"))


@query("h14_mercator", """SELECT pid, round(x, 2) AS x, round(y, 2) AS y, round(degrees(x / 6378137.0e0), 7) AS lon2, round(degrees(atan(sinh(y / 6378137.0e0))), 7) AS lat2
FROM (SELECT pid, radians(lon) * 6378137.0e0 AS x, ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137.0e0 AS y FROM fx_points)""")
def _(fx):
    x, y = geo.mercator_x(F.col("lon")), geo.mercator_y(F.col("lat"))
    return fx.points.select("pid", F.round(x, 2).alias("x"), F.round(y, 2).alias("y"),
                            F.round(geo.mercator_lon(x), 7).alias("lon2"), F.round(geo.mercator_lat(y), 7).alias("lat2"))
