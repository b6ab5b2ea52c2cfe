"""Grid joins against brute force on small tables, edges of the map included."""

import math
import random

from pyspark.sql import functions as F

from georeport.operators import spatial


def _km(a, b):
    p1, l1, p2, l2 = map(math.radians, (*a, *b))
    h = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin((l2 - l1) / 2) ** 2
    return 6371.0 * 2 * math.asin(math.sqrt(h))


def _data(spark):
    rnd = random.Random(7)
    spots = [(rnd.uniform(-89, 89), rnd.uniform(-180, 179.9)) for _ in range(150)] + [(rnd.uniform(47, 49), rnd.uniform(30, 33)) for _ in range(250)]
    places = [(i, lat, lon) for i, (lat, lon) in enumerate(spots)]
    points = [(i, rnd.uniform(-89.5, 89.5), rnd.uniform(-180, 179.9)) for i in range(60)] + [(100 + i, 48.0 + i / 40, 31.5) for i in range(20)] + [(200, 0.1, 179.99), (201, 48.0, 31.5)]
    return points, places, spark.createDataFrame(points, "pid int, lat double, lon double"), spark.createDataFrame(places, "row_no int, lat double, lon double")


def test_nearest_is_brute_force(spark):
    points, places, p, g = _data(spark)
    for n in (1, 5):
        got = {}
        for r in spatial.nearest(p, g, n).collect():
            got.setdefault(r["pid"], []).append((r["rank"], r["near_row_no"]))
        for pid, lat, lon in points:
            want = [x[1] for x in sorted((_km((lat, lon), (a, b)), i) for i, a, b in places)[:n]]
            assert [x[1] for x in sorted(got[pid])] == want


def _all_pairs(monkeypatch):
    """Counts the pairs of points and items that meet."""
    met, plain = [], spatial._pairs

    def counted(*args, **kw):
        out = plain(*args, **kw).cache()
        met.append(out.count())
        return out

    monkeypatch.setattr(spatial, "_pairs", counted)
    return met


def test_far_points_meet_few_places(spark, monkeypatch):
    """A tenth of the places is asked for from another continent, dense and sparse areas, a pole and the date line."""
    rnd = random.Random(11)
    places = [(i, rnd.uniform(44, 52), rnd.uniform(22, 40)) for i in range(3000)] + [(3000 + i, 45.0, 30.0) for i in range(500)]
    points = [(i, rnd.uniform(-40, -10), rnd.uniform(-75, -40)) for i in range(300)] + [(300 + i, rnd.uniform(44, 52), rnd.uniform(22, 40)) for i in range(300)]
    points += [(600, 89.9, 10.0), (601, -89.9, 0.0), (602, 10.0, 179.99), (603, 10.0, -179.99), (604, 45.0, 30.0)]
    p = spark.createDataFrame(points, "pid int, lat double, lon double")
    g = spark.createDataFrame(places, "row_no int, lat double, lon double")
    for n in (1, 3):
        met = _all_pairs(monkeypatch)
        got = {}
        for r in spatial.nearest(p, g, n).collect():
            got.setdefault(r["pid"], []).append((r["rank"], r["near_row_no"]))
        for pid, lat, lon in points:
            assert [x[1] for x in sorted(got[pid])] == [x[1] for x in sorted((_km((lat, lon), (a, b)), i) for i, a, b in places)[:n]]
        assert met[0] < 100 * len(points)


def test_far_lines_meet_few_points(spark, monkeypatch):
    rnd = random.Random(5)
    line = [(0, 0, i, 25.0 + i / 40, 45.0 + rnd.uniform(0, 5)) for i in range(600)]
    points = [(i, rnd.uniform(-40, -10), rnd.uniform(-75, -40)) for i in range(200)] + [(200 + i, rnd.uniform(44, 52), rnd.uniform(22, 40)) for i in range(200)]
    segments = spatial.line_segments(spark.createDataFrame(line, "line_no int, part_no int, pt_no int, lon double, lat double"))
    met = _all_pairs(monkeypatch)
    got = {r["pid"]: r["line_km"] for r in spatial.closest_on_lines(spark.createDataFrame(points, "pid int, lat double, lon double"), segments).collect()}
    ends = [(r.x1, r.y1, r.x2, r.y2) for r in segments.collect()]

    def to(x, y, x1, y1, x2, y2):
        dx, dy = x2 - x1, y2 - y1
        t = max(0.0, min(1.0, ((x - x1) * dx + (y - y1) * dy) / (dx * dx + dy * dy)))
        return math.hypot(x1 + t * dx - x, y1 + t * dy - y)

    for pid, lat, lon in points:
        x, y = 6378137.0 * math.radians(lon), 6378137.0 * math.log(math.tan(math.pi / 4 + math.radians(lat) / 2))
        assert abs(got[pid] - min(to(x, y, *e) for e in ends) / 1000) < 1e-6
    assert met[0] < 200 * len(points)


def test_within_is_brute_force(spark):
    points, places, p, g = _data(spark)
    for km in (25.0, 900.0):
        got = {(r["pid"], r["near_row_no"]) for r in spatial.within_km(p, g, km).collect()}
        assert got == {(pid, i) for pid, lat, lon in points for i, a, b in places if _km((lat, lon), (a, b)) <= km}


def test_nearest_without_places(spark):
    _, _, p, g = _data(spark)
    assert spatial.nearest(p, g.limit(0), 1).filter("near_row_no is null").count() == p.count()


def test_smallest_and_first_polygon(spark):
    def box(w, s, e, n):
        return [[[(w, s), (e, s), (e, n), (w, n), (w, s)]]]

    hole = [[box(0.0, 0.0, 10.0, 10.0)[0][0], box(4.0, 4.0, 6.0, 6.0)[0][0]]]
    rows = [(0, "big", box(0.0, 0.0, 10.0, 10.0)), (1, "small", box(2.0, 2.0, 3.0, 3.0)), (2, "ring", hole)]
    polys = spark.createDataFrame(rows, "poly_no int, poly_name string, polygons array<array<array<struct<lon:double,lat:double>>>>")
    area = F.aggregate("polygons", F.lit(0.0), lambda a, p: a + spatial.polygon_area(p))
    polys = polys.withColumn("area", area)
    assert {r["poly_name"]: r["area"] for r in polys.collect()} == {"big": 100.0, "small": 1.0, "ring": 96.0}
    pts = spark.createDataFrame([(1, 2.5, 2.5), (2, 5.0, 5.0), (3, 20.0, 20.0), (4, 8.0, 1.0)], "pid int, lat double, lon double")
    first = {r["pid"]: r["poly_name"] for r in spatial.assign_polygon(pts, polys).collect()}
    small = {r["pid"]: r["poly_name"] for r in spatial.assign_polygon(pts, polys, "area").collect()}
    assert first == {1: "big", 2: "big", 3: None, 4: "big"}
    assert small == {1: "small", 2: "big", 3: None, 4: "ring"}


def _inside(lat, lon, ring):
    out = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        if (y1 > lat) != (y2 > lat) and lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1:
            out = not out
    return out


def test_polygon_of_many_corners(spark):
    """100,000 corners, wavy and concave, across the equator; and a long thin one beside it."""
    wavy = []
    for i in range(100_000):
        a = 2 * math.pi * i / 100_000
        r = 5 + math.sin(7 * a) + 0.2 * math.sin(900 * a)
        wavy.append((3.00013 + r * math.cos(a), 0.70021 + 0.6 * r * math.sin(a)))
    thin = [(-20.0, 1.00001), (20.0, 1.30003), (20.0, 1.31003), (-20.0, 1.01001)]
    polys = spark.createDataFrame([(1, [[[(x, y) for x, y in wavy]]]), (2, [[[(x, y) for x, y in thin]]])],
                                  "poly_no int, polygons array<array<array<struct<lon:double,lat:double>>>>")
    rnd = random.Random(2)
    points = [(rnd.uniform(-4, 5), rnd.uniform(-4, 10)) for _ in range(400)] + [(1.16 + rnd.uniform(-0.2, 0.2), rnd.uniform(-21, 21)) for _ in range(200)]
    got = {(r.lat, r.lon, r.poly_no) for r in spatial.in_polygons(spark.createDataFrame(points, "lat double, lon double"), polys).collect()}
    assert got == {(y, x, no) for y, x in points for no, ring in ((1, wavy), (2, thin)) if _inside(y, x, ring)}
    edges, cells, _ = spatial.polygon_grid(polys)
    assert edges.groupBy("poly_no", "band", "col").count().agg(F.max("count")).first()[0] < 300


def test_point_on_a_cell_border_and_holes(spark):
    outer, hole = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)], [(1.0, 1.0), (1.0, 3.0), (3.0, 3.0), (3.0, 1.0)]
    polys = spark.createDataFrame([(1, [[[(x, y) for x, y in outer], [(x, y) for x, y in hole]]])], "poly_no int, polygons array<array<array<struct<lon:double,lat:double>>>>")
    points = [(0.5, 0.5), (0.5, 1.0), (2.0, 2.0), (0.53125, 0.0625), (3.5, 2.0), (2.0, 3.5), (1.5, 0.75), (5.0, 2.0), (-0.01, 2.0)]
    got = {(r.lat, r.lon) for r in spatial.in_polygons(spark.createDataFrame(points, "lat double, lon double"), polys).collect()}
    assert got == {(y, x) for y, x in points if _inside(y, x, outer) and not _inside(y, x, hole)}


def test_no_line_is_infinitely_far(spark):
    none = spark.createDataFrame([], "line_no int, pt_no int, x1 double, y1 double, x2 double, y2 double")
    pts = spark.createDataFrame([(48.0, 31.0)], "lat double, lon double")
    assert spatial.closest_on_lines(pts, none).first()["line_km"] == float("inf")
