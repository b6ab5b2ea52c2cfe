"""Nearest, radius, polygon and polyline joins without nested loops.

The map is cut in square cells at several levels: a cell of level ``j`` is ``width / 2**j``
wide. Two grids meet before points do: cells of points and occupied cells of items, each with the box of what it
holds, so every pair of cells has a least and a greatest distance. A cell whose least distance exceeds the greatest one of cells
that hold enough items is dropped. Pairs of cells are found by equi-joins on cell numbers, at a level chosen from
counts per area; where a cell of points still faces many items (far points, empty areas), both its cells and theirs are cut finer, until few are
left. So a point meets a bounded number of items however far they are. Nothing is cut off. Points with equal
coordinates are searched once, and of items with equal coordinates only as many as can be asked for.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from georeport.functions.geo import (
    LOOKUP_RADIUS_KM, MERCATOR_HALF_M, foot, lookup_km,
    mercator_lat, mercator_lon, mercator_x, mercator_y,
)
from georeport.operators.common import dealt_join, written

# Grid levels in use: every second one, so a refinement cuts a cell in 16.
FINEST, STEP = 14, 2
SPHERE, PLANE = "sphere", "plane"
_WIDTH = {SPHERE: 360.0, PLANE: 2 * MERCATOR_HALF_M}
_PIECE_M = 20_000.0


def _fine_x(space: str, x: Column) -> Column:
    shift = 180.0 if space == SPHERE else MERCATOR_HALF_M
    cell = F.floor((x + shift) / (_WIDTH[space] / 2**FINEST)).cast("long")
    return F.pmod(cell, F.lit(2**FINEST)) if space == SPHERE else cell


def _fine_y(space: str, y: Column) -> Column:
    shift = 90.0 if space == SPHERE else MERCATOR_HALF_M
    return F.floor((y + shift) / (_WIDTH[space] / 2**FINEST)).cast("long")


def _cell(level: Column, cx: Column, cy: Column) -> Column:
    return level.cast("long") * (1 << 40) + cy * (1 << 20) + cx


def _coarser(fine: Column, level: Column) -> Column:
    return F.floor(fine / F.pow(F.lit(2.0), FINEST - level)).cast("long")


def _around(cells: DataFrame, space: str, cx: str, cy: str, ring: int) -> DataFrame:
    """Each cell (at level ``_l``) once per cell around it, ``_wx``, ``_wy``; itself included, none twice."""
    most = F.pow(F.lit(2.0), F.col("_l")).cast("long")
    across = F.least(F.lit(2 * ring), most - 1) if space == SPHERE else F.lit(2 * ring).cast("long")
    x = F.col(cx) - ring + F.col("_d")
    out = cells.withColumn("_d", F.explode(F.sequence(F.lit(0).cast("long"), across))).withColumn("_wx", F.pmod(x, most) if space == SPHERE else x)
    return out.withColumn("_d", F.explode(F.sequence(F.lit(-ring).cast("long"), F.lit(ring).cast("long")))).withColumn("_wy", F.col(cy) + F.col("_d")).drop("_d")


def _level_for(space: str, reach: Column) -> Column:
    """Finest level in use whose cells are at least ``reach`` wide."""
    level = (F.floor(F.log2(F.lit(_WIDTH[space]) / reach) / STEP) * STEP).cast("int")
    return F.greatest(F.lit(0), F.least(F.lit(FINEST), level))


def _reach(space: str, dist: Column, fine_y: Column) -> Column:
    """Extent in either axis of everything within ``dist`` (degrees or metres)."""
    if space == PLANE:
        return dist * 1.0001
    step = _WIDTH[SPHERE] / 2**FINEST
    low = fine_y * step - 90.0
    top = F.greatest(F.abs(low), F.abs(low + step)) + dist
    ratio = F.sin(F.radians(F.least(dist, F.lit(90.0)) / 2)) / F.cos(F.radians(F.least(top, F.lit(89.9))))
    lon = F.degrees(2 * F.asin(F.least(F.lit(1.0), ratio)))
    return F.when(top >= 89.9, F.lit(360.0)).otherwise(F.greatest(dist, lon) * 1.0001)


_BOX = ("x0", "x1", "y0", "y1")


def _boxed(prefix: str, to: str) -> list[Column]:
    """Box of boxes."""
    return [(F.min if c.endswith("0") else F.max)(prefix + c).alias(to + c) for c in _BOX]


def _hav(degrees: Column) -> Column:
    return F.pow(F.sin(F.radians(degrees) / 2), 2)


def _measure(space: str, dist: Column) -> Column:
    """A distance (degrees or metres) in the form in which pairs of boxes are compared: haversine or square."""
    return _hav(F.least(dist, F.lit(180.0))) if space == SPHERE else dist * dist


def _apart(space: str) -> tuple[Column, Column]:
    """Least and greatest distance between the boxes ``_p*`` of points and ``_i*`` of items; bounds on a sphere."""
    p, i = ({c: F.col(f"_{side}{c}") for c in _BOX} for side in "pi")
    zero = F.lit(0.0)
    gap = {a: F.greatest(zero, p[a + "0"] - i[a + "1"], i[a + "0"] - p[a + "1"]) for a in "xy"}
    span = {a: F.greatest(p[a + "1"], i[a + "1"]) - F.least(p[a + "0"], i[a + "0"]) for a in "xy"}
    if space == PLANE:
        return gap["x"] * gap["x"] + gap["y"] * gap["y"], span["x"] * span["x"] + span["y"] * span["y"]

    def high(b: dict) -> Column:
        return F.cos(F.radians(F.greatest(F.abs(b["y0"]), F.abs(b["y1"]))))

    def low(b: dict) -> Column:
        return F.when((b["y0"] <= 0) & (b["y1"] >= 0), F.lit(1.0)).otherwise(F.cos(F.radians(F.least(F.abs(b["y0"]), F.abs(b["y1"])))))

    around = F.least(gap["x"], F.greatest(zero, 360.0 - span["x"]))
    return (_hav(gap["y"]) + high(p) * high(i) * _hav(around),
            F.least(F.lit(1.0), _hav(span["y"]) + low(p) * low(i) * _hav(F.least(span["x"], F.lit(180.0)))))


def _levels() -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(FINEST), F.lit(STEP))).alias("_l")


def _grid(items: DataFrame, by: list[str], space: str) -> DataFrame:
    """Occupied cells of items at all levels, with counts and boxes."""
    each = items.select(*by, "_fx", "_fy", *(f"_i{c}" for c in _BOX), _levels())
    return (each.groupBy(*by, "_l", _coarser(F.col("_fx"), F.col("_l")).alias("_cx"), _coarser(F.col("_fy"), F.col("_l")).alias("_cy"))
            .agg(F.count("*").alias("_k"), *_boxed("_i", "_i")))


def _enough(fine: DataFrame, grid: DataFrame, n: int, by: list[str], space: str, slack: float) -> DataFrame:
    """Search level ``_l`` and radius ``_r`` of each fine cell of points, from counts of items per 3 x 3 cells."""
    good = (_around(grid.select(*by, "_k", "_l", "_cx", "_cy"), space, "_cx", "_cy", 1)
            .groupBy(*by, "_l", "_wx", "_wy").agg(F.sum("_k").alias("_k")).filter(F.col("_k") >= n).select(*by, "_l", "_wx", "_wy"))
    best = (fine.select(*by, "_fx", "_fy", _levels())
            .withColumn("_wx", _coarser(F.col("_fx"), F.col("_l"))).withColumn("_wy", _coarser(F.col("_fy"), F.col("_l")))
            .join(good, [*by, "_l", "_wx", "_wy"])
            .groupBy(*by, "_fx", "_fy").agg(F.max("_l").alias("_l")))
    step = F.lit(_WIDTH[space]) / F.pow(F.lit(2.0), F.coalesce(F.col("_l"), F.lit(0)))
    dist = step * (2 * math.sqrt(2)) + slack
    return (fine.join(best, [*by, "_fx", "_fy"], "left")
            .withColumn("_r", F.when(F.col("_l").isNull(), F.lit(float("inf"))).otherwise(_measure(space, dist)))
            .withColumn("_l", F.when(F.col("_l").isNull(), F.lit(0)).otherwise(_level_for(space, _reach(space, dist, F.col("_fy"))))))


#: Items that a cell of points may face before both are cut finer.
FEW = 256
_SLACK = 1 + 1e-6


def _kept(pairs: DataFrame, cell: list[str], n: int | None, space: str) -> DataFrame:
    """Pairs of cells that may hold an answer, with the number ``_t`` of items that a cell of points faces."""
    least, greatest = _apart(space)
    pairs = pairs.withColumn("_least", least).filter(F.col("_least") <= F.col("_r") * _SLACK)
    w = W.partitionBy(*cell)
    if n is not None:
        reached = F.sum("_k").over(w.orderBy("_most").rowsBetween(W.unboundedPreceding, 0))
        pairs = pairs.withColumn("_most", greatest).withColumn("_sum", reached)
        bound = F.min(F.when(F.col("_sum") >= n, F.col("_most"))).over(w)
        pairs = pairs.withColumn("_b", bound).filter(F.col("_b").isNull() | (F.col("_least") <= F.col("_b") * _SLACK))
    return pairs.withColumn("_t", F.sum("_k").over(w)).select(*cell, "_cx", "_cy", "_t")


def _pairs(points: DataFrame, items: DataFrame, by: list[str], space: str, n: int | None = None, slack: float = 0.0,
           within: float | None = None) -> DataFrame:
    """Points with the items that may be among their ``n`` nearest, or ``within`` a distance (degrees).

    Points have ``_px``, ``_py``, items boxes ``_ix0`` and so on; both have fine cells.
    """
    grid = written(_grid(items, by, space), "grid")
    box = [F.min("_px").alias("_px0"), F.max("_px").alias("_px1"), F.min("_py").alias("_py0"), F.max("_py").alias("_py1")]
    fine = points.groupBy(*by, "_fx", "_fy").agg(*box)
    if n is None:
        level = _level_for(space, _reach(space, F.lit(within), F.col("_fy")))
        fine = fine.withColumn("_l", level).withColumn("_r", _measure(space, F.lit(within)))
    else:
        fine = _enough(fine, grid, n, by, space, slack)
    cell = [*by, "_l", "_sx", "_sy"]

    def at_level(cells: DataFrame, level: Column) -> DataFrame:
        return (cells.withColumn("_l", level).withColumn("_sx", _coarser(F.col("_fx"), F.col("_l")))
                .withColumn("_sy", _coarser(F.col("_fy"), F.col("_l"))))

    # Cells a quarter as wide as the reach, so what is out of reach is left out well.
    cells = written(at_level(fine, F.least(F.col("_l") + STEP, F.lit(FINEST))), "cells")
    boxed = [*_boxed("_p", "_p"), F.max("_r").alias("_r")]
    first = _around(cells.groupBy(*cell).agg(*boxed), space, "_sx", "_sy", 4).withColumnsRenamed({"_wx": "_cx", "_wy": "_cy"})
    many = (F.col("_t") > FEW) & (F.col("_l") < FINEST) if n is not None else F.lit(False)

    def told(links: DataFrame) -> tuple[DataFrame, bool, int]:
        """Links, whether cells face many items, and the levels of the others as bits; seen while the table is written."""
        seen = Observation()
        bits = F.call_function("shiftleft", F.lit(1), F.when(many, F.lit(31)).otherwise(F.col("_l")))
        links = written(links.observe(seen, F.bit_or(bits).alias("bits")), "links")
        found = seen.get["bits"] or 0
        return links, found < 0, found & 0x7FFFFFFF

    links, more, levels = told(_kept(first.join(grid, [*by, "_l", "_cx", "_cy"]), cell, n, space))
    found: list[tuple[DataFrame, DataFrame]] = []
    while more:
        open_ = links.filter(many)
        found.append((cells.join(open_.select(*cell).distinct(), cell, "left_anti"), links.filter(~many)))
        up = [F.col("_sx").alias("_ux"), F.col("_sy").alias("_uy")]
        inner = cells.join(open_.select(*cell).distinct(), cell, "left_semi").select("*", F.col("_l").alias("_ul"), *up).drop("_sx", "_sy")
        inner = at_level(inner, F.col("_ul") + STEP)
        finer = inner.groupBy(*cell, "_ul", "_ux", "_uy").agg(*boxed)
        above = open_.select(*by, F.col("_l").alias("_ul"), F.col("_sx").alias("_ux"), F.col("_sy").alias("_uy"), F.col("_cx").alias("_wx"), F.col("_cy").alias("_wy"))
        below = grid.withColumn("_wx", F.floor(F.col("_cx") / 2**STEP)).withColumn("_wy", F.floor(F.col("_cy") / 2**STEP))
        pairs = finer.join(above, [*by, "_ul", "_ux", "_uy"]).join(below, [*by, "_l", "_wx", "_wy"])
        cells = written(inner.drop("_ul", "_ux", "_uy"), "cells")
        links, more, finer_levels = told(_kept(pairs, cell, n, space))
        levels |= finer_levels
    found.append((cells, links))

    def numbered(turn: int, df: DataFrame, *rest: Column) -> DataFrame:
        # A cell may come up in two rounds, with other points.
        return df.select(*by, _cell(F.col("_l") + 64 * turn, F.col("_sx"), F.col("_sy")).alias("_s"), *rest)

    searched = _all([numbered(i, part, F.col("_fx"), F.col("_fy")) for i, (part, _) in enumerate(found)])
    linked = _all([numbered(i, part, _cell(F.col("_l"), F.col("_cx"), F.col("_cy")).alias("_c")) for i, (_, part) in enumerate(found)])
    used = F.explode(F.array(*(F.lit(x) for x in range(FINEST + 1) if levels >> x & 1 or not levels and x == 0))).alias("_l")
    placed = (items.select("*", used).withColumn("_c", _cell(F.col("_l"), _coarser(F.col("_fx"), F.col("_l")), _coarser(F.col("_fy"), F.col("_l"))))
              .drop("_l", "_fx", "_fy", *(f"_i{c}" for c in _BOX)))
    located = points.join(searched, [*by, "_fx", "_fy"])
    return located.join(placed.join(linked, [*by, "_c"]).drop("_c"), [*by, "_s"]).drop("_fx", "_fy", "_s", "_px", "_py")


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _place(df: DataFrame, space: str, x: str, y: str) -> DataFrame:
    return df.withColumn("_fx", _fine_x(space, F.col(x))).withColumn("_fy", _fine_y(space, F.col(y)))


def _rename(df: DataFrame, keep: Sequence[str], prefix: str) -> DataFrame:
    return df.select(*(F.col(c).alias(c if c in keep else prefix + c) for c in df.columns))


def _asked(points: DataFrame, by: list[str]) -> DataFrame:
    spots = points.select(*by, "lat", "lon").dropna().distinct()
    return _place(spots, SPHERE, "lon", "lat").withColumn("_px", F.col("lon")).withColumn("_py", F.col("lat"))


def _offered(places: DataFrame, by: list[str], prefix: str) -> DataFrame:
    boxes = places.select("*", *(F.col("lon" if c[0] == "x" else "lat").alias(f"_i{c}") for c in _BOX)).dropna(subset=["lat", "lon"])
    return _rename(_place(boxes, SPHERE, "lon", "lat"), [*by, "_fx", "_fy", *(f"_i{c}" for c in _BOX)], prefix)


def nearest(points: DataFrame, places: DataFrame, n: int, by: Sequence[str] = (),
            prefix: str = "near_") -> DataFrame:
    """The ``n`` nearest places of each point, as rows ``rank`` 1..n with ``km``.

    Both sides have ``lat`` and ``lon``; places have ``row_no``, which decides ties. Place columns get
    ``prefix``. Points without any place keep one row of nulls; places without coordinates are left out.
    """
    by = list(by)
    rest = [c for c in places.columns if c not in (*by, "lat", "lon", "row_no")]
    if n == 1:
        same = places.groupBy(*by, "lat", "lon").agg(F.min(F.struct("row_no", *rest)).alias("s")).select(*by, "lat", "lon", "s.*")
    else:
        first = F.row_number().over(W.partitionBy(*by, "lat", "lon").orderBy("row_no"))
        same = places.withColumn("_no", first).filter(F.col("_no") <= n).drop("_no")
    items = _offered(same, by, prefix)
    pairs = _pairs(_asked(points, by), items, by, SPHERE, n)
    pairs = pairs.withColumn("km", lookup_km(F.col("lat"), F.col("lon"), F.col(prefix + "lat"), F.col(prefix + "lon")))
    point = [*by, "lat", "lon"]
    got = [prefix + c for c in ("lat", "lon", *rest)]
    if n == 1:
        best = (pairs.groupBy(*point).agg(F.min(F.struct("km", prefix + "row_no", *got)).alias("s"))
                .select(*point, "s.*").withColumn("rank", F.lit(1)))
    else:
        w = W.partitionBy(*point).orderBy("km", prefix + "row_no")
        best = pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
    return points.join(best, point, "left")


def within_km(points: DataFrame, places: DataFrame, km: float, prefix: str = "near_", digits: int | None = None) -> DataFrame:
    """All places within a distance of each point, with ``km``, rounded to ``digits`` where given.

    Places are found, measured and rounded once per spot, then dealt to its points.
    """
    pairs = _pairs(_asked(points, []), _offered(places, [], prefix), [], SPHERE, within=math.degrees(km / LOOKUP_RADIUS_KM))
    dist = lookup_km(F.col("lat"), F.col("lon"), F.col(prefix + "lat"), F.col(prefix + "lon"))
    found = pairs.withColumn("km", dist).filter(F.col("km") <= km)
    if digits is not None:
        found = found.withColumn("km", F.round("km", digits))
    # Numbers tell spots apart before the join, their coordinates after it.
    spot = F.xxhash64("lat", "lon")
    asked = points.select("lat", "lon", *(c for c in points.columns if c not in ("lat", "lon"))).filter("lat is not null and lon is not null")
    met = dealt_join(asked.withColumn("_spot", spot), found.withColumn("_spot", spot).withColumnsRenamed({"lat": "_lat", "lon": "_lon"}), ["_spot"])
    return met.filter("lat - _lat = 0 and lon - _lon = 0").drop("_spot", "_lat", "_lon")


# ---------------------------------------------------------------- polygons

# Cells of the polygon grid, in degrees; runs of inner cells are kept in blocks of these many cells.
_SIDE = 1 / 32
_BLOCKS = tuple(8**i for i in range(5))


def ring_edges(ring: Column) -> Column:
    """Consecutive corner pairs of a ring; the closing edge is added when it is missing."""
    nxt = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    return F.zip_with(ring, nxt, lambda a, b: F.struct(
        a["lon"].alias("x1"), a["lat"].alias("y1"), b["lon"].alias("x2"), b["lat"].alias("y2")))


def ring_area(ring: Column) -> Column:
    total = F.aggregate(ring_edges(ring), F.lit(0.0),
                        lambda acc, e: acc + (e["x1"] * e["y2"] - e["x2"] * e["y1"]))
    return F.abs(total) / 2


def polygon_area(polygon: Column) -> Column:
    """Outer ring less holes, in square degrees."""
    areas = F.transform(polygon, ring_area)
    return F.aggregate(areas, F.lit(0.0), lambda a, x: a - x) + 2 * F.coalesce(F.get(areas, F.lit(0)), F.lit(0.0))


def _row(c: Column) -> Column:
    return F.floor(c / _SIDE).cast("long")


def polygon_grid(polygons: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges by cell (``band``, ``col``), cells with the number of crossings further east, and blocks of cells without an edge inside.

    An edge is only in the cells that it passes. Along the middle line of a band, ``east`` counts the edges that cross it in cells
    further east, so whether the middle of a cell is inside is known without them.
    """
    corners = F.flatten(F.flatten(F.transform("polygons", lambda p: F.transform(p, ring_edges))))
    edge = polygons.select("poly_no", F.explode(corners).alias("e")).select("poly_no", "e.*").filter("x1 <> x2 or y1 <> y2")
    top, bottom = F.greatest("y1", "y2"), F.least("y1", "y2")

    def x_at(y: Column) -> Column:
        return F.when(F.col("y1") == F.col("y2"), F.col("x1")).otherwise(F.col("x1") + (y - F.col("y1")) / F.nullif(F.col("y2") - F.col("y1"), F.lit(0.0)) * (F.col("x2") - F.col("x1")))

    low, high = F.greatest(bottom, F.col("band") * _SIDE), F.least(top, (F.col("band") + 1) * _SIDE)
    flat = F.col("y1") == F.col("y2")
    west, east = (F.when(flat, pick("x1", "x2")).otherwise(pick(x_at(low), x_at(high))) for pick in (F.least, F.greatest))
    middle = (F.col("band") + 0.5) * _SIDE
    cut = x_at(middle)
    edges = (edge.withColumn("band", F.explode(F.sequence(_row(bottom), _row(top))))
             .withColumn("cut", F.when((F.col("y1") > middle) != (F.col("y2") > middle), cut))
             # A hair wider, so that no rounding leaves out a cell.
             .withColumn("col", F.explode(F.sequence(_row(west - 1e-9), _row(east + 1e-9)))))
    edges = written(edges.withColumn("cut", F.when(_row(F.col("cut")) == F.col("col"), F.col("cut"))), "edges")
    w = W.partitionBy("poly_no", "band").orderBy(F.desc("col"))
    cells = (edges.groupBy("poly_no", "band", "col").agg(F.count("cut").alias("k"))
             .withColumn("east", F.coalesce(F.sum("k").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
             .withColumn("next", F.lag("col").over(w)))
    cells = written(cells.select("poly_no", "band", "col", "east", "next"), "edge-cells")
    return edges.drop("k"), cells.select("poly_no", "band", "col", "east"), _inner_blocks(cells)


def _inner_blocks(cells: DataFrame) -> DataFrame:
    """Runs of inner cells between two cells with edges, as aligned blocks (``size``, ``block``) of a band."""
    runs = cells.filter("next > col + 1 and east % 2 = 1").select("poly_no", "band", (F.col("col") + 1).alias("a"), F.col("next").alias("b"))
    parts = []
    for size, wider in zip(_BLOCKS, (*_BLOCKS[1:], None)):
        # What wider blocks leave over at both ends; all of it for the widest.
        a, b = F.ceil(F.col("a") / size), F.floor(F.col("b") / size)
        if wider is None:
            spans = F.array(F.struct(a.alias("from"), (b - 1).alias("to")))
        else:
            inner_a, inner_b = F.ceil(F.col("a") / wider) * (wider // size), F.floor(F.col("b") / wider) * (wider // size)
            held = inner_a < inner_b
            spans = F.when(held, F.array(F.struct(a.alias("from"), (inner_a - 1).alias("to")), F.struct(inner_b.alias("from"), (b - 1).alias("to")))).otherwise(
                F.array(F.struct(a.alias("from"), (b - 1).alias("to"))))
        one = runs.select("poly_no", "band", F.explode(spans).alias("s")).filter("s.from <= s.to")
        parts.append(one.select("poly_no", "band", F.lit(size).alias("size"), F.explode(F.sequence(F.col("s.from"), F.col("s.to"))).alias("block")))
    return _all(parts)


def in_polygons(points: DataFrame, polygons: DataFrame) -> DataFrame:
    """Pairs of point and polygon that holds it. Polygons: ``poly_no``, ``polygons``.

    In a cell without edges a point is inside where the cell is. Elsewhere it goes straight up or down to the
    middle line of its band and east from there: it meets the edges of its own cell only, the rest is a number.
    """
    edges, cells, blocks = polygon_grid(polygons)
    queries = (points.select("lat", "lon").dropna().distinct()
               .withColumn("band", _row(F.col("lat"))).withColumn("col", _row(F.col("lon"))))
    middle = (F.col("band") + 0.5) * _SIDE
    east = (F.col("cut") > F.col("lon")).cast("int")
    y = F.col("y1") + (F.col("lon") - F.col("x1")) / F.nullif(F.col("x2") - F.col("x1"), F.lit(0.0)) * (F.col("y2") - F.col("y1"))
    between = ((F.col("x1") > F.col("lon")) != (F.col("x2") > F.col("lon"))) & ((y > F.col("lat")) != (y > middle))
    met = (queries.join(edges, ["band", "col"])
           .groupBy("lat", "lon", "band", "col", "poly_no").agg(F.sum(F.coalesce(east, F.lit(0)) + F.coalesce(between, F.lit(False)).cast("int")).alias("n")))
    near = met.join(cells, ["poly_no", "band", "col"]).filter((F.col("n") + F.col("east")) % 2 == 1).select("lat", "lon", "poly_no")
    sizes = F.explode(F.array(*(F.lit(s) for s in _BLOCKS)))
    asked = queries.withColumn("size", sizes).withColumn("block", F.floor(F.col("col") / F.col("size")))
    return near.unionByName(asked.join(blocks, ["band", "size", "block"]).select("lat", "lon", "poly_no"))


def assign_polygon(points: DataFrame, polygons: DataFrame, order: str = "poly_no",
                   columns: Sequence[str] = ("poly_name",)) -> DataFrame:
    """First polygon (by ``order``) that holds a point, with ``confirmed``; unmatched points stay."""
    attrs = polygons.select("poly_no", F.struct(F.col(order).alias("_o"), "poly_no", *columns).alias("_a"))
    best = in_polygons(points, polygons).join(attrs, "poly_no").groupBy("lat", "lon").agg(F.min("_a").alias("_a"))
    out = points.join(best, ["lat", "lon"], "left")
    out = out.select(*points.columns, *(F.col(f"_a.{c}").alias(c) for c in columns), F.col("_a").isNotNull().alias("confirmed"))
    return out


# ---------------------------------------------------------------- polylines


def _line(df: DataFrame) -> list[str]:
    return [c for c in ("line_no", "part_no") if c in df.columns]


def line_segments(lines: DataFrame) -> DataFrame:
    """Points ``lon``, ``lat`` numbered ``pt_no`` in ``line_no`` (and ``part_no``, where a line has parts) to mercator segments."""
    w = W.partitionBy(*_line(lines)).orderBy("pt_no")
    xy = lines.withColumn("x1", mercator_x(F.col("lon"))).withColumn("y1", mercator_y(F.col("lat")))
    return (xy.withColumn("x2", F.lead("x1").over(w)).withColumn("y2", F.lead("y1").over(w))
            .filter(F.col("x2").isNotNull())
            .select(*(c for c in lines.columns if c not in ("lon", "lat")), "x1", "y1", "x2", "y2"))


def closest_on_lines(points: DataFrame, segments: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Planar mercator distance ``line_km`` and closest line point ``line_lat``, ``line_lon``.

    Long segments are entered in the grid in pieces, each keeping its whole segment, so
    the distance is exact. ``by`` limits a point to the lines with the same columns.
    Without any line the distance is infinite.
    """
    by = list(by)
    length = F.sqrt(F.pow(F.col("x2") - F.col("x1"), 2) + F.pow(F.col("y2") - F.col("y1"), 2))
    pieces = F.greatest(F.lit(1), F.ceil(length / _PIECE_M)).cast("int")

    def along(axis: str, place: Column) -> Column:
        return F.col(axis + "1") + place * (F.col(axis + "2") - F.col(axis + "1"))

    start, middle, end = ((F.col("_i") - back) / F.col("_n") for back in (1.0, 0.5, 0.0))
    line = _line(segments)
    items = (segments.select(*by, *line, "pt_no", "x1", "y1", "x2", "y2", pieces.alias("_n"))
             .withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_n"))))
             .withColumn("_mx", along("x", middle)).withColumn("_my", along("y", middle)))
    for axis in "xy":
        items = (items.withColumn(f"_i{axis}0", F.least(along(axis, start), along(axis, end)) - 1e-6)
                 .withColumn(f"_i{axis}1", F.greatest(along(axis, start), along(axis, end)) + 1e-6))
    items = _place(items, PLANE, "_mx", "_my").drop("_n", "_i", "_mx", "_my")
    queries = (points.select(*by, "lat", "lon").dropna().distinct()
               .withColumn("_x", mercator_x(F.col("lon"))).withColumn("_y", mercator_y(F.col("lat"))))
    queries = _place(queries, PLANE, "_x", "_y").withColumn("_px", F.col("_x")).withColumn("_py", F.col("_y"))
    pairs = _pairs(queries, items, by, PLANE, 1, slack=_PIECE_M / 2)
    seg = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    pairs = (pairs.withColumn("_t", foot(F.col("_x"), F.col("_y"), *seg))
             .withColumn("_cx", F.col("x1") + F.col("_t") * (F.col("x2") - F.col("x1")))
             .withColumn("_cy", F.col("y1") + F.col("_t") * (F.col("y2") - F.col("y1")))
             .withColumn("_m", F.sqrt(F.pow(F.col("_cx") - F.col("_x"), 2) + F.pow(F.col("_cy") - F.col("_y"), 2))))
    best = pairs.groupBy(*by, "lat", "lon").agg(F.min(F.struct("_m", *line, "pt_no", "_cx", "_cy")).alias("s"))
    best = best.select(*by, "lat", "lon", (F.col("s._m") / 1000.0).alias("_km"),
                       mercator_lat(F.col("s._cy")).alias("line_lat"), mercator_lon(F.col("s._cx")).alias("line_lon"))
    return (points.join(best, [*by, "lat", "lon"], "left")
            .withColumn("line_km", F.when(F.col("lat").isNotNull(), F.coalesce("_km", F.lit(float("inf"))))).drop("_km"))


def polygon_reach(points: DataFrame, polygons: DataFrame, by: Sequence[str]) -> DataFrame:
    """Distance in metres from a point to the polygon sharing its ``by`` columns, 0 inside.

    The boundary distance is planar mercator, as for lines. Null when there is no polygon.
    """
    by = list(by)
    corners = polygons.select(*by, "poly_no", F.posexplode(F.flatten("polygons")).alias("ring_no", "ring"))
    rings = (corners.select(*by, F.col("poly_no").alias("line_no"), F.col("ring_no").alias("part_no"),
                            F.posexplode(F.concat("ring", F.slice("ring", 1, 1))).alias("pt_no", "p"))
             .select(*by, "line_no", "part_no", "pt_no", "p.lon", "p.lat"))
    near = closest_on_lines(points, line_segments(rings), by)
    held = in_polygons(points, polygons).join(polygons.select(*by, "poly_no"), "poly_no")
    held = held.groupBy(*by, "lat", "lon").agg(F.lit(True).alias("inside"))
    return (near.join(held, [*by, "lat", "lon"], "left")
            .withColumn("inside", F.coalesce("inside", F.lit(False)))
            .withColumn("area_m", F.when(F.col("inside"), F.lit(0.0))
                        .when(F.col("line_km") < float("inf"), F.col("line_km") * 1000.0))
            .drop("line_km", "line_lat", "line_lon"))
