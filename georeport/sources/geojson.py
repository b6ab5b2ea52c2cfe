"""GeoJSON: lines, polygons and multilingual names.

A file is one FeatureCollection, or one feature per line (``lines=True``), which Spark can split. One large FeatureCollection
is read by many tasks with ``read_collection``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from georeport.functions.keys import is_latin, split_list, strip
from georeport.sources.order import in_file_order
from georeport.sources.ranges import array_objects

_FEATURE = "struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>"


def read_features(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Features in file order: ``feature_no``, ``properties``, ``type``, ``coordinates`` (JSON text)."""
    if lines:
        rows = spark.read.schema(_FEATURE[7:-1].replace("properties:", "properties ").replace(",geometry:", ", geometry ")).json(path)
        return in_file_order(rows, "feature_no").select("feature_no", "properties", "geometry.type", "geometry.coordinates")
    rows = spark.read.schema(f"features array<{_FEATURE}>").json(path, multiLine=True)
    return rows.select(F.posexplode("features").alias("feature_no", "f")).select(
        "feature_no", "f.properties", "f.geometry.type", "f.geometry.coordinates")


def read_collection(spark: SparkSession, path: str, size: int = 64 << 20) -> DataFrame:
    """Features of one FeatureCollection file in their order, read in byte ranges of ``size``; the columns are those of ``read_features``."""
    rows = array_objects(spark, path, 2, size).select(F.col("no").alias("feature_no"), F.from_json("value", _FEATURE.replace("struct<properties", "struct<type:string,properties", 1)).alias("f"))
    return rows.filter("f.type = 'Feature'").select("feature_no", "f.properties", "f.geometry.type", "f.geometry.coordinates")


def _parse(c: Column, depth: int) -> Column:
    return F.from_json(c, "array<" * depth + "double" + ">" * depth)


def _points(line: Column) -> Column:
    return F.transform(line, lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat")))


def read_lines(features: DataFrame) -> DataFrame:
    """Line points: ``line_no`` of the feature, ``part_no`` within it, ``pt_no``, ``lon``, ``lat``; of polygons the outer rings. Single points are dropped."""
    c, kind = F.col("coordinates"), F.col("type")
    lines = (F.when(kind == "LineString", F.array(_parse(c, 2))).when(kind == "MultiLineString", _parse(c, 3))
             .when(kind == "Polygon", F.slice(_parse(c, 3), 1, 1))
             .when(kind == "MultiPolygon", F.transform(F.filter(_parse(c, 4), lambda p: F.size(p) > 0), lambda p: p[0])))
    rows = features.select(F.col("feature_no").alias("line_no"), F.posexplode(lines).alias("part_no", "line")).filter(F.size("line") >= 2)
    return (rows.select("line_no", "part_no", F.posexplode(_points(F.col("line"))).alias("pt_no", "p"))
            .select("line_no", "part_no", "pt_no", "p.lon", "p.lat"))


def read_polygons(features: DataFrame, admin_level: str | None = None) -> DataFrame:
    """Region polygons with their properties; features without geometry are dropped."""
    c, kind = F.col("coordinates"), F.col("type")
    polygons = F.when(kind == "Polygon", F.array(_parse(c, 3))).when(kind == "MultiPolygon", _parse(c, 4))
    p = F.col("properties")
    rows = features.withColumn("polygons", F.transform(polygons, lambda g: F.transform(g, _points))).filter("polygons is not null")
    if admin_level is not None:
        rows = rows.filter(p["admin_level"] == admin_level)
    return rows.select(F.col("feature_no").alias("poly_no"), p["id"].alias("osm_id"), p["name:en"].alias("poly_name"), p["name"].alias("name_uk"),
                       p["ISO3166-2"].alias("iso"), p["wikidata"].alias("wikidata"), "polygons")


# Name properties in reading order, with the language they count for.
NAME_PROPERTIES = (
    ("ua", "name"), ("ua", "old_name"), ("ua", "alt_name"), ("ua", "name:uk"), ("ua", "old_name:uk"), ("ua", "alt_name:uk"),
    ("ru", "name:ru"), ("ru", "old_name:ru"), ("ru", "alt_name:ru"), ("en", "name:en"), ("en", "old_name:en"), ("en", "alt_name:en"),
)


def read_names(features: DataFrame) -> DataFrame:
    """Names ``qid``, ``lang``, ``name`` with their order. English and ``aliases`` only in Latin letters."""
    p = F.col("properties")
    fields = F.array(*(F.struct(F.lit(i).alias("k"), F.lit(lang).alias("lang"), split_list(p[prop]).alias("names"))
                       for i, (lang, prop) in enumerate(NAME_PROPERTIES)),
                     F.struct(F.lit(len(NAME_PROPERTIES)).alias("k"), F.lit("aliases").alias("lang"), F.coalesce(
                         F.transform(F.from_json(p["aliases"], "array<string>"), strip), F.array().cast("array<string>")).alias("names")))
    rows = features.select("feature_no", strip(F.coalesce(p["wikidata"], F.lit(""))).alias("qid"), F.explode(fields).alias("f")).filter("qid <> ''")
    rows = rows.select("qid", "feature_no", "f.k", "f.lang", F.posexplode("f.names").alias("i", "name")).filter("name <> ''")
    return rows.filter(~F.col("lang").isin("en", "aliases") | is_latin("name")).select("qid", "lang", "name", F.struct("feature_no", "k", "i").alias("ord"))


def merge_names(names: DataFrame) -> DataFrame:
    """Names per qid and language across features, first-seen order, distinct."""
    first = names.groupBy("qid", "lang", "name").agg(F.min("ord").alias("ord"))
    lists = F.transform(F.sort_array(F.collect_list(F.struct("ord", "name"))), lambda x: x["name"])
    return first.groupBy("qid", "lang").agg(lists.alias("names"))
