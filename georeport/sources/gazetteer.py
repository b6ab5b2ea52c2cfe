"""Gazetteer tables on disk: CSV with ``;``-packed lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from georeport.functions.keys import pack_list, split_list, strip
from georeport.sources.order import in_file_order

# Fixed value: column order of the places file.
PLACE_COLUMNS = ("name", "aliases", "place", "wikidata", "region", "ru_group", "usage", "lon", "lat", "cid")


def _read(spark: SparkSession, path: str) -> DataFrame:
    return in_file_order(spark.read.csv(path, header=True, multiLine=False, escape='"'), "row_no")


def _col(df: DataFrame, *names: str, default: str | None = None) -> Column:
    """First of the named columns that the file has."""
    for n in names:
        if n in df.columns:
            return F.col(f"`{n}`")
    return F.lit(default).cast("string")


def read_locales(spark: SparkSession, path: str, source: str = "base") -> DataFrame:
    df = _read(spark, path)
    return df.select(
        "row_no", F.trim("cid").cast("long").alias("cid"), "name", split_list("aliases").alias("aliases"),
        F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"), _col(df, "region").alias("region"),
        _col(df, "ru_group").alias("grp"), _col(df, "place").alias("place"), _col(df, "wikidata").alias("qid"),
        F.coalesce(_col(df, "usage").cast("int"), F.lit(0)).alias("usage"), F.lit(source).alias("source"))


def read_with_patch(spark: SparkSession, path: str, patch: str) -> DataFrame:
    """Places with those of a patch file after them."""
    base, more = read_locales(spark, path), read_locales(spark, patch, "patch")
    shifted = more.withColumn("row_no", F.col("row_no") + (1 << 62))
    return base.unionByName(shifted)


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    df = _read(spark, path)
    return df.select("row_no", "name", _col(df, "wikidata").alias("qid"), _col(df, "iso3166_2").alias("iso3166_2"),
                     split_list(_col(df, "aliases")).alias("aliases"), split_list(_col(df, "neighbors")).alias("neighbors"))


def read_groups(spark: SparkSession, path: str) -> DataFrame:
    df = _read(spark, path)
    return df.select("row_no", "name", F.trim("group_id").cast("int").alias("group_id"),
                     *(split_list(_col(df, c)).alias(c) for c in ("aliases", "regions", "neighbors")))


def read_directions(spark: SparkSession, path: str, locales: DataFrame) -> DataFrame:
    """Directions with their anchor id; an anchor that is no known place is an error.

    The anchor column may be called ``anchor`` or ``cid``, the name ``name`` or ``direction``.
    """
    df = _read(spark, path)
    rows = df.select("row_no", strip(_col(df, "name", "direction")).alias("name"),
                     strip(_col(df, "anchor", "cid")).cast("long").alias("anchor_cid"), split_list(_col(df, "aliases")).alias("aliases"))
    return attach_anchor(rows, locales)


def attach_anchor(directions: DataFrame, locales: DataFrame) -> DataFrame:
    places = locales.select(F.col("cid").alias("anchor_cid"), F.struct("name", "lat", "lon").alias("anchor"),
                            (F.col("row_no") if "row_no" in locales.columns else F.lit(0)).alias("row_no"))
    places = places.groupBy("anchor_cid").agg(F.max_by("anchor", F.struct("row_no", "anchor")).alias("anchor"))
    problem = F.concat(F.lit("direction anchor is no known place: "), F.coalesce(F.col("anchor_cid").cast("string"), F.lit("none")))
    return (directions.join(places, "anchor_cid", "left")
            .withColumn("anchor", F.when(F.col("anchor").isNull(), F.raise_error(problem)).otherwise(F.col("anchor"))))


def place_rows(locales: DataFrame) -> DataFrame:
    """Places in the column order of the file, lists packed."""
    out = locales.withColumn("aliases", pack_list("aliases"))
    names = {"wikidata": "qid", "ru_group": "grp"}
    return out.select(*(F.col(names.get(c, c)).alias(c) for c in PLACE_COLUMNS))


def write_locales(locales: DataFrame, path: str) -> None:
    place_rows(locales).write.csv(path, header=True, escape='"')
