"""Gazetteer upkeep: aliases, labels, ids and regions of places.

List work stays inside the row; other tables are only joined by id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from georeport.functions.keys import (
    CYRILLIC, alias_key, compare_key, cyrillic_to_latin, is_latin, location_key, sorted_pack, split_list, strip,
)
from georeport.operators.common import let, written
from georeport.operators.spatial import assign_polygon, polygon_area
from georeport.operators.spelling import Spelling, with_exonyms

_NONE = "array<string>"


def _empty() -> Column:
    return F.array().cast(_NONE)


def _append_new(existing: Column, additions: Column) -> Column:
    """Append normalized additions whose key is new, in order."""
    def fresh(keys: Column) -> Column:
        return F.filter(F.transform(additions, alias_key), lambda x: (x != "") & ~F.array_contains(keys, x))

    return F.concat(existing, F.array_distinct(let(F.transform(existing, alias_key), fresh)))


def normalize_aliases(cell: Column) -> Column:
    """Latin aliases only, as location keys, distinct and sorted."""
    keys = F.transform(F.filter(split_list(cell), is_latin), location_key)
    return sorted_pack(F.filter(keys, lambda x: x != ""))


def append_exonyms(places: DataFrame, ru_names: DataFrame, rules: Spelling) -> DataFrame:
    """Add Latin forms of Cyrillic aliases and Russian-style spellings to ``aliases`` (packed). ``row_no`` tells places apart.

    ``ru_names``: qid, name_ru, ord; the last non-empty one of a qid counts. The rule-based
    spelling is used only when neither the name table nor the qid gives one.
    """
    ru = (ru_names.filter(strip(F.coalesce("name_ru", F.lit(""))) != "").groupBy("qid")
          .agg(strip(cyrillic_to_latin(strip(F.max_by("name_ru", "ord")))).alias("_ru")))
    rows = places.withColumn("_q", strip(F.coalesce("qid", F.lit("")))).join(ru.withColumnRenamed("qid", "_q"), "_q", "left")
    rows = with_exonyms(rows, F.array(location_key(strip("name"))), rules)
    by_qid = F.when(F.coalesce("_ru", F.lit("")) != "", F.array("_ru")).otherwise(_empty())
    known = F.concat(F.flatten("whole"), by_qid)
    existing = split_list("aliases")
    cyrillic = F.transform(F.filter(existing, lambda a: a.rlike(CYRILLIC)), cyrillic_to_latin)
    rows = rows.withColumn("_existing", existing).withColumn("_new", F.concat(cyrillic, F.when(F.size(known) > 0, known).otherwise(F.flatten("spelled"))))
    packed = F.array_join(_append_new(F.col("_existing"), F.col("_new")), ";")
    named = strip(F.coalesce("name", F.lit(""))) != ""
    return rows.withColumn("aliases", F.when(named, packed).otherwise(F.col("aliases"))).select(places.columns)


def _spellings() -> Column:
    """Per text what the name table gives, else the spelling by words."""
    return F.flatten(F.zip_with("whole", "spelled", lambda w, s: F.when(F.size(w) > 0, w).otherwise(s)))


def label_places(places: DataFrame, labels: DataFrame) -> DataFrame:
    """Left join of places with labels (qid, en, uk, ru, ord); the last label row of a qid counts."""
    last = labels.groupBy("qid").agg(F.max_by(F.struct("en", "uk", "ru"), "ord").alias("_l")).withColumnRenamed("qid", "_q")
    rows = places.withColumn("_q", strip(F.coalesce("qid", F.lit("")))).join(last, "_q", "left")
    return rows.select(*places.columns, *(F.coalesce(f"_l.{x}", F.lit("")).alias(f"label_{x}") for x in ("en", "uk", "ru")))


def enrich_from_labels(places: DataFrame, labels: DataFrame, rules: Spelling) -> DataFrame:
    """Replace a canonical name that differs from the English label, and add spellings from the others. ``row_no`` tells places apart."""
    rows = with_exonyms(label_places(places, labels), F.array("label_uk"), rules)
    own = strip(F.coalesce("name", F.lit("")))
    replaced = (F.col("label_en") != "") & (compare_key("label_en") != compare_key(own))
    latin = F.when(F.col("label_ru") != "", F.array(cyrillic_to_latin("label_ru"))).otherwise(_empty())
    spelled = F.when(F.col("label_uk") != "", _spellings()).otherwise(_empty())
    rows = rows.withColumn("replaced", replaced).withColumn("_existing", split_list("aliases")).withColumn("_new", F.concat(latin, spelled))
    return (rows.withColumn("aliases", F.array_join(_append_new(F.col("_existing"), F.col("_new")), ";"))
            .withColumn("name", F.when(F.col("replaced"), F.col("label_en")).otherwise(F.col("name"))).drop("_existing", "_new", "whole", "spelled"))


def rebuild_aliases(places: DataFrame, merged: DataFrame, rules: Spelling) -> DataFrame:
    """Aliases anew from existing Latin ones, the name, and the merged names (qid, lang, names). ``row_no`` tells places apart.

    The names used stay as ``names_*``, for ``alias_audit``.
    """
    langs = ("ua", "ru", "en", "aliases")
    wide = merged.groupBy("qid").agg(*(F.coalesce(F.max(F.when(F.col("lang") == k, F.col("names"))), _empty()).alias(f"names_{k}")
                                       for k in langs)).withColumnRenamed("qid", "_q")
    # What the names of a qid come to is found once, not by each of its places.
    wide = with_exonyms(written(wide, "names"), F.filter("names_ua", is_latin), rules, "_q")
    wide = wide.withColumn("_shared", let(_keyed(F.concat("names_en", "names_aliases", F.transform("names_ru", cyrillic_to_latin), _spellings())), _first_of_key))
    wide = written(wide.drop("whole", "spelled"), "shared")
    rows = places.withColumn("_q", strip(F.coalesce("qid", F.lit("")))).join(wide.hint("merge"), "_q", "left").drop("_q")
    for k in langs:
        rows = rows.withColumn(f"names_{k}", F.coalesce(f"names_{k}", _empty()))
    own = let(_keyed(F.concat(split_list("aliases"), F.array(strip(F.coalesce("name", F.lit("")))))), _first_of_key)
    shared = F.coalesce("_shared", F.array().cast("array<struct<k:string,v:string>>"))

    def joined(ps: Column) -> Column:
        return F.concat(ps, let(F.transform(ps, lambda p: p["k"]), lambda ks: F.filter(shared, lambda p: ~F.array_contains(ks, p["k"]))))

    return rows.withColumn("aliases", F.array_join(F.array_sort(F.transform(let(own, joined), lambda p: p["v"])), ";")).drop("_shared")


def _keyed(names: Column) -> Column:
    """Latin names with their keys; those without a key are left out."""
    return F.filter(F.transform(F.filter(names, is_latin), lambda x: F.struct(alias_key(x).alias("k"), x.alias("v"))), lambda p: p["k"] != "")


def _first_of_key(pairs: Column) -> Column:
    return let(F.transform(pairs, lambda p: p["k"]), lambda ks: F.filter(pairs, lambda p, i: F.array_position(ks, p["k"]) == i + 1))


def alias_audit(places: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """What each place's aliases were made of, what came of them, and what was added and dropped."""
    before = places.select("row_no", split_list("aliases").alias("_old"))
    rows = rebuilt.join(before, "row_no").withColumn("_now", split_list("aliases"))
    named = [F.array_join(f"names_{k}", ", ").alias(out) for k, out in (("ua", "ua_names"), ("ru", "ru_names"), ("en", "en_names"), ("aliases", "spatial_aliases"))]
    return rows.select("row_no", strip(F.coalesce("qid", F.lit(""))).alias("wikidata"), strip(F.coalesce("name", F.lit(""))).alias("canonical_name"), *named,
                       F.col("aliases").alias("final_aliases"), F.array_join(F.array_except("_now", "_old"), ";").alias("added"),
                       F.array_join(F.array_except("_old", "_now"), ";").alias("dropped"))


def first_per_cid(directions: DataFrame) -> DataFrame:
    """Directions with trimmed ids, the first row of each id."""
    rows = directions.withColumn("cid", strip(F.col("cid").cast("string")))
    rest = [c for c in rows.columns if c not in ("cid", "row_no")]
    return rows.groupBy("cid").agg(F.min(F.struct("row_no", *rest)).alias("s")).select("cid", "s.*")


def join_once(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join that fails when the right side has several different rows for a key; a row that is there again counts once."""
    rest = [c for c in right.columns if c != key]
    one = F.struct(*rest)
    single = right.groupBy(key).agg(F.min(one).alias("_s"), F.max(one).alias("_t"))
    checked = F.when(F.col("_s") == F.col("_t"), F.col("_s")).otherwise(F.raise_error(F.concat(F.lit("key is not unique: "), F.col(key))))
    checked = F.when(F.col("_s").isNotNull(), checked)
    return left.join(single, key, "left").withColumn("_s", checked).select(*left.columns, *(F.col(f"_s.{c}").alias(c) for c in rest))


def update_directions(directions: DataFrame, places: DataFrame) -> DataFrame:
    """Aliases of directions from name and aliases of their anchor place (packed)."""
    lookup = places.select(F.col("cid").cast("string").alias("cid"), F.col("name").alias("place_name"), F.col("aliases").alias("place_aliases"))
    rows = join_once(first_per_cid(directions), lookup, "cid")
    raw = F.concat(F.array(strip(F.coalesce("place_name", F.lit("")))), split_list("place_aliases"))
    keys = F.filter(F.transform(F.filter(raw, is_latin), location_key), lambda x: x != "")
    return rows.withColumn("aliases", sorted_pack(keys)).drop("place_aliases")


def duplicate_ids(places: DataFrame, column: str = "qid") -> DataFrame:
    """Rows whose id occurs more than once; counted before the shuffle, not gathered."""
    repeated = places.filter(strip(F.coalesce(column, F.lit(""))) != "").groupBy(column).agg(F.count("*").alias("n")).filter("n > 1")
    return places.join(repeated, column)


def ids_of(table: DataFrame) -> DataFrame:
    """First non-empty of ``qid``, ``wikidata``, ``wikidata_id``, trimmed; distinct."""
    cols = [F.nullif(F.col(c), F.lit("")) for c in ("qid", "wikidata", "wikidata_id") if c in table.columns]
    return table.select(strip(F.coalesce(*cols)).alias("qid")).filter("qid <> ''").distinct()


def id_difference(first: DataFrame, second: DataFrame) -> DataFrame:
    """Ids in one table only, with the table they are missing from."""
    a, b = ids_of(first), ids_of(second)
    return (a.subtract(b).withColumn("missing_in", F.lit("second"))
            .unionByName(b.subtract(a).withColumn("missing_in", F.lit("first"))))


def settle_regions(settlements: DataFrame, polygons: DataFrame, smallest: bool = False) -> DataFrame:
    """Region of each settlement: first polygon that holds it, or the smallest one."""
    area = F.aggregate("polygons", F.lit(0.0), lambda a, p: a + polygon_area(p))
    shapes = polygons.withColumn("area", area)
    return assign_polygon(settlements, shapes, "area" if smallest else "poly_no", ("osm_id", "poly_name")).withColumnRenamed(
        "osm_id", "region_osm_id").withColumnRenamed("poly_name", "region_name")


def coverage(settled: DataFrame) -> DataFrame:
    return settled.agg(F.count("*").alias("total"), F.count_if("confirmed").alias("matched"), F.count_if(~F.col("confirmed")).alias("unmatched"))


def region_table(polygons: DataFrame) -> DataFrame:
    return polygons.select("osm_id", F.col("poly_name").alias("name"), "name_uk", "iso", "wikidata").orderBy("name")
