"""Text keys, sources and gazetteer upkeep."""

from pyspark.sql import functions as F

from checks.ctes import CTES, WS, cid, lockey, squeeze
from checks.registry import query
from georeport.functions import keys
from georeport.operators import filters, spelling, upkeep
from georeport.operators.common import scratch_path
from georeport.sources import gazetteer, geojson, records

_LAT, _CYR = "abvgdeziklmnoprstuf", "абвгдезиклмнопрстуф"


def altkey(x: str) -> str:
    return squeeze(f"translate(translate(lower({x}), '''’', ''), '-', ' ')")


def latin(x: str) -> str:
    s = f"regexp_replace({x}, '[ИиЫы][Йй]([ \\t\\n-]|$)', 'y\\1', 'g')"
    s = f"regexp_replace({s}, '(^|[ \\t\\n-])е', '\\1ye', 'g')"
    s = f"regexp_replace({s}, '(^|[ \\t\\n-])Е', '\\1Ye', 'g')"
    for k, v in keys.CYRILLIC_LATIN.items():
        s = f"replace(replace({s}, '{k}', '{v}'), '{k.upper()}', '{v.capitalize()}')"
    return s


def split(x: str) -> str:
    return f"list_filter(list_transform(string_split({x}, ';'), lambda a: trim(a)), lambda a: a <> '')"


CTES.update({
    "fx_spellings": f"""SELECT row_no, qid, cid, lat, lon, name, CASE row_no % 6 WHEN 0 THEN name || 'ivka' WHEN 1 THEN 'Stara ' || name WHEN 2 THEN name || 'ivska-' || aliases[1]
        WHEN 3 THEN upper(name) || 'ivske' WHEN 4 THEN '  ' || upper(name[1]) || lower(name[2:]) || '''ye –  the ' || aliases[1] || ' (x)' ELSE translate(name, '{_LAT}', '{_CYR}') END AS raw,
        'Ж' || translate(aliases[1], '{_LAT}', '{_CYR}') || 'ский-Елщьё' AS cyr,
        name || '; ' || upper(aliases[1]) || ';;' || 'Ж' || translate(aliases[1], '{_LAT}', '{_CYR}') || 'ский-Елщьё' || ' ;' || translate(name, '{_LAT}', '{_CYR}') || '; The O’' || aliases[1] AS cell
        FROM fx_locales""",
    "fx_name_rules": "SELECT w || 'ivka' AS k, w || 'ovo;' || w || 'grad' AS v FROM fx_vocab WHERE r BETWEEN 61 AND 70",
    "fx_word_rules": "SELECT w AS k, w || 'aya' AS v FROM fx_vocab WHERE r BETWEEN 80 AND 120 UNION ALL SELECT 'stara', 'staraya'",
    "fx_exonyms0": f"SELECT row_no, raw, {squeeze('''replace(lower(raw), '’', chr(39))''')} AS norm FROM fx_spellings",
    "fx_exonyms1": r"""SELECT row_no, string_agg(CASE WHEN wr.v IS NOT NULL THEN wr.v WHEN regexp_matches(p, '[bcdfghjklmnpqrstvwxyzi]ivka$') THEN regexp_replace(p, 'ivka$', 'ovka')
        WHEN suffix(p, 'ivska') THEN regexp_replace(p, 'ivska$', 'ovskaya') WHEN suffix(p, 'ivske') THEN regexp_replace(p, 'ivske$', 'ovskoye') ELSE p END, '' ORDER BY i) AS x
        FROM (SELECT row_no, unnest(l) AS p, generate_subscripts(l, 1) AS i FROM (SELECT row_no, regexp_extract_all(norm, '[ -]|[^ -]+') AS l FROM fx_exonyms0)) LEFT JOIN fx_word_rules wr ON wr.k = p GROUP BY row_no""",
    "fx_exonyms": "SELECT row_no, coalesce(n.v, x) AS exonym FROM fx_exonyms0 JOIN fx_exonyms1 USING (row_no) LEFT JOIN fx_name_rules n ON n.k = norm",
})


@query("h01_location_key", f"SELECT row_no, {lockey('raw')} AS k1, {lockey('cell')} AS k2 FROM fx_spellings")
def _(fx):
    return fx.spellings.select("row_no", keys.location_key("raw").alias("k1"), keys.location_key("cell").alias("k2"))


@query("h02_text_key", """SELECT row_no, lower(translate(translate(raw, '''’‘ʼ', ''), '-‒–—', '    ')) AS k1 FROM fx_spellings""")
def _(fx):
    return fx.spellings.select("row_no", keys.text_key("raw").alias("k1"))


@query("h03_accent_free", f"""SELECT row_no, {squeeze("translate(strip_accents(lower(trim(raw))), '’`–', '''''-')")} AS k1 FROM fx_spellings""")
def _(fx):
    return fx.spellings.select("row_no", keys.accent_free("raw").alias("k1"))


@query("h04_alias_key", f"SELECT row_no, {altkey('raw')} AS k1 FROM fx_spellings")
def _(fx):
    return fx.spellings.select("row_no", keys.alias_key("raw").alias("k1"))


_NO_BRACKETS = r"regexp_replace(raw, '[ \t]*\([^)]*\)', '', 'g')"


@query("h05_compare_key", f"""SELECT row_no, {squeeze(f"translate(translate({_NO_BRACKETS}, '''’', ''), '-', ' ')")} AS k1 FROM fx_spellings""")
def _(fx):
    return fx.spellings.select("row_no", keys.compare_key("raw").alias("k1"))


@query("h06_plain_key", "SELECT row_no, lower(trim(raw)) AS k1, lower(trim(raw)) = lower(trim(name)) OR list_contains(list_transform(string_split(cell, ';'), lambda a: lower(trim(a))), lower(trim(raw))) AS hit FROM fx_spellings")
def _(fx):
    return fx.spellings.select("row_no", keys.plain_key("raw").alias("k1"),
                               keys.matches_alias(F.col("raw"), F.col("name"), F.split("cell", ";")).alias("hit"))


@query("h07_cyrillic_to_latin", f"SELECT row_no, {latin('cyr')} AS k1, {latin('raw')} AS k2 FROM fx_spellings")
def _(fx):
    return fx.spellings.select("row_no", keys.cyrillic_to_latin("cyr").alias("k1"), keys.cyrillic_to_latin("raw").alias("k2"))


@query("h08_exonym_variants", "SELECT row_no, exonym FROM fx_exonyms")
def _(fx):
    found = spelling.exonyms(fx.spellings.select(F.col("raw").alias("text")), fx.rules)
    packed = F.array_join(F.when(F.size("whole") > 0, F.col("whole")).otherwise(F.col("spelled")), ";")
    return fx.spellings.select("row_no", F.col("raw").alias("text")).join(found, "text").select("row_no", packed.alias("exonym"))


@query("h09_packed_lists", f"SELECT row_no, array_to_string({split('cell')}, ';') AS packed, CAST(len({split('cell')}) AS INTEGER) AS n FROM fx_spellings")
def _(fx):
    return fx.spellings.select("row_no", keys.pack_list(keys.split_list("cell")).alias("packed"), F.size(keys.split_list("cell")).alias("n"))


@query("b07_latin_only", "SELECT row_no, raw <> '' AND NOT regexp_matches(raw, '[\\x{400}-\\x{4FF}]') AS is_latin FROM fx_spellings")
def _(fx):
    return fx.spellings.select("row_no", keys.is_latin("raw").alias("is_latin"))


@query("f03_sorted_aliases", f"SELECT row_no, array_to_string(list_sort(list_distinct({split('cell')})), ';') AS cell FROM fx_spellings")
def _(fx):
    return fx.spellings.select("row_no", keys.sorted_pack(keys.split_list("cell")).alias("cell"))


# ------------------------------------------------------------------- gazetteer files

_L = "SELECT cid, name, array_to_string(aliases, '|') AS aliases, lat, lon, region, grp, qid, 0 AS usage, 'base' AS source FROM fx_locales"


def _places(df):
    return df.select("cid", "name", F.array_join("aliases", "|").alias("aliases"), "lat", "lon", "region", "grp", "qid", "usage", "source")


def _locales_file(fx, df=None):
    path = scratch_path(fx.spark, "places")
    gazetteer.write_locales(fx.locales if df is None else df, path)
    return path


@query("a01_read_places", _L)
def _(fx):
    return _places(gazetteer.read_locales(fx.spark, _locales_file(fx)))


@query("a16_write_places", "SELECT name || ',' || array_to_string(aliases, ';') || ',town,' || coalesce(qid, '') || ',' || region || ',' || grp || ',0,' || lon || ',' || lat || ',' || cid AS line FROM fx_locales")
def _(fx):
    return fx.spark.read.text(_locales_file(fx)).filter(~F.col("value").startswith("name,aliases,")).select(F.col("value").alias("line"))


@query("a05_patched_places", _L + " UNION ALL SELECT cid, name || ' nova', array_to_string(aliases, '|'), lat, lon, region, grp, qid, 0, 'patch' FROM fx_locales WHERE row_no % 10 = 3")
def _(fx):
    patch = fx.locales.filter("row_no % 10 = 3").withColumn("name", F.concat("name", F.lit(" nova")))
    return _places(gazetteer.read_with_patch(fx.spark, _locales_file(fx), _locales_file(fx, patch)))


@query("a02_read_regions", """SELECT r.name, qid, iso3166_2, array_to_string(aliases, '|') AS aliases, array_to_string(neighbors, '|') AS neighbors, n AS n_places
FROM fx_regions r JOIN (SELECT region, count(*) AS n FROM fx_locales GROUP BY region) l ON l.region = r.name""")
def _(fx):
    path = scratch_path(fx.spark, "regions")
    fx.regions.select(F.col("qid").alias("wikidata"), "iso3166_2", "name", keys.pack_list("aliases").alias("aliases"), keys.pack_list("neighbors").alias("neighbors")).write.csv(path, header=True)
    counts = fx.locales.groupBy(F.col("region").alias("name")).agg(F.count("*").alias("n_places"))
    return gazetteer.read_regions(fx.spark, path).join(counts, "name").select(
        "name", "qid", "iso3166_2", F.array_join("aliases", "|").alias("aliases"), F.array_join("neighbors", "|").alias("neighbors"), "n_places")


@query("a03_read_groups", """SELECT r.name, group_id, array_to_string(aliases, '|') AS aliases, array_to_string(regions, '|') AS regions, array_to_string(neighbors, '|') AS neighbors, n AS n_places
FROM fx_groups r JOIN (SELECT grp, count(*) AS n FROM fx_locales GROUP BY grp) l ON l.grp = r.name""")
def _(fx):
    path = scratch_path(fx.spark, "groups")
    fx.groups.select("name", "group_id", *(keys.pack_list(c).alias(c) for c in ("aliases", "regions", "neighbors"))).write.csv(path, header=True)
    counts = fx.locales.groupBy(F.col("grp").alias("name")).agg(F.count("*").alias("n_places"))
    return gazetteer.read_groups(fx.spark, path).join(counts, "name").select(
        "name", "group_id", *(F.array_join(c, "|").alias(c) for c in ("aliases", "regions", "neighbors")), "n_places")


@query("a04_read_directions", "SELECT name, cid AS anchor_cid, array_to_string(aliases, '|') AS aliases, name AS anchor_name, lat, lon FROM fx_locales")
def _(fx):
    path = scratch_path(fx.spark, "directions")
    fx.locales.select(F.col("name").alias("direction"), F.concat(F.lit(" "), "cid").alias("cid"), keys.pack_list("aliases").alias("aliases")).write.csv(path, header=True)
    got = gazetteer.read_directions(fx.spark, path, fx.locales)
    return got.select("name", "anchor_cid", F.array_join("aliases", "|").alias("aliases"), F.col("anchor.name").alias("anchor_name"), "anchor.lat", "anchor.lon")


# --------------------------------------------------------------------------- GeoJSON


def _q(*parts):
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def _feature(kind, coordinates, props="{}"):
    return _q('{"type":"Feature","properties":', props, ',"geometry":{"type":"', kind, '","coordinates":', coordinates, "}}")


def _pt(dx, dy):
    return _q("[", (F.col("lon") + dx).cast("string"), ",", (F.col("lat") + dy).cast("string"), "]")


def _line_text():
    a, b, c = _pt(0.0, 0.0), _pt(0.25, 0.5), _pt(1.0, 0.125)
    ring = _q("[", a, ",", b, ",", c, ",", a, "]")
    m = F.col("row_no") % 5
    return (F.when(m == 0, _feature("LineString", _q("[", a, ",", b, ",", c, "]"))).when(m == 1, _feature("MultiLineString", _q("[[", a, ",", b, "],[", c, "]]")))
            .when(m == 2, _feature("Polygon", _q("[", ring, ",[", a, ",", b, "]]"))).when(m == 3, _feature("MultiPolygon", _q("[[", ring, "],[", ring, "]]")))
            .otherwise(_feature("LineString", _q("[", a, "]"))))


@query("a07_read_lines", """WITH p AS (SELECT * FROM fx_locales), s AS (
  SELECT row_no, 0 AS i, unnest([[lon, lat], [lon + 0.25, lat + 0.5], [lon + 1.0, lat + 0.125]]) AS p, unnest([0, 1, 2]) AS pt_no FROM p WHERE row_no % 5 = 0
  UNION ALL SELECT row_no, 0, unnest([[lon, lat], [lon + 0.25, lat + 0.5]]), unnest([0, 1]) FROM p WHERE row_no % 5 = 1
  UNION ALL SELECT row_no, 0, unnest([[lon, lat], [lon + 0.25, lat + 0.5], [lon + 1.0, lat + 0.125], [lon, lat]]), unnest([0, 1, 2, 3]) FROM p WHERE row_no % 5 IN (2, 3)
  UNION ALL SELECT row_no, 1, unnest([[lon, lat], [lon + 0.25, lat + 0.5], [lon + 1.0, lat + 0.125], [lon, lat]]), unnest([0, 1, 2, 3]) FROM p WHERE row_no % 5 = 3)
SELECT pt_no, round(p[1], 6) AS lon, round(p[2], 6) AS lat, count(*) AS n FROM s GROUP BY ALL""")
def _(fx):
    path = fx.lines(fx.locales.select(_line_text().alias("value")), "lines")
    pts = geojson.read_lines(geojson.read_features(fx.spark, path, lines=True))
    return pts.groupBy("pt_no", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat")).agg(F.count("*").alias("n"))


@query("a08_read_polygons", """SELECT 'r' || row_no AS osm_id, name AS poly_name, CASE WHEN row_no % 5 = 3 THEN 2 ELSE 1 END AS n_polygons, CASE row_no % 5 WHEN 2 THEN 2 ELSE 1 END AS n_rings,
  round(abs(0.25e0 * 0.125e0 - 1.0e0 * 0.5e0) / 2, 6) AS area FROM fx_locales WHERE row_no % 5 IN (2, 3) AND row_no % 2 = 0""")
def _(fx):
    props = _q('{"id":"r', F.col("row_no").cast("string"), '","name:en":"', F.col("name"), '","admin_level":', F.when(F.col("row_no") % 2 == 0, "4").otherwise("6"), "}")
    a, b, c = _pt(0.0, 0.0), _pt(0.25, 0.5), _pt(1.0, 0.125)
    ring = _q("[", a, ",", b, ",", c, ",", a, "]")
    m = F.col("row_no") % 5
    text = (F.when(m == 2, _feature("Polygon", _q("[", ring, ",[", a, ",", b, "]]"), props)).when(m == 3, _feature("MultiPolygon", _q("[[", ring, "],[", ring, "]]"), props))
            .when(m == 4, _q('{"type":"Feature","properties":', props, ',"geometry":null}')).otherwise(_feature("Point", a, props)))
    path = fx.lines(fx.locales.select(text.alias("value")), "polygons")
    from georeport.operators.spatial import ring_area
    got = geojson.read_polygons(geojson.read_features(fx.spark, path, lines=True), admin_level="4")
    return got.select("osm_id", "poly_name", F.size("polygons").alias("n_polygons"), F.size(F.get("polygons", F.lit(0))).alias("n_rings"),
                      F.round(ring_area(F.get(F.get("polygons", F.lit(0)), F.lit(0))), 6).alias("area"))


def _names_file(fx):
    def field(key, value):
        return _q('"', key, '":"', value, '"')

    raw = F.replace(F.col("raw"), F.lit('"'), F.lit(""))
    fields = F.concat_ws(",", field("wikidata", F.coalesce("qid", F.lit(""))), field("name", raw), field("alt_name", _q(F.col("name"), ";", raw)),
                         field("name:ru", F.col("cyr")), field("name:en", _q(F.col("name"), " ; ", F.col("cyr"))),
                         _q('"aliases":["', F.upper(F.col("name")), '","', F.col("cyr"), '"]'))
    text = _q('{"type":"Feature","properties":{', fields, '},"geometry":null}')
    return fx.lines(fx.spellings.orderBy("row_no").select(text.alias("value")), "names")


CTES["fx_names"] = """SELECT qid, lang, trim(name) AS name, row_no, k, i FROM (
  SELECT qid, row_no, 0 AS k, 'ua' AS lang, unnest([raw]) AS name, 1 AS i FROM fx_spellings
  UNION ALL SELECT qid, row_no, 2, 'ua', unnest([name, raw]), unnest([1, 2]) FROM fx_spellings
  UNION ALL SELECT qid, row_no, 6, 'ru', cyr, 1 FROM fx_spellings
  UNION ALL SELECT qid, row_no, 9, 'en', name, 1 FROM fx_spellings
  UNION ALL SELECT qid, row_no, 12, 'aliases', upper(name), 1 FROM fx_spellings) WHERE qid <> '' AND trim(name) <> ''"""


@query("a09_read_names", "SELECT qid, lang, name, count(*) AS n FROM fx_names GROUP BY ALL")
def _(fx):
    names = geojson.read_names(geojson.read_features(fx.spark, _names_file(fx), lines=True))
    return names.groupBy("qid", "lang", "name").agg(F.count("*").alias("n"))


CTES["fx_merged"] = "SELECT qid, lang, list(name ORDER BY row_no, k, i) AS names FROM (SELECT qid, lang, name, (min((row_no, k, i))) AS o, o[1] AS row_no, o[2] AS k, o[3] AS i FROM fx_names GROUP BY qid, lang, name) GROUP BY qid, lang"


@query("d04_merged_names", "SELECT qid, lang, array_to_string(names, '|') AS names FROM fx_merged")
def _(fx):
    names = geojson.read_names(geojson.read_features(fx.spark, _names_file(fx), lines=True))
    return geojson.merge_names(names).select("qid", "lang", F.array_join("names", "|").alias("names"))


# --------------------------------------------------------------------------- records


def _dump_lines(fx):
    k = F.col("row_no")
    labels = _q('{"en":{"language":"en","value":"', F.initcap(F.col("name")), '"},"ru":{"value":"', F.col("cyr"), '"}}')
    body = _q('{"type":"item","id":"', F.when(k % 19 == 5, "P").otherwise("Q"), k.cast("string"), '","labels":', F.when(k % 17 == 0, "{}").otherwise(labels), "},")
    return fx.spellings.select(F.when(k % 13 == 0, F.concat(F.lit("[ "), body)).when(k % 13 == 1, F.left(body, F.lit(25))).otherwise(body).alias("value"))


@query("a10_dump_labels", """SELECT 'Q' || row_no AS qid, upper(name[1]) || lower(name[2:]) AS en, '' AS uk, cyr AS ru FROM fx_spellings
WHERE row_no % 13 > 1 AND row_no % 17 <> 0 AND row_no % 19 <> 5""")
def _(fx):
    path = scratch_path(fx.spark, "dump")
    _dump_lines(fx).write.option("compression", "bzip2").text(path)
    return records.read_dump(fx.spark, path)


@query("a11_lexicon_triggers", """SELECT 'kinetic_verbs' AS category, lower(w) AS trigger, 'KINETIC_EVENT' AS label, 'Somebody ' || lower(w) || ' something' AS phrase FROM (SELECT DISTINCT w FROM fx_words WHERE length(w) > 2)
UNION ALL SELECT 'other', w, NULL, NULL FROM (SELECT DISTINCT w FROM fx_words WHERE length(w) > 8)""")
def _(fx):
    words = fx.table("documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("w")).distinct()
    part = words.withColumn("_b", F.pmod(F.xxhash64("w"), F.lit(64)))

    def items(cond, form):
        return F.array_join(F.collect_list(F.when(cond, F.concat(F.lit('"'), form, F.lit('"')))), ",")

    docs = part.groupBy("_b").agg(_q('{"actions":{"kinetic_verbs":[', items(F.length("w") > 2, _q(" ", F.translate("w", "abcdefghij", "ABCDEFGHIJ"), " ")), ',"  "]},"x":{"other":[', items(F.length("w") > 8, F.col("w")), "]}}").alias("value"))
    return records.lexicon_triggers(docs)


@query("a14_map_elements", """SELECT CASE WHEN row_no % 2 = 0 THEN 'node' ELSE 'way' END AS osm_type, row_no AS osm_id, 'town' AS place, name, raw AS "name:uk", qid AS wikidata,
  CASE WHEN row_no % 6 = 1 THEN NULL ELSE lat END AS lat, CASE WHEN row_no % 6 = 1 THEN NULL ELSE lon END AS lon FROM fx_spellings""")
def _(fx):
    k = F.col("row_no")
    place = _q('"lat":', F.col("lat").cast("string"), ',"lon":', F.col("lon").cast("string"))
    where = F.when(k % 2 == 0, place).when(k % 6 == 1, place).otherwise(_q('"center":{', place, "}"))
    qid = F.coalesce(_q(',"qid":"', F.col("qid"), '"'), F.lit(""))
    text = _q('{"type":"', F.when(k % 2 == 0, "node").otherwise("way"), '","id":', k.cast("string"), ",", where, ',"tags":{"place":"town","name:en":"', F.col("name"), '","name":"', F.col("raw"), '"}', qid, "}")
    return records.element_rows(fx.spellings.select(text.alias("value")))


# ---------------------------------------------------------------------------- upkeep


@query("b08_repaired_coordinates", """WITH c AS (SELECT row_no, CASE row_no % 5 WHEN 0 THEN lon WHEN 1 THEN lat WHEN 2 THEN lon + 100 END AS a, CASE row_no % 5 WHEN 0 THEN lat WHEN 1 THEN lon WHEN 2 THEN lat END AS b FROM fx_locales WHERE row_no % 5 < 3)
SELECT row_no, round(CASE WHEN sw THEN b ELSE a END, 6) AS lon, round(CASE WHEN sw THEN a ELSE b END, 6) AS lat, CASE WHEN ok THEN 'ok' WHEN sw THEN 'swapped' ELSE 'outside' END AS coord_status
FROM (SELECT *, a BETWEEN 22 AND 41 AND b BETWEEN 43 AND 53 AS ok, NOT (a BETWEEN 22 AND 41 AND b BETWEEN 43 AND 53) AND b BETWEEN 22 AND 41 AND a BETWEEN 43 AND 53 AS sw FROM c)""")
def _(fx):
    return filters.repair_coordinates(_coordinates(fx)).select("row_no", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), "coord_status")


def _coordinates(fx):
    lon, lat, m = F.col("lon").cast("string"), F.col("lat").cast("string"), F.col("row_no") % 5
    far = (F.col("lon") + 100).cast("string")
    cell = (F.when(m == 0, _q("[", lon, ", ", lat, "]")).when(m == 1, _q("[", lat, ",", lon, "]")).when(m == 2, _q(" [", far, ",", lat, "] "))
            .when(m == 3, _q("[", lon, ", oops")).when(F.col("row_no") % 2 == 0, ""))
    return fx.locales.select("row_no", "name", cell.alias("coordinates"))


@query("k06_coordinate_ids", f"""SELECT row_no, {cid('lat', 'CASE row_no % 5 WHEN 2 THEN lon + 100 ELSE lon END')} AS cid FROM fx_locales WHERE row_no % 5 < 3 AND lat BETWEEN 43 AND 53""")
def _(fx):
    return filters.add_cid(filters.repair_coordinates(_coordinates(fx))).select("row_no", "cid")


@query("k01_normalized_aliases", f"""SELECT row_no, coalesce(array_to_string(list_sort(list_distinct(list_filter(list_transform(list_filter({split('cell')}, lambda a: NOT regexp_matches(a, '[\\x{{400}}-\\x{{4FF}}]')),
  lambda a: {lockey('a')}), lambda a: a <> ''))), ';'), '') AS aliases FROM fx_spellings""")
def _(fx):
    return fx.spellings.select("row_no", upkeep.normalize_aliases(F.col("cell")).alias("aliases"))


CTES.update({
    # Additions in order, reduced to the new ones, appended to what is there.
    "fx_existing": f"SELECT row_no, {split('cell')} AS l, list_transform({split('cell')}, lambda a: {altkey('a')}) AS ks FROM fx_spellings",
    "fx_ru": f"SELECT qid, {latin('arg_max(cyr, row_no)')} AS ru FROM fx_spellings WHERE row_no % 4 = 0 AND qid <> '' GROUP BY qid",
    "fx_k02_key": f"SELECT row_no, qid, {lockey('trim(raw)')} AS norm FROM fx_spellings",
    "fx_k02_x1": CTES["fx_exonyms1"].replace("fx_exonyms0", "fx_k02_key"),
    "fx_k02_add": f"""SELECT e.row_no, 0 AS g, i, {altkey(latin('a'))} AS a FROM (SELECT row_no, unnest(l) AS a, generate_subscripts(l, 1) AS i FROM fx_existing) e WHERE regexp_matches(a, '[\\x{{400}}-\\x{{4FF}}]')
        UNION ALL SELECT row_no, 1, i, {altkey('trim(a)')} FROM (SELECT row_no, unnest(string_split(v, ';')) AS a, generate_subscripts(string_split(v, ';'), 1) AS i FROM fx_k02_key JOIN fx_name_rules ON k = norm)
        UNION ALL SELECT row_no, 2, 1, {altkey('ru')} FROM fx_k02_key JOIN fx_ru USING (qid)
        UNION ALL SELECT row_no, 3, 1, {altkey('x')} FROM fx_k02_key k JOIN fx_k02_x1 USING (row_no) WHERE NOT EXISTS (SELECT 1 FROM fx_ru r WHERE r.qid = k.qid) AND norm NOT IN (SELECT k FROM fx_name_rules)""",
})


def _appended(add: str) -> str:
    return f"""(SELECT row_no, list(a ORDER BY g, i) AS adds FROM (SELECT a.row_no, a.a, min((g, i)) AS o, o[1] AS g, o[2] AS i FROM {add} a JOIN fx_existing e USING (row_no)
      WHERE a.a <> '' AND NOT list_contains(e.ks, a.a) GROUP BY a.row_no, a.a) GROUP BY row_no)"""


@query("k02_appended_exonyms", f"SELECT e.row_no, array_to_string(list_concat(e.l, coalesce(adds, [])), ';') AS aliases FROM fx_existing e LEFT JOIN {_appended('fx_k02_add')} USING (row_no)")
def _(fx):
    places = fx.spellings.select("row_no", "qid", F.col("raw").alias("name"), F.col("cell").alias("aliases"))
    ru = fx.spellings.filter("row_no % 4 = 0").select("qid", F.col("cyr").alias("name_ru"), F.col("row_no").alias("ord"))
    return upkeep.append_exonyms(places, ru, fx.rules).select("row_no", "aliases")


CTES.update({
    "fx_labels": "SELECT qid, arg_max(en, row_no) AS en, arg_max(uk, row_no) AS uk, arg_max(cyr, row_no) AS ru FROM (SELECT *, CASE WHEN row_no % 3 = 0 THEN '' WHEN row_no % 3 = 1 THEN name || ' (town)' ELSE name || ' new' END AS en, CASE row_no % 4 WHEN 0 THEN name || 'ivska' WHEN 2 THEN upper(name) || 'ivka-stara' ELSE '' END AS uk FROM fx_spellings WHERE row_no % 5 <> 0) WHERE qid <> '' GROUP BY qid",
    "fx_k03": "SELECT s.row_no, s.qid, s.name, coalesce(l.en, '') AS en, coalesce(l.uk, '') AS uk, coalesce(l.ru, '') AS ru FROM fx_spellings s LEFT JOIN fx_labels l USING (qid)",
    "fx_k03_uk": "SELECT row_no, lower(uk) AS norm FROM fx_k03",
    "fx_k03_x1": CTES["fx_exonyms1"].replace("fx_exonyms0", "fx_k03_uk"),
    "fx_k03_add": f"""SELECT row_no, 0 AS g, 1 AS i, {altkey(latin('ru'))} AS a FROM fx_k03 WHERE ru <> ''
        UNION ALL SELECT row_no, 1, 1, {altkey('x')} FROM fx_k03 JOIN fx_k03_x1 USING (row_no) WHERE uk <> ''""",
})


def _labels(fx):
    k = F.col("row_no")
    en = F.when(k % 3 == 0, "").when(k % 3 == 1, F.concat("name", F.lit(" (town)"))).otherwise(F.concat("name", F.lit(" new")))
    return fx.spellings.filter("row_no % 5 <> 0 and qid <> ''").select("qid", en.alias("en"), F.when(k % 4 == 0, F.concat("name", F.lit("ivska"))).when(k % 4 == 2, F.concat(F.upper("name"), F.lit("ivka-stara"))).otherwise("").alias("uk"),
                                                                       F.col("cyr").alias("ru"), k.alias("ord"))


@query("c16_labelled_places", "SELECT row_no, en, uk, ru FROM fx_k03")
def _(fx):
    got = upkeep.label_places(fx.spellings.select("row_no", "qid"), _labels(fx))
    return got.select("row_no", F.col("label_en").alias("en"), F.col("label_uk").alias("uk"), F.col("label_ru").alias("ru"))


@query("k03_enriched_from_labels", rf"""SELECT e.row_no, CASE WHEN en <> '' AND trim(regexp_replace(en, '[ ]*\([^)]*\)', '')) <> name THEN en ELSE name END AS name, en <> '' AND trim(regexp_replace(en, '[ ]*\([^)]*\)', '')) <> name AS replaced,
  array_to_string(list_concat(e.l, coalesce(adds, [])), ';') AS aliases FROM fx_existing e JOIN fx_k03 k USING (row_no) LEFT JOIN {_appended('fx_k03_add')} USING (row_no)""")
def _(fx):
    places = fx.spellings.select("row_no", "qid", "name", F.col("cell").alias("aliases"))
    return upkeep.enrich_from_labels(places, _labels(fx), fx.rules).select("row_no", "name", "replaced", "aliases")


CTES.update({
    "fx_k04_ua0": f"SELECT row_no, j, u, {squeeze('''replace(lower(u), '’', chr(39))''')} AS norm FROM (SELECT s.row_no, unnest(m.names) AS u, generate_subscripts(m.names, 1) AS j FROM fx_spellings s JOIN fx_merged m ON m.qid = s.qid AND m.lang = 'ua') WHERE NOT regexp_matches(u, '[\\x{{400}}-\\x{{4FF}}]')",
    "fx_k04_ua1": CTES["fx_exonyms1"].replace("SELECT row_no, string_agg", "SELECT row_no, j, string_agg").replace("SELECT row_no, unnest(l)", "SELECT row_no, j, unnest(l)")
        .replace("SELECT row_no, regexp_extract_all", "SELECT row_no, j, regexp_extract_all").replace("fx_exonyms0", "fx_k04_ua0").replace("GROUP BY row_no", "GROUP BY row_no, j"),
    "fx_k04_all": f"""SELECT row_no, 0 AS g, i, 0 AS h, a FROM (SELECT row_no, unnest(l) AS a, generate_subscripts(l, 1) AS i FROM fx_existing)
        UNION ALL SELECT row_no, 1, 1, 0, trim(name) FROM fx_spellings
        UNION ALL SELECT row_no, 2, i, 0, a FROM (SELECT s.row_no, unnest(m.names) AS a, generate_subscripts(m.names, 1) AS i FROM fx_spellings s JOIN fx_merged m ON m.qid = s.qid AND m.lang = 'en')
        UNION ALL SELECT row_no, 3, i, 0, a FROM (SELECT s.row_no, unnest(m.names) AS a, generate_subscripts(m.names, 1) AS i FROM fx_spellings s JOIN fx_merged m ON m.qid = s.qid AND m.lang = 'aliases')
        UNION ALL SELECT row_no, 4, i, 0, {latin('a')} FROM (SELECT s.row_no, unnest(m.names) AS a, generate_subscripts(m.names, 1) AS i FROM fx_spellings s JOIN fx_merged m ON m.qid = s.qid AND m.lang = 'ru')
        UNION ALL SELECT row_no, 5, j, h, trim(a) FROM (SELECT row_no, j, unnest(string_split(x, ';')) AS a, generate_subscripts(string_split(x, ';'), 1) AS h FROM
          (SELECT u.row_no, u.j, coalesce(n.v, x) AS x FROM fx_k04_ua0 u JOIN fx_k04_ua1 USING (row_no, j) LEFT JOIN fx_name_rules n ON n.k = u.norm))""",
})


@query("k04_rebuilt_aliases", f"""SELECT row_no, string_agg(a, ';' ORDER BY a) AS aliases FROM (SELECT row_no, k, arg_min(a, (g, i, h)) AS a FROM (SELECT *, {altkey('a')} AS k FROM fx_k04_all
  WHERE a <> '' AND NOT regexp_matches(a, '[\\x{{400}}-\\x{{4FF}}]')) WHERE k <> '' GROUP BY row_no, k) GROUP BY row_no""")
def _(fx):
    places = fx.spellings.select("row_no", "qid", "name", F.col("cell").alias("aliases"))
    merged = geojson.merge_names(geojson.read_names(geojson.read_features(fx.spark, _names_file(fx), lines=True)))
    return upkeep.rebuild_aliases(places, merged, fx.rules).select("row_no", "aliases")


@query("k04b_alias_audit", f"""SELECT s.row_no, coalesce(s.qid, '') AS wikidata, trim(s.name) AS canonical_name, coalesce((SELECT array_to_string(names, ', ') FROM fx_merged m WHERE m.qid = s.qid AND m.lang = 'ru'), '') AS ru_names,
  coalesce((SELECT array_to_string(names, ', ') FROM fx_merged m WHERE m.qid = s.qid AND m.lang = 'en'), '') AS en_names, f.aliases AS final_aliases
  FROM fx_spellings s JOIN (SELECT row_no, string_agg(a, ';' ORDER BY a) AS aliases FROM (SELECT row_no, k, arg_min(a, (g, i, h)) AS a FROM (SELECT *, {altkey('a')} AS k FROM fx_k04_all
  WHERE a <> '' AND NOT regexp_matches(a, '[\\x{{400}}-\\x{{4FF}}]')) WHERE k <> '' GROUP BY row_no, k) GROUP BY row_no) f USING (row_no)""")
def _(fx):
    places = fx.spellings.select("row_no", "qid", "name", F.col("cell").alias("aliases"))
    merged = geojson.merge_names(geojson.read_names(geojson.read_features(fx.spark, _names_file(fx), lines=True)))
    audit = upkeep.alias_audit(places, upkeep.rebuild_aliases(places, merged, fx.rules))
    return audit.select("row_no", "wikidata", "canonical_name", "ru_names", "en_names", "final_aliases")


def _direction_rows(fx):
    return fx.table("orders").select(F.col("o_orderkey").alias("row_no"), F.col("o_custkey").alias("_k")).join(
        fx.locales.select(F.col("row_no").alias("_k"), "cid"), "_k").select("row_no", F.concat(F.lit(" "), "cid").alias("cid"), F.concat(F.lit("to "), F.col("row_no").cast("string")).alias("direction"))


@query("e08_first_per_cid", "SELECT cid, min(o_orderkey) AS row_no FROM orders JOIN fx_locales ON row_no = o_custkey GROUP BY cid")
def _(fx):
    return upkeep.first_per_cid(_direction_rows(fx)).select(F.col("cid").cast("long").alias("cid"), "row_no")


@query("c17_directions_joined", "SELECT min(o_orderkey) AS row_no, cid, name AS place_name FROM orders JOIN fx_locales l ON l.row_no = o_custkey GROUP BY cid, name")
def _(fx):
    places = fx.locales.select(F.col("cid").cast("string").alias("cid"), F.col("name").alias("place_name"))
    return upkeep.join_once(upkeep.first_per_cid(_direction_rows(fx)), places, "cid").select("row_no", F.col("cid").cast("long").alias("cid"), "place_name")


@query("k05_updated_directions", f"""SELECT min(o_orderkey) AS row_no, s.cid, array_to_string(list_sort(list_distinct(list_filter(list_transform(list_filter(list_prepend(s.name, {split('s.cell')}),
  lambda a: NOT regexp_matches(a, '[\\x{{400}}-\\x{{4FF}}]')), lambda a: {lockey('a')}), lambda a: a <> ''))), ';') AS aliases FROM orders JOIN fx_spellings s ON s.row_no = o_custkey GROUP BY ALL""")
def _(fx):
    places = fx.spellings.select("cid", "name", F.col("cell").alias("aliases"))
    return upkeep.update_directions(_direction_rows(fx), places).select("row_no", F.col("cid").cast("long").alias("cid"), "aliases")


@query("d03_duplicate_ids", "SELECT row_no, qid, count(*) OVER (PARTITION BY qid) AS n FROM fx_locales WHERE qid <> '' QUALIFY n > 1")
def _(fx):
    return upkeep.duplicate_ids(fx.locales).select("row_no", "qid", "n")


@query("k08_duplicate_report", "SELECT qid, count(*) AS n, string_agg(name, ',' ORDER BY row_no) AS names FROM fx_locales WHERE qid <> '' GROUP BY qid HAVING count(*) > 1")
def _(fx):
    lists = F.sort_array(F.collect_list(F.struct("row_no", "name")))
    return upkeep.duplicate_ids(fx.locales).groupBy("qid").agg(F.count("*").alias("n"), F.array_join(F.transform(lists, lambda x: x["name"]), ",").alias("names"))


_SIDES = """WITH a AS (SELECT DISTINCT trim(qid) AS qid FROM fx_locales WHERE qid <> '' AND row_no % 3 > 0), b AS (SELECT DISTINCT qid FROM fx_locales WHERE qid <> '' AND row_no % 4 > 0)
SELECT qid, 'second' AS missing_in FROM (SELECT qid FROM a EXCEPT SELECT qid FROM b) UNION ALL SELECT qid, 'first' FROM (SELECT qid FROM b EXCEPT SELECT qid FROM a)"""


def _id_sides(fx):
    a = fx.locales.filter("row_no % 3 > 0").select(F.lit("").alias("qid"), F.concat(F.lit(" "), "qid").alias("wikidata"))
    return a, fx.locales.filter("row_no % 4 > 0").select(F.col("qid").alias("wikidata_id"))


@query("g01_id_difference", _SIDES)
def _(fx):
    return upkeep.id_difference(*_id_sides(fx))


@query("k09_id_difference_report", "SELECT missing_in, count(*) AS n, min(qid) AS first_qid FROM (" + _SIDES + ") GROUP BY missing_in")
def _(fx):
    return upkeep.id_difference(*_id_sides(fx)).groupBy("missing_in").agg(F.count("*").alias("n"), F.min("qid").alias("first_qid"))


def _regions(fx):
    return fx.polygons.withColumn("osm_id", F.concat(F.lit("r"), F.col("poly_no").cast("string")))


@query("k07_settlement_regions", """WITH f AS (SELECT lat, lon, 'r' || min(poly_no) AS region_osm_id, arg_min(poly_name, poly_no) AS region_name, 'r' || arg_min(poly_no, (area, poly_no)) AS small_osm_id FROM fx_inside JOIN fx_areas USING (poly_no, poly_name) GROUP BY ALL)
SELECT pid, region_osm_id, region_name, small_osm_id, region_osm_id IS NOT NULL AS confirmed FROM fx_points LEFT JOIN f USING (lat, lon)""")
def _(fx):
    first = upkeep.settle_regions(fx.points, _regions(fx)).select("pid", "lat", "lon", "region_osm_id", "region_name", "confirmed")
    small = upkeep.settle_regions(fx.points.select("lat", "lon").distinct(), _regions(fx), smallest=True).select("lat", "lon", F.col("region_osm_id").alias("small_osm_id"))
    return first.join(small, ["lat", "lon"]).select("pid", "region_osm_id", "region_name", "small_osm_id", "confirmed")


@query("d10_coverage", "SELECT count(*) AS total, count(i.lat) AS matched, count(*) - count(i.lat) AS unmatched FROM fx_points p LEFT JOIN (SELECT DISTINCT lat, lon FROM fx_inside) i USING (lat, lon)")
def _(fx):
    return upkeep.coverage(upkeep.settle_regions(fx.points, _regions(fx)))


@query("f02_sorted_regions", "SELECT 'r' || poly_no AS osm_id, poly_name AS name, count(DISTINCT pid) AS n FROM fx_areas LEFT JOIN fx_inside USING (poly_no, poly_name) LEFT JOIN fx_points USING (lat, lon) GROUP BY ALL")
def _(fx):
    from georeport.operators.spatial import in_polygons
    n = fx.points.join(in_polygons(fx.points, fx.polygons), ["lat", "lon"]).groupBy("poly_no").agg(F.countDistinct("pid").alias("n"))
    table = upkeep.region_table(_regions(fx).select("osm_id", "poly_name", F.lit("").alias("name_uk"), F.lit("").alias("iso"), F.lit("").alias("wikidata")))
    return table.join(_regions(fx).select("osm_id", "poly_no"), "osm_id").join(n, "poly_no", "left").select("osm_id", "name", F.coalesce("n", F.lit(0)).alias("n")).orderBy("name")
