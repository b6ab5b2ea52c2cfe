"""Text keys, spelling rules, coordinates: hand-made rows."""

import math

import pytest
from pyspark.sql import functions as F

from georeport.functions import geo, keys, labels
from georeport.operators import upkeep
from georeport.operators.spelling import Spelling, exonyms, with_exonyms


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("text, key", [
    ("Boromels'ke", "boromelske"), ("Yeni-Kale", "yeni kale"), ("The  Netherlands", "nerlands"), (" A–b—c ", "a b c"), (None, ""), ("", ""), ("Київ’ська", "київська"),
])
def test_location_key(spark, text, key):
    assert one(spark, keys.location_key, text) == key


def test_keys_differ_where_they_should(spark):
    assert one(spark, keys.alias_key, "The Old-Town’s") == "the old towns"
    assert one(spark, keys.text_key, "A‒B  'c'") == "a b  c"
    assert one(spark, keys.compare_key, "Lyman (city) O'Neil-x") == "Lyman ONeil x"
    assert one(spark, keys.accent_free, " Évi–Ой ") == "evi-ои"
    assert one(spark, keys.is_latin, "") is False and one(spark, keys.is_latin, "Київ") is False


@pytest.mark.parametrize("text, latin", [
    ("Красный Лиман", "Krasny Liman"), ("Ейск", "Yeysk"), ("Щорс-Ёлка", "Shchors-Yolka"), ("Объезд", "Obezd"), ("Новый-Егорлык", "Novy-Yegorlyk"), ("abc", "abc"),
])
def test_cyrillic_to_latin(spark, text, latin):
    assert one(spark, keys.cyrillic_to_latin, text) == latin


def test_exonyms(spark):
    """Endings, word rules with one and several alternatives, whole names; empty texts and nulls."""
    want = {"Petrivka": ["petrovka"], "Ivka": ["ivka"], "Stara Petrivka": ["staraya petrovka"], "Sadivska-Nova": ["sadovskaya-nova"], "Sadivske": ["sadovskoye"],
            "maivka": ["maivka"], "Kaaivka": ["kaaivka"], "Mala  Petrivka-mala": ["malaya petrovka-malaya", "malaya petrovka-mala’", "mala’ petrovka-malaya", "mala’ petrovka-mala’"], "": []}
    rules = Spelling(spark.createDataFrame([("old town", "whole;other"), ("old town", "third")], "name string, variant string"),
                     spark.createDataFrame([("stara", "staraya"), ("mala", "malaya; mala’")], "word string, variant string"))
    texts = spark.createDataFrame([(t,) for t in [*want, "Old  Town", "Petrivka", None]], "text string")
    got = {r.text: (r.whole, r.spelled) for r in exonyms(texts, rules).collect()}
    assert {t: got[t][1] for t in want} == want and len(got) == len(want) + 1
    assert got["Old  Town"] == (["third", "whole", "other"], ["old town"]) and got["Petrivka"][0] == []


def test_very_many_rules(spark):
    """100,000 word rules and as many names; places keep their order of texts."""
    n = 100_000
    words = spark.range(n).selectExpr("concat('w', id) as word", "concat('v', id) as variant")
    names = spark.range(n).selectExpr("concat('w', id, ' town') as name", "concat('t', id, ';u', id) as variant")
    rows = spark.range(500).selectExpr("id as row_no", "array(concat('W', id * 7, ' Town'), concat('w', id, '-w', id + 1), 'Petrivka', null) as texts")
    got = {r.row_no: (r.whole, r.spelled) for r in with_exonyms(rows, F.col("texts"), Spelling(names, words)).collect()}
    assert got == {i: ([[f"t{7 * i}", f"u{7 * i}"], [], []], [[f"v{7 * i} town"], [f"v{i}-v{i + 1}"], ["petrovka"]]) for i in range(500)}


def test_rebuilt_aliases_and_their_audit(spark):
    places = spark.createDataFrame([(0, "Q1", "Petrivka", "Кале; old;Petrivka"), (1, None, " Lyman ", None)], "row_no int, qid string, name string, aliases string")
    merged = spark.createDataFrame([("Q1", "ua", ["Petrivka", "Стара"]), ("Q1", "ru", ["Лиман"]), ("Q1", "en", ["Peter's"])], "qid string, lang string, names array<string>")
    rebuilt = upkeep.rebuild_aliases(places, merged, Spelling.of(spark, {}, {"petrivka": "petrowka;petrovo"}))
    got = {r.row_no: r for r in upkeep.alias_audit(places, rebuilt).collect()}
    assert got[0].final_aliases == "Liman;Peter's;Petrivka;old;petrovo;petrowka" and got[1].final_aliases == "Lyman"
    assert (got[0].wikidata, got[0].ua_names, got[0].ru_names, got[0].en_names) == ("Q1", "Petrivka, Стара", "Лиман", "Peter's")
    assert got[0].dropped == "Кале" and set(got[0].added.split(";")) == {"Liman", "Peter's", "petrovo", "petrowka"} and got[1].wikidata == ""


def test_cid_round_trip(spark):
    rows = [(48.123456, 31.654321), (-89.9999994, -179.5), (0.0, 0.0), (53.0, 22.000001)]
    df = spark.createDataFrame(rows, "lat double, lon double").withColumn("c", geo.encode_cid(F.col("lat"), F.col("lon")))
    for r in df.select("*", geo.decode_lat(F.col("c")).alias("a"), geo.decode_lon(F.col("c")).alias("b")).collect():
        assert abs(r["a"] - r["lat"]) <= 1.1e-6 and abs(r["b"] - r["lon"]) <= 1.1e-6
        assert r["c"] == (int((round(r["lat"], 6) + 90.0) * 1e6) << 32) | int((round(r["lon"], 6) + 180.0) * 1e6)


def test_zero_axis_and_mercator(spark):
    r = spark.range(1).select(geo.unit_lat(F.lit(0.0), F.lit(0.0)).alias("z"), geo.mercator_lat(geo.mercator_y(F.lit(48.5))).alias("m")).first()
    assert r["z"] == 0.0 and math.isclose(r["m"], 48.5, abs_tol=1e-9)


def test_snippet_and_action(spark):
    assert one(spark, lambda c: labels.snippet(c, 3), " a\nbcd ") == "a b…"
    assert one(spark, labels.action_kind, " Shelled ") == "shelling"
    assert one(spark, labels.action_label, "took") == "capture"
    assert one(spark, labels.action_kind, "") is None


def test_accents_of_all_scripts(spark):
    import unicodedata
    texts = ["Ĥéllo", "ﬁne ﬂag", "ＡＢＣ１２", "Άθήνα", "ǆep", "Ǆ", "ĳ", "½ x", "ёй Ї", "ﷺ", "한국", "a\u0301b", "x²", "№ 5", "ß", "Ａ’ｂ–c", ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", keys.accent_free("t").alias("k")).collect()
    for r in rows:
        if r["t"] != "한국":
            base = "".join(c for c in unicodedata.normalize("NFKD", r["t"].strip().lower()) if not unicodedata.combining(c))
            for a, b in (("’", "'"), ("`", "'"), ("–", "-")):
                base = base.replace(a, b)
            assert r["k"] == " ".join(base.split()), r["t"]
    assert rows[10]["k"] == "한국"
