"""Repeated rows, scopes and large groups: results that must not depend on size, and work that must not grow with pairs."""

import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from checks.fixtures import Fixtures
from checks.queries import QUERIES
from georeport.functions.geo import RADIUS_KM
from georeport.operators import common, context, lookup, scoring, spatial, structure, summary, tagging, upkeep
from georeport.params import Scoring
from georeport.plans import resolve


def test_a_place_listed_twice_is_one_anchor(spark):
    left = spark.createDataFrame([("k", 1), ("m", 2), ("x", 3)], "k string, n int")
    right = spark.createDataFrame([("k", "a", None), ("k", "a", None), ("m", "b", 1)], "k string, v string, w int")
    got = upkeep.join_once(left, right, "k").orderBy("n").collect()
    assert [tuple(r) for r in got] == [("k", 1, "a", None), ("m", 2, "b", 1), ("x", 3, None, None)]
    other = right.unionByName(spark.createDataFrame([("m", "b", None)], right.schema))
    with pytest.raises(Exception, match="not unique"):
        upkeep.join_once(left, other, "k").collect()


def _rows_out(df):
    """The most rows that a join of the plan gave, by its own counter."""
    df.collect()
    plan, found = [df._jdf.queryExecution().executedPlan()], []
    while plan:
        p = plan.pop()
        name = p.nodeName()
        if name == "AdaptiveSparkPlan":
            plan.append(p.executedPlan())
        elif "QueryStage" in name:
            plan.append(p.plan())
        kids = p.children()
        plan += [kids.apply(i) for i in range(kids.size())]
        if "Join" in name:
            found.append(p.metrics().apply("numOutputRows").value())
    return max(found)


def test_scopes_are_part_of_the_join(spark):
    places = spark.createDataFrame([("a", [], i, f"r{i % 50} oblast" if i % 10 else None, "" if i % 7 == 0 else "g") for i in range(400)],
                                   "name string, aliases array<string>, cid int, region string, grp string")
    texts = spark.createDataFrame([(1, "A", "R3  Oblast", None), (2, "a", None, "G"), (3, "a", None, None), (4, "a", "R3 oblast", "g"), (5, "b", "r3 oblast", "g"), (6, "a", "", "")],
                                  "no int, text string, in_region string, in_group string")
    index = lookup.locale_index(places)
    by_region = lookup.search_locale(texts.filter("no in (1, 5)"), index, region="in_region").select("no", "cid")
    assert sorted(r["cid"] for r in by_region.collect()) == [3 + 50 * k for k in range(8)]
    assert _rows_out(by_region) <= 8
    both = lookup.search_locale(texts, index, region="in_region", group="in_group").select("no", "cid").collect()
    want = [(no, i) for no, r, g in ((1, "r3 oblast", None), (2, None, "g"), (3, None, None), (4, "r3 oblast", "g"))
            for i in range(400) if (r is None or (i % 10 and f"r{i % 50} oblast" == r)) and (g is None or i % 7)]
    assert sorted(tuple(r) for r in both) == want


def test_runs_of_odd_texts(spark):
    """Veiled underscores, several marks, lines, abbreviations and words of which nothing counts."""
    ent = "name string, aliases array<string>, row_no int"
    locales = spark.createDataFrame([("Kale", ["Yeni-Kale"], 0), ("Lyman", ["the Kale the"], 1)], ent)
    none = locales.limit(0)
    triggers = spark.createDataFrame([("K", "attack"), ("L", "shot down")], "label string, trigger string")
    patterns = tagging.dictionary(locales, none, none, none, triggers)
    texts = ["a_Kale x² Lyman", "Ka'le… attack.\nshot  down e.g. Lyman; the yeni–kale", None, "", "shot. down"]
    posts = spark.createDataFrame(list(enumerate(texts)), "post_id int, text string")
    got = tagging.match_words(posts, patterns, (("PROXIMITY", ("in",), ()),), partitions=2)
    rows = sorted((r.post_id, r.ts, r.te, r.label, r.key, r.surface, r.cs, r.ln, r.sn, r.s_ts, r.s_te) for r in got.collect())
    assert rows == [(0, 2, 3, "LOCALE", "kale", "Kale", 2, 0, 0, 0, 1), (0, 4, 5, "LOCALE", "lyman", "Lyman", 10, 0, 0, 0, 1),
                    (1, 0, 1, "LOCALE", "kale", "Ka'le", 0, 0, 0, 0, 1), (1, 2, 3, "K", "attack", "attack", 7, 0, 1, 2, 3),
                    (1, 4, 6, "L", "shot down", "shot  down", 15, 1, 2, 4, 9), (1, 10, 11, "LOCALE", "lyman", "Lyman", 31, 1, 3, 0, 1),
                    (1, 13, 16, "LOCALE", "yeni kale", "yeni–kale", 42, 1, 3, 0, 1), (1, 15, 16, "LOCALE", "kale", "kale", 47, 1, 3, 0, 1)]


def test_words_of_records_are_found_once_and_by_halving(spark):
    """The places of ``word_table``; a token's chars without a look at every word of its post."""
    texts = ["a_Kale x² Lyman", "Ka'le… attack.\nshot  down e.g. Lyman; the yeni–kale", None, "", "...", "one, two; (three)?! " * 60, "日本 ʼa 𐐀b — c"]
    posts = spark.createDataFrame(list(enumerate(texts)), "post_id int, text string").withColumn("more", F.array(F.struct(F.lit(1).alias("x"))))
    got = tagging.word_places(posts)
    plain = posts.withColumn("words", F.transform(tagging.word_table(F.col("text")), lambda w: F.struct(w["ts"].alias("ts"), w["cs"].alias("cs"), w["ce"].alias("ce"))))
    assert got.schema.simpleString() == plain.schema.simpleString() and _plain(got) == _plain(plain)
    asked = got.select("post_id", "text", "words", F.explode(F.array(*(F.lit(t).cast("long") for t in (-3, 0, 1, 2, 3, 4, 5, 7, 9, 301, 419, 9999)))).alias("t"))
    chars = asked.withColumn("c", structure.token_chars(F.col("text"), F.col("words"), F.col("t")))
    for r in chars.collect():
        if r.text is None:
            assert r.c.cs is None
            continue
        tokens = sorted([(w.cs, w.ce) for w in r.words] + [(i, i + 1) for i, x in enumerate(r.text) if not x.isspace() and not any(w.cs <= i < w.ce for w in r.words)])
        t = max(r.t, 0)
        assert (r.c.cs, r.c.ce) == (tokens[t] if t < len(tokens) else (len(r.text), len(r.text))), (r.post_id, r.t)


def test_posts_of_one_file_are_dealt_out(spark):
    posts = spark.range(5000).selectExpr("id as post_id", "'Kale' as text").coalesce(1)
    spans = spark.createDataFrame([(1, 5, 6, 0, 1, 0, "GROUP", "g", "g"), (1, 2, 4, 0, 1, 0, "LOCALE", "l", "l"), (1, 8, 9, 0, 1, 0, "LOCALE", "m", "m")],
                                  "post_id long, ts int, te int, cs int, ce int, ln int, label string, surface string, key string")
    conf = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        gathered = structure.gather_posts(posts, spans)
        assert gathered.select(F.spark_partition_id().alias("p")).distinct().count() == 4
        near = gathered.filter("post_id = 1").select(*(structure._inside(F.col("spans"), F.lit(a), F.lit(b)).alias(f"r{i}") for i, (a, b) in enumerate(
            ((0, 99), (2, 4), (3, 9), (5, 6), (2, 3), (9, 99), (0, 0))))).first()
        assert [[s.ts for s in r] for r in near] == [[2, 5, 8], [2], [5, 8], [5], [], [], []]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", conf)


def test_first_places_of_a_name(spark):
    places = spark.createDataFrame([(5, 50, "a", ["b", "A"]), (3, 30, "a", []), (4, 30, "a", []), (9, 90, "b", []), (1, 10, "c", [])],
                                   "row_no long, cid long, name string, aliases array<string>")
    got = lookup.first_places(lookup.locale_index(places), 2)
    assert sorted((r.key, r.row_no, r.cid) for r in got.collect()) == [("a", 3, 30), ("a", 5, 50), ("b", 5, 50), ("b", 9, 90), ("c", 1, 10)]
    assert [(r.key, r.row_no) for r in lookup.first_places(lookup.locale_index(places), 1).orderBy("key").collect()] == [("a", 3), ("b", 5), ("c", 1)]


def test_names_of_a_qid_are_spelled_once(spark, monkeypatch):
    """Many places of one qid: its names go to the spelling once, and each place has them with its own."""
    seen, plain = [], upkeep.with_exonyms

    def counted(rows, *more):
        seen.append(rows.count())
        return plain(rows, *more)

    monkeypatch.setattr(upkeep, "with_exonyms", counted)
    places = spark.createDataFrame([(i, " Q1" if i < 40 else None, f"n{i}", "Own;eins") for i in range(50)], "row_no long, qid string, name string, aliases string")
    merged = spark.createDataFrame([("Q1", "ua", ["petrivka", "Ж"]), ("Q1", "en", ["OWN", "Two"]), ("Q1", "ru", ["Два"])], "qid string, lang string, names array<string>")
    got = {r.row_no: (r.aliases, r.names_en) for r in upkeep.rebuild_aliases(places, merged, upkeep.Spelling.of(spark)).collect()}
    assert sum(seen) == 1
    assert got[7] == ("Dva;Own;Two;eins;n7;petrovka", ["OWN", "Two"]) and got[45] == ("Own;eins;n45", [])


def _town(spark, n, name="a"):
    return spark.createDataFrame([(i, 1000 + i, name, ["b"], 44.0 + i / 100, 30.0, f"r{i % 3}", "g", f"Q{i}") for i in range(n)],
                                 "row_no int, cid long, name string, aliases array<string>, lat double, lon double, region string, grp string, qid string")


def test_anchors_are_looked_up_once_per_text(spark):
    locales = _town(spark, 100)
    contexts = spark.createDataFrame([(f"e{i}", 0, "proximity" if i % 2 else "direction", ("A", "b", "zz", None)[i % 4]) for i in range(400)] + [("x", 1, "region", "a")],
                                     "event_id string, ord int, kind string, text string")
    got = summary.anchor_marks(contexts, locales.limit(0).selectExpr("row_no", "name", "cid as anchor_cid", "aliases"), locales, ["event_id", "ord"])
    assert _rows_out(got) <= 2 * 401
    marks = {r["text"]: r["mark"] for r in got.filter("event_id <> 'x'").collect()}
    assert marks == {"A": " (~)", "b": " (~)", "zz": " (?)", None: " (?)"}
    assert got.filter("event_id = 'x'").first()["mark"] == ""


def test_places_are_narrowed_once_per_name_and_contexts(spark):
    locales = _town(spark, 200)
    mentions = spark.createDataFrame([(f"e{i}", 0, "A") for i in range(300)] + [("e0", 0, "b"), (None, 0, "b"), ("e1", 1, None)], "event_id string, loc_no int, text string")
    contexts = spark.createDataFrame([(f"e{i}", None, None, 44.0, 30.0) for i in range(300)], "event_id string, in_region string, in_group string, prox_lat double, prox_lon double")
    got = context.narrow_candidates(mentions, contexts, locales)
    # 45 hundredths of a degree are 50 km; the mention without an event has no contexts.
    assert _rows_out(got) == 300 * 45 + 200
    per = {(r["event_id"], r["loc_no"]): r["n"] for r in got.groupBy("event_id", "loc_no").agg(F.countDistinct("cid").alias("n")).collect()}
    assert per == {**{(f"e{i}", 0): 45 for i in range(300)}, (None, 0): 200}


def test_mentions_of_a_name_ask_once(spark):
    asked = spark.createDataFrame([("e0", 0, "a"), ("e0", 0, "a"), ("e1", 0, "a"), ("e1", 0, "b"), ("e2", 1, "a"), (None, 0, None)], "event_id string, loc_no int, key string")
    mentioned, wants = context.asked_once(asked)
    assert mentioned.count() == 4 and wants.select("want").distinct().count() == 3
    got = mentioned.join(wants, "want").select("event_id", "loc_no", "key").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, {tuple(r) for r in asked.collect()}))


def test_events_without_an_anchor_stay_out_of_the_axis_join(spark):
    rows = [(f"e{i}", "r", None, *((44.0, 30.0) if i == 0 else (None, 31.0) if i == 1 else (None, None))) for i in range(500)]
    contexts = spark.createDataFrame(rows, "event_id string, ctx_region string, ctx_group string, dir_lat double, dir_lon double")
    segments = spatial.line_segments(spark.createDataFrame([(1, 0, 30.0, 45.0), (1, 1, 31.0, 45.0)], "line_no int, pt_no int, lon double, lat double"))
    got = resolve.with_axes(contexts, segments)
    assert _rows_out(got) < 100
    axes = {r["event_id"]: r for r in got.collect()}
    assert len(axes) == 500 and abs(axes["e0"]["axis_dlat"] - 1.0) < 1e-6
    assert all(axes[f"e{i}"]["axis_dlat"] is None for i in range(1, 500)) and axes["e1"]["axis_lon"] == 31.0


def test_mentions_are_resolved_once_per_name_and_contexts(spark, monkeypatch):
    locales = _town(spark, 60)
    regions = spark.createDataFrame([(i, f"r{i}", [], []) for i in range(3)], "row_no int, name string, aliases array<string>, neighbors array<string>")
    groups = spark.createDataFrame([(0, "g", [], [], [])], "row_no int, name string, aliases array<string>, regions array<string>, neighbors array<string>")
    directions = spark.createDataFrame([(0, "a", [], 1010)], "row_no int, name string, aliases array<string>, anchor_cid long")
    events = spark.createDataFrame([("p", "S0", f"e{i}") for i in [*range(200), 5]], "post_id string, section_id string, event_id string")
    kind = "post_id string, level string, section_id string, event_id string, ord int, kind string, text string"
    contexts = spark.createDataFrame([("p", "event", "S0", f"e{i}", 0, "region" if i < 9 else "direction", "r1" if i < 9 else "A") for i in range(7, 11)], kind)
    mentions = spark.createDataFrame([(f"e{i}", 0, "A") for i in range(200)] + [(None, 0, "a"), ("e3", 1, "zz"), ("e4", 1, None), ("gone", 0, "b")], "event_id string, loc_no int, text string")
    segments = spatial.line_segments(spark.createDataFrame([(1, 0, 30.0, 44.6), (1, 1, 31.0, 44.6)], "line_no int, pt_no int, lon double, lat double"))
    tried, plain = [], scoring.choose_places
    monkeypatch.setattr(scoring, "choose_places", lambda c, *more: tried.append(c.count()) or plain(c, *more))
    got, chosen = resolve.resolve_mentions(mentions, events, contexts, resolve.Gazetteer(locales, regions, groups, directions), segments)
    # One list without contexts, one within a region (of which 20 places are), one along an axis, those of e3 and e4, the other name, and
    # the event that is listed twice, which has its candidates twice.
    assert tried == [60 + 20 + 60 + 2 * 60 + 60 + 2 * 60]
    rows = {(r["event_id"], r["loc_no"]): r["final_cid"] for r in got.collect()}
    # The nearest to the line; the axis from the tenth place leads there, too.
    assert rows == {**{(f"e{i}", 0): 1058 if 7 <= i < 9 else 1059 for i in range(200)}, (None, 0): None, ("e3", 1): None, ("e4", 1): None, ("gone", 0): 1059}
    assert chosen.count() == 201


def test_beam_scores_each_pair_of_places_once(monkeypatch):
    rng = np.random.default_rng(3)
    n, s = 2400, Scoring()
    lat, lon = np.radians(rng.uniform(44, 52, n)), np.radians(rng.uniform(22, 40, n))
    lat[7], lon[1300], lon[5] = np.nan, np.nan, np.radians(-179.9)
    names = {"region": [f"r{i % 25}" if i % 9 else None for i in range(n)], "grp": [f"g{i % 5}" for i in range(n)]}
    rows = scoring._Rows(pa.table({"rlat": lat, "rlon": lon, "clat": np.cos(lat), "unary": rng.random(n), **names}), s)
    p, q = np.arange(0, n, 40)[:, None], np.arange(n)[None, :]
    d = 2 * RADIUS_KM * np.arcsin(np.sqrt(np.sin((lat[p] - lat[q]) / 2) ** 2 + np.cos(lat[p]) * np.cos(lat[q]) * np.sin((lon[p] - lon[q]) / 2) ** 2))
    near = np.where(d <= s.close_km, 1.0, np.where(d <= s.far_km, (s.far_km - d) / (s.far_km - s.close_km), np.maximum((s.far_km - d) / s.far_km, -1.0)))
    want = s.compactness_weight * near
    for of, same, differ in ((names["region"], s.region_same, s.region_differ), (names["grp"], s.group_same, s.group_differ)):
        a = np.array([x or "" for x in of])
        want = want + np.where((a[p] == "") | (a[q] == ""), 0.0, np.where(a[p] == a[q], same, -differ))
    assert np.allclose(rows.pairs(p, q), want, atol=1e-12, equal_nan=True)
    made, plain = [], scoring._Rows.pairs
    monkeypatch.setattr(scoring._Rows, "pairs", lambda self, p, q: made.append(np.broadcast(p, q).size) or plain(self, p, q))
    search = scoring._Search(50)
    for mention in (np.arange(1), np.arange(10, 40), np.arange(400, 1200), np.arange(1600, 2400)):
        search.offer(rows, mention)
        search.close()
    # The place of the first mention is the same in all 50 assignments.
    assert search.picks.shape == (50, 4) and sum(made) <= 30 + 800 * 31 + 800 * (1 + 30 + 50) and sum(made) < 0.8 * (30 + 800 * 60 + 800 * 150)


def test_places_of_a_name_are_read_by_the_search_not_joined_to_events(spark):
    """The same assignments, with names whose places fill several batches, lone places, distances to an anchor and events that begin alike."""
    rnd = random.Random(8)
    place = "want string, row_no int, cid int, name string, lat double, lon double, region string, grp string, qid string, unary double, prox_km double"
    sizes = {"p": 9000, "q": 1, "r": 30, "s": 5000, "t": 1}
    rows = [(w, 7 * c % n, 10000 * i + c, w, rnd.uniform(46, 50), rnd.uniform(30, 36), rnd.choice(["a", "b", "", None]), rnd.choice(["x", None]), None, rnd.choice([0.0, rnd.random()]),
             rnd.choice([None, 3.0, 8.0])) for i, (w, n) in enumerate(sizes.items()) for c in range(n)]
    places = spark.createDataFrame(rows, place)
    lists = ["p", "pr", "rp", "qpr", "prq", "s", "ps", "psr", "tqr", "rqt", "qq", "pp", "prsp", "x", "xq"]
    mentioned = spark.createDataFrame([(f"e{i}", 2 * k + 1, w) for i, ws in enumerate(lists * 3) for k, w in enumerate(ws)], "event_id string, loc_no int, want string")
    got = scoring.choose_wanted(mentioned, places)
    assert _rows_out(got) <= 3 * len(lists)
    want = scoring.choose_places(mentioned.join(places, "want").drop("want"))
    assert got.schema.simpleString() == want.schema.simpleString()
    rounded = F.round("score", 9).alias("score")
    assert _plain(got.withColumn("score", rounded)) == _plain(want.withColumn("score", rounded)) and got.count() == 3 * 14


def test_arrivals_of_messages_are_not_one_file(spark, tmp_path):
    words = [a * 3 + b * 4 for a in "abcdefg" for b in "hijklmnop"]
    text = [" ".join(words[i % 7:][:50]) + f" {words[(i * 5) % 63]}" for i in range(40)]
    docs = spark.createDataFrame([(i, text[i], "en", f"src{i % 3}", len(text[i])) for i in range(40)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    with common.job_folder(spark) as folder:
        fx = Fixtures(spark, str(tmp_path))
        got = sorted(tuple(r) for r in QUERIES["l01_streamed_posts"](fx).select("channel", "post_id").collect())
        landing = next(x for x in os.listdir(folder) if x.startswith("landing"))
        assert len([x for x in os.listdir(f"{folder}/{landing}") if x.endswith(".json")]) > 3
        want = sorted(tuple(r) for r in QUERIES["b06_post_records"](fx).select("channel", "post_id").collect())
    assert got == want and len(got) > 5


def _shares(df):
    """Rows of each task that gives any."""
    return [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]


def _plain(df):
    return sorted(repr(tuple(r)) for r in df.collect())


def test_places_of_a_frequent_name_are_dealt_in_equal_parts(spark, tmp_path):
    places = spark.createDataFrame([(i, f"c{i}", f"n{i % 3}", [f"m{i % 2}"]) for i in range(90)], "row_no int, cid string, name string, aliases array<string>")
    asked = [(i, "n0", {"a": i}) for i in range(3000)] + [(i, f"N{i % 3}", {"a": 1}) for i in range(3000, 3300)] + [(7, None, None), (7, None, None), (8, "x", None), (7, "n1", None), (7, "n1", None)]
    texts = spark.createDataFrame(asked, "no int, text string, name map<string,int>").coalesce(1)
    index = lookup.locale_index(places)
    got = lookup.search_locale(texts, index)
    want = texts.withColumn("key", lookup.location_key("text")).join(index, "key")
    assert got.columns == want.columns and _plain(got) == _plain(want)
    shares = _shares(got)
    assert sum(shares) == 30 * 3302 and max(shares) < 0.3 * sum(shares)
    # Ids without order: each text has 200 places, named in turn with others.
    many = spark.range(200 * 20).select(F.concat(F.lit("t"), (F.col("id") % 20)).alias("key"), F.xxhash64("id").alias("cid"))
    turns = spark.range(20 * 300).select(F.concat(F.lit("t"), (F.col("id") % 20)).alias("text"), F.xxhash64("id", "id").alias("text_id")).coalesce(1)
    found = lookup.search_locale(turns, many).select("text_id", "cid")
    found.write.parquet(f"{tmp_path}/out")
    size = sum(os.path.getsize(f"{tmp_path}/out/{x}") for x in os.listdir(f"{tmp_path}/out") if x.endswith(".parquet"))
    assert spark.read.parquet(f"{tmp_path}/out").count() == 1_200_000 and size < 800_000


def test_places_of_a_frequent_name_and_scope_are_dealt_in_equal_parts(spark):
    places = spark.createDataFrame([(i, f"n{i % 2}", ["m"], f"r{i % 3}") for i in range(90)], "row_no int, name string, aliases array<string>, region string")
    asked = [(i, "n0", "R0") for i in range(3000)] + [(i, "m", None) for i in range(3000, 6000)] + [(7, "N1", "r2"), (7, "N1", "r2"), (8, None, "r0"), (9, "n1", "x")]
    texts = spark.createDataFrame(asked, "no int, text string, in_region string").coalesce(1)
    index = lookup.locale_index(places)
    got = lookup.search_locale(texts, index, region="in_region")
    want = texts.withColumn("key", lookup.location_key("text")).join(index, "key").filter("in_region is null or lower(in_region) = region")
    assert got.columns == want.columns and _plain(got) == _plain(want)
    shares = _shares(got)
    assert sum(shares) == 3000 * 15 + 3000 * 90 + 2 * 15 and max(shares) < 0.3 * sum(shares)


def test_places_near_a_frequent_spot_are_dealt_in_equal_parts(spark):
    rows = [(i, 48.0, 30.0) for i in range(3000)] + [(i, 0.0, -0.0) for i in range(3000, 3010)] + [(1, None, 30.0), (2, 48.0, None), (3, -0.0, 0.0), (3, -0.0, 0.0), (4, 60.0, 30.0)]
    points = spark.createDataFrame(rows, "pid int, lat double, lon double").coalesce(1)
    around = [(i, 48.0 + i / 1000, 30.0 - i / 700) for i in range(40)] + [(100, 0.0, 0.1), (100, 0.0, 0.1), (101, -0.0, -0.0), (102, None, 0.0)]
    places = spark.createDataFrame(around, "row_no int, lat double, lon double")
    got = spatial.within_km(points, places, 30.0, digits=2)
    assert got.columns == ["lat", "lon", "pid", "near_row_no", "near_lat", "near_lon", "km"]
    want = (points.crossJoin(places.select(F.col("row_no").alias("near_row_no"), F.col("lat").alias("a"), F.col("lon").alias("b")))
            .withColumn("km", spatial.lookup_km(F.col("lat"), F.col("lon"), F.col("a"), F.col("b"))).filter("km <= 30").select("pid", "near_row_no", F.round("km", 2).alias("km")))
    assert _plain(got.select("pid", "near_row_no", "km")) == _plain(want)
    shares = _shares(got)
    assert sum(shares) == 3000 * 40 + 12 * 3 and max(shares) < 0.4 * sum(shares)
