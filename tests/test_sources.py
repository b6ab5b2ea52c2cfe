"""Files read and written, intake and errors."""

import json
import random

import pytest
from pyspark.sql import functions as F

from georeport.operators.filters import day_window
from georeport.operators.upkeep import join_once
from georeport.sources import geojson, posts, records, review
from georeport.sources.gazetteer import attach_anchor


def test_geojson_document(spark, tmp_path):
    doc = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"id": "1", "name:en": "A", "admin_level": 4}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}},
        {"type": "Feature", "properties": {}, "geometry": {"type": "LineString", "coordinates": [[5, 5]]}}, {"type": "Feature", "properties": {"id": "2"}, "geometry": None}]}
    path = tmp_path / "x.geojson"
    path.write_text(json.dumps(doc))
    features = geojson.read_features(spark, str(path))
    assert [(r["pt_no"], r["lon"]) for r in geojson.read_lines(features).orderBy("pt_no").collect()] == [(0, 0.0), (1, 1.0), (2, 1.0), (3, 0.0)]
    assert [r["poly_name"] for r in geojson.read_polygons(features, "4").collect()] == ["A"]


def test_review_document_defaults(spark, tmp_path):
    loc = {"location_id": "l", "raw_text": "x", "candidates": [{"locale": {"cid": 1, "name": "n", "lon": 1.0, "lat": 2.0}, "confidence": 0.5}]}
    doc = {"posts": [{"post_id": "p", "raw_text": "t", "children": [{"section_id": "S0", "raw_text": "t", "enabled": False, "children": [{"event_id": "e", "raw_text": "t", "children": [loc]}]}]}]}
    path = tmp_path / "tree.json"
    path.write_text(json.dumps(doc, indent=1))
    p, s, e, x, c = review.flatten_trees(review.read_trees(spark, str(path), lines=False))
    assert p.first()["enabled"] is True and s.first()["enabled"] is False and x.first()["location_id"] == "l"
    assert (c.first()["usage"], c.first()["source"]) == (0, "base")


def test_missing_fields_are_errors(spark):
    bad = spark.createDataFrame([(0, json.dumps({"document": "p", "word_matches": [{"document_word": "x"}]}))], "match_no long, value string")
    with pytest.raises(Exception, match="document_token_index"):
        records.match_words_of(records.match_events(bad)).collect()
    with pytest.raises(Exception, match="without document label"):
        records.match_events(spark.createDataFrame([(0, "{}")], "match_no long, value string")).collect()
    null = spark.createDataFrame([(0, json.dumps({"document": "p", "word_matches": [{"document_token_index": None}]}))], "match_no long, value string")
    assert records.match_events(null).first()["s_te"] == 0 and records.match_words_of(records.match_events(null)).first()["document_token_index"] == 0


def test_unknown_anchor_and_repeated_key(spark):
    places = spark.createDataFrame([(1, "a", 1.0, 1.0)], "cid long, name string, lat double, lon double")
    with pytest.raises(Exception, match="no known place"):
        attach_anchor(spark.createDataFrame([("d", 2)], "name string, anchor_cid long"), places).collect()
    left = spark.createDataFrame([("k",)], "k string")
    with pytest.raises(Exception, match="not unique"):
        join_once(left, spark.createDataFrame([("k", 1), ("k", 2)], "k string, v int"), "k").collect()


def test_channel_fallback_only_without_active_ones(spark):
    some = spark.createDataFrame([("a", None, None, True), ("b", None, None, None)], posts.CHANNEL_SCHEMA)
    spare = spark.createDataFrame([("c", "C", "uk", True)], posts.CHANNEL_SCHEMA)
    assert [tuple(r) for r in posts.active_channels(some, spare).collect()] == [("a", "a", "en", True)]
    assert [r["channel_name"] for r in posts.active_channels(some.filter("channel_name = 'b'"), spare).collect()] == ["c"]


def test_day_window_bounds(spark):
    rows = spark.createDataFrame([(x,) for x in ("2024-01-04 23:59:59.999999", "2024-01-05 00:00:00", "2024-01-05 23:59:59.999999", "2024-01-06 00:00:00", None)], "t string")
    kept = rows.filter(day_window(F.col("t").cast("timestamp"), "2024-01-05")).count()
    assert kept == 2
    with pytest.raises(ValueError):
        day_window(F.col("t"), "2024-01-05", "2024-01-04")


def test_empty_event_export_has_a_header(spark, tmp_path):
    empty = spark.createDataFrame([], "post_id string, event_id string")
    review.write_csv(empty, str(tmp_path / "e"))
    assert spark.read.text(str(tmp_path / "e")).first()["value"] == "post_id,event_id"


def test_kml_documents_are_whole(spark, tmp_path):
    rows = spark.createDataFrame([(i % 3, f"{i % 3}:{i}", i, "A&<b>", 48.0, 31.0) for i in range(7)], "post_id long, event_id string, location_id int, resolved_name string, lat double, lon double")
    review.write_kml(rows, str(tmp_path / "k"), by="post_id")
    assert sorted(f.name for f in (tmp_path / "k").glob("doc=*")) == ["doc=0", "doc=1", "doc=2"]
    marks = 0
    for f in (tmp_path / "k").rglob("part-*"):
        lines = f.read_text().splitlines()
        assert lines[0] == review.KML_HEAD and lines[-1] == review.KML_TAIL
        marks += len(lines) - 2
        assert "A&amp;&lt;b&gt;" in lines[1]
    assert marks == 7


def test_reviewed_tree_resolves_like_the_direct_path(spark, tmp_path):
    """Written, read back and resolved: the same places; disabled nodes are not resolved, and what hangs on them is gone."""
    from georeport.operators import scoring, tagging
    from georeport.operators.spatial import line_segments
    from georeport.params import Params
    from georeport.plans import resolve
    from georeport.plans.text import analyse_posts

    place = "row_no long, cid long, name string, aliases array<string>, lat double, lon double, region string, grp string, qid string"
    locales = spark.createDataFrame([(0, 10, "Kale", [], 48.0, 31.0, "Sumy Oblast", "East", "Q1"), (1, 11, "Kale", [], 50.0, 35.0, "Odesa Oblast", "East", "Q2"),
                                     (2, 12, "Lyman", [], 48.1, 31.1, "Sumy Oblast", "East", None), (3, 13, "Lyman", [], 47.0, 33.0, None, None, None)], place)
    region = "row_no int, name string, aliases array<string>, neighbors array<string>"
    regions = spark.createDataFrame([(0, "Sumy Oblast", ["Sumy"], []), (1, "Odesa Oblast", ["Odesa"], [])], region)
    groups = spark.createDataFrame([(0, "East", [], [], [])], "row_no int, name string, aliases array<string>, regions array<string>, neighbors array<string>")
    directions = spark.createDataFrame([(0, "Lyman", [], 12)], "row_no int, name string, aliases array<string>, anchor_cid long")
    triggers = spark.createDataFrame([("KINETIC_EVENT", "attack")], "label string, trigger string")
    posts = spark.createDataFrame([(1, "Odesa Oblast. Troops attack Kale and Lyman."), (2, "- Heading one:\nEast attack Kale, Lyman (Sumy). More attack Kale towards Lyman."),
                                   (3, "attack Lyman"), (4, "nothing")], "post_id long, text string")
    segments = line_segments(spark.createDataFrame([(0, 0, 30.0, 47.0), (0, 1, 32.0, 49.0)], "line_no int, pt_no int, lon double, lat double"))
    gaz = resolve.Gazetteer(locales, regions, groups, directions)
    t = analyse_posts(posts, tagging.dictionary(locales, regions, groups, directions, triggers))
    mentions, chosen = resolve.resolve_mentions(t.mentions, t.events, t.contexts, gaz, segments)
    ctx = resolve.event_contexts(t.events, t.contexts, gaz)
    offered = resolve.context.narrow_candidates(t.mentions, ctx, locales, Params())
    events = t.events.withColumn("enabled", t.events["event_id"] != "2:1")
    trees = review.build_trees(posts.selectExpr("*", "post_id <> 3 as enabled"), t.sections, events, mentions, t.contexts, offered, scoring.diagnostics(chosen))
    review.write_trees(trees, str(tmp_path / "trees"))
    back = review.reviewed_tables(review.read_trees(spark, str(tmp_path / "trees")))
    again, _ = resolve.resolve_mentions(back.mentions, back.events, back.contexts, gaz, segments)

    def found(df):
        return {(r.event_id, r.loc_no, r.text, r.final_cid, round(r.final_confidence or 0, 9)) for r in df.collect()}

    kept = {x for x in found(mentions) if x[0] != "2:1" and x[0][0] != "3"}
    assert kept and found(again) == kept and found(mentions) != kept
    told = {(r.event_id, r.loc_no, r.cid, r.name) for r in back.candidates.collect()}
    assert told == {(r.event_id, r.loc_no, r.cid, r.name) for r in offered.collect() if r.event_id != "2:1" and r.event_id[0] != "3"}
    diag = {r.event_id: r.diagnostics.bbox_km for r in back.events.collect()}
    assert diag == {r.event_id: r.bbox_km for r in scoring.diagnostics(chosen).collect() if r.event_id in diag}
    assert back.contexts.filter("post_id = '3' or event_id = '2:1'").count() == 0
    assert {r.level for r in back.contexts.collect()} == {"post", "section", "event", "location"}


def test_one_large_collection_in_ranges(spark, tmp_path):
    """Brackets, quotes and backslashes in strings, ranges that begin anywhere, objects longer than a range, objects that are no features."""
    rnd = random.Random(4)
    features = []
    for i in range(120):
        name = rnd.choice(["plain", 'quo"te', "back\\", '\\"', "}]{[", "é日本", "\\\\\\", "x" * 700, ""])
        features.append({"type": "Feature", "properties": {"id": str(i), "name": name, "deep": json.dumps([{"a": [1, {"b": "]"}]}])},
                         "geometry": None if i % 7 == 0 else {"type": "LineString", "coordinates": [[i, 0.5], [i + 1, 1.5]]}})
    doc = {"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": "x"}}, "bbox": [1, 2], "features": features, "more": [{"type": "Other"}, {"k": "}"}]}
    for k, text in enumerate((json.dumps(doc), json.dumps(doc, indent=1, ensure_ascii=False))):
        path = tmp_path / f"{k}.json"
        path.write_text(text)
        for size in ((331, 1 << 20) if k else (499,)):
            got, plain = ([(r.properties["id"], r.properties["name"], r.type, json.loads(r.coordinates or "0")) for r in rows.orderBy("feature_no").collect()]
                          for rows in (geojson.read_collection(spark, str(path), size), geojson.read_features(spark, str(path))))
            assert got == plain and len(got) == 120


def test_candidates_given_once_per_name_make_the_same_trees(spark, tmp_path):
    """Lists per name or per mention; a name without places, a mention without a name, events and posts without mentions."""
    posts = spark.createDataFrame([(p, f"post {p}") for p in range(5)], "post_id long, text string")
    sections = spark.createDataFrame([(p, f"{p}:s{s}", s, f"section {s}") for p in range(4) for s in range(2)], "post_id long, section_id string, section_no int, text string")
    events = spark.createDataFrame([(p, f"{p}:s{e % 2}", f"{p}:{e}", f"event {e}", None, None, "k", "a") for p in range(3) for e in range(3)],
                                   "post_id long, section_id string, event_id string, text string, actor_kind string, actor_text string, action_kind string, action_text string")
    names = ["a", "b", "none", None]
    located = spark.createDataFrame([(f"{p}:{e}", k, f"loc {k}", names[(p + e + k) % 4], k, "n", 1.0, 2.0, "r", "g", 0.5) for p in range(3) for e in range(2) for k in range(3)],
                                    "event_id string, loc_no int, text string, name string, final_cid long, final_name string, final_lat double, final_lon double, "
                                    "final_region string, final_group string, final_confidence double")
    place = "name string, row_no long, cid long, lat double, lon double, region string, grp string, qid string, unary double"
    places = spark.createDataFrame([(n, 9 - c, 10 * i + c, 48.0, 31.0, "r", None, "Q", c / 8) for i, n in enumerate("ab") for c in range(3)], place)
    each = located.select("event_id", "loc_no", "name").join(places, "name")
    old = review.build_trees(posts, sections, events, located, candidates=each)
    # The places come with the name that was asked for.
    new = review.build_trees(posts, sections, events, located.withColumnRenamed("name", "want"), candidates=places.withColumn("want", F.col("name")), offered_by=["want"])
    assert new.schema.simpleString() == old.schema.simpleString()
    assert sorted(map(str, new.collect())) == sorted(map(str, old.collect()))
    review.write_trees(new, str(tmp_path / "trees"))
    back = review.reviewed_tables(review.read_trees(spark, str(tmp_path / "trees")))
    got = sorted((r.event_id, r.loc_no, r.cand_no, r.cid, r.scores["unary"]) for r in back.candidates.collect())
    rows = sorted((r.event_id, r.loc_no, 9 - r.row_no, r.cid, r.unary) for r in each.collect())
    assert [x[:2] + x[3:] for x in got] == [x[:2] + x[3:] for x in sorted((e, m, 2 - c, cid, u) for e, m, c, cid, u in rows)] and len(got) == len(rows) > 20
    assert back.mentions.count() == located.count() and back.events.count() == 9
    # Nodes are read without candidates.
    plan = back.contexts._jdf.queryExecution().executedPlan().toString()
    assert "contexts" in plan and "offers" not in plan


def test_nodes_of_trees_are_read_without_candidates(spark, tmp_path):
    """Contexts are stored without candidates, which are parsed where they are asked for; both ways give the same tables."""
    ctx = [{"kind": "region", "text": "R"}]
    locations = [{"location_id": str(k), "span_text": f"s{k}", "enabled": k != 1, "contexts": ctx, "candidate_texts": ["n"],
                  "candidates": [{"locale": {"cid": 10 * k + c, "name": "n", "lat": 1.0, "lon": 2.0}, "scores": {"unary": c / 8}} for c in range(3)]} for k in range(3)]
    trees = [{"post_id": str(p), "enabled": p != 2, "contexts": ctx, "children": [{"section_id": "S0", "contexts": ctx, "children": [
        {"event_id": f"{p}:0", "contexts": ctx, "children": locations}]}]} for p in range(4)]
    (tmp_path / "trees").write_text("\n".join(map(json.dumps, [*trees, {"post_id": "5", "children": None}])))
    whole, nodes = (review.read_trees(spark, str(tmp_path / "trees"), candidates=c) for c in (True, False))
    assert "candidates:" not in nodes.schema.simpleString() and "candidates:" in whole.schema.simpleString()
    old, new = review.reviewed_tables(whole), review.reviewed_tables(whole, nodes)
    for name in ("posts", "sections", "contexts", "events", "mentions", "candidates"):
        a, b = getattr(old, name), getattr(new, name)
        assert a.schema.simpleString() == b.schema.simpleString() and sorted(map(str, a.collect())) == sorted(map(str, b.collect())), name
    assert new.candidates.count() == 3 * 2 * 3 and new.contexts.count() == 3 * (1 + 1 + 1 + 2)
