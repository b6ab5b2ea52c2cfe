"""Tagging, sections, scoping and events on hand-made posts."""

import pytest
from pyspark.sql import functions as F

from georeport.operators import structure, tagging
from georeport.params import Params
from georeport.plans.text import analyse_posts

ENT = "name string, aliases array<string>, row_no int"


@pytest.fixture(scope="module")
def patterns(spark):
    locales = spark.createDataFrame([("Kale", ["Yeni-Kale"], 0), ("Lyman", [], 1), ("North Lyman", [], 2), ("Rivne", None, 3)], ENT)
    regions = spark.createDataFrame([("Sumy Oblast", ["Sumy"], 0)], ENT)
    groups = spark.createDataFrame([("Group East", [], 0)], ENT)
    directions = spark.createDataFrame([("Rivne", [], 0)], ENT)
    triggers = spark.createDataFrame([("KINETIC_EVENT", "attack"), ("OUTCOME_EVENT", "shot down")], "label string, trigger string")
    return tagging.dictionary(locales, regions, groups, directions, triggers)


def _spans(spark, patterns, text):
    posts = spark.createDataFrame([(1, text)], "post_id int, text string")
    return [(r["label"], r["surface"]) for r in tagging.tag_spans(posts, patterns, Params().templates).orderBy("ts").collect()]


def _spans_of(spark, patterns, texts):
    posts = spark.createDataFrame(list(enumerate(texts)), "post_id int, text string")
    out = [[] for _ in texts]
    for r in tagging.tag_spans(posts, patterns, Params().templates).orderBy("post_id", "ts").collect():
        out[r["post_id"]].append((r["label"], r["surface"]))
    return out


def test_longest_span_wins_and_offsets_fit(spark, patterns):
    text = "Near NORTH  Lyman, yeni–kale; in the direction of Rivne. The Lyman"
    posts = spark.createDataFrame([(1, text)], "post_id int, text string")
    rows = tagging.tag_spans(posts, patterns, Params().templates).orderBy("ts").collect()
    assert [(r["label"], r["surface"]) for r in rows] == [
        ("PROXIMITY", "Near NORTH  Lyman"), ("LOCALE", "yeni–kale"), ("DIRECTION", "in the direction of Rivne"), ("LOCALE", "Lyman")]
    assert all(text[r["cs"]:r["ce"]] == r["surface"] for r in rows)


def test_punctuation_breaks_names_and_shapes(spark, patterns):
    assert _spans(spark, patterns, "Yeni, Kale. towards, Rivne") == [("LOCALE", "Kale"), ("LOCALE", "Rivne")]
    assert _spans(spark, patterns, "Rivne sector and the Rivne line") == [("DIRECTION", "Rivne sector"), ("DIRECTION", "the Rivne line")]
    assert _spans(spark, patterns, "") == []


def test_long_text_offsets(spark, patterns):
    text = "ab cd. " * 3000 + "Lyman"
    posts = spark.createDataFrame([(1, text)], "post_id int, text string")
    r = tagging.tag_spans(posts, patterns, Params().templates).first()
    assert (r["cs"], r["ce"], r["ts"]) == (21000, 21005, 9000)


def test_events_sections_and_scope(spark, patterns):
    text = "\nTroops attack Kale, Lyman (Sumy). Then\n- Second Heading:\nGroup East shot down near Lyman; attack.\n\nEnd Rivne direction attack Kale"
    t = analyse_posts(spark.createDataFrame([(7, text)], "post_id int, text string"), patterns)
    events = {r["event_id"]: r for r in t.events.collect()}
    assert [events[k]["action_text"] for k in sorted(events)] == ["attack", "shot down", "attack", "attack"]
    assert events["7:1"]["actor_text"] == "Group East" and events["7:0"]["actor_text"] is None
    assert [r["text"] for r in t.mentions.filter("event_id = '7:0'").orderBy("loc_no").collect()] == ["Kale", "Lyman"]
    scoped = {(r["event_id"], r["level"], r["loc_no"], r["pass"], r["kind"]) for r in t.contexts.filter("event_id is not null").collect()}
    assert {("7:0", "location", 0, 1, "region"), ("7:0", "location", 1, 1, "region")} <= scoped
    assert ("7:3", "event", None, 1, "direction") in scoped and ("7:3", "event", None, 2, "direction") in scoped
    sections = [(r["section_id"], r["cs"]) for r in t.sections.orderBy("section_no").collect()]
    assert sections[0] == ("S0", 0) and len(sections) == 5


def test_long_sections_are_cut_at_blank_lines(spark):
    text = "a" * 700 + "\n\n" + "b" * 200
    rows = spark.createDataFrame([(1, text), (2, "a\n\nb")], "post_id int, text string").withColumn(
        "spans", F.expr("cast(array() as array<struct<ts:int,te:int,cs:int,ce:int,ln:int,label:string,surface:string,key:string>>)"))
    got = {r["post_id"]: [s["section_id"] for s in r["s"]] for r in rows.select("post_id", structure.section_array(F.col("text"), F.col("spans")).alias("s")).collect()}
    assert got == {1: ["S0.0", "S0.1"], 2: ["S0"]}


@pytest.mark.parametrize("text,want", [
    ("Forces struck a depot 3.5 km from Lyman today.", ["Forces struck a depot 3.5 km from Lyman today."]),
    ("It began at 11:30. Next day calm.", ["It began at 11:30.", "Next day calm."]),
    ("Gen. Smith and Col. Gen. Jones met. Fine", ["Gen. Smith and Col. Gen. Jones met.", "Fine"]),
    ("He said \"go.\" They went… Then left!\n- Last", ["He said \"go.\"", "They went…", "Then left!", "- Last"]),
    ("... \n", []), ("First.\u00a0Second", ["First.", "Second"]), ("v1.2.3 is out", ["v1.2.3 is out"]),
])
def test_sentences(spark, text, want):
    row = spark.createDataFrame([(text,)], "t string").select(tagging.sentences(F.col("t")).alias("s"), tagging.word_table(F.col("t")).alias("w")).first()
    assert row["s"] == want
    # Words are numbered as the sentences are.
    assert sorted({w["sn"] for w in row["w"]}) == list(range(len(want)))
    for w in row["w"]:
        assert w["w"] in want[w["sn"]]


def test_heading_after_a_no_break_space(spark):
    from georeport.operators.structure import HEADING
    row = spark.createDataFrame([("-\u00a0Heading here",), ("- lower",), ("*Ab",)], "t string").select(F.col("t").rlike(HEADING)).collect()
    assert [r[0] for r in row] == [True, False, False]


def test_posts_of_two_channels_stay_apart(spark, patterns):
    from georeport.plans.report import keyed_posts, report
    from georeport.plans.resolve import Gazetteer
    rows = [("s", "a", 7, "Troops attack Kale"), ("s", "b", 7, "Troops attack Lyman. Then attack Kale")]
    posts = spark.createDataFrame(rows, "source string, channel string, post_id long, text string")
    kind = "row_no long, cid long, name string, aliases array<string>, lat double, lon double, region string, grp string, qid string, place string, usage int, source string"
    locales = spark.createDataFrame([(i, i, n, [], 48.0 + i, 31.0, "r", "g", None, None, 0, "base") for i, n in enumerate(["Kale", "Lyman"])], kind)
    none = spark.createDataFrame([], "row_no long, name string, aliases array<string>, qid string, anchor_cid long, regions array<string>, neighbors array<string>, group_id int")
    segments = spark.createDataFrame([(0, 0, 30.0, 47.0), (0, 1, 32.0, 49.0)], "line_no int, pt_no int, lon double, lat double")
    from georeport.operators.spatial import line_segments
    got = report(posts, patterns, Gazetteer(locales, none, none, none), line_segments(segments))
    found = sorted((r["post_id"], r["event_id"], r["final_name"]) for r in got.mentions.collect())
    assert found == [("s/a/7", "s/a/7:0", "Kale"), ("s/b/7", "s/b/7:0", "Lyman"), ("s/b/7", "s/b/7:1", "Kale")]
    with pytest.raises(ValueError, match="more than once"):
        keyed_posts(posts.union(posts))


def test_names_of_many_words_and_odd_first_words(spark):
    """First words with apostrophes, dashes and "the" inside; names of 15 words; words that vanish from a key."""
    long = " ".join(f"part{i}" for i in range(15))
    locales = spark.createDataFrame([(long, [], 0), ("Netherlands", ["O'Brien Town"], 1), ("Foo the Bar", [], 2), ("’ Quoted", ["x-y z"], 3)], ENT)
    none = locales.limit(0)
    patterns = tagging.dictionary(locales, none, none, none)

    texts = {f"In {long.upper()} and part0 part1": [long.upper()], "the NETHERLANDS, nerlands, O’brien   town OBRIEN TOWN": ["NETHERLANDS", "nerlands", "O’brien   town", "OBRIEN TOWN"],
             "foo bar foo the bar the foo-bar": ["foo bar", "foo the bar", "foo-bar"], "quoted X–Y Z x y z xy z": ["quoted", "X–Y Z", "x y z"]}
    assert _spans_of(spark, patterns, list(texts)) == [[("LOCALE", x) for x in want] for want in texts.values()]


def test_every_default_shape(spark, patterns):
    shapes = (("in the direction of Rivne", "DIRECTION"), ("towards Rivne", "DIRECTION"), ("Rivne direction", "DIRECTION"), ("Rivne axis", "DIRECTION"),
              ("Rivne sector", "DIRECTION"), ("the Rivne line", "DIRECTION"), ("near North Lyman", "PROXIMITY"))
    assert _spans_of(spark, patterns, [f"Xx {text} yy." for text, _ in shapes]) == [[(label, text)] for text, label in shapes]


def test_starts_never_miss(spark):
    """Every name of a large dictionary is found, whatever the size of the bit map."""
    names = [f"w{i} v{i % 7}" if i % 3 else f"w{i}" for i in range(3000)]
    locales = spark.createDataFrame([(n, [], i) for i, n in enumerate(names)], ENT)
    none = locales.limit(0)
    patterns = tagging.dictionary(locales, none, none, none)
    posts = spark.createDataFrame([(i, f"{n}, zz") for i, n in enumerate(names)], "post_id int, text string")
    small = tagging.MAP_BITS
    try:
        for bits in (small, 1 << 8):
            tagging.MAP_BITS = bits
            got = {(r.post_id, r.surface) for r in tagging.tag_spans(posts, patterns, ()).collect()}
            assert got == set(enumerate(names))
    finally:
        tagging.MAP_BITS = small


def test_long_run_of_touching_spans(spark):
    """20,000 spans of which each overlaps the next ones: longest first, then leftmost."""
    rows = [(1, "LOCALE", i, i + (5 if i % 11 == 0 else 3), 0, 0, 0, "s", "k") for i in range(20_000)] + [(2, "GROUP", 0, 1, 0, 0, 0, "s", "k"), (2, "LOCALE", 0, 1, 0, 0, 0, "s", "k")]
    hits = spark.createDataFrame(rows, "post_id int, label string, ts int, te int, cs int, ce int, ln int, surface string, key string")
    got = tagging.choose_spans(hits).collect()
    taken, want = set(), []
    for _, ts, te in sorted((r[2] - r[3], r[2], r[3]) for r in rows[:20_000]):
        if not taken & set(range(ts, te)):
            taken |= set(range(ts, te))
            want.append((ts, te))
    assert sorted((r.ts, r.te) for r in got if r.post_id == 1) == sorted(want)
    assert [r.label for r in got if r.post_id == 2] == ["LOCALE"]


def test_events_from_match_records(spark, patterns):
    import json

    from georeport.plans.text import analyse_records
    text = "(Note) Troops shelled Kale, Lyman (Sumy). Then\n- Second Heading:\nGroup East moved near Lyman!"
    posts = spark.createDataFrame([(7, text), (8, "")], "post_id int, text string")

    def word(first, last, **more):
        return {"document_token_index": last, "first_document_token_index": first, **more}

    records = [{"document": "7", "search_phrase_label": "K", "search_phrase_text": " Shelling ", "negated": True, "overall_similarity_measure": 0.9, "word_matches": [word(3, 11)]},
               {"document_label": "7", "search_phrase_label": "M", "word_matches": [word(17, 22)], "sentences_within_document": "own words", "uncertain": 1, "involves_coreference": True},
               {"document_name": "7", "overall_similarity_measure": 0.1, "word_matches": [word(0, 1)]},
               {"document": "7", "word_matches": []}, {"document": "8", "word_matches": [word(4, 5)]}, {"document": "unknown", "word_matches": [word(0, 1)]}]
    lines = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)], "match_no long, value string")
    t = analyse_records(posts, patterns, lines, Params(min_similarity=0.5))
    events = {r.event_id: r for r in t.events.collect()}
    assert set(events) == {"7:0", "7:1", "7:3", "8:0"}
    one, two, bare = events["7:0"], events["7:1"], events["7:3"]
    assert (one.text, one.action_kind, one.action_label, one.negated, one.uncertain, one.similarity) == ("Troops shelled Kale, Lyman (Sumy).", "shelling", "artillery_shelling", True, False, 0.9)
    assert (one.s_ts, one.s_te, one.s_cs) == (3, 12, 7) and one.section_id == "S0"
    assert (two.text, two.actor_text, two.uncertain, two.coreference, two.similarity) == ("own words", "Group East", True, True, 1.0) and two.section_id != "S0"
    assert (bare.text, bare.action_kind, bare.s_cs) == ("", None, 0) and events["8:0"].text == ""
    assert [r.text for r in t.mentions.filter("event_id = '7:0'").orderBy("loc_no").collect()] == ["Kale", "Lyman"]
    scoped = {(r.event_id, r.level, r.loc_no, r.kind) for r in t.contexts.filter("event_id is not null").collect()}
    assert {("7:0", "location", 0, "region"), ("7:0", "location", 1, "region"), ("7:1", "event", None, "group")} <= scoped
    assert t.sections.filter("post_id = 7").count() > 1 and t.contexts.filter("level = 'post'").count() > 0
