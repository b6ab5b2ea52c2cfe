"""Match records, mentions, review trees, exports and summaries."""

import re

from pyspark.sql import functions as F

from checks.ctes import CTES
from checks.queries_resolve import _CONF, beam_sql
from checks.registry import query
from georeport.functions.labels import action_kind, action_label, snippet
from georeport.operators import filters, scoring, structure, summary
from georeport.operators.common import scratch_path
from georeport.sources import records, review

CTES.update({
    "tx_matches": """SELECT *, idx % 11 = 5 AS bare, CASE WHEN idx % 7 = 3 THEN 1.0e0 ELSE (idx % 10) / 10.0e0 END AS similarity FROM (
        SELECT *, CAST(split_part(event_id, ':', 2) AS BIGINT) AS idx FROM tx_events)""",
    "tx_match_words": """SELECT event_id, CAST(0 AS INTEGER) AS word_no, 'Somebody' AS document_word, s_ts AS i0, s_ts AS i1, s_ts AS i2, CAST(NULL AS VARCHAR) AS extracted_word, false AS negated,
          CASE WHEN idx % 2 = 0 THEN 0.5e0 ELSE 1.0e0 END AS similarity_measure, post_id FROM tx_matches WHERE NOT bare
        UNION ALL SELECT event_id, 1, action_text, s_te - 1, s_te - 2, s_te - 1, left(action_text, 4), idx % 5 = 1, 1.0e0, post_id FROM tx_matches WHERE NOT bare""",
    "tx_direct": "SELECT event_id, ts, te, label, surface FROM tx_event_spans WHERE label IN ('LOCALE', 'REGION')",
    "tx_extracted": """SELECT DISTINCT w.event_id, w.word_no, s.ts, s.te, s.label, s.surface FROM tx_match_words w JOIN tx_spans s ON s.post_id = w.post_id AND s.label IN ('LOCALE', 'REGION')
        AND w.extracted_word <> '' AND contains(lower(s.surface), lower(w.extracted_word))""",
    "tx_all_mentions": """SELECT event_id, ts, te, label, surface, min((src, word_no)) AS o FROM (SELECT event_id, ts, te, label, surface, 0 AS src, 0 AS word_no FROM tx_direct
        UNION ALL SELECT event_id, ts, te, label, surface, 1, word_no FROM tx_extracted) GROUP BY ALL""",
})


# Events from match records: the token range of a match, its chars, and the text layer over it.
CTES["mx_tokens"] = r"""SELECT post_id, te - 1 AS t, ce - length(p) AS cs, ce FROM tx_counted WHERE is_word UNION ALL
    SELECT post_id, te0 + row_number() OVER (PARTITION BY post_id, i ORDER BY j) - 1, c0 + j - 1, c0 + j FROM (SELECT post_id, i, p, ce - length(p) AS c0,
      te - length(regexp_replace(p, '\s+', '', 'g')) AS te0, unnest(range(1, length(p) + 1)) AS j FROM tx_counted WHERE NOT is_word) WHERE regexp_matches(substr(p, j, 1), '\S')"""
CTES["mx_events0"] = """SELECT m.* EXCLUDE (text), a.cs AS s_cs, CASE WHEN s_te > s_ts THEN substr(p.text, a.cs + 1, b.ce - a.cs) ELSE '' END AS text FROM (
    SELECT post_id, event_id, label, action_text AS trigger, similarity, idx % 4 = 0 AS negated, '' AS text,
      CASE WHEN bare THEN 0 ELSE least(s_ts, s_te - 2) END AS s_ts, CASE WHEN bare THEN 0 ELSE s_te END AS s_te FROM tx_matches WHERE similarity >= 0.2) m
    JOIN fx_posts p USING (post_id) LEFT JOIN mx_tokens a ON a.post_id = m.post_id AND a.t = greatest(m.s_ts, 0) LEFT JOIN mx_tokens b ON b.post_id = m.post_id AND b.t = m.s_te - 1"""
_OVER = ("tx_events0", "tx_event_spans", "tx_mentions", "tx_loc_ends", "tx_scoped", "tx_placed", "tx_action")
for _name in _OVER[1:]:
    _sql = CTES[_name]
    for _other in _OVER:
        _sql = re.sub(rf"\b{_other}\b", _other.replace("tx_", "mx_"), _sql)
    CTES[_name.replace("tx_", "mx_")] = _sql


def _record_tables(fx):
    from checks.fixtures import TEMPLATES
    from georeport.params import Params
    from georeport.plans.text import analyse_records
    return analyse_records(fx.posts, fx.patterns, fx.matches, Params(min_similarity=0.2, templates=TEMPLATES), fx.spark.sparkContext.defaultParallelism)


@query("i04b_record_events", """SELECT e.post_id, e.event_id, p.section_id, e.label, e.text, g.surface AS actor_text, a.action_kind, e.trigger AS action_text, e.s_ts, e.s_te, e.s_cs, e.negated, e.similarity
  FROM mx_events0 e JOIN mx_placed p USING (event_id) JOIN mx_action a USING (event_id)
  LEFT JOIN (SELECT event_id, arg_min(surface, ts) AS surface FROM mx_event_spans WHERE label = 'GROUP' GROUP BY event_id) g USING (event_id)""")
def _(fx):
    return _record_tables(fx).events.select("post_id", "event_id", "section_id", "label", "text", "actor_text", "action_kind", "action_text",
                                            *(F.col(c).cast("long").alias(c) for c in ("s_ts", "s_te", "s_cs")), "negated", "similarity")


@query("i05b_record_mentions", "SELECT event_id, loc_no, text, ts, te FROM mx_mentions")
def _(fx):
    return _record_tables(fx).mentions.select("event_id", "loc_no", "text", F.col("ts").cast("long").alias("ts"), F.col("te").cast("long").alias("te"))


@query("i08b_record_contexts", """SELECT post_id, 'post' AS level, CAST(post_id AS VARCHAR) AS owner, kind, text FROM tx_post_contexts
UNION ALL SELECT post_id, 'section', section_id, kind, text FROM tx_section_contexts
UNION ALL SELECT e.post_id, CASE WHEN loc_no IS NULL THEN 'event' ELSE 'location' END, event_id || coalesce(':loc' || loc_no, ''), kind, x.text FROM mx_scoped x JOIN mx_events0 e USING (event_id)""")
def _(fx):
    owner = (F.when(F.col("level") == "post", F.col("post_id").cast("string")).when(F.col("level") == "section", F.col("section_id"))
             .when(F.col("level") == "event", F.col("event_id")).otherwise(F.concat("event_id", F.lit(":loc"), F.col("loc_no").cast("string"))))
    return _record_tables(fx).contexts.select("post_id", "level", owner.alias("owner"), "kind", "text")


@query("a13_match_words", """SELECT event_id, word_no, document_word, i0 AS document_token_index, i1 AS first_document_token_index, i2 AS last_document_token_index, extracted_word, negated, similarity_measure,
  CAST(0 AS BIGINT) AS depth FROM tx_match_words""")
def _(fx):
    return records.match_words_of(records.match_events(fx.matches)).select(
        "event_id", "word_no", "document_word", "document_token_index", "first_document_token_index", "last_document_token_index", "extracted_word", "negated", "similarity_measure", "depth")


@query("b09_similarity_floor", "SELECT event_id, label, similarity, idx % 4 = 0 AS negated FROM tx_matches WHERE similarity >= 0.3")
def _(fx):
    return records.match_events(fx.matches, 0.3).select("event_id", "label", "similarity", "negated")


@query("b11_content_words", "SELECT event_id, word_no, document_word FROM tx_match_words WHERE lower(document_word) <> 'somebody'")
def _(fx):
    return records.content_words(records.match_words_of(records.match_events(fx.matches))).select("event_id", "word_no", "document_word")


@query("d05_match_span", "SELECT event_id, CASE WHEN bare THEN 0 ELSE least(s_ts, s_te - 2) END AS s_ts, CASE WHEN bare THEN 0 ELSE s_te END AS s_te FROM tx_matches")
def _(fx):
    return records.match_events(fx.matches).select("event_id", "s_ts", "s_te")


@query("d11_matches_per_post", "SELECT CAST(post_id AS VARCHAR) AS post_id, count(*) AS n FROM tx_matches GROUP BY post_id")
def _(fx):
    return records.match_events(fx.matches).groupBy("post_id").agg(F.count("*").alias("n"))


def _mentions(fx):
    spans = fx.spans.withColumn("post_id", F.col("post_id").cast("string")).select("post_id", "ts", "te", "label", "surface")
    events = fx.report_events.withColumn("post_id", F.col("post_id").cast("string"))
    direct = structure.spans_in_event(spans, events, ("LOCALE", "REGION"))
    words = records.match_words_of(records.match_events(fx.matches))
    return filters.event_mentions(direct, words, spans)


@query("c18_extracted_spans", "SELECT event_id, ts, te, label FROM tx_extracted GROUP BY ALL")
def _(fx):
    spans = fx.spans.withColumn("post_id", F.col("post_id").cast("string")).select("post_id", "ts", "te", "label", "surface")
    words = records.match_words_of(records.match_events(fx.matches))
    none = spans.limit(0).select("post_id", F.lit("").alias("event_id"), "ts", "te", "label", "surface")
    return filters.event_mentions(none, words, spans).select("event_id", *(F.col(c).cast("long").alias(c) for c in ("ts", "te")), "label")


@query("g04_all_mentions", "SELECT event_id, ts, te, label, surface FROM tx_all_mentions")
def _(fx):
    return _mentions(fx).select("event_id", *(F.col(c).cast("long").alias(c) for c in ("ts", "te")), "label", "surface")


@query("e04_mention_ids", """SELECT event_id, event_id || ':loc' || (row_number() OVER (PARTITION BY event_id ORDER BY o, ts, te, label) - 1) AS mention_id, ts, label FROM tx_all_mentions""")
def _(fx):
    return filters.number_mentions(_mentions(fx)).select("event_id", "mention_id", F.col("ts").cast("long").alias("ts"), "label")


# ------------------------------------------------------------------ trees and exports


def _resolved(fx):
    return scoring.write_back(fx.mentions, fx.chosen, fx.locales)


def _trees(fx):
    path = scratch_path(fx.spark, "trees")
    review.write_trees(review.build_trees(fx.posts.select("post_id", "text"), fx.sections, fx.report_events, _resolved(fx)), path)
    return review.flatten_trees(review.read_trees(fx.spark, path))


@query("a12_read_tree_locations", beam_sql("tx_scored") + _CONF + """ SELECT CAST(m.post_id AS VARCHAR) AS post_id, e.section_id, m.event_id, m.loc_no, m.text AS span_text, p.cid AS final_cid, round(confidence, 6) AS confidence, true AS enabled
FROM tx_mentions m JOIN tx_placed e USING (event_id) LEFT JOIN beam_picks p USING (event_id, loc_no) LEFT JOIN cf USING (event_id, loc_no)""")
def _(fx):
    x = _trees(fx)[3]
    return x.select("post_id", "section_id", "event_id", "loc_no", "span_text", F.col("final_locale.cid").alias("final_cid"), F.round("final_confidence", 6).alias("confidence"), "enabled")


@query("a17_written_tree_events", """SELECT CAST(post_id AS VARCHAR) AS post_id, section_id, event_id, text AS raw_text, actor_text, action_kind, action_text,
  CAST(row_number() OVER (PARTITION BY post_id, section_id ORDER BY CAST(split_part(event_id, ':', 2) AS BIGINT)) - 1 AS INTEGER) AS event_no FROM tx_events""")
def _(fx):
    return _trees(fx)[2].select("post_id", "section_id", "event_id", "raw_text", "actor_text", "action_kind", "action_text", "event_no")


def _reviewed(fx, candidates=True):
    """Whole trees, written and read back; every fifth post is disabled. Candidates are only parsed for queries that ask for them."""
    path = scratch_path(fx.spark, "trees")
    posts = fx.posts.select("post_id", "text", (F.col("post_id") % 5 != 0).alias("enabled"))
    located = _resolved(fx).join(fx.mentioned, ["event_id", "loc_no"], "left")
    review.write_trees(review.build_trees(posts, fx.sections, fx.report_events, located, fx.contexts, fx.want_scored, scoring.diagnostics(fx.chosen), ["want"]), path)
    return review.reviewed_tables(review.read_trees(fx.spark, path), None if candidates else review.read_trees(fx.spark, path, candidates=False))


@query("a12b_reviewed_contexts", """SELECT * FROM (SELECT post_id, 'post' AS level, CAST(post_id AS VARCHAR) AS owner, kind, text FROM tx_post_contexts
UNION ALL SELECT post_id, 'section', section_id, kind, text FROM tx_section_contexts
UNION ALL SELECT e.post_id, CASE WHEN loc_no IS NULL THEN 'event' ELSE 'location' END, event_id || coalesce(':loc' || loc_no, ''), kind, x.text FROM tx_scoped x JOIN tx_events0 e USING (event_id))
WHERE post_id % 5 <> 0""")
def _(fx):
    owner = (F.when(F.col("level") == "post", F.col("post_id")).when(F.col("level") == "section", F.col("section_id"))
             .when(F.col("level") == "event", F.col("event_id")).otherwise(F.concat("event_id", F.lit(":loc"), F.col("loc_no").cast("string"))))
    return _reviewed(fx, candidates=False).contexts.select(F.col("post_id").cast("long").alias("post_id"), "level", owner.alias("owner"), "kind", "text")


@query("a17b_tree_candidates", """SELECT s.event_id, s.loc_no, s.cid, round(s.unary, 6) AS unary FROM tx_scored s JOIN tx_events0 e USING (event_id) WHERE e.post_id % 5 <> 0""")
def _(fx):
    return _reviewed(fx).candidates.select("event_id", "loc_no", "cid", F.round(F.col("scores")["unary"], 6).alias("unary"))


@query("a18_event_export", """SELECT CAST(post_id AS VARCHAR) AS post_id, section_id, event_id, coalesce(actor_text, '') AS actor, action_text AS action, coalesce(c, '') AS contexts FROM tx_events
LEFT JOIN (SELECT event_id, string_agg(text, '; ' ORDER BY pass, ts) AS c FROM tx_scoped WHERE loc_no IS NULL GROUP BY event_id) USING (event_id)""")
def _(fx):
    path = scratch_path(fx.spark, "events")
    review.write_csv(review.event_rows(fx.report_events, fx.contexts.filter("level = 'event'")), path)
    got = fx.spark.read.csv(path, header=True, escape='"')
    return got.select("post_id", "section_id", "event_id", *(F.coalesce(c, F.lit("")).alias(c) for c in ("actor", "action", "contexts")))


_LOC = """ SELECT e.post_id, e.section_id, p.event_id, p.loc_no AS location_id, m.text AS span_text, l.name AS resolved_name, p.lat, p.lon, round(confidence, 6) AS confidence
FROM beam_picks p JOIN tx_mentions m USING (event_id, loc_no) JOIN tx_events e USING (event_id) JOIN fx_locales l ON l.row_no = p.row_no JOIN cf USING (event_id, loc_no)"""


@query("a19_location_export", beam_sql("tx_scored") + _CONF + _LOC)
def _(fx):
    return review.location_rows(_resolved(fx), fx.report_events).withColumn("confidence", F.round("confidence", 6))


@query("a20_placemarks", beam_sql("tx_scored") + _CONF + f""" SELECT '<Placemark><name>' || resolved_name || '</name><description>Post ' || post_id || ', Event ' || event_id || '</description><Point><coordinates>' || lon || ',' || lat
  || ',0</coordinates></Point></Placemark>' AS line FROM ({_LOC})""")
def _(fx):
    path = scratch_path(fx.spark, "kml")
    review.write_kml(review.location_rows(_resolved(fx), fx.report_events), path, by="section_id")
    return fx.spark.read.text(path).filter(F.col("value").startswith("<Placemark>")).select(F.col("value").alias("line"))


@query("b12_enabled_locations", """SELECT m.event_id, m.loc_no FROM tx_mentions m JOIN tx_placed p USING (event_id) JOIN tx_sections s ON s.post_id = m.post_id AND s.section_id = p.section_id
WHERE m.post_id % 5 <> 0 AND s.section_no % 3 <> 1 AND CAST(split_part(event_id, ':', 2) AS BIGINT) % 4 <> 2 AND loc_no % 2 = 0""")
def _(fx):
    idx = F.element_at(F.split("event_id", ":"), -1).cast("long")
    out = filters.enabled_nodes(
        fx.posts.select("post_id", (F.col("post_id") % 5 != 0).alias("enabled")), fx.sections.withColumn("enabled", F.col("section_no") % 3 != 1),
        fx.report_events.withColumn("enabled", idx % 4 != 2), fx.mentions.withColumn("enabled", F.col("loc_no") % 2 == 0))
    return out[3].select("event_id", "loc_no")


# --------------------------------------------------------------------------- summaries


def _snip(text: str, n: int) -> str:
    t = f"replace(trim({text}, chr(32) || chr(9) || chr(10) || chr(13)), chr(10), ' ')"
    return f"left({t}, {n}) || CASE WHEN length({t}) > {n} THEN '…' ELSE '' END"


@query("h16_snippets", f"SELECT post_id, {_snip('text', 1000)} AS s1000, {_snip('text', 200)} AS s200 FROM fx_posts")
def _(fx):
    return fx.posts.select("post_id", snippet(F.col("text"), 1000).alias("s1000"), snippet(F.col("text"), 200).alias("s200"))


@query("h17_action_classes", """SELECT text_id, CASE WHEN contains(v, 'shell') THEN 'shelling' WHEN v IN ('attack', 'attacked', 'assault') THEN 'attack' WHEN v IN ('advance', 'advanced') THEN 'advance'
  WHEN v IN ('defend', 'defended') THEN 'defense' WHEN v IN ('capture', 'captured', 'took') THEN 'capture' WHEN v <> '' THEN 'other' END AS kind,
  CASE WHEN contains(v, 'shell') THEN 'artillery_shelling' WHEN v IN ('attack', 'attacked', 'assault') THEN 'attack' WHEN v IN ('advance', 'advanced') THEN 'advance'
  WHEN v IN ('defend', 'defended') THEN 'defense' WHEN v IN ('capture', 'captured', 'took') THEN 'capture' WHEN v <> '' THEN 'other' END AS label
FROM (SELECT text_id, trim(CASE text_id % 8 WHEN 0 THEN ' Attack ' WHEN 1 THEN 'shelled' WHEN 2 THEN 'advance' WHEN 3 THEN 'defended' WHEN 4 THEN 'took' WHEN 5 THEN '' WHEN 6 THEN NULL ELSE lower(text) END) AS v0, lower(v0) AS v FROM fx_texts)""")
def _(fx):
    m = F.col("text_id") % 8
    v = (F.when(m == 0, " Attack ").when(m == 1, "shelled").when(m == 2, "advance").when(m == 3, "defended").when(m == 4, "took").when(m == 5, "").when(m == 6, F.lit(None)).otherwise(F.lower("text")))
    return fx.texts.select("text_id", action_kind(v).alias("kind"), action_label(v).alias("label"))


@query("h18_parsed_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def _(fx):
    return fx.table("events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


CTES.update({
    "tx_marks": """SELECT event_id, pass, ts, kind, text, CASE WHEN kind NOT IN ('direction', 'proximity') THEN '' WHEN direction IS NOT NULL OR n = 1 THEN ' ✓' WHEN n > 1 THEN ' (~)' ELSE ' (?)' END AS mark FROM (
      SELECT t.event_id, t.pass, t.ord AS ts, t.kind, t.text, CASE WHEN kind IN ('direction', 'proximity') THEN entity END AS direction, (SELECT count(*) FROM fx_index i WHERE i.key = t.key) AS n
      FROM tx_resolved t WHERE level = 'event')""",
    "tx_labels": """SELECT event_id, '[' || string_agg(upper(kind[1]) || kind[2:] || ': ' || text || mark, '; ' ORDER BY pass, ts) || ']' AS ctx_label FROM tx_marks GROUP BY event_id""",
})


def _marked(fx):
    return summary.anchor_marks(fx.contexts.filter("level = 'event'").select("event_id", "ord", "kind", "text"), fx.directions, fx.locales, ["event_id", "ord"])


@query("n02_anchor_marks", "SELECT event_id, kind, text, mark FROM tx_marks")
def _(fx):
    return _marked(fx).select("event_id", "kind", "text", "mark")


@query("n01_event_summaries", f"""SELECT event_id, trim(concat_ws(' | ', 'group:' || actor_text, action_kind || ':' || action_text) || ' ' || coalesce(ctx_label, '')) AS summary, {_snip('text', 250)} AS snippet
FROM tx_events LEFT JOIN tx_labels USING (event_id)""")
def _(fx):
    labels = summary.context_labels(_marked(fx), ["event_id"])
    return summary.event_summary(fx.report_events.join(labels, "event_id", "left")).select("event_id", "summary", "snippet")


@query("n01b_node_summaries", f"""SELECT 'post' AS part, CAST(post_id AS VARCHAR) AS id, trim('Post ' || post_id || ' ' || coalesce(c, '')) AS summary, {_snip('text', 1000)} AS snippet FROM fx_posts
  LEFT JOIN (SELECT post_id, '[' || string_agg(upper(kind[1]) || kind[2:] || ': ' || text, '; ' ORDER BY ts) || ']' AS c FROM tx_post_contexts GROUP BY post_id) USING (post_id)
UNION ALL SELECT 'section', post_id || '/' || section_id, trim('Section ' || section_id || ' ' || coalesce(c, '')), {_snip('text', 300)} FROM tx_sections
  LEFT JOIN (SELECT post_id, section_id, '[' || string_agg(upper(kind[1]) || kind[2:] || ': ' || text, '; ' ORDER BY ts) || ']' AS c FROM tx_section_contexts GROUP BY ALL) USING (post_id, section_id)
UNION ALL SELECT 'location', event_id || ':loc' || loc_no, trim(text || ' ' || coalesce('(' || c || ')', '') || ' ' || coalesce(x, '')), {_snip('text', 200)} FROM tx_mentions
  LEFT JOIN (SELECT event_id, loc_no, '[' || string_agg(upper(kind[1]) || kind[2:] || ': ' || text, '; ' ORDER BY pass, ts) || ']' AS x FROM tx_scoped WHERE loc_no IS NOT NULL GROUP BY ALL) USING (event_id, loc_no)
  LEFT JOIN (SELECT event_id, loc_no, string_agg(name, ', ' ORDER BY row_no) FILTER (WHERE n <= 3) || CASE WHEN max(n) > 3 THEN ', …' ELSE '' END AS c FROM
    (SELECT *, row_number() OVER (PARTITION BY event_id, loc_no ORDER BY row_no) AS n FROM tx_candidates) GROUP BY ALL) USING (event_id, loc_no)""")
def _(fx):
    plain = fx.contexts.withColumn("mark", F.lit(""))
    posts = summary.post_summary(fx.posts.select("post_id", "text").join(
        summary.context_labels(plain.filter("level = 'post'"), ["post_id"]), "post_id", "left")).select(F.lit("post").alias("part"), F.col("post_id").cast("string").alias("id"), "summary", "snippet")
    secs = summary.section_summary(fx.sections.join(summary.context_labels(plain.filter("level = 'section'"), ["post_id", "section_id"]), ["post_id", "section_id"], "left")).select(
        F.lit("section"), F.concat_ws("/", F.col("post_id").cast("string"), "section_id"), "summary", "snippet")
    from pyspark.sql import Window as W
    few = fx.few_candidates(4).withColumn("_n", F.row_number().over(W.partitionBy("event_id", "loc_no").orderBy("row_no"))).filter("_n <= 4")
    names = few.groupBy("event_id", "loc_no").agg(F.transform(F.sort_array(F.collect_list(F.struct("_n", "name"))), lambda x: x["name"]).alias("candidate_texts"))
    labels = summary.context_labels(plain.filter("level = 'location'"), ["event_id", "loc_no"])
    locs = summary.location_summary(fx.mentions.join(names, ["event_id", "loc_no"], "left").join(labels, ["event_id", "loc_no"], "left")).select(F.lit("location"), "mention_id", "summary", "snippet")
    return posts.union(secs).union(locs)
