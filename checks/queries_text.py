"""Tagging, sections, contexts, events and mentions."""

from pyspark.sql import functions as F

from checks.ctes import CTES, lockey
from checks.fixtures import word_at
from checks.registry import query
from georeport.operators import structure, tagging

_HEAD = r"^[ \t\x0B\f\r]*(?:[-•*]|#+|\*)[ \t\x0B\f\r]*[A-ZА-ЯЁІЇЄҐ][^:]{2,}:?$"
_BLANK = "chr(32) || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)"

CTES.update({
    "tx_lines": """SELECT post_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS ln FROM (SELECT post_id, string_split(text, chr(10)) AS l FROM fx_posts)""",
    "tx_sections0": f"""SELECT post_id, k, trim(string_agg(line, chr(10) ORDER BY ln), {_BLANK}) AS text FROM (
        SELECT *, sum(CASE WHEN ln > 0 AND (regexp_matches(trim(line, {_BLANK}), '{_HEAD}') OR marked) THEN 1 ELSE 0 END) OVER (PARTITION BY post_id ORDER BY ln) AS k
        FROM (SELECT l.*, EXISTS (SELECT 1 FROM tx_spans s WHERE s.post_id = l.post_id AND s.ln = l.ln AND s.label IN ('DIRECTION', 'GROUP', 'REGION')) AS marked FROM tx_lines l))
        GROUP BY post_id, k""",
    "tx_sections1": f"""SELECT post_id, k, CAST(NULL AS BIGINT) AS j, 'S' || k AS section_id, text FROM tx_sections0 WHERE NOT (length(text) > 800 AND contains(text, chr(10) || chr(10)))
        UNION ALL SELECT post_id, k, j - 1, 'S' || k || '.' || (j - 1), trim(p, {_BLANK}) FROM (SELECT post_id, k, unnest(l) AS p, generate_subscripts(l, 1) AS j FROM
          (SELECT post_id, k, string_split(text, chr(10) || chr(10)) AS l FROM tx_sections0 WHERE length(text) > 800 AND contains(text, chr(10) || chr(10))))""",
    "tx_sections": """SELECT post_id, CAST(row_number() OVER (PARTITION BY post_id ORDER BY k, j) - 1 AS INTEGER) AS section_no, section_id, s.text,
        strpos(p.text, s.text) - 1 AS cs, strpos(p.text, s.text) - 1 + length(s.text) AS ce FROM tx_sections1 s JOIN fx_posts p USING (post_id)""",
    "tx_post_contexts": "SELECT post_id, lower(label) AS kind, surface AS text, ts FROM tx_spans WHERE label IN ('DIRECTION', 'GROUP', 'REGION') AND ts <= 12",
    "tx_section_contexts": """SELECT s.post_id, s.section_no, s.section_id, lower(label) AS kind, surface AS text, x.ts FROM tx_sections s JOIN tx_spans x ON x.post_id = s.post_id
        AND label IN ('DIRECTION', 'GROUP', 'REGION') AND x.cs >= s.cs AND x.ce <= s.ce AND x.cs - s.cs <= 40""",
    "tx_event_spans": "SELECT e.event_id, s.* FROM tx_events0 e JOIN tx_spans s ON s.post_id = e.post_id AND s.ts >= e.s_ts AND s.te <= e.s_te",
    "tx_mentions": """SELECT post_id, event_id, CAST(row_number() OVER (PARTITION BY event_id ORDER BY ts) - 1 AS INTEGER) AS loc_no, surface AS text, key, ts, te, cs, ce
        FROM tx_event_spans WHERE label = 'LOCALE'""",
    "tx_loc_ends": "SELECT event_id, count(*) AS n, max(te) AS max_te, min(ts) AS min_ts FROM tx_mentions GROUP BY event_id",
    "tx_scoped": """WITH c AS (SELECT e.*, l.n, l.max_te, l.min_ts FROM tx_event_spans e LEFT JOIN tx_loc_ends l USING (event_id) WHERE label <> 'LOCALE'),
      nxt AS (SELECT c.event_id, c.ts, min(m.loc_no) AS loc_no FROM c JOIN tx_mentions m ON m.event_id = c.event_id AND m.ts > c.ts GROUP BY ALL)
      SELECT c.event_id, 1 AS pass, c.ts, m.loc_no, lower(label) AS kind, surface AS text FROM c JOIN tx_mentions m USING (event_id) WHERE c.max_te <= c.ts
      UNION ALL SELECT event_id, 1, ts, NULL, lower(label), surface FROM c WHERE max_te IS NULL OR max_te > ts
      UNION ALL SELECT c.event_id, 2, c.ts, CASE WHEN label = 'DIRECTION' AND (min_ts IS NULL OR min_ts > c.ts) THEN NULL ELSE nxt.loc_no END, lower(label), surface
        FROM c LEFT JOIN nxt ON nxt.event_id = c.event_id AND nxt.ts = c.ts WHERE label IN ('DIRECTION', 'PROXIMITY')""",
    "tx_placed": """SELECT e.event_id, coalesce(arg_min(s.section_id, s.section_no) FILTER (WHERE s.cs <= e.s_cs AND e.s_cs <= s.ce), arg_min(s.section_id, s.section_no)) AS section_id
        FROM tx_events0 e JOIN tx_sections s USING (post_id) GROUP BY e.event_id""",
    "tx_action": """SELECT event_id, CASE WHEN contains(trigger, 'shell') THEN 'shelling' WHEN trigger IN ('attack', 'attacked', 'assault') THEN 'attack'
        WHEN trigger IN ('advance', 'advanced') THEN 'advance' WHEN trigger IN ('defend', 'defended') THEN 'defense' WHEN trigger IN ('capture', 'captured', 'took') THEN 'capture'
        ELSE 'other' END AS action_kind FROM tx_events0""",
    "tx_events": """SELECT e.post_id, e.event_id, p.section_id, e.label, t.text, CASE WHEN g.surface IS NOT NULL THEN 'group' END AS actor_kind, g.surface AS actor_text,
        a.action_kind, CASE a.action_kind WHEN 'shelling' THEN 'artillery_shelling' ELSE a.action_kind END AS action_label, e.trigger AS action_text, e.s_ts, e.s_te, e.s_cs
        FROM tx_events0 e JOIN tx_placed p USING (event_id) JOIN tx_action a USING (event_id) JOIN tx_sentence_texts t ON t.post_id = e.post_id AND t.sn = e.sn
        LEFT JOIN (SELECT event_id, arg_min(surface, ts) AS surface FROM tx_event_spans WHERE label = 'GROUP' GROUP BY event_id) g USING (event_id)""",
})

_INT = ("ts", "te", "cs", "ce")


def _long(*cols):
    return [F.col(c).cast("long").alias(c) for c in cols]


@query("c24_tag_spans", "SELECT post_id, label, ts, te, cs, ce, surface, key FROM tx_hits")
def _(fx):
    return fx.hits.filter("space <> 'TRIGGER'").select("post_id", "label", *_long(*_INT), "surface", "key")


# Short texts with one default phrase shape each; the name is the n-th word of the vocabulary.
_SHAPES = (("in the direction of ", ""), ("towards ", ""), ("", " direction"), ("", " axis"), ("", " sector"), ("the ", " line"), ("near ", ""), ("", ""))
CTES["fx_shaped"] = """SELECT o_orderkey AS post_id, w, b, a, 'Xy ' || b || w || a || ' zz.' AS text, CASE WHEN b = '' THEN 0 ELSE len(string_split(trim(b), ' ')) END AS nb,
    CASE WHEN a = '' THEN 0 ELSE 1 END AS na FROM (SELECT o_orderkey, w, CASE o_orderkey % 8 """ + " ".join(f"WHEN {i} THEN '{b}'" for i, (b, _) in enumerate(_SHAPES)) + """ END AS b,
    CASE o_orderkey % 8 """ + " ".join(f"WHEN {i} THEN '{a}'" for i, (_, a) in enumerate(_SHAPES)) + """ END AS a FROM orders JOIN fx_vocab ON r = 31 + o_orderkey % 430)"""


@query("c24b_default_shapes", f"""WITH s AS (SELECT *, {lockey('w')} AS key FROM fx_shaped)
SELECT post_id, label, 1 + nb AS ts, 2 + nb AS te, 3 + length(b) AS cs, 3 + length(b) + length(w) AS ce, w AS surface, key FROM s JOIN tx_names USING (key)
UNION ALL SELECT post_id, CASE WHEN b = 'near ' THEN 'PROXIMITY' ELSE 'DIRECTION' END, 1, 2 + nb + na, 3, 3 + length(b) + length(w) + length(a), b || w || a, key FROM s
  WHERE nb + na > 0 AND ((b = 'near ' AND key IN (SELECT key FROM fx_index)) OR (b <> 'near ' AND key IN (SELECT key FROM fx_direction_index)))""")
def _(fx):
    from georeport.params import Params
    o = fx.table("orders").select(F.col("o_orderkey").alias("post_id"))
    named = word_at(31 + F.col("post_id") % 430, fx.vocab, o, "w")
    pick = F.col("post_id") % 8
    b, a = (F.element_at(F.array(*(F.lit(s[k]) for s in _SHAPES)), (pick + 1).cast("int")) for k in (0, 1))
    posts = named.select("post_id", F.concat(F.lit("Xy "), b, "w", a, F.lit(" zz.")).alias("text"))
    got = tagging.match_words(posts, fx.patterns.filter("space <> 'TRIGGER'"), Params().templates, partitions=fx.spark.sparkContext.defaultParallelism)
    return got.select("post_id", "label", *_long(*_INT), "surface", "key")


@query("e09_chosen_spans", "SELECT post_id, label, ts, te, cs, ce, surface, key FROM tx_spans")
def _(fx):
    return fx.spans.select("post_id", "label", *_long(*_INT), "surface", "key")


@query("g03_pattern_union", """SELECT label, key FROM tx_names UNION SELECT 'DIRECTION', key FROM fx_direction_index
  UNION SELECT 'PROXIMITY', key FROM fx_index UNION SELECT label, trigger FROM fx_triggers""")
def _(fx):
    return fx.patterns.select("label", "key")


@query("c27_trigger_matches", "SELECT post_id, sn, label, trigger, ts FROM tx_triggered")
def _(fx):
    return fx.triggered.select("post_id", F.col("sn").cast("long").alias("sn"), "label", "trigger", F.col("ts").cast("long").alias("ts"))


@query("i01_sections", "SELECT post_id, section_no, section_id, text, cs, ce FROM tx_sections")
def _(fx):
    return fx.sections.select("post_id", "section_no", "section_id", "text", *_long("cs", "ce"))


_PARA = {k.replace("tx_", "rx_"): v.replace("tx_", "rx_").replace("fx_posts", "fx_paragraph_posts")
         for k, v in CTES.items() if k in ("tx_pieces", "tx_before", "tx_counted", "tx_words", "tx_names", "tx_pairs", "tx_hits", "tx_chosen", "tx_spans",
                                           "tx_lines", "tx_sections0", "tx_sections1", "tx_sections")}
CTES.update(_PARA)


@query("i01b_sections_of_paragraphs", "SELECT post_id, section_no, section_id, text, cs, ce FROM rx_sections")
def _(fx):
    from checks.fixtures import TEMPLATES
    posts = fx.paragraph_posts
    spans = tagging.tag_spans(posts, fx.patterns, TEMPLATES, fx.spark.sparkContext.defaultParallelism)
    got = structure.gather_posts(posts, spans).select(
        "post_id", structure.section_array(F.col("text"), F.col("spans")).alias("sections"))
    return structure.sections_of(got).select("post_id", "section_no", "section_id", "text", *_long("cs", "ce"))


@query("e05_section_numbers", "SELECT post_id, CAST(count(DISTINCT k) AS BIGINT) AS n_sections, CAST(count(*) AS BIGINT) AS n_parts FROM tx_sections1 GROUP BY post_id")
def _(fx):
    base = F.split("section_id", r"\.")[0]
    return fx.sections.groupBy("post_id").agg(F.countDistinct(base).alias("n_sections"), F.count("*").alias("n_parts"))


@query("i02_post_contexts", "SELECT post_id, kind, text, CAST(row_number() OVER (PARTITION BY post_id ORDER BY ts) - 1 AS INTEGER) AS ord FROM tx_post_contexts")
def _(fx):
    return fx.contexts.filter("level = 'post'").select("post_id", "kind", "text", "ord")


@query("i03_section_contexts", """SELECT post_id, section_id, kind, text, CAST(row_number() OVER (PARTITION BY post_id, section_no ORDER BY ts) - 1 AS INTEGER) AS ord
  FROM tx_section_contexts""")
def _(fx):
    return fx.contexts.filter("level = 'section'").select("post_id", "section_id", "kind", "text", "ord")


@query("i04_events", "SELECT post_id, event_id, label, text, s_ts, s_te, s_cs FROM tx_events")
def _(fx):
    return fx.report_events.select("post_id", "event_id", "label", "text", *_long("s_ts", "s_te", "s_cs"))


@query("e03_event_ids", "SELECT event_id, label, action_text FROM tx_events")
def _(fx):
    return fx.report_events.select("event_id", "label", "action_text")


@query("i05_event_mentions", "SELECT event_id, loc_no, text, ts, te FROM tx_mentions")
def _(fx):
    return fx.mentions.select("event_id", "loc_no", "text", *_long("ts", "te"))


@query("i06_event_actors", "SELECT event_id, actor_kind, actor_text FROM tx_events")
def _(fx):
    return fx.report_events.select("event_id", "actor_kind", "actor_text")


@query("i07_event_actions", "SELECT event_id, action_kind, action_label, action_text FROM tx_events")
def _(fx):
    return fx.report_events.select("event_id", "action_kind", "action_label", "action_text")


@query("i08_context_scope_first", "SELECT event_id, ts, loc_no, kind, text FROM tx_scoped WHERE pass = 1")
def _(fx):
    c = fx.analysed.select(F.explode("events").alias("e")).select("e.event_id", F.explode("e.contexts").alias("c"))
    return c.filter("c.pass = 1").select("event_id", F.col("c.ts").cast("long").alias("ts"), "c.loc_no", "c.kind", "c.text")


@query("i09_context_scope_second", "SELECT event_id, ts, loc_no, kind, text FROM tx_scoped WHERE pass = 2")
def _(fx):
    c = fx.analysed.select(F.explode("events").alias("e")).select("e.event_id", F.explode("e.contexts").alias("c"))
    return c.filter("c.pass = 2").select("event_id", F.col("c.ts").cast("long").alias("ts"), "c.loc_no", "c.kind", "c.text")


@query("e06_next_location", """SELECT c.event_id, c.ts, CAST(min(m.loc_no) AS INTEGER) AS loc_no FROM (SELECT DISTINCT event_id, ts FROM tx_event_spans WHERE label = 'PROXIMITY') c
  LEFT JOIN tx_mentions m ON m.event_id = c.event_id AND m.ts > c.ts GROUP BY ALL""")
def _(fx):
    c = fx.analysed.select(F.explode("events").alias("e")).select("e.event_id", F.explode("e.contexts").alias("c"))
    return c.filter("c.pass = 2 and c.kind = 'proximity'").select("event_id", F.col("c.ts").cast("long").alias("ts"), "c.loc_no")


@query("c19_event_sections", "SELECT event_id, section_id FROM tx_placed")
def _(fx):
    return fx.report_events.select("event_id", "section_id")


@query("b10_spans_in_events", """SELECT event_id, ts, label, true AS contained FROM tx_event_spans WHERE label IN ('LOCALE', 'REGION')
UNION ALL SELECT e.event_id, s.ts, s.label, false FROM tx_events0 e JOIN tx_spans s ON s.post_id = e.post_id AND s.ts < e.s_te AND s.te > e.s_ts WHERE s.label IN ('LOCALE', 'REGION')""")
def _(fx):
    spans = fx.spans.select("post_id", "ts", "te", "label")
    out = None
    for flag in (True, False):
        got = structure.spans_in_event(spans, fx.report_events, ("LOCALE", "REGION"), flag).select(
            "event_id", F.col("ts").cast("long").alias("ts"), "label", F.lit(flag).alias("contained"))
        out = got if out is None else out.unionByName(got)
    return out


@query("i10_text_tables", """SELECT 'section' AS part, CAST(post_id AS VARCHAR) || '/' || section_id AS id, text FROM tx_sections
UNION ALL SELECT 'event', event_id, text FROM tx_events UNION ALL SELECT 'mention', event_id || ':loc' || loc_no, text FROM tx_mentions
UNION ALL SELECT 'context', CAST(post_id AS VARCHAR), kind || ':' || text FROM tx_post_contexts
UNION ALL SELECT 'context', CAST(post_id AS VARCHAR) || '/' || section_id, kind || ':' || text FROM tx_section_contexts
UNION ALL SELECT 'context', event_id || coalesce(':loc' || loc_no, ''), kind || ':' || text FROM tx_scoped""")
def _(fx):
    sec = fx.sections.select(F.lit("section").alias("part"), F.concat_ws("/", F.col("post_id").cast("string"), "section_id").alias("id"), "text")
    ev = fx.report_events.select(F.lit("event").alias("part"), F.col("event_id").alias("id"), "text")
    me = fx.mentions.select(F.lit("mention").alias("part"), F.col("mention_id").alias("id"), "text")
    loc = F.when(F.col("loc_no").isNotNull(), F.concat(F.lit(":loc"), F.col("loc_no").cast("string"))).otherwise("")
    cx = fx.contexts.select(F.lit("context").alias("part"),
                            F.when(F.col("level") == "post", F.col("post_id").cast("string"))
                            .when(F.col("level") == "section", F.concat_ws("/", F.col("post_id").cast("string"), "section_id"))
                            .otherwise(F.concat("event_id", loc)).alias("id"),
                            F.concat_ws(":", "kind", "text").alias("text"))
    return sec.unionByName(ev).unionByName(me).unionByName(cx)
