"""Sections, contexts, events and mentions of posts.

Works on one row per post that carries its text, its spans and its trigger hits, so all
nesting is array work inside the row; nothing is joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from georeport.functions.keys import WS, strip
from georeport.functions.labels import action_kind, action_label, action_text
from georeport.operators.common import let, written
from georeport.operators.tagging import CONTEXT_LABELS, sentences, word_places
from georeport.params import Params

# Fixed value: a bullet or hash marks, then a capital letter.
HEADING = rf"^[{WS}]*(?:[-•*]|#+|\*)[{WS}]*[A-ZА-ЯЁІЇЄҐ][^:]{{2,}}:?\z"
BOUNDARY_LABELS = ("DIRECTION", "GROUP", "REGION")


def _labelled(spans: Column, labels: tuple[str, ...]) -> Column:
    return F.filter(spans, lambda s: s["label"].isin(*labels))


def gather_posts(posts: DataFrame, spans: DataFrame, hits: DataFrame | None = None) -> DataFrame:
    """Attach to each post its spans in order, and its trigger hits in order.

    Posts are dealt out by id, as a shuffled join needs them anyway: where the spans are sent around, posts of few files
    would stay in as few tasks.
    """
    posts = posts.repartition("post_id")
    per_post = spans.groupBy("post_id").agg(F.sort_array(F.collect_list(
        F.struct("ts", "te", "cs", "ce", "ln", "label", "surface", "key"))).alias("spans"))
    out = posts.join(per_post, "post_id", "left").withColumn(
        "spans", F.coalesce("spans", F.array().cast(per_post.schema["spans"].dataType)))
    if hits is not None:
        trig = hits.groupBy("post_id").agg(F.sort_array(F.collect_list(
            F.struct("sn", "ts", "trigger", "label", "s_ts", "s_te", "s_cs"))).alias("hits"))
        out = out.join(trig, "post_id", "left").withColumn(
            "hits", F.coalesce("hits", F.array().cast(trig.schema["hits"].dataType)))
    return out


def section_array(text: Column, spans: Column, params: Params = Params()) -> Column:
    """Sections of a text: ``section_id``, ``text``, start ``cs`` and end ``ce``.

    A heading line, or a line where a direction, group or region starts, opens a section;
    long sections are then cut at blank lines. The start is the first place of the
    section's text in the post.
    """
    def build(lines: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.size(lines) - 1)
        heads = F.filter(numbers, lambda i: strip(lines[i]).rlike(HEADING))
        marked = F.transform(_labelled(spans, BOUNDARY_LABELS), lambda s: s["ln"])
        cuts = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0)), heads, marked)))
        return let(cuts, lambda cs: F.flatten(F.transform(cs, lambda s, k: let(
            strip(F.array_join(F.slice(lines, s + 1, F.coalesce(F.get(cs, k + 1), F.size(lines)) - s), "\n")),
            lambda t: paragraphs(t, k)))))

    def paragraphs(t: Column, k: Column) -> Column:
        name = F.concat(F.lit("S"), k.cast("string"))
        long = (F.length(t) > params.section_split_chars) & t.contains("\n\n")
        parts = F.transform(F.split(t, "\n\n", -1), lambda p, i: F.struct(
            F.concat(name, F.lit("."), i.cast("string")).alias("section_id"), strip(p).alias("text")))
        return F.when(long, parts).otherwise(F.array(F.struct(name.alias("section_id"), t.alias("text"))))

    def locate(s: Column) -> Column:
        start = F.instr(text, s["text"]) - 1
        return F.struct(s["section_id"].alias("section_id"), s["text"].alias("text"),
                        start.alias("cs"), (start + F.length(s["text"])).alias("ce"))

    return F.transform(let(F.split(text, "\n", -1), build), locate)


def _context(s: Column) -> Column:
    return F.struct(F.lower(s["label"]).alias("kind"), s["surface"].alias("text"))


def post_contexts(spans: Column, params: Params = Params()) -> Column:
    """Region, group and direction spans near the start of a post."""
    early = F.filter(_labelled(spans, BOUNDARY_LABELS), lambda s: s["ts"] <= params.post_context_tokens)
    return F.transform(early, _context)


def section_contexts(section: Column, spans: Column, params: Params = Params()) -> Column:
    """The same labels near the start of a section."""
    near = F.filter(_labelled(spans, BOUNDARY_LABELS), lambda s: (
        (s["cs"] >= section["cs"]) & (s["ce"] <= section["ce"])
        & (s["cs"] - section["cs"] <= params.section_context_chars)))
    return F.transform(near, _context)


def spans_in_event(spans: DataFrame, events: DataFrame, labels: tuple[str, ...],
                   contained: bool = True) -> DataFrame:
    """Spans contained in (or overlapping) the token range ``s_ts``-``s_te`` of an event."""
    if contained:
        near = (F.col("ts") >= F.col("s_ts")) & (F.col("te") <= F.col("s_te"))
    else:
        near = (F.col("ts") < F.col("s_te")) & (F.col("te") > F.col("s_ts"))
    ranges = events.select("post_id", "event_id", "s_ts", "s_te")
    return spans.filter(F.col("label").isin(*labels)).join(ranges, "post_id").filter(near)


def section_of(start: Column, sections: Column) -> Column:
    """First section whose range holds the start (end included), else the first section."""
    held = F.filter(sections, lambda s: (s["cs"] <= start) & (start <= s["ce"]))
    return F.coalesce(F.get(held, F.lit(0))["section_id"], F.get(sections, F.lit(0))["section_id"])


def scope_contexts(spans: Column) -> Column:
    """Where each context span of an event applies: to one location or to the event.

    Pass 1: a context after all locations applies to each of them, any other to the event.
    Pass 2: a direction before all locations applies to the event; else it, and a proximity
    always, applies to the next location, or to the event when none follows.
    """
    locs = F.filter(spans, lambda s: s["label"] == "LOCALE")
    ctxs = _labelled(spans, CONTEXT_LABELS)
    nobody = F.lit(None).cast("int")

    def item(no: int, s: Column, loc: Column) -> Column:
        return F.struct(F.lit(no).alias("pass"), s["ts"].alias("ts"), loc.cast("int").alias("loc_no"),
                        F.lower(s["label"]).alias("kind"), s["surface"].alias("text"))

    def build(ls: Column) -> Column:
        def first(s: Column) -> Column:
            after_all = (F.size(ls) > 0) & F.forall(ls, lambda x: x["te"] <= s["ts"])
            return F.when(after_all, F.transform(ls, lambda x, i: item(1, s, i))).otherwise(F.array(item(1, s, nobody)))

        def second(s: Column) -> Column:
            before_all = F.forall(ls, lambda x: x["ts"] > s["ts"])
            n_before = F.size(F.filter(ls, lambda x: x["ts"] <= s["ts"]))
            following = F.when(n_before < F.size(ls), n_before)
            return item(2, s, F.when((s["label"] == "DIRECTION") & before_all, nobody).otherwise(following))

        veiled = _labelled(ctxs, ("DIRECTION", "PROXIMITY"))
        return F.concat(F.flatten(F.transform(ctxs, first)), F.transform(veiled, second))

    return let(locs, build)


def _event(own: Column, secs: Column, event_id: Column, label: Column, text: Column, trigger: Column, start: Column, stop: Column,
           first_char: Column, negated: Column, uncertain: Column, coreference: Column, similarity: Column) -> Column:
    """An event with its spans ``own``, that is those inside its token range."""
    actor = F.get(F.filter(own, lambda s: s["label"] == "GROUP"), F.lit(0))["surface"]
    return F.struct(
        event_id.alias("event_id"), label.alias("label"), text.alias("text"), section_of(first_char, secs).alias("section_id"),
        F.when(actor.isNotNull(), "group").alias("actor_kind"), actor.alias("actor_text"),
        action_kind(trigger).alias("action_kind"), action_label(trigger).alias("action_label"), action_text(trigger).alias("action_text"),
        start.cast("int").alias("s_ts"), stop.cast("int").alias("s_te"), first_char.cast("int").alias("s_cs"),
        negated.alias("negated"), uncertain.alias("uncertain"), coreference.alias("coreference"), similarity.alias("similarity"),
        F.filter(own, lambda s: s["label"] == "LOCALE").alias("locations"), scope_contexts(own).alias("contexts"))


def _sections(text: Column, spans: Column, params: Params) -> Column:
    """Sections of a post with their contexts."""
    return let(section_array(text, spans, params), lambda secs: F.transform(secs, lambda s: F.struct(
        s["section_id"].alias("section_id"), s["text"].alias("text"), s["cs"].alias("cs"), s["ce"].alias("ce"),
        section_contexts(s, spans, params).alias("contexts"))))


def _first_from(spans: Column, field: str, least: Column) -> Column:
    """How many spans, sorted by ``field``, lie before ``least``: by halving, so a long post costs few steps."""
    def halve(r: Column, _: Column) -> Column:
        mid = F.shiftright(r["lo"] + r["hi"], 1)
        below = (r["lo"] < r["hi"]) & (F.get(spans, mid)[field] < least)
        return F.struct(F.when(below, mid + 1).otherwise(r["lo"]).alias("lo"), F.when(below, r["hi"]).otherwise(F.least(mid, r["hi"])).alias("hi"))

    steps = F.sequence(F.lit(0), F.length(F.bin(F.size(spans))))
    return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.size(spans).alias("hi")), halve, lambda r: r["lo"])


def _between(spans: Column, field: str, least: Column, below: Column) -> Column:
    """The spans, sorted by ``field``, from ``least`` to before ``below``."""
    return let(_first_from(spans, field, least), lambda a: F.slice(spans, a + 1, F.greatest(_first_from(spans, field, below) - a, F.lit(0))))


def _inside(spans: Column, start: Column, stop: Column) -> Column:
    """Spans of a post, sorted and none of them empty, that lie in a token range."""
    return F.filter(_between(spans, "ts", start, stop), lambda s: s["te"] <= stop)


def analyse(gathered: DataFrame, params: Params = Params()) -> DataFrame:
    """One row per post with arrays of sections, contexts and events.

    Events are numbered from 0 in the order of their sentence and trigger.
    """
    spans, text, hits = F.col("spans"), F.col("text"), F.col("hits")
    no = F.lit(False)

    def event(texts: Column, secs: Column, h: Column, i: Column) -> Column:
        number = F.concat(F.col("post_id").cast("string"), F.lit(":"), i.cast("string"))
        return let(_inside(spans, h["s_ts"], h["s_te"]), lambda own: _event(
            own, secs, number, h["label"], F.get(texts, h["sn"]), h["trigger"], h["s_ts"], h["s_te"], h["s_cs"], no, no, no, F.lit(1.0)))

    events = let(F.struct(sentences(text, params.abbreviations).alias("t"), _sections(text, spans, params).alias("s")), lambda b: F.struct(
        b["s"].alias("sections"), F.transform(hits, lambda h, i: event(b["t"], b["s"], h, i)).alias("events")))
    return gathered.select("post_id", "text", post_contexts(spans, params).alias("contexts"), events.alias("b")).select(
        "post_id", "text", "contexts", "b.sections", "b.events")


def token_chars(text: Column, words: Column, token: Column) -> Column:
    """First and last char (exclusive) of a token of a text with the words ``words``, in order; visible characters between words are tokens, too.

    A token before the text is its first one, one behind it is empty and at its end. The word is found by halving.
    """
    def found(v: Column) -> Column:
        return let(v.withField("n", _first_from(v["ws"], "ts", v["t"] + 1)), lambda u: let(
            F.struct(u["t"].alias("t"), F.get(u["ws"], u["n"] - 1).alias("w"), F.get(u["ws"], u["n"])["cs"].alias("next")), chars))

    def chars(u: Column) -> Column:
        return F.when(u["w"]["ts"] == u["t"], F.struct(u["w"]["cs"].alias("cs"), u["w"]["ce"].alias("ce"))).otherwise(mark(u))

    def mark(u: Column) -> Column:
        start = F.coalesce(u["w"]["ce"], F.lit(0))
        stop = F.coalesce(u["next"], F.length(text))
        gap = F.when(stop > start, F.sequence(start, stop - 1)).otherwise(F.array().cast("array<int>"))
        seen = F.filter(gap, lambda i: F.substring(text, i + 1, F.lit(1)).rlike(r"\S"))
        at = F.get(seen, (u["t"] - F.coalesce(u["w"]["ts"], F.lit(-1)) - 1).cast("int"))
        return F.struct(F.coalesce(at, F.length(text)).alias("cs"), F.coalesce(at + 1, F.length(text)).alias("ce"))

    return let(F.struct(words.alias("ws"), F.greatest(token, F.lit(0)).alias("t")), found)


def analyse_matches(gathered: DataFrame, matches: DataFrame, params: Params = Params()) -> DataFrame:
    """As ``analyse``, with the matches of another extractor as events (see ``records.match_events``).

    One row per post with its sections and contexts, and one row per match that holds its event: a post's matches are not
    gathered, so a post may have any number. A match's range counts in the tokens of ``tagging.word_table``. Its text is its
    sentence, or else the text of its range. Matches of unknown posts are left out.
    """
    spans, text = F.col("spans"), F.col("text")
    posts = written(word_places(gathered.select("post_id", "text", "spans")).select(
        "post_id", "text", "spans", post_contexts(spans, params).alias("contexts"), _sections(text, spans, params).alias("sections"), "words"), "posts")
    m = matches.select(F.col("post_id").alias("_post"), "event_id", "label", "phrase", "sentence", "similarity", "negated", "uncertain", "coreference", "s_ts", "s_te")
    rows = posts.join(m, posts["post_id"].cast("string") == m["_post"])
    first, last = token_chars(text, F.col("words"), F.col("s_ts")), token_chars(text, F.col("words"), F.col("s_te") - 1)
    rows = rows.withColumn("_first", first["cs"]).withColumn("_last", last["ce"])
    own_text = F.when(F.col("s_te") > F.col("s_ts"), F.substring(text, F.col("_first") + 1, F.greatest(F.col("_last") - F.col("_first"), F.lit(0)))).otherwise("")
    event = let(_inside(spans, F.col("s_ts"), F.col("s_te")), lambda own: _event(
        own, F.col("sections"), F.col("event_id"), F.col("label"), F.when(F.col("sentence") != "", F.col("sentence")).otherwise(own_text), F.col("phrase"),
        F.col("s_ts"), F.col("s_te"), F.col("_first"), F.col("negated"), F.col("uncertain"), F.col("coreference"), F.col("similarity")))
    kinds = {f.name: f.dataType for f in posts.schema.fields}
    none = [F.array().cast(kinds[c]).alias(c) for c in ("contexts", "sections")]
    # In a step of its own: beside the empty columns its names would mean these.
    events = rows.select("post_id", F.array(event).alias("events")).select("post_id", F.lit(None).cast("string").alias("text"), *none, "events")
    empty = F.array().cast(events.schema["events"].dataType).alias("events")
    return posts.select("post_id", "text", "contexts", "sections", empty).unionByName(events)


def sections_of(posts: DataFrame) -> DataFrame:
    return posts.select("post_id", F.posexplode("sections").alias("section_no", "s")).select(
        "post_id", "section_no", "s.section_id", "s.text", "s.cs", "s.ce")


def events_of(posts: DataFrame) -> DataFrame:
    return posts.select("post_id", F.explode("events").alias("e")).select(
        "post_id", "e.event_id", "e.section_id", "e.label", "e.text", "e.actor_kind", "e.actor_text",
        "e.action_kind", "e.action_label", "e.action_text", "e.s_ts", "e.s_te", "e.s_cs",
        "e.negated", "e.uncertain", "e.coreference", "e.similarity")


def mentions_of(posts: DataFrame) -> DataFrame:
    """One location per place span of an event, numbered in order."""
    return (posts.select("post_id", F.explode("events").alias("e"))
            .select("post_id", "e.event_id", F.posexplode("e.locations").alias("loc_no", "s"))
            .select("post_id", "event_id", "loc_no",
                    F.concat("event_id", F.lit(":loc"), F.col("loc_no").cast("string")).alias("mention_id"),
                    F.lit("TARGET").alias("role"), F.lit("LOCALE").alias("kind"),
                    F.col("s.surface").alias("text"), F.col("s.ts").alias("ts"), F.col("s.te").alias("te"),
                    F.col("s.cs").alias("cs"), F.col("s.ce").alias("ce")))


def contexts_of(posts: DataFrame) -> DataFrame:
    """Contexts of all levels in one table. ``ord`` counts within the owner."""
    null = F.lit(None).cast("string")
    at_post = posts.select("post_id", F.lit("post").alias("level"), null.alias("section_id"), null.alias("event_id"),
                           F.posexplode("contexts").alias("ord", "c"))
    at_section = (posts.select("post_id", F.explode("sections").alias("s"))
                  .select("post_id", F.lit("section").alias("level"), "s.section_id", null.alias("event_id"),
                          F.posexplode("s.contexts").alias("ord", "c")))
    flat = at_post.unionByName(at_section).select(
        "post_id", "level", "section_id", "event_id", "ord", F.lit(None).cast("int").alias("loc_no"),
        F.lit(None).cast("int").alias("pass"), "c.kind", "c.text")
    at_event = (posts.select("post_id", F.explode("events").alias("e"))
                .select("post_id", "e.section_id", "e.event_id", F.posexplode("e.contexts").alias("ord", "c"))
                .select("post_id", F.when(F.col("c.loc_no").isNull(), "event").otherwise("location").alias("level"),
                        "section_id", "event_id", "ord", "c.loc_no", "c.pass", "c.kind", "c.text"))
    return flat.unionByName(at_event)
