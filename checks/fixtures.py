"""Input tables of the jobs, derived from the driver tables (rules in ``FIXTURES.md``).

The driver tables hold no place names or coordinates, so these give them. Everything but
the fixed line and polygons grows with the driver tables.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from georeport.functions.geo import encode_cid
from georeport.operators import structure, tagging
from georeport.operators.common import scratch_path, written
from georeport.functions.keys import location_key
from georeport.operators.context import asked_once, unique_places
from georeport.operators.lookup import first_places, locale_index
from georeport.operators.scoring import choose_wanted, unary_score
from georeport.operators.spatial import closest_on_lines, line_segments
from georeport.operators.spelling import Spelling
from georeport.plans.resolve import Gazetteer, event_contexts

VOCAB_SIZE = 460
TEMPLATES = (("DIRECTION", ("of",), ()), ("PROXIMITY", ("in",), ()))
EVENT_LABELS = ("KINETIC_EVENT", "MANEUVER_EVENT", "DEFENSIVE_EVENT", "INTERDICTION_EVENT", "SUPPORT_EVENT",
                "ACTION_PHRASE_EVENT", "OUTCOME_EVENT", "CASUALTY_EVENT", "AIR_DEFENCE_EVENT", "MISSILE_EVENT")
# The line, (lon, lat), and the polygons (no, name, ring): six bands, one concave, one inside another.
LINE = ((30.0, 46.1), (31.7, 46.9), (33.2, 46.6), (34.9, 47.8), (36.4, 48.1), (37.3, 49.9), (38.0, 51.0))


def _box(w: float, s: float, e: float, n: float) -> tuple:
    return ((w, s), (e, s), (e, n), (w, n), (w, s))


POLYGONS = (
    *((i, f"band {i}", _box(22.00013 + 3 * i, 44.00017, 24.90013 + 3 * i, 51.80017)) for i in range(5)),
    (5, "band 5", _box(38.00013, 45.00017, 39.70013, 50.00017)),
    (6, "notch", ((24.50011, 46.00019), (29.50011, 46.00019), (29.50011, 50.00019), (27.00011, 47.00019),
                  (24.50011, 50.00019), (24.50011, 46.00019))),
    (7, "inner", _box(29.00023, 47.00029, 29.60023, 48.00029)),
)


def word_at(r: Column, vocab: DataFrame, df: DataFrame, name: str) -> DataFrame:
    v = F.broadcast(vocab.select(F.col("r").alias("_r"), F.col("w").alias(name)))
    return df.withColumn("_r", r.cast("int")).join(v, "_r").drop("_r")


class Fixtures:
    _known: dict[tuple, "Fixtures"] = {}

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir.rstrip("/")

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str) -> "Fixtures":
        key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
        if key not in cls._known:
            cls._known[key] = cls(spark, sf_dir)
        return cls._known[key]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        return written(df, name)

    def lines(self, df: DataFrame, name: str, col: str = "value") -> str:
        path = scratch_path(self.spark, name)
        df.select(col).write.text(path)
        return path

    # ------------------------------------------------------------- vocabulary

    @cached_property
    def vocab(self) -> DataFrame:
        docs = self.table("documents").select("doc_id", "text")
        # An id that occurs once counts once per word; only documents of the other ids need their pairs of word and id told apart.
        again = docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 or doc_id is null").select("doc_id")
        words = docs.repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions"))).select("doc_id", F.explode(F.array_distinct(
            F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}{6,}"), F.lit(0)))).alias("w"))
        same = words["doc_id"].eqNullSafe(again["doc_id"])
        once = words.join(again, same, "left_anti").groupBy("w").agg(F.count("*").alias("n"))
        more = words.join(again, same, "left_semi").groupBy("w").agg(F.countDistinct("doc_id").alias("n"))
        top = once.unionByName(more).groupBy("w").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "w").limit(VOCAB_SIZE)
        rows = [(i, r["w"]) for i, r in enumerate(top.collect(), 1)]
        return self.spark.createDataFrame(rows, "r int, w string").coalesce(1)

    @cached_property
    def words(self) -> dict[int, str]:
        return {r["r"]: r["w"] for r in self.vocab.collect()}

    @property
    def triggers(self) -> DataFrame:
        labels = F.array(*(F.lit(x) for x in EVENT_LABELS))
        return self.vocab.filter("r <= 30").select(
            labels[(F.col("r") - 1) % 10].alias("label"), F.col("w").alias("trigger"))

    # -------------------------------------------------------------- gazetteer

    @cached_property
    def regions(self) -> DataFrame:
        return self.stored(self._regions(), "regions")

    def _regions(self) -> DataFrame:
        n = self.table("nation").select(F.col("n_nationkey").cast("int").alias("nk"), F.col("n_regionkey").cast("int").alias("rk"), "n_name")
        named = word_at(F.col("nk") + 31, self.vocab, n, "w").withColumn("name", F.concat("w", F.lit(" oblast")))
        other = named.select(F.col("nk").alias("o"), F.col("name").alias("o_name"))
        near = named.select("nk").crossJoin(F.broadcast(self.spark.range(1))).select("nk", F.explode(F.array(
            (F.col("nk") + 24) % 25, (F.col("nk") + 1) % 25)).alias("o")).join(other, "o").groupBy("nk").agg(
            F.array_sort(F.collect_list("o_name")).alias("neighbors"))
        return named.join(near, "nk", "left").select(
            F.col("nk").alias("row_no"), "name", F.array("w", F.lower("n_name")).alias("aliases"), "neighbors",
            F.concat(F.lit("QR"), "nk").alias("qid"), F.concat(F.lit("XX-"), "nk").alias("iso3166_2"), "rk")

    @cached_property
    def groups(self) -> DataFrame:
        return self.stored(self._groups(), "groups")

    def _groups(self) -> DataFrame:
        r = self.table("region").select(F.col("r_regionkey").cast("int").alias("rk"), "r_name")
        named = word_at(F.col("rk") + 56, self.vocab, r, "name")
        own = self.regions.groupBy("rk").agg(F.array_sort(F.collect_list("name")).alias("regions"))
        other = named.select(F.col("rk").alias("o"), F.col("name").alias("o_name"))
        near = named.select("rk", F.explode(F.array((F.col("rk") + 4) % 5, (F.col("rk") + 1) % 5)).alias("o")).join(
            other, "o").groupBy("rk").agg(F.array_sort(F.collect_list("o_name")).alias("neighbors"))
        return named.join(own, "rk", "left").join(near, "rk", "left").select(
            F.col("rk").alias("row_no"), "name", F.col("rk").alias("group_id"), F.array(F.lower("r_name")).alias("aliases"),
            "regions", "neighbors")

    @cached_property
    def locales(self) -> DataFrame:
        return self.stored(self._locales(), "locales")

    def _locales(self) -> DataFrame:
        base = self.table("customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").cast("int").alias("nk")).unionByName(
            self.table("supplier").select((F.col("s_suppkey") + 1000000).alias("k"), F.col("s_nationkey").cast("int").alias("nk")))
        nation = F.broadcast(self.table("nation").select(F.col("n_nationkey").cast("int").alias("nk"), F.col("n_regionkey").cast("int").alias("rk")))
        k = F.col("k")
        df = base.join(nation, "nk")
        df = word_at(61 + k % 400, self.vocab, df, "name")
        df = word_at(61 + (k * 7 + 3) % 400, self.vocab, df, "alias")
        df = word_at(F.col("nk") + 31, self.vocab, df, "rw")
        df = word_at(F.col("rk") + 56, self.vocab, df, "grp")
        lat, lon = 44.0 + (k * 7919 % 8000) / 1000.0, 22.0 + (k * 104729 % 18000) / 1000.0
        return df.select(
            k.alias("row_no"), encode_cid(lat, lon).alias("cid"), "name", F.array("alias").alias("aliases"),
            lat.alias("lat"), lon.alias("lon"), F.concat("rw", F.lit(" oblast")).alias("region"), "grp",
            F.when(k % 11 != 0, F.concat(F.lit("Q"), k % 997)).alias("qid"), F.lit("town").alias("place"),
            F.lit(0).alias("usage"), F.lit("base").alias("source"))

    @property
    def directions(self) -> DataFrame:
        last = self.locales.groupBy("name").agg(F.max_by(F.struct("row_no", "cid", "aliases"), "row_no").alias("s"))
        return last.select("s.row_no", "name", F.col("s.cid").alias("anchor_cid"), "s.aliases")

    @cached_property
    def patterns(self) -> DataFrame:
        return self.stored(tagging.dictionary(self.locales, self.regions, self.groups, self.directions, self.triggers), "patterns")

    # ------------------------------------------------------------------ texts

    @property
    def texts(self) -> DataFrame:
        o = self.table("orders").select(F.col("o_orderkey").alias("text_id"), F.col("o_custkey").alias("ck"))
        t = word_at(31 + F.col("text_id") % 430, self.vocab, o, "w")
        m = F.col("text_id") % 5
        text = (F.when(m == 0, F.col("w")).when(m == 1, F.upper("w")).when(m == 2, F.concat("w", F.lit(" oblast")))
                .when(m == 3, F.concat("w", F.lit(" direction"))).otherwise(F.concat(F.lit("Direction of "), "w")))
        return t.select("text_id", "ck", text.alias("text"))

    @property
    def points(self) -> DataFrame:
        ids = self.table("supplier").select((F.col("s_suppkey") + 1000000000).alias("pid"), (F.col("s_suppkey") + 5000).alias("k")).unionByName(
            self.table("events").select(F.col("event_id").alias("pid"), F.col("user_id").alias("k")))
        k = F.col("k")
        return ids.select("pid", "k", (44.0005 + (k * 6151 % 8000) / 1000.0).alias("lat"),
                          (22.0005 + (k * 93911 % 18000) / 1000.0).alias("lon"))

    @property
    def posts(self) -> DataFrame:
        d = self.table("documents")
        micros = (F.lit(1704067200) + (F.col("doc_id") % 30) * 86400 + (F.col("doc_id") % 1440) * 60) * 1000000
        return d.select(F.col("doc_id").alias("post_id"), F.col("source").alias("channel"), F.col("lang").alias("channel_lang"),
                        F.timestamp_micros(micros).alias("published_at"), "text")

    @property
    def paragraph_posts(self) -> DataFrame:
        c = self.table("conversations")
        part = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("- "), "text", F.lit(":"))).otherwise(F.col("text"))
        turns = F.sort_array(F.collect_list(F.struct("turn", part.alias("p"))))
        return c.groupBy("conv_id").agg(F.array_join(F.transform(turns, lambda t: t["p"]), "\n\n").alias("text")).select(
            F.col("conv_id").alias("post_id"), "text")

    # --------------------------------------------------------- line, polygons

    @property
    def line_points(self) -> DataFrame:
        rows = [(1, i, x, y) for i, (x, y) in enumerate(LINE)]
        return self.spark.createDataFrame(rows, "line_no int, pt_no int, lon double, lat double").coalesce(1)

    @property
    def segments(self) -> DataFrame:
        return line_segments(self.line_points)

    @property
    def polygons(self) -> DataFrame:
        rows = [(no, name, [[[(x, y) for x, y in ring]]]) for no, name, ring in POLYGONS]
        kind = "poly_no int, poly_name string, polygons array<array<array<struct<lon:double,lat:double>>>>"
        return self.spark.createDataFrame(rows, kind).coalesce(1)

    # ------------------------------------------------------------- text layer

    @cached_property
    def hits(self) -> DataFrame:
        return self.stored(tagging.match_words(self.posts, self.patterns, TEMPLATES, partitions=self.spark.sparkContext.defaultParallelism), "hits")

    @cached_property
    def spans(self) -> DataFrame:
        return self.stored(tagging.choose_spans(self.hits.filter("space <> 'TRIGGER'")), "spans")

    @property
    def triggered(self) -> DataFrame:
        return tagging.trigger_hits(self.hits.filter("space = 'TRIGGER'"))

    @cached_property
    def analysed(self) -> DataFrame:
        posts = self.posts.select("post_id", "text")
        return self.stored(structure.analyse(structure.gather_posts(posts, self.spans, self.triggered)), "analysed")

    @property
    def sections(self) -> DataFrame:
        return structure.sections_of(self.analysed)

    @property
    def report_events(self) -> DataFrame:
        return structure.events_of(self.analysed)

    @property
    def mentions(self) -> DataFrame:
        return structure.mentions_of(self.analysed)

    @property
    def contexts(self) -> DataFrame:
        return structure.contexts_of(self.analysed)

    # ------------------------------------------------------------- resolution

    @property
    def gazetteer(self) -> Gazetteer:
        return Gazetteer(self.locales, self.regions, self.groups, self.directions)

    @cached_property
    def event_contexts(self) -> DataFrame:
        return self.stored(event_contexts(self.report_events, self.contexts, self.gazetteer), "event-contexts")

    @cached_property
    def _asked(self) -> tuple[DataFrame, DataFrame]:
        mentioned, wants = asked_once(self.mentions.select("event_id", "loc_no", location_key("text").alias("key")))
        return self.stored(mentioned, "mentioned"), wants

    @property
    def mentioned(self) -> DataFrame:
        """Mentions with the name that they ask for, ``want``."""
        return self._asked[0]

    @cached_property
    def want_places(self) -> DataFrame:
        """Every place of each name that is asked for, once per name."""
        found = self._asked[1].join(locale_index(self.locales).drop("aliases"), "key").drop("key")
        return self.stored(unique_places(found, ["want"]), "want-places")

    def of_mentions(self, rows: DataFrame) -> DataFrame:
        """Rows of names as rows of the mentions that ask for them. Not stored: there are mentions times places of these."""
        return self.mentioned.join(rows, "want").drop("want")

    @property
    def candidates(self) -> DataFrame:
        """Plain candidates: every place a mention may name."""
        return self.of_mentions(self.want_places)

    def few_candidates(self, n: int) -> DataFrame:
        """The first ``n`` candidates of each mention. Names have their first places found before mentions come to them."""
        rows = first_places(locale_index(self.locales).drop("aliases"), n).withColumnRenamed("key", "_key")
        asked = self.mentions.select("event_id", "loc_no", "text").withColumn("_key", location_key("text"))
        return unique_places(asked.join(rows, "_key").drop("_key", "text"))

    def _scored(self, candidates: DataFrame) -> DataFrame:
        rows = closest_on_lines(candidates, self.segments).drop("line_lat", "line_lon")
        none = F.lit(None).cast("double")
        return rows.withColumn("unary", unary_score(F.col("line_km"), none, none))

    @cached_property
    def want_scored(self) -> DataFrame:
        """Places of names with line distance and unary score."""
        return self.stored(self._scored(self.want_places), "want-scored")

    @property
    def scored(self) -> DataFrame:
        """Candidates with line distance and unary score, which a place has whatever mention asks for it."""
        return self.of_mentions(self.want_scored)

    @cached_property
    def scored_first(self) -> DataFrame:
        """The same of each mention's first candidate."""
        return self.stored(self._scored(self.stored(self.few_candidates(1), "first")), "scored-first")

    @cached_property
    def chosen(self) -> DataFrame:
        return self.stored(choose_wanted(self.mentioned, self.want_scored), "chosen")

    # ------------------------------------------------------- upkeep and intake

    @property
    def spellings(self) -> DataFrame:
        """Place names in many spellings, with a packed alias cell."""
        n, a, m = F.col("name"), F.get("aliases", F.lit(0)), F.col("row_no") % 6
        cyr = F.translate(n, "abvgdeziklmnoprstuf", "абвгдезиклмнопрстуф")
        cyr2 = F.concat(F.lit("Ж"), F.translate(a, "abvgdeziklmnoprstuf", "абвгдезиклмнопрстуф"), F.lit("ский-Елщьё"))
        raw = (F.when(m == 0, F.concat(n, F.lit("ivka"))).when(m == 1, F.concat(F.lit("Stara "), n))
               .when(m == 2, F.concat(n, F.lit("ivska-"), a)).when(m == 3, F.concat(F.upper(n), F.lit("ivske")))
               .when(m == 4, F.concat(F.lit("  "), F.initcap(n), F.lit("'ye –  the "), a, F.lit(" (x)"))).otherwise(cyr))
        cell = F.concat(n, F.lit("; "), F.upper(a), F.lit(";;"), cyr2, F.lit(" ;"), cyr, F.lit("; The O’"), a)
        return self.locales.select("row_no", "qid", "cid", "lat", "lon", raw.alias("raw"), cyr2.alias("cyr"), cell.alias("cell"), n.alias("name"))

    @property
    def rules(self) -> Spelling:
        """Rules for whole names and for words, made of the vocabulary."""
        v, w = self.vocab, F.col("w")
        names = v.filter("r between 61 and 70").select(F.concat(w, F.lit("ivka")).alias("name"), F.concat(w, F.lit("ovo;"), w, F.lit("grad")).alias("variant"))
        words = v.filter("r between 80 and 120").select(w.alias("word"), F.concat(w, F.lit("aya")).alias("variant"))
        return Spelling(names, words.unionByName(v.filter("r = 1").select(F.lit("stara").alias("word"), F.lit("staraya").alias("variant"))))

    @property
    def channels(self) -> DataFrame:
        """Sources as channels; every fourth is inactive, some take the defaults."""
        no = F.substring("source", 4, 9).cast("int")
        return self.table("documents").select("source").distinct().select(
            F.col("source").alias("channel_name"), F.when(no % 3 != 0, F.upper("source")).alias("alias"),
            F.when(no % 5 != 0, F.when(no % 2 == 0, "en").otherwise("de")).alias("channel_lang"), F.when(no % 7 != 6, no % 4 != 0).alias("active"))

    @property
    def messages(self) -> DataFrame:
        """Posts as messages: some texts only in ``raw_text``, some empty, some without a time."""
        p, k = self.posts, F.col("post_id")
        return p.select("channel", "post_id", F.when(k % 50 != 7, F.col("published_at")).alias("published_at"),
                        F.when(k % 3 == 0, "").when(k % 3 == 1, F.concat(F.lit("  "), "text", F.lit("\n"))).alias("message"),
                        F.when(k % 11 != 0, F.col("text")).alias("raw_text"))

    @property
    def phrases(self) -> list[str]:
        return [self.words[r].upper() for r in (40, 41, 42)]

    @property
    def blacklist(self) -> list[str]:
        return [self.words[r] for r in (43, 44, 45)]

    @property
    def matches(self) -> DataFrame:
        """Raw match records of the report events, as JSON with some keys missing."""
        e = self.report_events
        idx = F.element_at(F.split("event_id", ":"), -1).cast("long")
        post = F.col("post_id").cast("string")
        word = F.col("action_text")
        base = F.struct(F.col("s_ts").alias("document_token_index"), F.lit("Somebody").alias("document_word"), F.when(idx % 2 == 0, F.lit(0.5)).alias("similarity_measure"))
        hit = F.struct((F.col("s_te") - 1).alias("document_token_index"), (F.col("s_te") - 2).alias("first_document_token_index"), word.alias("document_word"),
                       F.left(word, F.lit(4)).alias("extracted_word"), F.when(idx % 5 == 1, F.lit(True)).alias("negated"))
        record = F.struct(
            F.when(idx % 3 == 0, post).alias("document"), F.when(idx % 3 == 1, post).otherwise("").alias("document_label"), F.when(idx % 3 == 2, post).alias("document_name"),
            F.col("label").alias("search_phrase_label"), word.alias("search_phrase_text"), F.when(idx % 7 != 3, (idx % 10) / 10.0).alias("overall_similarity_measure"),
            F.when(idx % 4 == 0, F.lit(True)).alias("negated"),
            F.when(idx % 11 != 5, F.array(F.to_json(base), F.to_json(hit))).alias("word_matches"))
        # The words are objects, not texts.
        text = F.regexp_replace(F.replace(F.replace(F.replace(F.to_json(record), F.lit('\\"'), F.lit('"')), F.lit('"{'), F.lit("{")), F.lit('}"'), F.lit("}")), "^$", "")
        return e.select((F.col("post_id") * 100000 + idx).alias("match_no"), text.alias("value"))
