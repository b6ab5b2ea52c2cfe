"""Dictionary tagging: gazetteer names, phrase shapes and triggers in post texts.

A text is cut in words once, by the task that holds it. The dictionary's first words, each with the numbers of words that names beginning with it have, are a
bit map of bounded size that goes to the tasks; a word run is only made where its first word and its length
may begin a name. Those few runs become keys and meet the dictionary in one hash join, which decides.
With a dictionary small enough to broadcast, posts are not shuffled for this.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right, insort
from collections.abc import Callable, Iterator, Sequence
from itertools import accumulate
from operator import add

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from georeport.functions.keys import location_key, phrase_key, strip
from georeport.operators.common import let, totals_before, written
from georeport.params import ABBREVIATIONS

WORD = r"[\p{L}\p{N}'’ʼ]+"
# A sentence ends at one of these marks before white space, or with its line.
SENTENCE_MARK, SENTENCE_GAP = r"[.!?…][\"»”)\]]*", r"[\s\u00A0]"
# Order in which labels win when two spans cover the same words.
LABELS = ("LOCALE", "REGION", "GROUP", "DIRECTION", "PROXIMITY")
CONTEXT_LABELS = ("REGION", "DIRECTION", "PROXIMITY", "GROUP")


#: Size limit of the bit map. More names than it can tell apart cost time, not hits.
MAP_BITS = 1 << 23
#: Words and gaps a task remembers.
KNOWN = 200_000


class Starts:
    """Which first words, and which lengths after them, occur in a dictionary; may say yes too often, never no wrongly."""

    def __init__(self, patterns: DataFrame):
        word = r"[\p{L}\p{N}ʼ]+"
        keys = patterns.select("space", F.regexp_extract("key", rf"^{word}", 0).alias("lead"), F.regexp_count("key", F.lit(word)).alias("n")).distinct()
        keys = keys.unionByName(keys.select("space", "lead", F.lit(0).alias("n")).distinct())
        count = keys.count()
        self.bits = min(MAP_BITS, max(1 << 12, 1 << (16 * max(count, 1) - 1).bit_length()))
        at = F.crc32(F.concat_ws("/", "space", F.col("n").cast("string"), "lead").cast("binary")).bitwiseAND(self.bits - 1)
        # At most bits / 64 rows.
        rows = keys.select(F.shiftright(at, 6).alias("i"), F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(63).cast("int")).alias("b"))
        found = {r["i"]: r["b"] for r in rows.groupBy("i").agg(F.bit_or("b").alias("b")).collect()}
        self.map = b"".join((found.get(i, 0) % (1 << 64)).to_bytes(8, "little") for i in range(self.bits // 64))

    def may(self, space: str, lead: str, n: int) -> bool:
        at = zlib.crc32(f"{space}/{n}/{lead}".encode()) & (self.bits - 1)
        return bool(self.map[at >> 3] >> (at & 7) & 1)


def word_table(text: Column, abbreviations: Sequence[str] = ABBREVIATIONS) -> Column:
    """Array of words: text ``w``, gap before ``g``, char range ``cs``-``ce``, token number
    ``ts`` (other visible characters count as tokens), line ``ln`` and sentence ``sn``."""
    def pack(high: Column, low: Column) -> Column:
        return F.shiftleft(high.cast("long"), 32) + low

    def counts(ws: Column, gaps: Column) -> Column:
        chars = F.zip_with(gaps, ws, lambda g, w: pack(
            F.length(g) + F.length(w),
            F.when(g == " ", F.lit(1)).otherwise(F.length(F.regexp_replace(g, r"\s+", "")) + 1)))
        # What precedes the first word does not start a second sentence.
        def ends(g: Column, i: Column) -> Column:
            short = F.lower(ws[F.greatest(i - 1, F.lit(0))]).isin(*abbreviations) & g.rlike(r"^\.(?:[^\S\n]|\u00A0)*$")
            return (i > 0) & (g.contains("\n") | (g.rlike(SENTENCE_MARK + SENTENCE_GAP) & ~short))

        breaks = F.transform(gaps, lambda g, i: F.when(g == " ", F.lit(0).cast("long")).otherwise(pack(
            F.length(g) - F.length(F.translate(g, "\n", "")), ends(g, i).cast("int"))))
        return F.struct(ws.alias("w"), gaps.alias("g"), chars.alias("x"), breaks.alias("y"))

    def word(v: Column, w: Column, i: Column) -> Column:
        x, y = v["x0"][i] + v["x"][i], v["y0"][i] + v["y"][i]
        low = F.lit(0xFFFFFFFF)
        end = F.shiftright(x, 32).cast("int")
        return F.struct(
            w.alias("w"), v["g"][i].alias("g"), (end - F.length(w)).alias("cs"), end.alias("ce"),
            (x.bitwiseAND(low).cast("int") - 1).alias("ts"), F.shiftright(y, 32).cast("int").alias("ln"),
            y.bitwiseAND(low).cast("int").alias("sn"))

    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    parts = let(words, lambda ws: let(F.slice(F.split(text, WORD, -1), 1, F.size(ws)), lambda gs: counts(ws, gs)))
    summed = let(parts, lambda v: v.withField("x0", totals_before(v["x"])).withField("y0", totals_before(v["y"])))
    return let(summed, lambda v: F.transform(v["w"], lambda w, i: word(v, w, i)))


def word_places(posts: DataFrame, name: str = "words") -> DataFrame:
    """Posts (``text`` among their columns) with the token number ``ts`` and the char range ``cs``-``ce`` of each word as an array, as ``word_table`` has them.

    Made by the task that holds the post, in linear time.
    """
    kind = "array<struct<ts:int,cs:int,ce:int>>"
    schema = StructType([*posts.schema.fields, *StructType.fromDDL(f"{name} {kind}").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gaps, kinds = _Memo(_gap), to_arrow_schema(schema)
        for batch in batches:
            ends, empty, columns = [0], [], ([], [], [])
            for text in batch.column("text").to_pylist():
                veiled = (text or "").replace("_", "=")
                ws = _WORDS.findall(veiled)
                gs = _WORDS.split(veiled)[:len(ws)]
                ce = [*accumulate(map(add, map(len, ws), map(len, gs)))]
                columns[0].extend(x - 1 for x in accumulate(gaps[g][0] for g in gs))
                columns[1].extend(e - len(w) for e, w in zip(ce, ws))
                columns[2].extend(ce)
                empty.append(text is None)
                ends.append(len(columns[2]))
            items = pa.StructArray.from_arrays([pa.array(c, pa.int32()) for c in columns], ["ts", "cs", "ce"])
            words = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items, mask=pa.array(empty, pa.bool_()))
            given = [batch.column(c) for c in batch.schema.names]
            yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip([*given, words], kinds)], schema=kinds)

    return posts.mapInArrow(run, schema)


class _Memo(dict):
    """What a function says of the words or gaps seen lately."""

    def __init__(self, of: Callable):
        self.of = of

    def __missing__(self, x):
        if len(self) >= KNOWN:
            self.clear()
        self[x] = out = self.of(x)
        return out


#: ``WORD`` for texts whose underscores are veiled.
_WORDS = re.compile(r"[\w'’ʼ]+")
_SEEN = re.compile(r"[^ \t\n\x0B\f\r]")
_MARK = re.compile(SENTENCE_MARK + r"[ \t\n\x0B\f\r\u00A0]")
_DOT = re.compile(r"\.[ \t\x0B\f\r\u00A0]*[\x85\u2028\u2029]?\Z")


def _gap(g: str) -> tuple[int, int, bool, bool]:
    """Of the characters before a word: tokens with the word, new lines, whether a sentence ends there, and whether it does after an abbreviation."""
    if g == " ":
        return 1, 0, False, False
    line = "\n" in g
    ends = line or bool(_MARK.search(g))
    return len(_SEEN.findall(g)) + 1, g.count("\n"), ends, line or (ends and not _DOT.match(g))


def _lead(space: str, word: str) -> str:
    """Key of a single word; empty if nothing of it counts."""
    if space == "TRIGGER":
        return word.translate(_TRIGGER_MARKS).lower()
    return word.lower().translate(_NAME_MARKS).replace("the", "")


_TRIGGER_MARKS, _NAME_MARKS = dict.fromkeys(map(ord, "'’‘ʼ")), dict.fromkeys(map(ord, "'’"))


def _runs_of(starts: Starts, lengths: dict[str, int], templates: Sequence, abbreviations: Sequence[str]) -> Callable[[str], Iterator[tuple]]:
    """The function that gives the runs of a text that may be names, phrase shapes or triggers.

    A run: space, number of words, the name in it, the run's first and last word, and the tables of words and gaps. The words of a text
    are looked at once; longer runs are only tried where a name may begin.
    """
    gaps, short = _Memo(_gap), frozenset(abbreviations)
    shapes = [(label, tuple(before), tuple(after), lengths[label]) for label, before, after in templates if label in lengths]
    opening = {before[0] for _, before, _, _ in shapes if before}
    any_word = [label for label, before, _, _ in shapes if not before]

    def may_begin(space: str, lead: str) -> bool:
        return space in lengths and (lead == "" or starts.may(space, lead, 0))

    def about(w: str) -> tuple:
        """Lower-case form, keys as first word, and whether a run may begin here."""
        low, name, trigger = w.lower(), _lead("NAME", w), _lead("TRIGGER", w)
        begins = may_begin("NAME", name), may_begin("TRIGGER", trigger), frozenset(x for x, *_ in shapes if may_begin(x, name))
        return low, name, trigger, *begins, begins[0] or begins[1] or low in opening or any(x in begins[2] for x in any_word)

    words = _Memo(about)

    def runs(text: str) -> Iterator[tuple]:
        veiled = text.replace("_", "=")
        ws = _WORDS.findall(veiled)
        size = len(ws)
        if not size:
            return
        gs = _WORDS.split(veiled)[:size]
        known, between = [words[w] for w in ws], [gaps[g] for g in gs]
        ends = [0] + [int(b[2] and (b[3] or known[i][0] not in short)) for i, b in enumerate(between[1:])]
        at = {"ce": [*accumulate(map(add, map(len, ws), map(len, gs)))], "ts": [x - 1 for x in accumulate(b[0] for b in between)], "ln": [*accumulate(b[1] for b in between)], "sn": [*accumulate(ends)]}
        ce, sn = at["ce"], at["sn"]
        heads = [0, *(i for i in range(1, size) if ends[i])]

        def counted(space: str, i: int, n: int) -> bool:
            k = 2 if space == "TRIGGER" else 1
            lead = known[i][k]
            return lead == "" or starts.may(space, lead, sum(1 for w in known[i:i + n] if w[k] != ""))

        def run(space: str, i: int, j: int, n: int, last: int) -> tuple:
            """The run from word i to ``last`` with the name of n words from j on."""
            begin, end = ce[i] - len(ws[i]), ce[last]
            head, stop = (heads[sn[i]], heads[sn[i] + 1] if sn[i] + 1 < len(heads) else size) if space == "TRIGGER" else (0, 0)
            in_sentence = (at["ts"][head], at["ts"][stop - 1] + 1, ce[head] - len(ws[head])) if space == "TRIGGER" else (0, 1, 0)
            return (space, text[ce[j] - len(ws[j]):ce[j + n - 1]], last - i + 1, text[begin:end], at["ts"][i], at["ts"][last] + 1, begin, end, at["ln"][i], sn[i], *in_sentence)

        for i, word in enumerate(known):
            if not word[6]:
                continue
            if word[3] and word[0] != "the":
                for n in range(1, min(lengths["NAME"], size - i) + 1):
                    if known[i + n - 1][0] != "the" and counted("NAME", i, n):
                        yield run("NAME", i, i, n, i + n - 1)
            for label, before, after, longest in shapes:
                j, a = i + len(before), len(after)
                if j >= size or label not in known[j][5] or any(known[i + k][0] != w for k, w in enumerate(before)):
                    continue
                if any(_SEEN.search(g) for g in gs[i + 1:j + 1]):
                    continue
                for n in range(1, min(longest, size - a - j) + 1):
                    behind = range(j + n, j + n + a)
                    if all(known[k][0] == w and not _SEEN.search(gs[k]) for k, w in zip(behind, after)) and counted(label, j, n):
                        yield run(label, i, j, n, j + n + a - 1)
            if word[4]:
                for n in range(1, min(lengths["TRIGGER"], size - i) + 1):
                    if sn[i + n - 1] != sn[i]:
                        break
                    if counted("TRIGGER", i, n):
                        yield run("TRIGGER", i, i, n, i + n - 1)

    return runs


def dictionary(locales: DataFrame, regions: DataFrame, groups: DataFrame, directions: DataFrame,
               triggers: DataFrame | None = None) -> DataFrame:
    """Union of all patterns: ``space``, ``key``, ``label``, ``words``, the longest run of words."""
    def keys(df: DataFrame, spaces: Sequence[tuple[str, str]]) -> DataFrame:
        names = F.concat(F.coalesce("aliases", F.array().cast("array<string>")), F.array("name"))
        kinds = F.array(*(F.struct(F.lit(s).alias("space"), F.lit(x).alias("label")) for s, x in spaces))
        return (df.select(F.explode(names).alias("a")).select(
                    location_key("a").alias("key"), F.regexp_count("a", F.lit(WORD)).alias("words"))
                .filter("key <> '' and words > 0")
                .select("key", "words", F.explode(kinds).alias("k")).select("k.*", "key", "words"))

    out = (keys(locales, [("NAME", "LOCALE"), ("PROXIMITY", "PROXIMITY")])
           .unionByName(keys(regions, [("NAME", "REGION")]))
           .unionByName(keys(groups, [("NAME", "GROUP")]))
           .unionByName(keys(directions, [("DIRECTION", "DIRECTION")])))
    if triggers is not None:
        out = out.unionByName(triggers.select(
            F.lit("TRIGGER").alias("space"), "label", phrase_key("trigger").alias("key"),
            F.regexp_count("trigger", F.lit(WORD)).alias("words")).filter("key <> '' and words > 0"))
    return out.groupBy("space", "key", "label").agg(F.max("words").alias("words"))


_RUN = "space string, name string, n int, surface string, ts int, te int, cs int, ce int, ln int, sn int, s_ts int, s_te int, s_cs int"
#: Runs given on at once.
RUNS_AT_ONCE = 8192


def match_words(posts: DataFrame, patterns: DataFrame, templates: Sequence, abbreviations: Sequence[str] = ABBREVIATIONS,
                partitions: int | None = None) -> DataFrame:
    """All dictionary hits in posts (``post_id``, ``text``), overlapping ones included.

    The patterns are written first, so Spark knows their size and sends them around only if they are
    small. ``partitions`` deals posts out anew, for inputs that arrive in few pieces; more posts make more tasks, as many as Spark's shuffles have.
    """
    patterns = written(patterns.select("space", "key", "label", "words"), "patterns")
    lengths = {r["space"]: r["n"] for r in
               patterns.groupBy("space").agg(F.max("words").alias("n")).collect()}
    starts = Starts(patterns)
    templates = [(label, tuple(before), tuple(after)) for label, before, after in templates]
    dealt = posts.select("post_id", "text")
    if partitions:
        tasks = max(partitions, int(posts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        dealt = dealt.repartition(tasks)
    schema = StructType([dealt.schema["post_id"], *StructType.fromDDL(_RUN).fields])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, runs = to_arrow_schema(schema), _runs_of(starts, lengths, templates, abbreviations)
        for batch in batches:
            owners, rows = [], []

            def given() -> pa.RecordBatch:
                columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), list(kinds)[1:])]
                return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owners)).cast(kinds[0].type), *columns], schema=kinds)

            for no, text in enumerate(batch.column(1)):
                for r in runs(text.as_py() or ""):
                    owners.append(no)
                    rows.append(r)
                    if len(rows) >= RUNS_AT_ONCE:
                        yield given()
                        owners.clear()
                        rows.clear()
            if rows:
                yield given()

    found = dealt.mapInArrow(cut, schema)
    key = F.when(F.col("space") == "TRIGGER", phrase_key("name")).otherwise(location_key("name"))
    found = found.withColumn("key", key).filter("key <> ''")
    rest = [c for c in schema.fieldNames() if c not in ("post_id", "space", "name")]
    return found.join(patterns.select("space", "key", "label"), ["space", "key"]).select("space", "key", "post_id", *rest, "label")


def choose_spans(hits: DataFrame) -> DataFrame:
    """Non-overlapping spans of a post: longest first, then leftmost.

    A task takes the spans of a post in that order and keeps the token ranges taken so far sorted, so a span is
    only compared with its two neighbours.
    """
    fields = ["label", "ts", "te", "cs", "ce", "ln", "surface", "key"]
    order = F.array(*(F.lit(x) for x in LABELS))
    rows = hits.select("post_id", *fields, F.array_position(order, F.col("label")).alias("_prio"))
    rows = rows.repartition("post_id").sortWithinPartitions("post_id", F.col("ts") - F.col("te"), "ts", "_prio", "label", "key").drop("_prio")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        post, starts, ends = None, [], {}
        for batch in batches:
            kept = []
            for no, (own, ts, te) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("post_id", "ts", "te")))):
                if own != post:
                    post, starts, ends = own, [], {}
                at = bisect_right(starts, ts)
                if (at and ends[starts[at - 1]] > ts) or (at < len(starts) and starts[at] < te):
                    continue
                insort(starts, ts)
                ends[ts] = te
                kept.append(no)
            yield batch.take(pa.array(kept, pa.int64()))

    return rows.mapInArrow(run, rows.schema)


def tag_spans(posts: DataFrame, patterns: DataFrame, templates: Sequence, partitions: int | None = None) -> DataFrame:
    """Labelled spans of posts."""
    places = patterns.filter("space <> 'TRIGGER'")
    return choose_spans(match_words(posts, places, templates, partitions=partitions))


def trigger_hits(hits: DataFrame) -> DataFrame:
    """One row per post, sentence, label and trigger: the first occurrence."""
    return (hits.groupBy("post_id", "sn", "label", F.col("key").alias("trigger"))
            .agg(F.min(F.struct("ts", "te", "cs", "s_ts", "s_te", "s_cs", "surface")).alias("s"))
            .select("post_id", "sn", "label", "trigger", "s.*"))


def sentences(text: Column, abbreviations: Sequence[str] = ABBREVIATIONS) -> Column:
    """Sentences that hold a word, in the numbering of ``sn``."""
    one = WORD.removesuffix("+")
    # The dot of an abbreviation is veiled while the text is cut.
    veiled = F.regexp_replace(text, rf"(?<!{one})((?iu:{'|'.join(abbreviations)}))\.(?=(?:[^\S\n]|\u00A0)*{one})", "$1\uE000")
    cut = F.regexp_replace(veiled, f"({SENTENCE_MARK}){SENTENCE_GAP}", "$1\n")
    parts = F.filter(F.split(cut, "\n", -1), lambda s: s.rlike(WORD))
    return F.transform(parts, lambda s: F.translate(strip(s), "\uE000", "."))
