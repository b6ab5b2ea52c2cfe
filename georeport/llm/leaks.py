"""Benchmark decontamination over a positional inverted index, in DataFrame operations only.

Benchmark texts are cut in windows of consecutive words. Word counts over the whole corpus tell the rarest and second rarest
word of each window. The index holds the postings of just these words: row, position, and for the rarest the words around it.
Per window the two lists, shifted by the word's offset, are intersected; survivors are checked word by word. Words that
no window needs never leave the scan, and counts are combined before they are shuffled.

Index words are sent to the scans in parts of at most ``part_bytes``; a larger benchmark takes several scans.

Null and blank texts have no words. Items shorter than a window are one window. Rows are told apart by id and text, so a repeated or
null id is safe; equal rows get equal results. Other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from georeport.operators.common import written

# All ASCII but letters and digits; texts are cut before their words are lower-cased.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
KEY = ["row_id", "row_hash"]


def lower_ascii(word: Column) -> Column:
    """A-Z only. Words without other letters take the fast way."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, UPPER, UPPER.lower()))


def raw_words(text: Column) -> Column:
    """Words of a text, case as it is."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS), "")


def keyed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(docs[doc_id].alias("row_id"), F.xxhash64(docs[text]).alias("row_hash"), docs[text].alias("text"))


def windows(items: DataFrame, width: int, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, phrase): every run of ``width`` words, or the whole of a shorter item."""
    words = items.select(items[item_id].alias("item_id"), F.transform(raw_words(items[text]), lower_ascii).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - width, F.lit(0)))
    return words.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i + 1, width))).alias("phrase")).distinct()


def ranked(phrases: DataFrame, rows: DataFrame) -> DataFrame:
    """Per phrase its number, length, and its two rarest words in the corpus with their offsets (the second null if there is one word)."""
    counts = rows.select(F.explode(raw_words(F.col("text"))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    counts = counts.groupBy(lower_ascii(F.col("w")).alias("word")).agg(F.sum("n").alias("n"))
    used = phrases.select(F.explode("phrase").alias("word")).distinct()
    known = written(counts.join(used, "word"), "counts")
    each = phrases.select("phrase_no", F.posexplode("phrase").alias("offset", "word")).join(known, "word", "left")
    # A word that the corpus lacks sorts first: its phrase has no postings and so no match.
    order = F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "offset")
    two = each.groupBy("phrase_no").agg(F.slice(F.sort_array(F.collect_list(order)), 1, 2).alias("rare"))
    return phrases.join(two, "phrase_no").select(
        "phrase_no", "phrase", F.size("phrase").alias("length"), F.col("rare")[0]["word"].alias("first"), F.col("rare")[0]["offset"].alias("first_at"),
        F.try_element_at("rare", F.lit(2))["word"].alias("second"), F.try_element_at("rare", F.lit(2))["offset"].alias("second_at"))


def postings(rows: DataFrame, terms: DataFrame, around: int, part_bytes: int = 4 << 20) -> DataFrame:
    """Index rows (term, row, pos, near, near_from) of the given terms (term, leads).

    For terms that lead a phrase, ``near`` are the raw words from ``near_from`` on, up to ``around`` each side; for others it is null.
    """
    size = terms.agg(F.coalesce(F.sum(F.octet_length("term") + 16), F.lit(0))).first()[0]
    parts = size // part_bytes + 1
    terms = written(terms.withColumn("part", F.pmod(F.xxhash64("term"), F.lit(parts))), "terms")
    words = rows.select(*KEY, raw_words(F.col("text")).alias("w")).select(*KEY, "w", F.posexplode("w").alias("pos", "word"))
    start = F.greatest(F.col("pos") - (around - 1), F.lit(0))

    def scan(part: int) -> DataFrame:
        few = F.broadcast(terms.where(F.col("part") == part).select("term", "leads"))  # at most about part_bytes
        return (words.join(few, lower_ascii(F.col("word")) == F.col("term"))
                .select("term", *KEY, "pos", start.alias("near_from"), F.when(F.col("leads"), F.slice("w", start + 1, 2 * around - 1)).alias("near")))

    return reduce(DataFrame.union, [scan(p) for p in range(parts)])


def shifted(index: DataFrame, phrases: DataFrame, which: str) -> DataFrame:
    """Postings of each phrase's word, moved to where the phrase would begin."""
    hits = index.join(phrases.where(F.col(which).isNotNull()), index["term"] == phrases[which])
    return hits.withColumn("start", F.col("pos") - F.col(f"{which}_at")).where("start >= 0")


def phrase_matches(index: DataFrame, phrases: DataFrame) -> DataFrame:
    """(row, start, length, phrase_no): exact occurrences of the phrases."""
    place = [*KEY, "start", "phrase_no"]
    first = shifted(index, phrases, "first")
    right = shifted(index.drop("near"), phrases, "second").select(*(F.col(c).alias(f"r_{c}") for c in place))
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"r_{c}")) for c in KEY], (F.col("start") == F.col("r_start")) & (F.col("phrase_no") == F.col("r_phrase_no")))
    both = first.where("second is not null").join(right, same, "left_semi")
    found = both.unionByName(first.where("second is null"))
    inside = F.transform(F.slice("near", F.greatest(F.col("start") - F.col("near_from") + 1, F.lit(1)), F.col("length")), lower_ascii)
    return found.where(inside == F.col("phrase")).select(*KEY, "start", "length", "phrase_no").distinct()


def proximity_matches(index: DataFrame, phrases: DataFrame, slack: int) -> DataFrame:
    """(row, phrase_no, start, other): the two rarest words stand within ``slack`` places of where the phrase has them."""
    cell = F.floor(F.col("start") / (slack + 1))
    a = shifted(index, phrases, "first").select(*KEY, "phrase_no", "start", F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell"))
    b = shifted(index, phrases, "second").select(*(F.col(c).alias(f"r_{c}") for c in KEY), F.col("phrase_no").alias("r_no"), F.col("start").alias("other"), cell.alias("r_cell"))
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"r_{c}")) for c in KEY], (F.col("phrase_no") == F.col("r_no")) & (F.col("cell") == F.col("r_cell")))
    return a.join(b, same).where(F.abs(F.col("start") - F.col("other")) <= slack).select(*KEY, "phrase_no", "start", "other").distinct()


def build(docs: DataFrame, items: DataFrame, width: int = 10, doc_id: str = "doc_id", item_id: str = "item_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(phrases, items of phrases, index): all written, to be searched by the functions above."""
    rows = keyed(docs, doc_id)
    of_items = written(windows(items, width, item_id), "windows")
    numbered = written(of_items.select("phrase").distinct().withColumn("phrase_no", F.monotonically_increasing_id()), "phrases")
    phrases = written(ranked(numbered, rows), "ranked")
    each = F.explode(F.array(F.struct(F.col("first").alias("term"), F.lit(True).alias("leads")), F.struct(F.col("second").alias("term"), F.lit(False).alias("leads"))))
    terms = phrases.select(each.alias("t")).where("t.term is not null").groupBy("t.term").agg(F.max("t.leads").alias("leads"))
    longest = phrases.agg(F.coalesce(F.max("length"), F.lit(1))).first()[0]
    index = written(postings(rows, terms, longest), "index")
    return phrases, of_items.join(numbered, "phrase").select("item_id", "phrase_no"), index


def decontaminate(docs: DataFrame, items: DataFrame, width: int = 10, doc_id: str = "doc_id", item_id: str = "item_id") -> DataFrame:
    """One row per document: row_id, row_hash, n_words, n_hit, items (sorted ids as strings), contaminated."""
    phrases, of_items, index = build(docs, items, width, doc_id, item_id)
    matches = written(phrase_matches(index, phrases), "matches")
    # Covered words: of the spans in order, what reaches beyond the furthest end so far.
    spans = matches.groupBy(*KEY, "start").agg(F.max(F.col("start") + F.col("length")).alias("end"))
    before = W.partitionBy(*KEY).orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    reach = F.coalesce(F.max("end").over(before), F.lit(0))
    new = F.greatest(F.col("end") - F.greatest(F.col("start"), reach), F.lit(0))
    hit = spans.select(*KEY, new.alias("new")).groupBy(*KEY).agg(F.sum("new").cast("long").alias("n_hit"))
    seen = matches.select(*KEY, "phrase_no").distinct().join(of_items, "phrase_no").groupBy(*KEY).agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    rows = keyed(docs, doc_id).select(*KEY, F.size(raw_words(F.col("text"))).cast("long").alias("n_words"))

    def add(left: DataFrame, right: DataFrame) -> DataFrame:
        renamed = right.select(*(F.col(c).alias(f"r_{c}") for c in KEY), *(c for c in right.columns if c not in KEY))
        same = [F.col(c).eqNullSafe(F.col(f"r_{c}")) for c in KEY]
        return left.join(renamed, same[0] & same[1], "left").drop(*(f"r_{c}" for c in KEY))

    out = add(rows, add(hit, seen))
    return out.select(*KEY, "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"),
                      (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))
