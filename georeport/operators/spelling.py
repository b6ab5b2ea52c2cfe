"""Russian-style spellings of romanized names from rule tables.

Rules are tables of any size: texts are cut in words, words meet the word table and whole texts the name table by joins, and the
words of a text are put together again in order. Each distinct text is spelled once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from georeport.functions.keys import exonym_key, ruled_word, split_list


@dataclass(frozen=True)
class Spelling:
    """``names`` (name, variant) for whole texts, ``words`` (word, variant) for single words, both in lower case.

    A variant may hold several alternatives, separated by ``;``; those of several rows follow each other in their order.
    """

    names: DataFrame
    words: DataFrame

    @classmethod
    def of(cls, spark: SparkSession, names: dict[str, str] | None = None, words: dict[str, str] | None = None) -> "Spelling":
        return cls(spark.createDataFrame(list((names or {}).items()), "name string, variant string"),
                   spark.createDataFrame(list((words or {}).items()), "word string, variant string"))


def _alternatives(rules: DataFrame, key: str, out: str) -> DataFrame:
    return rules.groupBy(F.col(key).alias(f"_{key}")).agg(F.flatten(F.transform(F.sort_array(F.collect_list("variant")), split_list)).alias(out)).filter(F.size(out) > 0)


def exonyms(texts: DataFrame, rules: Spelling) -> DataFrame:
    """For each distinct ``text``: ``whole``, the spellings that the name table gives, and ``spelled``, those by words.

    A word without a rule is spelled by its ending; with several alternatives per word, all combinations are given.
    """
    each = texts.select("text").dropna().distinct().withColumn("norm", exonym_key("text"))
    norms = each.select("norm").distinct()
    parts = F.split("norm", "[ -]", -1)
    gaps = F.concat(F.regexp_extract_all("norm", F.lit("[ -]"), F.lit(0)), F.array(F.lit("")))
    tokens = norms.select("norm", F.posexplode(F.zip_with(parts, gaps, lambda w, g: F.struct(w.alias("w"), g.alias("g")))).alias("i", "t")).select("norm", "i", "t.*")
    tokens = tokens.join(_alternatives(rules.words, "word", "alts"), F.col("w") == F.col("_word"), "left")
    item = F.struct("i", F.coalesce("alts", F.array(ruled_word(F.col("w")))).alias("alts"), "g")

    def longer(done: Column, t: Column) -> Column:
        return F.flatten(F.transform(done, lambda a: F.transform(t["alts"], lambda b: F.concat(a, b, t["g"]))))

    words = tokens.groupBy("norm").agg(F.aggregate(F.sort_array(F.collect_list(item)), F.array(F.lit("")), longer).alias("by_word"))
    names = _alternatives(rules.names, "name", "whole")
    found = norms.join(words, "norm").join(names, F.col("norm") == F.col("_name"), "left")
    none = F.array().cast("array<string>")
    return each.join(found, "norm").select("text", F.coalesce("whole", none).alias("whole"), F.flatten(F.transform("by_word", split_list)).alias("spelled"))


def with_exonyms(rows: DataFrame, texts: Column, rules: Spelling, key: str = "row_no") -> DataFrame:
    """Rows with ``whole`` and ``spelled``: for each of their texts, in order, what ``exonyms`` gives. ``key`` is unique."""
    each = rows.select(key, F.posexplode(texts).alias("_i", "text"))
    found = each.join(exonyms(each, rules), "text").groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_i", "whole", "spelled"))).alias("_x"))
    none = F.array().cast("array<array<string>>")
    return rows.join(found, key, "left").select(*rows.columns, F.coalesce(F.transform("_x", lambda x: x["whole"]), none).alias("whole"),
                                                F.coalesce(F.transform("_x", lambda x: x["spelled"]), none).alias("spelled"))
