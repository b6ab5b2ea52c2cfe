"""Secret scan over a trigram index, in DataFrame operations only.

From each rule's expression a Boolean query over trigrams is derived: text that the rule matches must hold them. The index has a
posting for each query trigram and row that holds it (lower-cased). Postings of a row are intersected
as bits; rows that satisfy a rule's query are its candidates. Rules without a mandatory trigram take every row.
Candidates are verified with the expression itself over the whole text.

Null texts are empty. Rows are told apart by id and text; equal rows get equal results. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from georeport.llm.leaks import KEY, keyed
from georeport.operators.common import written


@dataclass(frozen=True)
class Rule:
    """Matches are leftmost and don't overlap; those whose ``group`` is shorter than ``least`` are dropped after matching."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# The first three are the base rules; letters of the assignment's names count in either case.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
RULES = (
    Rule("assign", ASSIGN, 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[opsru]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
BASE = ("assign", "access", "hex")


# --- Boolean queries ---------------------------------------------------------------------------------------------

def _strings(node, limit: int = 64) -> list[str] | None:
    """All strings that a parsed part can match, lower-cased, if they are few; else None."""
    op, arg = str(node[0]), node[1]
    if op == "LITERAL":
        return [chr(arg).lower()]
    if op == "IN":
        out = {chr(a).lower() for o, a in arg if str(o) == "LITERAL"}
        return sorted(out) if len(out) <= 8 and all(str(o) == "LITERAL" for o, _ in arg) else None
    if op == "SUBPATTERN":
        return _sequence(arg[3], limit)
    if op == "BRANCH":
        found = [_sequence(x, limit) for x in arg[1]]
        return None if any(x is None for x in found) else sorted(set().union(*found))
    if op == "MAX_REPEAT" and arg[1] <= 4:
        one = _sequence(arg[2], limit)
        return None if one is None else _limited(["".join(p) for n in range(arg[0], int(arg[1]) + 1) for p in product(one, repeat=n)], limit)
    return None


def _limited(found: list[str], limit: int) -> list[str] | None:
    return sorted(set(found)) if len(set(found)) <= limit else None


def _sequence(nodes, limit: int) -> list[str] | None:
    out: list[str] | None = [""]
    for node in nodes:
        more = _strings(node, limit)
        out = None if more is None else _limited([a + b for a in out for b in more], limit)
        if out is None:
            return None
    return out


def trigram_query(pattern: str, limit: int = 64) -> list[list[list[str]]]:
    """An AND of ORs of ANDs of trigrams; empty if nothing is mandatory."""
    query, run = [], [""]

    def close() -> None:
        if all(len(s) >= 3 for s in run):
            sets = {frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in run}
            # A set that holds another one adds nothing to the OR.
            query.append(sorted(sorted(x) for x in sets if not any(y < x for y in sets)))

    for node in re._parser.parse(pattern):
        more = _strings(node, limit)
        joined = None if more is None else _limited([a + b for a in run for b in more], limit)
        if joined is None:
            close()
            run = more or [""]
        else:
            run = joined
    close()
    return query


# --- index and search --------------------------------------------------------------------------------------------

def trigrams(rules: Sequence[Rule]) -> list[str]:
    return sorted({g for r in rules for any_of in trigram_query(r.pattern) for all_of in any_of for g in all_of})


def postings(rows: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(gram, row): gram is a place in ``trigrams(rules)``."""
    low = F.lower(F.coalesce("text", F.lit("")))
    held = F.array_compact(F.array(*(F.when(F.col("low").contains(g), i) for i, g in enumerate(trigrams(rules)))))
    return rows.select(*KEY, low.alias("low")).select(*KEY, F.explode(held).alias("gram"))


def candidates(index: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(row, rules): bit i is set where rule i's query holds. Rows without any bit are left out."""
    grams = trigrams(rules)
    groups = range(0, len(grams), 62)  # a long holds 62 of them
    bits = index.groupBy(*KEY).agg(*(F.coalesce(F.bit_or(F.when((F.col("gram") >= g) & (F.col("gram") < g + 62), F.expr(f"shiftleft(1L, gram - {g})"))),
                                                F.lit(0).cast("long")).alias(f"bits{g}") for g in groups))

    def holds(rule: Rule) -> Column:
        def all_of(some: list[str]) -> Column:
            masks = {g: sum(1 << (grams.index(x) - g) for x in some if g <= grams.index(x) < g + 62) for g in groups}
            return reduce(Column.__and__, [F.col(f"bits{g}").bitwiseAND(F.lit(m).cast("long")) == m for g, m in masks.items() if m])
        return reduce(Column.__and__, [reduce(Column.__or__, [all_of(s) for s in any_of]) for any_of in trigram_query(rule.pattern)])

    flags = [F.when(holds(r), 1 << i).otherwise(0) for i, r in enumerate(rules) if trigram_query(r.pattern)]
    return bits.select(*KEY, reduce(Column.__add__, flags, F.lit(0)).alias("rules")).where("rules > 0")


def matches(docs: DataFrame, rules: Sequence[Rule] = RULES, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(all rows' keys, spans): a span has row, rank (place of the rule), kind, start, end in code points, end exclusive."""
    rows = keyed(docs, doc_id, text)
    found = candidates(written(postings(rows, rules), "trigrams"), rules)
    right = found.select(*(F.col(c).alias(f"r_{c}") for c in KEY), "rules")
    joined = rows.join(right, F.col("row_id").eqNullSafe(F.col("r_row_id")) & (F.col("row_hash") == F.col("r_row_hash")), "left")

    def lengths(i: int, rule: Rule) -> Column:
        """Per match: text before it, its own length, whether it stays. Null where the rule has none."""
        pattern, body = F.lit(rule.pattern), F.col("text")
        candidate = F.col("rules").bitwiseAND(F.lit(1 << i)) != 0 if trigram_query(rule.pattern) else F.lit(True)
        gaps = F.transform(F.split(body, rule.pattern, -1), F.length)
        whole = F.transform(F.regexp_extract_all(body, pattern, F.lit(0)), F.length)
        tested = F.transform(F.regexp_extract_all(body, pattern, F.lit(rule.group)), F.length)
        zipped = F.zip_with(F.zip_with(F.slice(gaps, 1, F.size(whole)), whole, lambda g, n: F.struct(g.alias("gap"), n.alias("n"))), tested,
                            lambda x, t: F.struct(x["gap"].alias("gap"), x["n"].alias("n"), (t >= rule.least).alias("stays")))
        return F.when(candidate & body.rlike(rule.pattern), F.struct(F.lit(i).alias("rank"), zipped.alias("found")))

    tested = written(joined.select(*KEY, F.array_compact(F.array(*(lengths(i, r) for i, r in enumerate(rules)))).alias("kinds")), "tested")
    each = (tested.where(F.size("kinds") > 0).distinct().select(*KEY, F.explode("kinds").alias("k")).select(*KEY, "k.rank", F.posexplode("k.found").alias("i", "f"))
            .select(*KEY, "rank", "i", "f.*"))
    to_here = W.partitionBy(*KEY, "rank").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("n")).over(to_here)
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    spans = each.withColumn("end", end).where("stays").select(*KEY, "rank", kinds[F.col("rank")].alias("kind"), (F.col("end") - F.col("n")).alias("start"), "end")
    return tested.select(*KEY), spans


def joined_spans(which: Column) -> Column:
    """Spans of a group as kind:start:end, by start, then by the rules' order."""
    item = F.struct("start", "rank", "end", F.concat_ws(":", "kind", "start", "end").alias("said"))
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.when(which, item))), lambda x: x["said"]), ",")


def scan(docs: DataFrame, rules: Sequence[Rule] = RULES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: row_id, row_hash, n_<kind> for the base kinds, base (their spans), spans (all), as joined text."""
    keys, spans = matches(docs, rules, doc_id, text)
    counts = [F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in BASE]
    per_row = spans.groupBy(*KEY).agg(*counts, joined_spans(F.col("kind").isin(*BASE)).alias("base"), joined_spans(F.lit(True)).alias("spans"))
    right = per_row.select(*(F.col(c).alias(f"r_{c}") for c in KEY), *(c for c in per_row.columns if c not in KEY))
    out = keys.join(right, F.col("row_id").eqNullSafe(F.col("r_row_id")) & (F.col("row_hash") == F.col("r_row_hash")), "left")
    return out.select(*KEY, *(F.coalesce(f"n_{k}", F.lit(0).cast("long")).alias(f"n_{k}") for k in BASE),
                      *(F.coalesce(c, F.lit("")).alias(c) for c in ("base", "spans")))


def redacted(docs: DataFrame, rules: Sequence[Rule] = RULES, mask: str = "[secret]", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows with every span, overlapping ones merged, replaced by the mask; other columns stay."""
    _, spans = matches(docs, rules, doc_id, text)
    before = W.partitionBy(*KEY).orderBy("start", "end").rowsBetween(W.unboundedPreceding, -1)
    reach = F.coalesce(F.max("end").over(before), F.lit(-1))
    group = F.sum((F.col("start") >= F.col("reach")).cast("int")).over(W.partitionBy(*KEY).orderBy("start", "end"))
    merged = spans.withColumn("reach", reach).withColumn("run", group).groupBy(*KEY, "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    cuts = merged.groupBy(F.col("row_id").alias("__id"), F.col("row_hash").alias("__hash")).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("__cuts"))
    body = docs[text]
    joined = docs.join(cuts, docs[doc_id].eqNullSafe(F.col("__id")) & (F.xxhash64(body) == F.col("__hash")), "left")
    n = F.size("__cuts")
    # Text kept before each cut, then what follows the last one.
    kept = F.transform(F.sequence(F.lit(0), n), lambda i: F.substring(
        body, F.when(i == 0, 0).otherwise(F.col("__cuts")[F.greatest(i - 1, F.lit(0))]["end"]) + 1,
        F.when(i == n, F.length(body)).otherwise(F.col("__cuts")[F.least(i, n - 1)]["start"])
        - F.when(i == 0, 0).otherwise(F.col("__cuts")[F.greatest(i - 1, F.lit(0))]["end"])))
    changed = F.when(F.col("__cuts").isNull(), body).otherwise(F.array_join(kept, mask))
    return joined.select(*(changed.alias(c) if c == text else docs[c] for c in docs.columns))
