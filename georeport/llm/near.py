"""Near duplicates by circulant MinHash: banded signatures, exact Jaccard on full sets, connected classes.

A document is the set of its distinct word shingles (64-bit hashes of lower-cased words). The first permutation
scatters shingles over a ring; coordinate k is the least value of the second permutation shifted by k, so all coordinates come
from slices of one table. Bands of the signature make buckets.

Documents with equal sets are one class before banding, so groups of exact copies of any size cost one member. In
a bucket every class is compared with the smallest one. Where a bucket still holds several classes after that, each of its documents meets a few of
the bucket's most central members of another class (those in the largest buckets, so the least changed copies of a text), more of them in
every round; one link is enough to join a class, so large groups of copies collapse with a bounded number of comparisons per
document. What is apart even then is left to a join on the rarest shingles, which leaves out no pair that can be linked; a copy that no central
one is linked with has many shingles of its own, which come first there. A link at the threshold is missed with a chance of
``(1 - t ** rows) ** bands``, 2e-8 at the defaults for t = 0.8; every candidate is confirmed on full sets. No cap.

Null, empty and blank texts have empty sets and are linked with nothing. Fewer words than ``width``: the whole sequence is one
shingle. A null id is its own class (component_id null, kept). Rows that repeat an id are linked as one node. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from georeport.llm import textops as T
from georeport.operators.common import written

_U = np.uint64
EDGES = "a long, b long"


@dataclass(frozen=True)
class Settings:
    """Link sets with 100 * shared >= percent * union. ``ring`` is a power of two."""

    width: int = 5
    percent: int = 80
    bands: int = 45
    rows: int = 5
    ring: int = 1 << 20
    seed: int = 5

    @property
    def length(self) -> int:
        return self.bands * self.rows


@lru_cache
def permutations(settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """The scattering permutation, and all slices of the circular second one as a view."""
    rng = np.random.default_rng(settings.seed)
    scatter = rng.permutation(settings.ring).astype(np.uint32)
    second = rng.permutation(settings.ring).astype(np.uint32)
    around = np.concatenate([second, second[:settings.length]])
    return scatter, np.lib.stride_tricks.sliding_window_view(around, settings.length)


def shingle_sets(column, width: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each row."""
    buf, off = T.utf8(column)
    for a, b in T.pieces(off):
        part = T.LOWER[buf[off[a]:off[b]]]
        starts, ends, first = T.word_spans(part, off[a:b + 1] - off[a])
        if not len(starts):
            yield from (np.zeros(0, _U) for _ in range(a, b))
            continue
        rolling = T.Rolling(T.word_hashes(part, starts, ends))
        for i in range(b - a):
            lo, hi = first[i], first[i + 1]
            if hi - lo >= width:
                at = np.arange(lo, hi - width + 1)
                yield np.unique(rolling.of(at, at + width))
            else:
                yield rolling.of(np.array([lo]), np.array([hi])) if hi > lo else np.zeros(0, _U)


def signature(shingles: np.ndarray, settings: Settings) -> np.ndarray:
    scatter, slices = permutations(settings)
    at = scatter[(shingles & _U(settings.ring - 1)).astype(np.int64)]
    least = np.full(settings.length, settings.ring, np.uint32)
    for i in range(0, len(at), 2048):
        np.minimum(least, slices[at[i:i + 2048]].min(0), out=least)
    return least


def band_keys(least: np.ndarray, settings: Settings) -> np.ndarray:
    part = least.reshape(settings.bands, settings.rows).astype(_U)
    key = np.arange(1, settings.bands + 1, dtype=_U)
    with np.errstate(over="ignore"):
        for j in range(settings.rows):
            key = T.mix(key * _U(0x9E3779B97F4A7C15) + part[:, j])
    return key


def sketches(docs: DataFrame, settings: Settings = Settings(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, n_shingles, two sums that stand for the whole set, band keys."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sets = batch.column(0), shingle_sets(batch.column(1), settings.width)
            for a in range(0, len(ids), 512):
                n, one, two, keys, ends = [], [], [], [], [0]
                with np.errstate(over="ignore"):
                    for _ in range(a, min(a + 512, len(ids))):
                        s = next(sets)
                        n.append(len(s))
                        one.append(T.mix(s + _U(77)).sum(dtype=_U))
                        two.append(T.mix(s ^ _U(0xA5A5A5A5A5A5A5A5)).sum(dtype=_U))
                        if len(s):
                            keys.append(band_keys(signature(s, settings), settings))
                        ends.append(len(keys) * settings.bands)
                flat = np.concatenate(keys) if keys else np.zeros(0, _U)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, len(n)), pa.array(np.array(n, np.int64)), pa.array(T.signed(np.array(one, _U))), pa.array(T.signed(np.array(two, _U))),
                     T.lists(T.signed(flat), np.array(ends))], ["id", "n_shingles", "one", "two", "keys"])

    return docs.select(F.col(doc_id).cast("long").alias("id"), docs[text].alias("text")).mapInArrow(run, "id long, n_shingles long, one long, two long, keys array<long>")


def _sets(docs: DataFrame, settings: Settings) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sets = batch.column(0), shingle_sets(batch.column(1), settings.width)
            for a in range(0, len(ids), 256):
                got = [next(sets) for _ in range(a, min(a + 256, len(ids)))]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in got])])
                yield pa.RecordBatch.from_arrays([ids.slice(a, len(got)), T.lists(T.signed(np.concatenate(got)), ends)], ["id", "shingles"])

    return docs.mapInArrow(run, "id long, shingles array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold. A frequent ``a`` is split by adaptive execution."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    shared = F.size(F.array_intersect("sa", "sb")).cast("long")
    n = F.size("sa") + F.size("sb")
    possible = 100 * F.least(F.size("sa"), F.size("sb")) >= percent * F.greatest(F.size("sa"), F.size("sb"))
    return (pairs.join(right, "b").join(left, "a").where(possible).withColumn("shared", shared)
            .where(100 * F.col("shared") >= percent * (n - F.col("shared"))).select("a", "b"))


def prefix_pairs(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of nodes (head, label) with different labels that may reach the threshold; leaves none of them out.

    Shingles of a set are ordered from rare to frequent among the nodes. Two sets that share enough must share one
    near the front of both, as too few are left behind it otherwise. A document's own shingles come first.
    """
    each = sets.join(nodes.select(F.col("head").alias("id"), "label"), "id").select("id", "label", F.size("shingles").alias("n"), F.explode("shingles").alias("g"))
    counts = each.groupBy("g").agg(F.count("*").alias("df")).where("df > 1")
    order = F.sort_array(F.collect_list(F.struct(F.coalesce("df", F.lit(1)).alias("df"), "g")))
    front = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    fronts = (each.join(counts, "g", "left").groupBy("id", "label", "n").agg(order.alias("o")).select("id", "label", "n", F.posexplode(F.slice("o", 1, front.cast("int"))).alias("at", "x"))
              .where("x.df > 1").select("id", "label", "n", (F.col("at") + 1).alias("at"), F.col("x.g").alias("g")))
    fronts = written(fronts, "fronts")
    a = fronts.select("g", *(F.col(c).alias(f"{c}_a") for c in ("id", "label", "n", "at")))
    b = fronts.select("g", *(F.col(c).alias(f"{c}_b") for c in ("id", "label", "n", "at")))
    # The least number of shared shingles at these sizes.
    need = F.ceil((F.col("n_a") + F.col("n_b")) * percent / (100 + percent))
    fits = ((F.col("id_a") < F.col("id_b")) & (F.col("label_a") != F.col("label_b")) & (F.least("n_a", "n_b") >= need)
            & (F.col("at_a") <= F.col("n_a") - need + 1) & (F.col("at_b") <= F.col("n_b") - need + 1))
    return a.join(b, (a["g"] == b["g"]) & fits).select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct()


def classes(edges: DataFrame) -> DataFrame:
    """(id, label): label is the smallest id connected with id; only ids that have an edge.

    Each round every node takes the least label among its neighbours, then the label of that label, until nothing changes.
    Rounds are written tables, so nothing is gathered and lineage stays short; paths shrink by halves.
    """
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "links")
    labels = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("label")), "labels")
    while True:
        near = (both.join(labels.select(F.col("id").alias("b"), F.col("label").alias("other")), "b").groupBy("a").agg(F.min("other").alias("other")))
        hooked = labels.join(near, labels["id"] == near["a"]).select("id", "label", F.least("label", "other").alias("next"))
        # The label that a node leaves is itself a node: it follows to the smaller label as well.
        pulled = hooked.where("next < label").groupBy(F.col("label").alias("root")).agg(F.min("next").alias("pull"))
        step = (hooked.join(pulled, hooked["id"] == pulled["root"], "left")
                .select("id", "label", F.least("next", F.coalesce("pull", "next")).alias("next")))
        step = written(step, "step")
        jump = step.select(F.col("id").alias("to"), F.col("next").alias("far"))
        new = written(step.join(jump, step["next"] == jump["to"], "left").select("id", F.least("next", F.coalesce("far", "next")).alias("label"), F.col("label").alias("old")), "labels")
        if not new.where("label <> old").limit(1).count():
            return new.select("id", "label")
        labels = new.select("id", "label")


#: Central members that a document meets in each round.
ROUNDS = (4, 8, 16)


def _named(shared: DataFrame, found: DataFrame) -> DataFrame:
    """Members of the buckets that still hold several classes, with their class."""
    rows = written(shared.join(found, shared["head"] == found["id"], "left").select("key", "head", F.coalesce("label", "head").alias("label")), "named")
    apart = rows.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key")
    return written(rows.join(apart, "key"), "apart")


def central_pairs(apart: DataFrame, sizes: DataFrame, weight: DataFrame, most: int, turn: int) -> DataFrame:
    """Pairs (a, b) of a document b and the ``most`` most central members of one of its buckets that are of another class."""
    ranked = apart.join(weight, "head").withColumn("rank", F.row_number().over(W.partitionBy("key").orderBy(F.desc("weight"), "head"))).where(F.col("rank") <= most)
    centres = ranked.select("key", F.col("head").alias("a"), F.col("label").alias("other"))
    # The largest bucket of a document first, then others.
    order = F.struct("n", "key") if turn == 0 else F.struct(F.xxhash64("key", F.lit(turn)), "key")
    asked = apart.join(sizes, "key").groupBy("head", "label").agg(F.max(order).alias("o")).select(F.col("head").alias("b"), "label", F.col("o.key").alias("key"))
    return asked.join(centres, "key").where("label <> other").select("a", "b").distinct()


def _merged(found: DataFrame, links: DataFrame) -> DataFrame:
    """Classes after more links, which are between few classes."""
    name = found.select(F.col("id").alias("x"), "label")

    def root(side: str) -> DataFrame:
        return links.select(F.col(side).alias("x"), F.col("a").alias("_a"), F.col("b").alias("_b")).join(name, "x", "left").select("_a", "_b", F.coalesce("label", "x").alias(side))

    edges = root("a").join(root("b"), ["_a", "_b"]).select("a", "b").where("a <> b").distinct()
    roots = classes(edges).select(F.col("id").alias("label"), F.col("label").alias("root"))
    known = found.join(roots, "label", "left").select("id", F.coalesce("root", "label").alias("label"))
    # Documents that had no link before are their own classes.
    new = roots.join(found.select(F.col("id").alias("label")), "label", "left_anti").select(F.col("label").alias("id"), F.col("root").alias("label"))
    return written(known.unionByName(new), "classes")


def linked_classes(docs: DataFrame, settings: Settings = Settings(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, n_shingles, component_id (least id connected), kept."""
    sketched = written(sketches(docs, settings, doc_id, text), "sketches")
    same = ["n_shingles", "one", "two"]
    heads = written(sketched.where("n_shingles > 0 and id is not null").groupBy(*same).agg(F.min("id").alias("head"), F.first("keys").alias("keys")), "heads")
    slots = heads.select("head", F.explode("keys").alias("key"))
    centre = slots.groupBy("key").agg(F.min("head").alias("centre"), F.max("head").alias("most")).where("most > centre").select("key", "centre")
    shared = written(slots.join(centre, "key").select("key", "head", "centre"), "buckets")  # buckets of two classes or more
    active = shared.select(F.col("head").alias("id")).distinct()
    source = docs.select(F.col(doc_id).cast("long").alias("id"), docs[text].alias("text"))
    sets = written(_sets(source.join(active, "id", "left_semi"), settings), "sets")
    stars = written(shared.where("head <> centre").select(F.col("centre").alias("a"), F.col("head").alias("b")).distinct(), "stars")
    links = written(confirmed(stars, sets, settings.percent), "links")
    found = classes(links)
    # What a bucket's centre did not connect: documents of buckets that hold several classes still.
    sizes = written(shared.groupBy("key").agg(F.count("*").alias("n")), "sizes")
    weight = written(shared.join(sizes, "key").groupBy("head").agg(F.sum("n").alias("weight")), "weights")
    apart = _named(shared, found)
    for turn, most in enumerate(ROUNDS):
        pairs = written(central_pairs(apart, sizes, weight, most, turn), "pairs")
        if not pairs.limit(1).count():
            break
        found = _merged(found, written(confirmed(pairs, sets, settings.percent), "links"))
        apart = _named(shared, found)
    open_ = written(apart.select("head", "label").distinct(), "open")
    rest = prefix_pairs(open_, sets, settings.percent)
    found = _merged(found, written(confirmed(rest, sets, settings.percent), "more"))
    # Every document's class is that of its head.
    final = heads.select(*same, "head").join(found, F.col("head") == F.col("id"), "left").select(*same, F.coalesce("label", "head").alias("component_id"))
    alone = sketched.where("n_shingles = 0 or id is null").select("id", "n_shingles", F.col("id").alias("component_id"))
    grouped = sketched.where("n_shingles > 0 and id is not null").join(final, same).select("id", "n_shingles", "component_id")
    out = grouped.unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))
