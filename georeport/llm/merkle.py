"""Merkle manifest of a dataset as a persistent tree: each tampered leaf is a version that shares all untouched nodes.

A row's leaf is the SHA-256 of its fields. Leaves of a group (a source) stand in the order of their id, and every ``arity`` consecutive nodes become
their hash until one is left; the groups' last nodes, in the order of the groups, become the root in the same way.

Trees are built in aligned blocks of ``arity ** height`` nodes, which are subtrees of the whole: a task holds one block, the blocks' roots are the leaves of the next
level of blocks, and so on, so a hot group is many blocks. On the way back down each block learns the siblings
above it (a few per level). A version then copies only the ancestors of its leaf: those in its block, whose siblings stay shared, and on
through the levels above, in the block's own task, so versions never meet in one place.

Places within a group come from a range sort, whose partitions are numbered and counted; only one row per partition and group
is summed in a window.

A null field counts as ``-``. Null ids come first, rows that repeat an id stand in the order of their leaves, and each is a leaf. A row is tampered with in
copy only. Without rows there is no tree and no row. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from georeport.operators.common import written

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


@dataclass(frozen=True)
class Settings:
    arity: int = 3
    height: int = 6

    @property
    def block(self) -> int:
        return self.arity ** self.height


@dataclass
class Manifest:
    """Leaves (group, place, total, digest, id, changed) and the siblings above each block of them (group, block, above, subroot, root).

    ``levels`` are the tables of nodes that are block roots, from the leaves up, of the groups' trees and then of the tree over groups.
    """

    settings: Settings
    leaves: DataFrame
    above: DataFrame
    levels: list[DataFrame] = field(default_factory=list)


def said(column: Column) -> Column:
    """A field as it is hashed: its UTF-8 length, a colon and itself."""
    value = column.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*(said(c) for c in fields)), 256)


def joined_hash(digests: list[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows with ``place`` (from 0, in the order of ``order``, nulls first) within ``group`` and the group's ``total``."""
    keys = [F.col(c).asc_nulls_first() for c in ("group", *order)]
    part, at = F.shiftrightunsigned("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    line = written(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id()), "line")
    line = line.withColumn("__part", part).withColumn("__at", at)
    runs = line.groupBy("group", "__part").agg(F.count("*").alias("n"), F.min("__at").alias("first"))
    w = W.partitionBy("group")
    before = F.coalesce(F.sum("n").over(w.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(F.col("group").alias("g"), F.col("__part").alias("p"), (before - F.col("first")).alias("shift"), F.sum("n").over(w).alias("total"))
    return (line.join(runs, line["group"].eqNullSafe(runs["g"]) & (line["__part"] == runs["p"]))
            .withColumn("place", F.col("__at") + F.col("shift")).drop("__at", "__part", "g", "p", "shift"))


def tree(digests: list[str], settings: Settings, whole: bool) -> list[list[str]]:
    """Nodes of a block by level, leaves first. A block that is its group's only one ends with its last node, others have the full height."""
    levels = [digests]
    while (len(levels[-1]) > 1) if whole else (len(levels) <= settings.height):
        last, k = levels[-1], settings.arity
        levels.append([joined_hash(last[i:i + k]) for i in range(0, len(last), k)])
    return levels


def siblings(levels: list[list[str]], i: int, arity: int) -> list[tuple[int, list[str]]]:
    """Own position among its siblings and these, level by level."""
    out = []
    for level in levels[:-1]:
        lo = i - i % arity
        out.append((i - lo, level[lo:i] + level[i + 1:lo + arity]))
        i //= arity
    return out


def packed(path: list[tuple[int, list[str]]]) -> str:
    return "".join(f"{at}{''.join(others)};" for at, others in path)


def unpacked(path: str) -> list[tuple[int, list[str]]]:
    return [(int(x[0]), [x[j:j + 64] for j in range(1, len(x), 64)]) for x in path.split(";")[:-1]]


def version(new: str, levels: list[list[str]], i: int, arity: int, above: list[tuple[int, list[str]]]) -> list[str]:
    """The copied ancestors of a changed leaf, from its parent to the root. All other nodes are those of the tree."""
    copies = []
    for level in levels[:-1]:
        lo = i - i % arity
        new = joined_hash([*level[lo:i], new, *level[i + 1:lo + arity]])
        copies.append(new)
        i //= arity
    for at, others in above:
        new = joined_hash([*others[:at], new, *others[at:]])
        copies.append(new)
    return copies


def _blocks(rows: DataFrame, settings: Settings, handle, schema: str) -> DataFrame:
    """Give each aligned block (its rows in order, led by the row of what lies above it, if any) to ``handle``."""
    block = (F.col("place") / settings.block).cast("long")
    dealt = rows.withColumn("block", F.when(F.col("above").isNull(), block).otherwise(F.col("place"))).withColumn("lead", F.col("above").isNull())
    dealt = dealt.repartition("group", "block").sortWithinPartitions("group", "block", "lead", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, out = [f.split()[0] for f in schema.split(", ")], []
        fields = [pa.field(n, pa.int64() if t == "long" else pa.bool_() if t == "boolean" else pa.list_(pa.string()) if t.startswith("array") else pa.string())
                  for n, t in (f.split() for f in schema.split(", "))]
        open_, key = [], None

        def packed_rows() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out], pa.schema(fields))
            out.clear()
            return batch

        for batch in batches:
            for row in batch.to_pylist():
                own = row["group"], row["block"]
                if open_ and own != key:
                    out.extend(handle(open_))
                    open_ = []
                key = own
                open_.append(row)
                if len(out) >= 4096:
                    yield packed_rows()
        if open_:
            out.extend(handle(open_))
        if out:
            yield packed_rows()

    return dealt.mapInArrow(run, schema)


def _up(nodes: DataFrame, settings: Settings) -> DataFrame:
    """Roots of the blocks of nodes (group, place, total, digest), as nodes of the next level."""
    def handle(rows: list[dict]):
        total = rows[0]["total"]
        levels = tree([r["digest"] for r in rows], settings, total <= settings.block)
        yield rows[0]["group"], rows[0]["block"], -(-total // settings.block), levels[-1][0]

    given = nodes.select("group", "place", "total", "digest", F.lit(None).cast("string").alias("above"))
    return _blocks(given, settings, handle, "group string, place long, total long, digest string")


def _down(nodes: DataFrame, above: DataFrame, settings: Settings) -> DataFrame:
    """What lies above each node: siblings in its block, then what lies above that."""
    def handle(rows: list[dict]):
        lead, own = rows[0], rows[1:]
        levels = tree([r["digest"] for r in own], settings, own[0]["total"] <= settings.block)
        for i, r in enumerate(own):
            yield r["group"], r["place"], packed(siblings(levels, i, settings.arity)) + lead["above"], lead["subroot"], lead["root"]

    return _blocks(_led(nodes, above), settings, handle, "group string, place long, above string, subroot string, root string")


def _led(nodes: DataFrame, above: DataFrame) -> DataFrame:
    return nodes.unionByName(above.select("group", "place", "above", "subroot", "root"), allowMissingColumns=True)


def _climbed(nodes: DataFrame, settings: Settings) -> list[DataFrame]:
    """Levels of block roots, from the nodes given up to one node per group."""
    levels = [nodes]
    while levels[-1].where("total > 1").limit(1).count():
        levels.append(written(_up(levels[-1], settings), "roots"))
    return levels


def manifest(leaves: DataFrame, settings: Settings = Settings()) -> Manifest:
    """Build the tree. ``leaves``: group, id, digest, changed (the digest of a changed row, else null)."""
    # Written first: a range sort reads its input twice, and rows are hashed once.
    own = written(placed(written(leaves, "digests"), ["id", "digest"]), "leaves")
    levels = _climbed(own, settings)
    tops = levels[-1].select(F.lit("").alias("group"), F.col("group").alias("name"), "digest")
    groups = written(placed(tops, ["name"]), "groups")
    upper = _climbed(groups.select("group", "place", "total", "digest"), settings)
    top = upper[-1].select("group", "place", F.lit("").alias("above"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    # The top node is the block root of the level below it, whose nodes learn what lies above them, and so on down to the groups.
    over = top
    for nodes in reversed(upper[:-1]):
        over = written(_down(nodes, over, settings), "above")
    over = (over.join(groups.select("place", "name", F.col("digest").alias("own")), "place")
            .select(F.col("name").alias("group"), F.lit(0).cast("long").alias("place"), "above", F.col("own").alias("subroot"), "root"))
    for nodes in reversed(levels[1:-1]):
        over = written(_down(nodes, over, settings), "above")
    return Manifest(settings, own, over, levels + upper)


def versions(tree_of: Manifest, nodes: bool = False) -> DataFrame:
    """One row per leaf: id, leaf, subroot, root, proof_sha256 (hash of all siblings up to the root), folded_root, verified.

    A changed leaf makes a version of the tree; ``folded_root`` is that version's root. With ``nodes``, ``copied`` lists the
    ancestors it copies, from the leaf's parent to the new root; empty where nothing changed.
    """
    settings = tree_of.settings

    def handle(rows: list[dict]):
        lead, own = rows[0], rows[1:]
        levels = tree([r["digest"] for r in own], settings, own[0]["total"] <= settings.block)
        above, upper = unpacked(lead["above"]), "".join(x[1:] for x in lead["above"].split(";"))
        for i, r in enumerate(own):
            proof = "".join(x for _, others in siblings(levels, i, settings.arity) for x in others) + upper
            copies = version(r["changed"], levels, i, settings.arity, above) if r["changed"] else []
            folded = (copies[-1] if copies else r["changed"]) if r["changed"] else lead["root"]
            out = (r["id"], r["digest"], lead["subroot"], lead["root"], hashlib.sha256(proof.encode()).hexdigest(), folded, folded == lead["root"])
            yield (*out, copies) if nodes else out

    schema = "id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean" + (", copied array<string>" if nodes else "")
    return _blocks(_led(tree_of.leaves, tree_of.above), settings, handle, schema)


def document_leaves(docs: DataFrame) -> DataFrame:
    """Leaves of ``documents`` by source. Where crc32 of the id as text is even, the changed row lacks the line breaks of its text."""
    fields = [F.col(c) for c in FIELDS]
    tampered = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0) & (F.instr("text", "\n") > 0)
    changed = leaf([*fields[:-1], F.translate("text", "\n", "")])
    return docs.select(F.col("source").cast("string").alias("group"), F.col("doc_id").cast("long").alias("id"), leaf(fields).alias("digest"), F.when(tampered, changed).alias("changed"))
