"""Prefix trie of conversations by truncation peeling.

A conversation is its turns in order, each a (role, text) pair. A trie node is a distinct sequence of first turns. Peeling starts at the greatest
depth: conversations that end there and nodes that survive from one turn deeper stand side by side, those with equal sequences are
merged, the node's numbers are complete, its last turn is stripped, and it joins its parent's group one turn further up. So one pass from
the deepest turn to the root finds every node and sums its subtree.

Turns become digests while the table is read; a conversation's digests in a row are its path. Paths are dealt out by range in their order and peeled in blocks of
bounded size, whatever prefix they share: a block completes all nodes that lie inside it. Nodes on the path of its
first or last row may go on in a neighbour block; their sums so far travel on that path, one row for each edge of a block, to the next
round, until one block holds all rows. Thousands of rows become two, so rounds are few, however deep conversations are.

Turns are ordered by ``turn`` (null first), then role, then the text's digest. A null role or text is empty, a null conversation id is none and its
rows are left out. Repeated rows are turns of their own. Without conversations there is no node. Other columns are ignored. A conversation's
digests (16 bytes a turn) are held together, as a text is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from georeport.operators.common import written

WORD = r"[^\x20\x09-\x0D]+"
_FAR = np.iinfo(np.int64).max
_SUMS = ("n", "least", "children", "leaves", "saved")
NODE, EDGE, ENDS = 0, 1, 2
_SCHEMA = ("kind int, depth long, conv_id long, parent_conv_id long, node binary, parent binary, n_convs long, n_children long, n_leaves long, saved_tokens long, "
           "ends_sha256 string, ids binary, path binary, words array<int>, " + ", ".join(f"{c} array<long>" for c in _SUMS))
_ARROW = pa.schema([pa.field(name, {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "array<int>": pa.list_(pa.int32()),
                                    "array<long>": pa.list_(pa.int64())}[kind]) for name, kind in (x.split() for x in _SCHEMA.split(", "))])


def paths(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): the turns of each conversation in order, as (digest of role and text, words of the text)."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    turn = F.struct(F.col("turn").alias("turn"), role.alias("role"), digest.alias("digest"), F.regexp_count(text, F.lit(WORD)).alias("words"))
    own = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t"))
    return (own.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
            .select("conv_id", F.transform("t", lambda t: F.struct(t["digest"].alias("digest"), t["words"].alias("words"))).alias("turns")))


def rebuilt(own: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """Conversations whose first turns are those of the conversation ``c - c % every``: crc32(c) % most of them, or all it has."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    head = own.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("of"), F.slice("turns", 1, most - 1).alias("head"))
    both = own.withColumn("h", h).join(head, F.col("conv_id") - F.col("conv_id") % every == F.col("of"), "left")
    kind = own.schema["turns"].dataType
    first = F.slice(F.coalesce("head", F.array().cast(kind)), F.lit(1), F.col("h"))
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return both.select("conv_id", F.concat(first, rest).alias("turns"))


@dataclass
class Block:
    """Rows in path order. ``digests`` and ``words`` are flat, a turn an entry; ``items`` are sums at a depth of a row's path."""

    lens: np.ndarray
    off: np.ndarray
    digests: np.ndarray
    words: np.ndarray
    items: dict[str, np.ndarray]

    def shared(self) -> np.ndarray:
        """Leading turns that each row has in common with the row before it."""
        most = np.minimum(self.lens[1:], self.lens[:-1])
        start = np.cumsum(most) - most
        at = np.arange(most.sum()) - np.repeat(start, most)
        a, b = at + np.repeat(self.off[:-2], most), at + np.repeat(self.off[1:-1], most)
        differ = (self.digests[a] != self.digests[b]).any(1)
        out = most.copy()
        row = np.repeat(np.arange(len(most)), most)[differ]
        np.minimum.at(out, row, at[differ])
        return np.concatenate([[0], out])

    def path(self, row: int) -> bytes:
        return self.digests[self.off[row]:self.off[row + 1]].tobytes()


def node_names(path: bytes) -> list[bytes]:
    """Digest of each prefix of a path, the empty one included."""
    running, out = hashlib.md5(), []
    for i in range(len(path) // 16 + 1):
        out.append(running.digest())
        running.update(path[16 * i:16 * i + 16])
    return out


def peel(block: Block, last: bool, ids: np.ndarray | None = None) -> pa.Table:
    """Complete nodes of the block, its two edges, and (where ``ids`` are given) the conversations that end at nodes on the edges."""
    n, shared = len(block.lens), block.shared()
    by_len = np.argsort(block.lens, kind="stable")
    len_at = np.searchsorted(block.lens[by_len], np.arange(block.lens.max() + 2))
    items = {k: v[np.argsort(block.items["depth"], kind="stable")] for k, v in block.items.items()}
    item_at = np.searchsorted(items["depth"], np.arange(block.lens.max() + 2))
    edges = [dict.fromkeys(_SUMS), dict.fromkeys(_SUMS)]
    for edge, row in zip(edges, (0, n - 1)):
        for c in _SUMS:
            edge[c] = np.full(block.lens[row] + 1, _FAR if c == "least" else 0, np.int64)
    names = [node_names(block.path(row)) for row in (0, n - 1)]
    first, closed = np.zeros(0, np.int64), np.zeros(0, bool)
    end = np.zeros(0, np.int64)
    sums = {c: np.zeros(0, np.int64) for c in _SUMS}
    number = np.zeros(0, np.int64)  # of the node among those found, for the parent that it has yet to learn
    found: list[dict[str, np.ndarray]] = []
    parents: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    count = 0
    for depth in range(int(block.lens.max()), -1, -1):
        ended = np.sort(by_len[len_at[depth]:len_at[depth + 1]])
        order = np.argsort(np.concatenate([first, ended]), kind="stable")
        rows = np.concatenate([first, ended])[order]
        stop = np.concatenate([end, ended])[order]
        # Equal sequences: rows next to each other that share as many turns as this depth.
        start = np.ones(len(rows), bool)
        start[1:] = (rows[1:] != stop[:-1] + 1) | (shared[rows[1:]] < depth)
        at = np.flatnonzero(start)
        group = np.cumsum(start) - 1
        own = {}
        for c in _SUMS:
            empty = np.full(len(ended), _FAR if c == "least" else 0, np.int64)
            own[c] = (np.minimum if c == "least" else np.add).reduceat(np.concatenate([sums[c], empty])[order], at)
        new_first, new_end = rows[at], np.maximum.reduceat(stop, at)
        sl = slice(item_at[depth], item_at[depth + 1])
        where = np.searchsorted(new_first, items["row"][sl], "right") - 1
        for c in _SUMS:
            (np.minimum if c == "least" else np.add).at(own[c], where, items[c][sl])
        open_ = np.zeros(len(at), bool) if last else (new_first == 0) | (new_end == n - 1)
        if len(first):  # the children learn their parent
            child = np.argsort(order, kind="stable")[:len(first)]
            parents.append((number[closed], group[child][closed], np.full(int(closed.sum()), len(found))))
        for g in np.flatnonzero(open_):
            edge = edges[0] if new_first[g] == 0 else edges[1]
            for c in _SUMS:
                edge[c][depth] = own[c][g]
        done = ~open_
        words = block.words[block.off[new_first] + depth - 1] if depth else np.zeros(len(at), np.int64)
        leaves = np.where(own["children"] == 0, 1, own["leaves"])
        saved = own["saved"] + (own["n"] - 1) * words
        found.append({"depth": np.full(len(at), depth), "first": new_first, "closed": done, "conv_id": own["least"], "n_convs": own["n"],
                      "n_children": own["children"], "n_leaves": leaves, "saved_tokens": saved, "number": np.where(done, count + np.cumsum(done) - 1, -1)})
        number = found[-1]["number"]
        count += int(done.sum())
        first, end, closed = new_first, new_end, done
        sums = {"n": np.where(done, own["n"], 0), "least": np.where(done, own["least"], _FAR), "children": done.astype(np.int64),
                "leaves": np.where(done, leaves, 0), "saved": np.where(done, saved, 0)}
    return _told(block, last, ids, names, edges, found, parents, count, shared)


def _told(block, last, ids, names, edges, found, parents, count, shared) -> pa.Table:
    flat = {k: np.concatenate([f[k] for f in found]) for k in found[0]}
    level_at = np.cumsum([0, *(len(f["first"]) for f in found)])
    closed = flat["closed"]
    parent_conv, parent_node = np.full(count, -1, np.int64), [None] * count
    has = np.zeros(count, bool)
    for child, group, level in parents:
        if not len(child):
            continue
        up = level_at[level] + group
        known = closed[up]
        parent_conv[child[known]], has[child[known]] = flat["conv_id"][up[known]], True
        for c, u in zip(child[~known], up[~known]):
            parent_node[c] = names[0 if flat["first"][u] == 0 else 1][flat["depth"][u]]
    nodes = {k: v[closed] for k, v in flat.items()}
    out = {f.name: [None] * count for f in _ARROW}
    out["kind"] = [NODE] * count
    for c in ("depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"):
        out[c] = nodes[c].tolist()
    out["parent_conv_id"] = [int(p) if h else None for p, h in zip(parent_conv, has)]
    out["parent"] = parent_node
    if ids is not None:
        # Rows that end at a node come first among its rows and are alike.
        same = np.zeros(len(block.lens), bool)
        same[1:] = (block.lens[1:] == block.lens[:-1]) & (shared[1:] == block.lens[1:])
        heads = np.flatnonzero(~same)
        ended = dict(zip(heads.tolist(), np.diff(np.append(heads, len(block.lens))).tolist()))

        def listed(row: int, depth: int) -> bytes:
            return ",".join(map(str, ids[row:row + ended[row]].tolist())).encode() if block.lens[row] == depth else b""

        out["ends_sha256"] = [hashlib.sha256(listed(r, d)).hexdigest() for r, d in zip(nodes["first"].tolist(), out["depth"])]
    else:
        # Nodes that go on in other blocks are named, for the children that wait for them.
        by_row = {r: node_names(block.path(r)) for r in set(nodes["first"].tolist())}
        out["node"] = [by_row[r][d] for r, d in zip(nodes["first"].tolist(), out["depth"])]
    tables = [pa.Table.from_pydict(out, _ARROW)]
    if last:
        return tables[0]
    more: dict[str, list] = {f.name: [] for f in _ARROW}

    def add(**values) -> None:
        for name in more:
            more[name].append(values.get(name))

    for edge, row in zip(edges, (0, len(block.lens) - 1)):
        if edge is edges[1] and block.path(0).startswith(block.path(row)):
            continue  # the first edge has all its nodes
        add(kind=EDGE, path=block.path(row), words=block.words[block.off[row]:block.off[row + 1]].tolist(), **{c: edge[c].tolist() for c in _SUMS})
    if ids is not None:
        for f in found:
            for g in np.flatnonzero(~f["closed"]):
                row, depth = int(f["first"][g]), int(f["depth"][g])
                if block.lens[row] == depth:
                    add(kind=ENDS, node=names[0 if row == 0 else 1][depth], conv_id=int(ids[row]), ids=listed(row, depth))
    tables.append(pa.Table.from_pydict(more, _ARROW))
    return pa.concat_tables(tables)


def _block_of(part: pa.Table) -> tuple[Block, np.ndarray | None]:
    lens = np.array([len(x) // 16 for x in part["path"].to_pylist()], np.int64)
    off = np.concatenate([[0], np.cumsum(lens)])
    digests = np.frombuffer(b"".join(part["path"].to_pylist()), np.uint64).reshape(-1, 2)
    words = part["words"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    rows = np.arange(len(lens))
    if "conv_id" in part.column_names:
        ids = part["conv_id"].to_numpy()
        zero = np.zeros(len(lens), np.int64)
        return Block(lens, off, digests, words, {"row": rows, "depth": lens, "n": zero + 1, "least": ids, "children": zero, "leaves": zero, "saved": zero}), ids
    sums = {c: part[c].combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in _SUMS}
    row = np.repeat(rows, lens + 1)
    depth = np.arange(len(row)) - np.repeat(off[:-1] + rows, lens + 1)
    some = (sums["n"] > 0) | (sums["children"] > 0)
    return Block(lens, off, digests, words, {"row": row[some], "depth": depth[some], **{c: v[some] for c, v in sums.items()}}), None


def _peeled(rows: DataFrame, block: int, last: bool) -> DataFrame:
    """Peel sorted rows block by block. The last round's rows are one block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def give() -> Iterator[pa.RecordBatch]:
            part = pa.Table.from_batches(held)
            held.clear()
            own, ids = _block_of(part)
            yield from peel(own, last, ids).to_batches(8192)

        for batch in batches:
            while batch.num_rows:
                take = batch.num_rows if last else min(batch.num_rows, block - size)
                held.append(batch.slice(0, take))
                size, batch = size + take, batch.slice(take)
                if not last and size >= block:
                    yield from give()
                    size = 0
        if held:
            yield from give()

    return rows.mapInArrow(run, _SCHEMA)


def _digests(chunks: DataFrame) -> DataFrame:
    """(node, ends_sha256): the hash of a node's chunks of ids, in order, as a stream."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, running = None, None
        for batch in batches:
            done = []
            for node, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if node != key:
                    if key is not None:
                        done.append((key, running.hexdigest()))
                    key, running = node, hashlib.sha256(ids)
                else:
                    running.update(b"," + ids)
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())], ["node", "ends_sha256"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([running.hexdigest()])], ["node", "ends_sha256"])

    return chunks.repartition("node").sortWithinPartitions("node", "conv_id").select("node", "ids").mapInArrow(run, "node binary, ends_sha256 string")


def prefix_trie(own: DataFrame, block: int = 8192) -> DataFrame:
    """One row per node of the trie of ``own`` (conv_id, turns): conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens and ends_sha256, as sums over its subtree where they are. ``block``: rows peeled together."""
    path = F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), ""))
    rows = own.select("conv_id", path.alias("path"), F.transform("turns", lambda t: t["words"]).alias("words"))
    rows = rows.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    rounds = [written(_peeled(rows, block, False), "peeled")]
    while edges := rounds[-1].where(F.col("kind") == EDGE).count():
        rest = rounds[-1].where(F.col("kind") == EDGE).select("path", "words", *_SUMS)
        last = edges <= block
        rest = rest.repartition(1).sortWithinPartitions("path") if last else rest.repartitionByRange("path").sortWithinPartitions("path")
        rounds.append(written(_peeled(rest, block, last), "peeled"))
        if last:
            break
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    nodes = [r.where(F.col("kind") == NODE) for r in rounds]
    ends = _digests(rounds[0].where(F.col("kind") == ENDS)).withColumnRenamed("ends_sha256", "listed")
    later = nodes[0].limit(0)
    for r in nodes[1:]:
        later = later.unionByName(r)
    later = later.join(ends, "node", "left").withColumn("ends_sha256", F.coalesce("listed", F.sha2(F.lit(""), 256)))
    later = written(later.select("node", "parent", *columns), "upper")
    every = nodes[0].select("parent", *columns).unionByName(later.select("parent", *columns))
    named = later.select(F.col("node").alias("parent"), F.col("conv_id").alias("found"))
    loose = every.where("parent is not null").join(named, "parent").withColumn("parent_conv_id", F.col("found"))
    return every.where("parent is null").select(columns).unionByName(loose.select(columns))
