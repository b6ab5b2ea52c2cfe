"""Repeated windows: which runs of ``width`` symbols of a sequence also start anywhere else in the corpus.

A symbol is a byte or a word (as a 64-bit code). The windows that start in a document are told apart by their anchor, the least
of the ``seed``-symbol hashes inside; equal windows have equal anchors at equal distances, so anchors cut a document in *segments* of
window starts that need to be compared only with segments of the same anchor hash. That is about two rows per window width instead
of one per symbol, and a segment whose anchor hash is unique in the corpus is done.

Where anchor hashes repeat, order and equality are found from coarse to fine. A segment, then each block of window starts in it, then
each single window has two keys: ``core``, the hash of what all its windows have in common, and ``whole``, of all they cover.

* equal ``whole``: every window in it starts elsewhere too; the first of the class stands for it from here on
* ``core`` in one class only: nothing in it starts elsewhere
* else the class is cut finer

Every test is a count by key, combined before it is shuffled, so a passage in a third of all documents is no hot group: its
copies collapse into one row each time. Rows of a class are never gathered. Keys are 128 bits.

The result is one row per run of windows: row key, first and last window start, and the earliest place with the same content
(row key and start; null where the row itself is the earliest).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from georeport.llm import textops as T
from georeport.operators.common import written

_U = np.uint64
#: A piece of the corpus as symbols: codes, and the first symbol of each row.
Symbols = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
SEGMENT = "doc long, twin long, start int, lo int, hi int, core long, whole1 long, whole2 long"
CODE_BITS = 32


@dataclass(frozen=True)
class Settings:
    """``blocks``: numbers of window starts per block, from coarse to fine; the last step are single windows."""

    width: int
    seed: int
    blocks: tuple[int, ...]


def segments(codes: np.ndarray, off: np.ndarray, s: Settings) -> tuple[np.ndarray, ...]:
    """Row, anchor, first and last window start of each segment, as places in ``codes``."""
    n, span = len(codes), s.width - s.seed + 1
    starts = n - s.width + 1
    if starts <= 0:
        return (np.zeros(0, np.int64),) * 4
    at = np.arange(n - s.seed + 1)
    seeds = T.Rolling(codes).of(at, at + s.seed)
    # Least hash first, then the place: the left-most of equal hashes.
    rank = ((seeds >> _U(64 - CODE_BITS)) << _U(64 - CODE_BITS)) | at.astype(_U)
    # Sliding minimum by blocks: running minima from both sides of each block.
    full = -(-len(rank) // span) * span
    padded = np.full(full, np.iinfo(np.uint64).max, _U)
    padded[:len(rank)] = rank
    grid = padded.reshape(-1, span)
    left = np.minimum.accumulate(grid, 1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    least = np.minimum(right[:starts], left[span - 1:span - 1 + starts])
    anchor = (least & _U((1 << (64 - CODE_BITS)) - 1)).astype(np.int64)
    row = np.searchsorted(off, np.arange(starts), "right") - 1
    inside = np.arange(starts) + s.width <= off[row + 1]
    new = np.ones(starts, bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]) | ~inside[:-1]
    first = np.flatnonzero(new & inside)
    stop = np.flatnonzero(np.concatenate([new | ~inside, [True]]))
    last = stop[np.searchsorted(stop, first + 1)] - 1
    return row[first], anchor[first], first, last


class Hashes:
    """128-bit keys of slices."""

    def __init__(self, codes: np.ndarray):
        self.one, self.two = T.Rolling(codes, 0), T.Rolling(codes, 1)

    def __call__(self, start: np.ndarray, end: np.ndarray, salt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        with np.errstate(over="ignore"):
            more = salt.astype(_U) * _U(0x9E3779B97F4A7C15)
            return T.mix(self.one.of(start, end) ^ more), T.mix(self.two.of(start, end) + more)


def _corpus(batch: pa.RecordBatch, symbols: Symbols, column: str = "text", size: int = T.PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    buf, off = T.utf8(batch[column])
    for a, b in T.pieces(off, size):
        codes, first = symbols(buf[off[a]:off[b]], off[a:b + 1] - off[a])
        yield a, b, codes, first


def first_level(rows: DataFrame, symbols: Symbols, s: Settings) -> DataFrame:
    """All segments of all rows (doc, twin, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, twin = (batch[c].to_numpy(zero_copy_only=False) for c in ("doc", "twin"))
            for a, _, codes, off in _corpus(batch, symbols):
                row, anchor, lo, hi = segments(codes, off, s)
                if not len(row):
                    continue
                hashes = Hashes(codes)
                core = hashes(anchor, anchor + s.seed, np.zeros(len(row)))[0]
                w1, w2 = hashes(lo, hi + s.width, (anchor - lo) * 65536 + (hi - lo))
                base = off[row]
                yield pa.RecordBatch.from_arrays([pa.array(doc[a + row]), pa.array(twin[a + row]), *(pa.array((x - base).astype(np.int32)) for x in (anchor, lo, hi)),
                                                  *(pa.array(T.signed(x)) for x in (core, w1, w2))], ["doc", "twin", "start", "lo", "hi", "core", "whole1", "whole2"])

    return rows.mapInArrow(run, SEGMENT)


def finer(rows: DataFrame, symbols: Symbols, s: Settings, block: int) -> DataFrame:
    """The parts of open segments (doc, twin, text, open: array of start, lo, hi): blocks of ``block`` window starts, counted from the anchor."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, twin = (batch[c].to_numpy(zero_copy_only=False) for c in ("doc", "twin"))
            opened = batch["open"]
            items, ends = opened.flatten(), np.concatenate([[0], np.cumsum(opened.value_lengths().to_numpy(zero_copy_only=False))])
            start, lo, hi = (items.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
            for a, b, codes, off in _corpus(batch, symbols):
                hashes = Hashes(codes)
                row = np.repeat(np.arange(a, b), np.diff(ends[a:b + 1]))
                own = slice(ends[a], ends[b])
                base = off[row - a]
                anchor, first, last = start[own] + base, lo[own] + base, hi[own] + base
                # Distances from window start to anchor fall as starts rise.
                low, high = (anchor - last) // block, (anchor - first) // block
                n = high - low + 1
                which = np.repeat(np.arange(len(n)), n)
                number = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + low[which]
                anchor, row = anchor[which], row[which]
                part_lo = np.maximum(first[which], anchor - (number + 1) * block + 1)
                part_hi = np.minimum(last[which], anchor - number * block)
                if block > 1:
                    core = hashes(anchor - number * block, anchor - (number + 1) * block + 1 + s.width, number + 1)[0]
                    w1, w2 = hashes(part_lo, part_hi + s.width, (anchor - part_lo) * 65536 + (part_hi - part_lo))
                else:
                    w1, w2 = hashes(part_lo, part_lo + s.width, anchor - part_lo)
                    core = w1
                base = off[row - a]
                for i in range(0, len(row), 1 << 16):
                    j = slice(i, i + (1 << 16))
                    yield pa.RecordBatch.from_arrays([pa.array(doc[row[j]]), pa.array(twin[row[j]]), *(pa.array((x[j] - base[j]).astype(np.int32)) for x in (anchor, part_lo, part_hi)),
                                                      *(pa.array(T.signed(x[j])) for x in (core, w1, w2))], ["doc", "twin", "start", "lo", "hi", "core", "whole1", "whole2"])

    return rows.mapInArrow(run, SEGMENT)


def _place() -> Column:
    return F.struct("doc", "twin", "lo", "start", "hi")


def level(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(found, open): windows with another place, and the first of each class that has to be cut finer."""
    # Counts are written first: a join of tables is dealt by itself, so adaptive execution can split a frequent core.
    repeated = written(items.groupBy("core").agg(F.count("*").alias("n")).where("n > 1").select("core"), "repeated")
    busy = written(items.join(repeated, "core"), "busy")
    each = written(busy.groupBy("core", "whole1", "whole2").agg(F.min(_place()).alias("first"), F.count("*").alias("n")), "classes")
    members = busy.join(each.where("n > 1").select("core", "whole1", "whole2", "first"), ["core", "whole1", "whole2"])
    is_first = _place() == F.col("first")
    found = members.select("doc", "twin", "lo", "hi", *(F.when(~is_first, F.col(f"first.{c}")).alias(f"from_{c}") for c in ("doc", "twin", "lo")))
    several = written(each.groupBy("core").agg(F.count("*").alias("k")).where("k > 1").select("core"), "several")
    return found, each.join(several, "core").select("first.*")


def repeated_windows(docs: DataFrame, symbols: Symbols, s: Settings, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, twin, lo, hi, from_doc, from_twin, from_lo): see the module.

    ``doc`` and ``twin`` tell rows apart: see ``keyed``.
    """
    rows = keyed(docs, doc_id, text)
    found, open_ = level(written(first_level(rows, symbols, s), "segments"))
    out, at_hand = found, None
    for block in (*s.blocks, 1):
        per_row = open_.groupBy(F.col("doc").alias("d"), F.col("twin").alias("t")).agg(F.collect_list(F.struct("start", "lo", "hi")).alias("open"))
        source = rows if at_hand is None else at_hand
        mine = source.join(per_row, (source["doc"] == per_row["d"]) & (source["twin"] == per_row["t"])).select("doc", "twin", "text", "open")
        if s.blocks and at_hand is None:  # finer steps need no other rows
            mine = at_hand = written(mine, "open")
            at_hand = at_hand.select("doc", "twin", "text")
        found, open_ = level(written(finer(mine, symbols, s, block), "parts"))
        out = out.unionByName(found)
    return out


NO_ID = -(1 << 63)


def keyed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, twin, text): id, with the least long for null, and hash of the text. Rows equal in both count as copies of each other."""
    return docs.select(F.coalesce(docs[doc_id].cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(docs[text]).alias("twin"), docs[text].alias("text"))


def with_runs(docs: DataFrame, found: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, runs): every row with its array of (lo, hi, from_doc, from_twin, from_lo), null if it has none. A row's runs are bounded by its text."""
    runs = found.groupBy(F.col("doc").alias("d"), F.col("twin").alias("t")).agg(F.collect_list(F.struct("lo", "hi", "from_doc", "from_twin", "from_lo")).alias("runs"))
    rows = keyed(docs, doc_id, text)
    return rows.join(runs, (rows["doc"] == runs["d"]) & (rows["twin"] == runs["t"]), "left").select(F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id"), "text", "runs")


def covered(lo: np.ndarray, hi: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n symbols lie in a window that starts from lo to hi."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, lo, 1)
    np.add.at(change, hi + width, -1)
    return np.cumsum(change[:-1]) > 0


def row_runs(column: pa.Array) -> Iterator[tuple[np.ndarray, ...]]:
    """Per row the arrays lo, hi, from_doc, from_twin, from_lo, and where they are from another place."""
    items = column.flatten()
    n = np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
    known = items.field(2).is_valid().to_numpy(zero_copy_only=False)
    parts = [items.field(i).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5)]
    for a, b in zip(n[:-1], n[1:]):
        yield (*(x[a:b] for x in parts), known[a:b])
