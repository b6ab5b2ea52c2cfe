"""Language-model scores by partial matching: byte contexts, escape estimation, symbol exclusion.

A text is its UTF-8 bytes and an end symbol (0xFF, which UTF-8 never holds), led in by ``order`` bytes 0xFE. The trie of contexts of
every length up to ``order`` follows from one count over the whole training corpus: how often each run of ``order + 1`` bytes occurs. A byte that
its longest context has not seen costs an escape (distinct successors / (all successors + distinct ones)), is tried in the next
shorter context without the bytes excluded so far, and in the end among all bytes that are left, with equal chances.

The trie grows with the corpus, so nothing whole is sent around. Scoring tasks read the most frequent runs and words (a bounded table), which are
most of any text; the rest of a text's runs and words are rows that meet the whole tables in a shuffled join, and as all of them are rare, no key is hot for
being common. Runs that training has not seen go through the trie in shards, cut by the two bytes nearest to the predicted one: everything that a
prediction asks of contexts of two bytes or more is in one shard, whose size is bounded; each distinct run is worked out once. Contexts
of one and no byte are a table of 256 x 256 counts.

``train`` counts, ``scores`` gives each document's pretrained log probability and a word-unigram one, ``adaptive_bits`` the code length of
each document by a model that starts empty and learns from that document alone.

Null and empty texts are an end alone. Rows are scored one by one, so null and repeated ids and repeated rows are like any others. With nothing
to learn from, all bytes are equally likely. Other columns are ignored unless named in ``keep``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from georeport.llm import textops as T
from georeport.operators.common import scratch_path, written

LEAD, END = 0xFE, 0xFF
CHUNK = 1 << 20
_U = np.uint64
_GRAMS, _WORDS, _TEXTS = 0, 1, 2


@dataclass(frozen=True)
class Settings:
    """``order``: bytes of context, 2 to 6. ``hot``: entries at most of the tables that scoring tasks hold. ``shard``: entries of a shard of the trie;
    one is larger only if one pair of bytes has more, which 256 ** (order - 1) bounds."""

    order: int = 4
    hot: int = 1_000_000
    shard: int = 4_000_000


@dataclass(frozen=True)
class Model:
    """Tables of runs (key, n, log_p, shard) and words (key, n), folders of their frequent part, contexts of one byte, and the unigram totals."""

    settings: Settings
    runs: DataFrame
    words: DataFrame
    hot_runs: str
    hot_words: str
    shards: str
    one: np.ndarray
    texts: int
    tokens: int
    distinct: int

    @property
    def whole(self) -> int:
        return self.tokens + self.distinct + 1


def held_out(doc_id: Column) -> Column:
    """Rows that are not learned from: crc32 of the id as text leaves 2 when divided by 7. A null id is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def gram_chunks(buf: np.ndarray, off: np.ndarray, order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Runs of order + 1 bytes as numbers with the row they belong to, about CHUNK of them at a time, in the order of the texts."""
    for a, b in T.pieces(off, CHUNK):
        lens = off[a + 1:b + 1] - off[a:b]
        led = np.full(off[b] - off[a] + (b - a) * (order + 1), LEAD, np.uint8)
        ends = np.cumsum(lens + order + 1)
        led[np.arange(off[b] - off[a]) + np.repeat(np.arange(b - a) * (order + 1) + order, lens)] = buf[off[a]:off[b]]
        led[ends - 1] = END
        for lo in range(order, len(led), CHUNK):
            hi = min(lo + CHUNK, len(led))
            code = np.zeros(hi - lo, _U)
            for k in range(order, -1, -1):
                code = (code << _U(8)) | led[lo - k:hi - k]
            row = np.searchsorted(ends, np.arange(lo, hi), "right")
            own = np.arange(lo, hi) - (ends - lens - order - 1)[row] >= order
            yield code[own], row[own] + a


class Tally:
    """Counts by key, merged as they come and given out when they are many."""

    def __init__(self, most: int = 1 << 20):
        self.most, self.keys, self.counts, self.size = most, [], [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys.append(keys)
        self.counts.append(counts)
        self.size += len(keys)

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.keys:
            return np.zeros(0, _U), np.zeros(0, np.int64)
        keys, at = np.unique(np.concatenate(self.keys), return_inverse=True)
        return keys, np.bincount(at, np.concatenate(self.counts).astype(float), len(keys)).astype(np.int64)

    def full(self, last: bool = False) -> tuple[np.ndarray, np.ndarray] | None:
        """What is to be given out now."""
        if not last and self.size < 2 * self.most:
            return None
        keys, counts = self.merged()
        out = keys, counts
        self.keys, self.counts, self.size = [], [], 0
        if not last and len(keys) < self.most:
            self.add(keys, counts)
            return None
        return out


def word_table(buf: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """Hashes of lower-cased words and the first word of each row, for row ranges (a, b)."""
    for a, b in T.pieces(off):
        part = T.LOWER[buf[off[a]:off[b]]]
        starts, ends, first = T.word_spans(part, off[a:b + 1] - off[a])
        yield (T.word_hashes(part, starts, ends) if len(starts) else np.zeros(0, _U)), first, a, b


def counts(docs: DataFrame, order: int, text: str = "text") -> DataFrame:
    """(kind, key, n) over all texts: byte runs, words, and the number of texts."""
    def rows(kind: int, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(T.signed(keys)), pa.array(n)], ["kind", "key", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, texts = {_GRAMS: Tally(), _WORDS: Tally()}, 0
        for batch in batches:
            texts += batch.num_rows
            buf, off = T.utf8(batch.column(0))
            for code, _ in gram_chunks(buf, off, order):
                kinds[_GRAMS].add(*np.unique(code, return_counts=True))
            for words, _, _, _ in word_table(buf, off):
                kinds[_WORDS].add(*np.unique(words, return_counts=True))
            for kind, tally in kinds.items():
                if (out := tally.full()) is not None:
                    yield rows(kind, *out)
        for kind, tally in kinds.items():
            yield rows(kind, *tally.full(last=True))
        yield rows(_TEXTS, np.zeros(1, _U), np.array([texts], np.int64))

    each = docs.select(docs[text].alias("text")).mapInArrow(run, "kind int, key long, n long")
    return each.groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _shard(shards: str, key: Column) -> Column:
    """Shard of a run; ``shards`` lists that of each pair of bytes."""
    return F.get(F.split(F.lit(shards), ",").cast("array<int>"), F.shiftright(key, 8).bitwiseAND(0xFFFF).cast("int"))


def _hot(table: DataFrame, value: str, most: int, name: str) -> str:
    """Folder with the entries from some power of two of occurrences on, at most ``most``."""
    sizes = dict(table.groupBy(F.floor(F.log2("n")).cast("int").alias("e")).agg(F.count("*").alias("k")).collect())
    least, size = 64, 0
    while least > 0 and size + sizes.get(least - 1, 0) <= most:
        least -= 1
        size += sizes.get(least, 0)
    path = scratch_path(table.sparkSession, name)
    table.where(F.floor(F.log2("n")) >= least).select("key", F.col(value).cast("double").alias("value")).repartition(1).write.parquet(path)
    return path


def train(docs: DataFrame, settings: Settings = Settings(), text: str = "text") -> Model:
    """Learn from all rows. Only tables of at most 65,536 rows come to the driver."""
    found = written(counts(docs, settings.order, text), "counts")
    grams, words = found.where(F.col("kind") == _GRAMS), found.where(F.col("kind") == _WORDS).select("key", "n")
    pair = F.shiftright("key", 8).bitwiseAND(0xFFFF).cast("int")
    sizes = np.zeros(1 << 16, np.int64)
    for r in grams.groupBy(pair.alias("pair")).agg(F.count("*").alias("n")).collect():
        sizes[r["pair"]] = r["n"]
    shard_of, shard, size = [], 0, 0
    for n in sizes.tolist():
        if size and size + n > settings.shard:
            shard, size = shard + 1, 0
        shard_of.append(shard)
        size += n
    one = np.zeros((256, 256), np.int64)
    for r in grams.groupBy(F.col("key").bitwiseAND(0xFFFF).cast("int").alias("two")).agg(F.sum("n").alias("n")).collect():
        one[r["two"] >> 8, r["two"] & 255] = r["n"]
    # A context has at most 256 successors.
    w = W.partitionBy(F.shiftright("key", 8))
    shards = ",".join(map(str, shard_of))
    runs = written(grams.select("key", "n", F.log10(F.col("n") / (F.sum("n").over(w) + F.count("*").over(w))).alias("log_p"), _shard(shards, F.col("key")).alias("shard")), "runs")
    total = words.agg(F.count("*").alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    texts = found.where(F.col("kind") == _TEXTS).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return Model(settings, runs, words, _hot(runs, "log_p", settings.hot, "hot-runs"), _hot(words, "n", settings.hot, "hot-words"), shards, one, texts,
                 total["n"] + texts, total["v"] + (texts > 0))


class Lookup:
    """Values by 64-bit key, for arrays of keys."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.shift = _U(64 - max(1, (2 * len(keys)).bit_length()))
        order = np.argsort(self._slot(keys), kind="stable")
        self.keys, self.values = keys[order], values[order]
        self.first = np.searchsorted(self._slot(self.keys), np.arange((1 << int(_U(64) - self.shift)) + 1, dtype=_U))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (keys * _U(0x9E3779B97F4A7C15)) >> self.shift

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, NaN where there is none."""
        out = np.full(len(keys), np.nan)
        if not len(self.keys):
            return out
        slot = self._slot(keys)
        at, stop = self.first[slot], self.first[slot + _U(1)]
        open_ = np.flatnonzero(at < stop)
        at, stop = at[open_], stop[open_]
        while len(open_):
            hit = self.keys[at] == keys[open_]
            out[open_[hit]] = self.values[at[hit]]
            rest = ~hit & (at + 1 < stop)
            open_, at, stop = open_[rest], at[rest] + 1, stop[rest]
        return out


class Level:
    """Contexts of one length: successors and their counts, by context."""

    def __init__(self, keys: np.ndarray, n: np.ndarray):
        self.symbols, self.n = (keys & _U(255)).astype(np.int64), n
        self.contexts, self.start = np.unique(keys >> _U(8), return_index=True)
        self.stop = np.append(self.start[1:], len(keys))

    def successors(self, contexts: np.ndarray) -> np.ndarray:
        """Counts of the 256 symbols after each context."""
        out = np.zeros((len(contexts), 256))
        if not len(self.contexts):
            return out
        at = np.minimum(np.searchsorted(self.contexts, contexts), len(self.contexts) - 1)
        there = np.flatnonzero(self.contexts[at] == contexts)
        at = at[there]
        size = self.stop[at] - self.start[at]
        entry = np.arange(size.sum()) + np.repeat(self.start[at] - np.cumsum(size) + size, size)
        out[np.repeat(there, size), self.symbols[entry]] = self.n[entry]
        return out


class Trie:
    """Contexts of two bytes or more of one shard, and those of one and no byte."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, order: int, one: np.ndarray):
        at = np.argsort(keys)
        keys, n = keys[at], n[at]
        self.order, self.one, self.levels = order, one, {}
        for k in range(order, 1, -1):
            cut = keys & _U((1 << 8 * (k + 1)) - 1)
            own, where = np.unique(cut, return_inverse=True)
            self.levels[k] = Level(own, np.bincount(where, n, len(own)))
        top = self.levels[order]
        size = top.stop - top.start
        total = np.repeat(np.add.reduceat(n, top.start) if len(n) else np.zeros(0), size)
        self.seen = Lookup(keys, np.log10(n / (total + np.repeat(size, size))) if len(n) else np.zeros(0))

    def log_p(self, codes: np.ndarray) -> np.ndarray:
        out = self.seen.get(codes)
        missing = np.flatnonzero(np.isnan(out))
        if len(missing):
            unseen, where = np.unique(codes[missing], return_inverse=True)
            found = np.concatenate([self._escaped(unseen[i:i + 8192]) for i in range(0, len(unseen), 8192)])
            out[missing] = found[where]
        return out

    def _escaped(self, codes: np.ndarray) -> np.ndarray:
        """From the longest context down, with exclusion of what longer contexts have offered."""
        symbol, context, rows = (codes & _U(255)).astype(np.int64), codes >> _U(8), np.arange(len(codes))
        out, todo, excluded = np.zeros(len(codes)), np.ones(len(codes), bool), np.zeros((len(codes), 256), bool)
        for k in range(self.order, -1, -1):
            if k > 1:
                n = self.levels[k].successors(context & _U((1 << 8 * k) - 1))
            else:
                n = self.one[(context & _U(255)).astype(np.int64)].astype(float) if k else np.broadcast_to(self.one.sum(0).astype(float), excluded.shape)
            n = np.where(excluded, 0.0, n)
            total, distinct, own = n.sum(1), (n > 0).sum(1), n[rows, symbol]
            whole = np.maximum(total + distinct, 1)
            out += np.where(todo & (total > 0), np.log10(np.where(own > 0, own, distinct).clip(1) / whole), 0.0)
            todo &= own == 0
            excluded |= n > 0
        left = 255 - np.delete(excluded, LEAD, 1).sum(1)
        return out - np.where(todo, np.log10(np.maximum(left, 1)), 0.0)


@lru_cache(maxsize=2)
def _table(path: str) -> Lookup:
    files, where = pafs.FileSystem.from_uri(path) if ":" in path else (pafs.LocalFileSystem(), path)
    got = pq.read_table(where, filesystem=files, columns=["key", "value"], partitioning=None)
    return Lookup(got["key"].to_numpy().view(_U), got["value"].to_numpy())


class Rest:
    """Keys that a table does not have, per row, with how often each occurs."""

    def __init__(self):
        self.rows, self.keys, self.counts = [], [], []

    def add(self, row: np.ndarray, keys: np.ndarray) -> None:
        if len(keys):
            order = np.lexsort((keys, row))
            row, keys = row[order], keys[order]
            first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (keys[1:] != keys[:-1])))
            self.rows.append(row[first])
            self.keys.append(keys[first])
            self.counts.append(np.diff(np.append(first, len(keys))))

    def lists(self, n: int) -> pa.Array:
        row, keys, counts = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (self.rows, self.keys, self.counts))
        order = np.argsort(row, kind="stable")
        items = pa.StructArray.from_arrays([pa.array(T.signed(keys.astype(_U)[order])), pa.array(counts[order].astype(np.int64))], ["key", "k"])
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(row[order], np.arange(n + 1)), pa.int32()), items)


def _known(hot_runs: str, hot_words: str, order: int, whole: int, buf: np.ndarray, off: np.ndarray) -> list[pa.Array]:
    """Of each text: words, those found, the sums over words and runs found, and the words and runs that are not."""
    rows, runs, words = len(off) - 1, _table(hot_runs), _table(hot_words)
    n, found, base, score, rest = np.zeros(rows, np.int64), np.zeros(rows, np.int64), np.zeros(rows), np.zeros(rows), (Rest(), Rest())
    for keys, first, a, b in word_table(buf, off):
        row = np.repeat(np.arange(a, b), np.diff(first))
        c = words.get(keys)
        have = ~np.isnan(c)
        n += np.bincount(row, minlength=rows)
        found += np.bincount(row[have], minlength=rows)
        base += np.bincount(row[have], np.log10((c[have] + 1) / whole), rows)
        rest[0].add(row[~have], keys[~have])
    for keys, row in gram_chunks(buf, off, order):
        log_p = runs.get(keys)
        have = ~np.isnan(log_p)
        score += np.bincount(row[have], log_p[have], rows)
        rest[1].add(row[~have], keys[~have])
    return [pa.array(n), pa.array(found), pa.array(base), pa.array(score), *(r.lists(rows) for r in rest)]


def unseen(keys: DataFrame, model: Model) -> DataFrame:
    """(key, log_p) of distinct runs that training has not seen, shard by shard of the trie."""
    order, one = model.settings.order, model.one
    asked = keys.select(_shard(model.shards, F.col("key")).alias("shard"), F.lit(1).alias("kind"), "key", F.lit(0).cast("long").alias("n"))
    both = model.runs.select("shard", F.lit(0).alias("kind"), "key", "n").unionByName(asked).repartition("shard").sortWithinPartitions("shard", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held, trie = None, [], None
        for batch in batches:
            shard, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero(np.append(True, (shard[1:] != shard[:-1]) | (kind[1:] != kind[:-1])))
            for a, b in zip(cuts, np.append(cuts[1:], len(shard))):
                key, n = batch.column(2).slice(a, b - a).to_numpy().view(_U), batch.column(3).slice(a, b - a).to_numpy()
                if shard[a] != own:
                    own, held, trie = shard[a], [], None
                if kind[a] == 0:
                    held.append((key, n.astype(float)))
                    continue
                if trie is None:
                    parts = held or [(np.zeros(0, _U), np.zeros(0))]
                    trie, held = Trie(*(np.concatenate(x) for x in zip(*parts)), order, one), []
                yield pa.RecordBatch.from_arrays([pa.array(T.signed(key)), pa.array(trie.log_p(key))], ["key", "log_p"])

    return both.mapInArrow(run, "key long, log_p double")


def scores(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The columns of ``keep``, n_tokens, n_known, train_tokens, base_score, score: tokens (an end counts as one), those that training has, all of
    training, and log10 probabilities by word counts and by the trie."""
    hot_runs, hot_words, order, whole = model.hot_runs, model.hot_words, model.settings.order, model.whole
    names = [*keep, "__words", "__found", "__base", "__score", "__rest_words", "__rest_runs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                part = batch.slice(a, 2048)
                yield pa.RecordBatch.from_arrays([*part.columns[:len(keep)], *_known(hot_runs, hot_words, order, whole, *T.utf8(part.column(len(keep))))], names)

    own = docs.select(*keep, docs[text].alias("__text"))
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in own.schema.fields[:-1])
    rest = "array<struct<key:long,k:long>>"
    part = own.mapInArrow(run, f"{kept}__words long, __found long, __base double, __score double, __rest_words {rest}, __rest_runs {rest}")
    part = written(part.withColumn("__row", F.monotonically_increasing_id()), "partial")

    def left(column: str) -> DataFrame:
        return part.select("__row", F.explode(column).alias("x")).select("__row", "x.key", "x.k")

    chance = F.log10((F.coalesce("n", F.lit(0)) + 1) / F.lit(float(whole)))
    words = left("__rest_words").join(model.words, "key", "left").groupBy("__row").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("k")).otherwise(0)).alias("__more"), F.sum(F.col("k") * chance).alias("__more_base"))
    runs = written(left("__rest_runs").join(model.runs.select("key", "log_p"), "key", "left"), "rare-runs")
    new = unseen(runs.where("log_p is null").select("key").distinct(), model)
    every = (runs.where("log_p is not null").select("__row", "k", "log_p")
             .unionByName(runs.where("log_p is null").select("__row", "key", "k").join(new, "key").select("__row", "k", "log_p")))
    runs = every.groupBy("__row").agg(F.sum(F.col("k") * F.col("log_p")).alias("__more_score"))
    end, zero = math.log10((model.texts + 1) / whole), F.lit(0)
    return part.join(words, "__row", "left").join(runs, "__row", "left").select(
        *keep, (F.col("__words") + 1).alias("n_tokens"), (F.col("__found") + F.coalesce("__more", zero) + int(model.texts > 0)).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"), (F.col("__base") + F.coalesce("__more_base", F.lit(0.0)) + end).alias("base_score"),
        (F.col("__score") + F.coalesce("__more_score", F.lit(0.0))).alias("score"))


def adaptive_length(data: bytes, order: int) -> float:
    """Bits for a text and its end, by a model that starts empty and learns each byte after it is coded."""
    trie: dict[bytes, dict[int, int]] = {}
    led, bits = bytes([LEAD]) * order + data + bytes([END]), 0.0
    for at in range(order, len(led)):
        symbol, excluded = led[at], set()
        for k in range(order, -1, -1):
            n = {s: c for s, c in trie.get(led[at - k:at], {}).items() if s not in excluded}
            if not n:
                continue
            whole = sum(n.values()) + len(n)
            bits -= math.log2(n.get(symbol, len(n)) / whole)
            if symbol in n:
                break
            excluded |= n.keys()
        else:
            bits += math.log2(max(255 - len(excluded), 1))
        for k in range(order + 1):
            after = trie.setdefault(led[at - k:at], {})
            after[symbol] = after.get(symbol, 0) + 1
    return bits


def adaptive_bits(docs: DataFrame, order: int = 4, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The columns of ``keep``, n_bytes and adaptive_bits: how far each text tells itself, e.g. to find repetitive ones."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(x or "").encode() for x in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(keep)], pa.array([len(x) for x in texts], pa.int64()), pa.array([adaptive_length(x, order) for x in texts], pa.float64())],
                [*keep, "n_bytes", "adaptive_bits"])

    own = docs.select(*keep, docs[text].alias("__text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields[:-1])
    return own.mapInArrow(run, f"{kept}, n_bytes long, adaptive_bits double")
