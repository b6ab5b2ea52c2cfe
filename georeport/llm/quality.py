"""Quality classifier: hashed word n-gram logistic regression, trained with follow-the-regularised-leader.

Tokens are runs of letters, of digits, and of other marks. Features are hashes of token unigrams and bigrams
and of their shapes (class, case, "same as the token before"), so invented words still say something. The
model is one weight per hash slot; a score is a sparse dot product over the whole text, in one pass, no shuffle.

Training takes at most ``max_rows`` labelled rows, chosen by the hash of their id (a documented bound);
scoring takes every row. Labels, language, source and id are never inputs of a score.

Null and empty texts score with the bias alone. Rows without a label, or with null labels, don't train. With
no usable label all scores are 0.5. Repeated rows get the same score each. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from georeport.llm import textops as T

_U = np.uint64
OTHER, DIGIT, LETTER = 0, 1, 2


@dataclass(frozen=True)
class Settings:
    """Slots is a power of two; alpha, beta, l1, l2 are those of the per-coordinate update."""

    slots: int = 1 << 18
    max_rows: int = 4096
    epochs: int = 3
    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 0.002
    l2: float = 0.02
    batch: int = 32


def _classes() -> np.ndarray:
    table = np.full(256, OTHER, np.int8)
    table[48:58] = DIGIT
    table[65:91] = table[97:123] = LETTER
    table[128:] = LETTER
    return table


CLASS = _classes()


def features(buf: np.ndarray, offsets: np.ndarray, slots: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots of all features, their row, and the number of tokens of each row."""
    space = T.SPACE[buf]
    kind = np.where(space, -1, CLASS[buf]).astype(np.int8)
    first = ~space
    first[1:] &= kind[1:] != kind[:-1]
    at = offsets[:-1][offsets[:-1] < len(buf)]
    first[at] = ~space[at]
    starts = np.flatnonzero(first)
    rows = np.searchsorted(offsets, starts, "right") - 1
    # A token ends where the next begins, or at white space, or with its row.
    stop = np.flatnonzero(np.concatenate([first | space, [True]]))
    ends = stop[np.searchsorted(stop, starts + 1)]
    ends = np.minimum(ends, offsets[rows + 1])
    words = T.word_hashes(buf, starts, ends)
    upper = (buf[starts] >= 65) & (buf[starts] <= 90)
    second = np.minimum(starts + 1, len(buf) - 1)
    shouted = upper & (ends - starts > 1) & (buf[second] >= 65) & (buf[second] <= 90)
    same = np.zeros(len(starts), bool)
    same[1:] = (words[1:] == words[:-1]) & (rows[1:] == rows[:-1])
    shape = kind[starts].astype(_U) * _U(8) + upper.astype(_U) + shouted.astype(_U) * _U(2) + same.astype(_U) * _U(4)
    mask = _U(slots - 1)
    pair = rows[1:] == rows[:-1]

    def pairs(x: np.ndarray, salt: int) -> np.ndarray:
        return T.mix(x[:-1] * _U(0x9E3779B97F4A7C15) + x[1:] + _U(salt))[pair]

    with np.errstate(over="ignore"):
        out = [words, pairs(words, 1), T.mix(shape + _U(1 << 20)), pairs(shape, 1 << 21)]
    where = [rows, rows[1:][pair], rows, rows[1:][pair]]
    counts = np.bincount(rows, minlength=len(offsets) - 1)
    return np.concatenate([(x & mask).astype(np.int32) for x in out]), np.concatenate(where), counts


def _values(rows: np.ndarray, n: int) -> np.ndarray:
    """Each row's features share a length of one."""
    per_row = np.bincount(rows, minlength=n)
    return 1 / np.sqrt(np.maximum(per_row, 1))


def score_texts(column, weights: np.ndarray, bias: float) -> np.ndarray:
    buf, offsets = T.utf8(column)
    out = []
    for a, b in T.pieces(offsets):
        part, off = buf[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
        if len(part):
            slot, row, _ = features(part, off, len(weights))
            z = np.bincount(row, weights[slot], b - a) * _values(row, b - a)
        else:
            z = np.zeros(b - a)
        out.append(1 / (1 + np.exp(-np.clip(z + bias, -35, 35))))
    return np.concatenate(out) if out else np.zeros(0)


def _examples(batches: Iterator[pa.RecordBatch], slots: int) -> Iterator[pa.RecordBatch]:
    """Per row: its distinct slots, their summed values, its label."""
    for batch in batches:
        buf, offsets = T.utf8(batch["text"])
        label = batch["label"].to_numpy(zero_copy_only=False)
        for a, b in T.pieces(offsets):
            part, off = buf[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
            slot, row = features(part, off, slots)[:2] if len(part) else (np.zeros(0, np.int32), np.zeros(0, np.int64))
            key, count = np.unique(row * slots + slot, return_counts=True)
            owner = key // slots
            value = count * _values(row, b - a)[owner]
            ends = np.searchsorted(owner, np.arange(b - a + 1))
            yield pa.RecordBatch.from_arrays([T.lists((key % slots).astype(np.int32), ends), T.lists(value.astype(np.float32), ends),
                                              pa.array(label[a:b].astype(np.int32))], ["slots", "value", "label"])


@dataclass
class Model:
    weights: np.ndarray
    bias: float


def fit(rows: DataFrame, text: Column, label: Column, key: Column, settings: Settings = Settings()) -> Model:
    """Learn from labelled rows; ``key`` orders them by hash and so picks the sample, alike at every size."""
    sample = (rows.select(text.alias("text"), label.cast("int").alias("label"), F.xxhash64(key).alias("at")).where("label in (0, 1)")
              .orderBy("at", "text").limit(settings.max_rows).select("text", "label", "at"))
    slots = settings.slots
    data = (sample.select("text", "label").mapInArrow(lambda it: _examples(it, slots), "slots array<int>, value array<float>, label int")
            .toArrow())
    y = data["label"].to_numpy().astype(np.float64)
    index = data["slots"].combine_chunks()
    value = data["value"].combine_chunks()
    index = index.chunk(0) if isinstance(index, pa.ChunkedArray) and index.num_chunks else index
    value = value.chunk(0) if isinstance(value, pa.ChunkedArray) and value.num_chunks else value
    if not len(y):
        return Model(np.zeros(slots), 0.0)
    off = index.offsets.to_numpy()
    index, value = index.values.to_numpy(), value.values.to_numpy().astype(np.float64)
    z, n = np.zeros(slots + 1), np.zeros(slots + 1)

    def weight(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        return np.where(np.abs(zi) <= settings.l1, 0, -(zi - np.sign(zi) * settings.l1) / ((settings.beta + np.sqrt(n[i])) / settings.alpha + settings.l2))

    order = np.random.default_rng(7)
    for _ in range(settings.epochs):
        turn = order.permutation(len(y))
        for at in range(0, len(turn), settings.batch):
            docs = turn[at:at + settings.batch]
            flat = np.concatenate([np.append(index[off[d]:off[d + 1]], slots) for d in docs])
            x = np.concatenate([np.append(value[off[d]:off[d + 1]], 1.0) for d in docs])
            owner = np.repeat(np.arange(len(docs)), [off[d + 1] - off[d] + 1 for d in docs])
            p = 1 / (1 + np.exp(-np.clip(np.bincount(owner, weight(flat) * x, len(docs)), -35, 35)))
            used, where = np.unique(flat, return_inverse=True)
            g = np.bincount(where, (p - y[docs])[owner] * x, len(used))
            grown = n[used] + g * g
            z[used] += g - (np.sqrt(grown) - np.sqrt(n[used])) / settings.alpha * weight(used)
            n[used] = grown
    w = weight(np.arange(slots + 1))
    return Model(w[:slots].astype(np.float32).astype(np.float64), float(w[slots]))


def score(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",), name: str = "score") -> DataFrame:
    """The columns of ``keep`` and the score, under ``name``, for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: slots * 8 bytes
    fields = docs.select(*keep).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            s = score_texts(batch.column(batch.num_columns - 1), m.weights, m.bias)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(s)], [*batch.schema.names[:-1], name])

    return docs.select(*keep, docs[text].alias("__text")).mapInArrow(run, fields.add(name, "double"))


def held_out(doc_id: Column) -> Column:
    """Rows kept from training: crc32 of the id as text leaves 2 when divided by 4. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train_on_labels(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Fit on ``labels.quality``, without held-out rows. The sample is picked before texts are joined."""
    picked = (labels.select(F.col("doc_id").alias("id"), F.col("quality").cast("int").alias("label"))
              .where(F.col("label").isin(0, 1) & F.col("id").isNotNull() & ~held_out(F.col("id"))).groupBy("id").agg(F.max("label").alias("label"))
              .orderBy(F.xxhash64("id"), "id").limit(settings.max_rows))
    rows = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("t")).join(F.broadcast(picked), "id")  # at most max_rows rows
    return fit(rows, F.col("t"), F.col("label"), F.col("id"), settings)
