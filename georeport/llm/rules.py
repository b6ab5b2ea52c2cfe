"""Quality rules: fixed rules on word statistics, then an isolation forest over the statistics.

``statistics`` makes one pass over whole texts, without a shuffle. Trees split a small sample at random; a row
that few splits set apart is unusual. The score is the usual 2 ** (-mean path / expected path). The threshold comes
from labelled rows: the cut with the least error, where losing a good row weighs more than keeping a bad one.

Null and empty texts have zero words and fail the base rule. Equal rows have equal scores. With no labels, or an empty
table, the method rejects nothing. Other columns are ignored.
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
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_lines")


@dataclass(frozen=True)
class Settings:
    """A fixed number of trees over samples of fixed size, as the method asks; everything else covers all rows."""

    trees: int = 100
    sample: int = 256
    good_weight: float = 4.0
    seed: int = 11


def _symbols() -> np.ndarray:
    table = np.zeros(256, bool)
    table[[ord(c) for c in "#*$%&|<>"]] = True
    return table


SYMBOL = _symbols()


def _repeats(owner: np.ndarray, key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For items of (owner, key): whether the pair occurs more than once, and whether it is not the first."""
    order = np.lexsort((value, key, owner))
    same = (owner[order][1:] == owner[order][:-1]) & (key[order][1:] == key[order][:-1])
    many, later = np.zeros(len(key), bool), np.zeros(len(key), bool)
    later[order[1:]] = same
    many[order[1:]] |= same
    many[order[:-1]] |= same
    return many, later


def count(buf: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of each row of one piece."""
    n = len(off) - 1
    starts, ends, first = T.word_spans(buf, off)
    rows = np.repeat(np.arange(n), np.diff(first))
    char = (buf & 0xC0) != 0x80

    def per_row(flags: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(flags)])[off])

    # Lines: cut at newlines and at row borders; those with a word count.
    newline = np.flatnonzero(buf == 10)
    line_start = np.unique(np.concatenate([off[:-1], newline + 1]))
    line_start = line_start[line_start < len(buf)]
    line_row = np.searchsorted(off, line_start, "right") - 1
    line_end = np.append(line_start[1:], len(buf))
    line_end = np.minimum(line_end, off[line_row + 1])
    line_end = line_end - ((line_end > line_start) & (buf[line_end - 1] == 10))
    worded = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
    line_start, line_end, line_row = line_start[worded], line_end[worded], line_row[worded]
    codes = T.byte_codes()[buf]
    _, later = _repeats(line_row, T.Rolling(codes).of(line_start, line_end), line_start)
    # Three-word windows.
    words = T.Rolling(codes).of(starts, ends)
    full = np.flatnonzero(rows[2:] == rows[:-2]) if len(rows) > 2 else np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        key = T.mix(T.mix(words[full] * _U(3) + words[full + 1]) * _U(5) + words[full + 2])
    many, _ = _repeats(rows[full], key, full)
    hit = np.zeros(len(words) + 2, bool)
    for k in range(3):
        hit[full[many] + k] = True
    return {"n_words": np.diff(first), "word_chars": per_row(char & ~T.SPACE[buf]), "n_symbols": per_row(SYMBOL[buf]),
            "n_dup_lines": np.bincount(line_row[later], minlength=n), "n_repeat_words": np.bincount(rows[hit[:len(rows)]], minlength=n),
            "n_upper": per_row((buf >= 65) & (buf <= 90)), "n_lines": np.bincount(line_row, minlength=n)}


def statistics(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of ``keep`` and the counts, as longs, for every row."""
    fields = docs.select(*keep).schema
    for c in COUNTS:
        fields = fields.add(c, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = T.utf8(batch.column(batch.num_columns - 1))
            for a, b in T.pieces(off):
                part = buf[off[a]:off[b]]
                got = count(part, off[a:b + 1] - off[a]) if len(part) else {c: np.zeros(b - a, np.int64) for c in COUNTS}
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[:-1]), *(pa.array(got[c].astype(np.int64)) for c in COUNTS)],
                                                 [*batch.schema.names[:-1], *COUNTS])

    return docs.select(*keep, docs[text].alias("__text")).mapInArrow(run, fields)


def base_failed() -> Column:
    """Too short, or mostly repeated words."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def inputs() -> list[Column]:
    """Shares that don't depend on length, for the forest."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    lines = F.greatest(F.col("n_lines"), F.lit(1))
    return [x.cast("double") for x in (F.col("word_chars") / words, F.col("n_symbols") / words, F.col("n_dup_lines") / lines,
                                       F.col("n_repeat_words") / words, F.col("n_upper") / chars)]


class Forest:
    """Trees as flat arrays: feature (-1 at a leaf), cut, left child (right is the next), path length at the leaf."""

    def __init__(self, rows: np.ndarray, settings: Settings):
        rng = np.random.default_rng(settings.seed)
        self.expected = self._usual(min(settings.sample, len(rows)))
        self.trees = [self._grow(rows[rng.choice(len(rows), min(settings.sample, len(rows)), replace=False)], rng) for _ in range(settings.trees)] if len(rows) > 1 else []

    @staticmethod
    def _usual(n: int) -> float:
        """Mean path of a search that fails among n rows."""
        return 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n if n > 2 else float(n == 2)

    def _grow(self, rows: np.ndarray, rng) -> tuple[np.ndarray, ...]:
        limit = int(np.ceil(np.log2(max(2, len(rows)))))
        feature, cut, left, path = [-1], [0.0], [0], [0.0]
        open_ = [(0, rows, 0)]
        while open_:
            at, part, depth = open_.pop()
            low, high = part.min(0), part.max(0)
            wide = np.flatnonzero(high > low)
            if depth >= limit or not len(wide):
                path[at] = depth + self._usual(len(part))
                continue
            f = int(rng.choice(wide))
            c = float(rng.uniform(low[f], high[f]))
            right = part[:, f] > c
            if not right.any():
                c = float(np.nextafter(high[f], low[f]))
                right = part[:, f] > c
            feature[at], cut[at], left[at] = f, c, len(feature)
            for side in (part[~right], part[right]):
                open_.append((len(feature), side, depth + 1))
                for x, v in ((feature, -1), (cut, 0.0), (left, 0), (path, 0.0)):
                    x.append(v)
        return np.array(feature), np.array(cut), np.array(left), np.array(path)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        if not self.trees:
            return np.zeros(len(rows))
        total = np.zeros(len(rows))
        each = np.arange(len(rows))
        for feature, cut, left, path in self.trees:
            at = np.zeros(len(rows), np.int64)
            while (inner := feature[at] >= 0).any():
                f = np.maximum(feature[at], 0)
                at = np.where(inner, left[at] + (rows[each, f] > cut[at]), at)
            total += path[at]
        return 2 ** (-total / len(self.trees) / max(self.expected, 1e-9))


def fit_forest(stats: DataFrame, key: str = "doc_id", settings: Settings = Settings()) -> Forest:
    """Trees over a sample of trees * sample rows at most, chosen by the hash of the id."""
    most = settings.trees * settings.sample
    found = (stats.where(~base_failed()).select(F.xxhash64(F.col(key)).alias("at"), *(x.alias(f"x{i}") for i, x in enumerate(inputs())))
             .orderBy("at", *(f"x{i}" for i in range(5))).limit(most).toArrow())
    return Forest(np.column_stack([found[f"x{i}"].to_numpy() for i in range(5)]).reshape(-1, 5), settings)


def anomaly(stats: DataFrame, forest: Forest) -> DataFrame:
    """All rows of ``stats`` with ``anomaly``, from 0 to 1."""
    shared = stats.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("double")
    def scored(*columns):
        import pandas as pd
        return pd.Series(shared.value.scores(np.column_stack(columns)))

    return stats.withColumn("anomaly", scored(*inputs()))


def threshold(scored: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> float:
    """The score from which rows are rejected: the cut with the least weighted error over all labelled rows.

    A good row lost weighs ``good_weight`` times as much as a bad row missed.
    """
    marked = labels.select(F.col("doc_id").alias("id"), F.col("quality").cast("int").alias("good")).where("id is not null and good in (0, 1)")
    # Counts per thousandth and class: exact, and of bounded size.
    bins = (scored.where(~base_failed()).select("doc_id", F.floor(F.col("anomaly") * 1000).alias("bin"))
            .join(marked, F.col("doc_id") == F.col("id")).groupBy("bin").agg(F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("bad")).collect())
    best, cut = 0.0, float("inf")
    caught = lost = 0
    for r in sorted(bins, key=lambda r: -r["bin"]):
        caught, lost = caught + r["bad"], lost + r["good"]
        gain = caught - settings.good_weight * lost
        if gain > best:
            best, cut = gain, r["bin"] / 1000
    return cut
