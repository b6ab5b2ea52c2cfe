"""One large JSON document read by many tasks, as byte ranges.

Whether a byte lies in a string, and how deep in brackets, depends on all bytes before it. A first pass counts quotes and brackets per range,
the latter for both cases (the range begins inside a string or not); running totals of these few rows give each range its
state. In the second pass a task cuts out the objects that begin in its range, and reads on behind it for the last of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

_QUOTE, _BACKSLASH = 34, 92
PART_BITS = 33


def _opened(path: str):
    files, where = pafs.FileSystem.from_uri(path) if ":" in path else (pafs.LocalFileSystem(), path)
    return files.open_input_file(where)


def _marks(data: np.ndarray, escaped: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places of quotes that count, and by how much each byte changes the depth (quotes not regarded). ``escaped``: a backslash before the data counts."""
    back = data == _BACKSLASH
    at = np.arange(len(data))
    # Length of the run of backslashes that ends before each byte.
    last = np.maximum.accumulate(np.where(back, -1, at))
    run = np.where(np.append(False, back[:-1]), at - 1 - np.append(-1, last[:-1]), 0)
    odd = (run + np.where((run == at) & escaped, 1, 0)) % 2 == 1
    change = np.zeros(len(data), np.int8)
    change[(data == 123) | (data == 91)] = 1
    change[(data == 125) | (data == 93)] = -1
    return (data == _QUOTE) & ~odd, change


def _slash_before(file, start: int) -> bool:
    """Is the byte at ``start`` escaped? Counts the backslashes before it."""
    n, block = 0, 1 << 12
    while start > 0:
        lo = max(0, start - block)
        text = file.read_at(start - lo, lo)
        kept = len(text.rstrip(b"\\"))
        n += len(text) - kept
        if kept:
            break
        start = lo
    return n % 2 == 1


def _counts(path: str, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _opened(path) as file:
            for batch in batches:
                rows = []
                for no in batch.column(0).to_pylist():
                    quotes, change = _marks(np.frombuffer(file.read_at(size, no * size), np.uint8), _slash_before(file, no * size))
                    inside = np.cumsum(quotes) % 2 == 1
                    rows.append((no, int(quotes.sum()), int(change[~inside].sum(dtype=np.int64)), int(change[inside].sum(dtype=np.int64))))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 4, ["no", "quotes", "outside", "inside"])

    return run


def _objects(path: str, size: int, level: int):
    """Objects that begin in a range in an array at ``level``, whole."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _opened(path) as file:
            whole = file.size()
            for batch in batches:
                for no, quoted, depth in zip(*(batch.column(i).to_pylist() for i in range(3))):
                    begin = no * size
                    data = np.frombuffer(file.read_at(size, begin), np.uint8)
                    length, reach = len(data), size
                    while True:
                        quotes, change = _marks(data, _slash_before(file, begin))
                        outside = (np.cumsum(quotes) + quoted) % 2 == 0
                        deep = depth + np.cumsum(np.where(outside, change, 0), dtype=np.int64)
                        opens = np.flatnonzero(outside & (data == 123) & (deep == level + 1))
                        opens = opens[(opens < length)]
                        closes = np.flatnonzero(outside & (data == 125) & (deep == level))
                        if not len(opens) or (len(closes) and closes[-1] > opens[-1]) or begin + len(data) >= whole:
                            break
                        reach *= 2  # the last object goes on behind the range
                        data = np.frombuffer(file.read_at(size + reach, begin), np.uint8)
                    ends = closes[np.minimum(np.searchsorted(closes, opens), max(len(closes) - 1, 0))] if len(closes) else np.zeros(0, np.int64)
                    text, before = data.tobytes(), file.read_at(min(begin, 1 << 12), max(0, begin - (1 << 12)))
                    # An element of an array, not the value of a key.
                    own = [(int(a), int(b)) for a, b in zip(opens, ends) if b > a and (before + text[:a]).rstrip()[-1:] in (b"[", b",")]
                    for k in range(0, len(own), 1024):
                        part = own[k:k + 1024]
                        yield pa.RecordBatch.from_arrays([pa.array([(no << PART_BITS) + a for a, _ in part], pa.int64()), pa.array([text[a:b + 1].decode() for a, b in part])], ["no", "value"])

    return run


def array_objects(spark: SparkSession, path: str, level: int = 2, size: int = 64 << 20) -> DataFrame:
    """Objects in arrays at bracket level ``level`` of one JSON document: ``no``, rising with their place, and ``value``, their text.

    ``path`` is one file that all executors can open. With 2, these are the elements of arrays that are values of the outermost object.
    """
    with _opened(path) as file:
        ranges = max(1, -(-file.size() // size))
    numbers = spark.range(0, ranges, 1, ranges)
    counts = numbers.mapInArrow(_counts(path, size), "no long, quotes long, outside long, inside long")
    # One row per range.
    before = W.orderBy("no").rowsBetween(W.unboundedPreceding, -1)
    quoted = F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2
    state = counts.withColumn("quoted", quoted).withColumn("by", F.when(F.col("quoted") == 0, F.col("outside")).otherwise(F.col("inside")))
    state = state.select("no", "quoted", F.coalesce(F.sum("by").over(before), F.lit(0)).alias("depth")).repartition(ranges, "no")
    return state.mapInArrow(_objects(path, size, level), "no long, value string")
