"""Substring duplicates in bytes by counts of hashed windows (``repeats``), in place of a suffix array.

Whether a window of ``least`` bytes starts elsewhere is all that is asked, so windows are grouped by hashes of growing precision; no suffix is
sorted. The smallest place of a class, (document, text hash, position), stands for the previous factor of its other members.

``keep="first"`` removes the bytes of later copies, whatever covers them; ``keep="none"`` removes every copy, the first included.
Matches never cross rows. Null and short texts lose nothing. Rows equal in id and text are copies of each other: with "none" both lose
their text, with "first" both keep it. A null id stands before all others. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from georeport.llm import repeats
from georeport.llm import textops as T


def settings(least: int) -> repeats.Settings:
    seed = max(1, min(64, least // 4))
    return repeats.Settings(least, seed, (16,) if least - seed > 64 else ())


def symbols(part: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return T.byte_codes()[part], off


def repeated(docs: DataFrame, least: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Runs of byte positions whose next ``least`` bytes stand elsewhere, each with the smallest such place."""
    return repeats.repeated_windows(docs, symbols, settings(least), doc_id, text)


def previous_factors(found: DataFrame, least: int) -> DataFrame:
    """(doc, twin, start, length, from_doc, from_twin, from_start): the array of previous factors of at least ``least`` bytes in runs.

    Runs that go on along one earlier text are one factor.
    """
    own = found.where("from_doc is not null").select("doc", "twin", "lo", "hi", "from_doc", "from_twin", (F.col("from_lo") - F.col("lo")).alias("shift"))
    along = W.partitionBy("doc", "twin", "from_doc", "from_twin", "shift").orderBy("lo")
    far = F.max("hi").over(along.rowsBetween(W.unboundedPreceding, -1))
    marked = own.withColumn("new", F.when(F.col("lo") <= far + 1, 0).otherwise(1))
    runs = marked.withColumn("run", F.sum("new").over(along)).groupBy("doc", "twin", "from_doc", "from_twin", "shift", "run").agg(F.min("lo").alias("start"), F.max("hi").alias("hi"))
    return runs.select("doc", "twin", "start", (F.col("hi") - F.col("start") + least).alias("length"), "from_doc", "from_twin", (F.col("start") + F.col("shift")).alias("from_start"))


def removed(docs: DataFrame, least: int = 400, keep: str = "none", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, spans (start, end; maximal and in order), kept_sha256."""
    if keep not in ("none", "first"):
        raise ValueError(keep)
    found = repeated(docs, least, doc_id, text)
    rows = repeats.with_runs(docs, found if keep == "none" else found.where("from_doc is not null"), doc_id, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = T.utf8(batch["text"])
            n_removed, n_spans, digest, spans, ends = [], [], [], [], [0]
            for i, (lo, hi, *_) in enumerate(repeats.row_runs(batch["runs"])):
                own = buf[off[i]:off[i + 1]]
                if len(lo):
                    out = repeats.covered(lo, hi, least, len(own))
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], out, [False]]).astype(np.int8)))
                    own = own[~out]
                    n_removed.append(int(out.sum()))
                else:
                    edge = np.zeros(0, np.int64)
                    n_removed.append(0)
                n_spans.append(len(edge) // 2)
                spans.append(edge.reshape(-1, 2))
                ends.append(ends[-1] + len(edge) // 2)
                digest.append(hashlib.sha256(own).hexdigest())
            flat = np.concatenate(spans) if spans else np.zeros((0, 2), np.int64)
            pairs = pa.StructArray.from_arrays([pa.array(flat[:, 0], pa.int64()), pa.array(flat[:, 1], pa.int64())], ["start", "end"])
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(np.diff(off)), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()),
                                              pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs), pa.array(digest, pa.string())],
                                             ["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept_sha256"])

    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start: long, end: long>>, kept_sha256 string")
