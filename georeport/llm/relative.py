"""Substring duplicates in words by counts of hashed windows (``repeats``), in place of a relative Lempel-Ziv parse.

Words are removed by repeated windows alone. Factors are made afterwards, from the finished windows and earlier documents: greedily from the first word,
at each word the longest stretch along one earlier document; a word in no stretch is a literal. No removed word depends on a factor.

Null and blank texts have no words. Texts shorter than a window lose nothing. Rows equal in id and text are copies of each other.
A null id stands before all others. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from georeport.llm import repeats
from georeport.llm import textops as T


def settings(least: int) -> repeats.Settings:
    return repeats.Settings(least, max(1, min(8, least // 2)), ())


def symbols(part: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = T.word_spans(part, off)
    return T.word_hashes(part, starts, ends), first


def factors(lo: np.ndarray, hi: np.ndarray, doc: np.ndarray, twin: np.ndarray, at: np.ndarray, least: int) -> list[tuple[int, int, int, int, int]]:
    """(start, length, from_doc, from_twin, from_start) of the greedy parse; literals are left out.

    Runs along one reference block (same text, same shift) are one stretch.
    """
    shift = at - lo
    order = np.lexsort((lo, shift, twin, doc))
    stretches: list[list[int]] = []
    for i in order.tolist():
        last = stretches[-1] if stretches else None
        if last and (last[2], last[3], last[4]) == (doc[i], twin[i], shift[i]) and lo[i] <= last[1] - least + 1:
            last[1] = max(last[1], int(hi[i]) + least)
        else:
            stretches.append([int(lo[i]), int(hi[i]) + least, int(doc[i]), int(twin[i]), int(shift[i])])
    stretches.sort()
    out, word, i = [], 0, 0
    best: list[int] | None = None
    while True:
        while i < len(stretches) and stretches[i][0] <= word:
            if best is None or stretches[i][1] > best[1]:
                best = stretches[i]
            i += 1
        if best and best[1] > word:
            out.append((word, best[1] - word, best[2], best[3], word + best[4]))
            word = best[1]
        elif i < len(stretches):
            word = stretches[i][0]
        else:
            return out


def parsed(docs: DataFrame, least: int = 35, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept (text), factors (those with an earlier reference), kept_sha256."""
    rows = repeats.with_runs(docs, repeats.repeated_windows(docs, symbols, settings(least), doc_id, text), doc_id, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = T.utf8(batch["text"])
            runs = repeats.row_runs(batch["runs"])
            n_words, n_removed, kept, digest, found, ends = [], [], [], [], [], [0]
            for i, (lo, hi, doc, twin, at, known) in enumerate(runs):
                words = buf[off[i]:off[i + 1]].tobytes().split()
                n_words.append(len(words))
                if len(lo):
                    out = repeats.covered(lo, hi, least, len(words))
                    n_removed.append(int(out.sum()))
                    words = [words[j] for j in np.flatnonzero(~out).tolist()]
                    found += factors(lo[known], hi[known], doc[known], twin[known], at[known], least)
                else:
                    n_removed.append(0)
                ends.append(len(found))
                kept.append(b" ".join(words))
                digest.append(hashlib.sha256(kept[-1]).hexdigest())
            flat = np.array(found, np.int64).reshape(-1, 5)
            names = ["start", "length", "from_doc", "from_twin", "from_start"]
            items = pa.StructArray.from_arrays([pa.array(flat[:, j]) for j in range(5)], names)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()),
                                              pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items), pa.array(digest, pa.string())],
                                             ["doc_id", "n_words", "n_removed", "kept", "factors", "kept_sha256"])

    return rows.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string, factors array<struct<start: long, length: long, from_doc: long, "
                                "from_twin: long, from_start: long>>, kept_sha256 string")
