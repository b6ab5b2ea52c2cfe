"""Token counts per section: encode whole texts once, then give each token to the section it belongs to.

Sections are stretches of a text, in order and without overlap: (start, end) in code points. Tokens are stretches as well, so the join of both
is an interval join between two sorted lists of one row. A token that crosses a border is given to one section by rule:

* ``first``: where it begins        * ``most``: where most of it lies, the earlier of equal ones

Tokens outside of all sections count as ``outside``. A section's count and the tokens that cross its borders are reported, and a text's counts
add up to its tokens. Tokens are byte-level; a token inside a code point begins at that code point.

Null and empty texts have no sections and no tokens (one row with section null). Empty sections get no tokens. Rows are told apart by id alone in the result;
repeated rows are counted each. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RULES = ("first", "most")


@lru_cache
def encoder(path: str):
    """Encoder of a rank file: byte-level, no special tokens."""
    import base64

    import public_tokenizers
    import tiktoken
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def allocate(token_ends: np.ndarray, start: np.ndarray, end: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Tokens of each section, tokens that cross one of its borders, and tokens outside. All places in one unit."""
    filled = end > start
    if not filled.all():  # empty sections get nothing
        count, crossed = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        count[filled], crossed[filled], outside = allocate(token_ends, start[filled], end[filled], rule)
        return count, crossed, outside
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), len(token_ends)
    token_start = np.concatenate([[0], token_ends[:-1]])
    # The sections that a token touches are first..last: the join of two sorted interval lists.
    first = np.searchsorted(end, token_start, "right")
    last = np.searchsorted(start, token_ends, "left") - 1
    touches = (last >= first) & (token_ends > token_start)
    owner = np.full(len(token_ends), -1)
    if rule == "first":
        at = np.minimum(first, len(start) - 1)
        inside = touches & (start[at] <= token_start)
        owner[inside] = first[inside]
    else:
        one = touches & (first == last)
        owner[one] = first[one]
        for t in np.flatnonzero(touches & (last > first)).tolist():
            s = np.arange(first[t], last[t] + 1)
            share = np.minimum(end[s], token_ends[t]) - np.maximum(start[s], token_start[t])
            owner[t] = s[int(np.argmax(share))]
    at = np.clip(first, 0, len(start) - 1)
    crosses = touches & ((token_start < start[at]) | (token_ends > end[at]) | (last > first))
    crossed = np.zeros(len(start) + 1, np.int64)
    np.add.at(crossed, first[crosses], 1)
    np.add.at(crossed, last[crosses] + 1, -1)
    return np.bincount(owner[owner >= 0], minlength=len(start)), np.cumsum(crossed[:-1]), int((owner < 0).sum())


def attributed(docs: DataFrame, path: str, sections: Column | None = None, rule: str = "first", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, section, start, end, n_tokens, n_crossing, n_doc_tokens, n_outside): a row per section; lines by default."""
    if rule not in RULES:
        raise ValueError(rule)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                out = [[] for _ in range(7)]
                owner = []
                given = part.column(2).to_pylist() if part.num_columns > 2 else None
                for i, t in enumerate(part.column(1).to_pylist()):
                    raw = np.frombuffer((t or "").encode(), np.uint8)
                    tokens = encode.encode_ordinary(t) if t else []
                    ends = np.cumsum([len(x) for x in encode.decode_tokens_bytes(tokens)], dtype=np.int64)
                    if given is None:
                        cut = np.flatnonzero(raw == 10)
                        start, end = (np.concatenate([[0], cut + 1]), np.concatenate([cut, [len(raw)]])) if len(raw) else (np.zeros(0, np.int64),) * 2
                    else:
                        points = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
                        marks = np.array([(s["start"], s["end"]) for s in given[i] or []], np.int64).reshape(-1, 2)
                        start, end = points[np.clip(marks[:, 0], 0, len(points) - 1)], points[np.clip(marks[:, 1], 0, len(points) - 1)]
                    # Code points up to each byte, for places in the result.
                    upto = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
                    count, crossing, outside = allocate(ends, start, end, rule)
                    n = max(len(start), 1)
                    none = not len(start)
                    owner += [i] * n
                    for x, values in zip(out, ([None] if none else range(n), [None] if none else upto[start].tolist(), [None] if none else upto[end].tolist(),
                                               [0] if none else count.tolist(), [0] if none else crossing.tolist(), [len(tokens)] * n, [outside] * n)):
                        x.extend(values)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owner, pa.int64())), *(pa.array(x, pa.int64()) for x in out)],
                                                 ["doc_id", "section", "start", "end", "n_tokens", "n_crossing", "n_doc_tokens", "n_outside"])

    schema = docs.select(F.col(doc_id).alias("doc_id")).schema
    for c in ("section", "start", "end", "n_tokens", "n_crossing", "n_doc_tokens", "n_outside"):
        schema = schema.add(c, "long")
    columns = [F.col(doc_id).alias("doc_id"), F.col(text).alias("text")] + ([] if sections is None else [sections.alias("sections")])
    return docs.select(*columns).mapInArrow(run, schema)
