"""Best-fit decreasing packing of token sequences, with a segment tree over remaining capacities.

Documents are tokenized once; only ids' counts and checksums go on unless the ids are asked for. Longer documents than a sequence are cut
into full pieces. Pieces are dealt at random into groups of about ``group_rows``, and each group is packed on its own: longest first,
each into the tightest open sequence that holds it. A group wastes at most about one sequence against packing all at once.

Tokens come from whole texts: this tokenizer drops white space, so a text's ids are those of its words in order, and repeated words are
looked up instead of encoded anew.

Null and empty texts are one piece with the end token alone. Repeated rows are packed each. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from georeport.operators.common import written


@dataclass(frozen=True)
class Settings:
    capacity: int = 4096
    end_token: int = 1
    group_rows: int = 10_000
    known_words: int = 600_000


class WordEncoder:
    """Ids of texts by a tokenizer file that splits at white space and drops it; remembers words up to a bound."""

    def __init__(self, path: str, known_words: int):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.encode, self.bound = Tokenizer.from_file(path).encode, known_words
        self._forget()

    def _forget(self) -> None:
        self.numbers: dict[str, int] = defaultdict()
        self.numbers.default_factory = self.numbers.__len__
        self.ids, self.ends = np.zeros(1 << 16, np.uint32), np.zeros(1, np.int64)

    def _ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some words and their number per word, from one call: a token belongs to the word that it begins in."""
        made = self.encode(" ".join(words), add_special_tokens=False)
        begins = np.fromiter((a for a, _ in made.offsets), np.int64, len(made.ids))
        starts = np.cumsum([0] + [len(w) + 1 for w in words[:-1]])
        return np.array(made.ids, np.uint32), np.bincount(np.searchsorted(starts, begins, "right") - 1, minlength=len(words))

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and where each text's ids begin (one entry more than texts)."""
        if len(self.numbers) > self.bound:
            self._forget()
        lists = pc.ascii_split_whitespace(texts.fill_null(""))
        flat = lists.flatten()
        filled = pc.greater(pc.binary_length(flat), 0)
        upto = np.concatenate([[0], np.cumsum(filled.to_numpy(zero_copy_only=False))])
        first = upto[np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)]
        coded = flat.filter(filled).dictionary_encode()
        before = len(self.numbers)
        known = np.fromiter(map(self.numbers.__getitem__, coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
        if len(self.numbers) > before:
            new = list(islice(self.numbers, before, None))
            found = [self._ids(new[i:i + 1000]) for i in range(0, len(new), 1000)]
            ids = np.concatenate([x[0] for x in found])
            ends = self.ends[-1] + np.cumsum(np.concatenate([x[1] for x in found]))
            while len(self.ids) < ends[-1]:
                self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), np.uint32)])
            self.ids[self.ends[-1]:ends[-1]] = ids
            self.ends = np.concatenate([self.ends, ends])
        words = known[coded.indices.to_numpy()]
        n = self.ends[words + 1] - self.ends[words]
        upto = np.concatenate([[0], np.cumsum(n)])
        return self.ids[np.repeat(self.ends[words] - upto[:-1], n) + np.arange(upto[-1])], upto[first]


@lru_cache(maxsize=1)
def word_encoder(path: str, known_words: int) -> WordEncoder:
    """One per Python worker, kept from task to task."""
    return WordEncoder(path, known_words)


def pieces(docs: DataFrame, path: str, settings: Settings = Settings(), with_ids: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, dealt[, ids]): ``dealt`` is a random number for the groups, fixed per input partition."""
    schema = docs.select(F.col(doc_id).alias("doc_id")).schema
    schema.add("piece", "integer")
    for c in ("start", "length", "ids_crc32", "dealt"):
        schema.add(c, "long")
    if with_ids:
        schema.add("ids", ArrayType(IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_encoder(path, settings.known_words)
        rng = np.random.default_rng(TaskContext.get().partitionId())
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                flat, at = encode(part.column(1))
                row, piece, start, length, crc, ids = [], [], [], [], [], []
                for i in range(part.num_rows):
                    own = np.append(flat[at[i]:at[i + 1]], np.uint32(settings.end_token)).astype("<u4")
                    for k, s in enumerate(range(0, len(own), settings.capacity)):
                        cut = own[s:s + settings.capacity]
                        row.append(i)
                        piece.append(k)
                        start.append(s)
                        length.append(len(cut))
                        crc.append(zlib.crc32(cut.tobytes()))
                        if with_ids:
                            ids.append(cut.astype(np.int32))
                columns = [part.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                           pa.array(crc, pa.int64()), pa.array(rng.integers(0, 1 << 62, len(row)))]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array(ids, pa.list_(pa.int32()))] if with_ids else []), schema.names)

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


class OpenSequences:
    """Open sequences by remaining room. A tree over the rooms 0..capacity holds the largest room used below each node."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.tree = [-1] * (2 * self.size)
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, sequence: int, room: int) -> None:
        self.at[room].append(sequence)
        if len(self.at[room]) == 1:
            self._mark(room, room)

    def _mark(self, room: int, value: int) -> None:
        node = room + self.size
        self.tree[node] = value
        while node > 1:
            node >>= 1
            self.tree[node] = max(self.tree[2 * node], self.tree[2 * node + 1])

    def take(self, need: int) -> tuple[int, int] | None:
        """The sequence with the least room of at least ``need``, and its room."""
        tree, node = self.tree, need + self.size
        if tree[node] < 0:
            # Up until a right neighbour has something, then down its left-most used path.
            while node > 1 and (node & 1 or tree[node + 1] < 0):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if tree[2 * node] >= 0 else 2 * node + 1
        room = node - self.size
        sequence = self.at[room].pop()
        if not self.at[room]:
            self._mark(room, -1)
        return sequence, room


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece, longest first."""
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    opened, used = OpenSequences(capacity), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        found = opened.take(need)
        if found is None:
            found = used, capacity
            used += 1
        sequence[i], room = found
        offset[i] = capacity - room
        if room > need:
            opened.add(found[0], room - need)
    return sequence, offset


def packed(rows: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """All rows of a written table of pieces with sequence_id and offset instead of ``dealt``."""
    groups = rows.count() // settings.group_rows + 1
    dealt = rows.withColumn("group", F.pmod("dealt", F.lit(groups))).drop("dealt")
    schema = dealt.drop("group").schema.add("sequence_id", "long").add("offset", "long")

    def run(table: pa.Table) -> pa.Table:
        sequence, offset = best_fit(table["length"].to_numpy(), settings.capacity)
        first = int(table["group"][0].as_py()) << 32
        return table.drop_columns(["group"]).append_column("sequence_id", pa.array(sequence + first)).append_column("offset", pa.array(offset))

    return dealt.groupBy("group").applyInArrow(run, schema)


def pack(docs: DataFrame, path: str, settings: Settings = Settings(), with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset) for every piece of every document."""
    return packed(written(pieces(docs, path, settings, with_ids), "pieces"), settings)
