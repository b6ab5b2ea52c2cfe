"""WARC records in ZIP archives, read in place.

Writing: payloads with equal digests are found by a count per digest; of each group the record with the smallest id is a
response, the others are revisits that name it. Each task writes one archive: a stored member with gzip records one after another, and a stored
member with their index (id, offset, length). Archives are listed in a written table, so what a failed attempt leaves behind is never read.

Reading: an archive's end record, its ZIP64 end record, and the central directory tell where stored members lie; a member's
index tells where its records lie; records are then read by range, and never unpacked to disk. Members that are compressed are refused.

Files go through ``pyarrow.fs``, so the shared folder may be any store that it knows. Null payloads are empty. Rows that repeat an id
with the same payload are responses all. A null id comes after all others. An empty table gives no archive. Other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from georeport.operators.common import scratch_path, written

WARC, INDEX = "records.warc.gz", "records.idx"
#: Signatures and sizes of the ZIP format.
LOCAL, CENTRAL, END, END64, LOCATOR64 = 0x04034B50, 0x02014B50, 0x06054B50, 0x06064B50, 0x07064B50
SMALL, SHORT = 0xFFFFFFFF, 0xFFFF
ENTRY, ENTRY_BYTES = "<qQQ", 24
NO_ID = -(1 << 63)


def store(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


# --- ZIP ---------------------------------------------------------------------------------------------------------

class StoredZip:
    """Writes stored members to a stream, one open at a time; sizes above 4 GB and many members go to ZIP64 fields."""

    def __init__(self, out, force_zip64: bool = False):
        self.out, self.at, self.members, self.force = out, 0, [], force_zip64

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        self.name, self.start, self.crc = name.encode(), self.at, 0
        # Sizes follow in a descriptor (flag bit 3), as they are unknown on a stream.
        self._put(struct.pack("<IHHHHHIIIHH", LOCAL, 45, 8 | 0x800, 0, 0, 33, 0, SMALL, SMALL, len(self.name), 20) + self.name + struct.pack("<HHQQ", 1, 16, 0, 0))
        self.data = self.at

    def write(self, data: bytes) -> int:
        """Where in the member the data begin."""
        place = self.at - self.data
        self.crc = zlib.crc32(data, self.crc)
        self._put(data)
        return place

    def end(self) -> None:
        size = self.at - self.data
        self._put(struct.pack("<IIQQ", 0x08074B50, self.crc, size, size))
        self.members.append((self.name, self.crc, size, self.start))

    def close(self) -> None:
        start = self.at
        for name, crc, size, at in self.members:
            big, far = self.force or size >= SMALL, self.force or at >= SMALL
            extra = (struct.pack("<QQ", size, size) if big else b"") + (struct.pack("<Q", at) if far else b"")
            extra = struct.pack("<HH", 1, len(extra)) + extra if extra else b""
            shown = SMALL if big else size
            self._put(struct.pack("<IHHHHHHIIIHHHHHII", CENTRAL, 45, 45, 8 | 0x800, 0, 0, 33, crc, shown, shown, len(name), len(extra), 0, 0, 0, 0, SMALL if far else at) + name + extra)
        size, n = self.at - start, len(self.members)
        if self.force or start >= SMALL or size >= SMALL or n >= SHORT:
            at = self.at
            self._put(struct.pack("<IQHHIIQQQQ", END64, 44, 45, 45, 0, 0, n, n, size, start) + struct.pack("<IIQI", LOCATOR64, 0, at, 1))
            n, size, start = SHORT, SMALL, SMALL
        self._put(struct.pack("<IHHHHIIH", END, 0, 0, n, n, size, start, 0))


@dataclass(frozen=True)
class Member:
    name: str
    start: int
    size: int


def read_directory(file, size: int) -> list[Member]:
    """Members of an open archive of ``size`` bytes; ``file`` reads by range (``read_at(n, offset)``)."""
    tail_at = max(0, size - 65_557)
    tail = file.read_at(size - tail_at, tail_at)
    place = tail.rfind(struct.pack("<I", END))
    if place < 0:
        raise ValueError("not a ZIP archive")
    n, length, start = struct.unpack_from("<HII", tail, place + 10)
    if n == SHORT or SMALL in (length, start):
        locator = file.read_at(20, tail_at + place - 20)
        if struct.unpack_from("<I", locator)[0] != LOCATOR64:
            raise ValueError("no ZIP64 locator")
        end64 = file.read_at(56, struct.unpack_from("<Q", locator, 8)[0])
        n, length, start = struct.unpack_from("<QQQ", end64, 32)
    directory, at, out = file.read_at(length, start), 0, []
    for _ in range(n):
        mark, method, packed, plain, name_n, extra_n, note_n, where = (struct.unpack_from(f, directory, at + o)[0] for f, o in (
            ("<I", 0), ("<H", 10), ("<I", 20), ("<I", 24), ("<H", 28), ("<H", 30), ("<H", 32), ("<I", 42)))
        if mark != CENTRAL:
            raise ValueError("broken central directory")
        name = directory[at + 46:at + 46 + name_n].decode()
        extra, e = directory[at + 46 + name_n:at + 46 + name_n + extra_n], 0
        while e + 4 <= len(extra):
            kind, width = struct.unpack_from("<HH", extra, e)
            if kind == 1:
                fields = iter(struct.unpack_from(f"<{width // 8}Q", extra, e + 4))
                plain = next(fields) if plain == SMALL else plain
                packed = next(fields) if packed == SMALL else packed
                where = next(fields) if where == SMALL else where
            e += 4 + width
        if method:
            raise ValueError(f"{name} is compressed")
        head = file.read_at(30, where)
        skip = sum(struct.unpack_from("<HH", head, 26))
        out.append(Member(name, where + 30 + skip, packed))
        at += 46 + name_n + extra_n + note_n
    return out


# --- WARC --------------------------------------------------------------------------------------------------------

def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page: int | None, url: str, payload: bytes, sha: str, refers: int | None) -> bytes:
    """One record; a revisit keeps the response's header lines, whose length stands for the payload's."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if refers is not None else http + payload
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"page:{page}:{sha}")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Record-ID: <urn:uuid:{name}>", "WARC-Date: 2024-01-01T00:00:00Z",
            f"WARC-Target-URI: {' '.join(url.split())}", f"WARC-Payload-Digest: sha1:{sha}", f"X-Page: {'' if page is None else page}"]
    if refers is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page: {refers}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Header fields of a record and of the HTTP part, and the payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    http, _, payload = rest[:int(fields["Content-Length"])].partition(b"\r\n\r\n")
    return fields, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


# --- Spark -------------------------------------------------------------------------------------------------------

def marked(pages: DataFrame, least: int = 0) -> DataFrame:
    """(page_id, url, payload, sha1, refers_to): revisits have the id of the response with an equal payload."""
    payload = F.coalesce(pages["html"], F.lit("")).cast("binary")
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), F.coalesce(pages["url"], F.lit("")).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("key", F.sha1("payload"))
    heads = rows.where(F.octet_length("payload") >= least).groupBy("key").agg(F.min("page_id").alias("head"), F.count("*").alias("n")).where("n > 1 and head is not null")
    joined = rows.join(heads.select(F.col("key").alias("k"), "head"), F.col("key") == F.col("k"), "left")
    return joined.select("page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("head")), F.col("head")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Writes all pages; the written list of archives (path, size, n_records), one per task that had rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, out, index, n = f"{folder}/{uuid.uuid4().hex}.zip", None, [], 0
        for batch in batches:
            for page, url, payload, refers in zip(*(batch[c].to_pylist() for c in ("page_id", "url", "payload", "refers_to"))):
                if out is None:
                    files, place = store(path)
                    files.create_dir(place.rpartition("/")[0], recursive=True)
                    out = files.open_output_stream(place)
                    archive = StoredZip(out)
                    archive.begin(WARC)
                data = gzip.compress(record(page, url, payload, digest(payload), refers), 3, mtime=0)
                index.append(struct.pack(ENTRY, NO_ID if page is None else page, archive.write(data), len(data)))
        if out is None:
            return
        archive.end()
        archive.begin(INDEX)
        archive.write(b"".join(index))
        archive.end()
        archive.close()
        out.close()
        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([archive.at]), pa.array([len(index)])], ["path", "size", "n_records"])

    return written(marked(pages, least).mapInArrow(run, "path string, size long, n_records long"), "archives")


def read_archives(archives: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload): every record of the listed archives (path, size, n_records), read by range.

    Work is dealt out in stretches of index entries, so an archive of any size feeds many tasks.
    """
    step, per_task = 256, 16
    # Few bytes name much work here, so their size must not decide the number of tasks.
    stretches = archives.agg(F.coalesce(F.sum(F.ceil(F.col("n_records") / step)), F.lit(0))).first()[0]
    parts = archives.select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("n_records") - 1, F.lit(0)), F.lit(step).cast("long"))).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size, first in zip(*(batch[c].to_pylist() for c in ("path", "size", "first"))):
                files, place = store(path)
                with files.open_input_file(place) as file:
                    members = {m.name: m for m in read_directory(file, size)}
                    warc, listed = members[WARC], members[INDEX]
                    entries = list(struct.iter_unpack(ENTRY, file.read_at(min(step * ENTRY_BYTES, listed.size - first * ENTRY_BYTES), listed.start + first * ENTRY_BYTES)))
                    rows = []
                    for _, at, n in entries:
                        fields, http, payload = parse(gzip.decompress(file.read_at(n, warc.start + at)))
                        full = fields["WARC-Type"] == "response"
                        if full and digest(payload) != fields["WARC-Payload-Digest"].removeprefix("sha1:"):
                            raise ValueError(f"damaged record at {at} of {path}")
                        page, refers = fields["X-Page"], fields.get("X-Refers-To-Page")
                        rows.append((int(page) if page else None, int(http["Content-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"],
                                     int(refers) if refers else None, fields["WARC-Target-URI"], payload if full else None))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"])

    return parts.repartition(stretches // per_task + 1, F.col("path"), F.col("first")).mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary")


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Pages to archives in the shared folder and back."""
    return read_archives(write_archives(pages, scratch_path(pages.sparkSession, "warc"), least))
