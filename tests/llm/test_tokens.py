"""Packing, attribution, archives and the pipeline: brute force and round trips."""

import collections
import io
import random
import zipfile
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from georeport.llm import archives, attribution, packing

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.tiktoken")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, piece int, ids string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1, 3, "x") for i, t in rows], SCHEMA)


def texts(seed):
    r = random.Random(seed)
    words = ["the", "Größe", "don't", "naïve", "123", "😀", "á", "<|endoftext|>", "x y", "İ", "ΑΣ", "\x1c", "___", "we'll", "́start"]
    out = [(i, r.choice([" ", "\n", "\t  "]).join(r.choices(words, k=r.randrange(80)))) for i in range(60)]
    return out + [(100, None), (101, ""), (102, " \n"), (103, "word " * 9000), (5, out[5][1]), (None, "null id")]


def test_pieces_equal_whole_encodings(spark):
    from tokenizers import Tokenizer
    whole = Tokenizer.from_file(WORDS)
    rows = texts(1)
    want = collections.Counter()
    for i, t in rows:
        ids = whole.encode(t or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), 4096):
            cut = ids[k:k + 4096]
            want[(i, k // 4096, k, len(cut), zlib.crc32(np.array(cut, "<u4").tobytes()), tuple(cut))] += 1
    got = packing.pieces(frame(spark, rows), WORDS, packing.Settings(known_words=5), with_ids=True).collect()
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], tuple(r["ids"])) for r in got) == want


def test_packed_sequences(spark):
    rows = packing.pack(frame(spark, texts(2)), WORDS, packing.Settings(capacity=64, group_rows=50)).collect()
    places = collections.defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 64
    least = -(-sum(r["length"] for r in rows) // 64)
    assert len(places) <= 1.05 * least + len({s >> 32 for s in places})
    assert packing.pack(frame(spark, texts(2)).where("doc_id = -1"), WORDS).count() == 0


@pytest.mark.parametrize("capacity,seed", [(10, 1), (64, 2), (100, 3), (4096, 4)])
def test_best_fit_against_plain_search(capacity, seed):
    lengths = np.random.default_rng(seed).integers(1, capacity + 1, 400)
    sequence, offset = packing.best_fit(lengths, capacity)
    rooms, want = [], []
    for i in np.argsort(-lengths, kind="stable"):
        fits = [room for room in rooms if room >= lengths[i]]
        room = min(fits, default=capacity)
        if fits:
            rooms.remove(room)
        rooms.append(room - lengths[i])
        want.append((i, capacity - room))
    assert sorted(want) == list(enumerate(offset.tolist())) and len(rooms) == sequence.max() + 1


def test_open_sequences_find_the_tightest():
    r, opened, rooms = random.Random(1), packing.OpenSequences(37), []
    for n in range(600):
        if r.random() < 0.5:
            room = r.randrange(1, 38)
            opened.add(n, room)
            rooms.append(room)
        else:
            need = r.randrange(1, 38)
            found = opened.take(need)
            fits = [x for x in rooms if x >= need]
            assert (found is None) == (not fits)
            if fits:
                assert found[1] == min(fits)
                rooms.remove(found[1])


def attributed_brute(text, sections, rule):
    """Counts by trying every token with every section."""
    encode = attribution.encoder(BYTES)
    raw = (text or "").encode()
    place = [len((text or "")[:k].encode()) for k in range(len(text or "") + 1)]
    count, crossing, outside, at = [0] * len(sections), [0] * len(sections), 0, 0
    tokens = encode.encode_ordinary(text or "")
    for piece in encode.decode_tokens_bytes(tokens):
        a, b = at, at + len(piece)
        at = b
        share = [max(0, min(b, place[e]) - max(a, place[s])) for s, e in sections]
        for k, (s, e) in enumerate(sections):
            crossing[k] += bool(share[k]) and (a < place[s] or b > place[e])
        held = [k for k, (s, e) in enumerate(sections) if place[s] <= a < place[e]] if rule == "first" else [share.index(max(share))] if share and max(share) else []
        if held:
            count[held[0]] += 1
        else:
            outside += 1
    assert at == len(raw)
    return count, crossing, outside, len(tokens)


@pytest.mark.parametrize("rule", attribution.RULES)
def test_lines_get_their_tokens(spark, rule):
    rows = [x for x in texts(3) if x[0] is not None] + [(200, "a\n\n\n  b\n"), (201, "\n"), (202, "é\nü" * 30)]
    want = collections.Counter()
    for i, t in rows:
        sections, at = [], 0
        for line in (t.split("\n") if t else []):
            sections.append((at, at + len(line)))
            at += len(line) + 1
        count, crossing, outside, n = attributed_brute(t, sections, rule)
        for k, (s, e) in enumerate(sections):
            want[(i, k, s, e, count[k], crossing[k], n, outside)] += 1
        if not sections:
            want[(i, None, None, None, 0, 0, 0, 0)] += 1
    got = collections.Counter(tuple(r) for r in attribution.attributed(frame(spark, rows), BYTES, rule=rule).collect())
    assert got == want


def test_given_sections(spark):
    text = "Title: naïve words 123\nbody body"
    marks = [(0, 5), (9, 13), (13, 30)]
    docs = frame(spark, [(1, text), (2, None)])
    column = F.array(*(F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in marks))
    for rule in attribution.RULES:
        got = sorted((r["section"], r["n_tokens"], r["n_crossing"], r["n_outside"]) for r in attribution.attributed(docs, BYTES, column, rule).where("doc_id = 1").collect())
        count, crossing, outside, _ = attributed_brute(text, marks, rule)
        assert got == [(k, count[k], crossing[k], outside) for k in range(3)]
    with pytest.raises(ValueError):
        attribution.attributed(docs, BYTES, rule="last")


class Ranges:
    def __init__(self, data):
        self.data = data

    def read_at(self, n, at):
        return self.data[at:at + n]


@pytest.mark.parametrize("force", [False, True])
def test_zip_directories(force):
    out = io.BytesIO()
    archive = archives.StoredZip(out, force)
    for name, parts in (("a.bin", [b"one", b"two"]), ("ü", []), ("b", [b"x" * 70_000])):
        archive.begin(name)
        for p in parts:
            archive.write(p)
        archive.end()
    archive.close()
    data = out.getvalue()
    members = {m.name: data[m.start:m.start + m.size] for m in archives.read_directory(Ranges(data), len(data))}
    assert members == {"a.bin": b"onetwo", "ü": b"", "b": b"x" * 70_000}
    with zipfile.ZipFile(io.BytesIO(data)) as other:  # another reader agrees
        assert other.testzip() is None and {n: other.read(n) for n in other.namelist()} == members


def test_foreign_and_broken_archives():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("s", b"stored")
        z.comment = b"a note"
    data = out.getvalue()
    (m,) = archives.read_directory(Ranges(data), len(data))
    assert data[m.start:m.start + m.size] == b"stored"
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("d", b"x" * 1000)
    for data in (packed.getvalue(), b"no archive at all"):
        with pytest.raises(ValueError):
            archives.read_directory(Ranges(data), len(data))


def test_round_trip(spark):
    rows = [(1, "http://a", "<p>é</p>"), (2, "b c\nd", "<p>é</p>"), (3, None, None), (4, "x", ""), (5, "x", "y" * 300_000), (0, "z", "only"), (6, "z", "\r\n\r\nWARC/1.1"), (2, "b", "<p>é</p>"),
            (7, "q", "rep"), (7, "q", "rep"), (None, "n", "<p>é</p>")] + [(100 + i, "u", "same") for i in range(600)]
    pages = spark.createDataFrame([(*r, "payload?", "k") for r in rows], "page_id long, url string, html string, payload string, key string")
    heads = {}
    for i, _, h in rows:
        if i is not None:
            heads[h or ""] = min(heads.get(h or "", i), i)
    want = collections.Counter()
    for i, _, h in rows:
        raw = (h or "").encode()
        first = heads[h or ""] == i
        want[(i, len(raw), archives.digest(raw), "response" if first else "revisit", None if first else heads[h or ""], raw if first else None)] += 1
    got = archives.round_trip(pages).collect()
    assert collections.Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], None if r["payload"] is None else bytes(r["payload"])) for r in got) == want
    short = {r["page_id"]: r["record_type"] for r in archives.round_trip(pages, least=5).collect()}
    assert short[101] == "response" and short[2] == "revisit"
    assert archives.round_trip(pages.where("page_id = -5")).count() == 0


def test_pipeline(spark, tmp_path):
    """Each stage on small tables, by the same steps in plain code."""
    import corpus_pipeline
    r = random.Random(1)
    clean = [f"w{i}" for i in range(400)]
    docs = [(i, " ".join(r.choices(clean, k=60))) for i in range(80)]
    docs += [(100 + i, docs[i][1]) for i in range(5)] + [(200 + i, docs[i][1] + " extra") for i in range(5)]
    docs += [(300 + i, " ".join(r.choices(["BUY!!", "$$$$", "now###"], k=60))) for i in range(60)]
    item = " ".join(r.choices(clean, k=14))
    docs += [(400, " ".join(r.choices(clean, k=40)) + " " + item), (401, docs[61][1][:-3] + " password=hunter22 " + " ".join(r.choices(clean, k=40))), (402, None), (None, docs[70][1] + " q")]
    docs += [docs[7]]
    frame(spark, docs).drop("piece", "ids").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(not 300 <= i < 400), 0) for i, _ in docs if i is not None and i < 400], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    step, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "near duplicates", "decontamination", "secrets", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        before = step
        step = stage(spark, step, str(tmp_path)).cache()
        kept[name] = collections.Counter(x["doc_id"] for x in step.collect())
        if name != "packing":
            assert step.columns == before.columns
    good = {i for i, _ in docs if i is None or not 300 <= i < 400} - {402}
    assert {i for i in kept["quality classifier"] if i != 402} == good
    assert all(n == 1 for n in kept["near duplicates"].values())
    assert {i for i in kept["near duplicates"] if i is not None and i < 100} == set(range(80)) and not {i for i in kept["near duplicates"] if i and 100 <= i < 300}
    assert set(kept["near duplicates"]) - set(kept["decontamination"]) == {400}
    assert kept["secrets"] == kept["decontamination"] and set(kept["packing"]) == set(kept["secrets"])
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == step.count() and out.columns == step.columns


def test_pipeline_keeps_one_row_of_each_near_class(spark):
    """Ids that repeat over unrelated texts, and no ids at all."""
    import corpus_pipeline
    r = random.Random(2)
    a, b, c, d = (" ".join(r.choices([f"w{i}" for i in range(400)], k=60)) for _ in range(4))
    rows = [(1, a), (5, a), (5, b), (5, c), (7, b + " q"), (None, a + " q"), (None, d), (None, d), (None, d + " q"), (None, None), (None, ""), (5, ""), (5, None)]
    got = corpus_pipeline.keep_one_of_near(spark, frame(spark, rows).repartition(3), "").collect()
    left = collections.Counter((x["doc_id"], x["text"]) for x in got)
    (of_d,) = [x for x in left if x[1] in (d, d + " q")]
    assert left == collections.Counter([(1, a), (5, b), (5, c), of_d, (None, None), (None, ""), (5, ""), (5, None)])
