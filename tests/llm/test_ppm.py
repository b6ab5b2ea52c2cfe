"""Partial matching against a plain dictionary form of the same model."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from georeport.llm import ppm

SCHEMA = "doc_id long, text string"


def plain_model(texts, order):
    trie = defaultdict(Counter)
    for text in texts:
        led = b"\xfe" * order + text + b"\xff"
        for at in range(order, len(led)):
            for k in range(order + 1):
                trie[led[at - k:at]][led[at]] += 1
    return trie


def plain_log_p(trie, text, order):
    led, out = b"\xfe" * order + text + b"\xff", 0.0
    for at in range(order, len(led)):
        excluded = set()
        for k in range(order, -1, -1):
            n = {s: c for s, c in trie.get(led[at - k:at], {}).items() if s not in excluded}
            if not n:
                continue
            if led[at] in n:
                out += math.log10(n[led[at]] / (sum(n.values()) + len(n)))
                break
            out += math.log10(len(n) / (sum(n.values()) + len(n)))
            excluded |= set(n)
        else:
            out -= math.log10(255 - len(excluded))
    return out


def corpus(seed, n=120):
    rnd = random.Random(seed)
    words = ["the", "The", "cat", "sät", "on", "mat", "mât", "日本", "a", "zebra", "\U0001F600"]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(rnd.choice([1, 3, 8, 40])))) for i in range(n)]
    return rows + [(n, ""), (n + 1, None), (None, "the cat"), (5, "a repeated id"), (5, "a repeated id"), (n + 2, "\x00\t\n odd \x7f"), (n + 3, "word " * 30000), (n + 8, "qqq###qqq")]


def is_held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


@pytest.mark.parametrize("order, hot, shard", [(4, 1_000_000, 4_000_000), (2, 30, 10), (3, 0, 5), (6, 12, 50)])
def test_scores_equal_plain_code(spark, order, hot, shard, monkeypatch):
    monkeypatch.setattr(ppm, "CHUNK", 1 << 16)
    rows = corpus(order)
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("n", F.lit(1)).withColumn("key", F.lit("clash"))
    model = ppm.train(docs.where(~ppm.held_out(F.col("doc_id"))), ppm.Settings(order, hot, shard))
    assert (shard > 1000) == (max(map(int, model.shards.split(","))) == 0)
    got = ppm.scores(docs, model, keep=("doc_id", "n")).collect()
    assert len(got) == len(rows)
    learned = [(t or "").encode() for i, t in rows if not is_held_out(i)]
    trie = plain_model(learned, order)

    def words(b):
        return re.findall(rb"[^\x20\x09-\x0D]+", b.lower()) + [None]

    count = Counter(w for b in learned for w in words(b))
    total = sum(count.values())
    want = Counter()
    for i, text in rows:
        b = (text or "").encode()
        base = sum(math.log10((count[w] + 1) / (total + len(count) + 1)) for w in words(b))
        want[(i, len(words(b)), sum(count[w] > 0 for w in words(b)), total, round(base, 5), round(plain_log_p(trie, b, order), 5))] += 1
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5), round(r.score, 5)) for r in got) == want


def test_chances_of_a_byte_sum_to_at_most_one(spark):
    docs = spark.createDataFrame([(i, t) for i, t in corpus(9) if t and len(t) < 1000], SCHEMA)
    model = ppm.train(docs, ppm.Settings(3))
    keys, n = (np.array(x) for x in zip(*((r.key, r.n) for r in model.runs.collect())))
    trie = ppm.Trie(keys.astype(np.uint64), n.astype(float), 3, model.one)
    for context in (b"the", b"zzz", b"\xfe\xfec", b"at "):
        codes = np.array([int.from_bytes(context + bytes([s]), "big") for s in range(256) if s != ppm.LEAD], np.uint64)
        assert 0.9 < (10 ** trie.log_p(codes)).sum() < 1 + 1e-9


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "ab"), (2, None)], SCHEMA)
    model = ppm.train(docs.limit(0))
    got = {r.doc_id: r for r in ppm.scores(docs, model).collect()}
    assert got[1].score == pytest.approx(-3 * math.log10(255)) and got[1].train_tokens == 0 and got[1].n_known == 0
    assert got[2].score == pytest.approx(-math.log10(255)) and got[2].base_score == 0.0
    assert ppm.scores(docs.limit(0), model).collect() == []


def test_adaptive_length_tells_repetition(spark):
    rnd = random.Random(1)
    docs = spark.createDataFrame([(1, "abcdef " * 50), (2, "".join(chr(rnd.randrange(33, 126)) for _ in range(350))), (3, None)], SCHEMA)
    got = {r.doc_id: r for r in ppm.adaptive_bits(docs).collect()}
    assert got[1].n_bytes == got[2].n_bytes == 350 and got[1].adaptive_bits < got[2].adaptive_bits / 4
    assert got[3].adaptive_bits == pytest.approx(math.log2(255))


def test_language_learned_is_likelier(spark):
    """Held-out texts: the model beats word counts where words are new, and a text in its own order beats a shuffled one."""
    rnd = random.Random(3)
    rows = [(i, " ".join(rnd.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(30))) for i in range(200)]
    model = ppm.train(spark.createDataFrame(rows[:150], SCHEMA))
    own = [t for _, t in rows[150:]]
    mixed = ["".join(rnd.sample(t, len(t))) for t in own]
    got = ppm.scores(spark.createDataFrame([(i, t) for i, t in enumerate(own + mixed)], SCHEMA), model).collect()
    score = {r.doc_id: r.score for r in got}
    assert all(score[i] > score[i + 50] / 3 for i in range(50))
