"""Decontamination, secrets, rules and classifier against brute force and on odd input."""

import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from georeport.llm import leaks, quality, rules, secrets
from georeport.llm import textops as T

SCHEMA = "doc_id long, text string, lang string, row_id long, score double, w int, rules int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", 7, 0.1, 1, 2) for i, t in rows], SCHEMA)


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))


def leak_case(seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["Éa", "éA", "naïve", "THE", "x_y"]
    items = [(i, " ".join(r.choices(vocabulary, k=r.choice([0, 1, 4, 10, 14, 30])))) for i in range(15)] + [(90, None), (91, "... !"), (92, "zz zz zz"), (93, "w1 w1")]
    docs = []
    for i in range(60):
        body = r.choices(vocabulary, k=r.randrange(60))
        if i % 3 == 0:
            body += (items[r.randrange(15)][1] or "").lower().split() + r.choices(vocabulary, k=5)
        docs.append((i, r.choice([" ", ", ", "\n"]).join(body)))
    docs += [(100, None), (101, ""), (102, "?!"), (103, "zz " * 3000), (7, docs[7][1]), (8, "another text under a used id w1 w1")]
    return items, docs


@pytest.mark.parametrize("seed,width", [(1, 10), (2, 3)])
def test_leaks(spark, seed, width):
    items, docs = leak_case(seed)
    windows = collections.defaultdict(set)
    for i, t in items:
        w = words_of(t)
        for p in range(max(1, len(w) - width + 1)) if w else ():
            windows[tuple(w[p:p + width])].add(str(i))
    want = collections.Counter()
    for i, t in docs:
        w = words_of(t)
        hit, found = set(), set()
        for phrase, ids in windows.items():
            for p in range(len(w) - len(phrase) + 1):
                if tuple(w[p:p + len(phrase)]) == phrase:
                    hit |= set(range(p, p + len(phrase)))
                    found |= ids
        want[(i, len(w), len(hit), tuple(sorted(found)), bool(hit))] += 1
    items = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    got = leaks.decontaminate(frame(spark, docs), items, width).collect()
    assert collections.Counter((r["row_id"], r["n_words"], r["n_hit"], tuple(r["items"]), r["contaminated"]) for r in got) == want


def test_index_in_parts_and_proximity(spark):
    items = spark.createDataFrame([(1, "red green blue"), (2, "one two")], "item_id long, text string")
    docs = frame(spark, [(1, "red green blue"), (2, "red big green blue"), (3, "blue one x y z two"), (None, "Red green blue one two")])
    phrases, _, index = leaks.build(docs, items, 10)
    assert {(r["row_id"], r["start"], r["length"]) for r in leaks.phrase_matches(index, phrases).collect()} == {(1, 0, 3), (None, 0, 3), (None, 3, 2)}
    terms = index.groupBy("term").agg(F.max(F.col("near").isNotNull()).alias("leads"))
    several = leaks.postings(leaks.keyed(docs), terms, 3, part_bytes=8)
    assert sorted(map(str, several.collect())) == sorted(map(str, index.collect()))
    near = {(r["row_id"], r["start"], r["other"]) for r in leaks.proximity_matches(index, phrases, 3).collect()}
    assert {(1, 0, 0), (3, 1, 4)} <= {(a, min(b, c), max(b, c)) for a, b, c in near} and all(abs(b - c) <= 3 for _, b, c in near)


def test_leaks_of_empty_tables(spark):
    items = spark.createDataFrame([], "item_id long, text string")
    docs = frame(spark, [(1, "a b"), (2, None)])
    assert [(r["row_id"], r["n_words"], r["n_hit"]) for r in leaks.decontaminate(docs, items).orderBy("row_id").collect()] == [(1, 2, 0), (2, 0, 0)]
    assert leaks.decontaminate(docs.where("doc_id > 9"), spark.createDataFrame([(1, "a")], "item_id long, text string")).count() == 0


def spans_brute(text, rules_):
    out = []
    for rank, r in enumerate(rules_):
        for m in re.finditer(r.pattern, text or "", re.ASCII):
            if len(m.group(r.group)) >= r.least:
                out.append((m.start(), rank, m.end(), r.kind))
    return sorted(out)


SECRETS = ["password=hunter22", "PassWd: 'abc/def+1='", "secret=token:abcdefgh", "api_key = \"k9\"", "apikey:ABCDEF", "AKIA" + "A1" * 8, "AKIA" + "B" * 15, "f" * 24, "0" * 23,
           "deadbeef" * 5, "token==abcde", "ſecret=abcdefg", "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a1B" * 12, "xoxb-1234567890-abc", "eyJhbGciOi12.eyJzdWIiOi12.abcdefgh12"]


def secret_docs(seed):
    r = random.Random(seed)
    docs = []
    for i in range(50):
        body = r.choices(["plain", "wörter", "😀", "key", "pass", "AKI", "Token", "the secret of"] + SECRETS, k=r.randrange(12))
        docs.append((i, r.choice([" ", "\n", ""]).join(body)))
    return docs + [(60, None), (61, ""), (62, "a" * 30_000), (5, docs[5][1]), (6, "password=under-a-used-id"), (None, "token: abcdef1")]


def test_secrets(spark):
    docs = secret_docs(3)
    want = collections.Counter()
    for i, t in docs:
        found = spans_brute(t, secrets.RULES)
        said = [f"{k}:{a}:{b}" for a, _, b, k in found]
        base = [s for s in said if s.split(":")[0] in secrets.BASE]
        want[(i, *(sum(s.startswith(k + ":") for s in base) for k in secrets.BASE), ",".join(base), ",".join(said))] += 1
    got = secrets.scan(frame(spark, docs)).collect()
    assert collections.Counter((r["row_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base"], r["spans"]) for r in got) == want


def test_redaction(spark):
    docs = [d for d in secret_docs(4)]
    want = collections.Counter()
    for i, t in docs:
        merged = []
        for a, _, b, _ in spans_brute(t, secrets.RULES):
            if merged and a < merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        out, at = "", 0
        for a, b in merged:
            out, at = out + t[at:a] + "[secret]", b
        want[(i, None if t is None else out + t[at:])] += 1
    found = secrets.redacted(frame(spark, docs))
    assert found.columns == frame(spark, docs).columns
    assert collections.Counter((r["doc_id"], r["text"]) for r in found.collect()) == want


def test_trigram_queries_are_mandatory():
    assert secrets.trigram_query(r"[0-9a-f]{24,}") == []
    assert secrets.trigram_query("AKIA[A-Z]+") == [[["aki", "kia"]]]
    assert secrets.trigram_query("ab?cd") == [] or all(secrets.trigram_query("ab?cd"))
    for rule in secrets.RULES:
        for text in SECRETS:
            if re.search(rule.pattern, text, re.ASCII):
                held = text.lower()
                assert all(any(all(g in held for g in gs) for gs in any_of) for any_of in secrets.trigram_query(rule.pattern)), (rule.kind, text)


def test_empty_secret_tables(spark):
    assert secrets.scan(frame(spark, [(1, "x")]).where("doc_id > 1")).count() == 0
    assert secrets.redacted(frame(spark, [(1, "x")])).collect()[0]["text"] == "x"


def rule_counts(text):
    text = text or ""
    words = text.encode().split()
    lines = [x for x in text.split("\n") if x.encode().split()]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    triples = collections.Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    hit = {i + k for i in range(len(words) - 2) if triples[tuple(words[i:i + 3])] > 1 for k in range(3)}
    return len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


def test_rule_statistics(spark):
    r = random.Random(2)
    docs = [(i, r.choice([" ", "\n", "  \n\n"]).join(r.choices(["a", "bé", "##", "x|y", "long word", " ", "É%"], k=r.randrange(40)))) for i in range(80)]
    docs += [(100, None), (101, ""), (102, "\n\n"), (103, "a b c a b c"), (103, "a b c a b c"), (104, "z " * 20_000), (105, "same\nsame\nsame"), (None, "q\nq")]
    got = rules.statistics(frame(spark, docs)).collect()
    want = collections.Counter((i, *rule_counts(t)) for i, t in docs)
    assert collections.Counter((r["doc_id"], *(r[c] for c in rules.COUNTS[:5])) for r in got) == want


def test_forest_sets_odd_rows_apart(spark):
    r = random.Random(1)
    docs = [(i, " ".join(r.choices([f"w{k}" for k in range(500)], k=80)) + ".") for i in range(300)] + [(1000 + i, " ".join(r.choices([f"w{k}##$$" for k in range(500)], k=80))) for i in range(12)]
    labels = spark.createDataFrame([(i, int(i < 1000), 0) for i, _ in docs] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    stats = rules.statistics(frame(spark, docs))
    forest = rules.fit_forest(stats)
    scored = rules.anomaly(stats, forest)
    cut = rules.threshold(scored, labels)
    odd = [r["doc_id"] for r in scored.where(F.col("anomaly") >= cut).collect()]
    assert odd and sum(i >= 1000 for i in odd) > 4 * sum(i < 1000 for i in odd)
    mean = {r["odd"]: r["m"] for r in scored.groupBy((F.col("doc_id") >= 1000).alias("odd")).agg(F.avg("anomaly").alias("m")).collect()}
    assert mean[True] > mean[False] + 0.15
    # Path lengths by walking one row at a time.
    row = np.array([[6.0, 2.0, 0.0, 0.0, 0.0]])
    total = 0.0
    for feature, side, left, path in forest.trees:
        at = 0
        while feature[at] >= 0:
            at = left[at] + int(row[0][feature[at]] > side[at])
        total += path[at]
    assert forest.scores(row)[0] == pytest.approx(2 ** (-total / len(forest.trees) / forest.expected))


def test_forest_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    stats = rules.statistics(frame(spark, [(1, "a " * 60), (2, None)]))
    scored = rules.anomaly(stats, rules.fit_forest(stats))
    assert rules.threshold(scored, none) == float("inf") and scored.count() == 2
    empty = stats.where("doc_id > 5")
    assert rules.anomaly(empty, rules.fit_forest(empty)).count() == 0


def test_classifier(spark):
    r = random.Random(3)
    good = [(i, " ".join(r.choices(["the", "red", "fox", "runs", "far"], k=40))) for i in range(150)]
    bad = [(500 + i, " ".join(r.choices(["BUY!!", "now##", "$$$", "CLICK"], k=40))) for i in range(150)]
    docs = frame(spark, good + bad + [(900, None), (901, ""), (902, "red " * 30_000), (3, good[3][1])])
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad] + [(None, 1, 0), (900, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.train_on_labels(docs, labels)
    scored = quality.score(docs, model).collect()
    assert len(scored) == 304 and all(0 <= r["score"] <= 1 for r in scored)
    by_id = {r["doc_id"]: r["score"] for r in scored}
    held = {r["doc_id"] for r in docs.where(quality.held_out(F.col("doc_id"))).collect()}
    assert all((by_id[i] >= 0.7) == (i < 500) for i in by_id if i in held and i < 900)
    assert by_id[900] == by_id[901]
    flipped = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality.train_on_labels(docs, flipped)  # held-out labels are not read
    assert np.array_equal(again.weights, model.weights) and again.bias == model.bias


def test_classifier_without_labels(spark):
    docs = frame(spark, [(1, "a b")])
    model = quality.train_on_labels(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert quality.score(docs, model).collect()[0]["score"] == 0.5


def test_features_match_a_plain_reading():
    text = "AB c!! c 12ab é"
    buf = np.frombuffer(text.encode(), np.uint8)
    slot, row, n = quality.features(buf, np.array([0, len(buf)]), 1 << 18)
    assert n.tolist() == [7] and len(slot) == 7 + 6 + 7 + 6 and set(row.tolist()) == {0}


def test_word_spans_and_hashes():
    texts = ["a bb", "", " x", "yy ", "bb"]
    raw = "".join(texts).encode()
    off = np.cumsum([0] + [len(t) for t in texts])
    starts, ends, first = T.word_spans(np.frombuffer(raw, np.uint8), off)
    assert [raw[a:b] for a, b in zip(starts, ends)] == [b"a", b"bb", b"x", b"yy", b"bb"] and first.tolist() == [0, 2, 2, 3, 4, 5]
    hashes = T.word_hashes(np.frombuffer(raw, np.uint8), starts, ends)
    assert hashes[1] == hashes[4] and len(set(hashes.tolist())) == 4
