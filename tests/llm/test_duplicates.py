"""Near duplicates and repeated windows against brute force, with nulls, ties, long texts and clashing columns."""

import collections
import hashlib
import random

import numpy as np
import pytest

from georeport.llm import near, relative, repeats, suffixes

SCHEMA = "doc_id long, text string, lang string, id long, label string, doc string, runs int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", 7, "x", "y", 1) for i, t in rows], SCHEMA)


def corpus(seed, n=60):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["éa", "É", "ß"]
    rows = [(i, " ".join(r.choices(words, k=r.choice([0, 1, 3, 40, 90])))) for i in range(n)]
    base = [w for w in r.choices(words, k=120)]
    for i in range(n, n + 40):
        copy = list(base)
        for _ in range(r.choice([0, 1, 4, 9, 14])):
            copy[r.randrange(len(copy))] = r.choice(words)
        rows.append((i, " ".join(copy)))
    passage = " ".join(r.choices(words, k=70))
    rows += [(200 + i, f"{' '.join(r.choices(words, k=r.randrange(30)))}\n{passage}  {' '.join(r.choices(words, k=20))}") for i in range(12)]
    rows += [(300, None), (301, ""), (302, " \t\n"), (303, "ab " * 900), (304, "Ab " * 900), (305, "x" * 2000), (306, rows[5][1]), (307, rows[70][1]), (307, rows[70][1])]
    r.shuffle(rows)
    return rows


def sets_of(text, width):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + width]) for i in range(len(words) - width + 1)) if len(words) >= width else frozenset([tuple(words)])


def brute_classes(rows, width, percent):
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(i, sets_of(t, width)) for i, t in rows]
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            both = len(a & b)
            if a and b and 100 * both >= percent * (len(a) + len(b) - both):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {i: (len(s), find(i)) for i, s in sets}


@pytest.mark.parametrize("width,percent,seed", [(2, 80, 1), (5, 80, 2), (2, 60, 3)])
def test_classes(spark, width, percent, seed):
    rows = corpus(seed)
    settings = near.Settings(width=width, percent=percent, bands=45 if percent == 80 else 90, rows=5 if percent == 80 else 3)
    got = near.linked_classes(frame(spark, rows), settings).collect()
    assert len(got) == len(rows)
    want = brute_classes(rows, width, percent)
    assert {r["id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["id"] == r["component_id"]) for r in got)


def test_star_centre_leaves_links_to_the_prefix_join(spark):
    """The smallest id links with nobody, the others of its buckets do."""
    r = random.Random(9)
    base = [f"b{i}" for i in range(200)]
    rows = [(0, " ".join(base[:150] + [f"z{i}" for i in range(70)]))]
    for i in range(1, 30):
        copy = list(base)
        for _ in range(6):
            copy[r.randrange(200)] = f"c{r.randrange(10_000)}"
        rows.append((i, " ".join(copy)))
    got = {r["id"]: r["component_id"] for r in near.linked_classes(frame(spark, rows), near.Settings(width=2)).collect()}
    assert got == {i: c for i, (_, c) in brute_classes(rows, 2, 80).items()}


def test_prefix_pairs_leave_nothing_out(spark):
    r = random.Random(4)
    sets = {i: sorted(r.sample(range(60), r.randrange(20, 40))) for i in range(40)}
    for i in range(40, 60):
        sets[i] = sorted(set(sets[i - 40]) ^ set(r.sample(range(60), 5)))
    table = spark.createDataFrame(list(sets.items()), "id long, shingles array<long>")
    nodes = spark.createDataFrame([(i, i % 7) for i in sets], "head long, label long")
    pairs = {(x["a"], x["b"]) for x in near.prefix_pairs(nodes, table, 70).collect()}
    for a in sets:
        for b in sets:
            both = len(set(sets[a]) & set(sets[b]))
            if a < b and a % 7 != b % 7 and 100 * both >= 70 * (len(sets[a]) + len(sets[b]) - both):
                assert (a, b) in pairs
    links = {(x["a"], x["b"]) for x in near.confirmed(near.prefix_pairs(nodes, table, 70), table, 70).collect()}
    assert links <= pairs and links


def test_long_chain_is_one_class(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(70)] + [(100, 101), (3, 3)], "a long, b long")
    got = {r["id"]: r["label"] for r in near.classes(edges).collect()}
    assert got == {**{i: 0 for i in range(71)}, 100: 100, 101: 100}


def test_null_id_and_empty_table(spark):
    got = near.linked_classes(frame(spark, [(None, "a b c"), (2, "a b c"), (None, None)])).collect()
    assert sorted((r["id"] or -1, r["component_id"], r["kept"]) for r in got) == [(-1, None, True), (-1, None, True), (2, 2, True)]
    empty = frame(spark, [(1, "a")]).where("doc_id > 5")
    assert near.linked_classes(empty).count() == 0
    assert suffixes.removed(empty).count() == 0 and relative.parsed(empty).count() == 0


def removed_brute(sequences, width):
    seen = collections.Counter(tuple(s[p:p + width]) for s in sequences for p in range(len(s) - width + 1))
    for s in sequences:
        out = np.zeros(len(s), bool)
        for p in range(len(s) - width + 1):
            if seen[tuple(s[p:p + width])] > 1:
                out[p:p + width] = True
        yield out


@pytest.mark.parametrize("least,seed", [(400, 1), (100, 2), (9, 3), (1, 4)])
def test_removed_bytes(spark, least, seed):
    rows = corpus(seed, 30)
    want = collections.Counter()
    for (i, t), out in zip(rows, removed_brute([(t or "").encode() for _, t in rows], least)):
        kept = bytes(np.frombuffer((t or "").encode(), np.uint8)[~out])
        spans = int((np.diff(np.concatenate([[0], out.astype(int)])) == 1).sum())
        want[(i, len(out), int(out.sum()), spans, hashlib.sha256(kept).hexdigest())] += 1
    got = collections.Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffixes.removed(frame(spark, rows), least).collect())
    assert got == want


@pytest.mark.parametrize("least,seed", [(35, 1), (6, 2), (2, 3)])
def test_removed_words(spark, least, seed):
    rows = corpus(seed, 30)
    want = collections.Counter()
    texts = [(t or "").encode().split() for _, t in rows]
    for (i, _), words, out in zip(rows, texts, removed_brute(texts, least)):
        kept = b" ".join(w for w, x in zip(words, out) if not x)
        want[(i, len(words), int(out.sum()), hashlib.sha256(kept).hexdigest())] += 1
    found = relative.parsed(frame(spark, rows), least).collect()
    assert collections.Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in found) == want
    text = {}
    for (i, _), words in zip(rows, texts):
        text[i] = words
    for r in found:  # factors point to equal words
        for f in r["factors"]:
            own = text[r["doc_id"]][f["start"]:f["start"] + f["length"]]
            assert own == text[f["from_doc"]][f["from_start"]:f["from_start"] + f["length"]] and own


def test_first_copy_stays(spark):
    """keep="first" takes each byte whose window stands at a smaller place, and nothing else."""
    rows = [(i, t) for i, t in corpus(5, 30) if i != 307]
    least, order = 60, sorted(((i, (t or "").encode()) for i, t in rows))
    first = {}
    for i, s in order:
        for p in range(len(s) - least + 1):
            first.setdefault(s[p:p + least], (i, p))
    want = {}
    for i, s in order:
        out = np.zeros(len(s), bool)
        for p in range(len(s) - least + 1):
            if first[s[p:p + least]] != (i, p):
                out[p:p + least] = True
        want[i] = int(out.sum())
    got = {r["doc_id"]: r["n_removed"] for r in suffixes.removed(frame(spark, rows), least, "first").collect()}
    assert got == want
    found = suffixes.repeated(frame(spark, rows), least)
    text = dict(order)
    factors = suffixes.previous_factors(found, least).collect()
    assert factors
    for f in factors:
        own = text[f["doc"]][f["start"]:f["start"] + f["length"]]
        assert len(own) == f["length"] >= least and own == text[f["from_doc"]][f["from_start"]:f["from_start"] + f["length"]]
        assert (f["from_doc"], f["from_start"]) < (f["doc"], f["start"])


def test_segments_cover_each_window_once():
    codes = np.random.default_rng(1).integers(0, 4, 500).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    off = np.array([0, 3, 3, 120, 500])
    row, anchor, lo, hi = repeats.segments(codes, off, repeats.Settings(20, 5, ()))
    starts = sorted(p for a, b in zip(lo, hi) for p in range(a, b + 1))
    assert starts == [p for a, b in zip(off[:-1], off[1:]) for p in range(a, b - 19)]
    assert all(off[r] <= a <= b and b + 20 <= off[r + 1] and b <= x <= a + 15 for r, x, a, b in zip(row, anchor, lo, hi))


def test_keep_is_checked(spark):
    with pytest.raises(ValueError):
        suffixes.removed(frame(spark, [(1, "a")]), 5, "last")




def changed_copies(n, seed, words=400):
    """Copies of one text with 4 to 6 changed words each: many pairs are just below the threshold, none is equal to the text."""
    rnd = random.Random(seed)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(words)]
    rows = []
    for i in range(n):
        text = list(base)
        for at in rnd.sample(range(words), rnd.choice([4, 5, 6])):
            text[at] = f"x{i}n{at}"
        rows.append((i, " ".join(text)))
    return rows


def test_changed_copies_meet_in_proportion(spark, monkeypatch):
    """Twice the copies make two to three times the compared pairs, not four, and the classes are those of all pairs."""
    plain, met = near.confirmed, []

    def counted(pairs, sets, percent):
        met.append(pairs.count())
        return plain(pairs, sets, percent)

    monkeypatch.setattr(near, "confirmed", counted)
    totals = []
    for n in (600, 1200):
        met.clear()
        rows = changed_copies(n, 8)
        got = {r["id"]: r["component_id"] for r in near.linked_classes(frame(spark, rows), near.Settings(width=5)).collect()}
        totals.append(sum(met))
        if n < 1200:
            assert got == {i: x[1] for i, x in brute_classes(rows, 5, 80).items()}
        else:
            assert len(set(got.values())) == 1
    assert totals[1] < 3 * totals[0] and totals[1] < 1200 * 1199 / 2 / 30
