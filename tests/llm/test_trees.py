"""Prefix trie of conversations and Merkle manifest against plain code."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from georeport.llm import merkle, prefixes

CONV = "conv_id long, turn long, role string, text string"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def crc(x):
    return zlib.crc32(str(x).encode())


def plain_rebuilt(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            convs[c].append(((turn is not None, turn or 0), role, digest, text))
    convs = {c: [(t[1], t[3]) for t in sorted(v)] for c, v in convs.items()}
    return {c: convs.get(c - c % 20, [])[:crc(c) % 4] + convs[c][crc(c) % 4:] for c in convs}


def plain_trie(convs):
    members = defaultdict(list)
    for c, turns in sorted(convs.items()):
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)

    def under(node):
        yield node
        for x in children[node]:
            yield from under(x)

    out = set()
    for node, own in members.items():
        below = list(under(node))
        words = sum((len(members[x]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", x[-1][1])) for x in below if x)
        ends = ",".join(str(c) for c in own if len(convs[c]) == len(node))
        out.add((own[0], len(node), members[node[:-1]][0] if node else None, len(own), len(children[node]), sum(not children[x] for x in below), words,
                 hashlib.sha256(ends.encode()).hexdigest()))
    return out


def conversations(n, seed):
    rnd = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rnd.choice([1, 2, 3, 3, 4, 9])):
            rows.append((c, t, rnd.choice(["user", "assistant", None]), rnd.choice(["a b", "a  c\td", "", None, "common turn"])))
    for c in range(n, n + 30):  # copies and ever longer ones
        rows += [(c, t, "user", "same") for t in range(3)]
    for c in range(n + 30, n + 60):
        rows += [(c, t, "user", f"long {t}") for t in range(c - n)]
    rows += [(n + 70, None, "user", "null first"), (n + 70, 0, "user", "x"), (n + 70, 0, "user", "x"), (None, 0, "user", "nobody"), (n + 71, None, None, None)]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [8192, 64, 7, 3])
def test_trie_equals_plain_code(spark, block):
    rows = conversations(150, block)
    table = spark.createDataFrame(rows, CONV).withColumn("path", F.lit("clash")).withColumn("n", F.lit(1))
    got = prefixes.prefix_trie(prefixes.rebuilt(prefixes.paths(table)), block).collect()
    want = plain_trie(plain_rebuilt(rows))
    assert len(got) == len(want)
    assert {tuple(r) for r in got} == want


def test_trie_of_no_and_of_one_conversation(spark):
    assert prefixes.prefix_trie(prefixes.paths(spark.createDataFrame([], CONV))).collect() == []
    one = prefixes.prefix_trie(prefixes.paths(spark.createDataFrame([(5, 0, "user", "a b")], CONV))).collect()
    assert {tuple(r) for r in one} == plain_trie({5: [("user", "a b")]})


def test_deep_conversations_share_blocks(spark):
    """Paths of 300 turns that part near their ends, cut in blocks of few rows."""
    rows = [(c, t, "user", f"t{t}" if t < 290 else f"{c % 7} {t}") for c in range(40) for t in range(300)]
    convs = defaultdict(list)
    for c, _, role, text in rows:
        convs[c].append((role, text))
    got = prefixes.prefix_trie(prefixes.paths(spark.createDataFrame(rows, CONV)), 5).collect()
    want = set()
    for d in range(301):
        for c in range(40 if d == 0 else 7):
            if d <= 290 and c:
                continue
            same = [x for x in range(40) if d <= 290 or x % 7 == c]
            parent = None if d == 0 else (0 if d <= 291 else c)
            want.add((c, d, parent, len(same)))
    assert {(r.conv_id, r.depth, r.parent_conv_id, r.n_convs) for r in got} == want
    assert {r.n_leaves for r in got if r.depth <= 290} == {7}


def h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row, text):
    fields = [row["doc_id"], row["source"], row["lang"], row["n_chars"], text]
    return h("-" if x is None else f"{len(str(x).encode())}:{x}" for x in fields)


def folded(levels, i, new):
    for level in levels[:-1]:
        lo = i - i % 3
        run = level[lo:lo + 3]
        run[i - lo] = new
        new, i = h(run), i // 3
    return new


def plain_tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h(levels[-1][i:i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def plain_manifest(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r["source"]].append((r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r, r["text"]), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_tree([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in names}
    top = plain_tree([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, (_, _, digest, r) in enumerate(sorted(groups[s], key=lambda x: x[:3])):
            proof, place = [], i
            for levels, at in ((trees[s], i), (top, k)):
                for level in levels[:-1]:
                    lo = at - at % 3
                    proof += level[lo:at] + level[at + 1:lo + 3]
                    at //= 3
            text = r["text"]
            if r["doc_id"] is not None and crc(r["doc_id"]) % 2 == 0 and text is not None:
                text = text.replace("\n", "")
            new = folded(top, k, folded(trees[s], place, plain_leaf(r, text)))
            out.append((r["doc_id"], digest, trees[s][-1][0], top[-1][0], h(proof), new, new == top[-1][0]))
    return out


def documents(n, sources, seed):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        text = rnd.choice([None, "", "plain", "two\nlines", "é\n\nü", "x" * 5000 + "\n"])
        rows.append(dict(doc_id=i, text=text, lang=rnd.choice([None, "de"]), source=rnd.choice(sources), n_chars=rnd.choice([None, 3])))
    rows += [dict(doc_id=None, text="a\nb", lang="x", source=sources[0], n_chars=1)] * 2 + [dict(doc_id=3, text="a\nb", lang="x", source=sources[0], n_chars=1)] * 3
    return rows


@pytest.mark.parametrize("n, sources, height", [(400, ["a", "b", "ä", None], 2), (200, ["one"], 1), (90, [f"s{i}" for i in range(40)], 1), (300, ["a", "a", "a", "z"], 6), (1, [None], 3)])
def test_manifest_equals_plain_code(spark, n, sources, height):
    rows = documents(n, sources, n)
    docs = spark.createDataFrame([(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in rows], DOCS).withColumn("place", F.lit(1)).withColumn("above", F.lit("x"))
    tree = merkle.manifest(merkle.document_leaves(docs), merkle.Settings(height=height))
    got = merkle.versions(tree, nodes=True).collect()
    assert sorted(map(str, (tuple(r)[:7] for r in got))) == sorted(map(str, plain_manifest(rows)))
    # A version copies its ancestors and nothing else; its last node is its root.
    assert {len(r.copied) for r in got if r.copied} <= set(range(1, 20))
    assert all(r.copied[-1] == r.folded_root for r in got if r.copied)
    assert all(r.verified == (not r.copied) for r in got if n > 1)


def test_manifest_of_nothing(spark):
    assert merkle.versions(merkle.manifest(merkle.document_leaves(spark.createDataFrame([], DOCS)))).collect() == []
