"""Joint choice against full enumeration, diagnostics at their limits, narrowing."""

import itertools
import math
import random
import tracemalloc

import numpy as np
import pyarrow as pa

from georeport.operators import context, scoring
from georeport.params import Scoring

CAND = "event_id string, loc_no int, row_no long, cid long, lat double, lon double, region string, grp string, qid string, unary double"


def _km(a, b):
    p1, l1, p2, l2 = map(math.radians, (a[4], a[5], b[4], b[5]))
    h = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin((l2 - l1) / 2) ** 2
    return 2 * 6371.0088 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def _pair(a, b):
    s = 0.0
    if a[6] and b[6]:
        s += 1.0 if a[6] == b[6] else -1.0
    if a[7] and b[7]:
        s += 0.5 if a[7] == b[7] else -0.25
    d = _km(a, b)
    return s + 2 * (1.0 if d <= 15 else 1 - (d - 15) / 35 if d <= 50 else -min((d - 50) / 50, 1.0))


def _rows():
    rnd = random.Random(3)
    rows = []
    for e in range(12):
        for loc in range(rnd.randint(1, 3)):
            for c in range(rnd.choice([1, 2, 3])):
                n = e * 100 + loc * 10 + c
                rows.append((f"e{e}", loc, n, n, rnd.uniform(47, 48), rnd.uniform(30, 31), rnd.choice(["a", "b", "", None]), rnd.choice(["x", "y", None]), None, rnd.uniform(0, 1)))
    return rows


def test_beam_is_exhaustive_when_it_can_be(spark):
    rows = _rows()
    chosen = scoring.choose_places(spark.createDataFrame(rows, CAND)).collect()
    got = {r["event_id"]: (r["score"], {p["loc_no"]: p["cid"] for p in r["picks"]}) for r in chosen}
    for e in {r[0] for r in rows}:
        locs = [list(g) for _, g in itertools.groupby(sorted((r for r in rows if r[0] == e), key=lambda r: r[1]), key=lambda r: r[1])]
        best = max(itertools.product(*locs), key=lambda t: sum(x[9] for x in t) + sum(_pair(a, b) for a, b in itertools.combinations(t, 2)))
        score = sum(x[9] for x in best) + sum(_pair(a, b) for a, b in itertools.combinations(best, 2))
        assert math.isclose(got[e][0], score, abs_tol=1e-8)
        assert got[e][1] == {x[1]: x[3] for x in best}


def test_ties_go_to_the_earlier_candidate(spark):
    rows = [("e", loc, 10 * loc + c, 10 * loc + c, 48.0, 31.0, None, None, "Q1", 0.0) for loc in (0, 1) for c in (2, 1, 0)]
    chosen = scoring.choose_places(spark.createDataFrame(rows, CAND))
    assert [p["cid"] for p in chosen.first()["picks"]] == [0, 10]
    d = scoring.diagnostics(chosen).first()
    assert d["duplicate_qids"][0]["loc_nos"] == [0, 1] and d["bbox_km"] == 0.0 and d["structural_outliers"] == []


def _candidates(sizes, seed):
    """Rows of one event in order, ``sizes`` places per mention."""
    rng = np.random.default_rng(seed)
    n = sum(sizes)
    lat, lon = rng.uniform(47, 49, n), rng.uniform(30, 33, n)
    return pa.table({"event_id": ["e"] * n, "loc_no": np.repeat(np.arange(len(sizes)), sizes), "row_no": np.arange(n), "cid": np.arange(n), "lat": lat, "lon": lon,
                     "rlat": np.radians(lat), "rlon": np.radians(lon), "clat": np.cos(np.radians(lat)), "region": pa.array([f"r{i % 7}" for i in range(n)]),
                     "grp": pa.array([None] * n, pa.string()), "qid": pa.array([None] * n, pa.string()), "unary": np.round(rng.uniform(0, 1, n), 2)})


def _whole_beam(table, sizes, width=50):
    """All extensions at once."""
    rows, score, picks = scoring._Rows(table, Scoring()), np.zeros(1), np.zeros((1, 0), np.int64)
    ends = np.cumsum(sizes)
    for cands in (np.arange(b - n, b) for n, b in zip(sizes, ends)):
        grown = score[:, None] + rows.unary[cands][None, :]
        for j in range(picks.shape[1]):
            grown = grown + rows.pairs(picks[:, j, None], cands[None, :])
        best = np.argsort(-np.round(grown.ravel(), 9), kind="stable")[:width]
        picks, score = np.hstack([picks[best // len(cands)], cands[best % len(cands)][:, None]]), grown.ravel()[best]
    return picks[0], score[0]


def test_slices_choose_what_the_whole_search_does(monkeypatch):
    monkeypatch.setattr(scoring, "SLICE", 13)
    sizes = [1, 40, 3, 90, 25]
    table = _candidates(sizes, 4)
    search, every, start = scoring._Search(50), scoring._Rows(table, Scoring()), 0
    for n in sizes:
        for a in range(start, start + n, 31):  # in pieces, as batches bring them
            search.offer(every, np.arange(a, min(a + 31, start + n)))
        search.close()
        start += n
    picks, score = _whole_beam(table, sizes)
    assert list(search.picks[0]) == list(picks) and math.isclose(search.score[0], score, abs_tol=1e-8)


def test_name_of_very_many_places_in_bounded_memory(spark):
    sizes = [2, 200_000, 3]
    table = _candidates(sizes, 1)
    tracemalloc.start()
    search, every = scoring._Search(50), scoring._Rows(table, Scoring())
    search.offer(every, np.arange(2))
    search.close()
    search.offer(every, np.arange(2, 200_002))
    search.close()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6
    # And in a job, where the places come in many batches and other events lie around them.
    big = spark.createDataFrame(table.select(["event_id", "loc_no", "row_no", "cid", "lat", "lon", "region", "grp", "qid", "unary"]).to_pylist(), CAND)
    small = spark.createDataFrame(_rows(), CAND)
    both = big.unionByName(small)
    got = {r.event_id: [p.cid for p in sorted(r.picks, key=lambda p: p.loc_no)] for r in scoring.choose_places(both).collect()}
    # Mentions with one place come first; here all have more, so the order is that of the text.
    assert got["e"] == list(_whole_beam(table, sizes)[0])
    alone = {r.event_id: [p.cid for p in sorted(r.picks, key=lambda p: p.loc_no)] for r in scoring.choose_places(small).collect()}
    assert {k: v for k, v in got.items() if k != "e"} == alone


def test_structural_outlier(spark):
    near, far = [(48.0, 31.0), (48.02, 31.0)], (49.0, 31.0)
    rows = [("e", i, i, i, lat, lon, None, None, None, 0.0) for i, (lat, lon) in enumerate([*near, far])]
    d = scoring.diagnostics(scoring.choose_places(spark.createDataFrame(rows, CAND))).first()
    assert d["structural_outliers"] == [2] and d["outliers"] == [0, 1, 2]
    assert d["bbox_is_large"]


def test_fail_safe_narrowing_never_empties(spark):
    rows = [("e", 0, 1, "r1", "g1", "r9", "g1"), ("e", 0, 2, "r2", "g2", "r9", "g1"), ("e", 1, 3, "r1", "g1", "r1", "g9"), ("e", 1, 4, "r2", "g1", "r1", "g9")]
    df = spark.createDataFrame(rows, "event_id string, loc_no int, cid int, region string, grp string, ctx_region string, ctx_group string")
    both = {r["cid"] for r in context.keep_region_and_group(df).collect()}
    step = {r["cid"] for r in context.keep_group(context.keep_region(df)).collect()}
    assert both == step == {1, 3}


def test_last_resolved_context_wins(spark):
    events = spark.createDataFrame([("p", "S0", "p:0"), ("p", "S1", "p:1")], "post_id string, section_id string, event_id string")
    kind = "post_id string, level string, section_id string, event_id string, ord int, kind string, entity string"
    ctx = spark.createDataFrame([
        ("p", "post", None, None, 0, "region", "A"), ("p", "post", None, None, 1, "region", None), ("p", "post", None, None, 0, "group", "G"),
        ("p", "section", "S1", None, 0, "region", "B"), ("p", "section", "S1", None, 1, "region", None), ("p", "event", None, "p:1", 0, "group", None)], kind)
    got = {r["event_id"]: (r["ctx_region"], r["ctx_group"]) for r in context.inherit_contexts(events, ctx).collect()}
    assert got == {"p:0": (None, "G"), "p:1": ("B", "G")}


def test_event_with_many_mentions_and_small_batches(spark):
    rows = [("big", loc, 10 * loc + c, 10 * loc + c, 48.0 + c, 31.0, None, None, None, float(c == loc % 2)) for loc in range(2000) for c in range(2 if loc < 3 else 1)]
    rows += [(f"s{e}", 0, e, e, 48.0, 31.0, None, None, None, 0.5) for e in range(50)]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r["event_id"]: r["picks"] for r in scoring.choose_places(spark.createDataFrame(rows, CAND)).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert len(got) == 51 and sorted(p["loc_no"] for p in got["big"]) == list(range(2000))
    assert all(len(got[f"s{e}"]) == 1 and got[f"s{e}"][0]["cid"] == e for e in range(50))


def test_events_that_ask_for_the_same_names_are_searched_once(spark, monkeypatch):
    """The same assignments as with candidates of each mention, at each event's own mentions; a name without places and a lone place among the names."""
    rnd = random.Random(5)
    of_name = {w: [(w, n * 100 + c, n * 100 + c, rnd.uniform(47, 48), rnd.uniform(30, 31), rnd.choice(["a", "b", "", None]), rnd.choice(["x", None]), None, rnd.uniform(0, 1))
                   for c in range(size)] for n, (w, size) in enumerate((("p", 4), ("q", 1), ("r", 3), ("none", 0)))}
    lists = [("p",), ("r", "q", "p"), ("p", "r"), ("r", "p"), ("none", "p"), ("none",), ("p", "p")]
    mentioned = [(f"e{e}", e % 3 + k * 2, w) for e in range(70) for k, w in enumerate(lists[e % 7])]
    rows = [(e, loc, *place[1:]) for e, loc, w in mentioned for place in of_name[w]]
    want = {r["event_id"]: (r["score"], [tuple(p) for p in r["picks"]]) for r in scoring.choose_places(spark.createDataFrame(rows, CAND)).collect()}
    searched, plain = [], scoring.choose_places
    monkeypatch.setattr(scoring, "choose_places", lambda c, *more: searched.append(c.count()) or plain(c, *more))
    places = spark.createDataFrame([x for xs in of_name.values() for x in xs], "want string, " + CAND.split(", ", 2)[2])
    got = scoring.choose_wanted(spark.createDataFrame(mentioned, "event_id string, loc_no int, want string"), places).collect()
    assert {r["event_id"]: (r["score"], [tuple(p) for p in r["picks"]]) for r in got} == want and len(got) == len(want) == 60
    assert searched == [4 + 8 + 7 + 7 + 4 + 8] and sum(searched) * 5 < len(rows)
