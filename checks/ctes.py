"""The fixtures of ``fixtures.py`` once more, as DuckDB expressions, derived on their own."""

from __future__ import annotations

from checks.fixtures import EVENT_LABELS, LINE, POLYGONS

WS = (r"[ \t\n\x0B\f\r\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
      r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+")


def squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}', ' ', 'g'))"


def lockey(x: str) -> str:
    bare = f"replace(replace(replace(lower(coalesce({x}, '')), '''', ''), '’', ''), 'the', '')"
    return squeeze(f"replace(replace(replace({bare}, '-', ' '), '–', ' '), '—', ' ')")


def cid(lat: str, lon: str) -> str:
    return (f"(CAST(trunc((round_even({lat}, 6) + 90.0e0) * 1000000.0e0) AS BIGINT) * 4294967296"
            f" + CAST(trunc((round_even({lon}, 6) + 180.0e0) * 1000000.0e0) AS BIGINT))")


def hav(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return (f"(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2}))"
            f" * pow(sin(radians({lon2} - {lon1}) / 2), 2))")


def km(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    """Scoring distance."""
    return f"(2.0e0 * 6371.0088e0 * atan2(sqrt({hav(lat1, lon1, lat2, lon2)}), sqrt(1.0e0 - {hav(lat1, lon1, lat2, lon2)})))"


def lookup_km(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    """Gazetteer distance."""
    return f"(2.0e0 * 6371.0e0 * asin(sqrt({hav(lat1, lon1, lat2, lon2)})))"


def _values(rows: list[str]) -> str:
    return ", ".join(rows)


_GAP = "[^\\p{L}\\p{N}''’ʼ]"
_WRD = "[\\p{L}\\p{N}''’ʼ]"

CTES: dict[str, str] = {
    "fx_words": r"SELECT doc_id, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS w FROM documents",
    "fx_vocab": """SELECT r, w FROM (SELECT row_number() OVER (ORDER BY n DESC, w) AS r, w FROM
        (SELECT w, count(DISTINCT doc_id) AS n FROM fx_words WHERE length(w) >= 6 GROUP BY w)) WHERE r <= 460""",
    "fx_triggers": "SELECT CASE (r - 1) % 10 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(EVENT_LABELS))
                   + " END AS label, w AS trigger FROM fx_vocab WHERE r <= 30",
    "fx_regions0": """SELECT n_nationkey AS nk, n_regionkey AS rk, w || ' oblast' AS name, [w, lower(n_name)] AS aliases
        FROM nation JOIN fx_vocab ON r = 31 + n_nationkey""",
    "fx_regions": """SELECT a.nk AS row_no, a.name, a.aliases, a.rk, 'QR' || a.nk AS qid, 'XX-' || a.nk AS iso3166_2,
        (SELECT list_sort(list(b.name)) FROM fx_regions0 b WHERE b.nk IN ((a.nk + 24) % 25, (a.nk + 1) % 25)) AS neighbors
        FROM fx_regions0 a""",
    "fx_groups0": "SELECT r_regionkey AS rk, w AS name, [lower(r_name)] AS aliases FROM region JOIN fx_vocab ON r = 56 + r_regionkey",
    "fx_groups": """SELECT a.rk AS row_no, a.name, a.rk AS group_id, a.aliases,
        (SELECT list_sort(list(b.name)) FROM fx_regions0 b WHERE b.rk = a.rk) AS regions,
        (SELECT list_sort(list(b.name)) FROM fx_groups0 b WHERE b.rk IN ((a.rk + 4) % 5, (a.rk + 1) % 5)) AS neighbors
        FROM fx_groups0 a""",
    "fx_base": """SELECT k, nk, n_regionkey AS rk, 44.0e0 + (k * 7919 % 8000) / 1000.0e0 AS lat, 22.0e0 + (k * 104729 % 18000) / 1000.0e0 AS lon
        FROM (SELECT c_custkey AS k, c_nationkey AS nk FROM customer UNION ALL SELECT 1000000 + s_suppkey, s_nationkey FROM supplier)
        JOIN nation ON n_nationkey = nk""",
    "fx_locales": f"""SELECT k AS row_no, {cid('lat', 'lon')} AS cid, a.w AS name, [b.w] AS aliases, lat, lon,
        c.w || ' oblast' AS region, d.w AS grp, CASE WHEN k % 11 <> 0 THEN 'Q' || (k % 997) END AS qid
        FROM fx_base JOIN fx_vocab a ON a.r = 61 + k % 400 JOIN fx_vocab b ON b.r = 61 + (k * 7 + 3) % 400
        JOIN fx_vocab c ON c.r = 31 + nk JOIN fx_vocab d ON d.r = 56 + rk""",
    "fx_directions": "SELECT row_no, name, cid AS anchor_cid, aliases FROM fx_locales QUALIFY row_number() OVER (PARTITION BY name ORDER BY row_no DESC) = 1",
    "fx_index": f"SELECT {lockey('a')} AS key, * EXCLUDE (a) FROM (SELECT unnest(list_append(aliases, name)) AS a, * FROM fx_locales)",
    "fx_region_index": f"""SELECT key, arg_max(name, row_no) AS entity FROM (SELECT {lockey('a')} AS key, name, row_no FROM
        (SELECT unnest(list_append(aliases, name)) AS a, name, row_no FROM fx_regions)) GROUP BY key""",
    "fx_group_index": f"""SELECT key, arg_max(name, row_no) AS entity FROM (SELECT {lockey('a')} AS key, name, row_no FROM
        (SELECT unnest(list_append(aliases, name)) AS a, name, row_no FROM fx_groups)) GROUP BY key""",
    "fx_direction_index": f"""SELECT key, arg_max(name, row_no) AS entity FROM (SELECT {lockey('a')} AS key, name, row_no FROM
        (SELECT unnest(list_append(aliases, name)) AS a, name, row_no FROM fx_directions)) GROUP BY key""",
    "fx_texts": f"""SELECT text_id, ck, text, {lockey('text')} AS key FROM (SELECT o_orderkey AS text_id, o_custkey AS ck,
        CASE o_orderkey % 5 WHEN 0 THEN w WHEN 1 THEN upper(w) WHEN 2 THEN w || ' oblast' WHEN 3 THEN w || ' direction'
        ELSE 'Direction of ' || w END AS text FROM orders JOIN fx_vocab ON r = 31 + o_orderkey % 430)""",
    "fx_points": """SELECT pid, k, 44.0005e0 + (k * 6151 % 8000) / 1000.0e0 AS lat, 22.0005e0 + (k * 93911 % 18000) / 1000.0e0 AS lon
        FROM (SELECT 1000000000 + s_suppkey AS pid, 5000 + s_suppkey AS k FROM supplier UNION ALL SELECT event_id, user_id FROM events)""",
    "fx_spots": "SELECT DISTINCT lat, lon FROM fx_points",
    "fx_posts": """SELECT doc_id AS post_id, source AS channel, lang AS channel_lang, text,
        (1704067200 + (doc_id % 30) * 86400 + (doc_id % 1440) * 60) * 1000000 AS micros FROM documents""",
    "fx_paragraph_posts": r"""SELECT conv_id AS post_id, string_agg(CASE WHEN turn % 3 = 0 THEN '- ' || text || ':' ELSE text END,
        chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id""",
    "fx_line": "SELECT * FROM (VALUES " + _values([f"({i}, {x}e0, {y}e0)" for i, (x, y) in enumerate(LINE)]) + ") t(pt_no, lon, lat)",
    "fx_segments": """SELECT pt_no, x1, y1, x2, y2 FROM (SELECT pt_no, x AS x1, y AS y1, lead(x) OVER (ORDER BY pt_no) AS x2,
        lead(y) OVER (ORDER BY pt_no) AS y2 FROM (SELECT pt_no, radians(lon) * 6378137.0e0 AS x,
        ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137.0e0 AS y FROM fx_line)) WHERE x2 IS NOT NULL""",
    "fx_corners": "SELECT * FROM (VALUES " + _values([
        f"({no}, '{name}', {i}, {x}e0, {y}e0)" for no, name, ring in POLYGONS for i, (x, y) in enumerate(ring)])
        + ") t(poly_no, poly_name, i, x, y)",
    "fx_edges": """SELECT * FROM (SELECT poly_no, poly_name, i, x AS x1, y AS y1, lead(x) OVER w AS x2, lead(y) OVER w AS y2
        FROM fx_corners WINDOW w AS (PARTITION BY poly_no ORDER BY i)) WHERE x2 IS NOT NULL""",
    "fx_areas": "SELECT poly_no, poly_name, abs(sum(x1 * y2 - x2 * y1)) / 2 AS area FROM fx_edges GROUP BY ALL",
    "fx_inside": """SELECT s.lat, s.lon, poly_no, poly_name FROM fx_spots s, fx_edges e GROUP BY ALL HAVING
        count(*) FILTER (WHERE (y1 > s.lat) <> (y2 > s.lat) AND s.lon < (x2 - x1) * (s.lat - y1) / (y2 - y1) + x1) % 2 = 1""",
    # Text layer: pieces of a text alternate between words and gaps.
    "tx_pieces": f"""SELECT post_id, i, p, regexp_matches(p, '^{_WRD}') AS is_word FROM (SELECT post_id, unnest(l) AS p, generate_subscripts(l, 1) AS i
        FROM (SELECT post_id, regexp_extract_all(text, '{_WRD}+|{_GAP}+') AS l FROM fx_posts))""",
    "tx_before": r"""SELECT *, lower(lag(p) OVER (PARTITION BY post_id ORDER BY i)) AS prev FROM tx_pieces""",
    "tx_counted": r"""SELECT *, CAST(sum(length(p)) OVER w AS BIGINT) AS ce,
        CAST(sum(CASE WHEN is_word THEN 1 ELSE length(regexp_replace(p, '\s+', '', 'g')) END) OVER w AS BIGINT) AS te,
        CAST(sum(CASE WHEN is_word THEN 0 ELSE length(p) - length(replace(p, chr(10), '')) END) OVER w AS BIGINT) AS ln,
        CAST(sum(CASE WHEN NOT is_word AND i > 1 AND (contains(p, chr(10)) OR (regexp_matches(p, '[.!?…]["»”)\]]*[\s\x{00A0}]')
            AND NOT (prev IN ('gen', 'col', 'lt', 'maj', 'capt', 'sgt', 'dr', 'mr', 'mrs', 'st', 'ген', 'обл') AND regexp_matches(p, '^\.[ \t\r\f\v\x{00A0}]*$'))))
            THEN 1 ELSE 0 END) OVER w AS BIGINT) AS sn,
        lag(p) OVER w AS gap FROM tx_before WINDOW w AS (PARTITION BY post_id ORDER BY i)""",
    "tx_words": f"""SELECT post_id, row_number() OVER (PARTITION BY post_id ORDER BY i) AS wi, p AS w, gap, ce - length(p) AS cs, ce,
        te - 1 AS ts, te, ln, sn, lower(p) AS lw, {lockey('p')} AS key FROM tx_counted WHERE is_word""",
    "tx_names": f"""SELECT DISTINCT key, label FROM (SELECT key, 'LOCALE' AS label FROM fx_index
        UNION ALL SELECT key, 'REGION' FROM fx_region_index UNION ALL SELECT key, 'GROUP' FROM fx_group_index) WHERE key <> ''""",
    "tx_pairs": r"""SELECT a.post_id, a.lw AS lw1, b.lw AS lw2, a.w || b.gap || b.w AS surface, a.ts, b.te, a.cs, b.ce, a.ln, a.sn, b.key AS key2,
        regexp_matches(b.gap, '^\s*$') AS plain_gap FROM tx_words a JOIN tx_words b ON a.post_id = b.post_id AND b.wi = a.wi + 1""",
    "tx_hits": f"""SELECT post_id, label, ts, te, cs, ce, ln, w AS surface, key FROM tx_words JOIN tx_names USING (key) WHERE lw <> 'the'
        UNION ALL SELECT post_id, label, ts, te, cs, ce, ln, surface, n.key FROM tx_pairs p JOIN tx_names n ON n.key = {lockey('p.surface')}
            WHERE lw1 <> 'the' AND lw2 <> 'the'
        UNION ALL SELECT post_id, 'DIRECTION', ts, te, cs, ce, ln, surface, key2 FROM tx_pairs WHERE lw1 = 'of' AND plain_gap
            AND key2 IN (SELECT key FROM fx_direction_index)
        UNION ALL SELECT post_id, 'PROXIMITY', ts, te, cs, ce, ln, surface, key2 FROM tx_pairs WHERE lw1 = 'in' AND plain_gap
            AND key2 IN (SELECT key FROM fx_index)""",
    "tx_chosen": """SELECT post_id, list_reduce(list([s] ORDER BY s.te - s.ts DESC, s.ts, s.prio), lambda kept, x:
        CASE WHEN len(list_filter(kept, lambda k: k.ts < x[1].te AND k.te > x[1].ts)) > 0 THEN kept ELSE list_concat(kept, x) END) AS l
        FROM (SELECT post_id, {'ts': ts, 'te': te, 'cs': cs, 'ce': ce, 'ln': ln, 'label': label, 'surface': surface, 'key': key,
            'prio': list_position(['LOCALE', 'REGION', 'GROUP', 'DIRECTION', 'PROXIMITY'], label)} AS s FROM tx_hits) GROUP BY post_id""",
    "tx_spans": """SELECT post_id, s.ts AS ts, s.te AS te, s.cs AS cs, s.ce AS ce, s.ln AS ln, s.label AS label, s.surface AS surface, s.key AS key
        FROM (SELECT post_id, unnest(l) AS s FROM tx_chosen)""",
    "tx_sentences": """SELECT post_id, sn, min(ts) AS s_ts, max(te) AS s_te, min(cs) AS s_cs, max(ce) AS s_ce FROM tx_words GROUP BY ALL""",
    "tx_triggered": """SELECT post_id, sn, label, trigger, min(ts) AS ts FROM tx_words JOIN fx_triggers ON lw = trigger GROUP BY ALL""",
    # A sentence is its words, the gaps between them, and what of the gaps at its borders lies on its side of the cut.
    "tx_cut": r"""SELECT *, string_split(regexp_replace(p, '([.!?…]["»”)\]]*)[\s\x{00A0}]', '\1' || chr(10), 'g'), chr(10)) AS parts,
        lag(sn) OVER (PARTITION BY post_id ORDER BY i) AS sn0, max(i) OVER (PARTITION BY post_id) AS last FROM tx_counted""",
    "tx_sentence_texts": r"""SELECT post_id, sn, trim(string_agg(p, '' ORDER BY i), chr(32) || chr(9) || chr(13) || chr(12) || chr(11)) AS text FROM (
        SELECT post_id, sn, i, CASE WHEN is_word THEN p WHEN i = 1 THEN parts[-1] WHEN sn0 <> sn THEN parts[-1] WHEN i = last THEN parts[1] ELSE p END AS p FROM tx_cut
        UNION ALL SELECT post_id, sn0, i, parts[1] FROM tx_cut WHERE sn0 <> sn) GROUP BY post_id, sn""",
    "tx_events0": """SELECT t.post_id, t.post_id || ':' || (row_number() OVER (PARTITION BY t.post_id ORDER BY t.sn, t.ts, t.trigger, t.label) - 1) AS event_id,
        t.label, t.trigger, t.sn, s_ts, s_te, s_cs FROM tx_triggered t JOIN tx_sentences USING (post_id, sn)""",
}
