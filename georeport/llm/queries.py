"""Registered queries of this subpackage, with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from georeport.llm import archives, attribution, leaks, merkle, near, packing, ppm, prefixes, quality, relative, rules, secrets, suffixes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


OP2_SQL = r"""
WITH words AS (
    SELECT doc_id, regexp_extract_all(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'), '[^ ]+') AS w
    FROM documents
), sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w
           ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM words
), classes AS (
    SELECT s, len(s) AS n, min(doc_id) AS head FROM sets WHERE len(s) > 0 GROUP BY s
), items AS MATERIALIZED (
    SELECT head, n, unnest(s) AS g FROM classes
), shared AS MATERIALIZED (
    SELECT a.head AS a, b.head AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS common
    FROM items a JOIN items b ON a.g = b.g AND a.head < b.head AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY 1, 2
), links AS MATERIALIZED (
    SELECT a, b FROM shared WHERE 100 * common >= 80 * (na + nb - common)
), arcs AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
    WITH RECURSIVE r(id, to_id) AS (
        SELECT head, head FROM classes WHERE head IN (SELECT a FROM arcs) UNION SELECT r.id, arcs.b FROM r JOIN arcs ON r.to_id = arcs.a
    ) SELECT id, min(to_id) AS component FROM r GROUP BY id
)
SELECT sets.doc_id, CAST(len(sets.s) AS BIGINT) AS n_shingles,
       CASE WHEN len(sets.s) = 0 THEN sets.doc_id ELSE coalesce(reach.component, classes.head) END AS component_id,
       CASE WHEN len(sets.s) = 0 THEN true ELSE sets.doc_id = coalesce(reach.component, classes.head) END AS kept
FROM sets LEFT JOIN classes ON sets.s = classes.s AND len(sets.s) > 0 LEFT JOIN reach ON classes.head = reach.id
"""


# list_distinct keeps no fixed order, so sets are sorted before they are compared.
OP2_SQL = OP2_SQL.replace("ELSE list_distinct(", "ELSE list_sort(list_distinct(").replace("w[i + 1])) END", "w[i + 1]))) END")


@query("op2_minhash", OP2_SQL)
def op2(spark, sf_dir):
    return near.linked_classes(table(spark, sf_dir, "documents"), near.Settings(width=2)).withColumnRenamed("id", "doc_id")


@query("op4_rules")
def op4(spark, sf_dir):
    from georeport.operators.common import written
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    stats = written(rules.statistics(docs), "statistics")
    scored = rules.anomaly(stats, rules.fit_forest(stats))
    cut = rules.threshold(scored, labels)
    failed = rules.base_failed()
    return scored.select("doc_id", *rules.COUNTS[:5], failed.alias("base_failed"), (~failed & (F.col("anomaly") < cut)).alias("kept"), "anomaly")


@query("op6_classifier")
def op6(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.train_on_labels(docs, labels)
    return (quality.score(docs, model).withColumn("held_out", quality.held_out(F.col("doc_id")))
            .withColumn("predicted", F.when(F.col("score") >= 0.7, 1).otherwise(0)).select("doc_id", "held_out", "score", "predicted"))


OP3_SQL = r"""
WITH dw AS MATERIALIZED (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents
), bw AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark
), win AS MATERIALIZED (
    SELECT DISTINCT item_id, array_to_string(w[i:i + 9], ' ') AS p, least(10, len(w)) AS n
    FROM bw, unnest(range(1, greatest(2, len(w) - 8))) AS t(i) WHERE len(w) > 0
), lens AS (SELECT DISTINCT n FROM win
), occ AS MATERIALIZED (
    SELECT d.doc_id, d.s, d.n, win.item_id
    FROM (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS p FROM dw, lens, unnest(range(1, len(w) - n + 2)) AS t(s)) d
    JOIN win ON win.p = d.p AND win.n = d.n
), hit AS (
    SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS pos FROM (SELECT DISTINCT doc_id, s, n FROM occ)) GROUP BY doc_id
), items AS (
    SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM occ) GROUP BY doc_id
)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query("op3_decontamination", OP3_SQL)
def op3(spark, sf_dir):
    found = leaks.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("row_id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


_KINDS = (("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
          ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24), ("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
          ("github", "gh[opsru]_[A-Za-z0-9]{36,}", 0, 1), ("slack", "xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1),
          ("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1))
OP5_SQL = "WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), found AS (" + " UNION ALL ".join(
    f"""SELECT doc_id, {i} AS rank, '{kind}' AS kind, string_split_regex(t, '{pattern}') AS gaps, regexp_extract_all(t, '{pattern}') AS m,
        regexp_extract_all(t, '{pattern}', {group}) AS g, {least} AS least FROM d"""
    for i, (kind, pattern, group, least) in enumerate(_KINDS)) + """
), each AS (
    SELECT doc_id, rank, kind, least, i, len(gaps[i]) AS gap, len(m[i]) AS n, len(g[i]) AS tested FROM found, unnest(range(1, len(m) + 1)) AS t(i)
), placed AS (
    SELECT *, sum(gap + n) OVER (PARTITION BY doc_id, rank ORDER BY i) AS stop FROM each
), spans AS (
    SELECT doc_id, rank, kind, CAST(stop - n AS BIGINT) AS start, kind || ':' || CAST(stop - n AS BIGINT) || ':' || CAST(stop AS BIGINT) AS said FROM placed WHERE tested >= least
), agg AS (
    SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
           string_agg(said, ',' ORDER BY start, rank) FILTER (rank < 3) AS base, string_agg(said, ',' ORDER BY start, rank) AS spans FROM spans GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN agg USING (doc_id)
"""


@query("op5_secrets", OP5_SQL)
def op5(spark, sf_dir):
    found = secrets.scan(table(spark, sf_dir, "documents"))
    return found.select(F.col("row_id").alias("doc_id"), "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")


@query("op10_packing")
def op10(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op1_suffixes")
def op1(spark, sf_dir):
    return suffixes.removed(table(spark, sf_dir, "documents"), 400).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


OP7_SQL = r"""
WITH w AS MATERIALIZED (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS MATERIALIZED (
    SELECT doc_id, s, hash(w[s:s + 34]) AS h, md5(array_to_string(w[s:s + 34], ' ')) AS m FROM w, unnest(range(1, len(w) - 33)) AS t(s)
), twice AS (SELECT h, m FROM win GROUP BY h, m HAVING count(*) > 1
), gone AS MATERIALIZED (
    SELECT DISTINCT doc_id, unnest(range(s, s + 35)) AS i FROM win JOIN twice USING (h, m)
), words AS (SELECT doc_id, i, w[i] AS word FROM w, unnest(range(1, len(w) + 1)) AS t(i)
), rest AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
), n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN rest USING (doc_id)
"""


@query("op7_relative", OP7_SQL)
def op7(spark, sf_dir):
    return relative.parsed(table(spark, sf_dir, "documents"), 35).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
heads AS (SELECT hex, min(page_id) AS head FROM p GROUP BY hex),
letters AS (
    SELECT hex, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((CAST('0x' || substr(hex, 5 * k + 1, 5) AS BIGINT) >> (15 - 5 * j)) & 31) + 1, 1), '' ORDER BY k, j) AS said
    FROM heads, range(8) AS a(k), range(4) AS b(j) GROUP BY hex
)
SELECT p.page_id, CAST(octet_length(encode(p.html)) AS BIGINT) AS payload_bytes, said AS payload_digest,
       CASE WHEN p.page_id = head THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN p.page_id <> head THEN head END AS refers_to
FROM p JOIN heads USING (hex) JOIN letters USING (hex)
"""


@query("op8_archives", OP8_SQL)
def op8(spark, sf_dir):
    return archives.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op9_attribution")
def op9(spark, sf_dir):
    return attribution.attributed(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), rule="most")


def crc_sql(number: str) -> str:
    """Unsigned CRC-32 of a number as text, bit by bit."""
    said = f"CAST({number} AS VARCHAR)"
    a = f"xor(a, CASE WHEN i % 8 = 0 THEN CAST(ascii(substr({said}, i // 8 + 1, 1)) AS BIGINT) ELSE 0 END)"
    return f"xor(list_reduce(range(8 * len({said})), lambda a, i: xor({a} >> 1, ({a} & 1) * 3988292384), CAST(4294967295 AS BIGINT)), 4294967295)"


OP11_SQL = rf"""
WITH turns AS MATERIALIZED (
    SELECT conv_id, digest, words, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, digest) AS pos
    FROM (SELECT conv_id, turn, coalesce(role, '') AS role, md5(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest,
                 len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words FROM conversations WHERE conv_id IS NOT NULL)
), convs AS (SELECT conv_id, {crc_sql('conv_id')} % 4 AS h FROM (SELECT DISTINCT conv_id FROM turns)
), built AS (
    SELECT c.conv_id, 0 AS part, pos, digest, words FROM convs c JOIN turns t ON t.conv_id = c.conv_id - c.conv_id % 20 AND pos <= h
    UNION ALL SELECT c.conv_id, 1, pos, digest, words FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND pos > h
), steps AS (
    SELECT conv_id, words, row_number() OVER w AS d, string_agg(digest, '') OVER w AS path FROM built WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos)
), members AS MATERIALIZED (
    SELECT conv_id, d, words, path, left(path, len(path) - 32) AS up FROM steps UNION ALL SELECT conv_id, 0, 0, '', NULL FROM convs
), nodes AS MATERIALIZED (SELECT path, d, any_value(up) AS up, any_value(words) AS words, min(conv_id) AS conv_id, count(*) AS n FROM members GROUP BY path, d
), kids AS (SELECT up AS path, count(*) AS k FROM nodes WHERE up IS NOT NULL GROUP BY up
), below AS (
    SELECT m.path, sum((n.n - 1) * n.words) AS saved, count(*) FILTER (WHERE k IS NULL) AS leaves
    FROM nodes n LEFT JOIN kids ON kids.path = n.path JOIN members m ON m.conv_id = n.conv_id AND m.d <= n.d GROUP BY m.path
), ends AS (
    SELECT path, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids
    FROM (SELECT conv_id, path, d, max(d) OVER (PARTITION BY conv_id) AS last FROM members) WHERE d = last GROUP BY path
)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n AS n_convs, coalesce(k, 0) AS n_children, leaves AS n_leaves,
       CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM nodes n LEFT JOIN nodes p ON p.path = n.up LEFT JOIN kids ON kids.path = n.path JOIN below ON below.path = n.path LEFT JOIN ends ON ends.path = n.path
"""


@query("op11_prefixes", OP11_SQL)
def op11(spark, sf_dir):
    return prefixes.prefix_trie(prefixes.rebuilt(prefixes.paths(table(spark, sf_dir, "conversations"))))


@query("op12_partial_matching")
def op12(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = ppm.train(docs.where(~ppm.held_out(F.col("doc_id"))))
    return (ppm.scores(docs, model).withColumn("held_out", ppm.held_out(F.col("doc_id")))
            .select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"))


def _said(column: str) -> str:
    return f"CASE WHEN {column} IS NULL THEN '-' ELSE octet_length(encode(CAST({column} AS VARCHAR))) || ':' || {column} END"


_LEAF = "sha256(" + " || ".join(map(_said, ("doc_id", "source", "lang", "n_chars"))) + " || {})"


def _levels(name: str, given: str) -> str:
    return f"""{name} AS (
    SELECT 0 AS lev, * FROM ({given})
    UNION ALL SELECT lev + 1, source, i // 3, sha256(string_agg(h, '' ORDER BY i)), (max(total) + 2) // 3 FROM {name} WHERE total > 1 GROUP BY lev, source, i // 3
)"""


def _walk(name: str, levels: str, given: str) -> str:
    """Up from a leaf, original (h) and changed (c), with the siblings met."""
    return f"""{name} AS (
    SELECT 0 AS lev, * FROM ({given})
    UNION ALL SELECT v.lev + 1, v.r, v.source, v.i // 3, sha256(string_agg(CASE WHEN l.i = v.i THEN v.c ELSE l.h END, '' ORDER BY l.i)),
           any_value(v.proof) || coalesce(string_agg(CASE WHEN l.i <> v.i THEN l.h END, '' ORDER BY l.i), '')
    FROM {name} v JOIN {levels} l ON l.lev = v.lev AND l.source IS NOT DISTINCT FROM v.source AND l.i // 3 = v.i // 3 AND l.total > 1
    GROUP BY v.lev, v.r, v.source, v.i
)"""


OP13_SQL = f"""
WITH RECURSIVE leaves AS MATERIALIZED (
    SELECT *, row_number() OVER () AS r, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS total
    FROM (SELECT doc_id, source, {_LEAF.format(_said('text'))} AS leaf,
                 CASE WHEN {crc_sql('doc_id')} % 2 = 0 THEN {_LEAF.format(_said("replace(text, chr(10), '')"))} ELSE {_LEAF.format(_said('text'))} END AS changed FROM documents)
), {_levels('own', 'SELECT source, i, leaf AS h, total FROM leaves')
}, subroots AS MATERIALIZED (
    SELECT source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS total FROM own WHERE total = 1
), {_levels('top', "SELECT '' AS source, i, h, total FROM subroots")
}, {_walk('walk', 'own', "SELECT r, source, i, changed AS c, '' AS proof FROM leaves")
}, half AS (SELECT r, source, c, proof FROM walk QUALIFY row_number() OVER (PARTITION BY r ORDER BY lev DESC) = 1
), {_walk('climb', 'top', "SELECT r, '' AS source, s.i, c, proof FROM half JOIN subroots s ON s.source IS NOT DISTINCT FROM half.source")
}, whole AS (SELECT r, c, proof FROM climb QUALIFY row_number() OVER (PARTITION BY r ORDER BY lev DESC) = 1)
SELECT doc_id, leaf, subroots.h AS subroot, root.h AS root, sha256(proof) AS proof_sha256, c AS folded_root, c = root.h AS verified
FROM leaves JOIN whole USING (r) JOIN subroots ON subroots.source IS NOT DISTINCT FROM leaves.source, (SELECT h FROM top WHERE total = 1) root
"""


@query("op13_manifest", OP13_SQL)
def op13(spark, sf_dir):
    tree = merkle.manifest(merkle.document_leaves(table(spark, sf_dir, "documents")))
    return merkle.versions(tree).withColumnRenamed("id", "doc_id")
