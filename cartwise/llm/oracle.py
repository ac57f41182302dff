"""The queries that DuckDB can express as well: all pairs and reachability for
the embeddings, digests and first pages for the archives, words less one letter
for the spelling variants, all pairs of equal words of a text for its runs. (A
nullable integer is a double here, as in the frames that the results are
compared in.)"""

from __future__ import annotations

#: RFC 4648: five hex digits are four base32 letters.
BASE32 = """
b32 AS (
  SELECT h, list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((CAST('0x' || substr(h, CAST(1 + 5 * (i // 4) AS BIGINT), 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER))
         & 31), 1)), 'string_agg', '') AS b32
  FROM (SELECT DISTINCT sha1(coalesce(html, '')) AS h FROM pages))"""


def crc32_of(strings: str) -> str:
    """CTEs up to ``crc(s, h)``: the unsigned crc32 of each string s of the
    query ``strings``, byte by byte with the usual table."""
    step = "CASE WHEN {0} & 1 = 1 THEN xor({0} >> 1, 3988292384) ELSE {0} >> 1 END AS c"
    table = "SELECT range AS i, CAST(range AS BIGINT) AS c FROM range(256)"
    for _ in range(8):
        table = f"SELECT i, {step.format('c')} FROM ({table})"
    return f"""
crc_table AS (SELECT list(c ORDER BY i) AS t FROM ({table})),
crc_bytes AS (SELECT s, hex(encode(s)) AS b FROM ({strings})),
crc_steps(s, b, k, c) AS (
  SELECT s, b, 0, CAST(4294967295 AS BIGINT) FROM crc_bytes
  UNION ALL
  SELECT s, b, k + 1, xor(c >> 8, t[(xor(c, CAST('0x' || substr(b, 2 * k + 1, 2) AS BIGINT)) & 255) + 1])
  FROM crc_steps, crc_table WHERE 2 * k < length(b)),
crc AS (SELECT s, xor(c, 4294967295) AS h FROM crc_steps WHERE 2 * k = length(b))"""


LLM_ORACLE: dict[str, str] = {
    "op4_embedding_near_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
    ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach(a, b) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.a = e.vec_id) AS n_links,
       (SELECT min(b) FROM reach r WHERE r.a = e.vec_id) AS component_id,
       e.vec_id = (SELECT min(b) FROM reach r WHERE r.a = e.vec_id) AS kept
FROM embeddings e""",
    "op9_warc": "WITH " + BASE32.strip() + """,
p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
f AS (SELECT html, min(page_id) AS first FROM p GROUP BY html)
SELECT p.page_id, CAST(octet_length(encode(p.html)) AS BIGINT) AS payload_bytes, b32.b32 AS payload_digest,
       CASE WHEN p.page_id = f.first THEN 'response' ELSE 'revisit' END AS record_type,
       CAST(CASE WHEN p.page_id <> f.first THEN f.first END AS DOUBLE) AS refers_to
FROM p JOIN f ON p.html = f.html JOIN b32 ON b32.h = sha1(p.html)""",
    "op11_spelling_variants": """WITH RECURSIVE occurrences AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]{6,}')) AS run FROM documents),"""
    + crc32_of("SELECT DISTINCT doc_id || ':' || run AS s FROM occurrences") + """,
cut AS (
  SELECT run, h, CAST(h % length(run) AS BIGINT) AS k FROM occurrences JOIN crc ON s = doc_id || ':' || run),
words AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, k) || substr(run, k + 2) ELSE run END AS word FROM cut),
v AS (
  SELECT word, count(*) AS n FROM words WHERE length(word) >= 6 GROUP BY word HAVING count(*) >= 5),
less AS (
  SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest
  FROM (SELECT *, unnest(range(CAST(length(word) AS BIGINT))) AS i FROM v)),
near AS (
  SELECT a.word AS word, b.word AS other, b.n AS n FROM less a JOIN less b
    ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT l.word, v.word, v.n FROM less l JOIN v ON v.word = l.rest
  UNION SELECT v.word, l.word, l.n FROM less l JOIN v ON v.word = l.rest),
best AS (
  SELECT word, count(*) AS n_near, max(n) AS most, arg_max(other, (n, -place)) AS other
  FROM near JOIN (SELECT word AS other, row_number() OVER (ORDER BY encode(word)) AS place FROM v) USING (other)
  GROUP BY word),
formed AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 5 * v.n THEN other END AS form,
         CASE WHEN most >= 5 * v.n THEN most END AS form_n
  FROM v LEFT JOIN best USING (word)),
path(word, goal) AS (
  SELECT word, word FROM formed
  UNION ALL SELECT p.word, f.form FROM path p JOIN formed f ON f.word = p.goal WHERE f.form IS NOT NULL),
ends AS (SELECT p.word, p.goal AS root FROM path p JOIN formed f ON f.word = p.goal WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, CAST(form_n AS DOUBLE) AS form_n FROM formed JOIN ends USING (word)""",
    "op13_periodic_runs": "WITH RECURSIVE" + crc32_of("SELECT DISTINCT CAST(doc_id AS VARCHAR) AS s FROM documents") + """,
cut AS (
  SELECT doc_id, h, h // 10 AS g, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws
  FROM documents JOIN crc ON s = CAST(doc_id AS VARCHAR)),
plan AS (
  SELECT *, CASE WHEN h % 10 = 0 AND len(ws) > 0 THEN g % len(ws) ELSE len(ws) END AS a FROM cut),
plan2 AS (SELECT *, 1 + (len(ws) - a) // (3 + g % 8) AS p FROM plan),
w AS (
  SELECT doc_id, len(ws) AS n, i, CASE WHEN i < a THEN ws[i + 1] ELSE ws[a + (i - a) % p + 1] END AS word
  FROM (SELECT *, unnest(range(len(ws))) AS i FROM plan2)),
same AS (
  SELECT x.doc_id, x.i, y.i - x.i AS p FROM w x JOIN w y
    ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
stretches AS (
  SELECT doc_id, p, min(i) AS start, count(*) + p AS length FROM (
    SELECT *, i - row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS island FROM same)
  GROUP BY doc_id, p, island HAVING count(*) + p >= greatest(6, 4 * p)),
runs AS (SELECT doc_id, start, length, min(p) AS period FROM stretches GROUP BY ALL),
best AS (
  SELECT * FROM runs QUALIFY row_number() OVER (
    PARTITION BY doc_id ORDER BY CAST(length AS DOUBLE) / period DESC, start, period) = 1),
listed AS (
  SELECT doc_id, count(*) AS n_runs,
         string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines
  FROM runs GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t FROM w ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(b.start AS DOUBLE) AS start,
       CAST(b.length AS DOUBLE) AS length, CAST(b.period AS DOUBLE) AS period,
       CAST(1000 * b.length // b.period AS DOUBLE) AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM documents d LEFT JOIN listed USING (doc_id) LEFT JOIN best b USING (doc_id) LEFT JOIN kept USING (doc_id)""",
}
