"""SQL for the queries of this package, where SQL can express them."""

from __future__ import annotations

_WHITE = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

ORACLE = {
    "op3_line_dedup": f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents
), keys AS (
  SELECT *, translate(trim(line, {_WHITE}), {_LOWER}) AS k FROM lines
), owners AS (
  SELECT k, min(doc_id) AS owner FROM keys WHERE length(k) >= 10
  GROUP BY k HAVING count(DISTINCT doc_id) >= 2
), marked AS (
  SELECT keys.*, owner IS NOT NULL AND owner <> doc_id AS gone FROM keys LEFT JOIN owners USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""",
    "op7_chat_formatting": r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sized AS (
  -- header, text, one backslash per control string, end mark
  SELECT *, length(role) + 4 + 2 + length(text) + 9
         + len(regexp_extract_all(text, '### (System|User|Assistant|@)|</turn>')) AS size
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(size) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
""",
    "op5_suffix_array_dedup": """
WITH d AS (
  SELECT doc_id, encode(coalesce(text, '')) AS b, strlen(coalesce(text, '')) AS n FROM documents
), w AS (
  SELECT doc_id, s, md5(b[s + 1 : s + 400]) AS h FROM (
    SELECT doc_id, b, unnest(range(greatest(0, n - 399))) AS s FROM d)
), twice AS (
  SELECT h FROM w GROUP BY h HAVING count(*) > 1
), starts AS (
  SELECT doc_id, s, CASE WHEN s > lag(s, 1, -1000) OVER (PARTITION BY doc_id ORDER BY s) + 400
    THEN 1 ELSE 0 END AS new
  FROM w SEMI JOIN twice USING (h)
), islands AS (
  SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS k FROM starts
), spans AS (
  SELECT doc_id, min(s) AS lo, max(s) + 400 AS hi FROM islands GROUP BY doc_id, k
), cuts AS (
  SELECT doc_id, lo, hi, lag(hi, 1, 0) OVER (PARTITION BY doc_id ORDER BY lo) AS begins FROM spans
  UNION ALL
  SELECT d.doc_id, d.n, NULL, coalesce(max(s.hi), 0) FROM d LEFT JOIN spans s USING (doc_id)
  GROUP BY d.doc_id, d.n
)
SELECT d.doc_id, any_value(d.n) AS n_bytes, CAST(coalesce(sum(c.hi - c.lo), 0) AS BIGINT) AS n_removed,
       count(c.hi) AS n_spans,
       sha256(unhex(string_agg(hex(d.b[c.begins + 1 : c.lo]), '' ORDER BY c.lo, c.begins))) AS kept_sha256
FROM d JOIN cuts c USING (doc_id) GROUP BY d.doc_id
""",
    "op11_minhash_near_dedup": rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, md5(array_to_string(words[i + 1 : i + 4], ' ')) AS h FROM (
    SELECT doc_id, words, unnest(range(greatest(len(words) - 3, 1))) AS i FROM d WHERE len(words) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n
  FROM shingles a JOIN shingles b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM common c JOIN sizes s ON s.doc_id = x JOIN sizes t ON t.doc_id = y
  WHERE 100 * c.n >= 80 * (s.n + t.n - c.n)
), reach AS (
  SELECT x AS doc_id, y AS other FROM links UNION SELECT y, x FROM links
  UNION
  SELECT r.doc_id, l.y FROM reach r JOIN (SELECT x, y FROM links UNION ALL SELECT y, x FROM links) l ON r.other = l.x
), lowest AS (
  SELECT doc_id, min(other) AS other FROM reach GROUP BY doc_id
)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, coalesce(least(d.doc_id, l.other), d.doc_id) AS component_id,
       d.doc_id = coalesce(least(d.doc_id, l.other), d.doc_id) AS kept
FROM d LEFT JOIN sizes s USING (doc_id) LEFT JOIN lowest l USING (doc_id)
""",
    "op13_importance_resampling": rf"""
WITH steps AS (  -- the table of CRC-32, eight shifts of each byte
  SELECT i, list_reduce([i::UBIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, _:
    CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) t(i)
), crc_table AS (
  SELECT list(v ORDER BY i) AS t FROM steps
), texts AS (
  SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark
), words AS (
  SELECT kind, id, unnest(regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w
  FROM texts
), spelled AS (
  SELECT w, list_transform(range(strlen(w)), lambda i: ('0x' || substr(hex(w), 2 * i + 1, 2))::UBIGINT) AS b
  FROM (SELECT DISTINCT w FROM words)
), buckets AS (
  SELECT w, xor(list_reduce(list_prepend(4294967295::UBIGINT, b), lambda c, x:
    xor(c >> 8, t[(xor(c, x) % 256)::BIGINT + 1])), 4294967295) % 10000 AS bucket FROM spelled, crc_table
), features AS (
  SELECT kind, id, bucket FROM words JOIN buckets USING (w)
), counts AS (
  SELECT bucket, count(*) FILTER (WHERE kind = 'd') AS s, count(*) FILTER (WHERE kind = 'b') AS t FROM features GROUP BY bucket
), totals AS (
  SELECT sum(s)::DOUBLE AS s_all, sum(t)::DOUBLE AS t_all FROM counts
), gains AS (
  SELECT bucket, floor(1000 * ln((t + 1) * (s_all + 10000) / ((s + 1) * (t_all + 10000))))::BIGINT AS gain FROM counts, totals
), weighed AS (
  SELECT id, count(*) AS n, sum(gain)::BIGINT AS weight FROM features JOIN gains USING (bucket) WHERE kind = 'd' GROUP BY id
), scored AS (
  SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::UBIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM documents LEFT JOIN weighed ON doc_id = id
), ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= 20
)
SELECT s.doc_id, n_features, weight, score, CASE WHEN place <= n * 10 // 100 THEN place END AS rank
FROM scored s LEFT JOIN ranked USING (doc_id)
""",
}
