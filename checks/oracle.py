"""The same answers in SQL, written with joins where the engine uses arrays in the row."""

from __future__ import annotations

from chatlens import fixtures as fx
from chatlens.schemas import CHAT_COLUMNS, EXPORT_COLUMNS

# What the answers must say, written out here so that the engine can be found wrong.
MAX_ATTEMPTS = 3
EXHAUSTED = "Failed to get valid JSON after 3 times of retries"
ARRAY_REPLY = "list indices must be integers or slices, not str"
NULL_REPLY = "'NoneType' object does not support item assignment"
POSITIVE_REASON = "only positive words"
NEGATIVE_REASON = "only negative words"
MIXED_REASON = "positive and negative words"
NEUTRAL_REASON = "no listed word"


def _text(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def _values(rows: list[tuple]) -> str:
    return ", ".join(
        "(" + ", ".join(str(v) if isinstance(v, int) else _text(v) for v in r) + ")" for r in rows
    )


DAY = "(DATE '2024-01-01' + CAST(conv_id AS INTEGER))"

BASE = f"""base AS (
  SELECT conv_id, turn, 'grp' || (conv_id % 6) AS "Source",
    strftime({DAY}, '%Y-%m-%d') AS "Date1", strftime({DAY}, '%d/%m/%Y') AS "Date2",
    printf('%02d:%02d:00', 8 + turn, conv_id % 60) AS "Time", role AS "userPhone",
    CAST(NULL AS VARCHAR) AS "quotedMessage", text AS "messageBody",
    CASE WHEN turn % 4 = 3 THEN 'image' END AS "mediaType",
    CAST(NULL AS VARCHAR) AS "mediaCaption"
  FROM conversations)"""

RAW = '"Source", ' + ", ".join(f'"{c}"' for c in EXPORT_COLUMNS)

BOTH = f"""both_slices AS (
  SELECT {RAW} FROM base WHERE turn <= 4
  UNION ALL BY NAME
  SELECT {RAW.replace(', "mediaCaption"', '')} FROM base WHERE turn >= 3)"""

MERGED = "merged AS (SELECT DISTINCT * FROM both_slices)"

CANONICAL = ", ".join(
    {"Source": '"Source"', "Group": "'' AS \"Group\"", "Reason": "'' AS \"Reason\""}.get(
        c, f"coalesce(\"{c}\", '') AS \"{c}\""
    )
    for c in CHAT_COLUMNS
)

GROUPS = f"""group_info AS (
  SELECT * FROM (VALUES {_values(fx.GROUP_INFO)}) t(idx, gus_id, group_nature))"""

PARTS = """group_part AS (
  SELECT c_custkey AS idx, 'user' || (c_custkey % 700) AS gus_id,
    CASE WHEN c_custkey % 10 = 0 THEN 'Z' ELSE c_mktsegment END AS group_nature
  FROM customer)"""


def _natures(source: str) -> str:
    return f"""natures AS (
  SELECT gus_id, group_nature AS nature FROM {source} g
  WHERE idx = (SELECT max(idx) FROM {source} h WHERE h.gus_id = g.gus_id)
    AND length(group_nature) > 1)"""


FIXED_RULES = f"""raw_rules AS (
  SELECT * FROM (VALUES {_values(fx.RULES)}) t(idx, brand, product, keyword, required_product))"""

PART_RULES = """raw_rules AS (
  SELECT CAST(p_partkey AS INTEGER) AS idx, 'b' || (p_partkey // 40) AS brand,
    CASE WHEN p_type = 'STANDARD' THEN 'generic' ELSE lower(p_type) END AS product,
    CASE WHEN p_partkey % 97 = 0 THEN '' ELSE p_name || ' ' || p_size END AS keyword,
    CASE WHEN p_partkey % 5 = 0 THEN 'small, economy '
      WHEN p_partkey % 7 = 0 THEN 'nosuch' ELSE '' END AS required_product
  FROM part)"""

DOCUMENT_RULES = """raw_rules AS (
  SELECT CAST(doc_id AS INTEGER) AS idx, 'd' || (doc_id // 30) AS brand,
    CASE WHEN doc_id % 6 = 0 THEN 'generic' ELSE 'p' || (doc_id % 6) END AS product,
    coalesce((SELECT w FROM (SELECT unnest(string_split(text, ' ')) AS w) WHERE length(w) >= 5
      ORDER BY length(w), w LIMIT 1), text) AS keyword,
    CASE WHEN doc_id % 5 = 0 THEN 'p2, p3' ELSE '' END AS required_product
  FROM documents)"""

RULES = """rules AS (SELECT *, brand || '_' || product AS headers FROM raw_rules),
wanted AS (
  SELECT DISTINCT idx, brand || '_' || trim(p) AS headers
  FROM (SELECT idx, brand, unnest(string_split(required_product, ',')) AS p FROM raw_rules)),
req AS (
  SELECT w.idx, r.idx AS kidx, r.keyword AS word
  FROM wanted w JOIN rules r ON r.headers = w.headers),
req_text AS (SELECT idx, string_agg(word, '|' ORDER BY kidx) AS joined FROM req GROUP BY idx),
resolved AS (
  SELECT r.*, coalesce(t.joined, '') AS required_keyword
  FROM rules r LEFT JOIN req_text t ON t.idx = r.idx),
heads AS (
  SELECT headers, CAST(min(idx) AS BIGINT) AS ord, contains(headers, 'generic') AS generic,
    replace(headers, '_generic', '') AS base
  FROM rules GROUP BY headers)"""


def _hits(messages: str, keys: list[str], body: str, literal: bool = False) -> str:
    """Hits before (``hits``) and after (``final``) the generic fallback."""
    key = ", ".join(f"m.{k}" for k in keys)
    same = " AND ".join(f"s.{k} = h.{k}" for k in keys)
    if literal:
        needed = f"contains(lower(m.{body}), lower(r.required_keyword))"
    else:
        needed = (
            "EXISTS (SELECT 1 FROM req q WHERE q.idx = r.idx "
            f"AND contains(lower(m.{body}), lower(q.word)))"
        )
    return f"""hits AS (
  SELECT DISTINCT {key}, r.headers AS header
  FROM {messages} m JOIN resolved r ON contains(lower(m.{body}), lower(r.keyword))
  WHERE r.required_keyword = '' OR {needed}),
pairs AS (
  SELECT g.headers AS generic, s.headers AS specific
  FROM heads g JOIN heads s ON g.generic AND NOT s.generic AND contains(s.headers, g.base)),
blocked AS (
  SELECT DISTINCT {", ".join(f"s.{k}" for k in keys)}, p.generic AS header
  FROM hits s JOIN pairs p ON p.specific = s.header),
final AS (
  SELECT h.* FROM hits h WHERE NOT EXISTS (
    SELECT 1 FROM blocked s WHERE {same} AND s.header = h.header))"""


KEYS = ["conv_id", "turn"]
CONVERSATION_HITS = _hits("base", KEYS, '"messageBody"')
TAGGING = [BASE, FIXED_RULES, RULES, CONVERSATION_HITS]


def _any(body: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower({body}), {_text(w.lower())})" for w in words) + ")"


POS = _any('b."messageBody"', fx.POSITIVE)
NEG = _any('b."messageBody"', fx.NEGATIVE)

SCORED = f"""scored AS (
  SELECT f.conv_id, f.turn, f.header, h.ord,
    CASE WHEN {POS} AND NOT {NEG} THEN 'P' WHEN {NEG} AND NOT {POS} THEN 'N' ELSE 'I' END
      AS sentiment,
    CASE WHEN {POS} AND {NEG} THEN {_text(MIXED_REASON)}
      WHEN {POS} THEN {_text(POSITIVE_REASON)}
      WHEN {NEG} THEN {_text(NEGATIVE_REASON)}
      ELSE {_text(NEUTRAL_REASON)} END AS reason
  FROM final f JOIN base b ON b.conv_id = f.conv_id AND b.turn = f.turn
  JOIN heads h ON h.headers = f.header)"""

PROMPTS = """prompts AS (
  SELECT f.conv_id, f.turn, f.header, h.ord,
    'Formula Brand: ' || f.header || ', Message: ' || b."messageBody" AS prompt
  FROM final f JOIN base b ON b.conv_id = f.conv_id AND b.turn = f.turn
  JOIN heads h ON h.headers = f.header)"""

# what the scripted scorer answers
MODEL = f"""sized AS (SELECT *, length(prompt) AS size FROM prompts),
scored AS (
  SELECT conv_id, turn, header, ord, size % 5 NOT IN (1, 2) AS success,
    CASE WHEN size % 5 IN (1, 2) THEN 'I' ELSE substr('PNI', 1 + size % 3, 1) END AS sentiment,
    CASE WHEN size % 5 = 1 THEN {_text(ARRAY_REPLY)}
      WHEN size % 5 = 2 THEN {_text(EXHAUSTED)}
      ELSE 'size ' || size END AS reason
  FROM sized)"""

HEADERS = list(dict.fromkeys(f"{b}_{p}" for _, b, p, _, _ in fx.RULES))


def _cells(value: str) -> str:
    return ", ".join(
        f"coalesce(max(CASE WHEN s.header = {_text(h)} THEN {value} END), '') AS \"{h}\""
        for h in HEADERS
    )


SAME = "s.conv_id = b.conv_id AND s.turn = b.turn"
REASONS = "coalesce(string_agg(s.header || ': ' || s.reason || chr(10), '' ORDER BY s.ord), '')"


def _replies() -> str:
    reason = "regexp_replace(text, '[^A-Za-z ]', ' ', 'g')"
    cases = []
    for i, form in enumerate(fx.REPLY_FORMS):
        before, _, after = form.partition("{reason}")
        value = (
            f"{_text(before)} || {reason} || {_text(after)}"
            if "{reason}" in form
            else _text(form)
        )
        cases.append(f"WHEN {i} THEN {value}")
    return f"""replies AS (
  SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 9 <> 0 THEN
    CASE (conv_id * 5 + turn) % {len(fx.REPLY_FORMS)} {" ".join(cases)} END END AS reply
  FROM conversations),
cut AS (
  SELECT *, regexp_replace(
    CASE WHEN regexp_matches(reply, '(?s)```(?:json)?(.*?)```')
      THEN regexp_extract(reply, '(?s)```(?:json)?(.*?)```', 1) ELSE reply END,
    '^\\s+|\\s+$', '', 'g') AS part
  FROM replies),
valid AS (SELECT *, CASE WHEN json_valid(part) THEN CAST(part AS JSON) END AS doc FROM cut),
read AS (
  SELECT *, CASE WHEN reply IS NULL THEN 'no_text' WHEN doc IS NULL THEN 'bad_json'
    WHEN json_type(doc) <> 'OBJECT' THEN 'not_object'
    WHEN json_type(doc, '$.sentiment') = 'VARCHAR' AND json_type(doc, '$.reason') = 'VARCHAR'
      AND doc->>'$.sentiment' IN ('P', 'N', 'I') THEN 'ok'
    ELSE 'bad_structure' END AS status
  FROM valid)"""


def _with(parts: list[str], select: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + select


def _sequence(keys: str) -> str:
    ties = ", ".join(f'"{c}" NULLS LAST' for c in sorted(["Source", *EXPORT_COLUMNS]))
    return _with(
        [BASE, BOTH, MERGED],
        f"""SELECT "Source", "Date2", "Time", "messageBody",
  row_number() OVER (PARTITION BY "Source" ORDER BY {keys}, {ties}) AS seq FROM merged""",
    )


PART = [PART_RULES, RULES]

FINAL_COLUMNS = ", ".join(
    f"any_value(b.\"{c}\") AS \"{c}\"" for c in CHAT_COLUMNS if c not in ("Group", "Reason")
)


def _final(extra: str = "") -> str:
    routed = f"""routed AS (
  SELECT m.conv_id, m.turn, n.nature AS sheet, {", ".join("m." + c for c in RAW.split(", "))}
  FROM base m JOIN natures n ON n.gus_id = m."Source"),
canon AS (SELECT conv_id, turn, sheet, {CANONICAL} FROM routed)"""
    return _with(
        [*TAGGING, SCORED, GROUPS, _natures("group_info"), routed],
        f"""SELECT {extra}{FINAL_COLUMNS}, '' AS "Group", {REASONS} AS "Reason",
  {_cells("s.sentiment")}
FROM canon b LEFT JOIN scored s ON {SAME} GROUP BY b.conv_id, b.turn""",
    )


WORD_SIDES = """words AS (
  SELECT DISTINCT unnest(regexp_extract_all(text, '[a-z]{10,}')) AS word FROM documents),
sides AS (
  SELECT m."messageBody" AS body, coalesce(bool_or(length(w.word) % 2 = 0), false) AS pos,
    coalesce(bool_or(length(w.word) % 2 = 1), false) AS neg
  FROM (SELECT DISTINCT b."messageBody" FROM base b JOIN final f USING (conv_id, turn)) m
  LEFT JOIN words w ON contains(lower(m."messageBody"), w.word) GROUP BY m."messageBody")"""
WORD_VERDICTS = """SELECT f.conv_id, f.turn, f.header,
  CASE WHEN s.pos AND NOT s.neg THEN 'P' WHEN s.neg AND NOT s.pos THEN 'N' ELSE 'I' END AS sentiment
FROM final f JOIN base b USING (conv_id, turn) JOIN sides s ON s.body = b."messageBody\""""

ORACLE: dict[str, str] = {
    "union_exports": _with([BASE, BOTH], f"SELECT {CANONICAL} FROM both_slices"),
    "merge_dedupe": _with([BASE, BOTH], "SELECT DISTINCT * FROM both_slices"),
    "merge_seq_chrono": _sequence(
        "try_strptime(\"Date2\", '%d/%m/%Y') NULLS LAST, "
        "try_strptime(\"Time\", '%H:%M:%S') NULLS LAST"
    ),
    "merge_seq_lexical": _sequence('"Date2" NULLS LAST, "Time" NULLS LAST'),
    "merge_unsorted": _with(
        [BASE, BOTH], 'SELECT DISTINCT * EXCLUDE ("Date2") FROM both_slices'
    ),
    "group_files": """WITH files AS (
  SELECT DISTINCT 'grp' || (conv_id % 6) || '.csv' AS file_name,
    'exports/' || conv_id || '/grp' || (conv_id % 6) || '.csv' AS path
  FROM conversations)
SELECT file_name, path, count(*) OVER (PARTITION BY file_name) AS n_files FROM files""",
    "file_template": """SELECT DISTINCT 'grp' || (conv_id % 6) AS gus_id,
  CAST(NULL AS VARCHAR) AS group_nature FROM conversations""",
    "route_chats": _with(
        [BASE, BOTH, MERGED, GROUPS, _natures("group_info")],
        """SELECT m."Source", n.nature, m."Date2", m."Time", m."messageBody"
FROM merged m JOIN natures n ON n.gus_id = m."Source\"""",
    ),
    "route_events": _with(
        [PARTS, _natures("group_part")],
        """SELECT e.event_id, 'user' || e.user_id AS "Source", n.nature
FROM events e JOIN natures n ON n.gus_id = 'user' || e.user_id""",
    ),
    "distinct_natures": _with([PARTS], "SELECT DISTINCT group_nature AS nature FROM group_part"),
    "csv_round_trip": _with(
        [BASE],
        f"""SELECT CAST(conv_id AS VARCHAR) AS conv_id, CAST(turn AS VARCHAR) AS turn, {RAW}
FROM base""",
    ),
    "csv_exports_by_name": _with(
        [BASE],
        f"""SELECT CAST(conv_id AS VARCHAR) AS conv_id, CAST(turn AS VARCHAR) AS turn,
  {RAW.removeprefix('"Source", ')} FROM base WHERE turn <= 4
UNION ALL BY NAME
SELECT CAST(conv_id AS VARCHAR) AS conv_id, CAST(turn AS VARCHAR) AS turn,
  {RAW.removeprefix('"Source", ')} FROM base WHERE turn >= 3""",
    ),
    "lookup_scans": _with(
        [PART_RULES],
        """SELECT CAST(idx AS BIGINT) AS idx, brand, product, keyword,
  required_product FROM raw_rules""",
    ),
    "folder_sheets": _with(
        [BASE, BOTH, MERGED, GROUPS, _natures("group_info")],
        f"""SELECT nature AS sheet, {CANONICAL}
FROM merged JOIN natures ON gus_id = "Source\"""",
    ),
    "normalise_chat": _with([BASE], f"SELECT conv_id, turn, {CANONICAL} FROM base"),
    "chat_violations": """SELECT conv_id, turn, 'Date2' AS "column", 'not_null' AS rule
  FROM conversations WHERE conv_id % 7 = 0
UNION ALL SELECT conv_id, turn, 'Time', 'not_null' FROM conversations WHERE turn % 5 = 2
UNION ALL SELECT conv_id, turn, 'userPhone', 'not_null' FROM conversations
  WHERE conv_id % 11 = 0""",
    "rule_violations": _with(
        PART,
        """SELECT idx, 'keyword' AS "column", 'blank_keyword' AS rule FROM resolved
  WHERE keyword = ''
UNION ALL SELECT idx, 'required_product', 'unresolved_required_product' FROM resolved r
  WHERE required_product <> '' AND NOT EXISTS (SELECT 1 FROM req q WHERE q.idx = r.idx)""",
    ),
    "rule_headers": _with(PART, "SELECT headers, ord, generic, base FROM heads"),
    "rule_required": _with(PART, "SELECT idx, headers, required_keyword FROM resolved"),
    "rule_kinds": _with(
        PART,
        """SELECT idx, headers,
  CASE WHEN required_keyword = '' THEN 'simple' ELSE 'complex' END AS kind FROM resolved""",
    ),
    "generic_suppressors": _with(
        PART,
        """SELECT g.headers AS generic, s.headers AS specific
FROM heads g JOIN heads s ON g.generic AND NOT s.generic AND contains(s.headers, g.base)""",
    ),
    "header_keywords": _with(
        PART,
        """SELECT headers, string_agg(word, ', ' ORDER BY word) AS keywords FROM (
  SELECT headers, keyword AS word FROM resolved
  UNION
  SELECT headers, unnest(string_split(required_keyword, '|')) FROM resolved
  WHERE required_keyword <> '') GROUP BY headers""",
    ),
    "tag_simple": _with(
        [BASE, FIXED_RULES, RULES],
        """SELECT DISTINCT b.conv_id, b.turn, r.headers AS header
FROM base b JOIN resolved r ON contains(lower(b."messageBody"), lower(r.keyword))
WHERE r.required_keyword = ''""",
    ),
    "tag_required_any": _with(TAGGING, "SELECT conv_id, turn, header FROM hits"),
    "tag_required_literal": _with(
        [BASE, FIXED_RULES, RULES, _hits("base", KEYS, '"messageBody"', literal=True)],
        "SELECT conv_id, turn, header FROM hits",
    ),
    "tag_generic": _with(TAGGING, "SELECT conv_id, turn, header FROM final"),
    "tag_batched": _with(TAGGING, "SELECT conv_id, turn, header FROM final"),
    "tag_by_join": _with(TAGGING, "SELECT conv_id, turn, header FROM final"),
    "tag_documents": _with(
        [FIXED_RULES, RULES, _hits("documents", ["doc_id"], "text")],
        "SELECT doc_id, header FROM final",
    ),
    "tag_pages": _with(
        [FIXED_RULES, RULES, _hits("pages", ["page_id"], "html")],
        "SELECT page_id, header FROM final",
    ),
    "tag_many_rules": _with(
        [BASE, DOCUMENT_RULES, RULES, CONVERSATION_HITS],
        "SELECT conv_id, turn, header FROM final",
    ),
    "wide_many_headers": _with(
        [BASE, DOCUMENT_RULES, RULES, CONVERSATION_HITS],
        """SELECT conv_id, turn, header,
  CAST((SELECT count(*) FROM heads) + 2 AS INTEGER) AS n_columns FROM final""",
    ),
    "tag_wide": _with(
        TAGGING,
        "SELECT b.conv_id, b.turn, "
        + ", ".join(
            f"CAST(count(*) FILTER (WHERE s.header = {_text(h)}) AS INTEGER) AS \"{h}\""
            for h in HEADERS
        )
        + f" FROM base b LEFT JOIN final s ON {SAME} GROUP BY b.conv_id, b.turn",
    ),
    "requests": _with([*TAGGING, PROMPTS], "SELECT conv_id, turn, header, prompt FROM prompts"),
    "request_messages": _with(
        [*TAGGING, PROMPTS],
        """SELECT conv_id, turn, header, 'Rules: ' || (
  SELECT CAST(to_json(list({'brand': brand, 'product': product, 'keyword': keyword,
    'required_product': required_product, 'headers': headers,
    'required_keyword': required_keyword} ORDER BY idx)) AS VARCHAR) FROM resolved) AS system,
  prompt AS user FROM prompts""",
    ),
    "lexicon_scores": _with(
        [*TAGGING, SCORED], "SELECT conv_id, turn, header, sentiment FROM scored"
    ),
    "lexicon_word_tables": _with([*TAGGING, WORD_SIDES], WORD_VERDICTS),
    "lexicon_word_join": _with([*TAGGING, WORD_SIDES], WORD_VERDICTS),
    "parse_replies": _with(
        [_replies()],
        """SELECT conv_id, turn, status,
  CASE WHEN status = 'ok' THEN doc->>'$.sentiment' END AS sentiment,
  CASE WHEN status = 'ok' THEN doc->>'$.reason' END AS reason FROM read""",
    ),
    "retry_fold": _with(
        [
            _replies(),
            f"""tried AS (
  SELECT CAST(conv_id AS VARCHAR) AS request_id, turn + 1 AS attempt, * FROM read
  WHERE turn < {MAX_ATTEMPTS}),
ends AS (
  SELECT request_id, min(attempt) FILTER (WHERE status IN ('ok', 'not_object')) AS attempt
  FROM tried GROUP BY request_id)""",
        ],
        f"""SELECT e.request_id, coalesce(t.status = 'ok', false) AS success,
  CASE WHEN t.status = 'ok' THEN t.doc->>'$.sentiment' ELSE 'I' END AS sentiment,
  CASE WHEN t.status IS NULL THEN {_text(EXHAUSTED)}
    WHEN t.status = 'ok' THEN t.doc->>'$.reason'
    WHEN json_type(t.doc) = 'ARRAY' THEN {_text(ARRAY_REPLY)}
    ELSE {_text(NULL_REPLY)} END AS reason,
  CAST(coalesce(e.attempt, {MAX_ATTEMPTS}) AS INTEGER) AS attempts_used
FROM ends e LEFT JOIN tried t ON t.request_id = e.request_id AND t.attempt = e.attempt""",
    ),
    "map_score": _with(
        [*TAGGING, PROMPTS, MODEL],
        "SELECT conv_id, turn, header, success, sentiment, reason FROM scored",
    ),
    "reason_concat": _with(
        [*TAGGING, SCORED],
        f"""SELECT b.conv_id, b.turn, {REASONS} AS "Reason"
FROM base b LEFT JOIN scored s ON {SAME} GROUP BY b.conv_id, b.turn""",
    ),
    "wide_sentiment": _with(
        [*TAGGING, SCORED],
        f"""SELECT b.conv_id, b.turn, {_cells("s.sentiment")}
FROM base b LEFT JOIN scored s ON {SAME} GROUP BY b.conv_id, b.turn""",
    ),
    "wide_model_sentiment": _with(
        [*TAGGING, PROMPTS, MODEL],
        f"""SELECT b.conv_id, b.turn, {REASONS} AS "Reason",
  {_cells("CASE WHEN s.success THEN s.sentiment ELSE '1' END")}
FROM base b LEFT JOIN scored s ON {SAME} GROUP BY b.conv_id, b.turn""",
    ),
    "final_table": _final(),
    "final_run_files": _final(),
    "final_written": _final("any_value(b.sheet) AS sheet, "),
    "final_ordered": _with(
        [BASE, BOTH, MERGED, GROUPS, _natures("group_info")],
        f"""SELECT nature AS sheet, "Source", "Date2", "Time", "messageBody",
  row_number() OVER (PARTITION BY nature, "Source" ORDER BY
    try_strptime("Date2", '%d/%m/%Y') NULLS LAST, try_strptime("Time", '%H:%M:%S') NULLS LAST,
    "messageBody") AS place
FROM merged JOIN natures ON gus_id = "Source\"""",
    ),
    "offline_scores": _with(
        [*TAGGING, PROMPTS, MODEL],
        """SELECT conv_id, turn, header, success, sentiment, reason FROM scored""",
    ),
    "csv_bad_files": """SELECT DISTINCT v.*, conv_id % 8 AS file FROM conversations, (VALUES
  ('latin', 'bytes that are not UTF-8'), ('long', 'record longer than the header'),
  ('open', 'quote that is never closed')) v(kind, fault)""",
    "csv_many_headers": """SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name,
  CAST(c_nationkey AS VARCHAR) AS c_nationkey, c_mktsegment FROM customer""",
    "csv_quoted_header": """SELECT CAST(conv_id AS VARCHAR) AS conv_id, CAST(turn AS VARCHAR) AS turn,
  CAST(length(body) AS INTEGER) AS size, sha256(body) AS body_sha256
FROM (SELECT conv_id, turn, coalesce(text, '') || chr(10) || ', "end"' AS body FROM conversations)""",
    "csv_trailing_commas": """SELECT CAST(conv_id AS VARCHAR) AS conv_id,
  CAST(turn AS VARCHAR) AS turn, role FROM conversations""",
    "list_files": """SELECT 'c' || name AS gus_id, CAST(NULL AS VARCHAR) AS group_nature
FROM (SELECT DISTINCT conv_id % 3, conv_id % 40 AS name FROM conversations)""",
    "source_name": """SELECT 'c' || conv_id % 40 AS "Source", count(*) AS n_rows FROM conversations
GROUP BY conv_id % 40""",
    "load_chats": _with(
        [BASE],
        f"""SELECT 's' || conv_id % 3 AS sheet, 'c' || conv_id % 40 AS "Source",
  {CANONICAL.split(", ", 1)[1]} FROM base""",
    ),
    "scan_chat_csv": _with(
        [BASE],
        f"""SELECT {RAW.split(", ", 1)[1]}, count(*) AS n FROM base
GROUP BY ALL""",
    ),
    "scan_group_info": """SELECT c_custkey - (SELECT min(c_custkey) FROM customer) AS idx, 'user' || (c_custkey % 700) AS gus_id,
  CASE WHEN c_custkey % 10 = 0 THEN 'Z' ELSE c_mktsegment END AS group_nature FROM customer""",
    "lookup_parts": _with(
        [
            """group_part AS (
  SELECT row_number() OVER (ORDER BY c_custkey % 4, c_custkey) - 1 AS idx,
    'user' || (c_custkey % 700) AS gus_id,
    CASE WHEN c_custkey % 10 = 0 THEN 'Z' ELSE c_mktsegment END AS group_nature
  FROM customer)""",
            """last AS (SELECT gus_id, arg_max(group_nature, idx) AS nature FROM group_part GROUP BY gus_id)""",
        ],
        """SELECT e.event_id, 'user' || e.user_id AS "Source", l.nature
FROM events e JOIN last l ON l.gus_id = 'user' || e.user_id WHERE length(l.nature) > 1""",
    ),
    "rules_of_header": _with(PART, "SELECT idx, keyword FROM resolved WHERE headers = 'b1_generic'"),
    "empty_folders": _with(
        [BASE], f"""SELECT "Source" AS sheet, {CANONICAL} FROM base WHERE "Source" <> 'grp0'"""
    ),
    "final_by_sheet": _final("any_value(b.sheet) AS sheet, "),
}
