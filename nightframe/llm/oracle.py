"""DuckDB SQL for the queries that SQL can express: each states its contract plainly, by brute force."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLDED = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"
_SPACED = r"'[^\x20\x09-\x0D]+'"
_WORDS = rf"regexp_extract_all({_FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP3_SQL = f"""
WITH i AS (SELECT item_id::VARCHAR AS item, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL
), phrases AS (
  SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[k : k + least(13, len(w)) - 1], ' ') AS p FROM i, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS u(k) WHERE len(w) > 0
), d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents
), windows AS (
  SELECT r, n, k, array_to_string(w[k : k + n - 1], ' ') AS p FROM d, (SELECT DISTINCT n FROM phrases), unnest(range(1, len(w) - n + 2)) AS u(k)
), hits AS (SELECT r, k, n, item FROM windows JOIN phrases USING (n, p)
), words AS (SELECT r, count(DISTINCT k + o) AS n_hit FROM hits, unnest(range(0, n)) AS u(o) GROUP BY r
), items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""

OP5_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), {_SPACED}) AS w FROM documents
), windows AS (SELECT r, doc_id, k, array_to_string(w[k : k + 12], ' ') AS p FROM d, unnest(range(1, len(w) - 11)) AS u(k)
), late AS (SELECT r, k FROM (SELECT *, min(doc_id) OVER (PARTITION BY p) AS first FROM windows) WHERE first < doc_id
), gone AS (SELECT DISTINCT r, k + o AS i FROM late, range(0, 13) AS t(o)
), words AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d
), kept AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN gone USING (r, i) GROUP BY r
), removed AS (SELECT r, count(*) AS n FROM gone GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM d LEFT JOIN removed USING (r) LEFT JOIN kept USING (r)
"""



def _linked(words: int, part: int, more: str) -> str:
    """Documents by links of their sets of shingles of so many words, alike to part in a hundred."""
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_FOLDED}, {_SPACED}) AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[k : k + least({words}, len(w)) - 1], ' ') AS t FROM d, unnest(range(1, greatest(len(w) - {words - 1}, 1) + 1)) AS u(k) WHERE len(w) > 0
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), links AS (
  SELECT a, b FROM (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY ALL)
  JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= {part} * (x.n + y.n - shared)
), reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b
), g AS (SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(reach.b) AS component_id FROM d LEFT JOIN n USING (doc_id) JOIN reach ON reach.a = d.doc_id GROUP BY d.doc_id)
SELECT *{more} FROM g
"""


OP6_SQL = _linked(5, 75, "")
OP11_SQL = _linked(2, 80, ", doc_id = component_id AS kept")

#: The 256 values of the reflected polynomial 0xEDB88320, by which a crc32 goes on a byte at a time.
_CRC_TABLE = "SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, _: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t"


def _crc(codes: str) -> str:
    """The crc32 of a list of bytes; t is the table above."""
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, {codes}), lambda a, b: xor(a >> 8, t[xor(a % 256, b) + 1])))"


def _add(k: str, cost: str, edit: str) -> str:
    """A parse that goes on by an edit. Parses are costs of nine digits, then edits, so the least text is the best."""
    return f"(lpad(({k}[1:9]::INTEGER + {cost})::VARCHAR, 9, '0') || {k}[10:] || '{edit}')"


_NO_WORD = r"'^[\x20\x09-\x0D]*$'"
_OPEN_END = r"'[.!?][\x20\x09-\x0D]*$'"
#: States of the role grammar: 0 nothing yet, 1 after system, 2 after user, 3 after assistant.
_MOVES = {1: ("s", (0,)), 2: ("u", (0, 1, 3)), 3: ("a", (2,))}
_DELETED = {s: _add(f"k{s}", "2", "D") for s in range(4)}
_KEPT = {s: [f"CASE WHEN NOT forced AND initial = '{c}' THEN {_add(f'k{a}', 'more', 'K')} END" for a in of] for s, (c, of) in _MOVES.items()} | {0: []}
_GIVEN = {s: [f"CASE WHEN NOT forced THEN {_add(f'k{a}', '1 + more', 'R')} END" for a in of] for s, (c, of) in _MOVES.items() if c != "s"}
_NEXT = ", ".join(f"least({', '.join([_DELETED[s], *_KEPT[s], *_GIVEN.get(s, []), 'NULL'])}) AS r{s}" for s in range(4))

OP13_SQL = rf"""
WITH RECURSIVE crc AS ({_CRC_TABLE}
), keyed AS (
  SELECT conv_id, coalesce('=' || conv_id, '') AS c, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ord(x)::BIGINT) AS codes FROM conversations
), faults AS (SELECT *, {_crc("codes")} % 20 AS fault FROM keyed, crc
), given AS (
  SELECT c, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
    CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN fault = 3 THEN 2 ELSE 1 END)) AS copy
  FROM faults WHERE fault <> 0
), numbered AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text) AS i FROM given
), judged AS (
  SELECT *, regexp_matches(text, {_NO_WORD}) AS blank, row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 AS later,
    NOT regexp_matches(text, {_OPEN_END}) AS open_end, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY c ORDER BY i) AS before FROM numbered
), lines AS (
  SELECT *, blank OR later AS forced, CASE WHEN open_end THEN 5 ELSE 0 END AS more FROM judged
), counts AS (
  SELECT c, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (NOT blank AND later) AS duplicate,
    count(*) FILTER (NOT forced AND open_end) AS truncated, count(*) FILTER (i > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM lines GROUP BY c
), parses AS (
  SELECT c, n, 0::BIGINT AS i, '000000000' AS k0, NULL::VARCHAR AS k1, '000000005I' AS k2, '000000010II' AS k3 FROM counts
  UNION ALL
  SELECT c, n, i, r0, r1, s2, least(r3, {_add("s2", "5", "I")})
  FROM (SELECT *, least(r2, {", ".join(_add(f"r{s}", "5", "I") for s in (0, 1, 3))}) AS s2
    FROM (SELECT p.c, p.n, l.i, {_NEXT} FROM parses p JOIN lines l ON l.c = p.c AND l.i = p.i + 1))
), best AS (SELECT c, least(k0, k3)[1:9]::BIGINT AS cost, least(k0, k3)[10:] AS audit FROM parses WHERE i = n
), letters AS (SELECT c, unnest(string_split(audit, '')) AS x, unnest(range(1, length(audit) + 1)) AS p FROM best WHERE audit <> ''
), placed AS (
  SELECT *, sum((x <> 'I')::INTEGER) OVER w AS i, sum((x <> 'D')::INTEGER) OVER w AS place, sum((x <> 'D')::INTEGER) OVER (PARTITION BY c) % 2 AS system
  FROM letters WINDOW w AS (PARTITION BY c ORDER BY p)
), spoken AS (
  SELECT placed.c, string_agg(CASE WHEN x = 'K' THEN role WHEN (place - system) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN x = 'I' THEN '' ELSE text END, chr(10) ORDER BY place) AS whole
  FROM placed LEFT JOIN lines ON lines.c = placed.c AND lines.i = placed.i WHERE x <> 'D' GROUP BY placed.c
)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, c FROM keyed) o LEFT JOIN counts ON counts.c = o.c LEFT JOIN best ON best.c = o.c LEFT JOIN spoken ON spoken.c = o.c
"""

_RUN_CODES = "flatten(list_transform(string_split(doc || ':' || run, ''), lambda x: CASE WHEN ord(x) < 128 THEN [ord(x)::BIGINT] ELSE [195::BIGINT, ord(x)::BIGINT - 64] END))"

OP12_SQL = rf"""
WITH RECURSIVE crc AS ({_CRC_TABLE}
), runs AS (
  SELECT doc, run, count(*) AS n FROM (SELECT coalesce(doc_id::VARCHAR, '') AS doc, unnest(regexp_extract_all({_FOLDED}, '[A-Za-zÀ-ÿ]+')) AS run FROM documents) GROUP BY ALL
), hashed AS (SELECT run, n, {_crc(_RUN_CODES)} AS h FROM runs, crc
), spelt AS (SELECT n, CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word FROM hashed
), v AS (SELECT word, sum(n)::BIGINT AS n FROM spelt WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), less AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS d FROM v, unnest(range(1, length(word) + 1)) AS u(i)
), pairs AS (
  SELECT a.word, b.word AS near, b.n FROM less a JOIN less b ON a.d = b.d AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, v.word, v.n FROM less a JOIN v ON v.word = a.d
  UNION SELECT v.word, a.word, a.n FROM less a JOIN v ON v.word = a.d
), counted AS (SELECT word, count(*) AS n_near, max(n) AS most FROM pairs GROUP BY word
), formed AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 2 * v.n THEN (SELECT min(near) FROM pairs p WHERE p.word = v.word AND p.n = most) END AS form,
    CASE WHEN most >= 2 * v.n THEN most END AS form_n FROM v LEFT JOIN counted USING (word)
), ways AS (SELECT word, word AS reached, 0 AS steps FROM formed UNION ALL SELECT ways.word, form, steps + 1 FROM ways JOIN formed ON formed.word = ways.reached WHERE form IS NOT NULL
), ends AS (SELECT word, arg_max(reached, steps) AS root FROM ways GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN ends USING (word)
"""
