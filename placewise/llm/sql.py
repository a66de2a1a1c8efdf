"""SQL twins of the queries that SQL can express."""

from __future__ import annotations

from placewise.llm import line_quality, mixing

_UPPER = "".join(map(chr, range(ord("A"), ord("Z") + 1)))


def _lower(text: str) -> str:
    return f"translate({text}, '{_UPPER}', '{_UPPER.lower()}')"


OP4 = rf"""
WITH d AS (
    SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents
), w AS (
    SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
           list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
    FROM d
), windows AS (
    SELECT rid, p, array_to_string(ws[p:p + 7], ' ') AS win
    FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS p FROM w WHERE len(ws) >= 8)
), places AS (
    SELECT rid, p FROM (SELECT rid, p, count(*) OVER (PARTITION BY rid, win) AS n FROM windows) WHERE n > 1
), covered AS (
    SELECT rid, sum(CASE WHEN follow IS NULL THEN 8 ELSE least(8, follow - p) END) AS n
    FROM (SELECT rid, p, lead(p) OVER (PARTITION BY rid ORDER BY p) AS follow FROM places) GROUP BY rid
), lines AS (
    SELECT rid, source, substr(md5(t), 1, 15) AS content, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS n,
           {_lower(r"trim(regexp_replace(x, '[\x20\x09-\x0D]+', ' ', 'g'), ' ')")} AS line
    FROM (SELECT rid, source, t, unnest(ls) AS x FROM w)
), hosts AS (
    SELECT source, count(DISTINCT substr(md5(t), 1, 15)) AS texts FROM d GROUP BY source
), counted AS (
    SELECT source, line, count(DISTINCT content) AS n FROM lines GROUP BY source, line
), frequent AS (
    SELECT c.source, line FROM counted c JOIN hosts h ON c.source IS NOT DISTINCT FROM h.source
    WHERE n > {line_quality.MAX_TEXTS} AND 100 * n > {line_quality.MAX_SHARE} * texts
), lost AS (
    SELECT l.rid, sum(l.n) AS n FROM lines l JOIN frequent f ON l.line = f.line AND l.source IS NOT DISTINCT FROM f.source
    GROUP BY l.rid
), base AS (
    SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
           (length(t) - length(translate(t, '{line_quality.SYMBOLS}', '')))::BIGINT AS n_symbols,
           (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
           coalesce(lost.n, 0)::BIGINT AS removed_words
    FROM w LEFT JOIN covered USING (rid) LEFT JOIN lost USING (rid)
)
SELECT *, n_words < {line_quality.MIN_WORDS} OR 100 * n_repeat_words > {line_quality.MAX_REPEATED} * n_words AS base_failed,
       NOT (n_words < {line_quality.MIN_WORDS} OR 100 * n_repeat_words > {line_quality.MAX_REPEATED} * n_words)
       AND NOT 100 * removed_words > {line_quality.MAX_REMOVED} * n_words
       AND n_words - removed_words >= {line_quality.MIN_WORDS} AS kept
FROM base
"""

OP7 = r"""
WITH rows_ AS (
    SELECT conv_id, turn, role, text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
    UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), said AS (
    SELECT conv_id, turn, role AS r, text AS x, coalesce(role, '') AS role, coalesce(text, '') AS text FROM rows_
), written AS (
    SELECT *, length('<|im_start|><|im_end|>') + 2 + length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g'))
           + length(replace(replace(regexp_replace(role, '<(\\*)\|', '<\1\\|', 'g'), '~', '~0'), chr(10), '~1')) AS chars
    FROM said
), all_ AS (
    SELECT conv_id, count(*) AS n_turns, sum(chars)::BIGINT AS formatted_chars,
           string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r NULLS FIRST, x NULLS FIRST) AS turns,
           coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, r NULLS FIRST, x NULLS FIRST)
               FILTER (role = 'assistant'), '') AS loss
    FROM written GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256,
       formatted_chars
FROM all_
"""

OP8 = f"""
WITH d AS (
    SELECT doc_id, source, coalesce(strlen(text), 0) + 1 AS size,
           md5('{mixing.SEED}|' || coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')) AS k
    FROM documents
), s AS (
    SELECT source, sum(size)::DOUBLE AS size, pow(sum(size)::DOUBLE, {mixing.TEMPERATURE}) AS weight FROM d GROUP BY source
), r AS (
    SELECT source, round(weight / (SELECT sum(weight) FROM s) * (SELECT sum(size) FROM s) / size, 6) AS rate FROM s
), m AS (
    SELECT source, rate, greatest(1, ceil(rate / {mixing.MEAN_PER_DRAW}))::INTEGER AS draws FROM r
), terms AS (
    SELECT source, j, exp(j * ln(rate / draws) - rate / draws - lgamma(j + 1)) AS p
    FROM m, range(0, {mixing.TERMS} + 1) AS t(j) WHERE rate > 0
), steps AS (
    SELECT source, sum(p) OVER (PARTITION BY source ORDER BY j) AS c FROM terms
), cdf AS (
    SELECT source, list(c ORDER BY c) AS c FROM steps GROUP BY source
), drawn AS (
    SELECT doc_id, d.source, rate, k, c, unnest(range(1, draws + 1)) AS i
    FROM d JOIN m ON d.source IS NOT DISTINCT FROM m.source JOIN cdf ON d.source IS NOT DISTINCT FROM cdf.source
), counted AS (
    SELECT doc_id, source, rate, k, i, len(list_filter(c, lambda x: x <= ('0x' || substr(md5(k || '|' || i), 1, 15))::BIGINT / {float(1 << 60)!r})) AS n
    FROM drawn
), copies AS (
    SELECT doc_id, source, rate, k, sum(n)::BIGINT AS copies FROM
    (SELECT *, row_number() OVER (PARTITION BY k, i) AS repeat FROM counted) GROUP BY doc_id, source, rate, k, repeat
), spread AS (
    SELECT *, unnest(range(0, copies)) AS copy FROM copies
)
SELECT doc_id, source, rate, copies, copy, md5(k || '|copy|' || copy) AS shuffle_key FROM spread
"""

OP9 = f"""
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, {_lower("coalesce(text, '')")} AS t FROM documents) WINDOW same AS (PARTITION BY t)
"""



def _crc32(text: str) -> str:
    """Unsigned CRC-32 of a text of ASCII characters."""
    bits = "list_reduce(list_prepend(xor(a, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda r, z: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END)"
    codes = f"list_transform(string_split({text}, ''), lambda ch: ascii(ch)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda a, b: {bits}), 4294967295)"


# No cheapest repair inserts a turn: deleting what an inserted turn completes costs less.
OP11 = rf"""
WITH RECURSIVE given AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           {_crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind
    FROM conversations
), damaged AS (
    SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
           CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
           unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy
    FROM given WHERE kind <> 0
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged
), faults AS (
    SELECT *, substr(role, 1, 1) AS initial, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last,
           row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
           lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before
    FROM placed
), rows_ AS (
    SELECT *, last = '' AS blank, last <> '' AND again AS duplicate, last <> '' AND NOT again AND last NOT IN ('.', '!', '?') AS truncated
    FROM faults
), ids AS (
    SELECT DISTINCT conv_id FROM conversations
), edits AS (
    SELECT r.conv_id, r.i, s.state, e.edit, e.next, e.cost + CASE WHEN r.truncated AND e.edit <> 'D' THEN 5 ELSE 0 END AS cost
    FROM rows_ r, (VALUES ('N'), ('S'), ('U'), ('A')) s(state), (
        VALUES ('N', 's', 'K', 'S', 0), ('N', 'u', 'K', 'U', 0), ('S', 'u', 'K', 'U', 0), ('U', 'a', 'K', 'A', 0), ('A', 'u', 'K', 'U', 0),
               ('N', '', 'R', 'U', 1), ('S', '', 'R', 'U', 1), ('U', '', 'R', 'A', 1), ('A', '', 'R', 'U', 1),
               ('N', '', 'D', 'N', 2), ('S', '', 'D', 'S', 2), ('U', '', 'D', 'U', 2), ('A', '', 'D', 'A', 2)
    ) e(state, initial, edit, next, cost)
    WHERE e.state = s.state AND (e.initial = '' OR e.initial = r.initial) AND (e.edit = 'D' OR NOT (r.blank OR r.duplicate))
), best AS (
    SELECT conv_id, 0::BIGINT AS i, 'N' AS state, {{'cost': 0::BIGINT, 'audit': ''}} AS b FROM ids
    UNION ALL
    SELECT e.conv_id, e.i, e.next, min({{'cost': b.b.cost + e.cost, 'audit': b.b.audit || e.edit}})
    FROM best b JOIN edits e ON e.conv_id IS NOT DISTINCT FROM b.conv_id AND e.i = b.i + 1 AND e.state = b.state
    GROUP BY e.conv_id, e.i, e.next
), counted AS (
    SELECT ids.conv_id, count(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
           count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
           count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
    FROM ids LEFT JOIN rows_ r ON r.conv_id IS NOT DISTINCT FROM ids.conv_id GROUP BY ids.conv_id
), chosen AS (
    SELECT c.*, (SELECT min(b.b) FROM best b WHERE b.conv_id IS NOT DISTINCT FROM c.conv_id AND b.i = c.n AND b.state IN ('N', 'A')) AS b
    FROM counted c
), kept AS (
    SELECT c.conv_id, r.i, r.role, r.text, substr(c.b.audit, r.i, 1) AS edit,
           count(*) FILTER (NOT (substr(c.b.audit, r.i, 1) = 'K' AND r.initial = 's')) OVER (PARTITION BY c.conv_id ORDER BY r.i) AS place
    FROM chosen c JOIN rows_ r ON r.conv_id IS NOT DISTINCT FROM c.conv_id WHERE substr(c.b.audit, r.i, 1) <> 'D'
), said AS (
    SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN place % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY i) AS t
    FROM kept GROUP BY conv_id
)
SELECT c.conv_id, gaps, blank, duplicate, truncated, illegal, c.b.cost AS cost, c.b.audit AS audit, sha256(coalesce(s.t, '')) AS repaired_sha256
FROM chosen c LEFT JOIN said s ON s.conv_id IS NOT DISTINCT FROM c.conv_id
"""

OP13 = f"""
WITH own AS (
    SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}}
               ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns
    FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), plan AS (
    SELECT *, {_crc32("conv_id::VARCHAR")} % 6 AS h FROM own
), seqs AS (
    SELECT p.conv_id, list_concat(coalesce(b.turns[1:p.h], []), p.turns[p.h + 1:]) AS s
    FROM plan p LEFT JOIN own b ON b.conv_id = p.conv_id - p.conv_id % 100
), prefixes AS (
    SELECT conv_id, len(s) AS n, d AS depth, s[1:d] AS p FROM (SELECT *, unnest(range(len(s) + 1)) AS d FROM seqs)
), nodes AS (
    SELECT depth, p, min(conv_id) AS conv_id, count(*) AS n_convs,
           coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = depth), '') AS ends
    FROM prefixes GROUP BY depth, p
), children AS (
    SELECT p[1:depth - 1] AS p, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY p[1:depth - 1]
), known AS (
    SELECT n.*, coalesce(c.n, 0) AS n_children, (n_convs - 1) * CASE WHEN depth = 0 THEN 0 ELSE length(n.p[depth].text) END AS value
    FROM nodes n LEFT JOIN children c ON c.p = n.p
), above AS (
    SELECT *, unnest(range(depth + 1)) AS up FROM known
), trees AS (
    SELECT p[1:up] AS p, sum(value)::BIGINT AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM above GROUP BY p[1:up]
)
SELECT k.conv_id, k.depth, u.conv_id AS parent_conv_id, k.n_convs, k.n_children::BIGINT AS n_children, t.n_leaves, t.saved_tokens,
       sha256(k.ends) AS ends_sha256
FROM known k JOIN trees t ON t.p = k.p LEFT JOIN nodes u ON k.depth > 0 AND u.p = k.p[1:k.depth - 1]
"""

ORACLE_SQL: dict[str, str] = {
    "op4_line_quality": OP4,
    "op7_chat_format": OP7,
    "op8_mixing": OP8,
    "op9_exact_dedup": OP9,
    "op11_turn_repair": OP11,
    "op13_prefix_trie": OP13,
}
