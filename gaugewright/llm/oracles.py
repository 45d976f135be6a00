"""DuckDB twins of the queries that SQL can express; they know neither tries nor levels."""

from __future__ import annotations

#: Remainders of all bytes for the reflected polynomial of CRC-32, as one list.
_TABLE = "crc AS MATERIALIZED (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n::UBIGINT, [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::UBIGINT) ELSE a >> 1 END)) AS remainders)"


def _crc32(text: str) -> str:
    """CRC-32 of an expression's UTF-8 bytes, where ``remainders`` is in reach."""
    each = f"list_transform(range(octet_length(encode({text}))), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::UBIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::UBIGINT, {each}), lambda a, x: xor(a >> 8, remainders[(xor(a, x) & 255)::BIGINT + 1])), 4294967295::UBIGINT)"


#: Words without one letter meet under its place (replaced letters) or as words (inserted ones); forms are followed by recursion.
SPELLING = f"""WITH RECURSIVE {_TABLE}, runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS word FROM documents),
each AS (SELECT doc_id, word, count(*) AS n FROM runs GROUP BY 1, 2), hashed AS (SELECT word, n, {_crc32("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || word")} AS h FROM each, crc),
typed AS (SELECT CASE WHEN h % 97 = 0 THEN word[:(h % length(word))::BIGINT] || word[(h % length(word))::BIGINT + 2:] ELSE word END AS word, n FROM hashed),
vocab AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM typed WHERE length(word) >= 5 GROUP BY 1 HAVING sum(n) >= 3), short AS (SELECT word, i, word[:i - 1] || word[i + 1:] AS rest FROM vocab, unnest(range(1, length(word) + 1)) u(i)),
links AS (SELECT DISTINCT a.word, b.word AS other FROM short a JOIN short b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word UNION SELECT short.word, vocab.word FROM short JOIN vocab ON vocab.word = rest UNION SELECT vocab.word, short.word FROM short JOIN vocab ON vocab.word = rest),
ranked AS (SELECT links.word, other, o.n AS other_n, row_number() OVER (PARTITION BY links.word ORDER BY o.n DESC, other) AS place, count(*) OVER (PARTITION BY links.word) AS n_near FROM links JOIN vocab o ON o.word = other),
best AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * v.n THEN other END AS form, CASE WHEN other_n >= 2 * v.n THEN other_n END AS form_n FROM vocab v LEFT JOIN ranked r ON r.word = v.word AND place = 1),
steps AS (SELECT word, word AS root, form AS next FROM best UNION ALL SELECT s.word, s.next, b.form FROM steps s JOIN best b ON b.word = s.next)
SELECT b.word, form, s.root, b.n, n_near, form_n FROM best b JOIN steps s ON s.word = b.word AND s.next IS NULL"""

#: Every conversation's prefixes are listed whole; equal ones are one node, and nodes add to all prefixes of their smallest member.
CONVERSATION_TRIE = f"""WITH RECURSIVE {_TABLE}, t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
heads AS (SELECT DISTINCT c, c - c % 20 AS base, {_crc32("CAST(c AS VARCHAR)")} % 4 AS head FROM t, crc), own AS (SELECT c, list(struct_pack(role, text) ORDER BY pos) AS turns FROM t GROUP BY 1),
built AS (SELECT heads.c, list_concat(coalesce(b.turns, [])[:head], o.turns[head + 1:]) AS turns FROM heads JOIN own o ON o.c = heads.c LEFT JOIN own b ON b.c = base),
prefixes AS (SELECT c, d, turns[:d] AS prefix, turns[d].text AS said, len(turns) = d AS ends FROM (SELECT c, turns, unnest(range(len(turns) + 1)) AS d FROM built)), members AS (SELECT *, min(c) OVER (PARTITION BY d, prefix) AS node FROM prefixes),
nodes AS (SELECT node, d, count(*) AS n_convs, any_value(CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(said, '[^\\x20\\x09-\\x0D]+')) END) AS words, sha256(coalesce(string_agg(CASE WHEN ends THEN CAST(c AS VARCHAR) END, ',' ORDER BY c), '')) AS ends_sha256 FROM members GROUP BY 1, 2),
above AS (SELECT n.*, m.node AS parent FROM nodes n LEFT JOIN members m ON m.c = n.node AND m.d = n.d - 1), below AS (SELECT parent, d - 1 AS d, count(*) AS n_children FROM above WHERE d > 0 GROUP BY 1, 2),
full_ AS (SELECT a.*, coalesce(b.n_children, 0) AS n_children FROM above a LEFT JOIN below b ON b.parent = a.node AND b.d = a.d),
sums AS (SELECT m.node, m.d, count(*) FILTER (f.n_children = 0) AS n_leaves, sum((f.n_convs - 1) * f.words) AS saved FROM full_ f JOIN members m ON m.c = f.node AND m.d <= f.d GROUP BY 1, 2)
SELECT f.node AS conv_id, f.d AS depth, parent AS parent_conv_id, n_convs, n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, ends_sha256 FROM full_ f JOIN sums s ON s.node = f.node AND s.d = f.d"""
