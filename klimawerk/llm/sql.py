"""DuckDB SQL of the operators that SQL can express."""

from __future__ import annotations

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

ORACLE: dict[str, str] = {}

# Lines, and the sentences of lines that have several, by their normalised text; all but the first occurrence.
ORACLE["op1_substring_dedup"] = r"""
WITH line AS (
  SELECT doc_id, i, line, CAST(coalesce(sum(length(line) + 1) OVER (
           PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS low
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
        FROM documents)
),
normal AS (SELECT *, trim(regexp_replace(lower(line), '\s+', ' ', 'g')) AS norm FROM line),
part AS (
  SELECT doc_id, i, low, j, s, low + CAST(length(regexp_extract(line, '^[.!?。！？]*')) + coalesce(sum(length(s)) OVER (
           PARTITION BY doc_id, i ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS at_
  FROM (SELECT *, unnest(all_s) AS s, generate_subscripts(all_s, 1) AS j
        FROM (SELECT *, regexp_extract_all(line, '[^.!?。！？]+[.!?。！？]*') AS all_s FROM normal
              WHERE strlen(norm) > 48) WHERE len(all_s) >= 2)
),
unit AS (
  SELECT doc_id, i, 0 AS j, low AS start_, low + length(line) AS end_, norm FROM normal
  WHERE norm <> ''
  UNION ALL
  SELECT doc_id, i, j, at_, at_ + length(s), trim(regexp_replace(lower(s), '\s+', ' ', 'g')) FROM part
  WHERE strlen(trim(regexp_replace(lower(s), '\s+', ' ', 'g'))) >= 48
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY norm ORDER BY doc_id, i, j) AS n, min(doc_id) OVER (PARTITION BY norm) AS keep_id
  FROM unit
),
removed AS (SELECT * FROM ranked WHERE n > 1)
SELECT doc_id, CAST(start_ AS INTEGER) AS "start", CAST(end_ AS INTEGER) AS "end", keep_id
FROM removed r
WHERE j = 0 OR NOT EXISTS (SELECT 1 FROM removed w WHERE w.doc_id = r.doc_id AND w.i = r.i AND w.j = 0)
"""

ORACLE["op5_exact_dedup"] = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept,
       text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id ASC NULLS LAST)
"""


def _words(table: str, key: str) -> str:
    return rf"""
  SELECT {key}, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'),
                                   '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM {table}"""


ORACLE["op9_decontamination"] = rf"""
WITH d AS ({_words('documents', 'doc_id')}), i AS ({_words('benchmark', 'item_id')}),
item_size AS (SELECT item_id, w, least(len(w), 10) AS size FROM i WHERE len(w) > 0),
item_at AS (SELECT item_id, w, size, unnest(range(1, len(w) - size + 2)) AS pos FROM item_size),
item_window AS (SELECT DISTINCT item_id, size, array_to_string(list_slice(w, pos, pos + size - 1), ' ') AS key FROM item_at),
doc_at AS (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS pos
           FROM d, (SELECT DISTINCT size FROM item_window) WHERE len(w) >= size),
doc_window AS (SELECT doc_id, size, pos, array_to_string(list_slice(w, pos, pos + size - 1), ' ') AS key FROM doc_at),
hit AS (SELECT doc_id, size, pos, item_id FROM doc_window JOIN item_window USING (size, key)),
spot AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + size)) AS word FROM (SELECT DISTINCT doc_id, pos, size FROM hit)),
spots AS (SELECT doc_id, count(*) AS n_hit FROM spot GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN spots USING (doc_id) LEFT JOIN named USING (doc_id)
"""

# Base32 by the letter of each five bits; the digest is written as 160 binary digits.
ORACLE["op10_warc"] = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex
  FROM pages
),
bits AS (
  SELECT page_id, payload_bytes, hex,
         array_to_string([right(bin(16 + instr('0123456789abcdef', substr(hex, i, 1)) - 1), 4) FOR i IN range(1, 41)], '') AS b
  FROM p
),
coded AS (
  SELECT page_id, payload_bytes, hex,
         array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
           list_sum([CASE WHEN substr(b, 5 * i + j + 1, 1) = '1' THEN 16 >> j ELSE 0 END FOR j IN range(0, 5)]) AS INTEGER), 1)
           FOR i IN range(0, 32)], '')
           AS payload_digest
  FROM bits
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = min(page_id) OVER w THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = min(page_id) OVER w THEN NULL ELSE min(page_id) OVER w END AS refers_to
FROM coded WINDOW w AS (PARTITION BY hex)
"""


def _terms(table: str, key: str) -> str:
    return rf"""
  SELECT {key}, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'),
                                   '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM {table}"""


# Every document that shares a term with an item is scored.
ORACLE["op12_ranking"] = rf"""
WITH d AS ({_terms('documents', 'doc_id')}), i AS ({_terms('benchmark', 'item_id')}),
size AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n FROM d WHERE len(w) > 0),
total AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(n) AS BIGINT) AS n_words FROM size),
posting AS (SELECT doc_id, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM d) GROUP BY ALL),
item_term AS (SELECT item_id, term, CAST(count(*) AS BIGINT) AS times FROM (SELECT item_id, unnest(w) AS term FROM i) GROUP BY ALL),
weight AS (
  SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM posting GROUP BY term), total
),
scored AS (
  SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * n_docs) // n_words)))) AS BIGINT) AS score
  FROM item_term JOIN posting USING (term) JOIN weight USING (term) JOIN size USING (doc_id), total
  GROUP BY item_id, doc_id
)
SELECT item_id, CAST(row_number() OVER w AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0
WINDOW w AS (PARTITION BY item_id ORDER BY score DESC, doc_id)
QUALIFY rank <= 10
"""

# CRC-32 bit by bit: each byte is mixed in before the first of its eight steps.
ORACLE["op13_prefix_trie"] = """
WITH conv AS (
  SELECT conv_id, CAST(list_reduce(
           list_prepend(4294967295::BIGINT, flatten([[CAST(ascii(substr(CAST(conv_id AS VARCHAR), i, 1)) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]
                                               FOR i IN range(1, 1 + length(CAST(conv_id AS VARCHAR)))])),
           lambda crc, byte: xor(xor(crc, byte) >> 1, (xor(crc, byte) & 1) * 3988292384)) AS BIGINT) AS state
  FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL)
),
head AS (SELECT conv_id, conv_id - conv_id % 5 AS base, xor(state, 4294967295) % 9 AS h FROM conv),
turned AS (
  SELECT conv_id, list(struct_pack(role := coalesce(role, ''), text := coalesce(text, '')) ORDER BY turn NULLS FIRST) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
),
rebuilt AS (
  SELECT conv_id, list_concat(coalesce(list_slice(b.turns, 1, h), []), list_slice(o.turns, h + 1, len(o.turns))) AS turns
  FROM head JOIN turned o USING (conv_id) LEFT JOIN (SELECT conv_id AS base, turns FROM turned) b USING (base)
),
prefix AS (
  SELECT conv_id, CAST(d AS BIGINT) AS depth, list_slice(turns, 1, d) AS path, len(turns) AS size
  FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM rebuilt)
),
node AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE size = depth), '')) AS ends_sha256,
         CASE WHEN depth = 0 THEN 0 ELSE (count(*) - 1) * strlen(path[-1].text) END AS saved
  FROM prefix GROUP BY path, depth
),
child AS (SELECT list_slice(path, 1, depth - 1) AS path, depth - 1 AS depth, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY ALL),
full_node AS (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN child USING (path, depth)),
below AS (
  SELECT list_slice(path, 1, d) AS path, CAST(d AS BIGINT) AS depth, sum(saved) AS saved_tokens,
         count(*) FILTER (WHERE n_children = 0) AS n_leaves
  FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM full_node) GROUP BY ALL
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves,
       CAST(saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM full_node n JOIN below USING (path, depth)
LEFT JOIN node p ON n.depth > 0 AND p.depth = n.depth - 1 AND p.path = list_slice(n.path, 1, n.depth - 1)
"""
