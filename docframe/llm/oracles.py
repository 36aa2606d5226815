"""DuckDB SQL for the queries of this folder that SQL can express."""

from __future__ import annotations

from . import fingerprints as fp
from . import mixing as mx
from . import quality_rules as qr

_WS = "'[\\x20\\x09-\\x0D]+'"
_BLANK = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"


#: CTE crcs (tok, crc): CRC-32 of the distinct strings of CTE ``tokens`` (tok), by the table of bytes.
_CRC = """
crc_step AS (
  SELECT list(list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END) ORDER BY n) AS t
  FROM (SELECT unnest(range(256)) AS n)
),
crcs AS (
  SELECT tok, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, b: xor(t[xor(c, b) % 256 + 1], c // 256))) AS crc
  FROM (SELECT tok, list_transform(range(1, len(x), 2), lambda i: ('0x' || substr(x, i, 2))::BIGINT) AS bytes
        FROM (SELECT tok, hex(encode(tok)) AS x FROM (SELECT DISTINCT tok FROM tokens))), crc_step
)"""


def _joined(tokens: list[str]) -> str:
    out = f"{tokens[0]}::UBIGINT"
    for j, t in enumerate(tokens[1:], 1):
        out = f"xor({out}, {t}::UBIGINT << {fp.SHIFT * j})"
    return out


def _anchors(part: str) -> str:
    """CTEs ``{part}`` (id, pos, hash), its first places ``{part}_1``, and ``{part}_print`` (id, print, cover)."""
    return f"""
{part}_tok AS (SELECT id, pos, crc::BIGINT AS h FROM tokens JOIN crcs USING (tok) WHERE part = '{part}'),
{part}_mer AS (SELECT id, row_number() OVER w - 1 AS pos, h AS t1, lead(h, 1) OVER w AS t2, lead(h, 2) OVER w AS t3, count(*) OVER (PARTITION BY id) AS n FROM {part}_tok WINDOW w AS (PARTITION BY id ORDER BY pos)),
{part} AS (
  SELECT id, pos, {_joined(["t1", "t2", "t3"])} AS hash FROM {part}_mer WHERE n > {fp.K} AND t3 IS NOT NULL AND least(t1, t3) <= t2
  UNION ALL
  SELECT id, 0, {_joined(["t1", "coalesce(t2, 0)", "coalesce(t3, 0)"])} FROM {part}_mer WHERE n <= {fp.K} AND pos = 0
),
{part}_1 AS (SELECT id, hash, min(pos) AS pos FROM {part} GROUP BY id, hash),
{part}_print AS (
  SELECT id, string_agg(step || lpad(format('{{:x}}', hash), 16, '0'), '' ORDER BY pos) AS print
  FROM (SELECT *, pos - coalesce(lag(pos) OVER w, 0) AS step FROM {part} WINDOW w AS (PARTITION BY id ORDER BY pos)) GROUP BY id
),
{part}_cover AS ({_cover(f"{part}_1", "pos")})"""


def _cover(table: str, pos: str) -> str:
    return f"SELECT id, sum(new) AS cover FROM (SELECT id, least({fp.K}, coalesce({pos} - lag({pos}) OVER (PARTITION BY id ORDER BY {pos}), {fp.K})) AS new FROM {table}) GROUP BY id"


def _near(name: str, a: str, b: str) -> str:
    return f"CASE WHEN {a}.cover IS NULL AND {b}.cover IS NULL THEN 1.0 ELSE coalesce({name}_a.cover + {name}_b.cover, 0)::DOUBLE / (coalesce({a}.cover, 0) + coalesce({b}.cover, 0)) END"


OP1 = f"""
WITH base AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
ring AS (
  SELECT doc_id, text, coalesce(lead(doc_id) OVER o, min(doc_id) OVER ()) AS next_id,
         coalesce(lead(text) OVER o, first_value(text) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS next_text
  FROM base WINDOW o AS (ORDER BY doc_id)
),
edits AS (
  SELECT doc_id AS id, substr(text, 1, length(text) - length(text) // 2) || substr(next_text, 1, length(text) // 2) AS text FROM ring
),
tokens AS (
  SELECT part, id, unnest(toks) AS tok, generate_subscripts(toks, 1) AS pos
  FROM (SELECT part, id, regexp_extract_all(text, '{fp.TOKEN}') AS toks
        FROM (SELECT 'own' AS part, doc_id AS id, text FROM ring UNION ALL SELECT 'edited', * FROM edits))
),
{_CRC.strip()},
{_anchors('own')},
{_anchors('edited')},
with_edited AS (SELECT o.id, o.pos AS a, e.pos AS b FROM own_1 o JOIN edited_1 e ON e.id = o.id AND e.hash = o.hash),
with_next AS (SELECT r.doc_id AS id, o.pos AS a, x.pos AS b FROM ring r JOIN own_1 o ON o.id = r.doc_id JOIN own_1 x ON x.id = r.next_id AND x.hash = o.hash),
e_a AS ({_cover('with_edited', 'a')}), e_b AS ({_cover('with_edited', 'b')}), n_a AS ({_cover('with_next', 'a')}), n_b AS ({_cover('with_next', 'b')})
SELECT r.doc_id, length(r.text)::BIGINT AS n_chars, sha256(d.text) AS edited_sha256, coalesce(p.print, '') AS fingerprint, coalesce(q.print, '') AS edited_fingerprint,
       {_near('e', 'oc', 'ec')} AS near_edited, {_near('n', 'oc', 'nc')} AS near_next
FROM ring r JOIN edits d ON d.id = r.doc_id
LEFT JOIN own_print p ON p.id = r.doc_id LEFT JOIN edited_print q ON q.id = r.doc_id
LEFT JOIN own_cover oc ON oc.id = r.doc_id LEFT JOIN edited_cover ec ON ec.id = r.doc_id LEFT JOIN own_cover nc ON nc.id = r.next_id
LEFT JOIN e_a ON e_a.id = r.doc_id LEFT JOIN e_b ON e_b.id = r.doc_id LEFT JOIN n_a ON n_a.id = r.doc_id LEFT JOIN n_b ON n_b.id = r.doc_id
"""

_B = qr.BUCKETS
OP2 = f"""
WITH base AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos
  FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, {_WS}), lambda x: x <> '') AS ws FROM base)
),
windows AS (
  SELECT doc_id, pos, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o AS win
  FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY pos)
),
again AS (SELECT doc_id, pos FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, win) AS n FROM windows WHERE win IS NOT NULL) WHERE n > 1),
repeats AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT doc_id, unnest([pos, pos + 1, pos + 2]) AS p FROM again) GROUP BY doc_id
),
stats AS (SELECT doc_id, count(*) AS n_words, sum(length(word)) AS word_chars FROM w GROUP BY doc_id),
lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM base) WHERE translate(line, {_BLANK}, '') <> '' GROUP BY doc_id
),
rules AS (
  SELECT b.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
         (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM base b LEFT JOIN stats USING (doc_id) LEFT JOIN lines USING (doc_id) LEFT JOIN repeats USING (doc_id)
),
tokens AS (
  SELECT doc_id, unnest(ts) AS tok, generate_subscripts(ts, 1) AS pos
  FROM (SELECT doc_id, regexp_extract_all(lower(text), '{qr.TOKEN}') AS ts FROM base)
),
{_CRC.strip()},
tok AS (SELECT doc_id, pos, crc % {_B} AS b FROM tokens JOIN crcs USING (tok)),
pairs AS (SELECT doc_id, b, lag(b) OVER (PARTITION BY doc_id ORDER BY pos) AS a FROM tok),
grams AS (
  SELECT doc_id, b AS place FROM pairs
  UNION ALL
  SELECT doc_id, CASE WHEN a = b THEN {2 * _B} ELSE {_B} + (a * 7919 + b * 104729) % {_B} END FROM pairs WHERE a IS NOT NULL
),
trusted AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1),
counts AS (
  SELECT place, count(*) AS r, count(t.doc_id) AS t FROM grams g LEFT JOIN trusted t USING (doc_id) GROUP BY place
),
sums AS (SELECT sum(t) + {qr.SMOOTHING} * {qr.TABLE} AS nt, sum(r) + {qr.SMOOTHING} * {qr.TABLE} AS nr FROM counts),
ratios AS (SELECT place, ln((t + {qr.SMOOTHING}) / nt) - ln((r + {qr.SMOOTHING}) / nr) AS ratio FROM counts, sums),
verdict AS (SELECT doc_id, avg(ratio) AS ratio FROM grams JOIN ratios USING (place) GROUP BY doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND coalesce(ratio, 0) >= {qr.THRESHOLD} AS kept
FROM rules LEFT JOIN verdict USING (doc_id)
"""

OP9 = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
q AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS largest FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < largest THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < largest THEN largest END AS refers_to
FROM q
"""

#: One step of ``walk`` is a slot; sources are numbered from 1 in the order of their keys.
OP5 = f"""
WITH RECURSIVE base AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS key, md5('5:' || coalesce(doc_id::VARCHAR, '')) AS hash FROM documents
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY hash, doc_id) - 1 AS rank, dense_rank() OVER (ORDER BY key) AS k FROM base),
sizes AS (SELECT list(n ORDER BY key) AS total, list(sqrt(n) ORDER BY key) AS roots FROM (SELECT key, count(*) AS n FROM base GROUP BY key)),
raised AS (SELECT *, greatest({mx.PRECISION}, 8 * len(total)) AS p, list_transform(roots, lambda x: greatest(x, list_sum(roots) / greatest({mx.PRECISION}, 8 * len(total)))) AS weights FROM sizes),
plan AS (
  SELECT total, list_transform(weights, lambda x: round(x / list_sum(weights) * p)::BIGINT) AS parts, range(1, len(total) + 1) AS idx, list_sum(total)::BIGINT AS n FROM raised
),
walk AS (
  SELECT -1::BIGINT AS slot, -1::BIGINT AS phase, 0::BIGINT AS began, list_transform(idx, lambda x: 0::BIGINT) AS cnt, list_transform(idx, lambda x: 0::BIGINT) AS done,
         true AS ended, 0::BIGINT AS k, 0::BIGINT AS block, 0::BIGINT AS release, 0::BIGINT AS deadline FROM plan
  UNION ALL
  SELECT slot, phase, began, list_transform(idx, lambda x: cnt[x] + (x = k)::BIGINT), list_transform(idx, lambda x: done[x] + (x = k)::BIGINT),
         done[k] + 1 = total[k], k, done[k], began + cnt[k] * whole // parts[k], began + ((cnt[k] + 1) * whole + parts[k] - 1) // parts[k]
  FROM (
    SELECT *, list_min(list_transform(
        list_filter(idx, lambda x: done[x] < total[x] AND cnt[x] * whole // parts[x] <= slot - began),
        lambda x: ((cnt[x] + 1) * whole + parts[x] - 1) // parts[x] * 1000000 + x)) % 1000000 AS k
    FROM (
      SELECT w.slot + 1 AS slot, w.phase + w.ended::BIGINT AS phase, CASE WHEN w.ended THEN w.slot + 1 ELSE w.began END AS began,
             CASE WHEN w.ended THEN list_transform(idx, lambda x: 0::BIGINT) ELSE w.cnt END AS cnt, w.done, total, parts, idx,
             list_sum(list_transform(idx, lambda x: CASE WHEN w.done[x] < total[x] THEN parts[x] ELSE 0 END))::BIGINT AS whole
      FROM walk w, plan WHERE w.slot + 1 < n
    )
  )
)
SELECT doc_id, source, block, phase, slot, release, deadline, slot AS position
FROM ranked r JOIN walk w ON w.k = r.k AND w.block = r.rank
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_document_fingerprints": OP1, "op2_quality_rules": OP2, "op5_source_mixing": OP5, "op9_warc_normaliser": OP9}
