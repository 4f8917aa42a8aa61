"""DuckDB SQL for the corpus queries that SQL can express, over whole tables."""

from __future__ import annotations

from .mixing import BUCKET_ROWS
from .repetition import MAX_COVERED, MAX_LONGEST, MIN_REPEAT

_CHAT = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
    UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
)
SELECT
    conv_id,
    count(*)::BIGINT AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(
        length('<|im_start|>') + length(replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '<', '%3C')) + 1
        + length(replace(replace(text, '\', '\\'), '<|', '<\|')) + length('<|im_end|>') + 1
    )::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
"""

_MIX = f"""
WITH sized AS (
    SELECT
        doc_id, coalesce('0' || source, '1') AS skey,
        len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
        ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || size), 1, 8))::BIGINT AS hash
    FROM documents
),
per AS (
    SELECT
        skey, sum(size)::BIGINT AS source_size, count(*) AS n,
        CASE (row_number() OVER (ORDER BY skey) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight
    FROM sized GROUP BY skey
),
room AS (SELECT *, 2.0::DOUBLE * source_size / weight AS room FROM per),
level AS (
    SELECT *,
        (1.5::DOUBLE * sum(source_size) OVER ()::BIGINT
            - 2.0::DOUBLE * coalesce(sum(source_size) OVER (ORDER BY room, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)
        / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY room, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) AS level
    FROM room
),
water AS (SELECT level AS water FROM level WHERE room > level ORDER BY room, skey LIMIT 1),
per_source AS (
    SELECT
        skey, source_size, n,
        CASE WHEN water IS NULL OR room <= water THEN 2.0::DOUBLE * source_size ELSE weight * water END AS target,
        ('0x' || substr(md5('offset:' || skey), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS off
    FROM level LEFT JOIN water ON true
),
placed AS (
    SELECT s.*, p.source_size, p.target, p.off,
        CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS copies,
        size - size % (1::BIGINT << greatest(0, length(bin(size)) - 6)) AS class,
        floor(hash * ceil(n / {BUCKET_ROWS}.0::DOUBLE) / 4294967296.0::DOUBLE) AS bucket
    FROM sized s JOIN per_source p USING (skey)
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY skey ORDER BY class, bucket, hash, doc_id NULLS FIRST, size) AS rank FROM placed),
counted AS (
    SELECT *,
        CASE WHEN size > 0 THEN least(floor(off + rank * copies) - floor(off + (rank - 1) * copies), ceil(copies))::INTEGER ELSE 0 END AS taken_copies
    FROM ranked
)
SELECT doc_id, size, source_size, target, (size * taken_copies)::BIGINT AS taken, taken_copies AS copies FROM counted
"""

_JOIN = r"""
WITH RECURSIVE words AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents
),
shingles AS (
    SELECT r, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS g
    FROM words
),
sizes AS (SELECT r, count(*) AS n FROM shingles GROUP BY r),
shared AS (SELECT g FROM shingles GROUP BY g HAVING count(*) > 1),
sharing AS (SELECT s.r, s.g FROM shingles s SEMI JOIN shared USING (g)),
able AS (SELECT r FROM sharing JOIN sizes USING (r) GROUP BY r, n HAVING 100 * count(*) >= 80 * n),
few AS (SELECT s.r, s.g FROM sharing s SEMI JOIN able USING (r)),
pairs AS (SELECT a.r AS a, b.r AS b, count(*) AS o FROM few a JOIN few b ON a.g = b.g AND a.r < b.r GROUP BY 1, 2),
links AS (
    SELECT a, b FROM pairs JOIN sizes x ON x.r = a JOIN sizes y ON y.r = b WHERE 100 * o >= 80 * (x.n + y.n - o)
),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
degree AS (SELECT a AS r, count(*) AS n_links FROM both_ways GROUP BY a),
reach(r, t) AS (SELECT r, r FROM words UNION SELECT reach.r, b FROM reach JOIN both_ways ON a = t),
least_id AS (SELECT reach.r, min(doc_id) AS component_id FROM reach JOIN words ON words.r = t GROUP BY reach.r),
-- Rows with equal sets.
copy_of AS (SELECT r, sha256(array_to_string(list_sort(list(g)), chr(10))) AS h FROM shingles GROUP BY r),
copies AS (SELECT h, count(*) AS copies FROM copy_of GROUP BY h)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, coalesce(copies, 1)::BIGINT AS copies, coalesce(n_links, 0)::BIGINT AS n_links
FROM words JOIN least_id USING (r) LEFT JOIN sizes USING (r) LEFT JOIN degree USING (r) LEFT JOIN copy_of USING (r) LEFT JOIN copies USING (h)
"""

# Words that repeats of at least so many words cover are the words of windows of that many that are found twice or more;
# a repeat over the limit is a window of one word more than the limit that is found twice or more.
_windows = lambda size: f"list_transform(range(1, len(w) - {size} + 2), lambda i: array_to_string(w[i:i + {size} - 1], ' '))"
_covered = lambda size: f"""(
    SELECT r, count(DISTINCT i + k) AS n FROM (
        SELECT r, i, count(*) OVER (PARTITION BY r, g) AS held FROM (SELECT r, unnest({_windows(size)}) AS g, unnest(range(1, len(w) - {size} + 2)) AS i FROM split) x
    ) y, range(0, {size}) t(k) WHERE held > 1 GROUP BY r)"""  # noqa: E731
_RULES = rf"""
WITH split AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
),
lines AS (SELECT r, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l FROM split),
counted AS (
    SELECT
        doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
        (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(three.n, 0)::BIGINT AS n_repeat_words, coalesce(cover.n, 0)::BIGINT AS covered_words,
        len({_windows(MAX_LONGEST + 1)}) > len(list_distinct({_windows(MAX_LONGEST + 1)})) AS too_long_repeat
    FROM split JOIN lines USING (r) LEFT JOIN {_covered(3)} three USING (r) LEFT JOIN {_covered(MIN_REPEAT)} cover USING (r)
),
failed AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted)
SELECT *, NOT base_failed AND covered_words <= {MAX_COVERED}::DOUBLE * n_words AND NOT too_long_repeat AS kept FROM failed
"""



def _crc_table() -> list[int]:
    out = []
    for x in range(256):
        for _ in range(8):
            x = x >> 1 ^ (0xEDB88320 if x & 1 else 0)
        out.append(x)
    return out


# The payload in 24 columns. A hash's cells are 3T of its 24T rows high and 8/3 columns wide, so that a column's share of
# a cell is counted in thirds.
_MEDIA = rf"""
WITH crc AS (SELECT {_crc_table()} AS t),
body AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
sized AS (SELECT r, doc_id, b, octet_length(b) AS n, greatest(1, (octet_length(b) + 575) // 576) AS tiles FROM body),
padded AS (SELECT r, doc_id, n, tiles, b || unhex(repeat('FF', (576 * tiles - n)::BIGINT)) AS p FROM sized),
spread AS (SELECT r, tiles, unnest(regexp_extract_all(hex(p), '..')) AS h, unnest(range(576 * tiles)) AS i FROM padded),
columns AS (SELECT r, (i // 24) // (3 * tiles) AS y, i % 24 AS c, sum(('0x' || h)::INT)::BIGINT AS s FROM spread GROUP BY ALL),
cells AS (
    SELECT r, y, x, sum(s * greatest(0, least(3 * (c + 1), 8 * (x + 1)) - greatest(3 * c, 8 * x))) AS s
    FROM columns, range(9) t(x) WHERE least(3 * (c + 1), 8 * (x + 1)) > greatest(3 * c, 8 * x) GROUP BY ALL
),
bits AS (SELECT a.r, a.y, sum(CASE WHEN b.s > a.s THEN 1 << (7 - a.x)::INT ELSE 0 END)::INT AS v FROM cells a JOIN cells b ON a.r = b.r AND a.y = b.y AND b.x = a.x + 1 GROUP BY ALL),
hashes AS (SELECT r, string_agg(printf('%02x', v), '' ORDER BY y) AS dhash FROM bits GROUP BY r),
means AS (SELECT r, sum(s) AS s FROM columns GROUP BY r),
head AS (SELECT r, '{{''descr'': ''|u1'', ''fortran_order'': False, ''shape'': (' || tiles || ', 24, 24)}}' AS h FROM padded),
stored AS (
    SELECT r, doc_id, n, tiles, p, '\x93NUMPY\x01\x00'::BLOB || unhex(printf('%02X00', (length(h) + 11 + 63) // 64 * 64 - 10))
        || encode(h || repeat(' ', (length(h) + 11 + 63) // 64 * 64 - length(h) - 11) || chr(10)) || p AS npy
    FROM padded JOIN head USING (r)
)
SELECT
    doc_id, n::BIGINT AS n_bytes, octet_length(p)::BIGINT AS payload_bytes, sha256(p) AS payload_sha256,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(right(hex(p), 64), '..'), lambda h: ('0x' || h)::BIGINT)),
        lambda a, b: xor(t[xor(a, b) % 256 + 1]::BIGINT, a >> 8)), 4294967295::BIGINT) AS tail_crc32,
    octet_length(npy)::BIGINT AS media_bytes, sha256(npy) AS media_sha256,
    dhash || ':' || printf('%.6f', s::DOUBLE / octet_length(p)) AS feature, tiles::INT AS n_tiles
FROM stored JOIN hashes USING (r) JOIN means USING (r), crc
"""

ORACLES = {"op4_media_columns": _MEDIA, "op8_quality_rules": _RULES, "op1_ngram_jaccard_join": _JOIN, "op3_chat_formatting": _CHAT, "op7_mixing": _MIX}
