"""SQL that gives the rows of those queries of this subpackage that SQL can express."""

from __future__ import annotations

_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v{g} >> {shift}) & 31 AS INTEGER) + 1, 1)" for g in range(8) for shift in (15, 10, 5, 0))
_GROUPS = ", ".join(f"CAST('0x' || substr(h, {5 * g + 1}, 5) AS BIGINT) AS v{g}" for g in range(8))



def _box(kind: str, size: str, *content: str) -> str:
    """A box in hexadecimal, of SQL expressions: its size, kind and content."""
    return " || ".join([f"printf('%08x', {size})", f"'{kind.encode().hex()}'", *content])


# Fixed values of the container: sizes in bytes of boxes, and what stands in them, in the order of the format.
_MATRIX = "'" + "".join(f"{x:08x}" for x in (0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)) + "'"
_STBL, _MINF = "(144 + 8 * n_ticks + 8 * c + 12 * n_spans + 4 * n)", "(204 + 8 * n_ticks + 8 * c + 12 * n_spans + 4 * n)"
_MDIA, _TRAK, _MOOV = f"(92 + {_MINF})", f"(204 + {_MINF})", f"(332 + {_MINF})"
_FIRST = f"(32 + {_MOOV})"  # where the samples begin
_TABLES = [
    _box("stsd", "52", "'0000000000000001'", _box("raw ", "36", "'0000000000000001' || repeat('00', 8) || '00010008000000001f400000'")),
    _box("stts", "16 + 8 * n_ticks", "'00000000'", "printf('%08x', n_ticks)", "ticks"),
    _box("stss", "16 + 4 * c", "'00000000'", "printf('%08x', c)", "keys"),
    _box("stsc", "16 + 12 * n_spans", "'00000000'", "printf('%08x', n_spans)", "spans"),
    _box("stsz", "20 + 4 * n", "'0000000000000000'", "printf('%08x', n)", "repeat('00000400', n - 1)", "printf('%08x', last)"),
    _box("stco", "16 + 4 * c", "'00000000'", "printf('%08x', c)", "places"),
]
_MEDIA = " || ".join(
    [
        _box("ftyp", "24", "'69736f6d0000020069736f6d6d703432'"),
        _box("moov", _MOOV),
        _box("mvhd", "120", "'01000000' || repeat('00', 16) || '00001f40'", "printf('%016x', l)", "'000100000100' || repeat('00', 10)", _MATRIX, "repeat('00', 24) || '00000002'"),
        _box("trak", _TRAK),
        _box("tkhd", "104", "'01000003' || repeat('00', 16) || '0000000100000000'", "printf('%016x', l)", "repeat('00', 8) || '0000000001000000'", _MATRIX, "repeat('00', 8)"),
        _box("mdia", _MDIA),
        _box("mdhd", "44", "'01000000' || repeat('00', 16) || '00001f40'", "printf('%016x', l)", "'55c40000'"),
        _box("hdlr", "40", "'0000000000000000' || '736f756e' || repeat('00', 12) || '73616d706c657300'"),
        _box("minf", _MINF),
        _box("smhd", "16", "'0000000000000000'"),
        _box("dinf", "36", _box("dref", "28", "'0000000000000001'", _box("url ", "12", "'00000001'"))),
        _box("stbl", _STBL),
        *_TABLES,
        _box("mdat", "8 + l", "x"),
    ]
)

ORACLE_SQL = {
    "op2_blocks": r"""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w)),
least AS (SELECT h, min(doc_id) AS least FROM win GROUP BY h),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM (SELECT doc_id, i, unnest(range(50)) AS k FROM win JOIN least USING (h) WHERE least < doc_id)),
word AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id""",
    "op4_jaccard": r"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(ws[i:i + 4], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, least(len(ws), 1) + 1))) AS i FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT x, y FROM common JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 80 * (a.n + b.n - k)),
pair AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (SELECT x AS doc_id, x AS other FROM pair UNION SELECT reach.doc_id, pair.y FROM reach JOIN pair ON pair.x = reach.other)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.c, w.doc_id) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN (SELECT doc_id, min(other) AS c FROM reach GROUP BY doc_id) c ON c.doc_id = w.doc_id""",
    "op7_suffixes": r"""
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
win AS (SELECT doc_id, i, md5(substr(x, 2 * i + 1, 100)) AS h FROM (SELECT doc_id, x, unnest(range(0, CAST(length(x) / 2 - 49 AS BIGINT))) AS i FROM b)),
least AS (SELECT h, min(doc_id) AS least FROM win GROUP BY h),
hit AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM win JOIN least USING (h) WHERE least < doc_id),
run AS (SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i - before > 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM hit),
span AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS z FROM run GROUP BY doc_id, r),
piece AS (SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS z FROM span
    UNION ALL SELECT b.doc_id, coalesce(max(z), 0), CAST(length(any_value(x)) / 2 AS BIGINT) FROM b LEFT JOIN span ON span.doc_id = b.doc_id GROUP BY b.doc_id),
kept AS (SELECT piece.doc_id, string_agg(substr(x, CAST(2 * a + 1 AS BIGINT), CAST(2 * (z - a) AS BIGINT)), '' ORDER BY a) AS kept FROM piece JOIN b ON b.doc_id = piece.doc_id GROUP BY piece.doc_id)
SELECT b.doc_id, CAST(length(x) / 2 AS BIGINT) AS n_bytes, CAST((length(x) - length(kept)) / 2 AS BIGINT) AS n_removed, coalesce(n.n, 0) AS n_spans, sha256(unhex(kept)) AS kept_sha256
FROM b JOIN kept ON kept.doc_id = b.doc_id LEFT JOIN (SELECT doc_id, count(*) AS n FROM span GROUP BY doc_id) n ON n.doc_id = b.doc_id""",
    "op8_media": f"""
WITH RECURSIVE step AS (SELECT 0 AS k, 1::BIGINT AS one, 4294967295::BIGINT AS start
    UNION ALL SELECT k + 1, xor(one >> 1, (one & 1) * 3988292384), xor(start >> 1, (start & 1) * 3988292384) FROM step WHERE k < 512),
d AS (SELECT doc_id, row_number() OVER () AS r, lower(hex(encode(coalesce(text, '')))) AS raw FROM documents),
p AS (SELECT doc_id, r, CAST(length(raw) // 2 AS BIGINT) AS n_bytes, raw || repeat('00', CASE WHEN raw = '' THEN 64 ELSE CAST((64 - length(raw) // 2 % 64) % 64 AS BIGINT) END) AS x FROM d),
s AS (SELECT *, CAST(length(x) // 2 AS BIGINT) AS l, CAST((length(x) // 2 + 1023) // 1024 AS BIGINT) AS n, CAST((length(x) // 2 + 16383) // 16384 AS BIGINT) AS c FROM p),
t AS (SELECT *, l - 1024 * (n - 1) AS last, n - 16 * (c - 1) AS last_in, CASE WHEN n = 1 OR l % 1024 = 0 THEN 1 ELSE 2 END AS n_ticks, CASE WHEN c = 1 OR n % 16 = 0 THEN 1 ELSE 2 END AS n_spans FROM s),
u AS (SELECT *, CASE WHEN n_ticks = 2 THEN printf('%08x', n - 1) || '00000400' || printf('%08x', 1) || printf('%08x', last) ELSE printf('%08x', n) || printf('%08x', last) END AS ticks,
    CASE WHEN n_spans = 2 THEN printf('%08x', 1) || printf('%08x', 16) || printf('%08x', 1) || printf('%08x', c) || printf('%08x', last_in) || printf('%08x', 1) ELSE printf('%08x', 1) || printf('%08x', least(n, 16)) || printf('%08x', 1) END AS spans FROM t),
chunk AS (SELECT r, string_agg(printf('%08x', 1 + 16 * i), '' ORDER BY i) AS keys, string_agg(printf('%08x', {_FIRST} + 16384 * i), '' ORDER BY i) AS places FROM (SELECT r, n, c, n_ticks, n_spans, unnest(range(c)) AS i FROM u) GROUP BY r),
m AS (SELECT u.*, {_FIRST} AS first, {_MEDIA} AS media FROM u JOIN chunk USING (r)),
bit AS (SELECT r, i, CAST('0x' || substr(tail, CAST(2 * (i // 8) + 1 AS BIGINT), 2) AS BIGINT) >> (i % 8) & 1 AS b FROM (SELECT r, substr(x, length(x) - 127) AS tail, unnest(range(512)) AS i FROM p)),
crc AS (SELECT r, xor(xor(coalesce(bit_xor(one) FILTER (b = 1), 0), (SELECT start FROM step WHERE k = 512)), 4294967295) AS tail_crc32 FROM bit JOIN step ON k = 512 - i GROUP BY r)
SELECT doc_id, n_bytes, l AS payload_bytes, sha256(unhex(x)) AS payload_sha256, CAST(tail_crc32 AS BIGINT) AS tail_crc32, CAST(length(media) // 2 AS BIGINT) AS media_bytes, sha256(unhex(media)) AS media_sha256,
'codec=raw;timescale=8000;ticks=' || l || ';samples=' || n || ';keys=' || c || ';first_key=' || first || '-' || (first + least(1024, l)) || ';last_key=' || (first + 16384 * (c - 1)) || '-' || (first + least(l, 16384 * (c - 1) + 1024)) AS feature
FROM m JOIN crc USING (r)""",
    "op10_warc": f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
h AS (SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS n, sha1(payload) AS h FROM p),
g AS (SELECT page_id, n, h, max(page_id) OVER (PARTITION BY h) AS last, {_GROUPS} FROM h)
SELECT page_id, n AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id < last THEN last END AS refers_to
FROM g""",
}
