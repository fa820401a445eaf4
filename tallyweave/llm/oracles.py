"""DuckDB SQL for the queries of this subpackage that SQL can express."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

NGRAM_JOIN = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM w),
each AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM each a JOIN each b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id FROM sets LEFT JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) ON a = doc_id"""

WARC_AUDIT = """
WITH r AS (SELECT page_id, url, html, CAST(floor(page_id / 2048) AS BIGINT) * 1048576 AS volume,
  'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || CAST(page_id AS VARCHAR) || '>' || chr(13) || chr(10) || 'WARC-Date: 2024-01-01T00:00:00Z' || chr(13) || chr(10)
  || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || CAST(octet_length(encode(coalesce(html, ''))) AS VARCHAR) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS record FROM pages),
p AS (SELECT *, octet_length(encode(record)) AS n, row_number() OVER (PARTITION BY volume ORDER BY page_id, url, html) - 1 AS seq FROM r)
SELECT page_id, volume, seq, CAST(coalesce(sum(n) OVER (PARTITION BY volume ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS byte_offset, CAST(n AS BIGINT) AS byte_length, sha256(record) AS sha256_hex, page_id % 1009 = 5 AS damaged FROM p"""

CHAT_FORMAT = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
s AS (SELECT *, length(text) + length(text) - length(replace(text, '\', '')) + (length(text) - length(replace(text, '</turn>', ''))) // 7 + coalesce(list_sum(list_transform(regexp_extract_all(text, '#{3,}'), lambda x: length(x) - 2)), 0) AS n FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n + length(role) + length('### : </turn>') + 1) AS BIGINT) AS formatted_chars
FROM s GROUP BY conv_id"""

TOP_K = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q))
SELECT query_id, CAST(n AS INT) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM p) WHERE n <= 10"""

COLLOCATIONS = f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM w, range(1, 6) AS ks(k)),
c AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY lang, k, phrase),
totals AS (SELECT lang, sum(f) AS n FROM c WHERE k = 1 GROUP BY lang),
often AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, f FROM c WHERE f >= 100),
inner_phrases AS (SELECT lang, f, unnest(list_transform(range(1, k - j + 2), lambda i: array_to_string(w[i:i + j - 1], ' '))) AS phrase FROM often, range(2, 5) AS js(j) WHERE j < k),
longer AS (SELECT lang, phrase, max(f) AS f FROM inner_phrases GROUP BY lang, phrase),
kept AS (SELECT o.* FROM often o LEFT JOIN longer x USING (lang, phrase) WHERE o.k > 1 AND (x.f IS NULL OR 100 * x.f < 100 * o.f)),
cuts AS (SELECT kept.lang, kept.phrase, kept.f AS a, cut, x.f AS l, y.f AS r, n, CAST((1000::HUGEINT * kept.f::HUGEINT * n::HUGEINT) // (x.f::HUGEINT * y.f::HUGEINT) AS BIGINT) AS score
  FROM kept JOIN range(1, 5) AS cs(cut) ON cut < kept.k JOIN totals USING (lang)
  JOIN often x ON x.lang = kept.lang AND x.phrase = array_to_string(kept.w[1:cut], ' ') JOIN often y ON y.lang = kept.lang AND y.phrase = array_to_string(kept.w[cut + 1:], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM best QUALIFY rank <= 2000"""

def _field(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE CAST(octet_length(encode(CAST({value} AS VARCHAR))) AS VARCHAR) || ':' || CAST({value} AS VARCHAR) END"


def _crc32_is_even(value: str) -> str:
    """CRC-32 has the last bit of all ones at its end: bit by bit over the bytes of a short ASCII text."""
    step = "CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END"
    return f"list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({value}, ''), lambda x: ascii(x)::BIGINT)), lambda c, x: {_eight(step)}) % 2 = 1"


def _eight(step: str) -> str:
    """``step`` done eight times to the CRC with a byte in it."""
    return f"list_reduce(list_prepend(xor(c, x), range(8)), lambda c, i: {step})"


LEAF = "sha256(" + " || ".join(_field(v) for v in ("doc_id", "source", "lang", "n_chars"))
MERKLE_MANIFEST = f"""
WITH RECURSIVE leaves AS (SELECT doc_id, source, {LEAF} || {_field("text")}) AS leaf, {LEAF} || {_field("replace(text, chr(10), '')")}) AS cut, {_crc32_is_even("CAST(doc_id AS VARCHAR)")} AS hit FROM documents),
placed AS (SELECT *, coalesce('=' || source, '') AS grp, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM leaves),
own AS (SELECT grp, 0 AS lvl, pos, leaf AS h, n FROM placed UNION ALL SELECT grp, lvl + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3 FROM own WHERE n > 1 GROUP BY grp, lvl, pos // 3, n),
tops AS (SELECT grp, h AS subroot, row_number() OVER (ORDER BY encode(grp)) - 1 AS pos, count(*) OVER () AS n FROM own WHERE n = 1),
upper_nodes AS (SELECT 0 AS lvl, pos, subroot AS h, n FROM tops UNION ALL SELECT lvl + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3 FROM upper_nodes WHERE n > 1 GROUP BY lvl, pos // 3, n),
runs AS (SELECT grp, lvl, pos, h, n FROM own WHERE n > 1 UNION ALL SELECT NULL, lvl, pos, h, n FROM upper_nodes WHERE n > 1),
beside AS (SELECT a.grp, a.lvl, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r FROM runs a JOIN runs b ON a.grp IS NOT DISTINCT FROM b.grp AND a.lvl = b.lvl AND a.pos // 3 = b.pos // 3 GROUP BY 1, 2, 3),
steps AS (SELECT doc_id, b.lvl AS step, l, r FROM placed p JOIN beside b ON b.grp = p.grp AND b.pos = p.pos // CAST(pow(3, b.lvl) AS BIGINT)
  UNION ALL SELECT doc_id, 1000 + b.lvl, l, r FROM placed p JOIN tops t USING (grp) JOIN beside b ON b.grp IS NULL AND b.pos = t.pos // CAST(pow(3, b.lvl) AS BIGINT)),
path AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY step) AS k FROM steps),
fold AS (SELECT doc_id, 0 AS k, CASE WHEN hit THEN cut ELSE leaf END AS h FROM leaves UNION ALL SELECT f.doc_id, f.k + 1, sha256(l || h || r) FROM fold f JOIN path p ON p.doc_id = f.doc_id AND p.k = f.k + 1),
folded AS (SELECT doc_id, max_by(h, k) AS folded_root FROM fold GROUP BY 1),
proofs AS (SELECT doc_id, sha256(string_agg(l || r, '' ORDER BY k)) AS proof_sha256 FROM path GROUP BY 1), root AS (SELECT h AS root FROM upper_nodes WHERE n = 1)
SELECT doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified FROM placed JOIN tops USING (grp) JOIN folded USING (doc_id) LEFT JOIN proofs USING (doc_id), root"""

ORACLES = {"op1_ngram_join": NGRAM_JOIN, "op8_warc_audit": WARC_AUDIT, "op9_chat_format": CHAT_FORMAT, "op10_topk": TOP_K, "op12_collocations": COLLOCATIONS, "op13_merkle_manifest": MERKLE_MANIFEST}
