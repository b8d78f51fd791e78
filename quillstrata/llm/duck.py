"""SQL counterparts of the queries that SQL can express. They read whole tables and follow the contracts' wording, not the operators."""

from __future__ import annotations

from quillstrata.llm.secrets import RULES

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _either_case(*names: str) -> str:
    """A pattern for ASCII words in either case; the engine's own flag would fold other scripts' letters too."""
    return "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in name) for name in names)


# Patterns of the base kinds as the contract words them; those of the added kinds are the operator's own.
_PATTERNS = {
    "assign": f"({_either_case('password', 'passwd', 'secret', 'token', 'api_?key')})"
    r"""["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
} | {r.kind: r.pattern for r in RULES[3:]}
# (group, characters it must have) by kind.
_LEAST = {"assign": (2, 8), "access": (0, 16), "hex": (0, 32)}


def _matches(rank: int, kind: str, pattern: str) -> str:
    group, least = _LEAST.get(kind, (0, 1))
    return f"""
  SELECT rid, {rank} AS rank, '{kind}' AS kind, upto - length(m) AS start, upto AS stop
  FROM (
    SELECT rid, m, s, sum(length(b) + length(m)) OVER (PARTITION BY rid ORDER BY k) AS upto
    FROM (
      SELECT rid, unnest(m) AS m, unnest(s) AS s, unnest(b[1:len(m)]) AS b, unnest(range(len(m))) AS k
      FROM (
        SELECT rid, regexp_extract_all(text, '{pattern}') AS m, regexp_extract_all(text, '{pattern}', {group}) AS s,
               string_split_regex(text, '{pattern}') AS b
        FROM d WHERE regexp_matches(text, '{pattern}')
      )
    )
  )
  WHERE length(s) >= {least}"""


SECRETS = f"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents
), spans AS (
{" UNION ALL ".join(_matches(k, kind, pattern) for k, (kind, pattern) in enumerate(_PATTERNS.items()))}
), listed AS (
  SELECT rid,
         count(*) FILTER (kind = 'assign') AS n_assign,
         count(*) FILTER (kind = 'access') AS n_access,
         count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(concat_ws(':', kind, CAST(start AS BIGINT), CAST(stop AS BIGINT)), ',' ORDER BY start, rank) FILTER (rank < 3) AS base,
         string_agg(concat_ws(':', kind, CAST(start AS BIGINT), CAST(stop AS BIGINT)), ',' ORDER BY start, rank) AS spans
  FROM spans GROUP BY rid
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN listed USING (rid)
"""

_BARE = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

DECONTAMINATE = f"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_BARE}') AS w FROM documents
), i AS (
  SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_BARE}') AS w FROM benchmark
), item_windows AS MATERIALIZED (
  SELECT DISTINCT item_id, size, unnest(list_transform(range(1, len(w) - size + 2), lambda p: array_to_string(w[p : p + size - 1], ' '))) AS piece
  FROM (SELECT *, least(13, len(w)) AS size FROM i) WHERE size > 0
), doc_windows AS (
  SELECT rid, size, unnest(range(1, len(w) - size + 2)) AS p,
         unnest(list_transform(range(1, len(w) - size + 2), lambda p: array_to_string(w[p : p + size - 1], ' '))) AS piece
  FROM d, (SELECT DISTINCT size FROM item_windows) WHERE len(w) >= size
), hits AS MATERIALIZED (
  SELECT rid, p, size, item_id FROM doc_windows JOIN item_windows USING (size, piece)
), covered AS (
  SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(p, p + size)) AS q FROM hits) GROUP BY rid
), listed AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM d LEFT JOIN covered USING (rid) LEFT JOIN listed USING (rid)
"""

SUBSTRING = r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS MATERIALIZED (
  SELECT rid, doc_id, unnest(range(1, len(w) - 11)) AS p,
         unnest(list_transform(range(1, len(w) - 11), lambda p: array_to_string(w[p : p + 12], ' '))) AS piece
  FROM d WHERE len(w) >= 13
), firsts AS (
  SELECT piece, min(doc_id) AS first FROM windows GROUP BY piece
), gone AS (
  SELECT DISTINCT rid, unnest(range(p, p + 13)) AS p FROM windows JOIN firsts USING (piece) WHERE first < doc_id OR doc_id IS NULL AND first IS NOT NULL
), words AS (
  SELECT rid, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM d
), kept AS (
  SELECT rid, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS text FROM words ANTI JOIN gone USING (rid, p) GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (rid)
"""

WARC = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), g AS (
  SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS payload_digest,
         max(page_id) OVER (PARTITION BY payload) AS top
  FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM top AND top IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM top THEN top END AS refers_to,
       true AS verified
FROM g
"""

MINHASH = rf"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS MATERIALIZED (
  SELECT rid, doc_id,
         CASE len(w) WHEN 0 THEN [] WHEN 1 THEN w
              ELSE list_distinct(list_transform(range(1, len(w)), lambda p: w[p] || ' ' || w[p + 1])) END AS shingles
  FROM d
), e AS MATERIALIZED (
  SELECT rid, len(shingles) AS n, unnest(shingles) AS shingle FROM s
), shared AS (
  SELECT a.rid AS x, b.rid AS y, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS c
  FROM e a JOIN e b ON a.shingle = b.shingle AND a.rid <> b.rid AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY a.rid, b.rid
), links AS MATERIALIZED (
  SELECT x, y FROM shared WHERE 100 * c >= 80 * (n + m - c)
), reach AS (
  SELECT rid AS x, rid AS y FROM s
  UNION
  SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y
), least_key AS (
  SELECT r.x AS rid, min(s.doc_id) AS component_id FROM reach r JOIN s ON s.rid = r.y GROUP BY r.x
)
SELECT doc_id, CAST(len(shingles) AS BIGINT) AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept
FROM s JOIN least_key USING (rid)
"""

PHRASES = rf"""
WITH pieces AS (
  SELECT lang, piece, row_number() OVER () AS id
  FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents
  )
), words AS (
  SELECT lang, id, unnest(w) AS w, unnest(range(len(w))) AS p FROM (SELECT lang, id, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces)
), grams AS (
  SELECT lang, w AS w1, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM words WINDOW o AS (PARTITION BY id ORDER BY p)
), f1 AS MATERIALIZED (
  SELECT lang, w1, count(*) AS f FROM grams GROUP BY ALL
), f2 AS MATERIALIZED (
  SELECT lang, w1, w2, count(*) AS f FROM grams WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10
), f3 AS MATERIALIZED (
  SELECT lang, w1, w2, w3, count(*) AS f FROM grams WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10
), held AS (
  SELECT lang, w1, w2, max(f) AS f FROM (SELECT lang, w1, w2, f FROM f3 UNION ALL SELECT lang, w2, w3, f FROM f3) GROUP BY ALL
), cuts AS (
  SELECT c.lang, c.w1 || ' ' || c.w2 AS phrase, 1 AS k, c.f AS a, l.f AS l, r.f AS r
  FROM f2 c JOIN f1 l ON l.lang = c.lang AND l.w1 = c.w1 JOIN f1 r ON r.lang = c.lang AND r.w1 = c.w2
  LEFT JOIN held h ON h.lang = c.lang AND h.w1 = c.w1 AND h.w2 = c.w2
  WHERE h.f IS NULL OR 100 * h.f < 50 * c.f
  UNION ALL
  SELECT c.lang, concat_ws(' ', c.w1, c.w2, c.w3), 1, c.f, l.f, r.f
  FROM f3 c JOIN f1 l ON l.lang = c.lang AND l.w1 = c.w1 JOIN f2 r ON r.lang = c.lang AND r.w1 = c.w2 AND r.w2 = c.w3
  UNION ALL
  SELECT c.lang, concat_ws(' ', c.w1, c.w2, c.w3), 2, c.f, l.f, r.f
  FROM f3 c JOIN f2 l ON l.lang = c.lang AND l.w1 = c.w1 AND l.w2 = c.w2 JOIN f1 r ON r.lang = c.lang AND r.w1 = c.w3
), scored AS (
  SELECT *, CAST(CAST(1000000 AS HUGEINT) * a * a // (CAST(l AS HUGEINT) * r) AS BIGINT) AS score FROM cuts
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best
), sizes AS (
  SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f1 GROUP BY lang
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN sizes USING (lang) WHERE rank <= 2000
"""

FILL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS t
  FROM documents
), c AS (
  SELECT doc_id, text, t, list_transform([1, 9, 17, 25], lambda k: CAST('0x' || substr(h, k, 8) AS UBIGINT)) AS r FROM d
), f AS (
  SELECT doc_id, text, t, CAST(least(r[1] % (len(t) + 1), r[2] % (len(t) + 1)) AS BIGINT) AS a,
         CAST(greatest(r[1] % (len(t) + 1), r[2] % (len(t) + 1)) AS BIGINT) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR r[3] % 100 >= 50 THEN 'plain'
              WHEN r[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM c
), p AS (
  SELECT doc_id, text, form, CAST(len(t) AS BIGINT) AS n, array_to_string(t[1:a], '') AS prefix,
         array_to_string(t[a + 1 : b], '') AS middle, array_to_string(t[b + 1 :], '') AS suffix
  FROM f
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""

ORACLE = {"op4_blob_ledger": SECRETS, "op6_warc": WARC, "op9_decontaminate": DECONTAMINATE, "op10_substring": SUBSTRING, "op11_minhash": MINHASH, "op12_collocations": PHRASES, "op13_fill_in_middle": FILL}
