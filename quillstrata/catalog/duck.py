"""The same results in DuckDB SQL, written from the definitions rather than from the Spark expressions."""

from __future__ import annotations

import math

from quillstrata.functions.hashing import MERSENNE_31, band_shape, permutations, word_weights
from quillstrata.operators.chat import DEFAULT_SYSTEM_PROMPT
from quillstrata.schema import RULES

SEED = 42
NUM_PERM, THRESHOLD = 64, 0.80

WS = r"\s\x0b\x1c-\x1f\x{85}\p{Z}"
DIGIT_EDGE = r"\b"


def norm(x: str) -> str:
    return rf"trim(regexp_replace(nfc_normalize({x}), '[{WS}]+', ' ', 'g'))"


def strip(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '^[{WS}]+', ''), '[{WS}]+$', '')"


def words_in(x: str) -> str:
    return rf"CAST(len(regexp_extract_all({x}, '[^{WS}]+')) AS BIGINT)"


def tokens_in(x: str) -> str:
    return rf"CAST(len(regexp_extract_all({x}, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_{WS}]+')) AS BIGINT)"


def pct(part: str, whole: str) -> str:
    return f"CASE WHEN {whole} = 0 THEN 0.0::DOUBLE ELSE round({part}::DOUBLE / {whole} * 100, 2) END"


def key(x: str) -> str:
    return f"md5('{SEED}:' || CAST({x} AS VARCHAR))"


# --- views

PAIRS = """pairs AS (
  SELECT conv_id || ':' || turn AS record_id,
         CASE WHEN length(r) % 13 = 0 THEN '' WHEN length(r) % 17 = 0 THEN NULL ELSE 'B' END AS flags,
         text AS instruction,
         CASE WHEN length(text) % 7 = 0 THEN 'X' WHEN length(text) % 11 = 0 THEN '   '
              WHEN length(text) % 2 = 0 THEN ' order ' ELSE 'Refund' END AS category,
         CASE WHEN length(r) % 5 = 0 THEN ' Track_Order' || chr(10) ELSE 'get_refund' END AS intent,
         CASE WHEN length(text) % 19 = 0 THEN chr(9) || chr(160) || '    ' WHEN length(text) % 23 = 0 THEN 'No.' ELSE r END AS response
  FROM (SELECT *, lead(text) OVER w AS r, lead(role) OVER w AS r_role FROM conversations
        WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  WHERE role = 'user' AND r_role = 'assistant')"""

SLOTTED_PAIRS = PAIRS + """, slotted AS (
  SELECT record_id, flags, category, intent,
         CASE WHEN length(response) % 2 = 0 THEN instruction || ' {{Order Number}} {{a}}' ELSE instruction END AS instruction,
         CASE WHEN length(response) % 3 = 0 THEN response || ' {{a}} {{{{Account Type}}' ELSE response END AS response
  FROM pairs)"""

UNTIDY = """untidy AS (
  SELECT doc_id, '  ' || chr(160) || chr(10)
         || replace(replace(text, chr(233), 'e' || chr(769)), '. ', '.' || chr(133) || chr(9) || ' ')
         || chr(31) || '  ' AS text FROM documents)"""

SIGNED = """signed AS (
  SELECT doc_id, chr(128512) || replace(text, ' th', ' ' || chr(128512) || 'th') || ' ' || chr(128512) || 'a ' || chr(128512) AS text FROM documents)"""

SLOTTED = """slotted AS (
  SELECT doc_id, lang, source, CASE lang
    WHEN 'en' THEN text || ' {{Order Number}}'
    WHEN 'fr' THEN '{{' || source || '}}' || text || ' {{Email Address}} {{{{Account Type}} {{open'
    WHEN 'es' THEN 'a@b.org{{x}}+1 (743) 555-3824{{' || source || '}}4532-0000-0000-0009 ' || text
    ELSE text END AS text FROM documents)"""

SCORED = """scored AS (
  SELECT doc_id, CAST(quality AS VARCHAR) AS y_true,
         CASE WHEN lang = 'de' THEN '2' WHEN n_chars > 400 THEN '1' ELSE '0' END AS y_pred
  FROM labels JOIN documents USING (doc_id))"""


# --- personal data

EMAIL = r"[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}"
PHONE = (
    r"(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)[ .-]?|\b[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}\b"
    r"|\+[0-9]{1,3}(?:[ .-][0-9]{2,4}){2,5}\b"
)
CARD = (
    r"\b(?:[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{1,7}|[0-9]{4}[ -]?[0-9]{6}[ -]?[0-9]{5})\b"
)
OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
IP = rf"\b(?:{OCTET}\.){{3}}{OCTET}\b"
IBAN = r"\b[A-Z]{2}[0-9]{2}(?:[ -]?[A-Z0-9]{4}){2,7}(?:[ -]?[A-Z0-9]{1,3})?\b"
WALLET = r"\b(?:bc1[a-z0-9]{25,59}|[13][1-9A-HJ-NP-Za-km-z]{25,34})\b"


def luhn(x: str) -> str:
    s = f"regexp_replace({x}, '[^0-9]', '', 'g')"
    digit = f"CAST(substr({s}, length({s}) - i + 1, 1) AS INTEGER)"
    doubled = f"({digit} * 2 // 10 + {digit} * 2 % 10)"
    return (
        f"(list_sum(list_transform(range(1, length({s}) + 1), lambda i: "
        f"CASE WHEN i % 2 = 0 THEN {doubled} ELSE {digit} END)) % 10 = 0)"
    )


def iban(x: str) -> str:
    """The remainder of the whole number, spelled out as text first and taken digit by digit."""
    plain = f"regexp_replace({x}, '[ -]', '', 'g')"
    turned = f"(substr({plain}, 5) || substr({plain}, 1, 4))"
    spelled = (
        f"array_to_string(list_transform(string_split({turned}, ''), lambda c: "
        "CASE WHEN c BETWEEN 'A' AND 'Z' THEN CAST(ascii(c) - 55 AS VARCHAR) ELSE c END), '')"
    )
    digits = f"list_transform(string_split({spelled}, ''), lambda z: CAST(z AS INTEGER))"
    return f"(list_reduce({digits}, lambda a, b: (a * 10 + b) % 97) = 1)"


def masked(x: str, pattern: str, mask: str, check=None) -> str:
    if check is None:
        return f"regexp_replace({x}, '{pattern}', '{mask}', 'g')"
    return (
        f"array_to_string(list_transform(range(1, len(string_split_regex({x}, '{pattern}')) + 1), lambda k: "
        f"string_split_regex({x}, '{pattern}')[k] || coalesce(CASE WHEN hit_ok[k] THEN '{mask}' "
        f"ELSE regexp_extract_all({x}, '{pattern}')[k] END, '')), '')"
    )


STAGES = [
    ("EMAIL_ADDRESS", EMAIL, "<EMAIL>", None),
    ("CRYPTO", WALLET, "<CRYPTO>", None),
    ("IBAN_CODE", IBAN, "<IBAN_CODE>", iban),
    ("CREDIT_CARD", CARD, "<CARD>", luhn),
    ("IP_ADDRESS", IP, "<IP_ADDRESS>", None),
    ("PHONE_NUMBER", PHONE, "<PHONE>", None),
]
DEFAULT = ["EMAIL_ADDRESS", "PHONE_NUMBER", "CREDIT_CARD"]
ALL = [s[0] for s in STAGES]


def redact_ctes(source: str, entities: list[str]) -> tuple[str, str]:
    """A chain of CTEs s0, s1, ... over ``source`` (doc_id, text), counting hits per entity on the way."""
    ctes, last, counts = [f"s0 AS MATERIALIZED (SELECT doc_id, text FROM {source})"], "s0", []
    for n, (name, pattern, mask, check) in enumerate(s for s in STAGES if s[0] in entities):
        hits = f"regexp_extract_all(text, '{pattern}')"
        ok = "[]::BOOLEAN[]" if check is None else f"list_transform({hits}, lambda h: {check('h')})"
        count = f"len({hits})" if check is None else "len(list_filter(hit_ok, lambda b: b))"
        kept = "".join(f", {c}" for c in counts)
        ctes.append(
            f"s{n + 1} AS MATERIALIZED (SELECT doc_id, {masked('text', pattern, mask, check)} AS text{kept}, "
            f"{count} AS n_{name} FROM (SELECT *, {ok} AS hit_ok FROM {last}))"
        )
        last, counts = f"s{n + 1}", counts + [f"n_{name}"]
    return ",\n".join(ctes), last


SLOT = r"\{\{[^}]+\}\}"
HIDDEN = "chr(57344)"


def restored(hidden: str, original: str) -> str:
    return (
        f"array_to_string(list_transform(range(1, len(string_split({hidden}, {HIDDEN})) + 1), lambda k: "
        f"string_split({hidden}, {HIDDEN})[k] || coalesce(regexp_extract_all({original}, '{SLOT}')[k], '')), '')"
    )


HIDE = SLOTTED + rf""", hidden AS (
  SELECT doc_id, regexp_replace(text, '{SLOT}', {HIDDEN}, 'g') AS text FROM slotted)"""


def plain_redaction(entities: list[str]) -> str:
    ctes, last = redact_ctes("documents", entities)
    return f"WITH {ctes} SELECT doc_id, text FROM {last}"


def slot_redaction(entities: list[str], extra: str = "") -> str:
    ctes, last = redact_ctes("hidden", entities)
    return (
        f"WITH {HIDE}, {ctes} SELECT doc_id{extra}, {restored('l.text', 's.text')} AS text "
        f"FROM {last} l JOIN slotted s USING (doc_id)"
    )


def detection() -> str:
    ctes, last = redact_ctes("hidden", ALL)
    lists = ", ".join(f"list_transform(range(0, n_{e}), lambda i: '{e}')" for e in ALL)
    return f"WITH {HIDE}, {ctes} SELECT doc_id, array_to_string(flatten([{lists}]), ',') AS entities FROM {last}"


def scan() -> str:
    ctes, last = redact_ctes("documents", DEFAULT)
    return (
        f"WITH {ctes} SELECT CAST(count(*) AS BIGINT) AS rows_checked, "
        f"CAST(count(*) FILTER (l.text <> d.text) AS BIGINT) AS rows_changed "
        f"FROM {last} l JOIN documents d USING (doc_id)"
    )


def hit_counts() -> str:
    ctes, last = redact_ctes("documents", ALL)
    parts = " UNION ALL ".join(
        f"SELECT '{e}' AS entity, CAST(sum(n_{e}) AS BIGINT) AS hits FROM {last}" for e in ALL
    )
    return f"WITH {ctes} SELECT * FROM ({parts}) WHERE hits > 0"


# --- validation


def field_error(rule) -> str:
    f = rule.field
    least = f"{rule.min_length} character{'' if rule.min_length == 1 else 's'}"
    cases = [
        f"WHEN {f} IS NULL THEN '{f}: Input should be a valid string'",
        f"WHEN length({f}) < {rule.min_length} THEN '{f}: String should have at least {least}'",
    ]
    if rule.max_length:
        cases.append(f"WHEN length({f}) > {rule.max_length} THEN '{f}: String should have at most {rule.max_length} characters'")
    if rule.blank_message:
        cases.append(f"WHEN {strip(f)} = '' THEN '{f}: Value error, {rule.blank_message}'")
    return f"CASE {' '.join(cases)} END"


CHECKED = PAIRS + f""", checked AS (
  SELECT *, list_filter([{', '.join(field_error(r) for r in RULES)}], lambda e: e IS NOT NULL) AS errors FROM pairs)"""

# --- profiling


def distribution(column: str, table: str = "documents") -> str:
    return (
        f'SELECT {column} AS label, CAST(count(*) AS BIGINT) AS "count", '
        f"round(count(*)::DOUBLE / (SELECT count(*) FROM {table}) * 100, 2) AS percentage FROM {table} GROUP BY 1"
    )


def quantile(q: float) -> str:
    """Linear interpolation between neighbouring ranks, taken from the nearer one, cut to an integer."""
    ranks, at = "list_sort(list(value))", f"((count(value) - 1) * {q}::DOUBLE)"
    low, high = f"{ranks}[CAST(floor({at}) AS BIGINT) + 1]", f"{ranks}[CAST(ceil({at}) AS BIGINT) + 1]"
    share = f"({at} - floor({at}))"
    return (
        f"CAST(trunc(CASE WHEN {share} >= 0.5 THEN {high} - ({high} - {low}) * (1 - {share}) "
        f"ELSE {low} + ({high} - {low}) * {share} END) AS BIGINT)"
    )


STAT_COLUMNS = f"""CAST(min(value) AS BIGINT) AS min, {quantile(0.25)} AS p25, {quantile(0.5)} AS median,
  round(sum(value)::DOUBLE / count(value), 2) AS mean, {quantile(0.95)} AS p95, {quantile(0.99)} AS p99,
  CAST(max(value) AS BIGINT) AS max"""


def lengths_of(table: str) -> str:
    return f"""SELECT 'instruction_chars' AS metric, CAST(length(instruction) AS BIGINT) AS value FROM {table}
  UNION ALL SELECT 'instruction_words', {words_in('instruction')} FROM {table}
  UNION ALL SELECT 'response_chars', CAST(length(response) AS BIGINT) FROM {table}
  UNION ALL SELECT 'response_words', {words_in('response')} FROM {table}"""


def tokens_of(table: str) -> str:
    i, r = tokens_in("instruction"), tokens_in("response")
    return f"""SELECT 'instruction_tokens' AS metric, {i} AS value FROM {table}
  UNION ALL SELECT 'response_tokens', {r} FROM {table}
  UNION ALL SELECT 'total_tokens', {i} + {r} FROM {table}"""


def placeholder_row(table: str) -> str:
    left = f"count(*) FILTER (regexp_matches(instruction, '{SLOT}'))"
    right = f"count(*) FILTER (regexp_matches(response, '{SLOT}'))"
    return f"""SELECT CAST({left} AS BIGINT) AS instruction_count, {pct(left, 'count(*)')} AS instruction_percentage,
  CAST({right} AS BIGINT) AS response_count, {pct(right, 'count(*)')} AS response_percentage FROM {table}"""


def slot_names(table: str) -> str:
    pattern = r"\{\{([^}]+)\}\}"
    return f"""SELECT name, CAST(count(*) AS BIGINT) AS occurrences FROM (
  SELECT unnest(regexp_extract_all(instruction, '{pattern}', 1)) AS name FROM {table}
  UNION ALL SELECT unnest(regexp_extract_all(response, '{pattern}', 1)) FROM {table}) GROUP BY name"""


def dedup_row(table: str, left: str, right: str) -> str:
    return f"""SELECT CAST(count(*) AS BIGINT) AS total_rows,
  CAST(count(DISTINCT {left}) AS BIGINT) AS unique_instructions,
  CAST(count(*) - count(DISTINCT {left}) AS BIGINT) AS exact_duplicate_instructions,
  {pct(f'(count(*) - count(DISTINCT {left}))', 'count(*)')} AS instruction_duplicate_rate,
  CAST(count(DISTINCT ({left}, {right})) AS BIGINT) AS unique_instruction_response_pairs,
  CAST(count(*) - count(DISTINCT ({left}, {right})) AS BIGINT) AS duplicate_pairs FROM {table}"""


def _long(section: str, source: str, label: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{section}' AS section, '{c}' AS metric, {label} AS label, CAST(\"{c}\" AS DOUBLE) AS value FROM {source}"
        for c in columns
    )


def full_profile() -> str:
    stats = ["min", "p25", "median", "mean", "p95", "p99", "max"]
    dedup = ["total_rows", "unique_instructions", "exact_duplicate_instructions", "instruction_duplicate_rate",
             "unique_instruction_response_pairs", "duplicate_pairs"]
    slots = ["instruction_count", "instruction_percentage", "response_count", "response_percentage"]
    return f"""WITH {SLOTTED_PAIRS}, c AS ({distribution('category', 'slotted')}), i AS ({distribution('intent', 'slotted')}),
  v AS ({lengths_of('slotted')} UNION ALL {tokens_of('slotted')}),
  l AS (SELECT metric AS name, {STAT_COLUMNS} FROM v GROUP BY metric),
  p AS ({placeholder_row('slotted')}), n AS ({slot_names('slotted')}), d AS ({dedup_row('slotted', 'instruction', 'response')})
  {_long('categories', 'c', 'label', ['count', 'percentage'])} UNION ALL
  {_long('intents', 'i', 'label', ['count', 'percentage'])} UNION ALL
  {_long('lengths', 'l', 'name', stats)} UNION ALL
  {_long('placeholders', 'p', 'NULL', slots)} UNION ALL
  SELECT 'placeholders', 'occurrences', name, CAST(occurrences AS DOUBLE) FROM n UNION ALL
  {_long('duplicates', 'd', 'NULL', dedup)}"""


# --- near-duplicates

BANDS, ROWS = band_shape(THRESHOLD, NUM_PERM)


def shingle_ctes(source: str = "documents", ident: str = "doc_id") -> str:
    return f"""clean AS (SELECT {ident}, lower({norm('text')}) AS t FROM {source}),
words AS (SELECT {ident}, t, string_split(t, ' ') AS w FROM clean),
shingles AS (SELECT DISTINCT {ident}, unnest(CASE WHEN len(w) < 3 THEN [t] ELSE
  list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS shingle FROM words)"""


def signature_ctes(source: str = "documents", ident: str = "doc_id") -> str:
    def hashed(x: str) -> str:
        return f"CAST('0x' || substr(md5({x}), 1, 8) AS BIGINT)"

    minima = ", ".join(
        f"min(({a} * h + {b}) % {MERSENNE_31}) AS m{i}" for i, (a, b) in enumerate(permutations(NUM_PERM))
    )
    mixed = " + ".join(
        f"{hashed(f'split_part(shingle, chr(32), {k + 1})')} * {w} % {MERSENNE_31}" for k, w in enumerate(word_weights())
    )
    return f"""{shingle_ctes(source, ident)},
hashes AS (SELECT {ident}, CASE WHEN len(string_split(shingle, ' ')) < 3 THEN {hashed('shingle')}
  ELSE ({mixed}) % {MERSENNE_31} END AS h FROM shingles),
signatures AS MATERIALIZED (SELECT {ident}, {minima} FROM hashes GROUP BY {ident})"""


def band_ctes(source: str = "documents", ident: str = "doc_id") -> str:
    union = " UNION ALL ".join(
        f"SELECT {ident}, {k}::BIGINT AS band, md5(concat_ws(',', '{k}', "
        + ", ".join(f"m{k * ROWS + j}" for j in range(ROWS))
        + ")) AS bucket FROM signatures"
        for k in range(BANDS)
    )
    return f"{signature_ctes(source, ident)},\nbands AS MATERIALIZED ({union})"


EDGES = f"""{band_ctes()},
anchors AS (SELECT bucket, min(doc_id) AS anchor_id FROM bands GROUP BY bucket HAVING count(*) > 1),
edges AS MATERIALIZED (SELECT DISTINCT doc_id, anchor_id FROM bands JOIN anchors USING (bucket) WHERE anchor_id < doc_id)"""

CLUSTERS = f"""{EDGES},
links AS (SELECT doc_id AS a, anchor_id AS b FROM edges UNION ALL SELECT anchor_id, doc_id FROM edges),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
clustered AS MATERIALIZED (SELECT a AS doc_id, min(b) AS cluster_id FROM reach GROUP BY a)"""

# The sequential rule itself: in key order, a text no earlier seed is next to becomes a seed.
STAR = f"""{band_ctes()},
near AS MATERIALIZED (SELECT a.doc_id, list(DISTINCT b.doc_id) AS others FROM bands a JOIN bands b USING (bucket)
  WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id),
line AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY doc_id) AS i FROM near),
walk AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS seeds UNION ALL
  SELECT l.i, CASE WHEN list_has_any(l.others, w.seeds) THEN w.seeds ELSE list_append(w.seeds, l.doc_id) END
  FROM walk w JOIN line l ON l.i = w.i + 1),
done AS (SELECT arg_max(seeds, i) AS seeds FROM walk)"""


def split_ctes(source: str, train: float, val: float) -> str:
    """The sequential greedy walk, one cluster per recursion step."""
    return f"""sizes AS (SELECT cluster_id, count(*) AS size FROM {source} GROUP BY cluster_id),
target AS (SELECT CAST(floor(count(*) * {train}::DOUBLE) AS BIGINT) AS t, CAST(floor(count(*) * {val}::DOUBLE) AS BIGINT) AS v FROM {source}),
line AS MATERIALIZED (SELECT cluster_id, size, row_number() OVER (ORDER BY {key('cluster_id')}, cluster_id) AS i FROM sizes),
walk AS (SELECT 0::BIGINT AS i, 0::BIGINT AS tr, 0::BIGINT AS va, '' AS split
  UNION ALL SELECT l.i,
    w.tr + CASE WHEN w.tr + l.size <= t THEN l.size ELSE 0 END,
    w.va + CASE WHEN w.tr + l.size > t AND w.va + l.size <= v THEN l.size ELSE 0 END,
    CASE WHEN w.tr + l.size <= t THEN 'train' WHEN w.va + l.size <= v THEN 'val' ELSE 'test' END
  FROM walk w JOIN line l ON l.i = w.i + 1, target),
placed AS MATERIALIZED (SELECT cluster_id, split FROM walk JOIN line USING (i)),
split_rows AS MATERIALIZED (SELECT s.*, split FROM {source} s JOIN placed USING (cluster_id))"""


SPLIT = f"{CLUSTERS},\n{split_ctes('clustered', 0.8, 0.1)}"

AUDIT = """SELECT CAST(coalesce(sum(tr), 0) AS BIGINT) AS train_rows, CAST(coalesce(sum(va), 0) AS BIGINT) AS val_rows,
  CAST(coalesce(sum(te), 0) AS BIGINT) AS test_rows, CAST(count(*) FILTER (tr > 0) AS BIGINT) AS train_clusters,
  CAST(count(*) FILTER (va > 0) AS BIGINT) AS val_clusters, CAST(count(*) FILTER (te > 0) AS BIGINT) AS test_clusters,
  CAST(count(*) FILTER (tr > 0 AND va > 0) AS BIGINT) AS train_val_overlap,
  CAST(count(*) FILTER (tr > 0 AND te > 0) AS BIGINT) AS train_test_overlap,
  CAST(count(*) FILTER (va > 0 AND te > 0) AS BIGINT) AS val_test_overlap,
  CAST(count(*) FILTER ((tr > 0)::INT + (va > 0)::INT + (te > 0)::INT > 1) AS BIGINT) AS leakage_overlap,
  count(*) FILTER ((tr > 0)::INT + (va > 0)::INT + (te > 0)::INT > 1) = 0 AS is_leakage_free
FROM (SELECT cluster_id, count(*) FILTER (split = 'train') AS tr, count(*) FILTER (split = 'val') AS va,
  count(*) FILTER (split = 'test') AS te FROM split_rows GROUP BY cluster_id)"""


def naive_ctes(source: str, ident: str = "doc_id") -> str:
    return f"""naive AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY {key(ident)}) <= floor((SELECT count(*) FROM {source}) * 0.8::DOUBLE)
  THEN 'train' ELSE 'test' END AS split FROM {source})"""


def leak(kind: str, table: str) -> str:
    return f"""SELECT '{kind}' AS kind, CAST(count(*) AS BIGINT) AS test_rows,
  CAST(count(*) FILTER (c.cluster_id IS NOT NULL) AS BIGINT) AS leaked_rows,
  {pct('count(*) FILTER (c.cluster_id IS NOT NULL)', 'count(*)')} AS leaked_percentage
  FROM {table} r LEFT JOIN (SELECT DISTINCT cluster_id FROM {table} WHERE split = 'train') c USING (cluster_id)
  WHERE r.split = 'test'"""


def judged(split: str) -> str:
    return f"""WITH {naive_ctes('documents')} SELECT target, CAST(count(*) AS BIGINT) AS samples, true AS within, true AS good
  FROM naive, (VALUES ('category'), ('intent')) t(target) WHERE split = '{split}' GROUP BY target"""


# --- n-grams

WORDS_OF = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')"
WORD_GRAMS = f"""tokens AS (SELECT doc_id, {WORDS_OF} AS w FROM documents),
grams AS (SELECT doc_id, unnest(w) AS term FROM tokens UNION ALL
  SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM tokens)"""
VOCABULARY = f"""{WORD_GRAMS},
vocabulary AS MATERIALIZED (SELECT term, CAST(count(*) AS BIGINT) AS total FROM grams GROUP BY term ORDER BY total DESC, term LIMIT 10000)"""


def char_grams() -> str:
    parts = " UNION ALL ".join(
        f"SELECT unnest(list_transform(range(1, length(t) - {n - 2}), lambda i: substr(t, i, {n}))) AS gram FROM clean"
        for n in (3, 4, 5)
    )
    return f"""WITH {SIGNED}, clean AS (SELECT regexp_replace(lower(text), '[{WS}]{{2,}}', ' ', 'g') AS t FROM signed)
SELECT gram, CAST(count(*) AS BIGINT) AS occurrences FROM ({parts}) GROUP BY gram"""


# --- metrics

PER_CLASS = f"""{SCORED},
names AS (SELECT y_true AS label FROM scored UNION SELECT y_pred FROM scored),
counts AS (SELECT label, (SELECT count(*) FROM scored WHERE y_true = label AND y_pred = label) AS hits,
  (SELECT count(*) FROM scored WHERE y_true = label) AS support,
  (SELECT count(*) FROM scored WHERE y_pred = label) AS called FROM names),
ratios AS (SELECT label, support, CASE WHEN called = 0 THEN 0.0::DOUBLE ELSE hits::DOUBLE / called END AS p,
  CASE WHEN support = 0 THEN 0.0::DOUBLE ELSE hits::DOUBLE / support END AS r FROM counts),
scores AS (SELECT *, CASE WHEN p + r = 0 THEN 0.0::DOUBLE ELSE 2 * p * r / (p + r) END AS f FROM ratios)"""

def bootstrap(replicates: int = 200, low: int = 5, high: int = 196) -> str:
    """``low`` and ``high`` are the places of the nearest ranks outside 95 % of the replicates, from 1."""
    steps = [int(sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) * 2**32) for k in range(12)]
    weight = " + ".join(f"(u >= {s})::INT" for s in steps)
    long = " UNION ALL ".join(f"SELECT replicate, '{m}' AS metric, {m} AS value FROM summaries" for m in ("accuracy", "macro_f1", "weighted_f1"))
    return f"""WITH {SCORED},
drawn AS (SELECT y_true, y_pred, 4 * block + part AS replicate,
  CAST('0x' || substr(md5('{SEED}:' || doc_id || ':' || block), CAST(1 + 8 * part AS BIGINT), 8) AS BIGINT) AS u
  FROM scored, range({replicates // 4}) b(block), range(4) p(part)),
cells AS (SELECT replicate, y_true, y_pred, sum({weight}) AS n FROM drawn GROUP BY ALL HAVING n > 0
  UNION ALL SELECT -1, y_true, y_pred, count(*) FROM scored GROUP BY ALL),
sided AS (SELECT replicate, y_true AS label, CASE WHEN y_true = y_pred THEN n ELSE 0 END AS hits, n AS support, 0 AS called FROM cells
  UNION ALL SELECT replicate, y_pred, 0, 0, n FROM cells),
labels_of AS (SELECT replicate, label, sum(hits) AS hits, sum(support) AS support, sum(called) AS called FROM sided GROUP BY ALL),
summaries AS (SELECT replicate, round(sum(hits)::DOUBLE / sum(support), 4) AS accuracy,
  round(avg(2 * hits::DOUBLE / (called + support)), 4) AS macro_f1,
  round(sum(2 * hits::DOUBLE / (called + support) * support) / sum(support), 4) AS weighted_f1 FROM labels_of GROUP BY replicate),
long AS ({long})
SELECT metric, max(value) FILTER (replicate = -1) AS estimate, list_sort(list(value) FILTER (replicate >= 0))[{low}] AS low,
  list_sort(list(value) FILTER (replicate >= 0))[{high}] AS high, CAST(count(*) FILTER (replicate >= 0) AS BIGINT) AS replicates
FROM long GROUP BY metric"""


BALANCED = f"""{CLUSTERS},
labelled AS (SELECT c.doc_id, lang, cluster_id FROM clustered c JOIN documents USING (doc_id)),
cells AS (SELECT cluster_id, coalesce(lang, '') AS label, count(*) AS n FROM labelled GROUP BY ALL),
profiles AS (SELECT cluster_id, sum(n) AS size, first(label ORDER BY n DESC, label) AS label FROM cells GROUP BY cluster_id),
totals AS (SELECT *, sum(size) OVER (PARTITION BY label) AS total FROM profiles),
middles AS (SELECT *, 2 * sum(size) OVER (PARTITION BY label ORDER BY size * 100 <= total, {key('cluster_id')}, cluster_id ROWS UNBOUNDED PRECEDING)
  - size AS middle FROM totals),
spread AS MATERIALIZED (SELECT cluster_id, CASE WHEN middle <= total * 1.6::DOUBLE THEN 'train' WHEN middle <= total * 1.8::DOUBLE THEN 'val'
  ELSE 'test' END AS split FROM middles),
balanced AS (SELECT doc_id, lang, cluster_id, split FROM labelled JOIN spread USING (cluster_id))"""

CHAT_FIELDS = f"""{norm('instruction')} AS user_text, category, intent, coalesce({norm('response')}, '') AS response"""

ORACLE = {
    "load_records": "SELECT doc_id, text, lang, source, n_chars FROM documents",
    "ingest_raw": "SELECT 'parquet' AS copy, * FROM conversations UNION ALL SELECT 'csv', * FROM conversations",
    "dataset_fingerprint": """SELECT CAST(count(*) AS BIGINT) AS row_count,
  CAST(sum(CAST(CAST('0x' || substr(md5(concat_ws('|',
    length(doc_id::VARCHAR) || ':' || doc_id, length(text) || ':' || text, length(lang) || ':' || lang,
    length(source) || ':' || source)), 1, 15) AS BIGINT) AS HUGEINT)) AS VARCHAR) AS fingerprint FROM documents""",
    "write_split_parquet": f"WITH {naive_ctes('documents')} SELECT doc_id, lang, split FROM naive",
    "write_sft_jsonl": f"WITH {PAIRS} SELECT CAST(count(*) AS BIGINT) AS read_rows, CAST(count(*) AS BIGINT) AS written_rows FROM pairs",
    "read_sft_jsonl": f"WITH {PAIRS} SELECT 'system,user,assistant' AS roles, {CHAT_FIELDS} FROM pairs",
    "write_quarantine": f"""WITH {CHECKED} SELECT record_id AS row_index, flags, instruction, category, intent, response,
  array_to_string(errors, '; ') AS quarantine_reason FROM checked WHERE len(errors) > 0""",
    "normalize_text": f"WITH {UNTIDY} SELECT doc_id, {norm('text')} AS clean FROM untidy",
    "normalize_records": f"WITH {UNTIDY} SELECT doc_id, {norm('text')} AS instruction_clean, "
    f"{norm('array_to_string(list_reverse(string_split(text, {}))'.format(chr(39) * 2) + ', {})'.format(chr(39) * 2))} AS response_clean FROM untidy",
    "null_counts": f"WITH {PAIRS} " + " UNION ALL ".join(
        f'SELECT \'{c}\' AS "column", CAST(count(*) FILTER ({c} IS NULL) AS BIGINT) AS null_count FROM pairs'
        for c in ["record_id", "flags", "instruction", "category", "intent", "response"]
    ),
    "head_n": "SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT 500",
    "filter_split": "SELECT doc_id, source FROM documents WHERE lang = 'fr'",
    "label_cardinality": """SELECT 'lang' AS "column", CAST(count(DISTINCT lang) AS BIGINT) AS distinct_count FROM documents
  UNION ALL SELECT 'source', CAST(count(DISTINCT source) AS BIGINT) FROM documents""",
    "validate_rules": f"WITH {CHECKED} SELECT record_id, CAST(len(errors) AS BIGINT) AS error_count FROM checked",
    "validate_reason": f"WITH {CHECKED} SELECT record_id, CASE WHEN len(errors) > 0 THEN array_to_string(errors, '; ') END AS reason FROM checked",
    "canonicalize_record": f"""WITH {CHECKED} SELECT record_id, flags, {strip('instruction')} AS instruction,
  upper({strip('category')}) AS category, lower({strip('intent')}) AS intent, {strip('response')} AS response
  FROM checked WHERE len(errors) = 0""",
    "quarantine_split": f"WITH {CHECKED} SELECT record_id, CASE WHEN len(errors) = 0 THEN 'valid' ELSE 'quarantine' END AS route FROM checked",
    "validation_summary": f"""WITH {CHECKED} SELECT CAST(count(*) AS BIGINT) AS total_processed,
  CAST(count(*) FILTER (len(errors) = 0) AS BIGINT) AS valid_count,
  CAST(count(*) FILTER (len(errors) > 0) AS BIGINT) AS quarantined_count,
  {pct('count(*) FILTER (len(errors) > 0)', 'count(*)')} AS quarantine_rate FROM checked""",
    "protect_slots": f"WITH {HIDE} SELECT doc_id, {restored('lower(h.text)', 's.text')} AS text FROM hidden h JOIN slotted s USING (doc_id)",
    "redact_email": plain_redaction(["EMAIL_ADDRESS"]),
    "redact_phone": plain_redaction(["PHONE_NUMBER"]),
    "redact_card": plain_redaction(["CREDIT_CARD"]),
    "redact_configured": plain_redaction(ALL),
    "detect_pii": detection(),
    "sanitize_text": slot_redaction(DEFAULT),
    "sanitize_records": slot_redaction(ALL, ", lang"),
    "pii_scan": scan(),
    "pii_hits": hit_counts(),
    "class_distribution_category": distribution("lang"),
    "class_distribution_intent": distribution("source"),
    "length_stats": f"""WITH t AS (SELECT text AS instruction, regexp_replace(text, '[.,] ', '  ' || chr(10), 'g') AS response FROM documents),
  v AS ({lengths_of('t')}) SELECT metric, {STAT_COLUMNS} FROM v GROUP BY metric""",
    "percentile_stats": f"""WITH v AS (SELECT 'quantity' AS metric, CAST(trunc(l_quantity) AS BIGINT) AS value FROM lineitem
  UNION ALL SELECT 'price', CAST(floor(l_extendedprice) AS BIGINT) FROM lineitem
  UNION ALL SELECT 'event_' || event_type, CAST(floor(value) AS BIGINT) FROM events)
  SELECT metric, {STAT_COLUMNS} FROM v WHERE value IS NOT NULL GROUP BY metric""",
    "dedup_stats": dedup_row("documents", "text", "source"),
    "exact_duplicates": """SELECT md5(text) AS text_md5, CAST(count(*) AS BIGINT) AS copies, min(doc_id) AS first_id
  FROM documents GROUP BY text HAVING count(*) > 1""",
    "placeholder_stats": f"""WITH {SLOTTED_PAIRS}, p AS ({placeholder_row('slotted')}), n AS ({slot_names('slotted')})
  SELECT p.*, (SELECT string_agg(name, '|' ORDER BY name) FROM n) AS unique_placeholders FROM p""",
    "placeholder_frequency": f"WITH {SLOTTED}, both_sides AS (SELECT text AS instruction, text AS response FROM slotted) {slot_names('both_sides')}",
    "token_length_stats": f"WITH {PAIRS}, v AS ({tokens_of('pairs')}) SELECT metric, {STAT_COLUMNS} FROM v GROUP BY metric",
    "truncation_rate": f"""WITH t AS (SELECT {tokens_in('text')} + {tokens_in('lang')} > 512 AS over_limit FROM documents)
  SELECT CAST(count(*) AS BIGINT) AS total_rows, CAST(count(*) FILTER (over_limit) AS BIGINT) AS truncated_rows,
  {pct('count(*) FILTER (over_limit)', 'count(*)')} AS truncated_percentage FROM t""",
    "full_profile": full_profile(),
    "word_shingles": f"WITH {SIGNED}, {shingle_ctes('signed')} SELECT doc_id, shingle FROM shingles",
    "minhash_signature": f"WITH {signature_ctes()} SELECT doc_id, concat_ws(',', {', '.join(f'm{i}' for i in range(NUM_PERM))}) AS signature FROM signatures",
    "lsh_bands": f"WITH {band_ctes()} SELECT doc_id, band, bucket FROM bands",
    "near_dup_candidates": f"WITH {EDGES} SELECT doc_id, anchor_id FROM edges",
    "near_dup_lookup": f"""WITH everything AS (
    SELECT 'q' AS side, 'b' || item_id AS q, NULL::BIGINT AS doc_id, text FROM benchmark UNION ALL
    SELECT 'q', 'c' || conv_id || ':' || turn, NULL, text FROM conversations WHERE role = 'user' UNION ALL
    SELECT 'q', 'd' || doc_id, NULL, text FROM documents UNION ALL
    SELECT 'd', NULL, doc_id, text FROM documents),
  numbered AS MATERIALIZED (SELECT row_number() OVER (ORDER BY side, q, doc_id) AS n, * FROM everything),
  {band_ctes('numbered', 'n')},
  named AS (SELECT n, concat_ws(',', {', '.join(f'm{i}' for i in range(NUM_PERM))}) AS signature FROM signatures),
  grouped AS MATERIALIZED (SELECT side, signature, min(q) AS q, min(doc_id) AS doc_id, count(*) AS size, min(n) AS n
    FROM named JOIN numbered USING (n) GROUP BY side, signature),
  sided AS (SELECT g.*, bucket FROM grouped g JOIN bands USING (n))
  SELECT DISTINCT q.q AS query_first, CAST(q.size AS BIGINT) AS query_size, d.doc_id AS corpus_first, CAST(d.size AS BIGINT) AS corpus_size
  FROM sided q JOIN sided d USING (bucket) WHERE q.side = 'q' AND d.side = 'd'""",
    "jaccard_verify": f"""WITH {EDGES},
  sets AS (SELECT doc_id, list(shingle) AS s FROM shingles GROUP BY doc_id),
  scored AS (SELECT e.doc_id, anchor_id, CAST(len(list_intersect(a.s, b.s)) AS BIGINT) AS shared, len(a.s) AS na, len(b.s) AS nb
    FROM edges e JOIN sets a ON a.doc_id = e.doc_id JOIN sets b ON b.doc_id = e.anchor_id)
  SELECT doc_id, anchor_id, shared, CAST(na + nb - shared AS BIGINT) AS total, round(shared::DOUBLE / (na + nb - shared), 6) AS jaccard
  FROM scored WHERE shared >= (na + nb - shared) * {THRESHOLD}::DOUBLE""",
    "hash_split": f"""SELECT doc_id, source, CASE WHEN p < 0.8::DOUBLE THEN 'train' WHEN p < 0.8::DOUBLE + 0.1::DOUBLE THEN 'val' ELSE 'test' END AS split
  FROM (SELECT doc_id, source, CAST('0x' || substr({key('doc_id')}, 1, 13) AS BIGINT)::DOUBLE / 4503599627370496.0::DOUBLE AS p FROM documents)""",
    "cluster_ids": f"WITH RECURSIVE {CLUSTERS} SELECT doc_id, cluster_id FROM clustered",
    "cluster_ids_star": f"""WITH RECURSIVE {STAR} SELECT d.doc_id,
  CASE WHEN n.doc_id IS NULL OR list_contains(seeds, d.doc_id) THEN d.doc_id
    ELSE list_min(list_intersect(n.others, seeds)) END AS cluster_id
  FROM documents d LEFT JOIN near n USING (doc_id), done""",
    "cluster_sizes": f"""WITH RECURSIVE {CLUSTERS} SELECT size, CAST(count(*) AS BIGINT) AS clusters
  FROM (SELECT CAST(count(*) AS BIGINT) AS size FROM clustered GROUP BY cluster_id) GROUP BY size""",
    "seeded_cluster_order": f"""WITH RECURSIVE {CLUSTERS}, sizes AS (SELECT cluster_id, CAST(count(*) AS BIGINT) AS size FROM clustered GROUP BY 1)
  SELECT cluster_id, size, {key('cluster_id')} AS key,
  CAST(row_number() OVER (ORDER BY {key('cluster_id')}, cluster_id) - 1 AS BIGINT) AS position FROM sizes""",
    "grouped_split": f"WITH RECURSIVE {SPLIT} SELECT doc_id, cluster_id, split FROM split_rows",
    "assign_split": f"""WITH RECURSIVE src AS (SELECT doc_id, source AS cluster_id FROM documents), {split_ctes('src', 0.5, 0.25)}
  SELECT doc_id, cluster_id, split FROM split_rows""",
    "split_audit": f"WITH RECURSIVE {SPLIT} {AUDIT}",
    "split_shares": f"""WITH RECURSIVE {SPLIT} SELECT split, CAST(count(*) AS BIGINT) AS rows,
  {pct('count(*)', '(SELECT count(*) FROM split_rows)')} AS percentage,
  CAST(count(DISTINCT cluster_id) AS BIGINT) AS clusters FROM split_rows GROUP BY split""",
    "fixed_sample": f"SELECT doc_id, text FROM documents ORDER BY {key('doc_id')}, doc_id LIMIT 500",
    "naive_random_split": f"WITH {naive_ctes('documents')} SELECT doc_id, source, split FROM naive",
    "leakage_experiment": f"""WITH RECURSIVE {SPLIT}, {naive_ctes('clustered')}
  {leak('grouped', 'split_rows')} UNION ALL {leak('naive', 'naive')}""",
    "assistant_payload": f"WITH {PAIRS} SELECT record_id, category, intent, coalesce({norm('response')}, '') AS response FROM pairs",
    "format_sft": f"""WITH {PAIRS} SELECT record_id, 3::BIGINT AS turns, {len(DEFAULT_SYSTEM_PROMPT)}::BIGINT AS system_chars,
  {norm('instruction')} AS user_text FROM pairs""",
    "sft_roundtrip": f"""WITH {PAIRS} SELECT CAST(count(*) AS BIGINT) AS records, 0::BIGINT AS bad_shape, 0::BIGINT AS bad_payload FROM pairs""",
    "sft_step_budget": """SELECT CAST(count(*) AS BIGINT) AS train_rows, 16::BIGINT AS effective_batch,
  CAST(count(*) // 16 * 3 AS BIGINT) AS total_steps FROM documents""",
    "word_ngrams": f"WITH {WORD_GRAMS} SELECT term AS gram, CAST(count(*) AS BIGINT) AS occurrences FROM grams GROUP BY term",
    "char_ngrams": char_grams(),
    "vocabulary_topk": f"WITH {VOCABULARY} SELECT term, total FROM vocabulary",
    "tfidf_weights": f"""WITH {VOCABULARY},
  tf AS MATERIALIZED (SELECT doc_id, term, CAST(count(*) AS BIGINT) AS tf FROM grams JOIN vocabulary USING (term) GROUP BY ALL),
  idf AS (SELECT term, ln((1 + (SELECT count(*) FROM documents))::DOUBLE / (1 + count(*))) + 1 AS idf FROM tf GROUP BY term),
  raw AS MATERIALIZED (SELECT doc_id, term, tf, tf * idf AS raw FROM tf JOIN idf USING (term)),
  norms AS (SELECT doc_id, sqrt(sum(raw * raw)) AS norm FROM raw GROUP BY doc_id)
  SELECT doc_id, term, tf, round(raw / norm, 4) AS weight FROM raw JOIN norms USING (doc_id)""",
    "confusion_matrix": f"""WITH {PER_CLASS} SELECT a.label AS y_true, b.label AS y_pred,
  CAST((SELECT count(*) FROM scored WHERE y_true = a.label AND y_pred = b.label) AS BIGINT) AS "count" FROM names a, names b""",
    "accuracy": f"WITH {SCORED} SELECT round(avg((y_true = y_pred)::INT), 4) AS accuracy FROM scored",
    "per_class_metrics": f"""WITH {PER_CLASS} SELECT label, round(p, 4) AS precision, round(r, 4) AS recall, round(f, 4) AS f1_score,
  CAST(support AS BIGINT) AS support FROM scores""",
    "macro_f1": f"WITH {PER_CLASS} SELECT round(avg(f), 4) AS macro_f1 FROM scores",
    "weighted_f1": f"WITH {PER_CLASS} SELECT round(sum(f * support) / sum(support), 4) AS weighted_f1 FROM scores",
    "label_set": f"WITH {PER_CLASS} SELECT label FROM names",
    "prepare_corpus": f"""WITH RECURSIVE {SPLIT} SELECT *, train_rows + val_rows + test_rows AS split_rows,
  train_rows + val_rows + test_rows AS chat_rows, least(500, test_rows) AS eval_rows, least(500, test_rows) AS eval_chat_rows FROM ({AUDIT})""",
    "file_sha256": "SELECT count(*) > 0 AS any_file, true AS all_agree FROM documents",
    "dataset_manifest": """SELECT 'documents' AS dataset_name, 'file' AS source_url, '1' AS revision_sha, 'unknown' AS license,
  CAST(count(*) AS BIGINT) AS row_count, 5::BIGINT AS column_count, 'doc_id,text,lang,source,n_chars' AS columns, true AS files_agree FROM documents""",
    "write_profile": full_profile(),
    "fit_classifier": judged("train"),
    "evaluate_classifier": judged("test"),
    "train_and_evaluate": judged("test"),
    "predict_labels": f"WITH {naive_ctes('documents')} SELECT doc_id AS record_id, true AS known FROM naive WHERE split = 'test'",
    "save_load_model": f"""WITH {naive_ctes('documents')} SELECT CAST(count(*) AS BIGINT) AS test_rows, 0::BIGINT AS changed
  FROM naive WHERE split = 'test'""",
    "similar_texts": f"""WITH RECURSIVE {shingle_ctes()},
  counted AS MATERIALIZED (SELECT doc_id, shingle, count(*) OVER (PARTITION BY doc_id) AS n FROM shingles),
  pairs AS (SELECT a.doc_id AS x, b.doc_id AS y FROM counted a JOIN counted b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
    GROUP BY a.doc_id, b.doc_id HAVING count(*) >= 0.8 * (any_value(a.n) + any_value(b.n) - count(*))),
  reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, p.y FROM reach r JOIN pairs p ON p.x = r.y)
  SELECT x AS doc_id, min(y) AS class_id FROM reach GROUP BY x""",
    "verified_classes": f"""WITH RECURSIVE {band_ctes()},
  counted AS MATERIALIZED (SELECT doc_id, shingle, count(*) OVER (PARTITION BY doc_id) AS n FROM shingles),
  met AS (SELECT DISTINCT a.doc_id AS x, b.doc_id AS y FROM bands a JOIN bands b USING (band, bucket) WHERE a.doc_id <> b.doc_id),
  pairs AS (SELECT x, y FROM met JOIN counted a ON a.doc_id = x JOIN counted b ON b.doc_id = y AND a.shingle = b.shingle
    GROUP BY x, y HAVING count(*) >= 0.8 * (any_value(a.n) + any_value(b.n) - count(*))),
  reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, p.y FROM reach r JOIN pairs p ON p.x = r.y)
  SELECT x AS doc_id, min(y) AS class_id FROM reach GROUP BY x""",
    "near_dup_members": f"""WITH sides AS (SELECT 'query' AS side, 'b' || item_id AS key, text FROM benchmark
    UNION ALL SELECT 'query', 'c' || conv_id || ':' || turn, text FROM conversations WHERE role = 'user'
    UNION ALL SELECT 'query', 'd' || doc_id, text FROM documents UNION ALL SELECT 'corpus', CAST(doc_id AS VARCHAR), text FROM documents),
  named AS MATERIALIZED (SELECT side || key AS ident, side, key, text FROM sides), {signature_ctes('named', 'ident')}
  SELECT side, key, CASE side WHEN 'query' THEN min(key) OVER w ELSE CAST(min(try_cast(key AS BIGINT)) OVER w AS VARCHAR) END AS first
  FROM signatures JOIN named USING (ident) WINDOW w AS (PARTITION BY side, {", ".join(f"m{i}" for i in range(NUM_PERM))})""",
    "nearest_train": f"""WITH {naive_ctes('documents')}, {shingle_ctes()},
  counted AS MATERIALIZED (SELECT doc_id, split, shingle, count(*) OVER (PARTITION BY doc_id) AS n FROM shingles JOIN naive USING (doc_id)),
  pairs AS (SELECT a.doc_id, b.doc_id AS nearest, CAST(count(*) AS BIGINT) AS shared, CAST(any_value(a.n) + any_value(b.n) - count(*) AS BIGINT) AS total
    FROM counted a JOIN counted b ON a.shingle = b.shingle AND a.split = 'test' AND b.split = 'train' GROUP BY a.doc_id, b.doc_id),
  best AS (SELECT * FROM pairs WHERE shared::DOUBLE / total >= 0.2::DOUBLE
    QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY shared::DOUBLE / total DESC, nearest) = 1)
  SELECT doc_id, nearest, shared, total, round(shared::DOUBLE / total, 6) AS jaccard
  FROM naive LEFT JOIN best USING (doc_id) WHERE split = 'test'""",
    "balanced_split": f"WITH RECURSIVE {BALANCED} SELECT doc_id, lang, cluster_id, split FROM balanced",
    "label_balance": f"""WITH RECURSIVE {BALANCED},
  targets(split, target) AS (VALUES ('train', 0.8::DOUBLE), ('val', 0.1::DOUBLE), ('test', 0.1::DOUBLE)),
  shares AS (SELECT t.split, target, coalesce(lang, '') AS label, CAST(count(*) FILTER (b.split = t.split) AS BIGINT) AS rows,
    count(*) FILTER (b.split = t.split)::DOUBLE / count(*) AS exact FROM balanced b, targets t GROUP BY t.split, target, label)
  SELECT label, split, rows, round(exact, 6) AS share, target, round(abs(exact - target), 6) AS deviation FROM shares""",
    "bootstrap_intervals": bootstrap(),
    "read_sft_lines": f"""WITH {PAIRS} SELECT CASE length(instruction) % 9 WHEN 1 THEN 'blank line' WHEN 2 THEN 'not JSON' WHEN 3 THEN 'not an object'
  WHEN 4 THEN 'no messages' WHEN 5 THEN 'messages of another type' WHEN 6 THEN 'wrong roles' WHEN 7 THEN 'no content' ELSE 'good' END AS outcome,
  CAST(count(*) AS BIGINT) AS lines FROM pairs GROUP BY outcome""",
    "payload_validity": f"""WITH {PAIRS}, faults AS (SELECT CASE length(instruction) % 13 WHEN 0 THEN 'empty' WHEN 1 THEN 'empty'
    WHEN 2 THEN 'not JSON' WHEN 3 THEN 'not an object' WHEN 4 THEN 'no intent' WHEN 5 THEN 'category not text' WHEN 6 THEN 'intent blank'
    WHEN 7 THEN 'no intent' WHEN 8 THEN 'response not text'
    ELSE CASE WHEN category = '   ' THEN 'category blank' WHEN category = 'X' THEN 'category unknown'
      WHEN {norm('response')} = '' THEN 'response blank' ELSE 'valid' END END AS fault FROM pairs)
  SELECT fault, CAST(count(*) AS BIGINT) AS rows, {pct('count(*)', '(SELECT count(*) FROM faults)')} AS percentage FROM faults GROUP BY fault""",
    "growing_clusters": f"WITH RECURSIVE {CLUSTERS} SELECT doc_id, cluster_id FROM clustered",
    "changed_rows": """SELECT CAST(doc_id AS VARCHAR) AS key, CASE WHEN n_chars % 40 = 0 THEN 'removed' ELSE 'changed' END AS change,
    1::BIGINT AS old_rows, CASE WHEN n_chars % 40 = 0 THEN 0 WHEN n_chars % 70 = 3 THEN 2 ELSE 1 END::BIGINT AS new_rows
    FROM documents WHERE n_chars % 40 = 0 OR n_chars % 50 = 1 OR n_chars % 70 = 3
  UNION ALL SELECT CAST(-1 - doc_id AS VARCHAR), 'added', 0, 1 FROM documents WHERE n_chars % 60 = 2""",
    "leakage_models": f"""WITH RECURSIVE {SPLIT}, {naive_ctes('clustered')},
  sizes_of AS (SELECT 'grouped' AS kind, count(*) AS n FROM split_rows WHERE split = 'test' UNION ALL
    SELECT 'naive', count(*) FROM naive WHERE split = 'test')
  SELECT kind, target, CAST(n AS BIGINT) AS samples, true AS within FROM sizes_of, (VALUES ('category'), ('intent')) t(target)""",
}
