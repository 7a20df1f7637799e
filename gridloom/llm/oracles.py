"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

#: Fixed value: the reflected CRC-32 polynomial.
CRC_POLY = 0xEDB88320


def crc32_sql(text: str) -> str:
    """SQL for the CRC-32 of a text's UTF-8 bytes, bit by bit."""
    table = (
        f"list_transform(range(256), lambda n: list_reduce(range(8), lambda c, i: "
        f"CASE WHEN c & 1 = 1 THEN xor(c >> 1, {CRC_POLY}) ELSE c >> 1 END, n))"
    )
    byte = f"('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT"
    bytes_ = f"list_transform(range(octet_length(encode({text}))), lambda i: {byte})"
    return (
        f"(SELECT xor(list_reduce({bytes_}, lambda c, b: xor(t[1 + (xor(c, b) & 255)], c >> 8), 4294967295), 4294967295) "
        f"FROM (SELECT {table} AS t))"
    )


SHARDING = f"""
WITH slim AS (
  SELECT doc_id, coalesce(source, '') AS src, source IS NULL AS none, source,
         coalesce(octet_length(encode(text)), 0) + 8 AS size,
         coalesce({crc32_sql("text")}, 0)::BIGINT AS crc
  FROM documents),
keyed AS (SELECT *, md5('gridloom:' || coalesce(doc_id::VARCHAR, '-') || ':' || crc) AS key FROM slim),
own AS (
  SELECT *, row_number() OVER (PARTITION BY src, none ORDER BY key, doc_id, size) - 1 AS rank,
         count(*) OVER (PARTITION BY src, none) AS n_of, count(*) OVER () AS n
  FROM keyed),
frac AS (SELECT *, ((2 * rank + 1) * 67108864) // n_of AS f FROM own),
placed AS (SELECT *, row_number() OVER (ORDER BY f, src, none, key, doc_id, size) - 1 AS pos FROM frac),
dealt AS (SELECT *, (pos * 24) // n AS s FROM placed)
SELECT doc_id, source, size::BIGINT AS size, crc AS text_crc32, 'rows' AS law, s::INTEGER AS shard,
       (pos - (n * s + 23) // 24)::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM dealt
"""


UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[^\\x20\\x09-\\x0D]+')"

JACCARD = f"""
WITH RECURSIVE worded AS (SELECT doc_id, {WORDS} AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM worded),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS m, any_value(b.n) AS n, count(*) AS c
  FROM items a JOIN items b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (SELECT x, y FROM pairs WHERE 100 * c >= 75 * (m + n - c)),
reach AS (
  SELECT doc_id AS x, doc_id AS r FROM documents
  UNION
  SELECT links.y, reach.r FROM reach JOIN links ON links.x = reach.x)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, c.component_id
FROM sets s JOIN (SELECT x, min(r) AS component_id FROM reach GROUP BY 1) c ON c.x = s.doc_id
"""


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" for c in word)


# The base patterns; runs of at least so many characters are the long ones among all runs.
KEYS = "|".join([*map(either_case, ("password", "passwd", "secret", "token")), f"{either_case('api')}_?{either_case('key')}"])
SECRETS = {
    "assign": f"({KEYS})[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)",
    "access": "AKIA[A-Z0-9]{12,}",
    "hex": "[0-9a-f]{32,}",
}


def spans_sql(number: int, pattern: str, kept: str) -> str:
    """(s, k, e) of a pattern's matches: starts from the lengths of what lies before them."""
    before = "list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:i - 1], lambda x: length(x))), 0)"
    rows = f"list_transform(range(1, len(h) + 1), lambda i: {{'s': {before}, 'k': {number}, 'n': length(h[i]), 'ok': {kept}}})"
    found = (
        f"SELECT regexp_extract_all(text, '{pattern}') AS h, string_split_regex(text, '{pattern}') AS g, "
        f"{f"regexp_extract_all(text, '{pattern}', 2)" if not number else 'NULL'} AS v"
    )
    return f"(SELECT list_filter({rows}, lambda x: x.ok) FROM ({found}))"


SECRET_BASE = f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
f AS (SELECT r, doc_id,
  {spans_sql(0, SECRETS["assign"], "length(v[i]) >= 8")} AS a,
  {spans_sql(1, SECRETS["access"], "true")} AS b,
  {spans_sql(2, SECRETS["hex"], "true")} AS c FROM t)
SELECT doc_id, len(a)::BIGINT AS n_assign, len(b)::BIGINT AS n_access, len(c)::BIGINT AS n_hex,
  sha256(array_to_string(list_transform(list_sort(list_concat(a, b, c)),
    lambda x: ['assign', 'access', 'hex'][x.k + 1] || ':' || x.s::BIGINT || ':' || (x.s + x.n)::BIGINT), ',')) AS base_sha256
FROM f
"""

WORD = "[^\\x20\\x09-\\x0D]"
QUALITY_BASE = f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '{WORD}+') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS l FROM t),
three AS (SELECT r, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
twice AS (SELECT r, i FROM three QUALIFY count(*) OVER (PARTITION BY r, a, b, c) > 1),
covered AS (SELECT r, count(DISTINCT i + d) AS n FROM twice CROSS JOIN (SELECT unnest([0, 1, 2]) AS d) GROUP BY r),
counts AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN covered USING (r))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts
"""


EXACT_DEDUP = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
d AS (SELECT doc_id, length(text) AS n, sha256(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS sha FROM t)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY sha) AS group_size,
  row_number() OVER w = 1 AS kept, sha AS text_sha256
FROM d WINDOW w AS (PARTITION BY sha ORDER BY n DESC, doc_id NULLS LAST)
"""


def _leaf_sql(text: str) -> str:
    parts = [f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)]
    return f"sha256({' || '.join(parts)})"


def _trie_sql(name: str, of: str) -> str:
    """Nodes (g, lvl, idx, n, h) over rows (g, rank, n, h): every three become one, until one is left."""
    return f"""{name} AS (
  SELECT g, 0 AS lvl, rank AS idx, n, h FROM {of}
  UNION ALL
  SELECT g, lvl + 1, idx // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM {name} WHERE n > 1 GROUP BY g, lvl, n, idx // 3)"""


def _steps_sql(of: str, trie: str, part: int) -> str:
    """For each row and level the siblings on its left and on its right."""
    own = "r.rank // CAST(3 ** u.lvl AS BIGINT)"
    sides = [f"coalesce(string_agg(CASE WHEN u.idx {op} {own} THEN u.h END, '' ORDER BY u.idx), '') AS {n}" for op, n in (("<", "l"), (">", "r"))]
    return (
        f"SELECT r.row, {part} AS part, u.lvl, {', '.join(sides)} FROM {of} r JOIN (SELECT DISTINCT g, lvl FROM {trie} WHERE n > 1) v ON v.g = r.g "
        f"JOIN {trie} u ON u.g = r.g AND u.lvl = v.lvl AND u.idx // 3 = r.rank // CAST(3 ** (v.lvl + 1) AS BIGINT) GROUP BY r.row, u.lvl"
    )


MERKLE = f"""
WITH RECURSIVE digests AS (
  SELECT row_number() OVER () AS row, doc_id, source, coalesce('1' || source, '0') AS g, {_leaf_sql("text")} AS h,
    CASE WHEN {crc32_sql("coalesce(doc_id::VARCHAR, '-')")} % 2 = 0 THEN {_leaf_sql("replace(text, chr(10), '')")} END AS bad
  FROM documents),
ranked AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS rank, count(*) OVER (PARTITION BY g) AS n FROM digests),
{_trie_sql("trie", "ranked")},
subroots AS MATERIALIZED (
  SELECT '' AS g, g AS of, h, row_number() OVER (ORDER BY g) - 1 AS rank, count(*) OVER () AS n FROM trie WHERE n = 1),
{_trie_sql("upper_trie", "subroots")},
placed AS (SELECT ranked.row, subroots.g, subroots.rank, subroots.n, subroots.h FROM ranked JOIN subroots ON subroots.of = ranked.g),
steps AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY row ORDER BY part, lvl) - 1 AS step
  FROM ({_steps_sql("ranked", "trie", 0)} UNION ALL {_steps_sql("placed", "upper_trie", 1)})),
walk AS (
  SELECT row, 0 AS step, coalesce(bad, h) AS h FROM ranked
  UNION ALL
  SELECT walk.row, walk.step + 1, sha256(l || h || r) FROM walk JOIN steps ON steps.row = walk.row AND steps.step = walk.step),
ends AS (SELECT row, arg_max(h, step) AS folded_root FROM walk GROUP BY row),
proofs AS (SELECT row, string_agg(l || r, '' ORDER BY step) AS proof FROM steps GROUP BY row)
SELECT ranked.doc_id, ranked.source, ranked.h AS leaf, placed.h AS subroot, top.h AS root, sha256(coalesce(proof, '')) AS proof_sha256,
  folded_root, folded_root = top.h AS verified
FROM ranked JOIN placed USING (row) JOIN ends USING (row) LEFT JOIN proofs USING (row) CROSS JOIN (SELECT h FROM upper_trie WHERE n = 1) top
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_jaccard_join": JACCARD, "op3_sharding": SHARDING, "op11_exact_dedup": EXACT_DEDUP, "op12_merkle_manifest": MERKLE,
        "secret_base_spans": SECRET_BASE, "quality_base_counts": QUALITY_BASE,
    }
