"""DuckDB counterparts of those queries that SQL can express over whole tables."""

from lexmill.llm.op11_pii import CONTEXT, KINDS, LEAST, NEAR, Kind
from lexmill.llm.op12_divergence import BEST, LEAST_DOCS, SMOOTH, UNIT

#: The base patterns as they are meant; the operator runs possessive forms of them.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
}
DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"
APART = "NOT regexp_matches(right(a, 1), '[{0}]') AND NOT regexp_matches(left(b, 1), '[{0}]')"
CONFIRMED = {
    "email": "true",
    "ip": "len(list_filter(string_split(v, '.'), lambda p: NOT regexp_full_match(p, '0*([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])'))) = 0",
    "card": f"""length({DIGITS}) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, length({DIGITS}) + 1), lambda j:
        (CASE j % 2 WHEN 1 THEN 1 ELSE 2 END * CAST(substr(reverse({DIGITS}), j, 1) AS INT)) // 10
        + (CASE j % 2 WHEN 1 THEN 1 ELSE 2 END * CAST(substr(reverse({DIGITS}), j, 1) AS INT)) % 10)) % 10 = 0""",
    "phone": f"length({DIGITS}) BETWEEN 9 AND 15",
    "iban": APART.format("A-Za-z0-9") + """ AND length(replace(v, ' ', '')) BETWEEN 15 AND 34
        AND list_reduce(list_prepend(0, list_transform(string_split(substr(replace(v, ' ', ''), 5) || left(replace(v, ' ', ''), 4), ''),
            lambda c: CASE WHEN c < 'A' THEN ascii(c) - 48 ELSE ascii(c) - 55 END)),
            lambda s, x: (s * CASE WHEN x < 10 THEN 10 ELSE 100 END + x) % 97) = 1""",
    "national_id": APART.format("0-9A-Za-z-") + " AND NOT regexp_matches(v, '^(?:000|666|9)|-00-|-0000$')",
    "local_phone": APART.format("0-9A-Za-z.+-"),
}


def _word(words: str) -> str:
    if not words:
        return "false"
    fold = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return " OR ".join(f"regexp_matches({fold.format(side)}, '(?:^|[^a-z])(?:{words})(?:[^a-z]|$)')" for side in "ab")


def _kind(kind: Kind, rank: int) -> str:
    pattern = PLAIN.get(kind.name, kind.pattern)
    return f"""
    SELECT r, {rank} AS rank, '{kind.name}' AS kind, {str(kind.base).lower()} AS base, start, start + length(v) AS stop,
        round(least(greatest({kind.score} + CASE WHEN {_word(kind.words)} THEN {CONTEXT} ELSE 0 END - CASE WHEN {_word(kind.against)} THEN {CONTEXT} ELSE 0 END, 0), 1), 2) AS score
    FROM (
        SELECT r, hits[i] AS v, right(gaps[i], {NEAR}) AS a, left(gaps[i + 1], {NEAR}) AS b,
            list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS start
        FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM (
            SELECT r, regexp_extract_all(text, '{pattern}') AS hits, regexp_split_to_array(text, '{pattern}') AS gaps FROM d)))
    WHERE {CONFIRMED[kind.name]}"""


PII = f"""
WITH d AS (SELECT row_number() OVER () AS r, CAST(doc_id AS BIGINT) AS doc_id, coalesce(text, '') AS text FROM documents),
s AS ({' UNION ALL '.join(_kind(k, i) for i, k in enumerate(KINDS))}),
t AS (SELECT * FROM s WHERE base OR score >= {LEAST})
SELECT doc_id, {', '.join(f"count(*) FILTER (kind = '{k.name}') AS n_{k.name}" for k in KINDS if k.base)},
    sha256(coalesce(string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, rank) FILTER (base), '')) AS base_sha256,
    coalesce(string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, rank), '') AS spans,
    coalesce(string_agg(printf('%.2f', score), ',' ORDER BY start, rank), '') AS scores
FROM d LEFT JOIN t USING (r) GROUP BY r, doc_id
"""

DIVERGENCE = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ts FROM documents),
w AS (SELECT r, lang, source, unnest(ts) AS term FROM d),
vocab AS (SELECT lang, term, count(*) AS n FROM w GROUP BY ALL HAVING count(DISTINCT r) >= {LEAST_DOCS}),
langs AS (SELECT lang, count(*) AS v, sum(n) AS total FROM vocab GROUP BY lang),
cells AS (SELECT w.lang, source, term, count(*) AS n FROM w SEMI JOIN vocab ON w.lang = vocab.lang AND w.term = vocab.term GROUP BY ALL),
totals AS (SELECT lang, source, sum(n) AS total FROM cells GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM d),
p AS (
    SELECT g.lang, g.source, v.term, coalesce(c.n, 0) AS n,
        1 + ({UNIT}::HUGEINT * (coalesce(c.n, 0) + {SMOOTH})) // (coalesce(t.total, 0)::HUGEINT + {SMOOTH} * l.v) AS p,
        1 + ({UNIT}::HUGEINT * (v.n + {SMOOTH})) // (l.total::HUGEINT + {SMOOTH} * l.v) AS q
    FROM groups g JOIN vocab v ON g.lang = v.lang JOIN langs l ON g.lang = l.lang
    LEFT JOIN totals t ON t.lang = g.lang AND t.source = g.source
    LEFT JOIN cells c ON c.lang = g.lang AND c.source = g.source AND c.term = v.term),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
parts AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
    UNION ALL SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM parts)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= {BEST}
"""

INTERACTION = """
WITH w AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
f AS (
    SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
        CASE WHEN len(ws) < 200 THEN 1 ELSE 0 END
        + CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 2 ELSE 0 END
        + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) THEN 4 ELSE 0 END
        + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
        + CASE WHEN doc_id IS NOT NULL AND min(doc_id) OVER (PARTITION BY text) < doc_id THEN 16 ELSE 0 END AS mask
    FROM w LEFT JOIN l USING (doc_id)),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, mask),
x AS (SELECT unnest(string_split('ABCDE', '')) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e
    WHERE a.x NOT IN (b.x, c.x, d.x, e.x) AND b.x NOT IN (c.x, d.x, e.x) AND c.x NOT IN (d.x, e.x) AND d.x <> e.x),
s AS (SELECT filter_order, CAST(k AS INT) AS step, 1 << (ascii(substr(filter_order, k, 1)) - 65) AS bit,
    list_sum(list_transform(range(1, 6), lambda j: CASE WHEN j < k THEN 1 << (ascii(substr(filter_order, j, 1)) - 65) ELSE 0 END)) AS earlier
    FROM o, range(1, 6) r(k)),
t AS (
    SELECT part, filter_order, step, any_value(bit) AS bit, sum(CASE WHEN mask & (bit | earlier::BIGINT) = 0 THEN n ELSE 0 END) AS kept,
        sum(CASE WHEN mask & bit <> 0 AND mask & earlier::BIGINT = 0 THEN n ELSE 0 END) AS removed,
        sum(CASE WHEN mask & bit <> 0 AND mask & earlier::BIGINT <> 0 THEN n ELSE 0 END) AS redundant,
        sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN mask & bit <> 0 AND mask & earlier::BIGINT = 0 THEN good ELSE 0 END) AS good_lost,
        sum(CASE WHEN mask & bit <> 0 AND mask & earlier::BIGINT = 0 THEN toxic ELSE 0 END) AS toxic_lost
    FROM c, s GROUP BY part, filter_order, step)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
    CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
    CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM t
"""
