"""DuckDB text expressions and common table expressions shared by the SQL counterparts."""

from lexmill import constants as K

LATIN = "abcdefghijklmnopqrstuvwxyz" + "éèàâêçüöäßóíñá" + "0123456789"
ARABIC = (
    "ابتثجحخدذرزسشصضطظعغفقكلمنه"
    + "ىـأإةَآٱِّئؤءي"
    + K.ARABIC_DIGITS
)


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def digits(x: str) -> str:
    return f"translate(coalesce({x}, ''), '{K.ARABIC_DIGITS}', '{K.WESTERN_DIGITS}')"


def fold(x: str, teh: bool = False) -> str:
    src = K.ALEF_FORMS + "ى" + ("ة" if teh else "") + K.ARABIC_DIGITS + K.TATWEEL + K.DIACRITICS
    dst = "ا" * 4 + "ي" + ("ه" if teh else "") + K.WESTERN_DIGITS
    return f"translate(coalesce({x}, ''), '{src}', '{dst}')"


def norm(x: str, teh: bool = False) -> str:
    return f"trim(regexp_replace({fold(x, teh)}, '[{K.WS}]+', ' ', 'g'))"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^[{K.WS}]+|[{K.WS}]+\z', '', 'g')"


def arabize(x: str) -> str:
    return f"translate(lower({x}), '{LATIN}', '{ARABIC}')"


TOKEN = r"[\x{0600}-\x{06FF}\p{L}\p{N}_]+"
STOP = ", ".join(lit(s) for s in K.STOPWORDS)


def words(x: str) -> str:
    """Kept words of a text: folded, two or more characters, not stopwords."""
    return (
        f"list_filter(regexp_extract_all({fold(x, True)}, '{TOKEN}'), "
        f"lambda w: length(w) > 1 AND w NOT IN ({STOP}))"
    )


def stem_steps(source: str, keys: str) -> str:
    """Nested selects that strip the four prefixes from column ``w`` of ``source``, as ``term``."""
    step = source
    for cond, size in (
        ("w LIKE 'ال%'", 2), ("(w LIKE 'و%' OR w LIKE 'ف%')", 1),
        ("(w LIKE 'ب%' OR w LIKE 'ل%' OR w LIKE 'ك%')", 1), ("w LIKE 'ال%'", 2),
    ):
        step = (
            f"(SELECT {keys}, CASE WHEN length(w) > 4 AND {cond} THEN substr(w, {size + 1}) ELSE w END AS w "
            f"FROM {step})"
        )
    return f"SELECT {keys}, w AS term FROM {step}"


def numbers(text: str, pattern: str, group: int, kind: str = "INTEGER") -> str:
    return (
        f"list_transform(regexp_extract_all({text}, {lit(pattern)}, {group}), "
        f"lambda n: TRY_CAST(n AS {kind}))"
    )


def references(ar: str, en: str, current: str = "NULL::INTEGER") -> str:
    parts = " || ".join(
        [
            numbers(digits(ar), K.REFERENCE_AR_PATTERN, 1),
            numbers(digits(ar), K.REFERENCE_AR_PATTERN, 2),
            numbers(digits(en), rf"(?i)Articles?[{K.WS}]+([0-9]+)", 1),
            numbers(digits(en), rf"(?i)Articles?[{K.WS}]+[0-9]+[{K.WS}]+and[{K.WS}]+([0-9]+)", 1),
        ]
    )
    return (
        f"list_sort(list_distinct(list_filter({parts}, lambda n: n BETWEEN 1 AND {K.MAX_ARTICLE} "
        f"AND n IS DISTINCT FROM {current})))"
    )


def cited(x: str) -> str:
    t = digits(x)
    bracketed = numbers(t, K.CITED_BRACKET_PATTERN, 1, "BIGINT")
    plain = numbers(t, rf"(?i)(?:^|[^{K.WORD}])(?:المادة|Article)[{K.WS}]*([0-9]+)", 1, "BIGINT")
    return f"list_sort(list_distinct(CASE WHEN len({bracketed}) > 0 THEN {bracketed} ELSE {plain} END))"


def is_arabic(x: str) -> str:
    ar = r"[\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{08A0}-\x{08FF}]"
    return f"(len(regexp_extract_all({x}, '{ar}')) >= len(regexp_extract_all({x}, '[a-zA-Z]')))"


def in_ranges(x: str) -> str:
    return "(" + " OR ".join(f"{x} BETWEEN {lo} AND {hi}" for lo, hi in K.REPEALED_RANGES) + ")"


def hash_embedding(x: str, dim: int) -> str:
    """Unnormalized list; ``unit`` divides by the norm."""
    return (
        f"list_transform(range(0, {dim}), lambda i: "
        f"CAST(('0x' || substr(sha256({x}), ((i % 32) * 2 + 1)::INT, 2)) AS INTEGER) / 255.0::DOUBLE - 0.5)"
    )


def csv(x: str) -> str:
    """A list as text, empty list as empty text."""
    return f"coalesce(array_to_string({x}, ','), '')"


EN_TAIL = (
    "' See Article ' || ((doc_id * 7) % 1200 + 1) || ' and Articles ' || ((doc_id * 13) % 1149 + 1) "
    "|| ' and ' || ((doc_id * 17) % 1149 + 1) || '.'"
)

ARTICLES = f"""
raw_articles AS (
  SELECT CAST(doc_id + 1 AS INTEGER) AS article_number, source AS book, lang AS part,
         'CH-' || (doc_id % 7) AS chapter, 'SEC-' || (doc_id % 3) AS section,
         CASE WHEN doc_id % 5 <> 0 THEN 'topic ' || (doc_id % 11) END AS topic,
         {arabize('text')} AS text_ar_raw, text || {EN_TAIL} AS text_en,
         CAST(doc_id // 10 + 1 AS INTEGER) AS source_page
  FROM documents),
articles AS (
  SELECT *, {norm('text_ar_raw')} AS text_ar,
         {in_ranges('article_number')} AS is_repealed,
         '{K.CITATION_PREFIX}' || article_number AS citation
  FROM raw_articles)"""

FAULTY = f"""{ARTICLES},
faulty AS (
  SELECT a.* REPLACE (
    CASE WHEN article_number % 89 = 0 THEN '  ' ELSE text_ar END AS text_ar,
    CASE WHEN article_number % 83 = 0 THEN NOT is_repealed ELSE is_repealed END AS is_repealed,
    CASE WHEN article_number % 79 = 0 THEN 'Art. ' || article_number ELSE citation END AS citation,
    CASE WHEN article_number % 73 = 0 THEN 0 ELSE source_page END AS source_page)
  FROM articles a, (SELECT unnest(range(0, 2)) AS copy) c
  WHERE article_number % 101 <> 0 AND (copy = 0 OR article_number % 97 = 0))"""


def bm25(limit: int, where: str = "") -> str:
    """CTEs from ``chunks(chunk_id, article_number, paragraph_number, ctext, ...)`` and
    ``queries(query_id, question, ...)`` to ``bm25``."""
    return f"""
tok AS (SELECT chunk_id, unnest({words('ctext')}) AS w FROM chunks),
tf AS MATERIALIZED (SELECT chunk_id, term, count(*) AS tf FROM ({stem_steps('tok', 'chunk_id')}) GROUP BY 1, 2),
dl AS (SELECT chunk_id, sum(tf)::DOUBLE AS dl FROM tf GROUP BY 1),
st AS (SELECT (SELECT count(*) FROM chunks)::DOUBLE AS n,
              (SELECT sum(tf) FROM tf)::DOUBLE / (SELECT count(*) FROM chunks) AS avgdl),
idf0 AS MATERIALIZED (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS r FROM (SELECT term, count(*) AS df FROM tf GROUP BY 1), st),
idfm AS MATERIALIZED (SELECT avg(r) AS m FROM idf0),
idf AS (SELECT term, df, CASE WHEN r < 0 THEN 0.25 * m ELSE r END AS idf FROM idf0, idfm),
qtok AS (SELECT query_id, unnest({words('question')}) AS w FROM queries),
qt AS (SELECT query_id, term, count(*) AS qtf FROM ({stem_steps('qtok', 'query_id')}) GROUP BY 1, 2),
scored AS (
  SELECT qt.query_id, c.article_number, c.paragraph_number, c.chunk_id,
         round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS raw,
         sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS exact_raw
  FROM qt JOIN tf USING (term) JOIN idf USING (term) JOIN dl USING (chunk_id) JOIN chunks c USING (chunk_id)
  JOIN queries q ON q.query_id = qt.query_id, st {where} GROUP BY ALL),
bm25r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, article_number, paragraph_number NULLS FIRST, chunk_id) AS rank
  FROM scored WHERE exact_raw > 0),
bm25 AS (SELECT query_id, rank, article_number, paragraph_number, chunk_id, raw,
  raw / max(raw) OVER (PARTITION BY query_id) AS score FROM bm25r WHERE rank <= {limit})"""


DOC_CHUNKS = """
chunks AS (SELECT doc_id::VARCHAR AS chunk_id, doc_id::INTEGER AS article_number, NULL::INTEGER AS paragraph_number, text AS ctext FROM documents),
queries AS (SELECT item_id AS query_id, text AS question FROM benchmark)"""

# A document answers a question when it holds one of the question's sentences whole.
TRUTH = r"""
truth AS (SELECT DISTINCT q.query_id, d.doc_id::INTEGER AS article_number
  FROM (SELECT item_id AS query_id, trim(unnest(regexp_split_to_array(text, '[.\n]+'))) AS line FROM benchmark) q
  JOIN (SELECT doc_id, trim(unnest(regexp_split_to_array(text, '[.\n]+'))) AS line FROM documents) d USING (line) WHERE line <> '')"""


def paragraphs(source: str, key: str, col: str, out: str) -> str:
    """CTEs that split ``col`` of ``source`` into the list ``parts`` of ``out(key, parts)``."""
    opens = rf"'^[\(\[][{K.WS}]*[0-9٠-٩]+[{K.WS}]*[\)\]]|^[0-9٠-٩]+[{K.WS}.\-]'"
    return f"""
{out}_u AS (SELECT {key}, generate_subscripts(string_split({col}, chr(10)), 1) AS i, unnest(string_split({col}, chr(10))) AS line FROM {source}),
{out}_g AS (SELECT *, sum(CASE WHEN regexp_matches(line, {opens}) THEN 1 ELSE 0 END) OVER (PARTITION BY {key} ORDER BY i) AS grp FROM {out}_u),
{out}_a AS (SELECT {key}, grp, {strip('string_agg(line, chr(10) ORDER BY i)')} AS p FROM {out}_g GROUP BY {key}, grp),
{out}_n AS (SELECT {key}, list(p ORDER BY grp) FILTER (p <> '') AS ps FROM {out}_a GROUP BY {key}),
{out}_b AS (SELECT {key}, {col} AS t, list_filter(list_transform(string_split({col}, chr(10) || chr(10)), lambda x: {strip('x')}), lambda x: x <> '') AS bs FROM {source}),
{out} AS (SELECT b.{key}, CASE WHEN len(ps) > 1 THEN ps WHEN len(bs) > 1 THEN bs ELSE [{strip('t')}] END AS parts
  FROM {out}_b b JOIN {out}_n n ON b.{key} = n.{key})"""


# Article-level chunks of the derived corpus and the derived questions, with hash vectors.
DIM = 64
ASKED = (
    arabize("text") + " || CASE item_id % 4 WHEN 0 THEN ' المادة ' || (item_id + 40) "
    "WHEN 1 THEN ' Articles ' || (item_id + 380) || ' and 12' WHEN 2 THEN ' was it repealed?' ELSE '' END"
)


def hybrid_base(question: str = ASKED) -> str:
    return f"""{ARTICLES},
chunks AS (SELECT 'art_' || article_number AS chunk_id, article_number, NULL::INTEGER AS paragraph_number, text_ar AS ctext,
  text_ar, text_en, book, chapter, is_repealed, citation, source_page FROM articles),
queries AS (SELECT item_id AS query_id, {question} AS question FROM benchmark),
qf0 AS (SELECT query_id, question, {references('question', 'question')} AS nums FROM queries),
qf AS (SELECT query_id, question, nums,
  NOT ({" OR ".join(f"contains(lower({digits('question')}), '{k}')" for k in K.REPEALED_KEYWORDS)}
       OR len(list_filter(nums, lambda x: {in_ranges('x')})) > 0) AS exclude_repealed FROM qf0)"""


HYBRID_BASE = hybrid_base()


def unit_vectors(out: str, source: str, text: str) -> str:
    """CTEs that add the unit hash vector ``e`` (single precision) to ``source``."""
    return f"""{out}_h AS (SELECT *, {hash_embedding(text, DIM)} AS h FROM {source}),
{out}_n AS (SELECT *, sqrt(list_sum(list_transform(h, lambda x: x * x))) AS nrm FROM {out}_h),
{out}_e AS (SELECT *, generate_subscripts(h, 1) AS pos, unnest(h) / nrm AS x FROM {out}_n),
{out} AS (SELECT * EXCLUDE (pos, x, h, nrm), list(x::FLOAT::DOUBLE ORDER BY pos) AS e FROM {out}_e GROUP BY ALL)"""


def hybrid(top_k: int, depth: int) -> str:
    """CTEs from HYBRID_BASE to ``final(query_id, rank, chunk_id, score, source)``."""
    filters = """JOIN qf f ON f.query_id = qt.query_id WHERE (NOT f.exclude_repealed OR NOT c.is_repealed)
      AND (len(f.nums) = 0 OR list_contains(f.nums, c.article_number))"""
    scored = bm25(depth).replace("JOIN queries q ON q.query_id = qt.query_id, st ", "CROSS JOIN st " + filters)
    return f"""{scored},
{unit_vectors('vec', 'chunks', strip('ctext'))},
{unit_vectors('qvec', 'qf', 'question')},
sims AS (SELECT q.query_id, v.article_number, v.paragraph_number, v.chunk_id, round(list_cosine_similarity(v.e, q.e), 6) AS score
  FROM vec v, qvec q WHERE NOT q.exclude_repealed OR NOT v.is_repealed),
dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, article_number, paragraph_number NULLS FIRST, chunk_id) AS rank FROM sims)
  WHERE rank <= {depth}),
fused0 AS (SELECT query_id, article_number, paragraph_number, chunk_id, round(sum(part), 9) AS score, min(dr) AS dr, min(br) AS br FROM (
    SELECT query_id, article_number, paragraph_number, chunk_id, 0.7::DOUBLE / (60 + rank) AS part, rank AS dr, NULL AS br FROM dense
    UNION ALL SELECT query_id, article_number, paragraph_number, chunk_id, 0.3::DOUBLE / (60 + rank), NULL, rank FROM bm25) GROUP BY ALL),
fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, dr NULLS LAST, br NULLS LAST) AS rank FROM fused0),
exact AS (SELECT q.query_id, c.article_number, c.paragraph_number, c.chunk_id,
    row_number() OVER (PARTITION BY q.query_id ORDER BY c.article_number, c.chunk_id) AS rank
  FROM (SELECT query_id, unnest(nums) AS n FROM qf) q JOIN chunks c ON c.article_number = q.n),
allc AS (SELECT query_id, chunk_id, article_number, paragraph_number, 0 AS tier, rank, 1.0::DOUBLE AS score, 'exact_lookup' AS source FROM exact
  UNION ALL SELECT query_id, chunk_id, article_number, paragraph_number, 1, rank, score, 'hybrid' FROM fused),
firsts AS (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY tier, rank) AS k FROM allc),
merged AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY tier, rank) AS rank, chunk_id, article_number, paragraph_number, score, source FROM firsts WHERE k = 1),
final AS (SELECT * FROM merged WHERE rank <= {top_k})"""
