"""Layout queries over positioned spans derived from the documents."""

import uuid

from pyspark.sql import functions as F

from catalog import sqlparts as S
from catalog.fixtures import arabize
from catalog.registry import ORACLES, query, table
from lexmill import constants as K
from lexmill.operators import layout as L
from lexmill.plans.corpus import articles_from_spans
from lexmill.session import stage, staging_root
from lexmill.sources.readers import read_layout_spans

HEADING_TEXTS = ["BOOK II", "FIRST PART", "CHAPTER IV", "Section I", "3. Topic words"]

SRC = f"""src AS (SELECT doc_id, i - 1 AS i, line FROM (SELECT doc_id, generate_subscripts(l, 1) AS i, unnest(l) AS line
    FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))),
cells AS (SELECT doc_id::VARCHAR AS doc_id, i, (i // 8 + 1)::INTEGER AS page, (i % 8) * 18.0::DOUBLE + 40 AS y,
    CASE WHEN i % 3 = 0 THEN 'Article ' || (i // 3 + 1) || CASE (doc_id + i) % 4 WHEN 1 THEN ' of the same code' WHEN 2 THEN '. ' ELSE '' END
      WHEN i % 9 = 4 THEN '- 12 -' WHEN i % 7 = 2 THEN {S.lit('')} || CASE i % 5 {" ".join(f"WHEN {k} THEN '{h}'" for k, h in enumerate(HEADING_TEXTS))} END || ' ' || (i % 4)
      ELSE line END AS en,
    CASE WHEN i % 3 = 0 AND doc_id % 3 <> 2 THEN 'م ادة ' || (i // 3 + 1) ELSE {S.arabize('line')} || CASE WHEN i % 6 = 1 THEN ' ( 2 ) ' || {S.arabize('line')} ELSE '' END END AS ar
  FROM src),
lines0 AS (SELECT doc_id, page, (2 * i)::INTEGER AS line, 0 AS span, 'en' AS side, y, {S.strip('en')} AS text FROM cells
  UNION ALL SELECT doc_id, page, CASE WHEN i % 5 = 4 THEN 2 * i ELSE 2 * i + 1 END::INTEGER, CASE WHEN i % 5 = 4 THEN 1 ELSE 0 END, 'ar', y + 2, {S.strip('ar')} FROM cells),
lines AS (SELECT * FROM lines0 WHERE text <> '' AND NOT regexp_matches(text, '^-[{K.WS}]*[0-9]+[{K.WS}]*-$|(?i)^ITI([^{K.WORD}]|$)')),
cand0 AS (SELECT *, regexp_extract(text, '(?i)^(?:Article|rticle)[{K.WS}]*([0-9]+)', 1)::INTEGER AS n,
    {S.strip(f"regexp_replace(text, '(?i)^(?:Article|rticle)[{K.WS}]*[0-9]+', '')")} AS rest
  FROM lines WHERE side = 'en' AND regexp_matches(text, '(?i)^(?:Article|rticle)[{K.WS}]*[0-9]+([^{K.WORD}]|$)')),
cand AS (SELECT * FROM cand0 c WHERE NOT (regexp_matches(rest, '[{K.WS}]') OR starts_with(rest, '.')) OR EXISTS (
    SELECT 1 FROM lines a WHERE a.side = 'ar' AND a.doc_id = c.doc_id AND a.page = c.page AND abs(a.y - c.y) < 30 AND regexp_matches(a.text, '{K.ARABIC_MARKER_PATTERN}'))),
numbered AS (SELECT doc_id, page, y, line, n, row_number() OVER (PARTITION BY doc_id ORDER BY page, y, line) AS rn FROM cand),
walk AS (SELECT DISTINCT doc_id, 0::BIGINT AS rn, 0 AS last, false AS ok, 0 AS page, 0.0::DOUBLE AS y FROM numbered
  UNION ALL SELECT w.doc_id, w.rn + 1,
    CASE WHEN (last = 0 AND n = 1) OR (last > 0 AND n > last AND n <= last + CASE WHEN last IN (53, 54, 388) THEN 35 ELSE 5 END) THEN n ELSE last END,
    (last = 0 AND n = 1) OR (last > 0 AND n > last AND n <= last + CASE WHEN last IN (53, 54, 388) THEN 35 ELSE 5 END), c.page, c.y
  FROM walk w JOIN numbered c ON c.doc_id = w.doc_id AND c.rn = w.rn + 1),
headers AS (SELECT doc_id, last AS n, page, y FROM walk WHERE ok)"""
WITH = f"WITH RECURSIVE {SRC}"


def layout_spans(spark, sf):
    """Two columns of text per page with furniture, headings, article markers, decoys and crossing lines."""
    d, i = F.col("doc_id"), F.col("i")
    cells = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "text_line"))
    number = (F.floor(i / 3) + 1).cast("string")
    decoy = F.when((d + i) % 4 == 1, " of the same code").when((d + i) % 4 == 2, ". ").otherwise("")
    heading = F.element_at(F.array(*[F.lit(h) for h in HEADING_TEXTS]), (i % 5 + 1).cast("int"))
    line = F.col("text_line")
    en = (
        F.when(i % 3 == 0, F.concat(F.lit("Article "), number, decoy))
        .when(i % 9 == 4, "- 12 -")
        .when(i % 7 == 2, F.concat(heading, F.lit(" "), i % 4))
        .otherwise(line)
    )
    twice = F.when(i % 6 == 1, F.concat(F.lit(" ( 2 ) "), arabize(line))).otherwise("")
    ar = F.when((i % 3 == 0) & (d % 3 != 2), F.concat(F.lit("م ادة "), number)).otherwise(F.concat(arabize(line), twice))
    y = (i % 8) * 18.0 + 40
    crossing = i % 5 == 4

    def span(kind, line_no, no, x0, y0, line_x0, line_x1, text):
        return F.struct(
            F.lit(kind).alias("block_type"), line_no.cast("int").alias("line"), no.alias("span"), F.lit(line_x0).alias("line_x0") if isinstance(line_x0, float) else line_x0.alias("line_x0"),
            y0.alias("line_y0"), line_x1.alias("line_x1"), F.lit(x0).alias("x0"), y0.alias("y0"), text.alias("text"),
        )

    left = span(0, i * 2, F.lit(0), 50.0, y, 50.0, F.when(crossing, 550.0).otherwise(250.0), en)
    right_y = F.when(crossing, y).otherwise(y + 2)
    right = F.struct(
        F.lit(0).alias("block_type"), F.when(crossing, i * 2).otherwise(i * 2 + 1).cast("int").alias("line"),
        F.when(crossing, 1).otherwise(0).alias("span"), F.when(crossing, 50.0).otherwise(320.0).alias("line_x0"),
        right_y.alias("line_y0"), F.lit(550.0).alias("line_x1"), F.lit(320.0).alias("x0"), (y + 2).alias("y0"), ar.alias("text"),
    )
    image = span(1, i * 2 + 1_000_000, F.lit(0), 50.0, y, 50.0, F.lit(250.0), F.lit("picture"))
    return cells.select(
        F.col("doc_id").cast("string").alias("doc_id"),
        (F.floor(i / 8) + 1).cast("int").alias("page"),
        F.lit(0).alias("block"),
        F.lit(600.0).alias("page_width"),
        F.inline(F.array(left, right, image)),
    )


@query("layout_columns", f"{WITH} SELECT doc_id, page, line, span, side, y, text FROM lines")
def layout_columns(spark, sf):
    return L.column_lines(layout_spans(spark, sf)).select("doc_id", "page", "line", "span", "side", "y", "text")


@query("header_candidates", f"{WITH} SELECT doc_id, page, y, n FROM cand")
def header_candidates(spark, sf):
    lines = stage(L.column_lines(layout_spans(spark, sf)), "lines")
    return L.header_candidates(lines).select("doc_id", "page", "y", "n")


@query("header_selection", f"{WITH} SELECT doc_id, n, page, y FROM headers")
def header_selection(spark, sf):
    _, headers = parsed(spark, sf)
    return headers.select("doc_id", "n", "page", "y")


@query("header_selection_segmented", f"{WITH} SELECT doc_id, n, page, y FROM headers")
def header_selection_segmented(spark, sf):
    """The route of very long documents, taken by all of them."""
    lines = stage(L.column_lines(layout_spans(spark, sf)), "lines")
    headers = L.select_headers(L.header_candidates(lines), max_group=0, pages_per_segment=2, segments_per_block=2)
    return headers.select("doc_id", "n", "page", "y")


def parsed(spark, sf):
    lines = stage(L.column_lines(layout_spans(spark, sf)), "lines")
    return lines, stage(L.select_headers(stage(L.header_candidates(lines), "candidates")), "headers")


ASSIGNED = f"""{WITH}, last_page AS (SELECT doc_id, max(page) AS lp FROM lines GROUP BY 1),
bounds AS (SELECT h.doc_id, n, page AS sp, y AS sy, coalesce(lead(page) OVER w, lp) AS ep, coalesce(lead(y) OVER w, 99999.0::DOUBLE) AS ey
  FROM headers h JOIN last_page USING (doc_id) WINDOW w AS (PARTITION BY h.doc_id ORDER BY page, y)),
assigned AS (SELECT b.doc_id, b.n, l.side, l.page, l.y, l.line, l.span, l.text FROM bounds b JOIN lines l ON l.doc_id = b.doc_id AND l.page BETWEEN sp AND ep
  WHERE (l.page <> sp OR l.y + CASE WHEN l.side = 'ar' THEN -2 ELSE 0 END >= sy - 10) AND (l.page <> ep OR l.y + CASE WHEN l.side = 'ar' THEN -2 ELSE 0 END < ey - 4))"""


@query("span_assignment", f"{ASSIGNED} SELECT doc_id, n, side, page, y, text FROM assigned")
def span_assignment(spark, sf):
    lines, headers = parsed(spark, sf)
    return L.assign_lines(lines, headers).select("doc_id", "n", "side", "page", "y", "text")


_kind = "CASE " + " ".join(f"WHEN regexp_matches(text, {S.lit(p)}) THEN '{k}'" for k, p in K.HEADING_PATTERNS) + " END"


def _state(positions: str, out: str) -> str:
    """CTEs giving the heading state at ``positions(doc_id, page, y, n)``."""
    fill = ", ".join(
        f"coalesce(last_value(CASE WHEN kind = '{k}' THEN text END IGNORE NULLS) OVER w, {S.lit(K.DEFAULT_HEADINGS[k])}) AS {k}" for k in L.LEVELS
    )
    return f"""{out}_r AS (SELECT doc_id, page, y, line, false AS asked, NULL::INTEGER AS n, text, {_kind} AS kind FROM lines WHERE side = 'en'
      UNION ALL SELECT doc_id, page, y, 0, true, n, NULL, NULL FROM {positions}),
    {out} AS (SELECT * FROM (SELECT doc_id, page, n, asked, {fill} FROM {out}_r
      WINDOW w AS (PARTITION BY doc_id ORDER BY page, y, line, asked ROWS UNBOUNDED PRECEDING)) WHERE asked)"""


PAGE_END = "pos AS (SELECT doc_id, page, 1e18::DOUBLE AS y, n FROM headers)"


@query("heading_hierarchy", f"{WITH}, {PAGE_END}, {_state('pos', 'st')} SELECT doc_id, n, page, book, part, chapter, section, topic FROM st")
def heading_hierarchy(spark, sf):
    lines, headers = parsed(spark, sf)
    spots = headers.withColumn("y", F.lit(L.END_OF_PAGE))
    return L.heading_state(lines, spots, pages_per_block=2).select("doc_id", "n", "page", *L.LEVELS)


@query("heading_hierarchy_positional", f"{WITH}, {_state('headers', 'st')} SELECT doc_id, n, book, part, chapter, section, topic FROM st")
def heading_hierarchy_positional(spark, sf):
    lines, headers = parsed(spark, sf)
    return L.heading_state(lines, headers).select("doc_id", "n", *L.LEVELS)


D = "0-9٠-٩"
BUILT = f"""{ASSIGNED}, {PAGE_END}, {_state('pos', 'st')},
bodies AS (SELECT doc_id, n, coalesce(string_agg(text, ' ' ORDER BY page, y, line, span) FILTER (side = 'en'), '') AS en,
    coalesce(string_agg(text, ' ' ORDER BY page, y, line, span) FILTER (side = 'ar'), '') AS ar FROM assigned GROUP BY 1, 2),
b1 AS (SELECT doc_id, n, {S.strip(f"regexp_replace({S.strip('en')}, '(?i)^(?:Article|rticle)[{K.WS}]*[0-9]+[{K.WS}.:\\-)]*', '')")} AS text_en,
    {S.strip(f"regexp_replace({S.strip('ar')}, '^[{K.WS}(\\[]*{K.ARABIC_MARKER_PATTERN}[{K.WS}(\\[{D}\\-.:)]*', '')")} AS ar FROM bodies),
b2 AS (SELECT doc_id, n, text_en, {S.strip(f"regexp_replace(ar, '^[{K.WS}(\\[]*[{D}]+[{K.WS}).:\\-]*', '')")} AS ar FROM b1),
raws AS (SELECT doc_id, n, text_en, ar, {S.strip(f"regexp_replace(regexp_replace(ar, '(?:^|[{K.WS}])[\\x{{064B}}-\\x{{064D}}](?:[{K.WS}]|$)', ' ', 'g'), '[ \\t]+', ' ', 'g')")} AS text_ar_raw FROM b2),
built AS (SELECT st.doc_id AS corpus_id, st.n AS article_number, book, part, chapter, section, topic,
    CASE WHEN {S.norm('text_ar_raw')} <> '' THEN {S.norm('text_ar_raw')} ELSE text_ar_raw END AS text_ar, text_ar_raw, text_en, false AS is_repealed,
    st.page AS source_page, '{K.CITATION_PREFIX}' || st.n AS citation, {S.csv(S.references('ar', 'text_en', 'st.n'))} AS refs
  FROM st JOIN raws r ON r.doc_id = st.doc_id AND r.n = st.n)"""


def _flat(df):
    return df.withColumn("refs", F.array_join("references", ",")).drop("references")


@query("articles_from_layout", f"{BUILT} SELECT * FROM built")
def articles_from_layout(spark, sf):
    return _flat(L.build_articles(*parsed(spark, sf)))


# Status ranges small enough for the derived documents to meet them.
RANGES = [
    dict(lo=2, hi=3, page=2, chapter=None, section=None, fallback=("B", "P", "C", "S"), note_ar=K.NOTE_54_AR, note_en=K.NOTE_54_EN),
    dict(lo=6, hi=8, page=3, chapter="Set chapter", section="Set section", fallback=("B2", "P2", "", ""), note_ar=K.NOTE_389_AR, note_en=K.NOTE_389_EN),
]


def _overlay_sql() -> str:
    parts = []
    for i, r in enumerate(RANGES):
        fb = dict(zip(L.LEVELS, r["fallback"]))
        level = {k: f"CASE WHEN {r['page']} <= lp THEN o{i}.{k} ELSE '{fb[k]}' END" for k in L.LEVELS[:4]}
        for k in ("chapter", "section"):
            level[k] = f"'{r[k]}'" if r[k] else level[k]
        parts.append(
            f"SELECT o{i}.doc_id AS corpus_id, x AS article_number, {', '.join(f'{v} AS {k}' for k, v in level.items())}, '{K.OVERLAY_TOPIC}' AS topic, "
            f"{S.norm(S.lit(r['note_ar']))} AS text_ar, {S.lit(r['note_ar'])} AS text_ar_raw, {S.lit(r['note_en'])} AS text_en, true AS is_repealed, {r['page']} AS source_page, "
            f"'{K.CITATION_PREFIX}' || x || ' (Repealed)' AS citation, '' AS refs FROM o{i} JOIN last_page USING (doc_id), (SELECT unnest(range({r['lo']}, {r['hi'] + 1}))::INTEGER AS x)"
        )
    ctes = ", ".join(
        f"p{i} AS (SELECT doc_id, {r['page']} AS page, 1e18::DOUBLE AS y, 0 AS n FROM last_page), {_state(f'p{i}', f'o{i}')}" for i, r in enumerate(RANGES)
    )
    cut = " OR ".join(f"article_number BETWEEN {r['lo']} AND {r['hi']}" for r in RANGES)
    return f"{BUILT}, {ctes}, overlaid AS (SELECT * FROM built WHERE NOT ({cut}) UNION ALL {' UNION ALL '.join(parts)})"


@query("status_overlay", f"{_overlay_sql()} SELECT * FROM overlaid")
def status_overlay(spark, sf):
    lines, headers = parsed(spark, sf)
    return _flat(L.overlay_status(L.build_articles(lines, headers), lines, RANGES))


MARK = rf"[(\[][{K.WS}]*[٢2][{K.WS}]*[()\]]"


@query(
    "corpus_from_layout",
    f"""{_overlay_sql()},
    marked AS (SELECT corpus_id, article_number, text_ar_raw, regexp_extract(text_ar_raw, '{MARK}') AS m FROM overlaid WHERE article_number IN (1, 4) AND regexp_matches(text_ar_raw, '{MARK}')),
    cut AS (SELECT corpus_id, article_number, substr(text_ar_raw, 1, strpos(text_ar_raw, m) - 1) AS p1, substr(text_ar_raw, strpos(text_ar_raw, m) + length(m)) AS p2 FROM marked k
      WHERE EXISTS (SELECT 1 FROM overlaid o WHERE o.corpus_id = k.corpus_id AND o.article_number = k.article_number + 1)),
    patch AS (SELECT corpus_id, article_number, {S.strip('p1')} AS p FROM cut UNION ALL SELECT corpus_id, article_number + 1, {S.strip('p2')} FROM cut)
    SELECT o.* REPLACE (CASE WHEN p.p IS NOT NULL THEN {S.norm('p.p')} ELSE text_ar END AS text_ar, coalesce(p.p, text_ar_raw) AS text_ar_raw)
    FROM overlaid o LEFT JOIN patch p ON p.corpus_id = o.corpus_id AND p.article_number = o.article_number""",
)
def corpus_from_layout(spark, sf):
    return _flat(articles_from_spans(layout_spans(spark, sf), RANGES, [1, 4]))


@query("corpus_from_stored_spans", ORACLES["corpus_from_layout"])
def corpus_from_stored_spans(spark, sf):
    """The same corpus from spans that were written and are read with their schema."""
    path = f"{staging_root(spark)}/spans-{uuid.uuid4().hex}"
    layout_spans(spark, sf).write.parquet(path)
    return _flat(articles_from_spans(read_layout_spans(spark, path), RANGES, [1, 4]))
