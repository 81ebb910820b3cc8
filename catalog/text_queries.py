"""Text column queries."""

from pyspark.sql import functions as F

from catalog import fixtures as X
from catalog import sqlparts as S
from catalog.registry import query, table
from lexmill import constants as K
from lexmill.functions import guards as G
from lexmill.functions import text as T

AR = S.arabize("text")


def _csv(col):
    return F.array_join(col, ",")


@query("western_digits", f"SELECT doc_id, {S.digits(AR)} AS digits_text FROM documents")
def western_digits(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", T.western_digits(X.arabize(F.col("text"))).alias("digits_text"))


@query(
    "normalize_text",
    f"SELECT doc_id, {S.norm(AR)} AS normalized, {S.norm(AR, True)} AS normalized_teh FROM documents",
)
def normalize_text(spark, sf):
    ar = X.arabize(F.col("text"))
    return table(spark, sf, "documents").select(
        "doc_id", T.normalize(ar).alias("normalized"), T.normalize(ar, True).alias("normalized_teh")
    )


DIRTY = r"replace(replace(replace(text, '. ', '.' || chr(160) || ' «'), ', ', ' ' || chr(57362) || ' ” '), chr(10), '  ' || chr(10) || chr(10) || chr(9) || chr(10) || ' ')"


@query(
    "clean_raw_text",
    rf"""WITH d AS (SELECT doc_id, {DIRTY} AS t FROM documents),
    s AS (SELECT doc_id, translate(translate(regexp_replace(t, '[\x{{E000}}-\x{{F8FF}}]', '', 'g'),
            chr(160) || chr(8203), ' '), '«»”“’‘', repeat(chr(34), 4) || repeat(chr(39), 2)) AS t FROM d),
    u AS (SELECT doc_id, generate_subscripts(string_split(t, chr(10)), 1) AS i,
            unnest(string_split(t, chr(10))) AS line FROM s),
    l AS (SELECT doc_id, i, {S.strip("regexp_replace(line, '[ \\t]+', ' ', 'g')")} AS line FROM u),
    k AS (SELECT *, lag(line, 1, '') OVER (PARTITION BY doc_id ORDER BY i) AS before FROM l)
    SELECT doc_id, {S.strip("string_agg(line, chr(10) ORDER BY i)")} AS cleaned
    FROM k WHERE line <> '' OR before <> '' GROUP BY doc_id""",
)
def clean_raw_text(spark, sf):
    docs = table(spark, sf, "documents")
    dirty = F.replace(F.col("text"), F.lit(". "), F.lit(".\u00a0 «"))
    dirty = F.replace(dirty, F.lit(", "), F.lit(" \ue012 ” "))
    dirty = F.replace(dirty, F.lit("\n"), F.lit("  \n\n\t\n "))
    return docs.select("doc_id", T.clean_raw(dirty).alias("cleaned"))


MARK = "'( ' || " + S.arabize("CAST(doc_id % 1500 AS VARCHAR)") + " || ' )'"


@query(
    "marker_numbers",
    f"""WITH m AS (SELECT doc_id, array_to_string(regexp_extract_all({S.digits(MARK)}, '[0-9]+'), '') AS d
    FROM documents), v AS (SELECT doc_id, TRY_CAST(d AS BIGINT) AS val, TRY_CAST(reverse(d) AS BIGINT) AS rev FROM m)
    SELECT doc_id, CASE WHEN rev BETWEEN 1 AND 1149 AND NOT val BETWEEN 1 AND 1149 THEN rev ELSE val END AS marker
    FROM v""",
)
def marker_numbers(spark, sf):
    marker = F.concat(F.lit("( "), X.arabize((F.col("doc_id") % 1500).cast("string")), F.lit(" )"))
    return table(spark, sf, "documents").select("doc_id", T.marker_number(marker).alias("marker"))


@query(
    "reference_edges",
    f"""WITH {S.ARTICLES}
    SELECT article_number AS src, unnest({S.references('text_ar_raw', 'text_en', 'article_number')}) AS dst
    FROM articles""",
)
def reference_edges(spark, sf):
    return T.reference_edges(X.articles(spark, sf))


@query(
    "detect_script",
    f"""SELECT conv_id, turn, {S.is_arabic('text')} AS latin_side,
    {S.is_arabic("CASE WHEN turn % 2 = 0 THEN " + AR + " ELSE text END")} AS mixed_side FROM conversations""",
)
def detect_script(spark, sf):
    text = F.col("text")
    mixed = F.when(F.col("turn") % 2 == 0, X.arabize(text)).otherwise(text)
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", T.is_arabic(text).alias("latin_side"), T.is_arabic(mixed).alias("mixed_side")
    )


@query(
    "token_counts",
    f"""WITH u AS (SELECT doc_id, unnest({S.words(AR)}) AS w FROM documents),
    t AS ({S.stem_steps('u', 'doc_id')})
    SELECT term, count(*) AS occurrences, count(DISTINCT doc_id) AS docs FROM t GROUP BY term""",
)
def token_counts(spark, sf):
    words = T.kept_words(X.arabize(F.col("text")))
    per_doc = (
        table(spark, sf, "documents")
        .select("doc_id", F.explode(words).alias("w"))
        .groupBy("doc_id", T.stem(F.col("w")).alias("term"))
        .count()
    )
    return per_doc.groupBy("term").agg(
        F.sum("count").alias("occurrences"), F.count("*").alias("docs")
    )


# Frequent fragments of the given text; the second term contains the first.
CONCEPTS = [("the", "article clause"), ("there", "provision"), ("tion", "contract party"), ("le de", "obligation")]


@query(
    "expand_queries",
    "SELECT item_id, text"
    + "".join(f" || CASE WHEN contains({S.norm('text', True)}, '{t}') THEN ' {s}' ELSE '' END" for t, s in CONCEPTS)
    + " AS expanded FROM benchmark",
)
def expand_queries(spark, sf):
    return table(spark, sf, "benchmark").select(
        "item_id", T.expand_query(F.col("text"), CONCEPTS).alias("expanded")
    )


@query(
    "expand_queries_by_table",
    f"""WITH syn AS (SELECT item_id AS ord, split_part({S.norm('text', True)}, ' ', 1) AS term,
        split_part({S.norm('text', True)}, ' ', 2) AS syns FROM benchmark),
    q AS (SELECT conv_id * 1000 + turn AS query_id, text AS question FROM conversations),
    hits AS (SELECT query_id, string_agg(syns, ' ' ORDER BY ord) AS added FROM q JOIN syn
        ON contains({S.norm('question', True)}, {S.norm('term', True)}) WHERE term <> '' GROUP BY query_id)
    SELECT query_id, question || coalesce(' ' || added, '') AS expanded FROM q LEFT JOIN hits USING (query_id)""",
)
def expand_queries_by_table(spark, sf):
    norm = T.normalize(F.col("text"), True)
    synonyms = table(spark, sf, "benchmark").select(
        F.col("item_id").alias("ord"),
        F.split_part(norm, F.lit(" "), F.lit(1)).alias("term"),
        F.split_part(norm, F.lit(" "), F.lit(2)).alias("syns"),
    )
    questions = table(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("text").alias("question")
    )
    return T.expand_query_table(questions, synonyms).select("query_id", "expanded")


def _pii_sql() -> tuple[str, str]:
    """Chained redaction for RE2, with ASCII word edges."""
    steps = [
        ("national_id", r"\b[23][0-9]{13}\b", "[NATIONAL_ID_REDACTED]"),
        ("iban", r"(?i)\bEG[0-9]{2}[A-Za-z0-9]{25}\b", "[IBAN_REDACTED]"),
        ("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "[EMAIL_REDACTED]"),
        ("phone", rf"(?:\+?20[{K.WS}]*|0)?1[0125][0-9{K.WS}\-]{{8}}\b", "[PHONE_REDACTED]"),
        ("credit_card", rf"\b(?:[0-9]{{4}}[-{K.WS}]?){{3}}[0-9]{{4}}\b", "[CARD_REDACTED]"),
    ]
    ctes = [
        "p0 AS (SELECT doc_id, translate(text || CASE doc_id % 4 WHEN 1 THEN ' id 2950101' || lpad(doc_id::VARCHAR, 7, '0')"
        " WHEN 2 THEN ' iban EG12' || lpad(doc_id::VARCHAR, 25, '7')"
        f" WHEN 3 THEN ' tel ٠١٠' || lpad(doc_id::VARCHAR, 8, '3') ELSE '' END, '{K.ARABIC_DIGITS}', '{K.WESTERN_DIGITS}') AS t FROM documents)"
    ]
    finds = []
    for i, (kind, pattern, marker) in enumerate(steps):
        ctes.append(
            f"p{i + 1} AS (SELECT doc_id, regexp_replace(t, {S.lit(pattern)}, '{marker}', 'g') AS t FROM p{i})"
        )
        finds.append(
            f"SELECT doc_id, '{kind}' AS type, unnest(regexp_extract_all(t, {S.lit(pattern)})) AS value FROM p{i}"
        )
    return "WITH " + ", ".join(ctes), " UNION ALL ".join(finds)


PII_CTES, PII_FINDS = _pii_sql()


def _with_personal_data(spark, sf):
    d = F.col("doc_id")
    extra = (
        F.when(d % 4 == 1, F.concat(F.lit(" id 2950101"), F.lpad(d.cast("string"), 7, "0")))
        .when(d % 4 == 2, F.concat(F.lit(" iban EG12"), F.lpad(d.cast("string"), 25, "7")))
        .when(d % 4 == 3, F.concat(F.lit(" tel ٠١٠"), F.lpad(d.cast("string"), 8, "3")))
        .otherwise("")
    )
    return table(spark, sf, "documents").select("doc_id", F.concat("text", extra).alias("text"))


@query("pii_redaction", f"{PII_CTES} SELECT doc_id, t AS redacted FROM p5")
def pii_redaction(spark, sf):
    redacted, _ = G.redact(F.col("text"))
    return _with_personal_data(spark, sf).select("doc_id", redacted.alias("redacted"))


@query("pii_findings", f"{PII_CTES} {PII_FINDS}")
def pii_findings(spark, sf):
    _, found = G.redact(F.col("text"))
    return _with_personal_data(spark, sf).select("doc_id", F.inline(found))


@query("pii_type_counts", f"{PII_CTES} SELECT type, count(*) AS n FROM ({PII_FINDS}) GROUP BY type")
def pii_type_counts(spark, sf):
    _, found = G.redact(F.col("text"))
    return (
        _with_personal_data(spark, sf)
        .select(F.inline(found))
        .groupBy("type")
        .agg(F.count("*").alias("n"))
    )


TALK = (
    "CASE WHEN role <> 'user' THEN text WHEN conv_id % 7 = 0 THEN 'مرحبا ' || text WHEN conv_id % 11 = 0 THEN 'Thank you ' || text "
    "WHEN conv_id % 13 = 0 THEN 'من أنت' WHEN conv_id % 5 = 0 THEN 'Who are you' ELSE text END"
)


def _starts(phrases: list[str]) -> str:
    q = f"lower({S.norm('q', True)})"
    return "(" + " OR ".join(f"{q} = '{p}' OR starts_with({q}, '{p} ')" for p in phrases) + ")"


@query(
    "small_talk_routing",
    f"""WITH c AS (SELECT conv_id, turn, {TALK} AS q FROM conversations)
    SELECT conv_id, turn, CASE WHEN {_starts(K.GREETINGS)} THEN 'greeting' WHEN {_starts(K.THANKS)} THEN 'thanks'
    WHEN {_starts(K.IDENTITY)} THEN 'identity' END AS intent FROM c""",
)
def small_talk_routing(spark, sf):
    return with_small_talk(spark, sf).select("conv_id", "turn", G.small_talk(F.col("q")).alias("intent"))


def small_talk_column():
    conv, text = F.col("conv_id"), F.col("text")
    return (
        F.when(F.col("role") != "user", text)
        .when(conv % 7 == 0, F.concat(F.lit("مرحبا "), text))
        .when(conv % 11 == 0, F.concat(F.lit("Thank you "), text))
        .when(conv % 13 == 0, "من أنت")
        .when(conv % 5 == 0, "Who are you")
        .otherwise(text)
    )


def with_small_talk(spark, sf):
    return table(spark, sf, "conversations").withColumn("q", small_talk_column())


QUESTION = (
    "text || CASE item_id % 4 WHEN 0 THEN ' المادة ' || (item_id + 40) WHEN 1 THEN ' Articles ' || (item_id + 380) || ' and 12'"
    " WHEN 2 THEN ' was it repealed?' ELSE '' END"
)
_kw = " OR ".join(f"contains(lower({S.digits('q')}), '{k}')" for k in K.REPEALED_KEYWORDS)


@query(
    "query_filters",
    f"""WITH b AS (SELECT item_id, {QUESTION} AS q FROM benchmark),
    n AS (SELECT item_id, q, {S.references('q', 'q')} AS nums FROM b)
    SELECT item_id, {S.csv('nums')} AS article_numbers,
    NOT ({_kw} OR len(list_filter(nums, lambda x: {S.in_ranges('x')})) > 0) AS exclude_repealed FROM n""",
)
def query_filters(spark, sf):
    f = T.detect_filters(F.col("question"))
    return (
        questions_with_numbers(spark, sf)
        .select("query_id", f.alias("f"))
        .select(
            F.col("query_id").alias("item_id"),
            F.coalesce(_csv(F.col("f.article_numbers")), F.lit("")).alias("article_numbers"),
            "f.exclude_repealed",
        )
    )


def questions_with_numbers(spark, sf):
    i = F.col("item_id")
    tail = (
        F.when(i % 4 == 0, F.concat(F.lit(" المادة "), i + 40))
        .when(i % 4 == 1, F.concat(F.lit(" Articles "), i + 380, F.lit(" and 12")))
        .when(i % 4 == 2, " was it repealed?")
        .otherwise("")
    )
    return table(spark, sf, "benchmark").select(i.alias("query_id"), F.concat("text", tail).alias("question"))


@query(
    "paragraph_split",
    rf"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN replace(text, chr(10), chr(10) || '(' || (doc_id % 9) || ') ')
        WHEN doc_id % 3 = 1 THEN replace(text, chr(10), chr(10) || chr(10)) ELSE text END AS t FROM documents),
    u AS (SELECT doc_id, generate_subscripts(string_split(t, chr(10)), 1) AS i, unnest(string_split(t, chr(10))) AS line FROM d),
    m AS (SELECT *, CASE WHEN regexp_matches(line, '^[\(\[][{K.WS}]*[0-9٠-٩]+[{K.WS}]*[\)\]]|^[0-9٠-٩]+[{K.WS}.\-]') THEN 1 ELSE 0 END AS opens FROM u),
    g AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS grp FROM m),
    a AS (SELECT doc_id, grp, {S.strip('string_agg(line, chr(10) ORDER BY i)')} AS p FROM g GROUP BY doc_id, grp),
    num AS (SELECT doc_id, list(p ORDER BY grp) FILTER (p <> '') AS ps FROM a GROUP BY doc_id),
    b AS (SELECT doc_id, t, list_filter(list_transform(string_split(t, chr(10) || chr(10)), lambda x: {S.strip('x')}), lambda x: x <> '') AS bs FROM d),
    r AS (SELECT b.doc_id, CASE WHEN len(ps) > 1 THEN ps WHEN len(bs) > 1 THEN bs ELSE [{S.strip('t')}] END AS parts
        FROM b JOIN num ON b.doc_id = num.doc_id)
    SELECT doc_id, generate_subscripts(parts, 1)::INTEGER AS paragraph_number, unnest(parts) AS paragraph FROM r""",
)
def paragraph_split(spark, sf):
    text, d = F.col("text"), F.col("doc_id")
    numbered = F.replace(text, F.lit("\n"), F.concat(F.lit("\n("), (d % 9).cast("string"), F.lit(") ")))
    blank = F.replace(text, F.lit("\n"), F.lit("\n\n"))
    t = F.when(d % 3 == 0, numbered).when(d % 3 == 1, blank).otherwise(text)
    return (
        table(spark, sf, "documents")
        .select("doc_id", F.posexplode(T.paragraphs(t)).alias("pos", "paragraph"))
        .select("doc_id", (F.col("pos") + 1).alias("paragraph_number"), "paragraph")
    )


@query(
    "embedding_inputs",
    f"""WITH {S.ARTICLES} SELECT article_number, {S.strip('text_ar')} AS ar, {S.strip('text_en')} AS en,
    'passage: ' || {S.strip("text_ar || chr(10) || text_en")} AS both_prefixed FROM articles""",
)
def embedding_inputs(spark, sf):
    ar, en = F.col("text_ar"), F.col("text_en")
    return X.articles(spark, sf).select(
        "article_number",
        T.embedding_text("ar", ar, en).alias("ar"),
        T.embedding_text("en", ar, en).alias("en"),
        T.embedding_text("ar+en", ar, en, "passage: ").alias("both_prefixed"),
    )


CITING = (
    "text || CASE doc_id % 4 WHEN 0 THEN ' [المادة ' || (doc_id + 99999999999) || '] [Article ' || (doc_id + 3) || ']'"
    " WHEN 1 THEN ' as in article ' || (doc_id + 2) || ' and المادة ٧٧.' ELSE '' END"
)


@query("cited_numbers", f"SELECT doc_id, {S.csv(S.cited('t'))} AS cited FROM (SELECT doc_id, {CITING} AS t FROM documents)")
def cited_numbers(spark, sf):
    d = F.col("doc_id")
    tail = (
        F.when(d % 4 == 0, F.concat(F.lit(" [المادة "), d + 99_999_999_999, F.lit("] [Article "), d + 3, F.lit("]")))
        .when(d % 4 == 1, F.concat(F.lit(" as in article "), d + 2, F.lit(" and المادة ٧٧.")))
        .otherwise("")
    )
    return table(spark, sf, "documents").select(
        "doc_id", _csv(T.cited_numbers(F.concat("text", tail))).alias("cited")
    )


@query(
    "refusal_detection",
    f"""SELECT conv_id, turn, contains(t, {S.lit(K.REFUSAL_MARK_AR)}) OR contains(lower(t), {S.lit(K.REFUSAL_MARK_EN)}) AS is_refusal
    FROM (SELECT conv_id, turn, text || CASE conv_id % 5 WHEN 0 THEN ' {K.REFUSAL_EN}' WHEN 1 THEN ' {K.REFUSAL_AR}' ELSE '' END AS t
    FROM conversations)""",
)
def refusal_detection(spark, sf):
    conv = F.col("conv_id")
    tail = F.when(conv % 5 == 0, " " + K.REFUSAL_EN).when(conv % 5 == 1, " " + K.REFUSAL_AR).otherwise("")
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", T.is_refusal(F.concat("text", tail)).alias("is_refusal")
    )


@query(
    "judge_outputs",
    """WITH j AS (SELECT doc_id, CAST((doc_id % 150) AS DOUBLE) / 100 - 0.2 AS v, doc_id % 10 AS k FROM documents)
    SELECT doc_id, CASE WHEN k IN (4, 6, 8, 9) THEN NULL WHEN k = 3 THEN 0.0 WHEN k = 7 THEN 1.0 ELSE round(least(1.0, greatest(0.0, round(v, 2))), 6) END AS faithfulness,
      CASE WHEN k IN (4, 6, 8, 9) THEN NULL WHEN k = 7 THEN 0.0 ELSE 0.5::DOUBLE END AS answer_relevancy,
      CASE WHEN k IN (4, 6, 8, 9) THEN 'Error: judge output is not valid' WHEN k IN (2, 7) THEN 'LLM judged successfully' ELSE 'ok' END AS reason FROM j""",
)
def judge_outputs(spark, sf):
    d = F.col("doc_id")
    v = F.round((d % 150).cast("double") / 100 - 0.2, 2)
    full = F.format_string('{"faithfulness": %.2f, "answer_relevancy": 0.5, "reason": "ok"}', v)
    k = d % 10
    raw = (
        F.when(k == 0, F.concat(F.lit("Here:\n```json\n"), full, F.lit("\n```\nDone")))
        .when(k == 1, F.concat(F.lit("```\n"), full, F.lit("\n```")))
        .when(k == 2, F.format_string('{"faithfulness": "%.2f", "answer_relevancy": 0.5}', v))
        .when(k == 3, F.lit('{"answer_relevancy": 0.5, "reason": "ok"}'))
        .when(k == 4, F.concat(F.lit("not json "), full))
        .when(k == 6, F.concat(full, F.lit(" Done")))
        .when(k == 7, F.lit('{"faithfulness": true, "answer_relevancy": false}'))
        .when(k == 8, F.concat(full, F.lit(" "), full))
        .when(k == 9, F.lit('{"faithfulness": null, "answer_relevancy": 0.5, "reason": "ok"}'))
        .otherwise(full)
    )
    return (
        table(spark, sf, "documents")
        .select("doc_id", G.parse_judgement(raw).alias("j"))
        .select("doc_id", F.round("j.faithfulness", 6).alias("faithfulness"), "j.answer_relevancy", "j.reason")
    )
