"""Corpus and dataset check queries."""

from pyspark.sql import functions as F

from catalog import fixtures as X
from catalog import sqlparts as S
from catalog.registry import ORACLES, query, table
from lexmill import constants as K
from lexmill.operators import quality as Q

DUP = "SELECT article_number, count(*) AS n FROM faulty GROUP BY 1 HAVING count(*) > 1"
MISS = "SELECT n::INTEGER AS article_number FROM range(1, 1150) r(n) WHERE n NOT IN (SELECT article_number FROM faulty)"
OUT = "SELECT DISTINCT article_number FROM faulty WHERE article_number NOT BETWEEN 1 AND 1149"


@query("corpus_duplicates", f"WITH {S.FAULTY} {DUP}")
def corpus_duplicates(spark, sf):
    return Q.duplicate_keys(X.faulty_articles(spark, sf))


@query("corpus_missing", f"WITH {S.FAULTY} {MISS}")
def corpus_missing(spark, sf):
    return Q.missing_keys(X.faulty_articles(spark, sf))


@query("corpus_out_of_range", f"WITH {S.ARTICLES} SELECT article_number + 400 AS article_number FROM articles WHERE article_number + 400 > 1149")
def corpus_out_of_range(spark, sf):
    shifted = X.articles(spark, sf).withColumn("article_number", F.col("article_number") + 400)
    return Q.out_of_range_keys(shifted)


def _rules_sql() -> str:
    say = "'Article ' || article_number || ': "
    rules = [
        ("citation", f"NOT starts_with(citation, '{K.CITATION_PREFIX}')", f"{say}Malformed citation ''' || citation || ''''"),
        ("text_ar_empty", f"{S.strip('text_ar')} = ''", f"{say}text_ar is empty'"),
        ("text_ar_raw_empty", f"{S.strip('text_ar_raw')} = ''", f"{say}text_ar_raw is empty'"),
        ("text_en_empty", f"{S.strip('text_en')} = ''", f"{say}text_en is empty'"),
        ("text_ar_length", "length(text_ar) > 5000", f"{say}text_ar length (' || length(text_ar) || ') exceeds threshold (5000)'"),
        ("text_en_length", "length(text_en) > 5000", f"{say}text_en length (' || length(text_en) || ') exceeds threshold (5000)'"),
        ("repeal_missing", f"{S.in_ranges('article_number')} AND NOT is_repealed", f"{say}Known repealed article is not flagged is_repealed=True'"),
        ("repeal_unknown", f"NOT {S.in_ranges('article_number')} AND is_repealed", f"{say}Article flagged as repealed but not in known repealed list'"),
        ("source_page", "source_page < 1", f"{say}Invalid source_page (' || source_page || ')'"),
    ]
    return " UNION ALL ".join(
        f"SELECT '{r}' AS rule, article_number, {m} AS message FROM faulty WHERE {c}" for r, c, m in rules
    )


@query("corpus_row_violations", f"WITH {S.FAULTY} {_rules_sql()}")
def corpus_row_violations(spark, sf):
    return Q.row_violations(X.faulty_articles(spark, sf))


@query(
    "corpus_violations",
    f"""WITH {S.FAULTY}, v AS ({_rules_sql()}),
    d AS (SELECT 'duplicate' AS rule, article_number, 'Duplicate article number: ' || article_number AS message FROM ({DUP})),
    m AS (SELECT 'missing' AS rule, article_number, 'Missing article number: ' || article_number AS message FROM ({MISS})),
    o AS (SELECT 'out_of_range' AS rule, article_number, 'Unexpected article number out of bounds: ' || article_number AS message FROM ({OUT}))
    SELECT * FROM d UNION ALL SELECT * FROM m UNION ALL SELECT * FROM o UNION ALL SELECT * FROM v""",
)
def corpus_violations(spark, sf):
    return Q.violations(X.faulty_articles(spark, sf))


@query(
    "corpus_assertion",
    f"""WITH found AS ({ORACLES["corpus_violations"]}), r AS (SELECT message, row_number() OVER (ORDER BY article_number, rule, message) AS k, count(*) OVER () AS n FROM found)
    SELECT 'faulty' AS corpus, 'Corpus validation failed with ' || max(n) || ' error(s):' || chr(10) || string_agg(' - ' || message, chr(10) ORDER BY k) FILTER (k <= 20)
      || chr(10) || ' ... and ' || (max(n) - 20) || ' more' AS message FROM r
    UNION ALL SELECT 'empty', 'Corpus validation failed with ' || (1 + 1149) || ' error(s):' || chr(10) || ' - Corpus is empty: 0 articles found.' || chr(10)
      || (SELECT string_agg(' - Missing article number: ' || i, chr(10) ORDER BY i) FROM range(1, 20) t(i)) || chr(10) || ' ... and 1130 more'""",
)
def corpus_assertion(spark, sf):
    """What the assertion says of a faulty corpus and of one without articles."""
    faulty = X.faulty_articles(spark, sf)
    said = []
    for name, corpus in (("faulty", faulty), ("empty", faulty.filter("article_number < 0"))):
        try:
            Q.assert_valid(corpus)
        except Q.CorpusValidationError as e:
            said.append((name, str(e)))
    return spark.createDataFrame(said, "corpus string, message string")


COUNTS = "count(*) AS total_articles, count_if(NOT is_repealed)::BIGINT AS active_articles, count_if(is_repealed)::BIGINT AS repealed_articles"


@query("corpus_metadata", f"WITH {S.ARTICLES} SELECT {COUNTS}, min(article_number) AS min_article_number, max(article_number) AS max_article_number FROM articles")
def corpus_metadata(spark, sf):
    return Q.metadata(X.articles(spark, sf))


@query("corpus_statistics", f"WITH {S.ARTICLES} SELECT {COUNTS}, array_to_string(list_sort(list(DISTINCT book)), ',') AS books FROM articles")
def corpus_statistics(spark, sf):
    return Q.statistics(X.articles(spark, sf)).withColumn("books", F.array_join("books", ","))


def _snippet(c: str) -> str:
    return f"replace(substr({c}, 1, 160), chr(10), ' ') || CASE WHEN length({c}) > 160 THEN '...' ELSE '' END"


@query(
    "spot_check_sample",
    f"""WITH {S.ARTICLES}, picked AS (SELECT * FROM articles ORDER BY md5('42:' || article_number), article_number LIMIT 20),
    r AS (SELECT *, {S.references('text_ar_raw', 'text_en', 'article_number')} AS refs FROM picked)
    SELECT article_number, CASE WHEN is_repealed THEN 'REPEALED' ELSE 'ACTIVE' END AS status, citation, source_page,
    coalesce(book, 'N/A') AS book, coalesce(part, 'N/A') AS part, chapter, section, coalesce(topic, 'N/A') AS topic,
    CASE WHEN len(refs) > 0 THEN array_to_string(refs, ', ') ELSE 'None' END AS cross_references,
    length(text_ar)::INTEGER AS length_ar, length(text_en)::INTEGER AS length_en,
    {_snippet('text_ar')} AS snippet_ar, {_snippet('text_en')} AS snippet_en FROM r""",
)
def spot_check_sample(spark, sf):
    return Q.spot_check(X.articles(spark, sf), portable=True)


@query(
    "article_lookup",
    f"""WITH {S.ARTICLES}, req AS (SELECT DISTINCT CAST(user_id * 9 - 20 AS INTEGER) AS article_number FROM events)
    SELECT r.article_number, citation, coalesce(a.article_number IS NOT NULL AND r.article_number BETWEEN 1 AND 1149, false) AS found
    FROM req r LEFT JOIN articles a USING (article_number)""",
)
def article_lookup(spark, sf):
    wanted = table(spark, sf, "events").select((F.col("user_id") * 9 - 20).cast("int").alias("article_number")).distinct()
    return Q.lookup(wanted, X.articles(spark, sf)).select("article_number", "citation", "found")


CATS = "['contracts','torts','obligations','property','leases','repealed','out_of_scope']"


@query(
    "eval_set_checks",
    f"""WITH q AS (SELECT {CATS}[1 + (item_id % 7)] AS category, CASE WHEN item_id % 2 = 0 THEN text END AS ar,
        item_id % 7 = 6 AS refuse, item_id % 3 = 0 AS ci FROM benchmark),
    c AS (SELECT count(*) AS total_questions, count(DISTINCT category) AS required_categories, count(ar) AS bilingual_twins,
        count_if(category = 'repealed')::BIGINT AS repealed_questions, count_if(refuse)::BIGINT AS refusal_questions, count_if(ci)::BIGINT AS ci_subset_size FROM q),
    r AS (SELECT 'total_questions' AS rule, total_questions AS value, 50 AS minimum FROM c
        UNION ALL SELECT 'required_categories', required_categories, 7 FROM c UNION ALL SELECT 'bilingual_twins', bilingual_twins, 20 FROM c
        UNION ALL SELECT 'repealed_questions', repealed_questions, 5 FROM c UNION ALL SELECT 'refusal_questions', refusal_questions, 5 FROM c
        UNION ALL SELECT 'ci_subset_size', ci_subset_size, 0 FROM c)
    SELECT rule, value::BIGINT AS value, minimum::BIGINT AS minimum, value >= minimum AS passed FROM r""",
)
def eval_set_checks(spark, sf):
    i, text = F.col("item_id"), F.col("text")
    names = F.array(*[F.lit(c) for c in K.REQUIRED_CATEGORIES])
    questions = table(spark, sf, "benchmark").select(
        F.element_at(names, (i % 7 + 1).cast("int")).alias("category"),
        F.when(i % 2 == 0, text).alias("question_ar"),
        text.alias("question_en"),
        (i % 7 == 6).alias("is_refusal_expected"),
        (i % 3 == 0).alias("is_ci_subset"),
    )
    return Q.eval_set_checks(questions)


@query(
    "field_contracts",
    """WITH r AS (SELECT conv_id, turn, text AS question, CASE WHEN conv_id % 17 = 0 THEN 'tool' ELSE role END AS role,
        CASE conv_id % 4 WHEN 0 THEN 'auto' WHEN 1 THEN 'ar' WHEN 2 THEN 'en' ELSE 'fr' END AS language,
        (turn * 7 + conv_id) % 23 AS top_k, (conv_id % 9) - 1 AS prompt_tokens FROM conversations)
    SELECT conv_id, turn, 'question_length' AS rule FROM r WHERE NOT length(question) BETWEEN 1 AND 4000
    UNION ALL SELECT conv_id, turn, 'top_k_range' FROM r WHERE NOT top_k BETWEEN 1 AND 20
    UNION ALL SELECT conv_id, turn, 'language_value' FROM r WHERE language NOT IN ('auto','ar','en')
    UNION ALL SELECT conv_id, turn, 'role_value' FROM r WHERE role NOT IN ('system','user','assistant')
    UNION ALL SELECT conv_id, turn, 'prompt_tokens_sign' FROM r WHERE prompt_tokens < 0""",
)
def field_contracts(spark, sf):
    conv = F.col("conv_id")
    rows = table(spark, sf, "conversations").select(
        "conv_id",
        "turn",
        F.col("text").alias("question"),
        F.when(conv % 17 == 0, "tool").otherwise(F.col("role")).alias("role"),
        F.element_at(F.array(*[F.lit(v) for v in ("auto", "ar", "en", "fr")]), (conv % 4 + 1).cast("int")).alias("language"),
        ((F.col("turn") * 7 + conv) % 23).alias("top_k"),
        (conv % 9 - 1).alias("prompt_tokens"),
    )
    return Q.contract_violations(rows, ["conv_id", "turn"])
