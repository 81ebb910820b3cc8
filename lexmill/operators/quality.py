"""Corpus and dataset checks. Each check returns rows; asserting is one bounded action."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill import constants as K
from lexmill.functions.text import in_ranges, strip

KEY = "article_number"


class CorpusValidationError(ValueError):
    """Raised when a corpus breaks a rule; carries the first messages and the total."""


def keys_of(articles: DataFrame) -> list[str]:
    """Article key: with ``corpus_id`` where the table holds several corpora."""
    return ["corpus_id", KEY] if "corpus_id" in articles.columns else [KEY]


def duplicate_keys(articles: DataFrame) -> DataFrame:
    return articles.groupBy(*keys_of(articles)).agg(F.count("*").alias("n")).filter("n > 1")


def missing_keys(articles: DataFrame, last: int = K.MAX_ARTICLE) -> DataFrame:
    """Numbers up to ``last`` that a corpus lacks; each corpus is expected to have all of them."""
    keys = keys_of(articles)
    if len(keys) == 1:
        expected = articles.sparkSession.range(1, last + 1).select(F.col("id").cast("int").alias(KEY))
    else:
        numbers = F.explode(F.sequence(F.lit(1), F.lit(last))).alias(KEY)
        expected = articles.select("corpus_id").distinct().select("corpus_id", numbers)
    return expected.join(articles.select(*keys).distinct(), keys, "left_anti")


def out_of_range_keys(articles: DataFrame, last: int = K.MAX_ARTICLE) -> DataFrame:
    return articles.filter(~F.col(KEY).between(1, last)).select(*keys_of(articles)).distinct()


def _broken(rules: list[tuple[str, Column, Column]]) -> Column:
    """Array of ``(rule, message)`` for the rules whose condition holds."""
    rows = [
        F.when(broken, F.struct(F.lit(rule).alias("rule"), message.alias("message")))
        for rule, broken, message in rules
    ]
    return F.filter(F.array(*rows), lambda r: r.isNotNull())


def row_violations(
    articles: DataFrame,
    max_chars: int = K.MAX_TEXT_CHARS,
    citation_prefix: str = K.CITATION_PREFIX,
    repealed: list[tuple[int, int]] = K.REPEALED_RANGES,
) -> DataFrame:
    """One row per broken rule and article."""
    n, known = F.col(KEY), in_ranges(F.col(KEY), repealed)
    # The wording of the messages below, which must equal that of the checks followed.

    def say(*parts) -> Column:
        return F.concat(F.lit("Article "), n, F.lit(": "), *parts)

    rules = [
        (
            "citation",
            ~F.coalesce(F.col("citation").startswith(citation_prefix), F.lit(False)),
            say(F.lit("Malformed citation '"), F.coalesce("citation", F.lit("")), F.lit("'")),
        )
    ]
    for column in ("text_ar", "text_ar_raw", "text_en"):
        empty = F.length(strip(F.coalesce(column, F.lit("")))) == 0
        rules.append((f"{column}_empty", empty, say(F.lit(f"{column} is empty"))))
    for column in ("text_ar", "text_en"):
        size = F.length(column)
        rules.append(
            (
                f"{column}_length",
                size > max_chars,
                say(F.lit(f"{column} length ("), size, F.lit(f") exceeds threshold ({max_chars})")),
            )
        )
    flag = F.coalesce("is_repealed", F.lit(False))
    rules += [
        ("repeal_missing", known & ~flag, say(F.lit("Known repealed article is not flagged is_repealed=True"))),
        ("repeal_unknown", ~known & flag, say(F.lit("Article flagged as repealed but not in known repealed list"))),
        ("source_page", F.col("source_page") < 1, say(F.lit("Invalid source_page ("), F.col("source_page"), F.lit(")"))),
    ]
    return articles.select(*keys_of(articles), F.inline(_broken(rules)))


def violations(articles: DataFrame, last: int = K.MAX_ARTICLE, **options) -> DataFrame:
    """Every violation of a corpus as ``(rule, article_number, message)``; an empty corpus is one.

    A ``corpus_id`` column keys all rules and comes with the rows.
    """
    keys = keys_of(articles)

    def keyed(df: DataFrame, rule: str, text: str) -> DataFrame:
        return df.select(F.lit(rule).alias("rule"), *keys, F.concat(F.lit(text), F.col(KEY)).alias("message"))

    empty = (
        articles.agg(F.count("*").alias("n"))
        .filter("n = 0")
        .select(
            F.lit("empty").alias("rule"),
            *[F.lit(None).cast(articles.schema[k].dataType).alias(k) for k in keys],
            F.lit("Corpus is empty: 0 articles found.").alias("message"),
        )
    )
    return (
        empty.unionByName(keyed(duplicate_keys(articles), "duplicate", "Duplicate article number: "))
        .unionByName(keyed(missing_keys(articles, last), "missing", "Missing article number: "))
        .unionByName(keyed(out_of_range_keys(articles, last), "out_of_range", "Unexpected article number out of bounds: "))
        .unionByName(row_violations(articles, **options).select("rule", *keys, "message"))
    )


def assert_valid(articles: DataFrame, shown: int = 20, **options) -> None:
    """Raise with the first messages and the number of further ones."""
    found = violations(articles, **options).cache()
    try:
        total = found.count()
        if total:
            first = [r.message for r in found.orderBy(*keys_of(articles), "rule").limit(shown).collect()]
            more = f"\n ... and {total - shown} more" if total > shown else ""
            listed = "\n".join(f" - {m}" for m in first)
            raise CorpusValidationError(f"Corpus validation failed with {total} error(s):\n{listed}{more}")
    finally:
        found.unpersist()


def metadata(articles: DataFrame) -> DataFrame:
    """One row of counts and key bounds; zeros for an empty corpus."""
    return articles.agg(
        F.count("*").alias("total_articles"),
        F.count_if(~F.col("is_repealed")).alias("active_articles"),
        F.count_if(F.col("is_repealed")).alias("repealed_articles"),
        F.coalesce(F.min(KEY), F.lit(0)).alias("min_article_number"),
        F.coalesce(F.max(KEY), F.lit(0)).alias("max_article_number"),
    )


def statistics(articles: DataFrame) -> DataFrame:
    """Counts plus the sorted distinct non-empty books."""
    return articles.agg(
        F.count("*").alias("total_articles"),
        F.count_if(~F.col("is_repealed")).alias("active_articles"),
        F.count_if(F.col("is_repealed")).alias("repealed_articles"),
        F.array_sort(F.collect_set(F.when(F.col("book") != "", F.col("book")))).alias("books"),
    )


def spot_check(articles: DataFrame, sample_size: int = 20, seed: int = 42, portable: bool = False) -> DataFrame:
    """Reproducible sample with snippets; the order is a seeded hash of the key.

    ``portable`` orders by MD5, which other engines can repeat; the default hash is cheaper.
    """
    if portable:
        order = F.md5(F.concat(F.lit(f"{seed}:"), F.col(KEY)))
    else:
        order = F.xxhash64(F.lit(seed), F.col(KEY))

    def snippet(column: str) -> Column:
        flat = F.translate(F.substring(column, 1, 160), "\n", " ")
        return F.concat(flat, F.when(F.length(column) > 160, "...").otherwise(""))

    picked = articles.orderBy(order, KEY).limit(sample_size)
    filled = {c: F.when(F.coalesce(c, F.lit("")) == "", "N/A").otherwise(F.col(c)) for c in ("book", "part", "chapter", "section", "topic")}
    return picked.select(
        KEY,
        F.when(F.col("is_repealed"), "REPEALED").otherwise("ACTIVE").alias("status"),
        "citation",
        "source_page",
        *[c.alias(name) for name, c in filled.items()],
        F.when(F.size("references") > 0, F.array_join("references", ", ")).otherwise("None").alias("cross_references"),
        F.length("text_ar").alias("length_ar"),
        F.length("text_en").alias("length_en"),
        snippet("text_ar").alias("snippet_ar"),
        snippet("text_en").alias("snippet_en"),
    )


def lookup(requests: DataFrame, articles: DataFrame, last: int = K.MAX_ARTICLE) -> DataFrame:
    """Requested numbers with their article, or ``found = false`` when absent or out of range.

    With several corpora a request names its ``corpus_id`` too; without one it finds the number in each.
    """
    have = articles.withColumn("_have", F.lit(True))
    keys = [k for k in keys_of(articles) if k in requests.columns]
    return (
        requests.join(have, keys, "left")
        .withColumn("found", F.coalesce("_have", F.lit(False)) & F.col(KEY).between(1, last))
        .drop("_have")
    )


def eval_set_checks(questions: DataFrame, required: list[str] = K.REQUIRED_CATEGORIES) -> DataFrame:
    """Minimum-size rules of an evaluation set as ``(rule, value, minimum, passed)``."""
    twin = (F.coalesce("question_ar", F.lit("")) != "") & (F.coalesce("question_en", F.lit("")) != "")
    has = [F.coalesce(F.max((F.col("category") == c).cast("int")), F.lit(0)) for c in required]
    counts = questions.agg(
        F.count("*").alias("total_questions"),
        sum(has[1:], has[0]).cast("bigint").alias("required_categories"),
        F.count_if(twin).alias("bilingual_twins"),
        F.count_if(F.col("category") == "repealed").alias("repealed_questions"),
        F.count_if("is_refusal_expected").alias("refusal_questions"),
        F.count_if("is_ci_subset").alias("ci_subset_size"),
    )
    minimum = {
        "total_questions": 50, "required_categories": len(required), "bilingual_twins": 20,
        "repealed_questions": 5, "refusal_questions": 5, "ci_subset_size": 0,
    }
    rows = F.array(
        *[
            F.struct(
                F.lit(rule).alias("rule"), F.col(rule).alias("value"),
                F.lit(low).cast("bigint").alias("minimum"), (F.col(rule) >= low).alias("passed"),
            )
            for rule, low in minimum.items()
        ]
    )
    return counts.select(F.inline(rows))


# Contracts of logged fields, column -> (rule, SQL condition that must hold).
FIELD_CONTRACTS = {
    "question": ("question_length", "length(question) BETWEEN 1 AND 4000"),
    "top_k": ("top_k_range", "top_k BETWEEN 1 AND 20"),
    "language": ("language_value", "language IN ('auto', 'ar', 'en')"),
    "role": ("role_value", "role IN ('system', 'user', 'assistant')"),
    "prompt_tokens": ("prompt_tokens_sign", "prompt_tokens >= 0"),
    "completion_tokens": ("completion_tokens_sign", "completion_tokens >= 0"),
    "total_tokens": ("total_tokens_sign", "total_tokens >= 0"),
    "faithfulness": ("faithfulness_range", "faithfulness IS NULL OR faithfulness BETWEEN 0 AND 1"),
    "answer_relevancy": ("answer_relevancy_range", "answer_relevancy IS NULL OR answer_relevancy BETWEEN 0 AND 1"),
    "context_precision": ("context_precision_range", "context_precision BETWEEN 0 AND 1"),
    "context_recall": ("context_recall_range", "context_recall BETWEEN 0 AND 1"),
    "hit_rate": ("hit_rate_range", "hit_rate BETWEEN 0 AND 1"),
    "mrr": ("mrr_range", "mrr BETWEEN 0 AND 1"),
}


def contract_violations(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Broken field contracts of logged rows, for the contract columns the table has."""
    rules = [
        (rule, ~F.coalesce(F.expr(f"({condition})"), F.lit(False)), F.lit(condition))
        for column, (rule, condition) in FIELD_CONTRACTS.items()
        if column in rows.columns
    ]
    return rows.select(*keys, F.inline(_broken(rules))).drop("message")
