"""Tables derived from the given ones, in the shapes the operators take."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.registry import table
from catalog.sqlparts import ARABIC, LATIN
from lexmill import constants as K
from lexmill.functions import text as T
from lexmill.functions.vectors import hash_embedding
from lexmill.operators import chunks as C
from lexmill.session import broadcast_if_small, stage


def arabize(text: Column) -> Column:
    """Letter-for-letter Arabic so that every normalization branch is met on real text."""
    return F.translate(F.lower(text), LATIN, ARABIC)


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One article per document: arabized text, English text with cross references."""
    d = F.col("doc_id")
    tail = F.concat(
        F.lit(" See Article "), (d * 7) % 1200 + 1, F.lit(" and Articles "),
        (d * 13) % 1149 + 1, F.lit(" and "), (d * 17) % 1149 + 1, F.lit("."),
    )
    base = table(spark, sf_dir, "documents").select(
        (d + 1).cast("int").alias("article_number"),
        F.col("source").alias("book"),
        F.col("lang").alias("part"),
        F.concat(F.lit("CH-"), d % 7).alias("chapter"),
        F.concat(F.lit("SEC-"), d % 3).alias("section"),
        F.when(d % 5 != 0, F.concat(F.lit("topic "), d % 11)).alias("topic"),
        arabize(F.col("text")).alias("text_ar_raw"),
        F.concat("text", tail).alias("text_en"),
        (F.floor(d / 10) + 1).cast("int").alias("source_page"),
    )
    n = F.col("article_number")
    return base.withColumns(
        {
            "text_ar": T.normalize(F.col("text_ar_raw")),
            "is_repealed": T.in_ranges(n, K.REPEALED_RANGES),
            "citation": F.concat(F.lit(K.CITATION_PREFIX), n),
            "references": T.references(F.col("text_ar_raw"), F.col("text_en"), n),
        }
    )


def faulty_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles with missing, repeated and broken rows."""
    n = F.col("article_number")
    rows = articles(spark, sf_dir).filter(n % 101 != 0)
    rows = rows.withColumn("copy", F.explode(F.when(n % 97 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return rows.drop("copy").withColumns(
        {
            "text_ar": F.when(n % 89 == 0, "  ").otherwise(F.col("text_ar")),
            "is_repealed": F.when(n % 83 == 0, ~F.col("is_repealed")).otherwise(F.col("is_repealed")),
            "citation": F.when(n % 79 == 0, F.concat(F.lit("Art. "), n)).otherwise(F.col("citation")),
            "source_page": F.when(n % 73 == 0, 0).otherwise(F.col("source_page")),
        }
    )


def doc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as retrievable units."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("chunk_id"),
        F.col("doc_id").cast("int").alias("article_number"),
        F.col("text").alias("text_ar"),
        F.col("text").alias("text_ar_normalized"),
    )


def doc_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold one of a question's sentences whole: an equi join on the sentence, before anything is made distinct.

    Stored, as the metrics read it more than once.
    """
    def sentences(df: DataFrame, key: str) -> DataFrame:
        parts = df.select(key, F.explode(F.split("question", "[.\n]+")).alias("line"))
        return parts.select(key, F.trim("line").alias("line")).filter("line <> ''")

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("d"), F.col("text").alias("question"))
    asked = broadcast_if_small(sentences(doc_questions(spark, sf_dir), "query_id").distinct())
    found = sentences(docs, "d").join(asked, "line").select("query_id", F.col("d").cast("int").alias("article_number"))
    return stage(found.distinct(), "truth")


DIM = 64


def article_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.chunk_articles(articles(spark, sf_dir), strategy="article")


def article_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arabized questions, some naming articles or asking for repealed ones, with hash vectors."""
    i = F.col("item_id")
    tail = (
        F.when(i % 4 == 0, F.concat(F.lit(" المادة "), i + 40))
        .when(i % 4 == 1, F.concat(F.lit(" Articles "), i + 380, F.lit(" and 12")))
        .when(i % 4 == 2, " was it repealed?")
        .otherwise("")
    )
    asked = table(spark, sf_dir, "benchmark").select(
        i.alias("query_id"), F.concat(arabize(F.col("text")), tail).alias("question")
    )
    return with_hash_vector(asked)


def with_hash_vector(questions: DataFrame) -> DataFrame:
    vector = F.transform(hash_embedding(F.col("question"), DIM), lambda v: v.cast("float"))
    return questions.withColumn("embedding", vector)
