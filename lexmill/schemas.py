"""Explicit schemas of the tables the operators read and write."""

from pyspark.sql import types as T

ARTICLE = T.StructType(
    [
        T.StructField("article_number", T.IntegerType()),
        T.StructField("book", T.StringType()),
        T.StructField("part", T.StringType()),
        T.StructField("chapter", T.StringType()),
        T.StructField("section", T.StringType()),
        T.StructField("topic", T.StringType()),
        T.StructField("text_ar", T.StringType()),
        T.StructField("text_ar_raw", T.StringType()),
        T.StructField("text_en", T.StringType()),
        T.StructField("is_repealed", T.BooleanType()),
        T.StructField("source_page", T.IntegerType()),
        T.StructField("citation", T.StringType()),
        T.StructField("references", T.ArrayType(T.IntegerType())),
    ]
)

EVAL_QUESTION = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("question", T.StringType()),
        T.StructField("question_ar", T.StringType()),
        T.StructField("question_en", T.StringType()),
        T.StructField("ground_truth_articles", T.ArrayType(T.IntegerType())),
        T.StructField("category", T.StringType()),
        T.StructField("reference_answer", T.StringType()),
        T.StructField("is_refusal_expected", T.BooleanType()),
        T.StructField("is_ci_subset", T.BooleanType()),
    ]
)

LAYOUT_SPAN = T.StructType(
    [
        T.StructField("doc_id", T.StringType()),
        T.StructField("page", T.IntegerType()),
        T.StructField("block", T.IntegerType()),
        T.StructField("block_type", T.IntegerType()),
        T.StructField("line", T.IntegerType()),
        T.StructField("span", T.IntegerType()),
        T.StructField("line_x0", T.DoubleType()),
        T.StructField("line_y0", T.DoubleType()),
        T.StructField("line_x1", T.DoubleType()),
        T.StructField("x0", T.DoubleType()),
        T.StructField("y0", T.DoubleType()),
        T.StructField("page_width", T.DoubleType()),
        T.StructField("text", T.StringType()),
    ]
)

CHUNK_COLUMNS = [
    "chunk_id", "article_number", "book", "part", "chapter", "section", "topic", "citation",
    "text_ar", "text_ar_normalized", "text_en", "is_repealed", "references", "source_page",
    "paragraph_number", "total_paragraphs",
]
