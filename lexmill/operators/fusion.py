"""Exact lookup, rank fusion, merging, reranking and the final cut."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill import constants as K
from lexmill.functions import text as X
from lexmill.operators.lexical import CHUNK_ORDER, SCORE_DIGITS
from lexmill.session import broadcast_if_small


def branch_depth(top_k: int | Column) -> int | Column:
    """Candidates taken from each branch: three times the answer size, at least twenty."""
    return max(3 * top_k, 20) if isinstance(top_k, int) else F.greatest(top_k * 3, F.lit(20))


def exact_lookup(queries: DataFrame, chunks: DataFrame, limit: int | None = None, most_pushed: int = 1_000) -> DataFrame:
    """Chunks of articles a question names, score 1, in article and paragraph order.

    ``limit`` keeps the first rows per query on the map side; it is exact when nothing reorders
    the candidates later. Up to ``most_pushed`` different numbers become a filter of the chunk scan, and the
    questions are broadcast after a check of their number.
    """
    named = queries.select("query_id", F.explode("article_numbers").alias("article_number"))
    found = chunks.select(*CHUNK_ORDER)
    numbers = named.select("article_number").distinct().limit(most_pushed + 1).collect()  # bounded by most_pushed
    if len(numbers) <= most_pushed:
        found = found.filter(F.col("article_number").isin([r.article_number for r in numbers]))
    hits = broadcast_if_small(named).join(found, "article_number")
    order = Window.partitionBy("query_id").orderBy(*CHUNK_ORDER)
    ranked = hits.withColumn("rank", F.row_number().over(order))
    if limit is not None:
        ranked = ranked.filter(F.col("rank") <= limit)
    return ranked.select("query_id", "rank", *CHUNK_ORDER, F.lit(1.0).alias("score"))


def fuse_ranks(
    dense: DataFrame | None,
    lexical: DataFrame | None,
    dense_weight: float = K.DENSE_WEIGHT,
    lexical_weight: float = K.BM25_WEIGHT,
    rrf_k: int = K.RRF_K,
) -> DataFrame:
    """Weighted reciprocal rank fusion of two ranked branches."""
    parts = []
    for branch, weight, column in ((dense, dense_weight, "dense_rank"), (lexical, lexical_weight, "bm25_rank")):
        if branch is None:
            continue
        other = "bm25_rank" if column == "dense_rank" else "dense_rank"
        parts.append(
            branch.select(
                "query_id", *CHUNK_ORDER,
                (F.lit(weight) / (F.col("rank") + rrf_k)).alias("part"),
                F.col("rank").alias(column), F.lit(None).cast("int").alias(other),
            )
        )
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    fused = both.groupBy("query_id", *CHUNK_ORDER).agg(
        F.round(F.sum("part"), 9).alias("score"),
        F.min("dense_rank").alias("dense_rank"),
        F.min("bm25_rank").alias("bm25_rank"),
    )
    order = Window.partitionBy("query_id").orderBy(
        F.desc("score"), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("bm25_rank")
    )
    return fused.withColumn("rank", F.row_number().over(order)).select("query_id", "rank", *CHUNK_ORDER, "score")


def merge_candidates(exact: DataFrame | None, fused: DataFrame) -> DataFrame:
    """Exact hits first, then fused ones; a chunk keeps its first place."""
    hybrid = fused.withColumns({"source": F.lit("hybrid"), "tier": F.lit(1)})
    if exact is not None:
        hybrid = exact.withColumns({"source": F.lit("exact_lookup"), "tier": F.lit(0)}).unionByName(hybrid)
    first = hybrid.groupBy("query_id", *CHUNK_ORDER).agg(
        F.min(F.struct("tier", "rank", "score", "source")).alias("m")
    )
    order = Window.partitionBy("query_id").orderBy("m.tier", "m.rank")
    return first.select(
        "query_id", F.row_number().over(order).alias("rank"), *CHUNK_ORDER,
        F.col("m.score").alias("score"), F.col("m.source").alias("source"),
    )


Scorer = Callable[[Column, Column], Column]


def overlap_scorer(question: Column, text: Column) -> Column:
    """Share of the question's distinct tokens that the text contains."""
    q, t = F.array_distinct(X.tokens(question)), F.array_distinct(X.tokens(text))
    return F.coalesce(F.size(F.array_intersect(q, t)) / F.nullif(F.size(q), F.lit(0)), F.lit(0.0))


def rerank(candidates: DataFrame, texts: DataFrame, queries: DataFrame, scorer: Scorer | None = None) -> DataFrame:
    """Re-score candidates with a user's function of (question, chunk text).

    No scorer passes the order through, and so does a query with a single candidate. ``texts`` has
    ``chunk_id`` and ``text``; ``scorer`` may be built-in expressions or a pandas UDF.
    """
    if scorer is None:
        return candidates
    pairs = candidates.join(queries.select("query_id", "question"), "query_id").join(
        texts.select("chunk_id", "text"), "chunk_id"
    )
    n = F.count("*").over(Window.partitionBy("query_id"))
    scored = pairs.withColumn("alone", n <= 1).withColumn(
        "new_score", F.round(scorer(F.col("question"), F.col("text")), SCORE_DIGITS)
    )
    scored = scored.withColumns(
        {
            "score": F.when(F.col("alone"), F.col("score")).otherwise(F.col("new_score")),
            "source": F.when(F.col("alone"), F.col("source")).otherwise("reranked"),
        }
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "rank")
    return scored.withColumn("rank", F.row_number().over(order)).select(*candidates.columns)


def final_cut(ranked: DataFrame, top_k: int, min_score: float = 0.0) -> DataFrame:
    """Best ``top_k`` rows; a positive minimum drops low scores but never exact hits."""
    cut = ranked.filter(F.col("rank") <= top_k)
    if min_score > 0:
        cut = cut.filter((F.col("score") >= min_score) | (F.col("source") == "exact_lookup"))
    return cut
