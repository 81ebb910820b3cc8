"""Hybrid retrieval of a question table as one plan."""

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill import constants as K
from lexmill.functions import text as X
from lexmill.operators import fusion
from lexmill.operators.dense import dense_topk
from lexmill.operators.ivf import VectorIndex
from lexmill.operators.lexical import LexicalIndex
from lexmill.session import stage


def with_filters(queries: DataFrame) -> DataFrame:
    """Attach detected filters; a ``filter_override`` struct column replaces them where present.

    ``article_numbers`` keeps the numbers the question names, whatever the override says.
    """
    rows = queries.withColumn("filters", X.detect_filters(F.col("question")))
    rows = rows.withColumn("article_numbers", F.col("filters.article_numbers"))
    if "filter_override" in queries.columns:
        rows = rows.withColumn("filters", F.coalesce("filter_override", "filters"))
    return rows


def _embedded(queries: DataFrame, embed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Questions with an ``embedding``: their own, else that of ``embed``, which gets ``query_id, question``.

    Stored, as both branches and the filters read the questions and a model should see each of them once.
    """
    if "embedding" not in queries.columns:
        return stage(embed(queries), "asked")
    missing = queries.filter(F.col("embedding").isNull()).drop("embedding")
    return stage(queries.filter(F.col("embedding").isNotNull()).unionByName(embed(missing).select(*queries.columns)), "asked")


def retrieve(
    queries: DataFrame,
    index: LexicalIndex,
    vectors: DataFrame | VectorIndex | None = None,
    top_k: int = 5,
    dense_weight: float = K.DENSE_WEIGHT,
    lexical_weight: float = K.BM25_WEIGHT,
    rrf_k: int = K.RRF_K,
    exact: bool = True,
    scorer: fusion.Scorer | None = None,
    texts: DataFrame | None = None,
    min_score: float = 0.0,
    embed_questions: Callable[[DataFrame], DataFrame] | None = None,
    **lexical_options,
) -> DataFrame:
    """Ranked chunks per question: exact lookup, dense and BM25 branches, fused and merged.

    ``queries`` has ``query_id``, ``question`` and, for the dense branch, ``embedding``, which
    ``embed_questions`` adds to questions that have none. ``vectors`` is a table, searched exactly, or a
    ``VectorIndex``. Without ``vectors`` or query embeddings the BM25 branch alone is ranked, and so is a single
    question whose vector is missing, incomplete or of another length than the stored ones. The result carries
    ids and scores only; join the chunk table afterwards.
    """
    if vectors is not None and embed_questions is not None:
        queries = _embedded(queries, embed_questions)
    asked = with_filters(queries)
    depth = fusion.branch_depth(top_k)
    lexical = index.search(asked, limit=depth, **lexical_options)
    dense = None
    if vectors is not None and "embedding" in queries.columns:
        dense = vectors.search(asked, limit=depth) if isinstance(vectors, VectorIndex) else dense_topk(vectors, asked, limit=depth)
    fused = fusion.fuse_ranks(dense, lexical, dense_weight, lexical_weight, rrf_k)
    named = None
    if exact:
        named = fusion.exact_lookup(asked, index.documents(), limit=None if scorer else top_k)
    merged = fusion.merge_candidates(named, fused)
    ranked = fusion.rerank(merged, texts, asked, scorer)
    return fusion.final_cut(ranked, top_k, min_score)
