"""Idempotent full ingest and incremental re-index of the stored vector table."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.operators import chunks as C
from lexmill.operators.segments import SegmentedIndex
from lexmill.sources.readers import table_fingerprint
from lexmill.session import stage, unstage

Embedder = Callable[[DataFrame], DataFrame]


def hash_embedder(dim: int, mode: str = "ar") -> Embedder:
    return lambda chunks: C.embed_by_hash(chunks, dim, mode)


def model_embedder(make_predict_fn, mode: str = "ar", prefix: str = "", batch_size: int = 64) -> Embedder:
    return lambda chunks: C.embed_with_model(chunks, make_predict_fn, mode, prefix, batch_size)


def ingest(
    spark: SparkSession,
    articles: DataFrame,
    store: str,
    model_id: str,
    dim: int,
    embed: Embedder,
    corpus_hash: str | None = None,
    force: bool = False,
    strategy: str = "article_paragraph",
    max_chars: int = 1200,
    buckets: int = 64,
) -> dict:
    """Chunk, embed and store a corpus unless this (model, dimension, corpus) already has rows.

    ``force`` replaces the stored collection, also rows of later re-indexing.
    """
    corpus_hash = corpus_hash or table_fingerprint(articles).first().fingerprint
    status = {
        "collection_name": C.collection_name(model_id, dim, corpus_hash), "model_id": model_id,
        "dimension": dim, "corpus_hash": corpus_hash,
    }
    if not force and C.table_exists(spark, store):
        known = C.read_vectors(spark, store, model_id, dim, corpus_hash).count()
        if known:
            return status | {"chunks_count": known, "status": "skipped_already_exists"}
    version = C.next_version(spark, store, model_id, dim, corpus_hash)
    rows = _vectors(C.chunk_articles(articles, strategy, max_chars), embed, model_id, dim, corpus_hash, version)
    C.upsert_vectors(spark, store, rows, buckets, replace_collection=force)
    return status | {
        "chunks_count": C.read_vectors(spark, store, model_id, dim, corpus_hash).count(),
        "articles_count": articles.count(),
        "status": "indexed_successfully",
    }


def reindex(
    spark: SparkSession,
    documents: DataFrame,
    store: str,
    model_id: str,
    dim: int,
    embed: Embedder,
    corpus_hash: str = "dynamic",
    version: int | None = None,
    replace_by_article: bool = False,
    strategy: str = "article_paragraph",
    max_chars: int = 1200,
    buckets: int = 64,
    writer: str | None = None,
    order_by: str | None = None,
    lexical: SegmentedIndex | None = None,
) -> dict:
    """Add new or amended articles to an existing collection; the last write wins.

    ``lexical`` is an index of the same corpus that gets the chunks as a segment, so words and vectors stay in step.

    Writes of a collection are numbered in the store. ``writer`` names a write that may be replayed: it keeps
    its number, so a replay changes nothing; without a name, the same documents sent twice in a row are one
    write. An explicit ``version`` takes the place of the number. Of several
    versions of an article in one call the one with the greatest ``order_by`` counts, ties by content.
    ``replace_by_article`` also removes paragraphs an amended article no longer has.
    """
    if version is None:
        named = writer is not None
        writer = writer or "content:" + table_fingerprint(documents).first().fingerprint
        version = C.next_version(spark, store, model_id, dim, corpus_hash, writer, anytime=named)
    if order_by is not None:
        keys = C.article_key(documents)
        rest = [c for c in documents.columns if c not in keys]
        newest = documents.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(order_by, F.xxhash64(*rest))).alias("_r"))
        documents = newest.select(*keys, "_r.*").select(*documents.columns)
    chunks = C.chunk_articles(documents, strategy, max_chars)
    rows = _vectors(chunks, embed, model_id, dim, corpus_hash, version).withColumn("writer", F.lit(writer).cast("string"))
    rows = stage(rows, "reindex")
    C.upsert_vectors(spark, store, rows, buckets, replace_by_article)
    if lexical is not None:
        lexical.write(rows, writer, replace_by_article).merge()
    counts = rows.agg(F.count_distinct("article_number").alias("a"), F.count("*").alias("c")).first()
    unstage(rows)
    return {
        "status": "reindexed_successfully", "collection_name": C.collection_name(model_id, dim, corpus_hash),
        "new_articles_count": counts.a, "new_chunks_count": counts.c,
    }


def _vectors(chunks: DataFrame, embed: Embedder, model_id: str, dim: int, corpus_hash: str, version: int) -> DataFrame:
    return embed(chunks).withColumns(
        {
            "model_id": F.lit(model_id), "dim": F.lit(dim), "corpus_hash": F.lit(corpus_hash),
            "version": F.lit(version).cast("bigint"),
        }
    )
