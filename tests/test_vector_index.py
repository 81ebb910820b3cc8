"""The inverted file against exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.operators import dense as D
from lexmill.operators import ivf as I
from lexmill.operators.lexical import LexicalIndex
from lexmill.plans.hybrid import retrieve

COLUMNS = "chunk_id string, article_number int, embedding array<double>"


def vectors_of(spark, x):
    return spark.createDataFrame([(f"c{i:05d}", i, [float(v) for v in row]) for i, row in enumerate(x)], COLUMNS).repartition(3)


def asked_of(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "query_id int, embedding array<double>")


def hits(df):
    return sorted((r.query_id, r["rank"], r.chunk_id, r.score) for r in df.collect())


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(9)
    centers = rng.normal(size=(40, 16))
    x = np.vstack([centers[rng.integers(0, 40, 3000)] + 0.4 * rng.normal(size=(3000, 16)), np.repeat(centers[:1], 900, axis=0)])
    return x, x[rng.integers(0, 3000, 25)] + 0.2 * rng.normal(size=(25, 16))


def test_all_cells_give_the_exact_result(spark, clustered):
    vecs, asked = vectors_of(spark, clustered[0]), asked_of(spark, clustered[1])
    index = I.VectorIndex.build(vecs, cells=30, cell_rows=200)
    assert index.cells.agg(F.sum("rows")).first()[0] == index.vectors.count() == 3900
    assert hits(index.search(asked, 10, probes=10_000)) == hits(D.dense_topk(vecs, asked, 10))
    assert hits(index.search(asked, 10, probes=10_000, max_query_bytes=500, max_cells=50)) == hits(D.dense_topk(vecs, asked, 10))


def test_default_probes_reach_the_recall_and_read_few_cells(spark, clustered):
    vecs, asked = vectors_of(spark, clustered[0]), asked_of(spark, clustered[1])
    index = I.VectorIndex.build(vecs, cells=100)
    want, got = ({(q, c) for q, _, c, _ in hits(df)} for df in (D.dense_topk(vecs, asked, 10), index.search(asked, 10)))
    assert len(got & want) >= 0.95 * len(want) and index.probes() <= 0.25 * index.cells.count()
    one = index.search(asked.limit(1), 10, probes=2)
    assert "PartitionFilters: [cell" in one._jdf.queryExecution().executedPlan().toString()
    assert one._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0


def test_over_full_cells_are_divided_and_copies_are_spread(spark, clustered):
    index = I.VectorIndex.build(vectors_of(spark, clustered[0]), cells=4, cell_rows=300)
    sizes = {r.cell: r.rows for r in index.cells.collect()}
    assert len(sizes) > 8 and sum(n > 300 for n in sizes.values()) == 1  # the copies of one vector cannot be divided
    hot = max(sizes, key=sizes.get)
    assert sizes[hot] >= 900 and len({r.f for r in index.vectors.filter(F.col("cell") == hot).select(F.input_file_name().alias("f")).collect()}) > 1


def test_added_vectors_are_found(spark, clustered):
    x, q = clustered
    index = I.VectorIndex.build(vectors_of(spark, x[:1500]), cells=20)
    grown = index.add(vectors_of(spark, x).filter("article_number >= 1500"))
    assert hits(grown.search(asked_of(spark, q), 7, probes=100)) == hits(D.dense_topk(vectors_of(spark, x), asked_of(spark, q), 7))
    assert I.VectorIndex.load(spark, grown.path).cells.agg(F.sum("rows")).first()[0] == len(x)


def test_odd_vectors(spark):
    rows = [("a", 1, [1.0, 0.0]), ("b", 2, [0.0, 1.0]), ("c", 3, None), ("d", 4, [1.0, None]), ("e", 5, []), ("f", 6, [1.0, 2.0, 3.0]), ("g", 7, [0.0, 0.0])]
    vecs = spark.createDataFrame(rows, COLUMNS)
    asked = spark.createDataFrame([(1, [1.0, 0.1]), (2, None), (3, [0.2, 1.0]), (4, [1.0])], "query_id int, embedding array<double>")
    index = I.VectorIndex.build(vecs)
    assert hits(index.search(asked, 2)) == hits(D.dense_topk(vecs, asked, 2))
    assert {(q, c) for q, _, c, _ in hits(index.search(asked, 2))} == {(1, "a"), (1, "b"), (3, "a"), (3, "b")}
    assert I.VectorIndex.build(vecs.limit(0)).search(asked, 2).collect() == [] and index.search(asked.limit(0), 2).collect() == []


def test_a_question_without_a_fitting_vector_is_ranked_by_words(spark, articles):
    from lexmill.operators import chunks as C

    chunks = C.embed_by_hash(C.chunk_articles(articles, "article"), 8)
    index = LexicalIndex.build(chunks)
    words = spark.createDataFrame([(1, "تنفيذ العقد"), (2, "تنفيذ العقد"), (3, "تنفيذ العقد")], "query_id int, question string")
    own = chunks.filter("article_number = 147").select("embedding").first().embedding
    vector = F.when(F.col("query_id") == 1, F.array(*[F.lit(v) for v in own])).when(F.col("query_id") == 2, F.array(F.lit(1.0), F.lit(2.0)))
    asked = words.withColumn("embedding", vector.cast("array<double>"))
    dense = D.dense_topk(chunks, asked, 3)
    assert {r.query_id for r in dense.collect()} == {1}
    plain = {(r["rank"], r.chunk_id) for r in retrieve(words.filter("query_id = 2"), index, None).collect()}
    found = retrieve(asked, index, chunks).collect()
    assert {(r["rank"], r.chunk_id) for r in found if r.query_id == 2} == plain == {(r["rank"], r.chunk_id) for r in found if r.query_id == 3}
    embed = lambda q: q.withColumn("embedding", F.array(*[F.lit(float(v)) for v in own]))
    filled = retrieve(asked, index, I.VectorIndex.build(chunks), embed_questions=embed).collect()
    assert [r.chunk_id for r in filled if r.query_id == 3] == [r.chunk_id for r in filled if r.query_id == 1] != []
    assert {r.query_id for r in retrieve(words, index, chunks, embed_questions=embed).collect()} == {1, 2, 3}


def test_a_cell_of_the_grid_is_a_retrieval(spark, articles):
    from lexmill.operators import chunks as C
    from lexmill.operators import fusion as U
    from lexmill.operators.evaluate import retrieval_metrics
    from lexmill.plans.sweep import Cell, hybrid_sweep

    chunks = C.embed_by_hash(C.chunk_articles(articles, "article"), 8)
    asked = spark.createDataFrame([(1, "تنفيذ العقد"), (2, "Article 148 good faith"), (3, "المادة 54"), (4, "شريعة المتعاقدين")], "query_id int, question string")
    asked = asked.withColumn("embedding", F.array(*[F.lit(0.1 * i) + F.col("query_id") % 3 for i in range(8)]))
    truth = spark.createDataFrame([(1, 148), (2, 148), (3, 54), (4, 147)], "query_id int, article_number int")
    cells = [Cell(top_k=1), Cell(0.1, 0.9, 2), Cell(top_k=2, min_score=0.016), Cell(top_k=2, rerank=True)]
    runs = hybrid_sweep(asked, truth, {"article": chunks}, cells).orderBy("ordinal").collect()
    index, texts = LexicalIndex.build(chunks), chunks.select("chunk_id", F.col("text_ar_normalized").alias("text"))
    for run, c in zip(runs, cells, strict=True):
        scorer = U.overlap_scorer if c.rerank else None
        hits = retrieve(asked, index, chunks, c.top_k, c.dense_weight, c.lexical_weight, min_score=c.min_score, scorer=scorer, texts=texts)
        row = retrieval_metrics(asked, hits, truth).agg(*[F.avg(m) for m in ("hit_rate", "mrr", "context_recall", "context_precision")]).first()
        assert [round(x, 9) for x in row] == [round(run[m], 9) for m in ("hit_rate", "mrr", "context_recall", "context_precision")]
