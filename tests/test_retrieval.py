import math
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lexmill import constants as K
from lexmill.operators import chunks as C
from lexmill.operators import dense as D
from lexmill.operators import fusion as U
from lexmill.operators.lexical import LexicalIndex
from lexmill.plans.hybrid import retrieve
from lexmill.session import stage
from tests.test_text import reference_tokens

DIM = 16


@pytest.fixture(scope="module")
def chunks(articles):
    return stage(C.embed_by_hash(C.chunk_articles(articles, "article"), DIM), "t-chunks")


@pytest.fixture(scope="module")
def index(chunks):
    return LexicalIndex.build(chunks)


def ask(spark, *texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "query_id int, question string")
    from lexmill.functions.vectors import hash_embedding

    return rows.withColumn("embedding", hash_embedding(F.col("question"), DIM))


def test_bm25_hits(spark, index):
    top = index.search(ask(spark, "شريعة المتعاقدين"), limit=5).orderBy("rank").collect()
    assert top[0].article_number == 147 and top[0].score == 1.0


def brute_bm25(docs, query):
    toks = [reference_tokens(d) for d in docs]
    n, avg = len(docs), sum(map(len, toks)) / len(docs)
    df = Counter(t for d in toks for t in set(d))
    idf = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df.items()}
    floor = K.BM25_EPSILON * sum(idf.values()) / len(idf)
    idf = {t: floor if v < 0 else v for t, v in idf.items()}
    out = []
    for d in toks:
        tf = Counter(d)
        out.append(sum(idf.get(q, 0) * tf[q] * 2.5 / (tf[q] + 1.5 * (0.25 + 0.75 * len(d) / avg)) for q in reference_tokens(query)))
    return out


def test_bm25_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    vocab = [f"w{i}" for i in range(30)]
    docs = [" ".join(rng.choice(vocab, size=rng.integers(0, 25))) for _ in range(40)] + [""]
    queries = [" ".join(rng.choice(vocab, size=6)) for _ in range(5)]
    frame = spark.createDataFrame([(f"c{i:02d}", i, d, d) for i, d in enumerate(docs)], "chunk_id string, article_number int, text_ar string, text_ar_normalized string")
    hits = LexicalIndex.build(frame).search(ask(spark, *queries), limit=7, synonyms=[]).collect()
    for q, text in enumerate(queries):
        scores = [round(s, 6) for s in brute_bm25(docs, text)]
        best = sorted((i for i, s in enumerate(scores) if s > 0), key=lambda i: (-scores[i], i))[:7]
        got = sorted((h for h in hits if h.query_id == q), key=lambda h: h["rank"])
        assert [h.article_number for h in got] == best
        assert [h.raw for h in got] == pytest.approx([scores[i] for i in best])


def test_dense_filters_and_order(spark, chunks):
    q = ask(spark, "anything").withColumn("embedding", F.lit([float(x) for x in chunks.filter("article_number = 147").first().embedding]))
    assert D.dense_topk(chunks, q, 5).orderBy("rank").first().article_number == 147
    assert D.dense_topk(chunks, q, 5).count() == 3  # no filter: repealed rows stay
    flt = F.struct(
        F.lit(None).cast("string").alias("book"), F.lit(None).cast("string").alias("chapter"), F.lit(None).cast("string").alias("section"),
        F.lit(True).alias("exclude_repealed"), F.lit(None).cast("array<int>").alias("article_numbers"),
    )
    assert {r.article_number for r in D.dense_topk(chunks, q.withColumn("filters", flt), 5).collect()} == {147, 148}


def test_dense_equals_brute_force_with_ties(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(30, 8))
    x = np.vstack([base, base, np.repeat(base[:1], 40, axis=0)])
    vecs = spark.createDataFrame(
        [(f"c{i:03d}", int(i), [float(v) for v in row]) for i, row in enumerate(x)], "chunk_id string, article_number int, embedding array<double>"
    ).repartition(5)
    qs = rng.normal(size=(6, 8))
    queries = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(qs)], "query_id int, embedding array<double>")
    for size in (128 << 20, 200):  # one pass, then several
        got = D.dense_topk(vecs, queries, 10, max_query_bytes=size).collect()
        sims = np.round((x / np.linalg.norm(x, axis=1, keepdims=True)) @ (qs / np.linalg.norm(qs, axis=1, keepdims=True)).T, 6)
        for j in range(6):
            want = sorted(range(len(x)), key=lambda i: (-sims[i, j], i))[:10]
            rows = sorted((r for r in got if r.query_id == j), key=lambda r: r["rank"])
            assert [r.article_number for r in rows] == want


def test_exact_hits_come_first(spark, index, chunks):
    q = ask(spark, "ما هو نص المادة 147؟", "Article 148 good faith performance", "هل المادة 54 ملغاة؟")
    rows = retrieve(q, index, chunks, top_k=3).filter("rank = 1").orderBy("query_id").collect()
    assert [(r.article_number, r.source) for r in rows] == [(147, "exact_lookup"), (148, "exact_lookup"), (54, "exact_lookup")]


def test_filter_override_keeps_exact_lookup(spark, index, chunks):
    only = F.struct(
        F.lit("General").alias("book"), F.lit(None).cast("string").alias("chapter"), F.lit(None).cast("string").alias("section"),
        F.lit(False).alias("exclude_repealed"), F.lit(None).cast("array<int>").alias("article_numbers"),
    )
    q = ask(spark, "العقد المادة 147").withColumn("filter_override", only)
    rows = retrieve(q, index, chunks, top_k=5).orderBy("rank").collect()
    assert rows[0].source == "exact_lookup" and {r.article_number for r in rows[1:]} <= {54}


def test_fusion_formula(spark):
    cols = "query_id int, rank int, article_number int, paragraph_number int, chunk_id string, score double"
    dense = spark.createDataFrame([(1, 1, 1, None, "a", 0.9), (1, 2, 2, None, "b", 0.8)], cols)
    lexical = spark.createDataFrame([(1, 1, 2, None, "b", 1.0), (1, 2, 3, None, "c", 0.5)], cols)
    rows = U.fuse_ranks(dense, lexical).orderBy("rank").collect()
    assert [r.chunk_id for r in rows] == ["b", "a", "c"]
    assert rows[0].score == pytest.approx(0.7 / 62 + 0.3 / 61, abs=1e-9)
    assert U.branch_depth(5) == 20 and U.branch_depth(10) == 30


def test_rerank_with_pandas_udf(spark, index, chunks):
    @F.pandas_udf("double")
    def length(q: pd.Series, t: pd.Series) -> pd.Series:
        return -t.str.len().astype("float64")

    texts = chunks.select("chunk_id", F.col("text_ar_normalized").alias("text"))
    rows = retrieve(ask(spark, "تنفيذ العقد"), index, chunks, top_k=2, scorer=length, texts=texts).orderBy("rank").collect()
    assert rows[0].source == "reranked" and rows[0].score >= rows[1].score
    one = retrieve(ask(spark, "تنفيذ العقد طبقا"), index, None, top_k=1, scorer=length, texts=texts, exact=False).collect()
    assert len(one) == 1


def test_plan_limits_before_shuffle(spark, index):
    plan = index.search(ask(spark, "العقد"), limit=5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2 and "BroadcastHashJoin" in plan and "CartesianProduct" not in plan


def test_dense_survives_any_batch(spark):
    rows = [("a", 1, [1.0, 0.0]), ("b", 2, [0.0, 1.0]), ("c", 3, None), ("d", 4, [1.0, None]), ("e", 5, [])]
    vecs = spark.createDataFrame(rows, "chunk_id string, article_number int, embedding array<double>")
    asked = spark.createDataFrame([(1, [1.0, 0.1]), (2, None), (3, [0.2, 1.0])], "query_id int, embedding array<double>")
    assert D.dense_topk(vecs, asked.filter("query_id > 9"), 5).collect() == []
    for size, cells in ((1 << 20, 1 << 20), (16, 1)):  # as many passes as leave some without a question; tiles of one score
        got = D.dense_topk(vecs, asked, 5, max_query_bytes=size, max_cells=cells).collect()
        assert sorted((r.query_id, r["rank"], r.chunk_id) for r in got) == [(1, 1, "a"), (1, 2, "b"), (3, 1, "b"), (3, 2, "a")]


def test_two_corpora_stay_apart(spark, articles):
    both = articles.withColumn("corpus_id", F.lit("x")).unionByName(articles.withColumn("corpus_id", F.lit("y")))
    chunks = C.embed_by_hash(C.chunk_articles(both, "article"), 8)
    assert chunks.select("chunk_id").distinct().count() == chunks.select("point_id").distinct().count() == 2 * articles.count()
    hits = LexicalIndex.build(chunks).search(ask(spark, "العقد"), limit=10).collect()
    assert {h.chunk_id.split(":")[0] for h in hits} == {"x", "y"} and len({h.chunk_id for h in hits}) == len(hits)
