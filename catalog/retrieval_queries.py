"""Index and retrieval queries."""

import uuid

from pyspark.sql import functions as F

from catalog import fixtures as X
from catalog import sqlparts as S
from catalog.registry import query, table
from lexmill.functions.vectors import hash_embedding, point_id
from lexmill.operators import chunks as C
from lexmill.operators import dense as D
from lexmill.operators import evaluate as E
from lexmill.operators import fusion as U
from lexmill.operators.ivf import VectorIndex
from lexmill.operators.lexical import LexicalIndex
from lexmill.operators.segments import SegmentedIndex
from lexmill.plans import hybrid as H
from lexmill.session import stage, staging_root


def doc_index(spark, sf):
    return LexicalIndex.build(X.doc_chunks(spark, sf))


NUM = """src AS (SELECT CAST(doc_id + 1 AS INTEGER) AS n, CAST(doc_id // 10 + 1 AS INTEGER) AS source_page,
  replace(text, chr(10), chr(10) || '(' || (doc_id % 9) || ') ') AS ar, text AS en FROM documents)"""


@query(
    "chunk_articles",
    f"""WITH {NUM}, {S.paragraphs('src', 'n', 'ar', 'arp')}, {S.paragraphs('src', 'n', 'en', 'enp')},
    j AS (SELECT s.n, source_page, length({S.strip('ar')}) <= 200 AS whole, {S.strip('ar')} AS ar, {S.strip('en')} AS en,
        arp.parts AS ap, enp.parts AS ep FROM src s JOIN arp ON s.n = arp.n JOIN enp ON s.n = enp.n),
    k AS (SELECT n, source_page, whole, CASE WHEN whole THEN [ar] ELSE ap END AS ap, CASE WHEN whole THEN [en] ELSE ep END AS ep FROM j),
    e AS (SELECT *, unnest(range(1, greatest(len(ap), len(ep)) + 1)) AS i FROM k)
    SELECT 'art_' || n || CASE WHEN whole THEN '' ELSE '_p' || i END AS chunk_id, n AS article_number,
      'Egyptian Civil Code, Article ' || n || CASE WHEN whole THEN '' ELSE ', Paragraph ' || i END AS citation,
      ap[least(i, len(ap))] AS text_ar, {S.norm('ap[least(i, len(ap))]')} AS text_ar_normalized, ep[least(i, len(ep))] AS text_en, source_page,
      CASE WHEN NOT whole THEN i::INTEGER END AS paragraph_number, greatest(len(ap), len(ep))::INTEGER AS total_paragraphs FROM e""",
)
def chunk_articles(spark, sf):
    d, text = F.col("doc_id"), F.col("text")
    marker = F.concat(F.lit("\n("), (d % 9).cast("string"), F.lit(") "))
    rows = table(spark, sf, "documents").select(
        (d + 1).cast("int").alias("article_number"),
        (F.floor(d / 10) + 1).cast("int").alias("source_page"),
        F.concat(F.lit("Egyptian Civil Code, Article "), d + 1).alias("citation"),
        F.replace(text, F.lit("\n"), marker).alias("text_ar"),
        text.alias("text_en"),
    )
    return C.chunk_articles(rows, max_chars=200)


@query(
    "hash_embedding",
    f"""WITH e AS (SELECT doc_id, {S.hash_embedding('text', 48)} AS e FROM documents),
    n AS (SELECT doc_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM e)
    SELECT doc_id, generate_subscripts(e, 1)::INTEGER AS pos, round(unnest(e) / norm, 6) AS value FROM n""",
)
def hash_embedding_query(spark, sf):
    vec = hash_embedding(F.col("text"), 48)
    return (
        table(spark, sf, "documents")
        .select("doc_id", F.posexplode(vec).alias("p", "v"))
        .select("doc_id", (F.col("p") + 1).alias("pos"), F.round("v", 6).alias("value"))
    )


@query(
    "model_embeddings",
    """WITH p AS (SELECT doc_id, 'passage: ' || text AS t FROM documents)
    SELECT doc_id, length(t) - length(replace(t, 'a', '')) AS n_a, length(t) - length(replace(t, 'e', '')) AS n_e,
      length(t) - length(replace(t, 'é', '')) AS n_accent, length(t) % 97 AS size_mod FROM p""",
)
def model_embeddings(spark, sf):
    """The model hook with a prefix and small batches; the model counts letters and is pickled with the query."""

    def letter_counts():
        import numpy as np

        def predict(texts):
            rows = [[t.count("a"), t.count("e"), t.count("é"), len(t) % 97] for t in texts]
            return np.array(rows, dtype=np.float32).reshape(len(texts), 4)

        return predict

    rows = C.embed_with_model(table(spark, sf, "documents").select("doc_id", "text"), letter_counts, prefix="passage: ", batch_size=32, text=F.col("text"))
    names = ("n_a", "n_e", "n_accent", "size_mod")
    return rows.select("doc_id", *[F.col("embedding")[i].cast("bigint").alias(n) for i, n in enumerate(names)])


@query("point_ids", "SELECT doc_id, CAST('0x' || substr(sha256('art_' || doc_id), 1, 15) AS BIGINT) AS point_id FROM documents")
def point_ids(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", point_id(F.concat(F.lit("art_"), F.col("doc_id"))).alias("point_id")
    )


@query(
    "upsert_latest",
    """SELECT user_id AS point_id, max(event_id) AS version, arg_max(value, event_id) AS value FROM events GROUP BY user_id""",
)
def upsert_latest(spark, sf):
    rows = table(spark, sf, "events").select(
        F.col("user_id").alias("point_id"), F.col("event_id").alias("version"), "value"
    )
    return C.latest_by_id(rows)


@query(
    "vector_manifest",
    """SELECT 'model-' || (label % 2) AS model_id, 64 AS dim, 'c' || (label % 3) AS corpus_hash, count(*) AS points,
    count_if(len(embedding) <> 64)::BIGINT AS bad_dimension FROM embeddings GROUP BY ALL""",
)
def vector_manifest(spark, sf):
    label = F.col("label")
    return C.manifest(
        table(spark, sf, "embeddings").select(
            F.concat(F.lit("model-"), label % 2).alias("model_id"), F.lit(64).alias("dim"),
            F.concat(F.lit("c"), label % 3).alias("corpus_hash"), "embedding",
        )
    )


BM25_DOCS = f"WITH {S.DOC_CHUNKS}, {S.bm25(5)}"


@query(
    "bm25_term_stats",
    f"WITH {S.DOC_CHUNKS}, {S.bm25(5).split('qtok AS')[0].rstrip().rstrip(',')} SELECT term, df, round(idf, 6) AS idf FROM idf",
)
def bm25_term_stats(spark, sf):
    return doc_index(spark, sf).terms().select("term", "df", F.round("idf", 6).alias("idf"))


@query(
    "bm25_corpus_stats",
    f"""WITH {S.DOC_CHUNKS}, {S.bm25(5)}
    SELECT n::BIGINT AS n_chunks, (SELECT sum(tf) FROM tf)::BIGINT AS n_tokens, round(avgdl, 6) AS avgdl FROM st""",
)
def bm25_corpus_stats(spark, sf):
    return doc_index(spark, sf).corpus().withColumn("avgdl", F.round("avgdl", 6))


@query(
    "bm25_topk",
    f"{BM25_DOCS} SELECT query_id, rank::INTEGER AS rank, chunk_id, raw, round(score, 6) AS score FROM bm25",
)
def bm25_topk(spark, sf):
    hits = doc_index(spark, sf).search(X.doc_questions(spark, sf), limit=5)
    return hits.select("query_id", "rank", "chunk_id", "raw", F.round("score", 6).alias("score"))


def _amended(spark, sf, path):
    """An index of stale texts and surplus documents that four writes bring to the documents as they are."""
    docs = X.doc_chunks(spark, sf)
    n = F.col("article_number")
    stale = docs.withColumn("text_ar_normalized", F.when(n % 4 == 0, F.col("text_ar")).otherwise(F.concat(F.lit("stale words "), F.reverse("text_ar"))))
    surplus = docs.filter(n % 5 == 0).withColumn("chunk_id", F.concat("chunk_id", F.lit("-gone")))
    index = SegmentedIndex.create(stale.filter(n % 7 != 3).unionByName(surplus), path)
    for k in (1, 2, 3):
        index.write(docs.filter((n % 4 == k) | (n % 7 == 3)), writer=f"round:{k}")
    return index.write(docs.filter(n < 20), writer="round:4", delete=surplus.select("chunk_id"))


@query("bm25_segments", f"{BM25_DOCS} SELECT query_id, rank::INTEGER AS rank, chunk_id, raw, round(score, 6) AS score FROM bm25")
def bm25_segments(spark, sf):
    """A base and four segments, with amended, added and removed chunks, searched as one index."""
    index = _amended(spark, sf, f"{staging_root(spark)}/segments-{uuid.uuid4().hex}")
    hits = index.view().search(X.doc_questions(spark, sf), limit=5)
    return hits.select("query_id", "rank", "chunk_id", "raw", F.round("score", 6).alias("score"))


@query(
    "bm25_segments_merged",
    f"""WITH {S.DOC_CHUNKS}, {S.bm25(5)}, s AS (SELECT count(*) AS n_terms, sum(df)::BIGINT AS postings, round(avg(idf), 6) AS mean_idf FROM idf)
    SELECT query_id, rank::INTEGER AS rank, chunk_id, raw, n_terms, postings, mean_idf FROM bm25, s""",
)
def bm25_segments_merged(spark, sf):
    """The same after the segments were merged, with the statistics of the merged index."""
    index = _amended(spark, sf, f"{staging_root(spark)}/segments-{uuid.uuid4().hex}").merge(ratio=100).view()
    known = index.terms().agg(F.count("*").alias("n_terms"), F.sum("df").alias("postings"), F.round(F.avg("idf"), 6).alias("mean_idf"))
    hits = index.search(X.doc_questions(spark, sf), limit=5).select("query_id", "rank", "chunk_id", "raw")
    return hits.join(F.broadcast(known))


@query("bm25_pruned", f"{BM25_DOCS} SELECT query_id, rank::INTEGER AS rank, chunk_id, raw, round(score, 6) AS score FROM bm25")
def bm25_pruned(spark, sf):
    """The search that leaves out ranges of chunks which cannot reach a question's best."""
    index = LexicalIndex.build(X.doc_chunks(spark, sf), buckets=32, pruned=True)
    hits = index.search(X.doc_questions(spark, sf), limit=5)
    return hits.select("query_id", "rank", "chunk_id", "raw", F.round("score", 6).alias("score"))


@query(
    "multi_corpus_bm25",
    f"""WITH {S.DOC_CHUNKS.replace("doc_id::VARCHAR AS chunk_id, doc_id::INTEGER AS article_number", "'c' || (doc_id % 2) || ':art_' || (doc_id // 2) AS chunk_id, (doc_id // 2)::INTEGER AS article_number")},
    {S.bm25(5)} SELECT query_id, rank::INTEGER AS rank, chunk_id, raw FROM bm25""",
)
def multi_corpus_bm25(spark, sf):
    """Two corpora with the same article numbers in one index."""
    d = F.col("article_number")
    number = F.floor(d / 2).cast("int")
    chunks = X.doc_chunks(spark, sf).withColumn("chunk_id", F.concat(F.lit("c"), d % 2, F.lit(":art_"), number))
    chunks = chunks.withColumn("article_number", number)
    return LexicalIndex.build(chunks).search(X.doc_questions(spark, sf), limit=5).select("query_id", "rank", "chunk_id", "raw")


@query(
    "bm25_filtered",
    f"""WITH {S.DOC_CHUNKS.replace("text AS ctext FROM documents", "text AS ctext, source AS book, lang AS chapter, coalesce(quality = 0, false) AS is_repealed FROM documents LEFT JOIN labels USING (doc_id)")},
    {S.bm25(5, "WHERE NOT is_repealed AND (q.query_id % 3 <> 0 OR chapter = 'en')")}
    SELECT query_id, rank::INTEGER AS rank, chunk_id, raw FROM bm25""",
)
def bm25_filtered(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), "source", "lang", "doc_id")
    bad = table(spark, sf, "labels").select("doc_id", (F.col("quality") == 0).alias("bad"))
    facts = docs.join(bad, "doc_id", "left").select(
        "chunk_id", F.col("source").alias("book"), F.col("lang").alias("chapter"),
        F.coalesce("bad", F.lit(False)).alias("is_repealed"),
    )
    filters = F.struct(
        F.lit(None).cast("string").alias("book"),
        F.when(F.col("query_id") % 3 == 0, "en").alias("chapter"),
        F.lit(None).cast("string").alias("section"),
        F.lit(True).alias("exclude_repealed"),
        F.lit(None).cast("array<int>").alias("article_numbers"),
    )
    index = LexicalIndex.build(X.doc_chunks(spark, sf).join(facts, "chunk_id"))
    hits = index.search(X.doc_questions(spark, sf).withColumn("filters", filters), limit=5)
    return hits.select("query_id", "rank", "chunk_id", "raw")


DENSE = """WITH c AS (SELECT label, i, avg(x) AS x FROM (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY 1, 2),
    q AS (SELECT label::BIGINT AS query_id, list(x ORDER BY i) AS e FROM c GROUP BY 1),
    s AS (SELECT query_id, vec_id::VARCHAR AS chunk_id, vec_id::INTEGER AS article_number, round(list_cosine_similarity(embedding::DOUBLE[], e), 6) AS score FROM embeddings, q),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, article_number) AS rank FROM s)
    SELECT query_id, rank::INTEGER AS rank, chunk_id, score FROM r WHERE rank <= 10"""


def _label_means(spark, sf):
    from lexmill.operators.monitor import mean_vector

    emb = table(spark, sf, "embeddings")
    queries = mean_vector(emb, ["label"]).select(F.col("label").cast("bigint").alias("query_id"), F.col("mean").alias("embedding"))
    return queries, emb.select(F.col("vec_id").cast("string").alias("chunk_id"), F.col("vec_id").cast("int").alias("article_number"), "embedding")


@query("dense_topk", DENSE)
def dense_topk(spark, sf):
    """Nearest vectors to each label's mean vector."""
    queries, vectors = _label_means(spark, sf)
    return D.dense_topk(vectors, queries, limit=10).select("query_id", "rank", "chunk_id", "score")


@query("dense_ivf_topk", DENSE)
def dense_ivf_topk(spark, sf):
    """The same through the inverted file with every cell probed, half of the vectors added after the fit."""
    queries, vectors = _label_means(spark, sf)
    index = VectorIndex.build(vectors.filter("article_number % 2 = 0"), cell_rows=200).add(vectors.filter("article_number % 2 <> 0"), cell_rows=200)
    return index.search(queries, limit=10, probes=index.cells.count()).select("query_id", "rank", "chunk_id", "score")


HYBRID = f"WITH {S.HYBRID_BASE}, {S.hybrid(5, 20)}"


def stored_chunks(spark, sf):
    """Chunks with vectors as a table, the way an ingest leaves them."""
    return stage(C.embed_by_hash(X.article_chunks(spark, sf), X.DIM), "chunks")


@query(
    "exact_lookup",
    f"{HYBRID} SELECT query_id, rank::INTEGER AS rank, chunk_id FROM exact",
)
def exact_lookup(spark, sf):
    asked = H.with_filters(X.article_questions(spark, sf))
    return U.exact_lookup(asked, X.article_chunks(spark, sf)).select("query_id", "rank", "chunk_id")


def _branches(spark, sf):
    asked = H.with_filters(X.article_questions(spark, sf))
    chunks = stored_chunks(spark, sf)
    dense = D.dense_topk(chunks, asked, limit=20)
    return dense, LexicalIndex.build(chunks).search(asked, limit=20, synonyms=[])


@query(
    "dense_filtered",
    f"{HYBRID} SELECT query_id, rank::INTEGER AS rank, chunk_id, score FROM dense",
)
def dense_filtered(spark, sf):
    asked = H.with_filters(X.article_questions(spark, sf))
    found = D.dense_topk(C.embed_by_hash(X.article_chunks(spark, sf), X.DIM), asked, limit=20)
    return found.select("query_id", "rank", "chunk_id", "score")


@query(
    "rrf_fusion",
    f"{HYBRID} SELECT query_id, rank::INTEGER AS rank, chunk_id, score FROM fused",
)
def rrf_fusion(spark, sf):
    return U.fuse_ranks(*_branches(spark, sf)).select("query_id", "rank", "chunk_id", "score")


@query(
    "hybrid_retrieve",
    f"{HYBRID} SELECT query_id, rank::INTEGER AS rank, chunk_id, score, source FROM final",
)
def hybrid_retrieve(spark, sf):
    return hybrid_hits(spark, sf).select("query_id", "rank", "chunk_id", "score", "source")


def hybrid_hits(spark, sf, chunks=None, **options):
    chunks = stored_chunks(spark, sf) if chunks is None else chunks
    return H.retrieve(X.article_questions(spark, sf), LexicalIndex.build(chunks), chunks, synonyms=[], **options)


MIXED = HYBRID.replace("qvec q WHERE NOT q.exclude_repealed OR NOT v.is_repealed", "qvec q WHERE q.query_id % 3 <> 0 AND (NOT q.exclude_repealed OR NOT v.is_repealed)")


@query("hybrid_mixed_vectors", f"{MIXED} SELECT query_id, rank::INTEGER AS rank, chunk_id, score, source FROM final")
def hybrid_mixed_vectors(spark, sf):
    """Questions with vectors of another length are ranked by BM25 alone, those without get theirs inside the retrieval."""
    asked = X.article_questions(spark, sf)
    own = F.when(F.col("query_id") % 3 == 0, F.slice("embedding", 1, 16)).when(F.col("query_id") % 3 == 1, F.col("embedding"))
    chunks = stored_chunks(spark, sf)
    hits = H.retrieve(asked.withColumn("embedding", own), LexicalIndex.build(chunks), chunks, synonyms=[], embed_questions=X.with_hash_vector)
    return hits.select("query_id", "rank", "chunk_id", "score", "source")


@query(
    "hybrid_min_score",
    f"{HYBRID} SELECT query_id, rank::INTEGER AS rank, chunk_id, score, source FROM final WHERE score >= 0.0115 OR source = 'exact_lookup'",
)
def hybrid_min_score(spark, sf):
    return hybrid_hits(spark, sf, min_score=0.0115).select("query_id", "rank", "chunk_id", "score", "source")


RERANK = f"""{HYBRID},
ct AS (SELECT chunk_id, list(DISTINCT term) AS terms FROM tf GROUP BY 1),
qd AS (SELECT query_id, list(DISTINCT term) AS terms FROM qt GROUP BY 1),
pairs AS (SELECT m.*, count(*) OVER (PARTITION BY m.query_id) AS n,
    round(coalesce(len(list_intersect(qd.terms, ct.terms))::DOUBLE / len(qd.terms), 0), 6) AS ns
  FROM merged m LEFT JOIN ct USING (chunk_id) LEFT JOIN qd USING (query_id)),
rr AS (SELECT query_id, chunk_id, CASE WHEN n <= 1 THEN score ELSE ns END AS score, CASE WHEN n <= 1 THEN source ELSE 'reranked' END AS source, rank AS r0 FROM pairs),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, r0) AS rank FROM rr)"""


@query(
    "rerank_overlap",
    f"{RERANK} SELECT query_id, rank::INTEGER AS rank, chunk_id, score, source FROM rk WHERE rank <= 5",
)
def rerank_overlap(spark, sf):
    chunks = stored_chunks(spark, sf)
    texts = chunks.select("chunk_id", F.col("text_ar_normalized").alias("text"))
    hits = hybrid_hits(spark, sf, chunks, scorer=U.overlap_scorer, texts=texts)
    return hits.select("query_id", "rank", "chunk_id", "score", "source")


@query(
    "bm25_quality",
    f"""{BM25_DOCS}, {S.TRUTH}, t AS (SELECT query_id, count(*) AS n FROM truth GROUP BY 1),
    h AS (SELECT b.query_id, count(*) AS got, min(CASE WHEN t.article_number IS NOT NULL THEN rank END) AS first,
        count(DISTINCT t.article_number) AS hits FROM bm25 b LEFT JOIN truth t ON t.query_id = b.query_id AND t.article_number = b.article_number GROUP BY 1),
    m AS (SELECT q.query_id, coalesce(n, 0) AS n, coalesce(got, 0) AS got, first, coalesce(hits, 0) AS hits
        FROM queries q LEFT JOIN t USING (query_id) LEFT JOIN h USING (query_id)),
    e AS (SELECT query_id, CASE WHEN n = 0 THEN (got = 0)::INT::DOUBLE ELSE (first IS NOT NULL)::INT::DOUBLE END AS hit_rate,
        CASE WHEN n = 0 THEN (got = 0)::INT::DOUBLE ELSE coalesce(1.0::DOUBLE / first, 0) END AS mrr,
        CASE WHEN n = 0 THEN 1.0::DOUBLE ELSE hits::DOUBLE / n END AS context_recall,
        CASE WHEN n = 0 THEN (got = 0)::INT::DOUBLE WHEN got = 0 THEN 0.0::DOUBLE ELSE hits::DOUBLE / got END AS context_precision FROM m)
    SELECT count(*) AS questions, round(avg(hit_rate), 6) AS hit_rate, round(avg(mrr), 6) AS mrr,
      round(avg(context_recall), 6) AS context_recall, round(avg(context_precision), 6) AS context_precision FROM e""",
)
def bm25_quality(spark, sf):
    """Flagship: top-5 BM25 documents per question, scored against the true ones."""
    questions = X.doc_questions(spark, sf)
    hits = doc_index(spark, sf).search(questions, limit=5)
    per = E.retrieval_metrics(questions, hits, X.truth(spark, sf))
    return per.agg(
        F.count("*").alias("questions"),
        *[F.round(F.avg(c), 6).alias(c) for c in ("hit_rate", "mrr", "context_recall", "context_precision")],
    )


GRID = [(d, w, k, m, r) for d, w in ((0.7, 0.3), (0.2, 0.8)) for k in (3, 8) for m, r in ((0.0, False), (0.0115, False), (0.0, True))]


def _grid_sql() -> str:
    """Each cell searched and ranked on its own: the branches are those of the hybrid search, the rest is said again per cell."""
    base = S.hybrid(5, 24).split("fused0 AS")[0].rstrip().rstrip(",")
    exact = S.hybrid(5, 24)[S.hybrid(5, 24).index("exact AS (") :].split("allc AS")[0].rstrip().rstrip(",")
    out = []
    for n, (d, w, k, least, again) in enumerate(GRID):
        depth = max(3 * k, 20)
        score = "CASE WHEN m > 1 THEN ns ELSE score END" if again else "score"
        order = f"CASE WHEN m > 1 THEN {score} ELSE 0 END DESC, place" if again else "place"
        keep = f"(score >= {least} OR tier = 0)" if least else "true"
        out.append(f"""SELECT {n} AS ordinal, query_id, article_number, chunk_id, rank FROM (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {order}) AS rank FROM (
              SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tier, erank, score DESC, dr NULLS LAST, br NULLS LAST) AS place, count(*) OVER (PARTITION BY query_id) AS m FROM (
                SELECT query_id, chunk_id, any_value(article_number) AS article_number, min(CASE WHEN kind = 'e' THEN 0 ELSE 1 END) AS tier, min(CASE WHEN kind = 'e' THEN rank END) AS erank,
                  min(CASE WHEN kind = 'd' THEN rank END) AS dr, min(CASE WHEN kind = 'b' THEN rank END) AS br,
                  CASE WHEN min(CASE WHEN kind = 'e' THEN 0 ELSE 1 END) = 0 THEN 1.0::DOUBLE
                    ELSE round(coalesce(sum(CASE kind WHEN 'd' THEN {d}::DOUBLE / (60 + rank) WHEN 'b' THEN {w}::DOUBLE / (60 + rank) END), 0), 9) END AS score
                FROM ranks WHERE kind = 'e' OR rank <= {depth} GROUP BY query_id, chunk_id) LEFT JOIN overlap USING (query_id, chunk_id))) WHERE rank <= {k} AND {keep}""")
    return f"""WITH {S.HYBRID_BASE}, {base}, {exact}, {S.TRUTH},
    ranks AS MATERIALIZED (SELECT query_id, chunk_id, article_number, rank, 'd' AS kind FROM dense UNION ALL SELECT query_id, chunk_id, article_number, rank, 'b' FROM bm25
      UNION ALL SELECT query_id, chunk_id, article_number, rank, 'e' FROM exact),
    ct AS (SELECT chunk_id, list(DISTINCT term) AS terms FROM tf GROUP BY 1), qd AS (SELECT query_id, list(DISTINCT term) AS terms FROM qt GROUP BY 1),
    overlap AS (SELECT r.query_id, r.chunk_id, round(coalesce(len(list_intersect(any_value(qd.terms), any_value(ct.terms)))::DOUBLE / len(any_value(qd.terms)), 0), 6) AS ns
      FROM ranks r LEFT JOIN ct USING (chunk_id) LEFT JOIN qd USING (query_id) GROUP BY ALL),
    got AS ({" UNION ALL ".join(out)}),
    t AS (SELECT query_id, count(*) AS n FROM truth GROUP BY 1),
    h AS (SELECT ordinal, g.query_id, count(*) AS got, min(CASE WHEN x.article_number IS NOT NULL THEN rank END) AS first, count(DISTINCT x.article_number) AS hits
      FROM got g LEFT JOIN truth x ON x.query_id = g.query_id AND x.article_number = g.article_number GROUP BY ALL),
    mm AS (SELECT o.ordinal, q.query_id, coalesce(n, 0) AS n, coalesce(got, 0) AS got, first, coalesce(hits, 0) AS hits
      FROM queries q CROSS JOIN (SELECT range::INTEGER AS ordinal FROM range({len(GRID)})) o LEFT JOIN t ON t.query_id = q.query_id LEFT JOIN h ON h.query_id = q.query_id AND h.ordinal = o.ordinal)
    SELECT ordinal, round(avg(CASE WHEN n = 0 THEN (got = 0)::INT::DOUBLE ELSE (first IS NOT NULL)::INT::DOUBLE END), 6) AS hit_rate,
      round(avg(CASE WHEN n = 0 THEN (got = 0)::INT::DOUBLE ELSE coalesce(1.0::DOUBLE / first, 0) END), 6) AS mrr,
      round(avg(CASE WHEN n = 0 THEN 1.0::DOUBLE ELSE hits::DOUBLE / n END), 6) AS context_recall,
      round(avg(CASE WHEN n = 0 THEN (got = 0)::INT::DOUBLE WHEN got = 0 THEN 0.0::DOUBLE ELSE hits::DOUBLE / got END), 6) AS context_precision FROM mm GROUP BY ordinal"""


@query("sweep_hybrid", _grid_sql())
def sweep_hybrid(spark, sf):
    """Weights, depths, least scores and re-scoring of a hybrid search, from one search of each branch."""
    from lexmill.plans.sweep import Cell, hybrid_sweep

    cells = [Cell(d, w, k, m, r) for d, w, k, m, r in GRID]
    runs = hybrid_sweep(X.article_questions(spark, sf), X.truth(spark, sf), {"article": stored_chunks(spark, sf)}, cells, synonyms=[])
    return runs.select("ordinal", *[F.round(c, 6).alias(c) for c in ("hit_rate", "mrr", "context_recall", "context_precision")])
