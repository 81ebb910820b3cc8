"""Placed postings, ranges left out, and segments."""

import re

import pytest
from pyspark.sql import functions as F

from lexmill.operators import chunks as C
from lexmill.operators import lexical
from lexmill.session import stage
from lexmill.operators.lexical import LexicalIndex, postings
from lexmill.operators.segments import SegmentedIndex
from lexmill.plans import ingest as I

COLUMNS = "chunk_id string, article_number int, text_ar string, text_ar_normalized string"


def corpus(spark, texts):
    return spark.createDataFrame([(f"art_{i}", i, t, t) for i, t in texts.items()], COLUMNS)


def words_of(i):
    return " ".join(f"word{(i * 7 + k * k) % (5 + i % 40)}x" for k in range(6 + i % 9))


@pytest.fixture(scope="module")
def questions(spark):
    return spark.createDataFrame([(i, f"{words_of(i)} word3x rare{i}z") for i in range(12)], "query_id int, question string")


def hits(index, questions, **options):
    return sorted((r.query_id, r["rank"], r.chunk_id, r.raw, round(r.score, 6)) for r in index.search(questions, limit=5, **options).collect())


def test_one_exchange_between_postings_and_result(spark, questions):
    index = LexicalIndex.build(corpus(spark, {i: words_of(i) for i in range(300)}), buckets=4)
    found = index.search(questions, limit=5)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1 and plan.index("WindowGroupLimit") < plan.rindex("Exchange hashpartitioning")
    again = LexicalIndex.build(corpus(spark, {i: words_of(i) for i in range(300)}), path=None, buckets=7)
    assert hits(index, questions) == hits(again, questions)


def test_postings_are_written_where_their_text_was_placed(spark, tmp_path):
    index = LexicalIndex.build(corpus(spark, {i: words_of(i) for i in range(300)}), path=str(tmp_path / "i"), buckets=4)
    files = [f for f in (tmp_path / "i" / "postings").iterdir() if f.suffix == ".parquet"]
    assert len(files) == 4 and index.postings.filter("range <> pmod(hash(chunk_id), 4)").isEmpty()  # one shuffle, one file a bucket
    plan = postings(corpus(spark, {1: "a b"}), buckets=4)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("Exchange hashpartitioning", plan)) == 1


def test_a_stored_index_is_searched_alike(spark, questions, tmp_path):
    chunks = corpus(spark, {i: words_of(i) for i in range(120)})
    built = LexicalIndex.build(chunks, path=str(tmp_path / "i"), buckets=4, pruned=True)
    loaded = LexicalIndex.load(spark, str(tmp_path / "i"))
    assert hits(loaded, questions) == hits(built, questions) == hits(LexicalIndex.build(chunks), questions)
    plan = loaded.search(questions, limit=5)._jdf.queryExecution().executedPlan().toString()
    assert loaded.peaks is not None and "Bucketed: true" in plan


def test_ranges_that_cannot_reach_the_best_are_not_read(spark):
    texts = {i: "common filler text of no use" for i in range(400)} | {i: "rareterm deepterm common" for i in (11, 12, 13)}
    index = LexicalIndex.build(corpus(spark, texts), buckets=16, pruned=True)
    asked = spark.createDataFrame([(1, "rareterm deepterm common")], "query_id int, question string")
    seen = []
    once = index._pruned

    def watched(weights, gain, scored, cut, limit):
        return once(weights, gain, lambda pairs, ranges: (seen.append(sorted(ranges)), scored(pairs, ranges))[1], cut, limit)

    index._pruned = watched
    found = hits(index, asked)
    assert found == hits(LexicalIndex.build(corpus(spark, texts)), asked) and {x[2] for x in found} >= {"art_11", "art_12", "art_13"}
    one = [r for r in index.search(asked, limit=1).collect()]
    assert one[0].chunk_id in {"art_11", "art_12", "art_13"} and len(seen[-1]) < 4 and len(seen[-2]) == 1  # of 16 ranges


def test_segments_equal_a_rebuilt_index(spark, questions, tmp_path):
    texts = {i: words_of(i) for i in range(200)}
    index = SegmentedIndex.create(corpus(spark, {i: "old " + t for i, t in texts.items() if i % 3}), str(tmp_path / "s"), buckets=4)
    index.write(corpus(spark, {i: t for i, t in texts.items() if i % 3 == 1}), buckets=4)
    index.write(corpus(spark, {i: t for i, t in texts.items() if i % 3 != 1}), buckets=4)
    index.write(corpus(spark, {5: texts[5], 900: "surplus rare1z"}), buckets=4)
    index.write(corpus(spark, {}), delete=spark.createDataFrame([("art_900",), ("never",)], "chunk_id string"), buckets=4)
    want = hits(LexicalIndex.build(corpus(spark, texts)), questions)
    assert len(index.segments()) == 5 and hits(index.view(), questions) == want
    terms = {(r.term, r.df) for r in LexicalIndex.build(corpus(spark, texts)).term_table.collect()}
    assert {(r.term, r.df) for r in index.view().term_table.collect()} == terms
    index.merge(ratio=4, buckets=4)
    assert len(index.segments()) < 5 and hits(index.view(), questions) == want
    index.merge(ratio=1000, buckets=4)
    assert len(index.segments()) == 1 and hits(index.view(), questions) == want
    assert index.vacuum() > 4 and hits(SegmentedIndex(spark, str(tmp_path / "s")).view(), questions) == want
    assert index.view().documents().count() == 200 and {(r.term, r.df) for r in index.view().term_table.collect()} == terms


def test_merging_keeps_few_segments(spark, tmp_path):
    index = SegmentedIndex.create(corpus(spark, {i: words_of(i) for i in range(64)}), str(tmp_path / "s"), buckets=2)
    for k in range(6):
        index.write(corpus(spark, {100 + k: words_of(k)}), buckets=2).merge(buckets=2)
    sizes = [s.chunks for s in index.segments()]
    assert len(sizes) <= 3 and sum(sizes) == 70


def test_a_replayed_write_changes_nothing(spark, questions, tmp_path):
    index = SegmentedIndex.create(corpus(spark, {i: words_of(i) for i in range(30)}), str(tmp_path / "s"), buckets=2)
    index.write(corpus(spark, {1: "amended once"}), writer="q:1", buckets=2)
    before = index.segments()
    assert index.write(corpus(spark, {1: "amended twice"}), writer="q:1", buckets=2).segments() == before
    assert len(index.write(corpus(spark, {1: "amended twice"}), writer="q:2", buckets=2).segments()) == len(before) + 1


def test_reindex_keeps_words_and_vectors_in_step(spark, articles, tmp_path):
    store, embed = str(tmp_path / "v"), I.hash_embedder(8)
    I.ingest(spark, articles, store, "hash", 8, embed, "base", buckets=2)
    index = SegmentedIndex.create(C.chunk_articles(articles), str(tmp_path / "s"), buckets=2)
    old = articles.filter("article_number = 148")
    changed = old.withColumns({"text_ar": F.lit("نص جديد تماما"), "text_en": F.lit("New.")})
    I.reindex(spark, changed, store, "hash", 8, embed, "base", buckets=2, replace_by_article=True, lexical=index, writer="s:1")

    def found(question):
        asked = spark.createDataFrame([(1, question)], "query_id int, question string")
        return {r.article_number for r in index.view().search(asked, limit=5).collect()}

    assert 148 in found("جديد تماما") and 148 not in found("تنفيذ العقد طبقا لما اشتمل عليه")
    vectors = C.read_vectors(spark, store, "hash", 8, "base")
    assert {r.chunk_id for r in vectors.collect()} == {r.chunk_id for r in index.view().documents().collect()}


def test_many_collections_keep_their_own_buckets(spark, tmp_path):
    path = str(tmp_path / "v")
    rows = spark.range(30).selectExpr("concat('m', id) AS model_id", "2 AS dim", "'c' AS corpus_hash", "id AS point_id", "CAST(id AS INT) AS article_number", "0L AS version", "array(1.0D, 2.0D) AS embedding")
    C.upsert_vectors(spark, path, rows.filter("point_id % 2 = 0"), buckets=2)
    C.upsert_vectors(spark, path, rows.withColumn("version", F.lit(1).cast("bigint")), buckets=5)
    stored = spark.read.parquet(path)
    assert stored.count() == 30 and {(r.buckets, r.version) for r in stored.collect()} == {(2, 1), (5, 1)}
    assert stored.filter("point_id % 2 = 0").select("buckets").distinct().first()[0] == 2


def test_a_bucket_is_bounded_by_the_size_of_the_input(spark, questions, tmp_path, monkeypatch):
    chunks = stage(corpus(spark, {i: words_of(i) for i in range(120)}), "chunks")
    want = hits(LexicalIndex.build(chunks, buckets=4), questions)
    monkeypatch.setattr(lexical, "BUCKET_BYTES", 300)
    index = LexicalIndex.build(chunks, path=str(tmp_path / "i"), buckets=4, pruned=True)
    stored = spark.read.parquet(str(tmp_path / "i" / "postings-layout")).first().buckets
    assert stored > 4 and stored % 4 == 0 and {r.range for r in index.peaks.select("range").collect()} == {0, 1, 2, 3}
    assert hits(index, questions) == hits(LexicalIndex.load(spark, str(tmp_path / "i")), questions) == want
