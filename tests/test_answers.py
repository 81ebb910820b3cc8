import pytest
from pyspark.sql import functions as F

from lexmill import constants as K
from lexmill.operators import answers as A
from lexmill.operators import chunks as C
from lexmill.operators.lexical import LexicalIndex
from lexmill.plans.answering import SMALL_TALK_REPLIES, answer_log
from lexmill.session import stage


@pytest.fixture(scope="module")
def chunks(articles):
    return stage(C.embed_by_hash(C.chunk_articles(articles, "article"), 16), "t-chunks")


@pytest.fixture(scope="module")
def hits(spark, chunks):
    ranked = spark.createDataFrame([(1, 1, "art_147", 147, 0.9, "hybrid")], "query_id int, rank int, chunk_id string, article_number int, score double, source string")
    asked = spark.createDataFrame([(1, "ما هو العقد"), (2, "nothing found")], "query_id int, question string")
    return A.gather(asked, ranked, chunks).cache()


def check(hits, answer, query=1):
    row = hits.filter(F.col("query_id") == query).select(A.grounding(F.lit(answer), F.col("hits")).alias("g"), A.citations(F.lit(answer), F.col("hits")).alias("c"))
    return row.first()


def test_grounding_rules(hits):
    good = check(hits, "العقد شريعة المتعاقدين ولا يجوز تعديله إلا باتفاق الطرفين [المادة 147].").g
    assert good.is_grounded and good.grounded_citations == [147]
    bad = check(hits, "نص آخر [المادة 999] و [المادة 147]").g
    assert not bad.is_grounded and bad.hallucinated_citations == [999] and "[999]" in bad.reason
    for refusal in (K.REFUSAL_AR, K.REFUSAL_EN):
        assert check(hits, refusal).g.reason == "Valid refusal"
    assert check(hits, "  ").g.confidence_score == 0.0
    assert check(hits, "some answer", 2).g.reason == "Answer provided without retrieved context"
    assert "low overlap" in check(hits, "totally different words everywhere").g.reason
    assert check(hits, "ab cd").g.reason == "No substantive tokens to verify"


def test_citations(hits):
    rows = {c.article_number: c for c in check(hits, "[المادة 147] و [المادة 999]").c}
    assert rows[147].is_grounded and rows[147].text_ar_snippet
    assert not rows[999].is_grounded and rows[999].source_page == 0 and rows[999].citation.endswith("Article 999")


def test_context_and_quote(hits):
    ar = F.lit(True)
    row = hits.filter("query_id = 1").select(
        A.format_context(F.col("hits"), ar).alias("ctx"), A.extractive_answer(F.col("hits"), ar).alias("q"),
        A.extractive_answer(F.col("hits"), F.lit(False)).alias("qe"), A.prompt_messages(F.col("question"), F.col("hits"), ar).alias("m"),
    ).first()
    assert row.ctx.startswith("--- [المادة 147 / Article 147] ---\nالمرجع: Egyptian Civil Code, Article 147\nالموضع: Obligations > Contracts\nالنص العربي:\n")
    assert row.q.startswith("وفقاً لأحكام [المادة 147]") and row.qe.startswith("According to [Article 147]")
    assert [m.role for m in row.m] == ["system", "user"] and "147" in row.m[1].content and "ما هو العقد" in row.m[1].content
    empty = hits.filter("query_id = 2").select(A.format_context(F.col("hits"), ar).alias("ctx"), A.extractive_answer(F.col("hits"), F.lit(False)).alias("q")).first()
    assert empty.ctx == K.EMPTY_CONTEXT and empty.q == K.REFUSAL_EN


def test_token_assembly(spark):
    rows = [("t", 2, "token", " b"), ("t", 1, "token", "a"), ("t", 3, "done", "{}"), ("u", 1, "token", "x")]
    got = {r.trace_id: r for r in A.assemble_tokens(spark.createDataFrame(rows, "trace_id string, seq int, event string, data string")).collect()}
    assert got["t"].answer == "a b" and got["t"].is_done and got["t"].n_tokens == 2 and not got["u"].is_done


def test_answer_log(spark, chunks):
    asked = spark.createDataFrame(
        [(1, "ما نص المادة 147؟"), (2, "hello friend"), (3, "Article 148 mail me a@b.com"), (4, "zzz qqq"), (5, "المادة 147 مرة")], "query_id int, question string"
    )
    written = spark.createDataFrame([(5, "invented [المادة 999]", 10, 5, 12.5)], "query_id int, answer string, prompt_tokens long, completion_tokens long, latency_ms double")
    log = {r.query_id: r for r in answer_log(asked, LexicalIndex.build(chunks), chunks, model_answers=written, chat_model_id="m").collect()}
    assert "[المادة 147]" in log[1].answer and log[1].grounding.is_grounded and log[1].total_tokens == 80
    assert log[2].answer == SMALL_TALK_REPLIES["greeting"] and log[2].hits == [] and log[2].total_tokens == 0
    assert log[3].pii_redacted and "a@b.com" not in log[3].question and log[3].citations[0].article_number == 148
    assert log[4].chat_model_id == "guardrail-fallback" and log[4].answer == K.REFUSAL_EN and log[4].citations == []
    assert log[5].answer == K.REFUSAL_AR and log[5].grounding.hallucinated_citations == [999] and log[5].total_tokens == 15
    assert len({r.trace_id for r in log.values()}) == 5
