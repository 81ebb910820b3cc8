"""Batch answering: screened questions in, one full log row per question out."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions import guards as G
from lexmill.functions import text as X
from lexmill.operators import answers as A
from lexmill.operators.lexical import LexicalIndex
from lexmill.plans.hybrid import retrieve
from lexmill.session import stage

# Neutral replies; pass your own per intent.
SMALL_TALK_REPLIES = {
    "greeting": "Hello! Ask a question about the articles of this corpus.",
    "thanks": "You are welcome. Is there anything else to look up?",
    "identity": "I answer from the articles of this corpus and cite them.",
}
OFFLINE_USAGE = (50, 30, 80)


def screen(questions: DataFrame, mask: bool = True, assistant_name: str | None = None) -> DataFrame:
    """Redacted question, whether anything was removed, small-talk intent and language."""
    text, found = G.redact(F.col("question"))
    mode = F.coalesce("language", F.lit("auto")) if "language" in questions.columns else F.lit("auto")
    rows = questions
    if mask:
        rows = rows.withColumns({"question": text, "pii_redacted": F.size(found) > 0})
    else:
        rows = rows.withColumn("pii_redacted", F.lit(False))
    return rows.withColumns(
        {"intent": G.small_talk(F.col("question"), assistant_name), "is_ar": X.is_arabic(F.col("question"), mode)}
    )


def answer_log(
    questions: DataFrame,
    index: LexicalIndex,
    chunks: DataFrame,
    vectors: DataFrame | None = None,
    model_answers: DataFrame | None = None,
    top_k: int = 5,
    mask: bool = True,
    check: bool = True,
    threshold: float = 0.25,
    replies: dict[str, str] = SMALL_TALK_REPLIES,
    chat_model_id: str = "extractive",
    embedding_model_id: str = "hash",
    **retrieve_options,
) -> DataFrame:
    """Screen, retrieve, answer, verify and cite a table of questions.

    ``model_answers`` holds ``(query_id, answer, prompt_tokens, completion_tokens, latency_ms)``
    written by any model; questions without a row there are answered by quotation. Small talk
    leaves before retrieval.
    """
    screened = stage(screen(questions, mask), "screened")
    asked = screened.filter("intent IS NULL")
    hits = retrieve(asked, index, vectors, top_k, **retrieve_options)
    rows = A.gather(asked, hits, chunks)
    quoted = A.extractive_answer(F.col("hits"), F.col("is_ar"))
    if model_answers is not None:
        rows = rows.join(model_answers.withColumnRenamed("answer", "model_answer"), "query_id", "left")
    else:
        kinds = {"model_answer": "string", "prompt_tokens": "bigint", "completion_tokens": "bigint", "latency_ms": "double"}
        rows = rows.withColumns({c: F.lit(None).cast(t) for c, t in kinds.items()})
    none, modelled = F.size("hits") == 0, F.col("model_answer").isNotNull()
    rows = rows.withColumn("raw_answer", F.when(none, A.refusal(F.col("is_ar"))).when(modelled, F.col("model_answer")).otherwise(quoted))
    if check:
        verdict = A.grounding(F.col("raw_answer"), F.col("hits"), threshold)
    else:
        verdict = _verdict("Unguarded")
    rows = rows.withColumn("grounding", F.when(none, _verdict("Refused due to empty retrieval context")).otherwise(verdict))
    rows = rows.withColumn("answer", F.when(none, F.col("raw_answer")).otherwise(A.enforce(F.col("raw_answer"), F.col("grounding"), F.col("is_ar"))))
    prompt, completion, _ = OFFLINE_USAGE
    used = {"prompt_tokens": prompt, "completion_tokens": completion}
    rows = rows.withColumns(
        {
            **{c: F.when(none, 0).when(modelled, F.coalesce(c, F.lit(0))).otherwise(n).cast("bigint") for c, n in used.items()},
            "chat_model_id": F.when(none, "guardrail-fallback").when(modelled, chat_model_id).otherwise("extractive"),
            "citations": F.when(none, A.citations(F.lit(""), F.col("hits"))).otherwise(A.citations(F.col("answer"), F.col("hits"))),
        }
    )
    reply = F.create_map(*[F.lit(v) for pair in replies.items() for v in pair])
    talk = screened.filter("intent IS NOT NULL").withColumns(
        {
            "answer": reply[F.col("intent")],
            "hits": F.array().cast(rows.schema["hits"].dataType),
            "citations": F.array().cast(rows.schema["citations"].dataType),
            "grounding": _verdict("Conversational intent"),
            "prompt_tokens": F.lit(0).cast("bigint"),
            "completion_tokens": F.lit(0).cast("bigint"),
            "latency_ms": F.lit(None).cast("double"),
            "chat_model_id": F.lit(chat_model_id),
        }
    )
    columns = [
        "query_id", "question", "answer", "citations", "hits", "grounding", "prompt_tokens", "completion_tokens",
        "latency_ms", "chat_model_id", "pii_redacted", "intent", "is_ar",
    ]
    return (
        rows.select(*columns)
        .unionByName(talk.select(*columns))
        .withColumns(
            {
                "total_tokens": F.col("prompt_tokens") + F.col("completion_tokens"),
                "embedding_model_id": F.lit(embedding_model_id),
                "trace_id": F.sha2(F.concat_ws(":", F.lit(chat_model_id), F.col("query_id")), 256),
            }
        )
    )


def _verdict(reason: str) -> Column:
    none = F.array().cast("array<bigint>")
    return F.struct(
        F.lit(True).alias("is_grounded"), none.alias("hallucinated_citations"), none.alias("grounded_citations"),
        F.lit(1.0).alias("confidence_score"), F.lit(reason).alias("reason"),
    )
