"""Context blocks, extractive answers, citations and grounding over retrieved hits.

``gather`` brings the hits of a question together once, at most the retrieval depth of them;
everything after that is a narrow column over the ``hits`` array.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill import constants as K
from lexmill.functions import text as X
from lexmill.functions.binding import let
from lexmill.session import broadcast_if_small, stage

HIT_FIELDS = [
    "rank", "chunk_id", "article_number", "score", "source", "citation", "book", "chapter", "source_page",
    "is_repealed", "text_ar", "text_ar_normalized", "text_en",
]


def gather(questions: DataFrame, retrieved: DataFrame, chunks: DataFrame) -> DataFrame:
    """Questions with their ranked hits and payload; no hits give an empty array.

    Ranked ids are few next to the chunk table: they are staged, checked and broadcast to its scan.
    """
    payload = chunks.select("chunk_id", *[c for c in HIT_FIELDS if c in chunks.columns and c not in ("chunk_id", "article_number")])
    ranked = broadcast_if_small(stage(retrieved.select("query_id", "rank", "chunk_id", "article_number", "score", "source"), "ranked"))
    full = payload.join(ranked, "chunk_id")
    hits = full.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(*HIT_FIELDS))).alias("hits"))
    empty = F.array().cast(hits.schema["hits"].dataType)
    return questions.join(hits, "query_id", "left").withColumn("hits", F.coalesce("hits", empty))


def format_context(hits: Column, arabic: Column) -> Column:
    """Context block of a prompt: one section per hit, preferred language first."""
    def section(h: Column) -> Column:
        n = h["article_number"].cast("string")
        ar = F.concat(F.lit("النص العربي:\n"), h["text_ar"], F.lit("\n\nEnglish Translation:\n"), h["text_en"])
        en = F.concat(F.lit("English Text:\n"), h["text_en"], F.lit("\n\nArabic Text:\n"), h["text_ar"])
        return F.concat(
            F.lit("--- [المادة "), n, F.lit(" / Article "), n, F.lit("]"),
            F.when(h["is_repealed"], K.REPEALED_MARK).otherwise(""), F.lit(" ---\nالمرجع: "), h["citation"],
            F.lit("\nالموضع: "), X.text_or_empty(h["book"]), F.lit(" > "), X.text_or_empty(h["chapter"]), F.lit("\n"),
            F.when(arabic, ar).otherwise(en),
        )

    return F.when(F.size(hits) == 0, K.EMPTY_CONTEXT).otherwise(F.array_join(F.transform(hits, section), "\n\n"))


def prompt_messages(question: Column, hits: Column, arabic: Column, system_prompt: str = K.SYSTEM_PROMPT) -> Column:
    """System and user message per question."""
    context = format_context(hits, arabic)

    def user(parts: tuple[str, str, str]) -> Column:
        return F.concat(F.lit(parts[0]), context, F.lit(parts[1]), question, F.lit(parts[2]))

    body = F.when(arabic, user(K.USER_PROMPT_AR)).otherwise(user(K.USER_PROMPT_EN))
    return F.array(
        F.struct(F.lit("system").alias("role"), F.lit(system_prompt).alias("content")),
        F.struct(F.lit("user").alias("role"), body.alias("content")),
    )


def refusal(arabic: Column) -> Column:
    return F.when(arabic, K.REFUSAL_AR).otherwise(K.REFUSAL_EN)


def first_per_article(hits: Column) -> Column:
    numbers = F.transform(hits, lambda h: h["article_number"])
    return F.filter(hits, lambda h, i: F.array_position(numbers, h["article_number"]) == i + 1)


def extractive_answer(hits: Column, arabic: Column, sections: int = 4) -> Column:
    """Quote the first chunk of up to four distinct articles; a refusal when there are none."""
    distinct = first_per_article(hits)
    first = F.get(distinct, F.lit(0))

    def single(form: tuple[str, str], field: str) -> Column:
        return F.concat(F.lit(form[0]), first["article_number"].cast("string"), F.lit(form[1]), first[field])

    def several(opening: str, label: str, field: str) -> Column:
        parts = F.transform(
            F.slice(distinct, 1, sections),
            lambda h: F.concat(F.lit(f"\n\n• **[{label} "), h["article_number"].cast("string"), F.lit("]**:\n"), h[field]),
        )
        return F.concat(F.lit(opening), F.array_join(parts, ""))

    return (
        F.when(F.size(hits) == 0, refusal(arabic))
        .when((F.size(distinct) == 1) & arabic, single(K.SINGLE_AR, "text_ar"))
        .when(F.size(distinct) == 1, single(K.SINGLE_EN, "text_en"))
        .when(arabic, several(K.MULTI_AR, "المادة", "text_ar"))
        .otherwise(several(K.MULTI_EN, "Article", "text_en"))
    )


def citations(answer: Column, hits: Column, prefix: str = K.CITATION_PREFIX) -> Column:
    """Cited numbers linked to the first retrieved chunk of that article, or marked ungrounded."""
    def snippet(text: Column) -> Column:
        return F.concat(F.substring(text, 1, 200), F.when(F.length(text) > 200, "...").otherwise(""))

    def link(n: Column, hit: Column) -> Column:
        found = hit.isNotNull()
        return F.struct(
            n.alias("article_number"),
            F.when(found, hit["citation"]).otherwise(F.concat(F.lit(prefix), n.cast("string"))).alias("citation"),
            F.when(found, snippet(hit["text_ar"])).otherwise("").alias("text_ar_snippet"),
            F.when(found, snippet(hit["text_en"])).otherwise("").alias("text_en_snippet"),
            F.when(found, hit["source_page"]).otherwise(0).alias("source_page"),
            found.alias("is_grounded"),
            F.coalesce(found & hit["is_repealed"], F.lit(False)).alias("is_repealed"),
        )

    def first_hit(n: Column) -> Column:
        return F.get(F.filter(hits, lambda h: h["article_number"] == n), F.lit(0))

    return F.transform(X.cited_numbers(answer), lambda n: let(first_hit(n), lambda hit: link(n, hit)))


def grounding(answer: Column, hits: Column, threshold: float = 0.25) -> Column:
    """Grounding verdict: first rule that applies decides."""
    clean = X.text_or_empty(answer)
    retrieved = F.transform(hits, lambda h: h["article_number"].cast("bigint"))
    words = F.filter(F.array_distinct(F.split(X.normalize(clean), " ")), lambda t: F.length(t) > 2)
    normalized = F.transform(
        hits,
        lambda h: X.normalize(F.when(X.text_or_empty(h["text_ar_normalized"]) == "", h["text_ar"]).otherwise(h["text_ar_normalized"])),
    )
    context = F.flatten(
        F.concat(
            F.transform(normalized, lambda t: F.split(t, " ")),
            F.transform(hits, lambda h: F.split(F.lower(h["text_en"]), f"[{K.WS}]+")),
        )
    )
    none = F.array().cast("array<bigint>")

    def verdict(ok: bool, score: Column | float, why: Column | str, bad: Column = none, good: Column = none) -> Column:
        return F.struct(
            F.lit(ok).alias("is_grounded"),
            bad.alias("hallucinated_citations"),
            good.alias("grounded_citations"),
            (F.lit(score) if isinstance(score, float) else score).alias("confidence_score"),
            (F.lit(why) if isinstance(why, str) else why).alias("reason"),
        )

    def by_overlap(cited: Column, backed: Column, overlap: Column) -> Column:
        low = F.concat(F.lit("Answer has low overlap ("), X.two_decimals(overlap), F.lit(") and lacks citations"))
        weak = (F.size(cited) == 0) & (overlap < threshold)
        return F.when(weak, verdict(False, overlap, low)).otherwise(
            verdict(True, overlap, "Grounded in retrieved context", good=backed)
        )

    def by_words(cited: Column, backed: Column, w: Column) -> Column:
        share = F.size(F.array_intersect(w, context)) / F.size(w)
        return F.when(F.size(w) == 0, verdict(True, 1.0, "No substantive tokens to verify", good=backed)).otherwise(
            let(share, lambda overlap: by_overlap(cited, backed, overlap))
        )

    def by_citations(cited: Column) -> Column:
        invented, backed = F.array_except(cited, retrieved), F.array_intersect(cited, retrieved)
        listed = F.concat(F.lit("Hallucinated citations not in retrieved context: ["), F.array_join(invented, ", "), F.lit("]"))
        return F.when(F.size(invented) > 0, verdict(False, 0.0, listed, invented, backed)).otherwise(
            let(words, lambda w: by_words(cited, backed, w))
        )

    return (
        F.when(F.length(X.strip(clean)) == 0, verdict(False, 0.0, "Empty answer produced"))
        .when(clean.contains(K.REFUSAL_AR) | clean.contains(K.REFUSAL_EN), verdict(True, 1.0, "Valid refusal"))
        .when(F.size(hits) == 0, verdict(False, 0.0, "Answer provided without retrieved context"))
        .otherwise(let(X.cited_numbers(clean), by_citations))
    )


def enforce(answer: Column, verdict: Column, arabic: Column) -> Column:
    """The answer, or the refusal in the question's language when it is not grounded."""
    return F.when(verdict["is_grounded"], answer).otherwise(refusal(arabic))


def assemble_tokens(events: DataFrame) -> DataFrame:
    """Full answers from token events ``(trace_id, seq, event, data)``; one row per trace."""
    token = F.when(F.col("event") == "token", F.struct("seq", "data"))
    return events.groupBy("trace_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(token)), lambda t: t["data"]), "").alias("answer"),
        F.count(token).alias("n_tokens"),
        (F.count_if(F.col("event") == "done") > 0).alias("is_done"),
    )
