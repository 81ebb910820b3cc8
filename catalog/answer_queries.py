"""Answer post-processing queries over hybrid retrieval results."""

from pyspark.sql import functions as F

from catalog import fixtures as X
from catalog import sqlparts as S
from catalog.registry import query, table
from catalog.retrieval_queries import HYBRID, hybrid_hits, stored_chunks
from lexmill import constants as K
from lexmill.functions import text as T
from lexmill.operators import answers as A
from lexmill.operators.lexical import LexicalIndex
from lexmill.plans import answering as P

L = S.lit
GATHERED = f"""{HYBRID},
hits AS (SELECT f.query_id, f.rank, f.chunk_id, c.article_number, c.citation, c.book, c.chapter, c.source_page, c.is_repealed, c.text_ar, c.text_en
  FROM final f JOIN chunks c USING (chunk_id)),
asked AS (SELECT query_id, question, {S.is_arabic('question')} AS is_ar FROM queries),
sections AS (SELECT h.*, a.is_ar, '--- [المادة ' || article_number || ' / Article ' || article_number || ']' || CASE WHEN is_repealed THEN {L(K.REPEALED_MARK)} ELSE '' END
    || ' ---' || chr(10) || 'المرجع: ' || citation || chr(10) || 'الموضع: ' || coalesce(book, '') || ' > ' || coalesce(chapter, '') || chr(10)
    || CASE WHEN is_ar THEN 'النص العربي:' || chr(10) || text_ar || chr(10) || chr(10) || 'English Translation:' || chr(10) || text_en
       ELSE 'English Text:' || chr(10) || text_en || chr(10) || chr(10) || 'Arabic Text:' || chr(10) || text_ar END AS section
  FROM hits h JOIN asked a USING (query_id)),
context AS (SELECT a.query_id, a.question, a.is_ar, coalesce(string_agg(section, chr(10) || chr(10) ORDER BY rank), {L(K.EMPTY_CONTEXT)}) AS context
  FROM asked a LEFT JOIN sections s USING (query_id) GROUP BY ALL),
one AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS pos FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id, article_number ORDER BY rank) AS k FROM hits) WHERE k = 1),
quoted AS (SELECT a.query_id, a.question, a.is_ar, count(o.pos) AS n, min(CASE WHEN pos = 1 THEN o.article_number END) AS n0,
    min(CASE WHEN pos = 1 THEN o.text_ar END) AS ar0, min(CASE WHEN pos = 1 THEN o.text_en END) AS en0,
    string_agg(chr(10) || chr(10) || '• **[' || CASE WHEN is_ar THEN 'المادة ' ELSE 'Article ' END || o.article_number || ']**:' || chr(10)
      || CASE WHEN is_ar THEN o.text_ar ELSE o.text_en END, '' ORDER BY pos) FILTER (pos <= 4) AS parts
  FROM asked a LEFT JOIN one o USING (query_id) GROUP BY ALL),
extractive AS (SELECT query_id, question, is_ar, n0, en0, CASE WHEN n = 0 THEN CASE WHEN is_ar THEN {L(K.REFUSAL_AR)} ELSE {L(K.REFUSAL_EN)} END
    WHEN n = 1 AND is_ar THEN {L(K.SINGLE_AR[0])} || n0 || {L(K.SINGLE_AR[1])} || ar0
    WHEN n = 1 THEN {L(K.SINGLE_EN[0])} || n0 || {L(K.SINGLE_EN[1])} || en0
    WHEN is_ar THEN {L(K.MULTI_AR)} || parts ELSE {L(K.MULTI_EN)} || parts END AS quote FROM quoted),
answers AS (SELECT query_id, question, is_ar, CASE query_id % 6 WHEN 0 THEN quote
    WHEN 1 THEN 'see [Article ' || (n0 + CASE WHEN query_id % 4 = 1 THEN 99999995000 ELSE 5000 END) || '] and [المادة ' || n0 || ']' WHEN 2 THEN 'Nothing here matches: ' || question
    WHEN 3 THEN {L(K.REFUSAL_EN)} WHEN 4 THEN ' ' ELSE 'Per Article ' || n0 || ': ' || en0 END AS answer FROM extractive),
cited AS (SELECT query_id, answer, is_ar, {S.cited('answer')} AS nums FROM answers)"""


def gathered(spark, sf):
    questions = X.article_questions(spark, sf).select("query_id", "question")
    chunks = stored_chunks(spark, sf)
    rows = A.gather(questions, hybrid_hits(spark, sf, chunks), chunks)
    return rows.withColumn("is_ar", T.is_arabic(F.col("question")))


def answered(spark, sf):
    """Questions with hits and an answer of each kind: quoted, invented, unsupported, refused, empty, plain."""
    q, first = F.col("query_id") % 6, F.get("hits", F.lit(0))
    n0 = first["article_number"]
    answer = (
        F.when(q == 0, A.extractive_answer(F.col("hits"), F.col("is_ar")))
        .when(q == 1, F.concat(F.lit("see [Article "), n0 + F.when(F.col("query_id") % 4 == 1, F.lit(99_999_995_000)).otherwise(F.lit(5000)), F.lit("] and [المادة "), n0, F.lit("]")))
        .when(q == 2, F.concat(F.lit("Nothing here matches: "), F.col("question")))
        .when(q == 3, K.REFUSAL_EN)
        .when(q == 4, " ")
        .otherwise(F.concat(F.lit("Per Article "), n0, F.lit(": "), first["text_en"]))
    )
    return gathered(spark, sf).withColumn("answer", answer)


@query("context_blocks", f"{GATHERED} SELECT query_id, context FROM context")
def context_blocks(spark, sf):
    return gathered(spark, sf).select("query_id", A.format_context(F.col("hits"), F.col("is_ar")).alias("context"))


def _user(parts) -> str:
    return f"{L(parts[0])} || context || {L(parts[1])} || question || {L(parts[2])}"


@query(
    "prompt_messages",
    f"""{GATHERED} SELECT query_id, 'system' AS role, {L(K.SYSTEM_PROMPT)} AS content FROM context UNION ALL
    SELECT query_id, 'user', CASE WHEN is_ar THEN {_user(K.USER_PROMPT_AR)} ELSE {_user(K.USER_PROMPT_EN)} END FROM context""",
)
def prompt_messages(spark, sf):
    messages = A.prompt_messages(F.col("question"), F.col("hits"), F.col("is_ar"))
    return gathered(spark, sf).select("query_id", F.inline(messages))


@query("extractive_answers", f"{GATHERED} SELECT query_id, quote AS answer FROM extractive")
def extractive_answers(spark, sf):
    return gathered(spark, sf).select("query_id", A.extractive_answer(F.col("hits"), F.col("is_ar")).alias("answer"))


def _cut(c: str) -> str:
    return f"substr({c}, 1, 200) || CASE WHEN length({c}) > 200 THEN '...' ELSE '' END"


@query(
    "citation_links",
    f"""{GATHERED}, x AS (SELECT query_id, unnest(nums) AS article_number FROM cited)
    SELECT x.query_id, x.article_number, coalesce(o.citation, '{K.CITATION_PREFIX}' || x.article_number) AS citation,
      CASE WHEN o.query_id IS NULL THEN '' ELSE {_cut('o.text_ar')} END AS text_ar_snippet,
      CASE WHEN o.query_id IS NULL THEN '' ELSE {_cut('o.text_en')} END AS text_en_snippet,
      coalesce(o.source_page, 0) AS source_page, o.query_id IS NOT NULL AS is_grounded, coalesce(o.is_repealed, false) AS is_repealed
    FROM x LEFT JOIN one o ON o.query_id = x.query_id AND o.article_number = x.article_number""",
)
def citation_links(spark, sf):
    return answered(spark, sf).select("query_id", F.inline(A.citations(F.col("answer"), F.col("hits"))))


GROUNDED = f"""{GATHERED},
ret AS (SELECT query_id, list(DISTINCT article_number) AS ret FROM hits GROUP BY 1),
cw AS (SELECT query_id, list(DISTINCT w) AS ctx FROM (
    SELECT query_id, unnest(string_split({S.norm('text_ar')}, ' ')) AS w FROM hits
    UNION ALL SELECT query_id, unnest(regexp_split_to_array(lower(text_en), '[{K.WS}]+')) FROM hits) GROUP BY 1),
g0 AS (SELECT c.query_id, c.answer, c.is_ar, c.nums, coalesce(ret, []) AS ret, coalesce(ctx, []) AS ctx,
    list_filter(list_distinct(string_split({S.norm('c.answer')}, ' ')), lambda t: length(t) > 2) AS words FROM cited c LEFT JOIN ret USING (query_id) LEFT JOIN cw USING (query_id)),
g1 AS (SELECT *, list_sort(list_filter(nums, lambda n: NOT list_contains(ret, n))) AS bad, list_sort(list_filter(nums, lambda n: list_contains(ret, n))) AS good,
    CASE WHEN len(words) > 0 THEN len(list_intersect(words, ctx))::DOUBLE / len(words) END AS overlap FROM g0),
g2 AS (SELECT *, CASE WHEN {S.strip('answer')} = '' THEN 1 WHEN contains(answer, {L(K.REFUSAL_AR)}) OR contains(answer, {L(K.REFUSAL_EN)}) THEN 2
    WHEN len(ret) = 0 THEN 3 WHEN len(bad) > 0 THEN 4 WHEN len(words) = 0 THEN 5 WHEN len(nums) = 0 AND overlap < 0.25 THEN 6 ELSE 7 END AS rule FROM g1),
verdict AS (SELECT query_id, answer, is_ar, rule IN (2, 5, 7) AS is_grounded,
    CASE WHEN rule = 4 THEN array_to_string(bad, ',') ELSE '' END AS hallucinated,
    CASE WHEN rule IN (4, 5, 7) THEN array_to_string(good, ',') ELSE '' END AS grounded,
    CASE WHEN rule IN (2, 5) THEN 1.0::DOUBLE WHEN rule IN (6, 7) THEN round(overlap, 6) ELSE 0.0::DOUBLE END AS confidence,
    CASE rule WHEN 1 THEN 'Empty answer produced' WHEN 2 THEN 'Valid refusal' WHEN 3 THEN 'Answer provided without retrieved context'
      WHEN 4 THEN 'Hallucinated citations not in retrieved context: [' || array_to_string(bad, ', ') || ']' WHEN 5 THEN 'No substantive tokens to verify'
      WHEN 6 THEN 'Answer has low overlap (' || printf('%.2f', overlap) || ') and lacks citations' ELSE 'Grounded in retrieved context' END AS reason FROM g2)"""


@query("grounding_check", f"{GROUNDED} SELECT query_id, is_grounded, coalesce(hallucinated, '') AS hallucinated, coalesce(grounded, '') AS grounded, confidence, reason FROM verdict")
def grounding_check(spark, sf):
    g = F.col("g")
    return (
        answered(spark, sf)
        .select("query_id", A.grounding(F.col("answer"), F.col("hits")).alias("g"))
        .select(
            "query_id", g["is_grounded"].alias("is_grounded"),
            F.array_join(g["hallucinated_citations"], ",").alias("hallucinated"),
            F.array_join(g["grounded_citations"], ",").alias("grounded"),
            F.round(g["confidence_score"], 6).alias("confidence"), g["reason"].alias("reason"),
        )
    )


@query(
    "guardrail_enforced",
    f"{GROUNDED} SELECT query_id, CASE WHEN is_grounded THEN answer WHEN is_ar THEN {L(K.REFUSAL_AR)} ELSE {L(K.REFUSAL_EN)} END AS answer FROM verdict",
)
def guardrail_enforced(spark, sf):
    verdict = A.grounding(F.col("answer"), F.col("hits"))
    return answered(spark, sf).select("query_id", A.enforce(F.col("answer"), verdict, F.col("is_ar")).alias("answer"))


TOKENS = """tok AS (SELECT conv_id, turn, generate_subscripts(string_split(text, ' '), 1) AS seq, unnest(string_split(text, ' ')) AS w FROM conversations)"""


@query(
    "token_assembly",
    f"""WITH {TOKENS} SELECT conv_id || ':' || turn AS trace_id, string_agg(CASE WHEN seq = 1 THEN w ELSE ' ' || w END, '' ORDER BY seq) AS answer,
    count(*) AS n_tokens, conv_id % 10 <> 0 AS is_done FROM tok GROUP BY conv_id, turn""",
)
def token_assembly(spark, sf):
    return A.assemble_tokens(token_events(spark, sf))


def token_events(spark, sf):
    """Conversation turns as token streams; every tenth conversation never closes."""
    turns = table(spark, sf, "conversations").withColumn("trace_id", F.concat_ws(":", "conv_id", "turn"))
    words = turns.select("trace_id", F.posexplode(F.split("text", " ")).alias("p", "w"))
    tokens = words.select(
        "trace_id", (F.col("p") + 1).alias("seq"), F.lit("token").alias("event"),
        F.when(F.col("p") == 0, F.col("w")).otherwise(F.concat(F.lit(" "), F.col("w"))).alias("data"),
    )
    done = turns.filter(F.col("conv_id") % 10 != 0).select(
        "trace_id", F.lit(1 << 30).alias("seq"), F.lit("done").alias("event"), F.lit("{}").alias("data")
    )
    return tokens.unionByName(done)


@query(
    "answer_log",
    f"""{GATHERED.replace(S.HYBRID_BASE, S.hybrid_base(f"CASE WHEN item_id % 5 = 0 THEN 'hello ' || text ELSE {S.ASKED} END"))},
    ret AS (SELECT query_id, string_agg(chunk_id, ',' ORDER BY rank) AS chunks FROM hits GROUP BY 1)
    SELECT a.query_id, CASE WHEN starts_with(a.question, 'hello ') THEN {L(P.SMALL_TALK_REPLIES['greeting'])} ELSE quote END AS answer,
      CASE WHEN starts_with(a.question, 'hello ') THEN '' ELSE chunks END AS chunks,
      CASE WHEN starts_with(a.question, 'hello ') THEN 0 ELSE 80 END::BIGINT AS total_tokens, CASE WHEN starts_with(a.question, 'hello ') THEN 'greeting' END AS intent
    FROM extractive a LEFT JOIN ret USING (query_id)""",
)
def answer_log(spark, sf):
    i = F.col("query_id")
    asked = X.article_questions(spark, sf).select("query_id", "question")
    plain = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    asked = asked.join(plain, "query_id").withColumn(
        "question", F.when(i % 5 == 0, F.concat(F.lit("hello "), "text")).otherwise(F.col("question"))
    )
    asked = X.with_hash_vector(asked.drop("text"))
    chunks = stored_chunks(spark, sf)
    log = P.answer_log(asked, LexicalIndex.build(chunks), chunks, chunks, synonyms=[])
    return log.select(
        "query_id", "answer", F.array_join(F.transform("hits", lambda h: h["chunk_id"]), ",").alias("chunks"), "total_tokens", "intent"
    )


@query(
    "empty_retrieval",
    f"""WITH {S.HYBRID_BASE} SELECT query_id, query_id % 3 = 0 AS empty, CASE WHEN query_id % 3 = 0 THEN 'guardrail-fallback' ELSE 'extractive' END AS chat_model_id,
      CASE WHEN query_id % 3 = 0 THEN 0 ELSE 80 END::BIGINT AS total_tokens,
      CASE WHEN query_id % 3 = 0 THEN CASE WHEN {S.is_arabic('question')} THEN {L(K.REFUSAL_AR)} ELSE {L(K.REFUSAL_EN)} END END AS refusal,
      CASE WHEN query_id % 3 = 0 THEN 0 ELSE -1 END::INTEGER AS n_citations, query_id % 3 = 0 AS is_grounded,
      CASE WHEN query_id % 3 = 0 THEN 'Refused due to empty retrieval context' END AS reason FROM queries""",
)
def empty_retrieval(spark, sf):
    """Every third question asks in a book there is not: it is refused without citations or usage."""
    none = F.lit(None)
    override = F.struct(
        F.when(F.col("query_id") % 3 == 0, "no such book").alias("book"), none.cast("string").alias("chapter"), none.cast("string").alias("section"),
        F.lit(False).alias("exclude_repealed"), none.cast("array<int>").alias("article_numbers"),
    )
    asked = X.article_questions(spark, sf).withColumn("filter_override", override)
    chunks = stored_chunks(spark, sf)
    log = P.answer_log(asked, LexicalIndex.build(chunks), chunks, chunks, synonyms=[], exact=False)
    none = F.size("hits") == 0
    only = lambda c: F.when(none, c)
    return log.select(
        "query_id", none.alias("empty"), "chat_model_id", "total_tokens", only(F.col("answer")).alias("refusal"), F.when(none, F.size("citations")).otherwise(-1).alias("n_citations"),
        (none & F.col("grounding.is_grounded")).alias("is_grounded"), only(F.col("grounding.reason")).alias("reason"),
    )
