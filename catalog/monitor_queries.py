"""Evaluation and monitoring queries."""

from pyspark.sql import functions as F

from catalog import fixtures as X
from catalog import sqlparts as S
from catalog.registry import query, table
from catalog.retrieval_queries import BM25_DOCS, doc_index
from lexmill import constants as K
from lexmill.functions import text as T
from lexmill.operators import chunks as C
from lexmill.operators import evaluate as E
from lexmill.operators import monitor as M
from lexmill.operators.lexical import LexicalIndex

# --- evaluation -----------------------------------------------------------------------------
METRIC_CTES = f"""{BM25_DOCS}, {S.TRUTH}, t AS (SELECT query_id, count(*) AS n FROM truth GROUP BY 1),
h AS (SELECT b.query_id, count(*) AS got, min(CASE WHEN t.article_number IS NOT NULL THEN rank END) AS first,
    count(DISTINCT t.article_number) AS hits FROM bm25 b LEFT JOIN truth t ON t.query_id = b.query_id AND t.article_number = b.article_number GROUP BY 1),
mm AS (SELECT q.query_id, coalesce(n, 0) AS n, coalesce(got, 0) AS got, first, coalesce(hits, 0) AS hits
    FROM queries q LEFT JOIN t USING (query_id) LEFT JOIN h USING (query_id)),
metrics AS (SELECT query_id, CASE WHEN n = 0 THEN (got = 0)::INT::DOUBLE ELSE (first IS NOT NULL)::INT::DOUBLE END AS hit_rate,
    CASE WHEN n = 0 THEN (got = 0)::INT::DOUBLE ELSE coalesce(1.0::DOUBLE / first, 0) END AS mrr,
    CASE WHEN n = 0 THEN 1.0::DOUBLE ELSE hits::DOUBLE / n END AS context_recall,
    CASE WHEN n = 0 THEN (got = 0)::INT::DOUBLE WHEN got = 0 THEN 0.0::DOUBLE ELSE hits::DOUBLE / got END AS context_precision FROM mm)"""


@query(
    "retrieval_metrics",
    f"{METRIC_CTES} SELECT query_id, hit_rate, round(mrr, 6) AS mrr, round(context_recall, 6) AS context_recall, round(context_precision, 6) AS context_precision FROM metrics",
)
def retrieval_metrics(spark, sf):
    q = X.doc_questions(spark, sf)
    rows = E.retrieval_metrics(q, doc_index(spark, sf).search(q, limit=5), X.truth(spark, sf))
    return rows.select("query_id", "hit_rate", *[F.round(c, 6).alias(c) for c in ("mrr", "context_recall", "context_precision")])


SAMPLES = f"""{METRIC_CTES},
ans AS (SELECT query_id, CASE query_id % 4 WHEN 0 THEN {S.lit(K.REFUSAL_EN)} WHEN 1 THEN {S.lit(K.REFUSAL_AR)} ELSE question END AS answer,
    query_id % 8 IN (0, 3) AS expected, query_id % 16 = 7 AS failed, (query_id * 37 % 101) * 12.5::DOUBLE AS latency_ms FROM queries),
ref AS (SELECT *, query_id % 4 IN (0, 1) AND NOT failed AS refused FROM ans),
samples AS (SELECT r.query_id,
    CASE WHEN failed THEN NULL WHEN refused THEN 1.0 WHEN expected THEN 0.0 ELSE 0.95 END::DOUBLE AS faithfulness,
    CASE WHEN failed THEN NULL WHEN refused AND expected THEN 1.0 WHEN refused THEN 0.2 WHEN expected THEN 0.0 ELSE 0.9 END::DOUBLE AS answer_relevancy,
    CASE WHEN failed THEN 0.0::DOUBLE ELSE context_precision END AS context_precision, CASE WHEN failed THEN 0.0::DOUBLE ELSE context_recall END AS context_recall,
    CASE WHEN failed THEN 0.0::DOUBLE ELSE hit_rate END AS hit_rate, CASE WHEN failed THEN 0.0::DOUBLE ELSE mrr END AS mrr,
    CASE WHEN failed THEN 'failed' WHEN refused AND expected THEN 'Correct canonical refusal on ungrounded query' WHEN refused THEN 'Refused to answer in-scope question'
      WHEN expected THEN 'Answered out-of-scope question instead of refusing' ELSE 'Deterministic statutory evaluation (Mock Mode)' END AS reason,
    refused AS is_refusal, CASE WHEN failed THEN 0.0::DOUBLE ELSE latency_ms END AS latency_ms, CASE WHEN failed THEN 0 ELSE 80 END::BIGINT AS total_tokens
  FROM ref r JOIN metrics USING (query_id))"""


def samples(spark, sf):
    q = F.col("query_id")
    questions = X.doc_questions(spark, sf).withColumn("is_refusal_expected", (q % 8).isin(0, 3))
    answers = questions.filter(q % 16 != 7).select(
        "query_id",
        F.when(q % 4 == 0, K.REFUSAL_EN).when(q % 4 == 1, K.REFUSAL_AR).otherwise(F.col("question")).alias("answer"),
        ((q * 37 % 101) * 12.5).alias("latency_ms"),
        F.lit(80).cast("bigint").alias("total_tokens"),
    )
    hits = doc_index(spark, sf).search(questions, limit=5)
    return E.evaluate_samples(questions, answers, hits, X.truth(spark, sf))


ROUNDED = ["context_precision", "context_recall", "mrr"]


@query(
    "sample_evaluations",
    f"{SAMPLES} SELECT * REPLACE (round(context_precision, 6) AS context_precision, round(context_recall, 6) AS context_recall, round(mrr, 6) AS mrr) FROM samples",
)
def sample_evaluations(spark, sf):
    return samples(spark, sf).withColumns({c: F.round(c, 6) for c in ROUNDED})


REPORT = f"""{SAMPLES}, report AS (SELECT count(*) AS n_total, count(faithfulness) AS n_scored, count(*) - count(faithfulness) AS n_errors,
  {", ".join(f"round(avg({m}), 6) AS {m}" for m in E.METRICS)}, avg(total_tokens) AS tokens_per_query, round(quantile_cont(latency_ms, 0.95), 6) AS latency_p95 FROM samples)"""


def rounded_report(spark, sf):
    return E.report(samples(spark, sf)).withColumns({c: F.round(c, 6) for c in [*E.METRICS, "latency_p95"]})


@query("eval_report", f"{REPORT} SELECT * FROM report")
def eval_report(spark, sf):
    return rounded_report(spark, sf)


@query(
    "quality_gate",
    f"{REPORT} SELECT n_total, faithfulness, n_errors::DOUBLE / n_total <= 0.2 AS valid, faithfulness >= 0.75 AS passed, faithfulness < 0.80 AS alert FROM report",
)
def quality_gate(spark, sf):
    return E.quality_gate(E.error_rules(rounded_report(spark, sf))).select("n_total", "faithfulness", "valid", "passed", "alert")


@query(
    "latency_percentiles",
    """SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99
    FROM events GROUP BY 1 UNION ALL SELECT 'all', round(quantile_cont(value, 0.5), 6), round(quantile_cont(value, 0.95), 6), round(quantile_cont(value, 0.99), 6) FROM events""",
)
def latency_percentiles(spark, sf):
    events, probs = table(spark, sf, "events"), {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    each = E.exact_percentiles(events, "value", probs, ["event_type"])
    total = E.exact_percentiles(events, "value", probs).withColumn("event_type", F.lit("all"))
    return each.unionByName(total).withColumns({p: F.round(p, 6) for p in probs})


# Sweep: tokens with or without the stop list x answer depth, every run over all questions.
def _sweep_sql() -> str:
    runs = []
    for i, (strategy, k) in enumerate(SWEEP):
        ctes = f"{S.DOC_CHUNKS}, {S.bm25(k)}"
        if strategy == "paragraph":
            ctes = ctes.replace("text AS ctext FROM documents", "unnest(string_split(text, chr(10))) AS ctext FROM documents").replace(
                "doc_id::VARCHAR AS chunk_id", "doc_id || '_' || generate_subscripts(string_split(text, chr(10)), 1) AS chunk_id"
            ).replace("NULL::INTEGER AS paragraph_number", "generate_subscripts(string_split(text, chr(10)), 1)::INTEGER AS paragraph_number")
        body = METRIC_CTES.replace(BM25_DOCS, "WITH " + ctes)
        runs.append(
            f"""SELECT * FROM ({body} SELECT {i} AS ordinal, '{strategy}' AS chunk_strategy, {k} AS top_k, round(avg(hit_rate), 6) AS hit_rate,
            round(avg(mrr), 6) AS mrr, round(avg(context_recall), 6) AS context_recall, round(avg(context_precision), 6) AS context_precision FROM metrics)"""
        )
    return " UNION ALL ".join(runs)


SWEEP = [("article", 3), ("article", 5), ("article", 8), ("paragraph", 3), ("paragraph", 5), ("paragraph", 8)]


def sweep_runs(spark, sf):
    from lexmill.plans.sweep import retrieval_sweep

    docs = X.doc_chunks(spark, sf)
    lines = docs.select("article_number", F.posexplode(F.split("text_ar", "\n")).alias("p", "text_ar")).select(
        F.concat_ws("_", "article_number", F.col("p") + 1).alias("chunk_id"), "article_number",
        (F.col("p") + 1).alias("paragraph_number"), "text_ar", F.col("text_ar").alias("text_ar_normalized"),
    )
    return retrieval_sweep(
        X.doc_questions(spark, sf), X.truth(spark, sf), {"article": docs, "paragraph": lines}, [3, 5, 8]
    )


@query("parameter_sweep", _sweep_sql())
def parameter_sweep(spark, sf):
    return sweep_runs(spark, sf).withColumns({c: F.round(c, 6) for c in ("hit_rate", *ROUNDED)})


ORACLES_RUNS = f"""WITH r AS ({_sweep_sql()}), s AS (SELECT ordinal, chunk_strategy, top_k, round(mrr * 0.4 + hit_rate * 0.3 + context_recall * 0.3, 9) AS composite_score FROM r),
board AS (SELECT *, ordinal = (SELECT ordinal FROM s ORDER BY composite_score DESC, ordinal LIMIT 1) AS is_best FROM s)"""


@query("run_leaderboard", f"{ORACLES_RUNS} SELECT * FROM board")
def run_leaderboard(spark, sf):
    """Ranks real sweep runs; MRR and hit rate stand where judge scores would."""
    runs = parameter_sweep(spark, sf).withColumns({"faithfulness": F.col("mrr"), "answer_relevancy": F.col("hit_rate")})
    return E.leaderboard(runs).select("ordinal", "chunk_strategy", "top_k", "composite_score", "is_best")


# --- drift ----------------------------------------------------------------------------------
MEAN = "SELECT {k}i, avg(x) AS x FROM (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings{w}) GROUP BY ALL"


@query(
    "label_centroids",
    f"""WITH m AS ({MEAN.format(k='label, ', w='')}), n AS (SELECT label, sqrt(sum(x * x)) AS n FROM m GROUP BY 1)
    SELECT label, i::INTEGER AS pos, round(x / n, 6) AS value FROM m JOIN n USING (label)""",
)
def label_centroids(spark, sf):
    rows = M.centroid(table(spark, sf, "embeddings"), ["label"])
    return rows.select("label", F.posexplode("centroid").alias("p", "v")).select(
        "label", (F.col("p") + 1).alias("pos"), F.round("v", 6).alias("value")
    )


DIST = f"""WITH m AS ({MEAN.format(k='', w=' WHERE label < 5')}), c AS (SELECT list(x ORDER BY i) AS c FROM m),
d AS (SELECT vec_id, label >= 5 AS is_query, 1 - list_cosine_similarity(embedding::DOUBLE[], c) AS distance FROM embeddings, c)"""


@query("centroid_distance", f"{DIST} SELECT vec_id, round(distance, 6) AS distance FROM d")
def centroid_distance(spark, sf):
    emb = table(spark, sf, "embeddings")
    return M.distances(emb, M.centroid(emb.filter("label < 5"))).select("vec_id", F.round("distance", 6).alias("distance"))


def _ks_sql(source: str) -> str:
    return f"""{source}, n AS (SELECT count_if(s) AS n1, count_if(NOT s) AS n2 FROM smp),
    g AS (SELECT v, count_if(s) AS a, count_if(NOT s) AS b FROM smp GROUP BY v),
    f AS (SELECT abs(sum(a) OVER (ORDER BY v) / n1::DOUBLE - sum(b) OVER (ORDER BY v) / n2::DOUBLE) AS gap FROM g, n),
    k AS (SELECT n1, n2, max(gap) AS d, sqrt(n1 * n2 / (n1 + n2)::DOUBLE) AS en FROM f, n GROUP BY ALL),
    ks AS (SELECT n1::BIGINT AS n1, n2::BIGINT AS n2, d AS ks_statistic, greatest(0.0::DOUBLE, least(1.0::DOUBLE, 2 * exp(-2 * pow((en + 0.12 + 0.11 / en) * d, 2)))) AS ks_p_value FROM k)"""


KS_EVENTS = _ks_sql("WITH smp AS (SELECT value AS v, event_type IN ('view', 'click') AS s FROM events)")


@query("ks_two_sample", f"{KS_EVENTS} SELECT n1, n2, round(ks_statistic, 6) AS ks_statistic, round(ks_p_value, 6) AS ks_p_value FROM ks")
def ks_two_sample(spark, sf):
    rows = table(spark, sf, "events").withColumn("s", F.col("event_type").isin("view", "click"))
    return M.ks_two_sample(rows, "value", "s").withColumns({c: F.round(c, 6) for c in ("ks_statistic", "ks_p_value")})


DRIFT = _ks_sql(f"{DIST}, smp AS (SELECT round(distance, 6) AS v, is_query AS s FROM d)")


@query(
    "drift_report",
    f"""{DRIFT}, q AS (SELECT count(*) AS sample_size, avg(distance) AS m, min(distance) AS lo, max(distance) AS hi, stddev_pop(distance) AS sd FROM d WHERE is_query)
    SELECT sample_size, round(m, 6) AS mean_cosine_distance, round(lo, 6) AS distance_min, round(hi, 6) AS distance_max, round(sd, 6) AS distance_std,
      0.45::DOUBLE AS threshold_distance, round(ks_statistic, 6) AS ks_statistic, round(ks_p_value, 6) AS ks_p_value,
      m > 0.45 OR (ks_p_value < 0.01 AND m > 0.40) AS drift_detected,
      CASE WHEN m > 0.45 OR (ks_p_value < 0.01 AND m > 0.40) THEN {S.lit(K.DRIFT_VERDICT)} ELSE {S.lit(K.NO_DRIFT_VERDICT)} END AS verdict FROM q, ks""",
)
def drift_report(spark, sf):
    emb = table(spark, sf, "embeddings")
    rows = M.drift_report(emb.filter("label >= 5"), emb.filter("label < 5"), digits=6)
    cols = ["mean_cosine_distance", "distance_min", "distance_max", "distance_std", "ks_statistic", "ks_p_value"]
    return rows.withColumns({c: F.round(c, 6) for c in cols})


# --- traffic --------------------------------------------------------------------------------
REQ = """WITH req AS (SELECT ts, user_id, CASE event_type WHEN 'view' THEN 'GET' WHEN 'click' THEN 'GET' ELSE 'POST' END AS method,
  CASE event_type WHEN 'view' THEN '/articles/' || user_id WHEN 'click' THEN '/corpus/stats' ELSE '/ask' END AS endpoint,
  CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status_code, value / 100 AS duration_s,
  CASE user_id % 50 WHEN 0 THEN 'always' WHEN 1 THEN 'never' END AS override FROM events),
rt AS (SELECT * REPLACE (CASE WHEN starts_with(endpoint, '/articles/') THEN '/articles/{number}' ELSE endpoint END AS endpoint) FROM req)"""


def requests(spark, sf):
    kind = F.col("event_type")
    return table(spark, sf, "events").select(
        F.col("ts").cast("timestamp").alias("ts"),
        "user_id",
        F.when(kind.isin("view", "click"), "GET").otherwise("POST").alias("method"),
        F.when(kind == "view", F.concat(F.lit("/articles/"), F.col("user_id"))).when(kind == "click", "/corpus/stats").otherwise("/ask").alias("endpoint"),
        F.when(kind == "error", 500).otherwise(200).alias("status_code"),
        (F.col("value") / 100).alias("duration_s"),
        F.when(F.col("user_id") % 50 == 0, "always").when(F.col("user_id") % 50 == 1, "never").alias("override"),
    )


def templated(spark, sf):
    return requests(spark, sf).withColumn("endpoint", T.endpoint_template(F.col("endpoint")))


@query("request_counts", f"{REQ} SELECT method, endpoint, status_code, count(*) AS requests FROM rt GROUP BY ALL")
def request_counts(spark, sf):
    return M.request_counts(requests(spark, sf))


def _hist_sql(src: str, keys: str, value: str, bounds: list[float]) -> str:
    return " UNION ALL ".join(
        f"SELECT {keys}, '{b}' AS le, count_if({value} <= {b})::BIGINT AS cumulative FROM {src} GROUP BY ALL" for b in bounds
    ) + f" UNION ALL SELECT {keys}, '+Inf', count(*) FROM {src} GROUP BY ALL"


@query("latency_histogram", f"{REQ} {_hist_sql('rt', 'method, endpoint', 'duration_s', K.LATENCY_BUCKETS)}")
def latency_histogram(spark, sf):
    return M.histogram(templated(spark, sf), "duration_s", K.LATENCY_BUCKETS, ["method", "endpoint"])


@query(
    "score_histogram",
    f"WITH sc AS (SELECT label, round(list_extract(embedding, 1)::DOUBLE + 0.5, 6) AS score FROM embeddings) {_hist_sql('sc', 'label', 'score', K.SCORE_BUCKETS)}",
)
def score_histogram(spark, sf):
    rows = table(spark, sf, "embeddings").select("label", F.round(F.get("embedding", F.lit(0)).cast("double") + 0.5, 6).alias("score"))
    return M.histogram(rows, "score", K.SCORE_BUCKETS, ["label"])


def _quantile_sql(q: float) -> str:
    cases, before, lower = [], "0", "0"
    for i, b in enumerate(K.LATENCY_BUCKETS):
        inside = f"{lower}::DOUBLE + ({b} - {lower}) * (total * {q} - {before})::DOUBLE / nullif(b{i} - {before}, 0)"
        cases.append(f"WHEN b{i} >= total * {q} THEN coalesce({inside}, {b})")
        before, lower = f"b{i}", str(b)
    return f"round(CASE {' '.join(cases)} ELSE {K.LATENCY_BUCKETS[-1]} END, 6)"


@query(
    "histogram_quantiles",
    f"""{REQ}, w AS (SELECT time_bucket(INTERVAL '5 minutes', ts) AS window_start, endpoint, duration_s FROM rt),
    b AS (SELECT window_start, endpoint, count(*) AS total, {", ".join(f"count_if(duration_s <= {b}) AS b{i}" for i, b in enumerate(K.LATENCY_BUCKETS))} FROM w GROUP BY 1, 2)
    SELECT strftime(window_start, '%Y-%m-%d %H:%M:%S') AS window_start, endpoint, total AS requests, round(total / 300.0::DOUBLE, 6) AS per_second,
      {_quantile_sql(0.5)} AS p50, {_quantile_sql(0.9)} AS p90, {_quantile_sql(0.95)} AS p95 FROM b""",
)
def histogram_quantiles(spark, sf):
    rows = templated(spark, sf).withColumn("window_start", F.window("ts", "5 minutes")["start"])
    out = M.latency_quantiles(rows, ["window_start", "endpoint"], 300.0)
    return out.withColumns({c: F.round(c, 6) for c in ("per_second", "p50", "p90", "p95")}).withColumn(
        "window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss")
    )


@query(
    "token_cost",
    """WITH u AS (SELECT 'model-' || event_type AS model_id, floor(value)::BIGINT AS p, (json_extract(props, '$.k'))::BIGINT AS c FROM events),
    t AS (SELECT model_id, sum(p)::BIGINT AS prompt, sum(c)::BIGINT AS completion FROM u GROUP BY 1),
    pr AS (SELECT 'model-' || event_type AS model_id, 0.14::DOUBLE AS i, 0.28::DOUBLE AS o FROM (SELECT DISTINCT event_type FROM events) WHERE event_type <> 'signup'),
    j AS (SELECT t.*, round((prompt * i + completion * o) / 1000000, 6) AS cost_usd FROM t LEFT JOIN pr USING (model_id))
    SELECT model_id, 'prompt' AS type, prompt AS tokens, cost_usd FROM j UNION ALL SELECT model_id, 'completion', completion, cost_usd FROM j""",
)
def token_cost(spark, sf):
    events = table(spark, sf, "events")
    usage = events.select(
        F.concat(F.lit("model-"), "event_type").alias("model_id"), F.floor("value").alias("prompt_tokens"),
        F.get_json_object("props", "$.k").cast("bigint").alias("completion_tokens"),
    )
    prices = usage.select("model_id").distinct().filter("model_id <> 'model-signup'").withColumns(
        {"input_per_1m": F.lit(0.14), "output_per_1m": F.lit(0.28)}
    )
    return M.token_cost(usage, prices).withColumn("cost_usd", F.round("cost_usd", 6))


@query(
    "guardrail_counters",
    f"""WITH l AS (SELECT CASE WHEN turn % 3 = 0 THEN {S.arabize('text')} ELSE text END AS question,
      CASE conv_id % 5 WHEN 0 THEN {S.lit(K.REFUSAL_EN)} WHEN 1 THEN {S.lit(K.REFUSAL_AR)} ELSE text END AS answer, conv_id % 7 <> 0 AS ok FROM conversations)
    SELECT CASE WHEN {S.is_arabic('question')} THEN 'ar' ELSE 'en' END AS language, count(*) AS answers,
      count_if(contains(answer, {S.lit(K.REFUSAL_MARK_AR)}) OR contains(lower(answer), {S.lit(K.REFUSAL_MARK_EN)}))::BIGINT AS refusals,
      count_if(NOT ok)::BIGINT AS interventions FROM l GROUP BY 1""",
)
def guardrail_counters(spark, sf):
    conv, text = F.col("conv_id"), F.col("text")
    log = table(spark, sf, "conversations").select(
        F.when(F.col("turn") % 3 == 0, X.arabize(text)).otherwise(text).alias("question"),
        F.when(conv % 5 == 0, K.REFUSAL_EN).when(conv % 5 == 1, K.REFUSAL_AR).otherwise(text).alias("answer"),
        (conv % 7 != 0).alias("is_grounded"),
    )
    return M.guardrail_counters(log)


@query("latest_gauge", "SELECT event_type, arg_max(value, event_id) AS value FROM events GROUP BY 1")
def latest_gauge(spark, sf):
    return M.latest_value(table(spark, sf, "events"), "value", "event_id", ["event_type"])


def spans(spark, sf):
    return table(spark, sf, "events").select(
        F.col("event_type").alias("name"), F.col("user_id").alias("trace_id"), F.col("event_id").cast("double").alias("start_s"),
        (F.col("event_id").cast("double") + F.col("value") / 1000).alias("end_s"),
    )


SPANS = "WITH sp AS (SELECT event_type AS name, user_id AS trace_id, ((event_id::DOUBLE + value / 1000) - event_id::DOUBLE) * 1000 AS ms FROM events)"


@query("span_statistics", f"{SPANS} SELECT name, count(*) AS spans, round(avg(ms), 4) AS mean_ms, round(quantile_cont(ms, 0.95), 4) AS p95_ms FROM sp GROUP BY 1")
def span_statistics(spark, sf):
    return M.span_statistics(spans(spark, sf)).withColumns({c: F.round(c, 4) for c in ("mean_ms", "p95_ms")})


@query(
    "trace_totals",
    f"""{SPANS}, sc AS (SELECT DISTINCT user_id AS trace_id, (user_id % 10) / 10.0::DOUBLE AS faithfulness FROM events WHERE user_id % 3 = 0)
    SELECT trace_id, count(*) AS spans, round(sum(ms), 4) AS total_ms, faithfulness FROM sp LEFT JOIN sc USING (trace_id) GROUP BY trace_id, faithfulness""",
)
def trace_totals(spark, sf):
    u = F.col("user_id")
    scores = table(spark, sf, "events").filter(u % 3 == 0).select(u.alias("trace_id"), ((u % 10) / 10.0).alias("faithfulness")).distinct()
    return M.trace_totals(spans(spark, sf), scores).withColumn("total_ms", F.round("total_ms", 4))


COHORT = """CASE WHEN override = 'always' THEN 'canary' WHEN override = 'never' THEN 'stable'
  WHEN ('0x' || substr(md5(user_id::VARCHAR), 1, 8))::BIGINT % 10000 < {s} THEN 'canary' ELSE 'stable' END"""


@query("cohort_split", f"{REQ} SELECT user_id, {COHORT.format(s=500)} AS cohort, count(*) AS requests FROM req GROUP BY ALL")
def cohort_split(spark, sf):
    who = M.cohort(F.col("user_id").cast("string"), F.col("override"), portable=True)
    return requests(spark, sf).groupBy("user_id", who.alias("cohort")).agg(F.count("*").alias("requests"))


@query(
    "cohort_rollback",
    f"""{REQ}, c AS (SELECT strftime(time_bucket(INTERVAL '5 minutes', ts), '%Y-%m-%d %H:%M:%S') AS window_start, {COHORT.format(s=2500)} AS cohort, status_code, duration_s * 1000 AS ms,
        CASE WHEN user_id % 4 = 0 THEN (user_id % 100) / 100.0::DOUBLE END AS fa FROM req),
    g AS (SELECT window_start, cohort, count(*) AS requests, count_if(status_code >= 500) / count(*)::DOUBLE AS e, min(fa) AS faithfulness, quantile_cont(ms, 0.95) AS p FROM c GROUP BY 1, 2),
    t AS (SELECT *, e > 0.005 AS errors_tripped, p > 2000 AS latency_tripped, coalesce(faithfulness < 0.75, false) AS quality_tripped FROM g)
    SELECT window_start, cohort, requests, round(e, 6) AS error_rate, faithfulness, round(p, 6) AS p95_ms, errors_tripped, latency_tripped, quality_tripped,
      errors_tripped OR latency_tripped OR quality_tripped AS roll_back FROM t""",
)
def cohort_rollback(spark, sf):
    u = F.col("user_id")
    rows = requests(spark, sf).withColumns(
        {
            "cohort": M.cohort(u.cast("string"), F.col("override"), 25.0, portable=True),
            "duration_ms": F.col("duration_s") * 1000,
            "faithfulness": F.when(u % 4 == 0, (u % 100) / 100.0),
        }
    )
    out = M.rollback_triggers(rows)
    return out.withColumns(
        {"error_rate": F.round("error_rate", 6), "p95_ms": F.round("p95_ms", 6), "window_start": F.date_format("window_start", "yyyy-MM-dd HH:mm:ss")}
    )
