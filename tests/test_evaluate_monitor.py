import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill import constants as K
from lexmill.operators import evaluate as E
from lexmill.operators import monitor as M


def metrics(spark, retrieved, truth):
    q = spark.createDataFrame([(1,)], "query_id int")
    hits = spark.createDataFrame([(1, i + 1, a) for i, a in enumerate(retrieved)], "query_id int, rank int, article_number int")
    want = spark.createDataFrame([(1, a) for a in truth], "query_id int, article_number int")
    r = E.retrieval_metrics(q, hits, want).first()
    return r.hit_rate, r.mrr, r.context_recall, r.context_precision


def test_retrieval_metrics(spark):
    assert metrics(spark, [147, 148, 150], [147, 148]) == (1.0, 1.0, 1.0, pytest.approx(2 / 3))
    assert metrics(spark, [100, 147, 147], [147, 148]) == (1.0, 0.5, 0.5, pytest.approx(1 / 3))
    assert metrics(spark, [], []) == (1.0, 1.0, 1.0, 1.0)
    assert metrics(spark, [1], []) == (0.0, 0.0, 1.0, 0.0)
    assert metrics(spark, [], [1]) == (0.0, 0.0, 0.0, 0.0)


def samples(spark, scores):
    rows = [(i, s, s, 0.5, 0.5, 1.0, 1.0, 10.0 * i, 80) for i, s in enumerate(scores)]
    return spark.createDataFrame(rows, "query_id int, faithfulness double, answer_relevancy double, context_precision double, context_recall double, hit_rate double, mrr double, latency_ms double, total_tokens long")


def test_report_and_rules(spark):
    ok = E.report(samples(spark, [0.9] * 9 + [None]))
    row = ok.first()
    assert (row.n_total, row.n_scored, row.n_errors) == (10, 9, 1) and row.faithfulness == pytest.approx(0.9)
    assert row.latency_p95 == pytest.approx(np.percentile([10.0 * i for i in range(10)], 95))
    E.assert_evaluation(ok)
    with pytest.raises(RuntimeError, match="3/10"):
        E.assert_evaluation(E.report(samples(spark, [0.9] * 7 + [None] * 3)))
    with pytest.raises(ValueError):
        E.assert_evaluation(E.report(samples(spark, [0.9]).limit(0)))


@pytest.mark.parametrize("score,passed,alert", [(0.88, True, False), (0.78, True, True), (0.68, False, True)])
def test_gate(spark, score, passed, alert):
    row = E.quality_gate(spark.createDataFrame([(score,)], "faithfulness double")).first()
    assert (row.passed, row.alert) == (passed, alert)


def test_leaderboard_first_wins_ties(spark):
    runs = spark.createDataFrame([(0, 0.8, 0.8, 0.8), (1, 0.9, 0.9, 0.9), (2, 0.9, 0.9, 0.9)], "ordinal int, faithfulness double, answer_relevancy double, context_recall double")
    assert [r.ordinal for r in E.leaderboard(runs).filter("is_best").collect()] == [1]


def test_refusal_matrix(spark):
    rows = spark.createDataFrame([(True, True), (True, False), (False, True), (False, False)], "r boolean, e boolean")
    got = [(x.s.faithfulness, x.s.answer_relevancy) for x in rows.select(E.answer_scores(F.col("r"), F.col("e")).alias("s")).collect()]
    assert got == [(1.0, 1.0), (1.0, 0.2), (0.0, 0.0), (0.95, 0.9)]


def test_percentiles_sketch_route_is_exact(spark):
    rng = np.random.default_rng(1)
    a, b = rng.exponential(size=30_000).round(3), np.full(20_000, 5.0)
    rows = spark.createDataFrame([("a", float(v)) for v in a] + [("b", float(v)) for v in b] + [("c", 1.0), ("c", 2.0)], "k string, v double")
    probs = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    got = {r.k: r for r in E.exact_percentiles(rows, "v", probs, ["k"], accuracy=1000).collect()}
    for name, p in probs.items():
        assert got["a"][name] == pytest.approx(np.percentile(a, p * 100))
        assert got["b"][name] == 5.0
        assert got["c"][name] == pytest.approx(np.percentile([1.0, 2.0], p * 100))


def ks(spark, a, b):
    rows = spark.createDataFrame([(float(v), True) for v in a] + [(float(v), False) for v in b], "v double, s boolean")
    r = M.ks_two_sample(rows, "v", "s").first()
    return r.ks_statistic, r.ks_p_value


def test_ks(spark):
    same = np.linspace(0, 1, 50)
    d, p = ks(spark, same, same)
    assert d == 0.0 and p >= 0.9
    d, p = ks(spark, same, same + 5)
    assert d == 1.0 and p < 0.05
    assert ks(spark, same, []) == (0.0, 1.0)
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=3000).round(2), rng.normal(0.1, 1.1, size=2500).round(2)
    grid = np.concatenate([x, y])
    want = np.max(np.abs(np.searchsorted(np.sort(x), grid, "right") / 3000 - np.searchsorted(np.sort(y), grid, "right") / 2500))
    assert ks(spark, x, y)[0] == pytest.approx(want)


def test_centroid_and_drift(spark):
    frame = lambda rows: spark.createDataFrame([(r,) for r in rows], "embedding array<double>")
    assert M.centroid(frame([[2.0, 0.0], [2.0, 0.0]])).first().centroid == [1.0, 0.0]
    assert M.centroid(frame([[1.0, 0.0], [-1.0, 0.0]])).first().centroid == [0.0, 0.0]
    near, far = [[1.0, 0.01 * i] for i in range(20)], [[-1.0, 0.01 * i] for i in range(20)]
    assert M.drift_report(frame(near), frame(near)).first().drift_detected is False
    row = M.drift_report(frame(far), frame(near)).first()
    assert row.drift_detected and row.verdict == K.DRIFT_VERDICT and row.sample_size == 20


def test_bucket_quantile(spark):
    rows = spark.createDataFrame([(v,) for v in (0.01, 0.2, 0.2, 0.3, 0.7, 20.0)], "duration_s double")
    r = M.latency_quantiles(rows.withColumn("k", F.lit(1)), ["k"], 60.0).first()
    assert r.requests == 6 and r.per_second == 0.1 and r.p50 == pytest.approx(0.25) and r.p95 == 10.0


def test_cost_and_cohort(spark):
    usage = spark.createDataFrame([("m", 1_000_000, 500_000), ("x", 5, 5)], "model_id string, prompt_tokens long, completion_tokens long")
    prices = spark.createDataFrame([("m", 0.14, 0.28)], "model_id string, input_per_1m double, output_per_1m double")
    got = {(r.model_id, r.type): (r.tokens, r.cost_usd) for r in M.token_cost(usage, prices).collect()}
    assert got[("m", "prompt")] == (1_000_000, pytest.approx(0.28)) and got[("x", "completion")] == (5, None)
    keys = spark.range(20_000).select(F.col("id").cast("string").alias("k"))
    share = keys.select((M.cohort(F.col("k")) == "canary").cast("int").alias("c")).agg(F.avg("c")).first()[0]
    assert 0.04 < share < 0.06
    forced = keys.select(M.cohort(F.col("k"), F.lit("always")).alias("c")).distinct().collect()
    assert [r.c for r in forced] == ["canary"]


def test_runs_share_one_truth(spark):
    from lexmill.operators.evaluate import retrieval_metrics

    asked = spark.createDataFrame([(r, q) for r in (0, 1) for q in (1, 2)], "run int, query_id int")
    got = spark.createDataFrame([(0, 1, 1, 7), (0, 1, 2, 8), (1, 1, 1, 8), (1, 2, 1, 9)], "run int, query_id int, rank int, article_number int")
    truth = spark.createDataFrame([(1, 8)], "query_id int, article_number int")
    together = retrieval_metrics(asked, got, truth, ["run"])
    plan = together._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=merge" in plan  # however small its file, the truth is not sent whole to the driver
    for run in (0, 1):
        alone = retrieval_metrics(asked.filter(f"run = {run}").drop("run"), got.filter(f"run = {run}").drop("run"), truth)
        assert sorted(map(tuple, alone.collect())) == sorted(tuple(r)[1:] for r in together.filter(f"run = {run}").collect())
