"""Drift, traffic, cost and rollout monitoring."""

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill import constants as K
from lexmill.functions import text as X
from lexmill.functions.vectors import dot, norm
from lexmill.operators.evaluate import exact_percentiles


# --- drift ----------------------------------------------------------------------------------
def mean_vector(vectors: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Component-wise mean per key: positions are averaged on the map side before the shuffle."""
    keys = keys or []
    parts = vectors.select(*keys, F.posexplode("embedding").alias("pos", "x"))
    means = parts.groupBy(*keys, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "x")))
    return means.groupBy(*keys).agg(F.transform(ordered, lambda p: p["x"]).alias("mean"))


def centroid(vectors: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Mean direction: the mean vector at unit length, or as it is when its norm is zero."""
    sized = mean_vector(vectors, keys).withColumn("norm", norm(F.col("mean")))
    unit = F.transform("mean", lambda x: F.when(F.col("norm") > 0, x / F.col("norm")).otherwise(x))
    return sized.select(*(keys or []), unit.alias("centroid"))


def cosine_distance(embedding: Column, center: Column) -> Column:
    """One minus the cosine to a unit centre; a zero vector is divided by 1e-12."""
    size = norm(embedding)
    return 1.0 - dot(embedding, center) / F.when(size == 0, 1e-12).otherwise(size)


def distances(vectors: DataFrame, centers: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Distance of every vector to the single centre, or to the centre of its key."""
    if keys:
        joined = vectors.join(centers, keys)
        return joined.withColumn("distance", cosine_distance(F.col("embedding"), F.col("centroid"))).drop("centroid")
    center = F.lit(centers.first().centroid)  # one vector, so a literal of the plan
    return vectors.withColumn("distance", cosine_distance(F.col("embedding"), center))


def ks_two_sample(samples: DataFrame, value: str, side: str, digits: int | None = None) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic and asymptotic p-value.

    ``side`` is true for the first sample. Equal values are merged first; prefix sums are taken
    inside value ranges cut at sketched quantiles and shifted by the totals of lower ranges, so no
    task orders the whole sample.
    """
    from pyspark.ml.feature import Bucketizer

    v = F.col(value).cast("double")
    v = v if digits is None else F.round(v, digits)
    merged = (
        samples.filter(F.col(value).isNotNull())
        .select(v.alias("v"), F.col(side).alias("s"))
        .groupBy("v")
        .agg(F.count_if("s").alias("a"), F.count_if(~F.col("s")).alias("b"))
    )
    cuts = sorted(set(samples.agg(F.percentile_approx(v, [i / 256 for i in range(1, 256)], 2000).alias("q")).first().q or []))
    splits = [-math.inf, *cuts, math.inf]
    if len(splits) > 2:
        ranged = Bucketizer(splits=splits, inputCol="v", outputCol="r").transform(merged)
    else:
        ranged = merged.withColumn("r", F.lit(0.0))
    below = Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)  # at most 256 rows
    totals = ranged.groupBy("r").agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    offsets = totals.select(
        "r", F.coalesce(F.sum("ta").over(below), F.lit(0)).alias("oa"), F.coalesce(F.sum("tb").over(below), F.lit(0)).alias("ob")
    )
    sizes = totals.agg(F.sum("ta").alias("n1"), F.sum("tb").alias("n2"))
    run = Window.partitionBy("r").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    n1, n2 = (sizes.select(F.nullif(n, F.lit(0))).scalar() for n in ("n1", "n2"))
    gaps = ranged.join(F.broadcast(offsets), "r").select(
        F.abs((F.col("oa") + F.sum("a").over(run)) / n1 - (F.col("ob") + F.sum("b").over(run)) / n2).alias("gap")
    )
    out = gaps.agg(F.max("gap").alias("d")).select(
        F.coalesce(n1, F.lit(0)).alias("n1"), F.coalesce(n2, F.lit(0)).alias("n2"), "d"
    )
    empty = (F.col("n1") == 0) | (F.col("n2") == 0)
    p = ks_probability(F.col("d"), F.col("n1"), F.col("n2"))
    return out.select(
        "n1", "n2",
        F.when(empty, 0.0).otherwise(F.col("d")).alias("ks_statistic"),
        F.when(empty, 1.0).otherwise(p).alias("ks_p_value"),
    )


def ks_probability(d: Column, n1: Column, n2: Column) -> Column:
    """Asymptotic p-value of the two-sample statistic ``d``; null if a sample is empty."""
    en = F.sqrt(F.nullif(n1 * n2, F.lit(0)) / (n1 + n2))
    lam = (en + 0.12 + 0.11 / en) * d
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2.0 * F.exp(-2.0 * lam * lam)))


def baseline_cells(values: DataFrame, value: str, cells: int = 64) -> tuple[list[float], list[float], int]:
    """Cuts of a sample at its quantiles, the share of the sample up to each cut, and its size: one row, whatever the sample."""
    found = values.agg(F.percentile_approx(value, [i / cells for i in range(1, cells)], 10_000).alias("q")).first().q
    cuts = sorted(set(found or []))
    row = values.filter(F.col(value).isNotNull()).agg(F.count("*").alias("n"), *[F.count_if(F.col(value) <= c).alias(f"c{i}") for i, c in enumerate(cuts)]).first()
    return cuts, [row[f"c{i}"] / row.n for i in range(len(cuts))], row.n


def ks_bounds(counts: list[Column], total: Column, shares: list[float]) -> tuple[Column, Column]:
    """Least and greatest Kolmogorov-Smirnov statistic that fits the numbers of values up to each cut.

    ``shares`` are those of the other sample. The least is the distance at the cuts; between two cuts either sample may
    rise anywhere, so the greatest exceeds it by no more than what a sample has in one cell.
    """
    mine = [F.lit(0.0), *[c / total for c in counts], F.lit(1.0)]
    other = [0.0, *shares, 1.0]
    low = F.array_max(F.array(*[F.abs(a - F.lit(b)) for a, b in zip(mine, other, strict=True)]))
    rise = [x for a, b, c, d in zip(mine, mine[1:], other, other[1:], strict=False) for x in (b - F.lit(c), F.lit(d) - a)]
    return low, F.greatest(low, F.array_max(F.array(*rise)))


def drift_report(queries: DataFrame, baseline: DataFrame, threshold: float = K.DRIFT_THRESHOLD, digits: int | None = None) -> DataFrame:
    """One row: distance of query vectors to the baseline centroid, KS against the baseline, verdict."""
    centers = centroid(baseline)
    both = (
        distances(queries, centers).select("distance", F.lit(True).alias("is_query"))
        .unionByName(distances(baseline, centers).select("distance", F.lit(False).alias("is_query")))
    )
    d = F.when(F.col("is_query"), F.col("distance"))
    summary = both.agg(
        F.count(d).alias("sample_size"), F.avg(d).alias("mean_cosine_distance"),
        F.min(d).alias("distance_min"), F.max(d).alias("distance_max"), F.stddev_pop(d).alias("distance_std"),
    )
    ks = ks_two_sample(both, "distance", "is_query", digits)
    p, stat = ks.select("ks_p_value").scalar(), ks.select("ks_statistic").scalar()
    mean = F.col("mean_cosine_distance")
    rows = summary.withColumns({"threshold_distance": F.lit(threshold), "ks_statistic": stat, "ks_p_value": p})
    drifted = (mean > threshold) | ((F.col("ks_p_value") < K.DRIFT_P) & (mean > K.DRIFT_MEAN))
    return rows.withColumn("drift_detected", drifted).withColumn(
        "verdict", F.when(F.col("drift_detected"), K.DRIFT_VERDICT).otherwise(K.NO_DRIFT_VERDICT)
    )


# --- traffic --------------------------------------------------------------------------------
def request_counts(requests: DataFrame) -> DataFrame:
    return requests.groupBy("method", X.endpoint_template(F.col("endpoint")).alias("endpoint"), "status_code").agg(
        F.count("*").alias("requests")
    )


def bucket_columns(value: Column, bounds: list[float]) -> list[Column]:
    """Cumulative bucket counters plus total and sum, for any grouping or window."""
    return [F.count_if(value <= b).alias(f"le_{i}") for i, b in enumerate(bounds)] + [
        F.count(value).alias("total"), F.sum(value).alias("total_value")
    ]


def histogram(rows: DataFrame, value: str, bounds: list[float], keys: list[str]) -> DataFrame:
    """Cumulative histogram in long form: one row per key and upper bound, ``+Inf`` last."""
    wide = rows.groupBy(*keys).agg(*bucket_columns(F.col(value), bounds))
    long = F.array(
        *[F.struct(F.lit(str(b)).alias("le"), F.col(f"le_{i}").alias("cumulative")) for i, b in enumerate(bounds)],
        F.struct(F.lit("+Inf").alias("le"), F.col("total").alias("cumulative")),
    )
    return wide.select(*keys, F.inline(long))


def quantile_from_buckets(q: float, bounds: list[float]) -> Column:
    """Quantile by linear interpolation inside the first bucket that reaches rank q."""
    les = F.array(*[F.lit(float(b)) for b in bounds])
    cums = F.array(*[F.col(f"le_{i}") for i in range(len(bounds))])
    rank = F.col("total") * q
    i = F.array_position(F.transform(cums, lambda c: c >= rank), True).cast("int")
    upper, lower = F.get(les, i - 1), F.when(i == 1, 0.0).otherwise(F.get(les, i - 2))
    before = F.when(i == 1, 0).otherwise(F.get(cums, i - 2))
    width = F.get(cums, i - 1) - before
    inside = lower + (upper - lower) * (rank - before) / F.nullif(width, F.lit(0))
    return F.when(F.col("total") == 0, None).when(i == 0, float(bounds[-1])).otherwise(F.coalesce(inside, upper))


def latency_quantiles(requests: DataFrame, keys: list[str], seconds: float, bounds: list[float] = K.LATENCY_BUCKETS) -> DataFrame:
    """p50, p90, p95 from buckets and the per-second rate, per group of a fixed-length window."""
    wide = requests.groupBy(*keys).agg(*bucket_columns(F.col("duration_s"), bounds))
    return wide.select(
        *keys, F.col("total").alias("requests"), (F.col("total") / seconds).alias("per_second"),
        *[quantile_from_buckets(q, bounds).alias(f"p{round(q * 100)}") for q in (0.5, 0.9, 0.95)],
    )


def token_cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Token totals and USD cost per model; unknown models count tokens without cost.

    Usage is aggregated before the price join, so the join sees one row per model.
    """
    totals = usage.groupBy("model_id").agg(
        F.sum("prompt_tokens").alias("prompt"), F.sum("completion_tokens").alias("completion")
    )
    cost = (F.col("prompt") * F.col("input_per_1m") + F.col("completion") * F.col("output_per_1m")) / 1_000_000.0
    return (
        totals.join(prices, "model_id", "left")
        .withColumn("cost_usd", cost)
        .select("model_id", "cost_usd", F.inline(F.array(*[F.struct(F.lit(t).alias("type"), F.col(t).alias("tokens")) for t in ("prompt", "completion")])))
    )


def guardrail_counters(log: DataFrame) -> DataFrame:
    """Refusals and grounding interventions per question language."""
    language = F.when(X.is_arabic(F.col("question")), "ar").otherwise("en")
    return log.groupBy(language.alias("language")).agg(
        F.count("*").alias("answers"),
        F.count_if(X.is_refusal(F.col("answer"))).alias("refusals"),
        F.count_if(~F.col("is_grounded")).alias("interventions"),
    )


def latest_value(rows: DataFrame, value: str, order: str, keys: list[str]) -> DataFrame:
    """Gauge: the last recorded value per key."""
    return rows.groupBy(*keys).agg(F.max_by(value, order).alias(value))


def span_statistics(spans: DataFrame) -> DataFrame:
    """Count, mean and exact p95 duration per span name."""
    timed = spans.withColumn("duration_ms", (F.col("end_s") - F.col("start_s")) * 1000.0)
    means = timed.groupBy("name").agg(F.count("*").alias("spans"), F.avg("duration_ms").alias("mean_ms"))
    return means.join(exact_percentiles(timed, "duration_ms", {"p95_ms": 0.95}, ["name"]), "name")


def trace_totals(spans: DataFrame, scores: DataFrame) -> DataFrame:
    """Total duration per trace with the scores attached to it, if any."""
    totals = spans.groupBy("trace_id").agg(
        F.count("*").alias("spans"), F.sum((F.col("end_s") - F.col("start_s")) * 1000.0).alias("total_ms")
    )
    return totals.join(scores, "trace_id", "left")


# --- rollout --------------------------------------------------------------------------------
def cohort(key: Column, override: Column | None = None, percent: float = 5.0, portable: bool = False) -> Column:
    """``canary`` for a fixed share of hashed client keys; ``always``/``never`` decide outright."""
    if portable:
        slot = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint") % 10_000
    else:
        slot = F.pmod(F.xxhash64(key), F.lit(10_000))
    split = F.when(slot < percent * 100, "canary").otherwise("stable")
    if override is None:
        return split
    return F.when(override == "always", "canary").when(override == "never", "stable").otherwise(split)


def rollback_triggers(requests: DataFrame, window: str = "5 minutes") -> DataFrame:
    """Error rate, exact p95 and lowest faithfulness per cohort and window, with the tripped rules.

    ``requests`` has ``ts``, ``cohort``, ``status_code``, ``duration_ms`` and ``faithfulness``.
    """
    keys = ["window_start", "cohort"]
    rows = requests.withColumn("window_start", F.window("ts", window)["start"])
    base = rows.groupBy(*keys).agg(
        F.count("*").alias("requests"),
        (F.count_if(F.col("status_code") >= 500) / F.count("*")).alias("error_rate"),
        F.min("faithfulness").alias("faithfulness"),
    )
    joined = base.join(exact_percentiles(rows, "duration_ms", {"p95_ms": 0.95}, keys), keys, "left")
    tripped = {
        "errors_tripped": F.col("error_rate") > K.ROLLBACK_ERROR_RATE,
        "latency_tripped": F.coalesce(F.col("p95_ms") > K.ROLLBACK_P95_MS, F.lit(False)),
        "quality_tripped": F.coalesce(F.col("faithfulness") < K.GATE_THRESHOLD, F.lit(False)),
    }
    return joined.withColumns(tripped).withColumn("roll_back", F.col("errors_tripped") | F.col("latency_tripped") | F.col("quality_tripped"))
