"""Structured Streaming jobs over documents, requests, vectors, tokens and questions."""

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from lexmill import constants as K
from lexmill.functions import text as X
from lexmill.operators import monitor as M
from lexmill.plans.answering import screen
from lexmill.plans.ingest import Embedder, reindex
from lexmill.session import ship_package


def reindex_stream(
    documents: DataFrame, store: str, checkpoint: str, model_id: str, dim: int, embed: Embedder,
    corpus_hash: str = "dynamic", available_now: bool = True, **options,
) -> StreamingQuery:
    """Re-index documents as they arrive; each batch is the newest write of its collection.

    The write is named by the query's id, which its checkpoint keeps, and the batch: a batch replayed after a
    failure keeps its number, and a query with a new checkpoint writes after all that is stored.
    """
    def apply(batch: DataFrame, batch_id: int) -> None:
        query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        reindex(batch.sparkSession, batch, store, model_id, dim, embed, corpus_hash, writer=f"{query}:{batch_id}", **options)

    writer = documents.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def request_metrics(
    requests: DataFrame, window: str = "5 minutes", slide: str | None = None, late: str = "10 minutes",
    keys: list[str] | None = None, bounds: list[float] = K.LATENCY_BUCKETS, accuracy: int = 10_000,
) -> DataFrame:
    """Rolling counts, error rate, histogram and the 95th percentile per window: from the buckets and from a sketch.

    State per window and key is a fixed set of counters and a mergeable quantile sketch, however heavy the traffic.
    ``p95_value`` is a duration whose rank is off by at most one ``accuracy``-th of the window's requests, so the exact
    one up to that many requests.
    """
    keys = keys or ["endpoint"]
    rows = requests.withColumn("endpoint", X.endpoint_template(F.col("endpoint")))
    span = F.window("ts", window, slide) if slide else F.window("ts", window)
    counted = rows.withWatermark("ts", late).groupBy(span.alias("w"), *keys).agg(
        *M.bucket_columns(F.col("duration_s"), bounds), F.count_if(F.col("status_code") >= 500).alias("errors"),
        F.percentile_approx("duration_s", 0.95, accuracy).alias("p95_value"),
    )
    return counted.select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys,
        F.col("total").alias("requests"), (F.col("errors") / F.col("total")).alias("error_rate"),
        *[F.col(f"le_{i}") for i in range(len(bounds))],
        M.quantile_from_buckets(0.95, bounds).alias("p95"), "p95_value",
    )


def drift_windows(vectors: DataFrame, center: list[float], window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Mean, least and greatest distance to a fixed centroid per event-time window."""
    timed = vectors.withColumn("distance", M.cosine_distance(F.col("embedding"), F.lit(center)))
    return timed.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w")).agg(
        F.count("*").alias("sample_size"), F.avg("distance").alias("mean_cosine_distance"),
        F.min("distance").alias("distance_min"), F.max("distance").alias("distance_max"),
    ).select("w.start", "w.end", "sample_size", "mean_cosine_distance", "distance_min", "distance_max")


def drift_ks_windows(
    vectors: DataFrame, baseline: DataFrame, window: str = "1 hour", late: str = "10 minutes", cells: int = 64,
    threshold: float = K.DRIFT_THRESHOLD, digits: int | None = None,
) -> DataFrame:
    """Drift against a fixed baseline per event-time window, the Kolmogorov-Smirnov test included.

    The baseline's distances are cut into ``cells`` at their quantiles once; a window's state is one counter a cut. The
    statistic lies between ``ks_low`` and ``ks_high``, which differ by no more than what either sample has in one cell,
    and the p-value between those of the two. ``drift_detected`` is decided by ``ks_low``: it is never set by the test alone
    unless the exact test sets it. Rows later than ``late`` behind the newest are left out, others are counted.
    """
    centers = M.centroid(baseline)
    center = centers.first().centroid
    distance = M.cosine_distance(F.col("embedding"), F.lit(center))
    distance = distance if digits is None else F.round(distance, digits)
    cuts, shares, n = M.baseline_cells(baseline.select(distance.alias("distance")), "distance", cells)
    timed = vectors.withColumn("distance", distance).withWatermark("ts", late)
    counted = timed.groupBy(F.window("ts", window).alias("w")).agg(
        F.count("distance").alias("sample_size"), F.avg("distance").alias("mean_cosine_distance"),
        *[F.count_if(F.col("distance") <= c).alias(f"c{i}") for i, c in enumerate(cuts)],
    ).filter("sample_size > 0")
    low, high = M.ks_bounds([F.col(f"c{i}") for i in range(len(cuts))], F.col("sample_size"), shares)
    rows = counted.select("w.start", "w.end", "sample_size", "mean_cosine_distance", low.alias("ks_low"), high.alias("ks_high"))
    size = F.lit(n)
    rows = rows.withColumns({f"ks_p_{a}": M.ks_probability(F.col(f"ks_{b}"), F.col("sample_size"), size) for a, b in (("high", "low"), ("low", "high"))})
    mean = F.col("mean_cosine_distance")
    return rows.withColumn("drift_detected", (mean > threshold) | ((F.col("ks_p_high") < K.DRIFT_P) & (mean > K.DRIFT_MEAN)))


def drift_batches(vectors: DataFrame, baseline: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Full drift report, with the KS test, per micro-batch; one folder per batch id."""
    def apply(batch: DataFrame, batch_id: int) -> None:
        M.drift_report(batch, baseline).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return vectors.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


ANSWER_SCHEMA = "trace_id string, answer string, n_tokens long, closed_by string"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class AnswerAssembly(StatefulProcessor):
    """Tokens of open traces as they came, and when a trace closes by itself.

    A batch writes the tokens it brings in one call, and one deadline a trace; what came before is not written again. A
    trace that closes in the batch that brings its tokens writes nothing. Of tokens with one sequence number the last counts.
    """

    def __init__(self, idle_ms: int, longest_ms: int | None):
        self.idle_ms, self.longest_ms = idle_ms, longest_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tokens = handle.getListState("tokens", "seq int, data string")
        self.times = handle.getValueState("times", "opened long, deadline long")

    def handleInputRows(self, key, rows, timerValues):
        done, opened, last, tokens = False, None, 0, []
        for frame in rows:
            events = frame["event"].to_numpy()
            part = events == "token"
            tokens += [(int(seq), data) for seq, data in zip(frame["seq"].to_numpy()[part], frame["data"].to_numpy()[part], strict=True)]
            done = done or bool((events == "done").any())
            opened = min(x for x in (opened, int(frame["ts"].min().timestamp() * 1000)) if x is not None)
            last = max(last, int(frame["ts"].max().timestamp() * 1000))
        if done:
            yield self._closed(key, "done", tokens)
            return
        if tokens:
            self.tokens.appendList(tokens)
        known = self.times.get() if self.times.exists() else None
        opened = min(opened, known[0]) if known else opened
        deadline = max(last, timerValues.getCurrentWatermarkInMs(), known[1] - self.idle_ms if known else 0) + self.idle_ms
        if self.longest_ms is not None:
            deadline = min(deadline, opened + self.longest_ms)
        if known is None or known[1] != deadline:
            if known:
                self.handle.deleteTimer(known[1])
            self.handle.registerTimer(deadline)
        self.times.update((opened, deadline))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield self._closed(key, "timeout", [])

    def _closed(self, key, by: str, last: list[tuple]) -> pd.DataFrame:
        found = {}
        if self.times.exists():  # written whenever tokens are
            found.update(self.tokens.get())
            self.handle.deleteTimer(self.times.get()[1])
            self.tokens.clear()
            self.times.clear()
        found.update(last)
        tokens = sorted(found.items())
        return pd.DataFrame({"trace_id": [key[0]], "answer": ["".join(t for _, t in tokens)], "n_tokens": [len(tokens)], "closed_by": [by]})

    def close(self) -> None:
        pass


def assemble_answers(events: DataFrame, idle: str = "10 minutes", longest: str | None = None) -> DataFrame:
    """Answers from token events ``(trace_id, seq, ts, event, data)``.

    A trace closes on its ``done`` event, or when the watermark passes its last token by the idle time or, with
    ``longest``, its first one by that time. State is the open traces' tokens with their sequence numbers: a token that
    comes again takes its own place. The state store must be RocksDB; the session is set to it.
    """
    ms = lambda text: int(pd.Timedelta(text).total_seconds() * 1000)
    ship_package(events.sparkSession)
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    return events.withWatermark("ts", idle).groupBy("trace_id").transformWithStateInPandas(
        AnswerAssembly(ms(idle), ms(longest) if longest else None), outputStructType=ANSWER_SCHEMA, outputMode="append", timeMode="eventTime"
    )


def screen_stream(questions: DataFrame, **options) -> DataFrame:
    """Redaction and small-talk tagging are stateless, so the batch columns serve a stream."""
    return screen(questions, **options)


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is available, into a table, and read it back."""
    spark: SparkSession = stream.sparkSession
    query = (
        stream.writeStream.outputMode(mode).format("parquet").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
