import datetime as dt
import time
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lexmill.operators import chunks as C
from lexmill.operators import monitor as M
from lexmill.plans import ingest as I
from lexmill.streaming import streams as Z


def stored(spark, store):
    return {r.chunk_id: (r.version, r.text_en) for r in C.read_vectors(spark, store, "hash", 8, "base").collect()}


def test_ingest_is_idempotent_and_reindex_merges(spark, articles, tmp_path):
    store, embed = str(tmp_path / "v"), I.hash_embedder(8)
    first = I.ingest(spark, articles, store, "hash", 8, embed, "base", max_chars=70, buckets=4)
    assert first["status"] == "indexed_successfully" and first["chunks_count"] == 4
    assert I.ingest(spark, articles, store, "hash", 8, embed, "base")["status"] == "skipped_already_exists"
    new = articles.filter("article_number = 147").withColumns({"article_number": F.lit(1150), "text_en": F.lit("New.")})
    changed = articles.filter("article_number = 148").withColumns({"text_ar": F.lit("قصير"), "text_en": F.lit("Short.")})
    out = I.reindex(spark, new.unionByName(changed), store, "hash", 8, embed, "base", buckets=4)
    assert out["new_articles_count"] == 2 and out["new_chunks_count"] == 2
    rows = stored(spark, store)
    assert rows["art_1150"] == (1, "New.") and rows["art_148"] == (1, "Short.") and "art_148_p1" in rows  # stale chunks stay by default
    assert stored(spark, store) == rows
    I.reindex(spark, new.unionByName(changed), store, "hash", 8, embed, "base", buckets=4)
    assert stored(spark, store) == rows
    m = C.manifest(spark.read.parquet(store)).first()
    assert (m.points, m.bad_dimension) == (6, 0)


def test_replace_by_article_drops_stale_chunks(spark, articles, tmp_path):
    store, embed = str(tmp_path / "v"), I.hash_embedder(8)
    options = dict(buckets=4, replace_by_article=True)
    I.reindex(spark, articles, store, "hash", 8, embed, "base", version=0, max_chars=70, **options)
    changed = articles.filter("article_number = 148").withColumn("text_ar", F.lit("قصير"))
    I.reindex(spark, changed, store, "hash", 8, embed, "base", version=1, **options)
    assert sorted(stored(spark, store)) == ["art_147", "art_148", "art_54"]


def test_files_that_lose_no_row_are_not_written_again(spark, tmp_path):
    path, files = str(tmp_path / "t"), lambda: {str(f) for f in (tmp_path / "t").rglob("*.parquet")}
    rows = spark.range(0, 40, 1, 1).selectExpr("'m' model_id", "1 dim", "'a:b' corpus_hash", "cast(id as int) article_number", "id point_id", "0L version", "'old' t")
    C.upsert_vectors(spark, path, rows, buckets=4)
    first = files()
    again = rows.filter("point_id = 7").unionByName(rows.filter("point_id = 7")).withColumns({"version": F.lit(1).cast("bigint"), "t": F.lit("new")})
    C.upsert_vectors(spark, path, again.unionByName(rows.filter("point_id = 7").withColumn("point_id", F.lit(99).cast("bigint"))), buckets=9)
    found = {r.point_id: (r.version, r.t) for r in spark.read.parquet(path).collect()}
    assert found == {**{i: (0, "old") for i in range(40)}, 7: (1, "new"), 99: (0, "old")}
    assert len(first & files()) == len(first) - 1 and spark.read.parquet(path).count() == 41
    assert [f.name for f in tmp_path.iterdir()] == ["t"] and {r.buckets for r in spark.read.parquet(path).select("buckets").collect()} == {4}


def test_latest_wins(spark):
    rows = spark.createDataFrame([(1, 1, "old"), (1, 3, "new"), (1, 2, "mid"), (2, 1, "x")], "point_id long, version long, t string")
    assert {(r.point_id, r.t) for r in C.latest_by_id(rows).collect()} == {(1, "new"), (2, "x")}


def test_stream_metrics_equal_batch(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(start + dt.timedelta(seconds=20 * i), f"/articles/{i % 4}", 500 if i % 10 == 0 else 200, (i % 30) / 10) for i in range(300)]
    frame = spark.createDataFrame(rows, "ts timestamp, endpoint string, status_code int, duration_s double")
    frame.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    got = Z.drain(Z.request_metrics(stream), str(tmp_path / "out"), str(tmp_path / "ck"))
    batch = Z.request_metrics(frame)
    closed = batch.filter(F.col("window_end") <= F.lit(rows[-1][0] - dt.timedelta(minutes=10)))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, closed.collect())) and got.count() > 5


def test_stream_answers_close_on_done_or_timeout(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("a", 1, t0, "token", "x"), ("a", 2, t0, "token", "y"), ("a", 3, t0, "done", "{}"), ("b", 1, t0, "token", "z"), ("c", 1, t0 + dt.timedelta(hours=2), "done", "{}")]
    schema = "trace_id string, seq int, ts timestamp, event string, data string"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    got = {r.trace_id: (r.answer, r.closed_by) for r in Z.drain(Z.assemble_answers(stream), str(tmp_path / "o"), str(tmp_path / "c")).collect()}
    assert got == {"a": ("xy", "done"), "b": ("z", "timeout"), "c": ("", "done")}


def test_drift_batches(spark, tmp_path):
    base = spark.createDataFrame([([1.0, 0.01 * i],) for i in range(20)], "embedding array<double>")
    base.write.parquet(str(tmp_path / "in"))
    Z.drift_batches(spark.readStream.schema(base.schema).parquet(str(tmp_path / "in")), base, str(tmp_path / "o"), str(tmp_path / "c")).awaitTermination()
    row = spark.read.parquet(str(tmp_path / "o")).first()
    assert row.batch_id == 0 and row.drift_detected is False


def test_screening(spark):
    rows = spark.createDataFrame([("mail a@b.com",), ("hello you",)], "question string")
    got = Z.screen_stream(rows).collect()
    assert got[0].question == "mail [EMAIL_REDACTED]" and got[0].pii_redacted and got[1].intent == "greeting"
    with pytest.raises(Exception):
        Z.screen_stream(spark.createDataFrame([(1,)], "x int")).collect()


def test_stream_ks_bounds_hold_the_exact_statistic(spark, tmp_path):
    rng = np.random.default_rng(4)
    start = dt.datetime(2024, 1, 1)
    base = [([float(x) for x in rng.normal(size=6)],) for _ in range(400)]
    moved = [(start + dt.timedelta(minutes=3 * i), [float(x) for x in rng.normal(size=6) + i / 60]) for i in range(160)]
    late = [(start + dt.timedelta(minutes=4), [float(x) for x in rng.normal(size=6)])]  # far behind the newest when it comes
    baseline = spark.createDataFrame(base, "embedding array<double>")
    for name, rows in (("a", moved[:100]), ("b", late), ("c", moved[100:])):
        spark.createDataFrame(rows, "ts timestamp, embedding array<double>").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)  # files are read in the order of their times
    stream = spark.readStream.schema("ts timestamp, embedding array<double>").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = Z.drain(Z.drift_ks_windows(stream, baseline, cells=16), str(tmp_path / "o"), str(tmp_path / "c")).orderBy("start").collect()
    center = M.centroid(baseline).first().centroid
    distance = lambda x: 1 - np.dot(x, center) / np.linalg.norm(x)
    b = np.sort([distance(x) for (x,) in base])
    assert len(got) > 5 and sum(r.sample_size for r in got) % 20 == 0  # the late row is in no window
    for r in got:
        w = np.sort([distance(x) for t, x in moved if r.start <= t < r.end])
        at = np.concatenate([b, w])
        exact = np.abs(np.searchsorted(w, at, "right") / len(w) - np.searchsorted(b, at, "right") / len(b)).max()
        assert r.sample_size == len(w) and r.ks_low - 1e-9 <= exact <= r.ks_high + 1e-9
        in_cell = np.diff([0, *[(w <= c).sum() / len(w) for c in np.quantile(b, np.arange(1, 16) / 16, method="inverted_cdf")], 1]).max()
        assert r.ks_high - r.ks_low <= max(in_cell, 1 / 16) + 1e-6 and r.ks_p_low <= r.ks_p_high
    assert got[-1].drift_detected and not got[0].drift_detected


def test_stream_answers_grow_over_batches(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    at = lambda minutes: t0 + dt.timedelta(minutes=minutes)
    schema = "trace_id string, seq int, ts timestamp, event string, data string"
    batches = [
        [("a", 2, at(0), "token", "b"), ("slow", 1, at(0), "token", "0")],
        [("a", 1, at(1), "token", "a"), ("a", 2, at(1), "token", "b"), ("slow", 2, at(8), "token", "1")],
        [("a", 3, at(9), "token", "c"), ("slow", 3, at(16), "token", "2")],
        [("a", 4, at(12), "done", "{}"), ("slow", 4, at(24), "token", "3")],
        [("slow", 5, at(32), "token", "4"), ("z", 1, at(60), "done", "{}")],
        [("z", 1, at(90), "done", "{}")],
    ]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)  # files are read in the order of their times

    def answers(name, **options):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        rows = Z.drain(Z.assemble_answers(stream, **options), str(tmp_path / f"{name}-o"), str(tmp_path / f"{name}-c")).collect()
        return {(r.trace_id, r.answer, r.n_tokens, r.closed_by) for r in rows if r.trace_id != "z"}

    assert answers("idle") == {("a", "abc", 3, "done"), ("slow", "01234", 5, "timeout")}
    first = [x for x in answers("limit", longest="1 minute") if x[0] == "slow"]
    assert len(first) > 1 and "".join(sorted(x[1] for x in first)) == "01234" and {x[3] for x in first} == {"timeout"}


class CountedState:
    """A state handle that counts what a trace asks of it."""

    def __init__(self):
        self.calls, self.value, self.rows, self.timers = 0, None, [], []

    def _counted(self, do):
        def call(*args):
            self.calls += 1
            return do(*args)

        return call

    def getListState(self, name, schema):
        clear, add = self._counted(lambda: self.rows.clear()), self._counted(lambda rows: self.rows.extend(rows))
        return SimpleNamespace(get=self._counted(lambda: iter(list(self.rows))), appendList=add, clear=clear)

    def getValueState(self, name, schema):
        put = self._counted(lambda x: setattr(self, "value", x))
        return SimpleNamespace(exists=self._counted(lambda: self.value is not None), get=self._counted(lambda: self.value), update=put, clear=lambda: put(None))

    def registerTimer(self, at):
        self.calls += 1
        self.timers.append(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.remove(at)


def test_stream_answers_ask_little_of_the_state(spark):
    t0 = pd.Timestamp(2024, 1, 1)
    frame = lambda seqs, event="token": pd.DataFrame({"trace_id": "a", "seq": seqs, "ts": t0, "event": event, "data": [f"<{s}>" for s in seqs]})
    now = SimpleNamespace(getCurrentWatermarkInMs=lambda: 0)
    state, trace = CountedState(), Z.AnswerAssembly(600_000, None)
    trace.init(state)
    whole = list(trace.handleInputRows(("a",), [frame(range(1000)), frame([1000], "done")], now))
    assert whole[0].n_tokens[0] == 1000 and state.calls <= 2 and state.rows == []
    state.calls = 0
    assert list(trace.handleInputRows(("a",), [frame(range(500))], now)) == []
    assert list(trace.handleInputRows(("a",), [frame(range(400, 1000))], now)) == [] and state.calls <= 12 and len(state.timers) == 1
    row = list(trace.handleExpiredTimer(("a",), now, None))[0]
    assert row.answer[0] == "".join(f"<{k}>" for k in range(1000)) and row.closed_by[0] == "timeout"
    assert state.rows == [] and state.value is None and state.timers == []
