"""What the operators of this package share: reading texts, scratch tables, Arrow batches by bytes."""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.session import ship_package, stage


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def bounded_batches(spark: SparkSession, rows: int = 2_000) -> None:
    """Fewer rows an Arrow batch than Spark's default of 10,000, as rows are whole documents here.

    A value other than the default is somebody's choice and stays.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name, "10000") == "10000":
        spark.conf.set(name, str(rows))


def texts(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` alone, a null text as the empty one: other columns cannot clash."""
    ship_package(docs.sparkSession)
    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def labelled_sample(docs: DataFrame, known: DataFrame, per_label: int, longest: int) -> DataFrame:
    """``doc_id, label, text`` of a bounded sample: of each label of ``known`` the ``per_label`` rows of smallest hash.

    Only their ids travel, two labels of ``per_label`` each; of texts over ``longest`` characters none is used, and of
    rows that share a doc_id the first text in order.
    """
    ids = None
    for label in (0, 1):
        top = known.filter(F.col("label") == label).distinct().orderBy(F.xxhash64("doc_id", F.lit("fit")), "doc_id").limit(per_label)
        ids = top if ids is None else ids.union(top)
    return texts(docs).join(F.broadcast(ids), "doc_id").filter(F.length("text") <= longest).groupBy("doc_id", "label").agg(
        F.min("text").alias("text")
    )


def scratch(df: DataFrame, label: str) -> DataFrame:
    """A written table under spark.checkpoint.dir: read again after a lost executor, not computed again."""
    return stage(df, label)


def drop_scratch(df: DataFrame) -> None:
    """Remove the files of a scratch table that nothing reads any more."""
    spark = df.sparkSession
    for name in df.inputFiles()[:1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(name).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def by_bytes(batch: pa.RecordBatch, column: str = "text", limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts come to ``limit`` bytes; a longer text is a run of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)


def per_batch(fn: Callable[[pa.RecordBatch], pa.RecordBatch], limit: int = 4 << 20):
    """A mapInArrow function that hands ``fn`` runs of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, limit=limit):
                out = fn(part)
                if out is not None and out.num_rows:
                    yield out

    return run


def keep_rows(docs: DataFrame, keep: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """Rows of ``docs``, all columns, whose text ``keep`` marks; a null text is judged as the empty one.

    Map-side only. Columns travel by place under plain names, so their own names may repeat or clash. The runs are
    small: a worker that has ended keeps its memory for a minute, beside the stage that follows.
    """
    ship_package(docs.sparkSession)
    bounded_batches(docs.sparkSession)
    at = docs.columns.index("text")
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, f"c{at}", limit=1 << 20):
                out = part.filter(pa.array(keep(pc.fill_null(part.column(at), ""))))
                if out.num_rows:
                    yield out

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
