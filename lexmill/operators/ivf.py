"""Approximate cosine search: vectors stored by the cell of their nearest centroid, a query looks into a few cells."""

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.operators import dense as D
from lexmill.session import broadcast_if_small, ship_package, stage, staging_root

#: Bounds of a fit: vectors of the sample, bytes of the sample and of the centroids.
SAMPLE = 50_000
SAMPLE_BYTES = 128 << 20
CENTROID_BYTES = 32 << 20
ROUNDS = 8
#: Rows of a cell from which it is split, and the rounds of splitting.
CELL_ROWS = 100_000
SPLITS = 3
#: The cells a query looks into are as many as give this recall of the nearest neighbours of some stored vectors.
RECALL = 0.97
CHECKED = 200
NEIGHBOURS = 10


def spherical_means(x: np.ndarray, k: int, seed: int = 0, rounds: int = ROUNDS) -> np.ndarray:
    """Up to ``k`` unit centroids of the unit rows ``x`` by Lloyd's steps; a centroid nobody is nearest to is left out."""
    if not len(x):
        return x
    start = np.unique(x, axis=0)
    start = start[np.random.default_rng(seed).permutation(len(start))[:k]]
    for _ in range(rounds):
        near = _nearest(x, start, 1)[:, 0]
        sums = np.zeros_like(start)
        np.add.at(sums, near, x)
        start = D.unit_rows(sums[np.bincount(near, minlength=len(start)) > 0])
    return start


def _nearest(x: np.ndarray, centroids: np.ndarray, n: int, rows: int = 4096) -> np.ndarray:
    """Places of the ``n`` nearest centroids of every row, nearest first."""
    out = np.zeros((len(x), n), np.int64)
    for lo in range(0, len(x), rows):
        scores = x[lo : lo + rows] @ centroids.T
        best = np.argpartition(-scores, n - 1, axis=1)[:, :n] if n < len(centroids) else np.argsort(-scores, axis=1)
        order = np.argsort(-np.take_along_axis(scores, best, 1), axis=1, kind="stable")
        out[lo : lo + rows] = np.take_along_axis(best, order, 1)
    return out


def _sampled(vectors: DataFrame, rows: int, seed: int) -> np.ndarray:
    """Unit vectors of at most ``rows`` different chunks, those of the smallest hash."""
    order = F.xxhash64(F.lit(seed), "chunk_id")
    found = vectors.select("embedding", order.alias("_h"), "chunk_id").orderBy("_h", "chunk_id").limit(rows).select("embedding").collect()
    return D.unit_rows(np.array([r.embedding for r in found], dtype=np.float64)) if found else np.zeros((0, 1))


def _cell_samples(placed: DataFrame, cells: list[int], rows: int, seed: int) -> dict[int, np.ndarray]:
    """Unit vectors of each of the ``cells``, at most ``rows`` in all, equally many a cell."""
    order = Window.partitionBy("cell").orderBy(F.xxhash64(F.lit(seed), "chunk_id"), "chunk_id")
    mine = placed.filter(F.col("cell").isin(cells)).withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= max(1, rows // max(1, len(cells))))
    found: dict[int, list] = {}
    for r in (mine.select("cell", "embedding").collect() if cells else []):
        found.setdefault(r.cell, []).append(r.embedding)
    return {cell: D.unit_rows(np.array(x, dtype=np.float64)) for cell, x in sorted(found.items())}


class VectorIndex:
    """Two stored tables: the vectors in one folder a cell, and the cells with their centroids.

    Every vector is stored once, whatever the sample of the fit. The vectors have one length, that of most of them in the
    sample; others take no part, as they could meet no query.
    """

    def __init__(self, vectors: DataFrame, cells: DataFrame, path: str):
        self.vectors, self.cells, self.path = vectors, cells, path

    @classmethod
    def build(
        cls, vectors: DataFrame, path: str | None = None, cells: int | None = None, sample: int = SAMPLE, cell_rows: int = CELL_ROWS, seed: int = 0, recall: float = RECALL
    ) -> "VectorIndex":
        """Fit centroids on a bounded sample, store every vector by cell.

        ``cells`` defaults to the square root of the number of vectors. A cell of more than ``cell_rows`` rows is fitted
        again on a sample of its own and divided; what cannot be divided, as copies of one vector, is stored in several
        files by a hash of the chunk, so no task reads more than a file of it. How many cells a search looks into follows
        from ``recall``: the exact neighbours of some stored vectors tell how many cells hold that share of them.
        """
        spark = vectors.sparkSession
        path = path or f"{staging_root(spark)}/ivf-{uuid.uuid4().hex}"
        whole = vectors.filter(D.whole_vector())
        counted = whole.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
        dim, n = (counted.dim, counted["count"]) if counted else (1, 0)
        whole = whole.filter(F.size("embedding") == dim)
        cells = max(1, min(cells or math.ceil(math.sqrt(n)), CENTROID_BYTES // (8 * dim)))
        sample = max(cells, min(sample, SAMPLE_BYTES // (8 * dim)))
        centroids = spherical_means(_sampled(whole, sample, seed), cells, seed)
        placed = stage(_assigned(whole, centroids), "ivf-assigned")
        for turn in range(SPLITS):
            over = {r.cell: r["count"] for r in placed.groupBy("cell").count().filter(F.col("count") > cell_rows).collect()}  # at most ``cells`` rows
            room, divided = CENTROID_BYTES // (8 * dim) - len(centroids), []
            for cell, x in _cell_samples(placed, sorted(over), sample, seed + turn + 1).items():
                means = spherical_means(x, min(2 * math.ceil(over[cell] / cell_rows), room + 1), seed)
                if len(means) > 1:
                    divided, room = [*divided, (cell, means)], room - len(means) + 1
            if not divided:
                break
            old = [cell for cell, _ in divided]
            for cell, means in divided:
                centroids = np.concatenate([centroids, means[1:]])
                centroids[cell] = means[0]
            # only rows of divided cells may move, and to any nearer centroid
            moved = _assigned(placed.filter(F.col("cell").isin(old)).drop("cell"), centroids)
            placed = stage(placed.filter(~F.col("cell").isin(old)).unionByName(moved), "ivf-assigned")
        placed.limit(0).write.mode("overwrite").parquet(f"{path}/shape")
        _stored(placed, path, cell_rows, "overwrite")
        probes = _probes_for(placed, centroids, recall, seed)
        spark.createDataFrame([(probes, recall)], "probes int, recall double").write.mode("overwrite").parquet(f"{path}/settings")
        counts = placed.groupBy("cell").agg(F.count("*").alias("rows"))
        rows = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "cell int, centroid array<double>")
        rows.join(counts, "cell", "left").fillna(0, ["rows"]).write.mode("overwrite").parquet(f"{path}/cells")
        return cls.load(spark, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "VectorIndex":
        shape = spark.read.parquet(f"{path}/shape").schema  # an index without vectors has no file that tells
        return cls(spark.read.schema(shape).parquet(f"{path}/vectors"), spark.read.parquet(f"{path}/cells"), path)

    def add(self, vectors: DataFrame, cell_rows: int = CELL_ROWS) -> "VectorIndex":
        """Store more vectors in the cells there are; the centroids stay."""
        spark, centroids = vectors.sparkSession, self.centroids()
        new = stage(_assigned(vectors.filter(D.whole_vector() & (F.size("embedding") == centroids.shape[1])), centroids), "ivf-added")
        _stored(new, self.path, cell_rows, "append")
        cells = stage(self.cells.join(new.groupBy("cell").agg(F.count("*").alias("more")), "cell", "left"), "ivf-cells")
        cells.select("cell", "centroid", (F.col("rows") + F.coalesce("more", F.lit(0))).alias("rows")).write.mode("overwrite").parquet(f"{self.path}/cells")
        return VectorIndex.load(spark, self.path)

    def centroids(self) -> np.ndarray:
        rows = self.cells.select("cell", "centroid").orderBy("cell").collect()  # CENTROID_BYTES
        return np.array([r.centroid for r in rows], dtype=np.float64).reshape(len(rows), len(rows[0].centroid) if rows else 1)

    def probes(self) -> int:
        """Cells that reach the recall asked for when the index was built."""
        return self.vectors.sparkSession.read.parquet(f"{self.path}/settings").first().probes

    def search(
        self, queries: DataFrame, limit: int = 20, probes: int | None = None, limit_column: str | None = None, max_query_bytes: int = 32 << 20, max_cells: int = 4 << 20
    ) -> DataFrame:
        """Best ``limit`` chunks per query among the vectors of its ``probes`` nearest cells, scored exactly.

        Arguments and result are those of ``dense_topk``; with as many probes as cells the result is the same. Only the
        folders of the probed cells are read. Vectors are not shuffled, and no pairs are made: a task multiplies the rows
        of a cell with the queries that look into it and keeps the best.
        """
        centroids = self.centroids()
        probes = min(probes or self.probes(), len(centroids))

        def one(part: DataFrame) -> DataFrame:
            if not probes:
                return D.search_pass(self.vectors, [], part, limit, max_cells)
            rows = _probing(part.filter(F.size("embedding") == centroids.shape[1]), centroids, probes).collect()  # a pass: max_query_bytes
            asked: dict[int, list[int]] = {}
            for j, r in enumerate(rows):
                for cell in r.cells:
                    asked.setdefault(cell, []).append(j)
            known = self.vectors if len(asked) == len(centroids) else self.vectors.filter(F.col("cell").isin(sorted(asked)))
            return D.search_pass(known, rows, part, limit, max_cells, {c: np.array(at) for c, at in asked.items()})

        return D.best_per_query(D.in_passes(D.query_side(queries), max_query_bytes, one), queries, limit, limit_column)


def _probes_for(placed: DataFrame, centroids: np.ndarray, recall: float, seed: int) -> int:
    """Least number of nearest cells that hold the share ``recall`` of the neighbours of ``CHECKED`` stored vectors."""
    order = F.xxhash64(F.lit(~seed), "chunk_id")
    asked = placed.select(F.col("chunk_id").alias("query_id"), "embedding", order.alias("_h")).orderBy("_h", "query_id").limit(CHECKED).drop("_h")
    asked = stage(asked.dropDuplicates(["query_id"]), "ivf-asked")
    near = D.dense_topk(placed, asked, NEIGHBOURS + 1).filter("query_id <> chunk_id").select("query_id", "chunk_id")
    rows = placed.select("chunk_id", "cell").join(F.broadcast(near), "chunk_id").join(F.broadcast(asked), "query_id").select("embedding", "cell").collect()
    if not rows:
        return max(1, len(centroids))
    ranked = _nearest(D.unit_rows(np.array([r.embedding for r in rows], dtype=np.float64)), centroids, len(centroids))
    needed = np.sort(np.argmax(ranked == np.array([r.cell for r in rows])[:, None], axis=1)) + 1
    return int(needed[math.ceil(recall * len(needed)) - 1])


def _assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``vectors`` with the number of the nearest centroid as ``cell``."""
    spark = vectors.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(centroids)
    at = vectors.columns.index("embedding")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = _nearest(D.unit_rows(D.matrix_of(batch.column(at))), shared.value, 1)[:, 0]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.int32())], [*batch.schema.names, "cell"])

    schema = vectors.drop("cell").schema.simpleString()[len("struct<") : -1] if "cell" in vectors.columns else vectors.schema.simpleString()[len("struct<") : -1]
    return vectors.drop("cell").mapInArrow(run, f"{schema},cell:int")


def _probing(queries: DataFrame, centroids: np.ndarray, probes: int) -> DataFrame:
    """Each query with the ``cells`` it looks into."""
    ship_package(queries.sparkSession)
    shared = queries.sparkSession.sparkContext.broadcast(centroids)
    at = queries.columns.index("embedding")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = _nearest(D.unit_rows(D.matrix_of(batch.column(at))), shared.value, probes)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.tolist(), pa.list_(pa.int32()))], [*batch.schema.names, "cells"])

    return queries.mapInArrow(run, f"{queries.schema.simpleString()[len('struct<') : -1]},cells:array<int>")


def _stored(placed: DataFrame, path: str, cell_rows: int, mode: str) -> None:
    """One folder a cell; a cell of many rows has several files."""
    parts = placed.groupBy("cell").agg(F.ceil(F.count("*") / cell_rows).cast("int").alias("_parts"))
    spread = placed.join(broadcast_if_small(parts, 100_000), "cell").withColumn("_part", F.pmod(F.xxhash64("chunk_id"), "_parts"))
    spread.repartition("cell", "_part").drop("_part", "_parts").write.mode(mode).option("maxRecordsPerFile", cell_rows).partitionBy("cell").parquet(f"{path}/vectors")
