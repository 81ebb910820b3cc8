"""Exact cosine search of query batches over a vector table."""

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.operators.lexical import CHUNK_KEYS, CHUNK_ORDER, SCORE_DIGITS
from lexmill.session import ship_package, stage

FILTER_FIELDS = ["exclude_repealed", "book", "chapter"]


def dense_topk(
    vectors: DataFrame,
    queries: DataFrame,
    limit: int = 20,
    limit_column: str | None = None,
    max_query_bytes: int = 32 << 20,
    max_cells: int = 4 << 20,
) -> DataFrame:
    """Exact top ``limit`` chunks per query by cosine.

    Each task multiplies its Arrow batches with the query matrix and keeps the best ``limit`` rows
    per query, so tasks emit at most queries x limit rows whatever the corpus size. The query
    matrix travels to the tasks and is bounded by ``max_query_bytes``; a larger batch is cut into
    that many passes over the vectors, each stored before the next is collected, so the driver holds
    one pass at a time. A task never holds more than ``max_cells`` scores. Rows and queries without a
    vector take no part, and vectors of one length meet only those of the same; no query gives no row. ``queries`` holds ``query_id``, ``embedding`` and
    optionally a ``filters`` struct whose article numbers are not applied in this branch.
    """
    found = in_passes(query_side(queries), max_query_bytes, lambda part: search_pass(vectors.filter(whole_vector()), part.collect(), part, limit, max_cells))
    return best_per_query(found, queries, limit, limit_column)


def query_side(queries: DataFrame) -> DataFrame:
    """``query_id, embedding`` and the filter columns of the questions that have a vector."""
    if "filters" in queries.columns:
        flags = [F.col("filters")[f].alias(f) for f in FILTER_FIELDS]
    else:
        flags = [F.lit(False).alias("exclude_repealed")] + [F.lit(None).cast("string").alias(f) for f in FILTER_FIELDS[1:]]
    return queries.select("query_id", "embedding", *flags).filter(whole_vector())


def in_passes(side: DataFrame, max_query_bytes: int, search: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``search`` of the questions, or of as many parts of them as keep a part's vectors within the bytes; parts are stored."""
    size = side.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("d")).first()
    passes = max(1, math.ceil((size.n or 0) * (size.d or 1) * 8 / max_query_bytes))
    if passes == 1:
        return search(side)
    found = None
    for turn in range(passes):
        one = stage(search(side.filter(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == turn)), "dense-pass")
        found = one if found is None else found.unionByName(one)
    return found


def best_per_query(found: DataFrame, queries: DataFrame, limit: int, limit_column: str | None) -> DataFrame:
    """The ``limit`` best rows of each query among those that the tasks kept."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), *CHUNK_ORDER)
    top = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
    if limit_column:
        top = top.join(queries.select("query_id", limit_column), "query_id").filter(F.col("rank") <= F.col(limit_column))
    return top.select("query_id", "rank", *CHUNK_ORDER, "score")


def whole_vector() -> Column:
    """Rows whose vector is there and has no null in it."""
    return (F.size("embedding") > 0) & ~F.exists("embedding", lambda x: x.isNull())


class _Best:
    """Best rows so far of a tile of queries, as flat arrays cut back when they have doubled."""

    def __init__(self, queries: int, limit: int):
        self.limit, self.floor = limit, np.full(queries, -np.inf)
        self.parts: list[tuple] = []
        self.size, self.room = 0, max(100_000, 4 * queries * limit)

    def add(self, query, score, article, paragraph, chunk) -> None:
        self.parts.append((query, score, article, paragraph, chunk))
        self.size += len(query)
        if self.size > self.room:
            self.cut()

    def cut(self) -> tuple:
        if not self.parts:
            return ()
        query, score, article, paragraph, chunk = (np.concatenate(x) for x in zip(*self.parts))
        order = np.lexsort((chunk, paragraph, article, -score, query))
        query = query[order]
        first = np.searchsorted(query, query, "left")
        keep = np.arange(len(query)) - first < self.limit
        order = order[keep]
        kept = tuple(x[order] for x in (np.concatenate(c) for c in zip(*self.parts)))
        self.parts, self.size = [kept], len(order)
        ends = np.flatnonzero(np.diff(np.append(kept[0], -1)) != 0)
        full = ends[np.bincount(kept[0], minlength=len(self.floor))[kept[0][ends]] >= self.limit]
        self.floor[kept[0][full]] = kept[1][full]
        return kept


def search_pass(
    vectors: DataFrame, rows: list, queries: DataFrame, limit: int, max_cells: int, probed: dict[int, np.ndarray] | None = None
) -> DataFrame:
    """Best ``limit`` vectors of each task for the queries ``rows``, whose number the caller bounds.

    ``probed`` gives for each cell of the vectors' ``cell`` column the sorted places of the queries that look into it;
    without it every query meets every vector.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    id_type = queries.schema["query_id"].dataType.simpleString()
    schema = f"query_id {id_type}, article_number int, paragraph_number int, chunk_id string, score double"
    if not rows:
        return spark.createDataFrame([], schema)
    groups: dict[tuple, list[int]] = {}
    for j, r in enumerate(rows):
        groups.setdefault((len(r.embedding), bool(r.exclude_repealed), r.book, r.chapter), []).append(j)
    blocks = [(key, np.array(at), unit_rows(np.array([rows[j].embedding for j in at], dtype=np.float64))) for key, at in groups.items()]
    shared = spark.sparkContext.broadcast(([r.query_id for r in rows], blocks, probed))

    def local_best(batches):
        ids, blocks, probed = shared.value
        best = _Best(len(ids), limit)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            table = {c: batch.column(c) for c in batch.schema.names}
            lengths = pc.list_value_length(table["embedding"]).to_numpy(zero_copy_only=False)
            flags = {c: np.array(table[c].to_pylist(), dtype=object) for c in ("is_repealed", "book", "chapter")}
            article, paragraph = (_filled(table[c]) for c in ("article_number", "paragraph_number"))
            chunk = np.array(table["chunk_id"].to_pylist(), dtype=object)
            cell = table["cell"].to_numpy() if probed is not None else np.zeros(batch.num_rows, np.int64)
            for (dim, no_repealed, book, chapter), members, matrix in blocks:
                keep = lengths == dim
                if no_repealed:
                    keep &= flags["is_repealed"] != True  # noqa: E712
                if book is not None:
                    keep &= flags["book"] == book
                if chapter is not None:
                    keep &= flags["chapter"] == chapter
                for one in np.unique(cell[keep]):
                    at = np.flatnonzero(keep & (cell == one))
                    asked = np.arange(len(members)) if probed is None else np.flatnonzero(np.isin(members, probed.get(int(one), ())))
                    x = unit_rows(matrix_of(table["embedding"].take(pa.array(at))))
                    width = max(1, min(len(asked), 4096))
                    height = max(1, max_cells // width)
                    for m in range(0, len(asked), width):
                        tile = members[asked[m : m + width]]
                        q = matrix[asked[m : m + width]].T
                        for lo in range(0, len(at), height):
                            block = at[lo : lo + height]
                            scores = np.round(x[lo : lo + height] @ q, SCORE_DIGITS)
                            floor = best.floor[tile]
                            if len(block) > limit:
                                floor = np.maximum(floor, np.partition(scores, len(block) - limit, axis=0)[len(block) - limit])
                            i, j = np.nonzero(scores >= floor)
                            best.add(tile[j], scores[i, j], article[block][i], paragraph[block][i], chunk[block][i])
        kept = best.cut()
        if kept:
            out = [(ids[j], _unfilled(int(a)), _unfilled(int(p)), c, float(s)) for j, s, a, p, c in zip(*kept)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), type=t) for c, t in zip(zip(*out), _arrow_types(id_type))],
                names=["query_id", "article_number", "paragraph_number", "chunk_id", "score"],
            )

    cells = ["cell"] if probed is not None else []
    flat = vectors.select(*[c for c in CHUNK_KEYS if c in vectors.columns], *_absent(vectors), "embedding", *cells)
    return flat.mapInArrow(local_best, schema)


def _absent(vectors: DataFrame) -> list:
    kinds = {"article_number": "int", "paragraph_number": "int", "book": "string", "chapter": "string", "is_repealed": "boolean"}
    return [F.lit(None).cast(k).alias(c) for c, k in kinds.items() if c not in vectors.columns]


NULL = np.iinfo(np.int64).min  # sorts first, as nulls do in the final window


def _filled(column) -> np.ndarray:
    return np.array([NULL if v is None else v for v in column.to_pylist()], dtype=np.int64)


def _unfilled(value: int) -> int | None:
    return None if value == NULL else value


def matrix_of(column) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1)


def unit_rows(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(size == 0, 1e-12, size)


def _arrow_types(id_type: str) -> list:
    ids = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[id_type]
    return [ids, pa.int32(), pa.int32(), pa.string(), pa.float64()]
