"""BM25 over a stored postings table."""

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill import constants as K
from lexmill.functions import text as X
from lexmill.session import broadcast_if_small, stage, staging_root, stored_bytes

CHUNK_KEYS = ["chunk_id", "article_number", "paragraph_number", "book", "chapter", "is_repealed"]
CHUNK_ORDER = ["article_number", "paragraph_number", "chunk_id"]
SCORE_DIGITS = 6


def postings(chunks: DataFrame, text: Column | None = None, buckets: int | None = None, **token_options) -> DataFrame:
    """One row per chunk and term: ``tf``, the chunk's length ``dl`` and its filter columns.

    ``head`` is 1 on exactly one row per chunk, so chunk counts need no distinct; a chunk without
    tokens keeps one row with a null term. Length and filters are stored on every row so scoring
    never joins the chunk table. Texts are placed by chunk before they are tokenized: a chunk's
    tokens then meet without shuffling the much wider postings.
    """
    text = F.coalesce("text_ar_normalized", "text_ar") if text is None else text
    placed = chunks.select(*_chunk_keys(chunks), text.alias("body"))
    placed = placed.repartition(buckets, "chunk_id") if buckets else placed.repartition("chunk_id")
    rows = placed.select(*CHUNK_KEYS, X.kept_words(F.col("body"), **token_options).alias("words"))
    words = rows.select(
        *CHUNK_KEYS, F.size("words").alias("dl"), F.posexplode_outer("words").alias("pos", "word")
    )
    return (
        words.groupBy(*CHUNK_KEYS, "dl", X.stem(F.col("word")).alias("term"))
        .agg(F.count("word").alias("tf"), (F.coalesce(F.min("pos"), F.lit(0)) == 0).cast("int").alias("head"))
    )


#: Stored bytes of the tables behind the chunks for which an index has a bucket more.
BUCKET_BYTES = 16 << 20


def bucket_count(chunks: DataFrame, least: int) -> int:
    """The multiple of ``least`` with which a bucket, and so the rows of the task that writes it, stays bounded.

    The size is that of the files below, as Spark's plan states it; sources of unknown size do not count.
    """
    return least * max(1, math.ceil(stored_bytes(chunks) / BUCKET_BYTES / least))


def _chunk_keys(chunks: DataFrame) -> list[Column]:
    kinds = {"paragraph_number": "int", "book": "string", "chapter": "string", "is_repealed": "boolean"}
    return [
        F.col(c) if c in chunks.columns else F.lit(False if c == "is_repealed" else None).cast(kinds[c]).alias(c)
        for c in CHUNK_KEYS
    ]


#: Chunks from which an index keeps the peaks of its ranges and a search leaves ranges out.
PRUNED_FROM = 1_000_000


def placed_table(df: DataFrame, path: str, buckets: int, order: list[str], write: bool = True) -> DataFrame:
    """A stored table that knows its place: rows of a chunk are in one bucket, so sums by chunk need no exchange.

    ``df`` should be in ``buckets`` partitions by chunk already, as ``postings`` leaves it, or a bucket has several files.
    The files are an external table of the session's catalog under a name of their own; ``write`` off only names them.
    """
    spark, name = df.sparkSession, f"lexmill_placed_{uuid.uuid4().hex}"
    if write:
        rows = df.write.bucketBy(buckets, "chunk_id").sortBy(*order)
        rows.mode("overwrite").option("path", path).saveAsTable(name)
        spark.range(0, 1, 1, 1).select(F.lit(buckets).alias("buckets")).write.mode("overwrite").parquet(f"{path}-layout")
        df.limit(0).write.mode("overwrite").parquet(f"{path}-shape")  # a table without rows has no file that tells its columns
    else:
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (chunk_id) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def stored_placed_table(spark: SparkSession, path: str) -> DataFrame:
    return placed_table(spark.read.parquet(f"{path}-shape"), path, spark.read.parquet(f"{path}-layout").first().buckets, [], write=False)


class LexicalIndex:
    """Stored tables: postings, term statistics, one row of corpus totals, the chunks' keys, and peaks of ranges.

    A search reads the totals, the small term table and the postings columns it needs; nothing is
    counted again. The chunk table is sorted by article, so a lookup of some numbers skips row groups. The postings may
    come in several parts, each with all terms of its chunks.
    """

    def __init__(self, parts: list[DataFrame], term_table: DataFrame, totals: DataFrame, chunk_table: DataFrame, peaks: DataFrame | None = None):
        self.parts, self.term_table, self.totals, self.chunk_table, self.peaks = parts, term_table, totals, chunk_table, peaks

    @property
    def postings(self) -> DataFrame:
        out = self.parts[0]
        for part in self.parts[1:]:
            out = out.unionByName(part)
        return out

    @classmethod
    def build(cls, chunks: DataFrame, path: str | None = None, buckets: int | None = None, pruned: bool | None = None, **options) -> "LexicalIndex":
        """Tokenize once and store; a chunk's postings are in one bucket, sorted by term.

        ``pruned`` adds the peaks: for each term and range of chunks the greatest frequency and the least length, from
        which a search tells ranges that cannot reach a question's best; by default from ``PRUNED_FROM`` chunks on. A
        range is one of ``buckets`` parts; it is stored as several buckets once a bucket would have more than
        ``BUCKET_BYTES`` of the input.
        """
        spark = chunks.sparkSession
        path = path or f"{staging_root(spark)}/lexical-{uuid.uuid4().hex}"
        buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

        def keep(df: DataFrame, name: str) -> DataFrame:
            df.write.mode("overwrite").parquet(f"{path}/{name}")
            return spark.read.schema(df.schema).parquet(f"{path}/{name}")

        stored = bucket_count(chunks, buckets)
        found = postings(chunks, buckets=stored, **options).withColumn("range", F.pmod(F.hash("chunk_id"), F.lit(buckets)))
        rows = placed_table(found, f"{path}/postings", stored, ["term"])
        sums = stage(rows.groupBy("term").agg(F.count("*").alias("df"), F.sum("head").alias("heads"), F.sum("tf").alias("tokens")), "term-sums")
        counted = sums.agg(F.sum("heads").alias("n_chunks"), F.sum("tokens").alias("n_tokens"))
        terms = keep(sums.filter("term IS NOT NULL").select("term", "df"), "terms")
        totals = keep(with_means(counted, terms), "totals")
        chunk_rows = keep(rows.filter("head = 1").select(*CHUNK_KEYS, "dl").sortWithinPartitions("article_number"), "chunks")
        peaks = None
        if pruned or (pruned is None and (totals.first().n_chunks or 0) >= PRUNED_FROM):
            peaks = keep(range_peaks(rows), "peaks")
        return cls([rows], terms, totals, chunk_rows, peaks)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "LexicalIndex":
        peaks = spark.read.parquet(f"{path}/peaks") if path_exists(spark, f"{path}/peaks") else None
        tables = [spark.read.parquet(f"{path}/{name}") for name in ("terms", "totals", "chunks")]
        return cls([stored_placed_table(spark, f"{path}/postings")], *tables, peaks)

    def corpus(self) -> DataFrame:
        """One row: chunk count, token count and mean length."""
        return self.totals.select("n_chunks", "n_tokens", "avgdl")

    def documents(self) -> DataFrame:
        return self.chunk_table

    def terms(self, epsilon: float = K.BM25_EPSILON) -> DataFrame:
        """Document frequency and idf per term; negative idf becomes epsilon times the mean idf."""
        known = self.totals.first()
        raw = raw_idf(F.lit(known.n_chunks))
        return self.term_table.withColumn("raw_idf", raw).withColumn("idf", F.when(raw < 0, F.lit(epsilon) * known.mean_idf).otherwise(raw))

    def query_terms(self, queries: DataFrame, synonyms=K.SYNONYMS, **token_options) -> DataFrame:
        """Query terms with how often each occurs in the expanded question."""
        expanded = X.expand_query(F.col("question"), synonyms)
        words = queries.select("query_id", F.explode(X.kept_words(expanded, **token_options)).alias("word"))
        return words.groupBy("query_id", X.stem(F.col("word")).alias("term")).agg(F.count("*").alias("qtf"))

    def search(
        self,
        queries: DataFrame,
        limit: int = 20,
        k1: float = K.BM25_K1,
        b: float = K.BM25_B,
        epsilon: float = K.BM25_EPSILON,
        synonyms=K.SYNONYMS,
        limit_column: str | None = None,
        **token_options,
    ) -> DataFrame:
        """Best chunks per query with the score divided by the query's best.

        ``queries`` holds ``query_id``, ``question`` and optionally a ``filters`` struct. Query
        weights are a small table: staged, checked, and broadcast to the postings scan, so the
        postings are shuffled only as (query, chunk) partial sums. A batch too large for that is
        joined by term with the runtime's skew handling.
        """
        weights = self.query_terms(queries, synonyms, **token_options).join(
            self.terms(epsilon).select("term", "idf"), "term"
        )
        extra = [c for c in ("filters", limit_column) if c and c in queries.columns]
        if extra:
            weights = weights.join(queries.select("query_id", *extra), "query_id")
        weights = stage(weights, "query-terms")
        avgdl = self.corpus().select("avgdl").scalar()

        def gain(tf: str, dl: str) -> Column:
            return F.col("qtf") * F.col("idf") * F.col(tf) * (k1 + 1) / (F.col(tf) + k1 * (1 - b + b * F.col(dl) / avgdl))

        keys = ["query_id", *CHUNK_ORDER] + ([limit_column] if limit_column else [])

        side = broadcast_if_small(weights, max_rows=1_000_000)

        def scored(pairs: DataFrame | None = None, ranges: list[int] | None = None) -> DataFrame:
            """Sums of the gains by question and chunk, of ``pairs`` of a question and a range alone where they are given.

            Each part of the postings is summed where it lies.
            """
            near, out = None if pairs is None else broadcast_if_small(pairs, max_rows=1_000_000), None
            for part in self.parts:
                part = part.filter("term IS NOT NULL")
                part = part if ranges is None else part.filter(F.col("range").isin(ranges))
                hits = part.join(side, "term")
                hits = hits if near is None else hits.join(near, ["query_id", "range"])
                if "filters" in extra:
                    hits = hits.filter(matches_filters(article_numbers=True))
                sums = hits.groupBy(*keys).agg(F.sum(gain("tf", "dl")).alias("raw")).filter("raw > 0")
                out = sums if out is None else out.unionByName(sums)
            return out.withColumn("raw", F.round("raw", SCORE_DIGITS))

        order = Window.partitionBy("query_id").orderBy(F.desc("raw"), *CHUNK_ORDER)

        def cut(rows: DataFrame) -> DataFrame:
            return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)

        if self.peaks is None:
            top = cut(scored())
        else:
            top = cut(self._pruned(weights, gain, scored, cut, limit))
        if limit_column:
            top = top.filter(F.col("rank") <= F.col(limit_column))
        best = F.max("raw").over(Window.partitionBy("query_id"))
        score = F.coalesce(F.col("raw") / F.nullif(best, F.lit(0.0)), F.lit(0.0))  # a best that rounds to 0 divides nothing
        return top.withColumn("score", score).select(
            "query_id", "rank", *CHUNK_ORDER, "raw", "score"
        )

    def _pruned(self, weights: DataFrame, gain, scored, cut, limit: int) -> DataFrame:
        """Scores of all chunks that can be among a question's ``limit`` best.

        What a range can reach at most is the sum of the gains of its greatest frequencies at its least lengths. The
        range that promises most is scored first; its ``limit``-th score is a bound that other ranges must be able to
        reach. Ranges that cannot are not read for the question, and files of ranges that no question needs are skipped.
        """
        reach = self.peaks.join(broadcast_if_small(weights, max_rows=1_000_000), "term")
        reach = reach.groupBy("query_id", "range").agg(F.sum(F.greatest(gain("tf", "dl"), F.lit(0.0))).alias("most"))
        reach = stage(reach.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("most", "range")), False).alias("ranges")), "query-ranges")

        def asked(pairs: DataFrame) -> tuple[DataFrame, list[int]]:
            pairs = stage(pairs, "query-ranges-asked")
            return pairs, [r.range for r in pairs.select("range").distinct().collect()]  # the ranges of the index

        first = stage(scored(*asked(reach.select("query_id", F.col("ranges")[0]["range"].alias("range")))), "first-range")
        bound = cut(first).groupBy("query_id").agg(F.when(F.count("*") == limit, F.min("raw")).alias("bound"))
        rest = reach.select("query_id", F.explode(F.slice("ranges", 2, F.size("ranges"))).alias("r")).join(bound, "query_id", "left")
        rest = rest.filter(F.col("bound").isNull() | (F.col("r.most") >= F.col("bound") - 10.0 ** -SCORE_DIGITS))
        return first.unionByName(scored(*asked(rest.select("query_id", "r.range"))))


def raw_idf(n: Column) -> Column:
    return F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)


def with_means(counted: DataFrame, terms: DataFrame) -> DataFrame:
    """The corpus counts with the mean length of a chunk and the mean idf of a term."""
    n = counted.select("n_chunks").scalar()
    mean = terms.agg(F.avg(raw_idf(n)).alias("m")).scalar()
    return counted.withColumns({"avgdl": F.col("n_tokens") / F.nullif("n_chunks", F.lit(0)), "mean_idf": mean})


def range_peaks(rows: DataFrame) -> DataFrame:
    return rows.filter("term IS NOT NULL").groupBy("term", "range").agg(F.max("tf").alias("tf"), F.min("dl").alias("dl"))


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def matches_filters(article_numbers: bool) -> Column:
    """Row predicate of a per-query filter struct; null fields match everything."""
    f = F.col("filters")
    keep = (
        (~F.coalesce(f["exclude_repealed"], F.lit(False)) | ~F.coalesce("is_repealed", F.lit(False)))
        & (f["book"].isNull() | (F.col("book") == f["book"]))
        & (f["chapter"].isNull() | (F.col("chapter") == f["chapter"]))
    )
    if article_numbers:
        keep = keep & (f["article_numbers"].isNull() | F.array_contains(f["article_numbers"], F.col("article_number")))
    return keep
