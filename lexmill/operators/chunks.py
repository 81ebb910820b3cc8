"""Articles to chunks, chunks to vectors, and the stored vector table."""

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.functions import text as X
from lexmill.functions.vectors import hash_embedding, point_id
from lexmill.schemas import CHUNK_COLUMNS
from lexmill.session import broadcast_if_small, fits, setting, stage, stored_bytes, unstage

COLLECTION = ["model_id", "dim", "corpus_hash"]


def chunk_articles(
    articles: DataFrame,
    strategy: str = "article_paragraph",
    max_chars: int = 1200,
    overlap: int = 100,
    text_column: str = "text_ar",
) -> DataFrame:
    """One row per chunk: short articles whole, long ones by paragraph with both languages paired.

    The shorter language repeats its last paragraph. ``max_chars`` only decides whether to split
    and ``overlap`` is accepted without effect, as in the behaviour this follows. With a ``corpus_id``
    column the chunk ids begin with it, so equal numbers of several corpora stay apart.
    """
    if strategy not in ("article", "article_paragraph"):
        raise ValueError(f"unknown chunk strategy: {strategy}")
    ar, en = X.strip(F.coalesce(text_column, F.lit(""))), X.strip(F.coalesce("text_en", F.lit("")))
    rows = articles.withColumns({"_ar": ar, "_en": en})
    whole = F.lit(True) if strategy == "article" else F.length("_ar") <= max_chars
    rows = rows.withColumns(
        {
            "_whole": whole,
            "_ar_parts": F.when(whole, F.array("_ar")).otherwise(X.paragraphs(F.col("_ar"))),
            "_en_parts": F.when(whole, F.array("_en")).otherwise(X.paragraphs(F.col("_en"))),
        }
    )
    rows = rows.withColumn("total_paragraphs", F.greatest(F.size("_ar_parts"), F.size("_en_parts")))

    def part(parts: str, i: Column) -> Column:
        return F.element_at(parts, F.least(i, F.size(parts)))

    pieces = F.transform(
        F.sequence(F.lit(1), F.col("total_paragraphs")),
        lambda i: F.struct(
            i.alias("_i"), part("_ar_parts", i).alias("text_ar"), part("_en_parts", i).alias("text_en")
        ),
    )
    kept = [c for c in rows.columns if c not in ("text_ar", "text_en", text_column, "_ar", "_en", "_ar_parts", "_en_parts")]
    chunks = rows.select(*kept, F.inline(pieces))
    number, i = F.col("article_number"), F.col("_i")
    named = [F.coalesce(F.col("corpus_id").cast("string"), F.lit("")), F.lit(":")] if "corpus_id" in rows.columns else []
    chunks = chunks.withColumns(
        {
            "chunk_id": F.concat(*named, F.lit("art_"), number, F.when(F.col("_whole"), "").otherwise(F.concat(F.lit("_p"), i))),
            "citation": F.when(F.col("_whole"), F.col("citation")).otherwise(F.concat("citation", F.lit(", Paragraph "), i)),
            "paragraph_number": F.when(~F.col("_whole"), i),
            "text_ar_normalized": X.normalize(F.col("text_ar")),
        }
    )
    extra = [c for c in ("corpus_id", "version") if c in chunks.columns]
    return chunks.select(*extra, *[c for c in CHUNK_COLUMNS if c in chunks.columns])


def embed_by_hash(chunks: DataFrame, dim: int, mode: str = "ar") -> DataFrame:
    """Offline embedding: a deterministic vector of the text, computed without Python."""
    text = X.embedding_text(mode, F.col("text_ar_normalized"), F.col("text_en"))
    vector = F.transform(hash_embedding(text, dim), lambda v: v.cast("float"))
    return chunks.withColumns({"point_id": point_id(F.col("chunk_id")), "embedding": vector})


def embed_with_model(
    rows: DataFrame,
    make_predict_fn,
    mode: str = "ar",
    prefix: str = "",
    batch_size: int = 64,
    text: Column | None = None,
) -> DataFrame:
    """Embed with a user's model: ``make_predict_fn`` loads it once per Python worker.

    The returned function maps an array of texts to an array of vectors. Pass ``text`` for
    tables that are not chunks, such as questions with their own prefix.
    """
    from pyspark.ml.functions import predict_batch_udf

    predict = predict_batch_udf(
        make_predict_fn, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size
    )
    if text is None:
        text = X.embedding_text(mode, F.col("text_ar_normalized"), F.col("text_en"), prefix)
    elif prefix:
        text = F.concat(F.lit(prefix), text)
    out = rows.withColumn("embedding", predict(text))
    return out.withColumn("point_id", point_id(F.col("chunk_id"))) if "chunk_id" in rows.columns else out


def model_dimension(spark: SparkSession, make_predict_fn, probe: str = "probe") -> int:
    """Vector length of a model, from one probe text."""
    one = spark.createDataFrame([(probe,)], "t string")
    return len(embed_with_model(one, make_predict_fn, text=F.col("t")).first().embedding)


def latest_by_id(rows: DataFrame, key: str = "point_id", version: str = "version") -> DataFrame:
    """Last write per key. ``max_by`` combines on the map side, so a hot key is not collected."""
    others = [c for c in rows.columns if c != key]
    newest = rows.groupBy(key).agg(F.max_by(F.struct(*others), F.col(version)).alias("_r"))
    return newest.select(key, "_r.*").select(*rows.columns)


def collection_name(model_id: str, dim: int, corpus_hash: str, prefix: str = "corpus") -> str:
    """Readable name of a (model, dimension, corpus) triple with unsafe characters replaced."""
    import re

    return re.sub(r"[^a-zA-Z0-9_\-]", "_", f"{prefix}_{model_id}_{dim}_{corpus_hash}")


def manifest(vectors: DataFrame) -> DataFrame:
    """Which collections exist, how many points they hold, and rows of a wrong dimension."""
    return vectors.groupBy(*COLLECTION).agg(
        F.count("*").alias("points"),
        F.count_if(F.size("embedding") != F.col("dim")).alias("bad_dimension"),
    )


def table_exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(hadoop)


def read_vectors(spark: SparkSession, path: str, model_id: str, dim: int, corpus_hash: str) -> DataFrame:
    """One collection of the stored table; the filter prunes partitions."""
    return spark.read.parquet(path).filter(
        (F.col("model_id") == model_id) & (F.col("dim") == dim) & (F.col("corpus_hash") == corpus_hash)
    )


def article_key(df: DataFrame) -> list[str]:
    return [c for c in ("corpus_id", "article_number") if c in df.columns]


def stored_buckets(spark: SparkSession, path: str) -> DataFrame | None:
    """Bucket count of each stored collection, one row a collection, from the folder names."""
    if not table_exists(spark, path):
        return None
    return spark.read.parquet(path).select(*COLLECTION, F.col("buckets").alias("_stored")).distinct()


def next_version(
    spark: SparkSession, path: str, model_id: str, dim: int, corpus_hash: str, writer: str | None = None, anytime: bool = True
) -> int:
    """Number of the next write of a collection. A ``writer`` that is stored already gets its own number again;
    with ``anytime`` off only if nothing was written since."""
    if not table_exists(spark, path):
        return 0
    have = read_vectors(spark, path, model_id, dim, corpus_hash)
    row = have.agg(F.max("version").alias("last"), F.max(F.when(F.col("writer") == F.lit(writer), F.col("version"))).alias("own")).first()
    if row.own is not None and (anytime or row.own == row.last):
        return row.own
    return 0 if row.last is None else row.last + 1


#: Most files a write makes without shuffling its rows to their buckets first.
MOST_FILES = 20_000


def upsert_vectors(
    spark: SparkSession,
    path: str,
    rows: DataFrame,
    buckets: int = 64,
    replace_by_article: bool = False,
    replace_collection: bool = False,
) -> None:
    """Merge ``rows`` into the stored table: new rows are new files, old files are rewritten only if they lose rows.

    Rows carry the collection columns, ``point_id`` and ``version``. Rows of an article share a bucket,
    whatever the call, and the bucket count is part of the stored layout: a collection keeps the count of its
    first write. Which rows lose is decided by ids and versions alone. Everything is written beside the table and put
    in its place when whole, new files before old ones go: a failed write can be replayed, the next one drops what it
    left twice. ``replace_by_article`` also drops stored chunks of the incoming articles that were
    not resent, ``replace_collection`` all stored rows of the incoming collections.
    """
    place = [*COLLECTION, "buckets", "bucket"]
    rows = rows if "writer" in rows.columns else rows.withColumn("writer", F.lit(None).cast("string"))
    known = stored_buckets(spark, path)
    if known is None:
        keyed = rows.withColumn("buckets", F.lit(buckets).cast("int"))
    else:
        keyed = rows.join(broadcast_if_small(known), COLLECTION, "left")
        keyed = keyed.withColumn("buckets", F.coalesce("_stored", F.lit(buckets)).cast("int")).select(*rows.columns, "buckets")
    keyed = keyed.withColumn("bucket", F.pmod(F.xxhash64(*article_key(rows)), F.col("buckets")).cast("int"))
    beside = f"{path.rstrip('/')}-new-{uuid.uuid4().hex}"
    incoming = _write_placed(keyed, f"{beside}/sent", place, buckets)
    merged, extra, stale = _at(incoming), False, None
    if known is not None and not replace_collection:
        old = _at(_touched_part(spark.read.parquet(path), incoming.select(*place).distinct(), place))
        extra = set(old.columns) != set(merged.columns)  # files of other columns are written again with all of them
        if replace_by_article:
            # a stored paragraph is stale only against a newer write of its article
            sent = incoming.groupBy(*COLLECTION, *article_key(incoming)).agg(F.max("version").alias("_sent"))
            old = old.join(broadcast_if_small(sent, 1_000_000), [*COLLECTION, *article_key(incoming)], "left")
            live = F.col("_sent").isNull() | F.coalesce(F.col("version") > F.col("_sent"), F.lit(False))
            stale, old = old.filter(~live).select("_path", "_row"), old.filter(live).drop("_sent")
        merged = old.unionByName(merged, allowMissingColumns=True)
    lost = _losers(merged, place)
    lost = lost if stale is None else stale if lost is None else lost.unionByName(stale)
    gone = set()
    if lost is not None:
        lost = stage(lost, "upsert-lost")
        gone = {r._path for r in lost.select("_path").distinct().collect()}  # files of the touched buckets
    if extra:
        gone = {r._path for r in merged.select("_path").distinct().collect()}
    if gone:
        kept = merged.filter(F.col("_path").isin(list(gone)))
        if lost is not None:
            ids = lost.select(F.xxhash64("_path").alias("_file"), "_row")
            kept = kept.withColumn("_file", F.xxhash64("_path")).join(broadcast_if_small(ids, 2_000_000), ["_file", "_row"], "left_anti")
        _write_placed(kept.drop("_path", "_row", "_file"), f"{beside}/kept", place, buckets)
    if replace_collection and known is not None:
        have = spark.read.parquet(path).select("*", F.col("_metadata.file_path").alias("_path"))
        gone |= {r._path for r in have.join(F.broadcast(incoming.select(*COLLECTION).distinct()), COLLECTION, "left_semi").select("_path").distinct().collect()}
    _put_in_place(spark, beside, path, gone)
    if lost is not None:
        unstage(lost)


def _write_placed(df: DataFrame, folder: str, place: list[str], buckets: int) -> DataFrame:
    """``df`` in a folder a bucket. A task writes to all buckets it has rows of at once, without a sort or a shuffle, unless
    that made too many files."""
    spark = df.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, stored_bytes(df) >> 27)
    if tasks * buckets > MOST_FILES:
        df = df.hint("rebalance", *[F.col(c) for c in place])
    with setting(spark, "spark.sql.maxConcurrentOutputFileWriters", str(min(buckets, 64) + 1)):
        df.write.partitionBy(*place).option("compression", "zstd").parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def _at(stored: DataFrame) -> DataFrame:
    """Stored rows with their file and their place in it."""
    return stored.select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.row_index").alias("_row"))


def _losers(merged: DataFrame, place: list[str]) -> DataFrame | None:
    """``_path, _row`` of rows that are not the last write of their point; equal versions are told apart by content.

    Points that occur once, by far the most, are found without their rows' content.
    """
    key = {"_none": F.col("point_id").isNull(), "_id": F.coalesce("point_id", F.lit(0))}
    keys = [*place, *key]
    again = merged.withColumns(key).groupBy(*keys).agg(F.count("*").alias("_n"), F.size(F.collect_set("version")).alias("_v"))
    again = stage(again.filter("_n > 1").select(*keys, (F.col("_v") < F.col("_n")).alias("_tie")), "upsert-again")
    if again.isEmpty():
        unstage(again)
        return None
    others = [c for c in merged.columns if c not in (*place, "point_id", "version", "_path", "_row")]
    content = F.xxhash64(*others) if not again.filter("_tie").isEmpty() else F.lit(0).cast("long")
    rows = merged.withColumns(key).join(broadcast_if_small(again.drop("_tie"), 1_000_000), keys).withColumn("_content", content)
    newest = Window.partitionBy(*keys).orderBy(F.desc("version"), F.desc("_content"), "_path", "_row")
    return rows.select(*keys, "version", "_content", "_path", "_row").withColumn("_place", F.row_number().over(newest)).filter("_place > 1").select("_path", "_row")


def _put_in_place(spark: SparkSession, beside: str, path: str, gone: set[str]) -> None:
    """Move the files written beside the table into it, then delete those that they replace."""
    hadoop, uri = spark._jvm.org.apache.hadoop.fs.Path, spark._jvm.java.net.URI
    fs = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    old = [fs.makeQualified(hadoop(uri(p))) for p in gone]
    again, made = {p.toString() for p in old}, set()  # a task's files have one name in all folders
    for part in ("sent", "kept"):
        root = hadoop(f"{beside}/{part}")
        files = fs.listFiles(root, True) if fs.exists(root) else None
        top = fs.makeQualified(root).toString() if files else ""
        while files and files.hasNext():
            file = files.next().getPath()
            if not file.getName().endswith(".parquet") or fs.makeQualified(file).toString() in again:
                continue
            folder = path.rstrip("/") + file.getParent().toString()[len(top) :]
            if folder not in made:
                fs.mkdirs(hadoop(folder))
                made.add(folder)
            if not fs.rename(file, hadoop(hadoop(folder), file.getName())):
                raise OSError(f"could not move {file.toString()} to {folder}")
    for p in old:
        fs.delete(p, False)
    fs.delete(hadoop(beside), True)


def _touched_part(stored: DataFrame, touched: DataFrame, place: list[str], bound: int = 10_000) -> DataFrame:
    """Stored rows of the touched buckets; a short list becomes a filter that prunes partitions."""
    if not fits(touched, bound):
        return stored.join(touched, place, "left_semi")
    groups: dict[tuple, list[int]] = {}
    for row in touched.collect():
        groups.setdefault(tuple(row)[:-1], []).append(row.bucket)
    wanted = F.lit(False)
    for collection, buckets in groups.items():
        same = F.col("bucket").isin(buckets)
        for name, value in zip(place[:-1], collection):
            same = same & (F.col(name) == value)
        wanted = wanted | same
    return stored.filter(wanted)  # a bucket count in the folder names is fixed by the collection


def suggested_buckets(n_rows: int, rows_per_bucket: int = 2_000_000) -> int:
    """Bucket count that keeps one bucket's rewrite within a task's memory."""
    return max(1, math.ceil(n_rows / rows_per_bucket))
