"""Typed readers. Schemas are explicit and malformed input fails the job."""

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexmill.schemas import ARTICLE, EVAL_QUESTION, LAYOUT_SPAN
from lexmill.session import ship_package, stage

FILE_ORDER = ["file_path", "block_start", "line_pos"]


def read_articles(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Article rows from ``json`` files (arrays or objects), ``jsonl`` or ``parquet``.

    A JSON file is cut at the ends of its records, so one large array is read by as many tasks as its size gives.
    """
    if fmt == "parquet":
        rows = spark.read.schema(ARTICLE).parquet(path)
    elif fmt == "json":
        rows = read_json_records(spark, path, ARTICLE)
    else:
        rows = spark.read.schema(ARTICLE).option("mode", "FAILFAST").json(path)
    return fill_articles(rows)


def json_records(spark: SparkSession, path: str) -> DataFrame:
    """``record`` (text), ``file_path`` and ``place`` of every outermost object in files of JSON arrays or objects.

    The files are read in pieces that end with a closing brace, wherever a split falls. Whether a piece starts inside
    a string follows from the quotes before it, whether its brace closes a record from the braces before it that are
    outside of strings. A first pass sums both over each split, for either start; sums over the splits then tell how each
    one starts, and a second pass cuts the records. Texts stay in their tasks; only what a split's ends cut of a record is
    shuffled. A file that ends inside a record, or has text between records, fails the job.
    """
    ship_package(spark)
    pieces = spark.read.option("lineSep", "}").text(path).select(
        F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("size"),
    )
    splits = stage(pieces.mapInArrow(_split_sums, SPLIT_SUMS), "json-splits")
    before = Window.partitionBy("file_path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row a split
    whole = Window.partitionBy("file_path")

    def shift(count) -> Column:
        return F.coalesce(F.sum(count).over(before), F.lit(0))

    inside = shift("odd") % 2 == 1
    starts = splits.withColumn("inside", inside).withColumn("s", F.when(F.col("inside"), F.col("within")).otherwise(F.col("outside")))
    starts = starts.withColumn("depth", shift(F.col("s.change")))
    starts = starts.withColumn("place", shift(F.when(F.col("s.low") == -F.col("depth"), F.col("s.times")).otherwise(0)))
    # a last piece without a brace behind it is one byte too long; the mark at the start of a file is not among the pieces
    total, last = F.sum("bytes").over(whole), F.max("block").over(whole)
    starts = starts.withColumn("open", (F.col("block") == last) & ((total > F.col("size")) | (total == F.col("size") - 2)))
    # one row a split, as the driver's own list of them
    known = pieces.drop("size").join(F.broadcast(starts.select("file_path", "block", "inside", "depth", "place", "open")), ["file_path", "block"])
    inner, cut = (known.mapInArrow(_cutter(kind), CUT_RECORD) for kind in (True, False))
    text = F.array_sort(F.collect_list(F.struct("block", F.col("value").cast("string").alias("value"), F.col("bare").cast("string").alias("bare"))))
    found = cut.groupBy("file_path", "place").agg(text.alias("parts"), F.max("ends").alias("ends"))
    joined, rest = (F.array_join(F.col(f"parts.{c}"), "}") for c in ("value", "bare"))
    record = F.when(F.col("ends") & rest.rlike(r"^[\s,\[]*\{"), F.concat(F.regexp_replace(joined, r"^[\s,\[]*", ""), F.lit("}")))
    # what the last brace of a file leaves must be the end of the array alone
    record = record.when(~F.col("ends") & rest.rlike(r"^[\s\]\[]*$"), F.lit(None)).otherwise(F.raise_error(F.concat(F.lit("not a whole JSON record in "), "file_path")))
    found = found.select("file_path", "place", record.alias("record")).filter("record IS NOT NULL")
    return inner.select("file_path", "place", F.col("value").cast("string").alias("record")).unionByName(found)


SPLIT_SUMS = (
    "file_path string, block long, size long, bytes long, odd long, "
    "outside struct<change: long, low: long, times: long>, within struct<change: long, low: long, times: long>"
)
CUT_RECORD = "file_path string, place long, block long, ends boolean, value binary, bare binary"
_ESCAPED, _QUOTED = re.compile(rb"\\[^\n\r]"), re.compile(rb'"[^"]*"?')
_BETWEEN, _OPENING = re.compile(rb"[\s,\[]*"), re.compile(rb"[\s,\[]*\{")


def _bare(value: bytes, inside: bool) -> tuple[bytes, bool]:
    """A piece with its strings emptied, and whether it ends inside of one. An escape never spans two pieces."""
    plain = _ESCAPED.sub(b"", value) if b"\\" in value else value
    ends = inside ^ (plain.count(b'"') % 2 == 1)
    if inside:
        plain = plain.partition(b'"')[2]
    return _QUOTED.sub(b'""', plain), ends


def _rows(batches, names: list[str]):
    for batch in batches:
        yield from zip(*[batch.column(n).to_pylist() for n in names])


def _split_sums(batches):
    """For each split: bytes and quotes, and for either start the change in depth, the lowest depth after a closing
    brace and how often it is met. Records end at depth 0, the lowest there is in a whole file."""
    out, key, sums = [], None, None
    for file, block, size, value in _rows(batches, ["file_path", "block", "size", "value"]):
        if key != (file, block):
            key, sums = (file, block), [0, 0, (False, [0, None, 0]), (True, [0, None, 0])]
            out.append((file, block, size, sums))
        sums[0] += len(value) + 1
        for k in (2, 3):
            inside, s = sums[k]
            bare, ends = _bare(value, inside)
            s[0] += bare.count(b"{") - (not ends)
            if not ends:
                if s[1] is None or s[0] < s[1]:
                    s[1:] = s[0], 0
                s[2] += s[0] == s[1]
            sums[k] = (ends, s)
    state = lambda s: dict(zip(("change", "low", "times"), s[1]))
    rows = [(f, b, n, s[0], int(s[2][0]), state(s[2]), state(s[3])) for f, b, n, s in out]
    names = ("file_path", "block", "size", "bytes", "odd", "outside", "within")
    kind = pa.struct([("change", pa.int64()), ("low", pa.int64()), ("times", pa.int64())])
    types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), kind, kind)
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=list(names))


def _cutter(inner: bool):
    """Records that lie within a split, or else what its ends leave of others, and whatever is not a record."""
    def cut(batches):
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary())
        names = ["file_path", "place", "block", "ends", "value", "bare"]
        key, held, parts, bares = None, None, [], []
        inside, depth, place, fresh = False, 0, 0, True
        out = []

        def put(ends: bool) -> None:
            bare = b"}".join(bares)
            if (whole := ends and fresh and _OPENING.match(bare) is not None) == inner:
                value = b"}".join(parts)
                out.append((key[0], place, key[1], ends, _BETWEEN.sub(b"", value, count=1) + b"}" if whole else value, None if whole else bare))
            parts.clear()
            bares.clear()

        def take(value: bytes, closed: bool) -> None:
            nonlocal inside, depth, place, fresh
            bare, inside = _bare(value, inside)
            parts.append(value)
            bares.append(bare)
            depth += bare.count(b"{") - (not inside)
            if closed and not inside and depth == 0:
                put(True)
                place, fresh = place + 1, True

        def leave(unclosed: bool) -> None:
            if key is not None:
                take(held, not unclosed)
                if parts:
                    put(False)

        unclosed = False
        for batch in batches:
            for file, block, value, *start, opened in _rows([batch], ["file_path", "block", "value", "inside", "depth", "place", "open"]):
                if key != (file, block):
                    leave(unclosed)
                    key, unclosed = (file, block), opened
                    inside, depth, place = start
                    fresh = depth == 0 and not inside
                else:
                    take(held, True)
                held = value
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)
                out.clear()
        leave(unclosed)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    return cut


def read_json_records(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Typed rows of files of JSON arrays or objects, read by split; a malformed record fails the job."""
    return json_records(spark, path).select(F.from_json("record", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def fill_articles(rows: DataFrame) -> DataFrame:
    """Defaults of optional fields."""
    none = F.array().cast("array<int>")
    return rows.withColumns(
        {"is_repealed": F.coalesce("is_repealed", F.lit(False)), "references": F.coalesce("references", none)}
    )


def stream_articles(spark: SparkSession, path: str, fmt: str = "json", max_files: int = 1000) -> DataFrame:
    """The same rows from files as they arrive."""
    reader = spark.readStream.schema(ARTICLE).option("maxFilesPerTrigger", max_files)
    if fmt != "parquet":
        reader = reader.option("mode", "FAILFAST").option("multiLine", fmt == "json")
    return fill_articles(reader.format("parquet" if fmt == "parquet" else "json").load(path))


def read_eval_questions(spark: SparkSession, path: str, subset: str = "all", ci_size: int = 20) -> DataFrame:
    """Evaluation questions from JSON lines with their file order; blank lines are skipped.

    ``ci`` keeps the first flagged questions in file order. The order is (file, block, line) and
    needs no global numbering.
    """
    if subset not in ("all", "full", "ci"):
        raise ValueError(f"unknown subset: {subset}")
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("line_pos"),
    )
    parsed = F.from_json("value", EVAL_QUESTION, {"mode": "FAILFAST"})
    rows = lines.filter(F.trim("value") != "").select(parsed.alias("q"), *FILE_ORDER).select("q.*", *FILE_ORDER)
    rows = rows.withColumns(
        {
            "ground_truth_articles": F.coalesce("ground_truth_articles", F.array().cast("array<int>")),
            "is_refusal_expected": F.coalesce("is_refusal_expected", F.lit(False)),
            "is_ci_subset": F.coalesce("is_ci_subset", F.lit(False)),
        }
    )
    if subset == "ci":
        rows = rows.filter("is_ci_subset").orderBy(*FILE_ORDER).limit(ci_size)
    return rows


def read_layout_spans(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LAYOUT_SPAN).parquet(path)


def file_fingerprint(spark: SparkSession, path: str) -> DataFrame:
    """First eight hex digits of each file's SHA-256."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.substring(F.sha2("content", 256), 1, 8).alias("fingerprint"))


def table_fingerprint(rows: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Order-free fingerprint of a table: row digests are summed on the map side.

    Unlike the file fingerprint it does not depend on row order or file layout.
    """
    def text(c: str) -> Column:
        col = F.col(c)
        return F.coalesce(F.to_json(col) if rows.schema[c].dataType.typeName() in ("array", "struct", "map") else col.cast("string"), F.lit("~"))

    row = F.md5(F.concat_ws("|", *[text(c) for c in (columns or rows.columns)]))
    digest = F.conv(F.substring(row, 1, 15), 16, 10).cast("decimal(38,0)")
    total = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(digest), F.lit(0)).alias("s"))
    return total.select(
        F.col("n").alias("rows"), F.substring(F.sha2(F.concat_ws(":", "n", F.col("s").cast("decimal(38,0)")), 256), 1, 8).alias("fingerprint")
    )
