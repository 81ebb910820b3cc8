"""Positioned text spans to structured articles, for any number of documents at once.

Work is keyed by page wherever a whole document could be large; the only per-document steps run
over article headers, which are at most one per article number.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill import constants as K
from lexmill.functions import text as X
from lexmill.session import fits

DOC = "doc_id"
ORDER = ["page", "y", "block", "line", "span"]
LEVELS = ["book", "part", "chapter", "section", "topic"]
END_OF_PAGE = 1e18


def is_furniture(text: Column) -> Column:
    """Running page numbers, page footers and blank lines."""
    return (F.length(X.strip(text)) == 0) | X.strip(text).rlike(f"(?i){K.FURNITURE_PATTERN}")


def column_lines(spans: DataFrame, gutter: float = 15.0) -> DataFrame:
    """Lines of the two text columns: whole lines by their box, crossing lines span by span."""
    piece = F.struct("span", "x0", "y0", X.strip(F.col("text")).alias("text"))
    lines = (
        spans.filter("block_type = 0")
        .groupBy(DOC, "page", "block", "line", "line_x0", "line_y0", "line_x1", "page_width")
        .agg(F.array_sort(F.collect_list(piece)).alias("pieces"))
        .withColumn("pieces", F.filter("pieces", lambda p: F.length(p["text"]) > 0))
        .withColumn("whole", F.array_join(F.transform("pieces", lambda p: p["text"]), " "))
        .filter(~is_furniture(F.col("whole")))
    )
    middle = F.col("page_width") / 2.0

    def row(side, y, span, text) -> Column:
        return F.struct(side.alias("side"), y.alias("y"), span.alias("span"), text.alias("text"))

    def whole(side: str) -> Column:
        return F.array(row(F.lit(side), F.col("line_y0"), F.lit(0), F.col("whole")))

    crossing = F.transform(
        F.filter("pieces", lambda p: ~is_furniture(p["text"])),
        lambda p: row(F.when(p["x0"] < middle, "en").otherwise("ar"), p["y0"], p["span"], p["text"]),
    )
    placed = (
        F.when(F.col("line_x1") < middle, whole("en"))
        .when(F.col("line_x0") >= middle - gutter, whole("ar"))
        .otherwise(crossing)
    )
    return lines.select(DOC, "page", "block", "line", F.inline(placed))


def header_candidates(lines: DataFrame, reach: float = 30.0) -> DataFrame:
    """English lines that open with an article number.

    Lines that go on like running text count only with an Arabic marker near them on the page.
    """
    opening = rf"(?i)^(?:Article|rticle)[{K.WS}]*([0-9]+)(?![{K.WORD}])"
    found = lines.filter((F.col("side") == "en") & F.col("text").rlike(opening)).withColumns(
        {
            "n": F.regexp_extract("text", opening, 1).try_cast("int"),
            "rest": X.strip(F.regexp_replace("text", opening, "")),
        }
    )
    running = F.col("rest").rlike(f"[{K.WS}]") | F.col("rest").startswith(".")
    markers = lines.filter((F.col("side") == "ar") & F.col("text").rlike(K.ARABIC_MARKER_PATTERN)).select(
        DOC, "page", F.col("y").alias("marker_y")
    )
    near = found.filter(running).join(
        markers,
        [found[DOC] == markers[DOC], found["page"] == markers["page"], F.abs(F.col("marker_y") - found["y"]) < reach],
        "left_semi",
    )
    return found.filter(~running).unionByName(near).select(DOC, *ORDER, "n")


def _step(last: Column, n: Column) -> Column:
    """Next accepted number: 1 first, then a small step up, or a long one after fixed numbers."""
    limit = F.when(last.isin(*K.HEADER_LONG_STEP_AFTER), K.HEADER_LONG_STEP).otherwise(K.HEADER_STEP)
    return F.when((last == 0) & (n == 1), n).when((last > 0) & (n > last) & (n <= last + limit), n).otherwise(last)


def _accepted(candidates: Column, start: Column) -> Column:
    """Candidates a scan from ``start`` accepts, in order."""
    kind = "array<struct<page:int,y:double,block:int,line:int,span:int,n:int>>"
    begin = F.struct(start.cast("int").alias("last"), F.array().cast(kind).alias("kept"))

    def scan(acc: Column, c: Column) -> Column:
        new = _step(acc["last"], c["n"])
        return F.struct(
            new.cast("int").alias("last"),
            F.when(new != acc["last"], F.concat(acc["kept"], F.array(c))).otherwise(acc["kept"]).alias("kept"),
        )

    return F.aggregate(candidates, begin, scan, lambda acc: acc["kept"])


def select_headers(candidates: DataFrame, max_group: int = 20_000, pages_per_segment: int = 16, segments_per_block: int = 512) -> DataFrame:
    """Monotone header selection per document.

    The scan is sequential, so a document with few candidates is scanned as one array. A larger
    one is cut into page segments; each becomes a map from entering to leaving number, blocks of
    segments are composed, and the entering numbers then flow back down, so no array holds more
    than a segment's candidates or a block's maps.
    """
    order = F.array_sort(F.collect_list(F.struct(*ORDER, "n"))).alias("cands")
    big = candidates.groupBy(DOC).agg(F.count("*").alias("_n")).filter(F.col("_n") > max_group).select(DOC)
    all_short = fits(big, 0)
    short = candidates if all_short else candidates.join(big, DOC, "left_anti")
    direct = short.groupBy(DOC).agg(order).select(DOC, _accepted(F.col("cands"), F.lit(0)).alias("kept"))
    if all_short:
        return direct.select(DOC, F.inline("kept"))

    large = candidates.join(big, DOC, "left_semi")
    segments = (
        large.withColumn("seg", F.floor(F.col("page") / pages_per_segment))
        .groupBy(DOC, "seg")
        .agg(order)
        .withColumn("blk", F.floor(F.col("seg") / segments_per_block))
    )
    starts = F.array_distinct(
        F.concat(
            F.array(*[F.lit(s) for s in (0, *K.HEADER_LONG_STEP_AFTER)]),
            F.flatten(
                F.transform("cands", lambda c: F.sequence(F.greatest(c["n"] - K.HEADER_STEP, F.lit(0)), F.greatest(c["n"] - 1, F.lit(0))))
            ),
        )
    )
    leave = F.transform(starts, lambda s: F.aggregate("cands", s, lambda last, c: _step(last, c["n"]).cast("int")))
    maps = segments.select(DOC, "blk", "seg", F.map_from_arrays(starts, leave).alias("m"))

    def through(entries: Column, start: Column) -> Column:
        return F.aggregate(entries, start, lambda s, e: F.coalesce(F.try_element_at(e["m"], s), s))

    blocks = maps.groupBy(DOC, "blk").agg(F.array_sort(F.collect_list(F.struct("seg", F.map_entries("m").alias("e")))).alias("raw"))
    blocks = blocks.withColumn("entries", F.transform("raw", lambda e: F.struct(e["seg"].alias("at"), F.map_from_entries(e["e"]).alias("m"))))
    keys = F.array_distinct(F.flatten(F.transform("raw", lambda e: F.transform(e["e"], lambda p: p["key"]))))
    block_maps = blocks.withColumn("keys", keys).select(
        DOC, "blk", F.map_from_arrays("keys", F.transform("keys", lambda s: through(F.col("entries"), s))).alias("m")
    )

    def entering(entries: Column, start: Column) -> Column:
        """Entering number of every entry, scanning in order."""
        begin = F.struct(start.alias("s"), F.array().cast("array<struct<at:bigint,s:int>>").alias("out"))
        return F.aggregate(
            entries,
            begin,
            lambda acc, e: F.struct(
                F.coalesce(F.try_element_at(e["m"], acc["s"]), acc["s"]).alias("s"),
                F.concat(acc["out"], F.array(F.struct(e["at"].alias("at"), acc["s"].alias("s")))).alias("out"),
            ),
            lambda acc: acc["out"],
        )

    docs = block_maps.groupBy(DOC).agg(F.array_sort(F.collect_list(F.struct("blk", F.map_entries("m").alias("e")))).alias("raw"))
    docs = docs.withColumn("entries", F.transform("raw", lambda e: F.struct(e["blk"].alias("at"), F.map_from_entries(e["e"]).alias("m"))))
    block_starts = docs.select(DOC, F.inline(entering(F.col("entries"), F.lit(0)))).withColumnsRenamed({"at": "blk", "s": "start"})
    seg_starts = (
        blocks.join(block_starts, [DOC, "blk"])
        .select(DOC, F.inline(entering(F.col("entries"), F.col("start"))))
        .withColumnsRenamed({"at": "seg", "s": "start"})
    )
    scanned = segments.join(seg_starts, [DOC, "seg"]).select(DOC, _accepted(F.col("cands"), F.col("start")).alias("kept"))
    return direct.unionByName(scanned).select(DOC, F.inline("kept"))


def assign_lines(lines: DataFrame, headers: DataFrame) -> DataFrame:
    """Lines of each article, from a little above its header to just above the next one.

    The bounds overlap, so a line can belong to two articles. Spans are exploded to pages and
    joined by page; the vertical bounds are a residual condition.
    """
    after = Window.partitionBy(DOC).orderBy(*ORDER)
    last_pages = lines.groupBy(DOC).agg(F.max("page").alias("last_page"))
    spans = (
        headers.withColumns({"end_page": F.lead("page").over(after), "end_y": F.lead("y").over(after)})
        .join(last_pages, DOC)
        .select(
            DOC, "n", F.col("page").alias("start_page"), F.col("y").alias("start_y"),
            F.coalesce("end_page", "last_page").alias("end_page"), F.coalesce("end_y", F.lit(99999.0)).alias("end_y"),
        )
        .withColumn("page", F.explode(F.sequence("start_page", "end_page")))
    )
    y = F.col("y") + F.when(F.col("side") == "ar", -2.0).otherwise(0.0)
    return (
        spans.join(lines, [DOC, "page"])
        .filter(((F.col("page") != F.col("start_page")) | (y >= F.col("start_y") - 10)) & ((F.col("page") != F.col("end_page")) | (y < F.col("end_y") - 4)))
        .select(DOC, "n", "side", *ORDER, "text")
    )


def heading_kind(text: Column) -> Column:
    kind = F
    for name, pattern in K.HEADING_PATTERNS:
        kind = kind.when(text.rlike(pattern), name)
    return kind


def heading_state(
    lines: DataFrame, positions: DataFrame, defaults: dict[str, str] = K.DEFAULT_HEADINGS, pages_per_block: int = 1024
) -> DataFrame:
    """Headings in force at each position ``(doc_id, page, y, …)``; lower levels are not reset.

    Forward fill in two levels: inside blocks of pages, then over one summary row per block, so a
    very long document is not ordered by one task.
    """
    text = X.strip(F.col("text"))
    headings = (
        lines.filter(F.col("side") == "en")
        .select(DOC, *ORDER, text.alias("text"), heading_kind(text).alias("kind"))
        .filter("kind IS NOT NULL")
    )
    extra = [c for c in positions.columns if c not in (DOC, *ORDER)]
    marks = headings.select(DOC, *ORDER, F.lit(False).alias("asked"), *[F.when(F.col("kind") == k, F.col("text")).alias(k) for k in LEVELS])
    asked = positions.withColumns({"asked": F.lit(True), **{k: F.lit(None).cast("string") for k in LEVELS}})
    rows = marks.unionByName(asked, allowMissingColumns=True).withColumn("blk", F.floor(F.col("page") / pages_per_block))
    inside = Window.partitionBy(DOC, "blk").orderBy(*ORDER, "asked").rowsBetween(Window.unboundedPreceding, 0)
    filled = rows.withColumns({k: F.last(k, ignorenulls=True).over(inside) for k in LEVELS}).filter("asked")
    at = F.struct(*ORDER)
    closing = rows.filter("NOT asked").groupBy(DOC, "blk").agg(
        *[F.max_by(k, F.when(F.col(k).isNotNull(), at)).alias(k) for k in LEVELS]
    )
    wanted = filled.select(DOC, "blk").distinct().join(closing, [DOC, "blk"], "full")
    earlier = Window.partitionBy(DOC).orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    carried = wanted.select(DOC, "blk", *[F.last(k, ignorenulls=True).over(earlier).alias(f"_{k}") for k in LEVELS])
    return filled.join(carried, [DOC, "blk"], "left").select(
        DOC, *ORDER, *extra, *[F.coalesce(k, f"_{k}", F.lit(defaults[k])).alias(k) for k in LEVELS]
    )


def strip_markers(english: Column, arabic: Column) -> tuple[Column, Column]:
    """Bodies without the leading article markers."""
    digits = "0-9٠-٩"
    en = X.strip(F.regexp_replace(X.strip(english), rf"(?i)^(?:Article|rticle)[{K.WS}]*[0-9]+[{K.WS}.:\-)]*", ""))
    ar = X.strip(F.regexp_replace(X.strip(arabic), rf"^[{K.WS}(\[]*{K.ARABIC_MARKER_PATTERN}[{K.WS}(\[{digits}\-.:)]*", ""))
    ar = X.strip(F.regexp_replace(ar, rf"^[{K.WS}(\[]*[{digits}]+[{K.WS}).:\-]*", ""))
    return en, ar


def build_articles(
    lines: DataFrame, headers: DataFrame, citation_prefix: str = K.CITATION_PREFIX, positional: bool = False
) -> DataFrame:
    """Article rows: joined bodies, cleaned and normalized text, hierarchy, references, citation.

    The hierarchy is the state at the end of the page an article starts on, or with
    ``positional`` the state at its header.
    """
    def body(side: str) -> Column:
        part = F.when(F.col("side") == side, F.struct(*ORDER, "text"))
        return F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["text"]), " ")

    bodies = assign_lines(lines, headers).groupBy(DOC, "n").agg(body("en").alias("en"), body("ar").alias("ar"))
    spots = headers if positional else headers.withColumn("y", F.lit(END_OF_PAGE))
    placed = heading_state(lines, spots.select(DOC, *ORDER, "n"))
    rows = placed.join(bodies, [DOC, "n"], "left")
    en, ar = strip_markers(X.text_or_empty(F.col("en")), X.text_or_empty(F.col("ar")))
    rows = rows.withColumns({"text_en": en, "_ar": ar}).withColumn("text_ar_raw", X.clean_raw(F.col("_ar")))
    rows, norm = rows.withColumn("_norm", X.normalize(F.col("text_ar_raw"))), F.col("_norm")
    return rows.select(
        F.col(DOC).alias("corpus_id"),
        F.col("n").alias("article_number"),
        *LEVELS,
        F.when(norm != "", norm).otherwise(F.col("text_ar_raw")).alias("text_ar"),
        "text_ar_raw",
        "text_en",
        F.lit(False).alias("is_repealed"),
        F.col("page").alias("source_page"),
        F.concat(F.lit(citation_prefix), "n").alias("citation"),
        X.references(F.col("_ar"), F.col("text_en"), F.col("n")).alias("references"),
    )


def overlay_status(
    articles: DataFrame, lines: DataFrame, ranges: list[dict] = K.OVERLAY_RANGES, citation_prefix: str = K.CITATION_PREFIX
) -> DataFrame:
    """Replace or create every article of the status ranges, in every corpus, with its note."""
    if not ranges:
        return articles
    docs = lines.groupBy(DOC).agg(F.max("page").alias("last_page"))

    def entry(r: dict) -> Column:
        text = {c: F.lit(r[c]).cast("string").alias(f"set_{c}") for c in ("chapter", "section")}
        spare = [F.lit(v).alias(f"spare_{k}") for k, v in zip(LEVELS[:4], r["fallback"])]
        return F.struct(
            F.lit(r["lo"]).alias("lo"), F.lit(r["hi"]).alias("hi"), F.lit(r["page"]).alias("page"), *text.values(), *spare,
            F.lit(r["note_ar"]).alias("text_ar_raw"), F.lit(r["note_en"]).alias("text_en"),
        )

    asked = docs.select(DOC, "last_page", F.inline(F.array(*[entry(r) for r in ranges]))).withColumns(
        {"y": F.lit(END_OF_PAGE), "block": F.lit(0), "line": F.lit(0), "span": F.lit(0)}
    )
    rows = heading_state(lines, asked).withColumn("n", F.explode(F.sequence("lo", "hi")))
    seen = F.col("page") <= F.col("last_page")
    levels = {k: F.when(seen, F.col(k)).otherwise(F.col(f"spare_{k}")) for k in LEVELS[:4]}
    for k in ("chapter", "section"):
        levels[k] = F.coalesce(f"set_{k}", levels[k])
    overlay = rows.select(
        F.col(DOC).alias("corpus_id"), F.col("n").alias("article_number"),
        *[v.alias(k) for k, v in levels.items()], F.lit(K.OVERLAY_TOPIC).alias("topic"),
        X.normalize(F.col("text_ar_raw")).alias("text_ar"), "text_ar_raw", "text_en",
        F.lit(True).alias("is_repealed"), F.col("page").alias("source_page"),
        F.concat(F.lit(citation_prefix), "n", F.lit(" (Repealed)")).alias("citation"),
        F.array().cast("array<int>").alias("references"),
    )
    covered = X.in_ranges(F.col("article_number"), [(r["lo"], r["hi"]) for r in ranges])
    return articles.filter(~covered).unionByName(overlay)


def split_merged(articles: DataFrame, numbers: list[int] = [1021]) -> DataFrame:  # noqa: B006
    """Move the text after a "(2)" marker of article n to article n + 1, for the listed numbers."""
    marker = rf"[(\[][{K.WS}]*[٢2][{K.WS}]*[()\]]"
    parts = F.split("text_ar_raw", marker, 2)
    near = F.coalesce(F.col("article_number").isin(*numbers, *[n + 1 for n in numbers]), F.lit(False))
    others, articles = articles.filter(~near), articles.filter(near)  # the only ones that can give or get a text
    merged = (
        articles.filter(F.col("article_number").isin(*numbers) & F.col("text_ar_raw").rlike(marker))
        .select("corpus_id", (F.col("article_number") + 1).alias("article_number"), parts.alias("parts"))
        .join(articles.select("corpus_id", "article_number"), ["corpus_id", "article_number"], "left_semi")
    )
    patches = merged.select(
        "corpus_id",
        F.inline(
            F.array(
                F.struct((F.col("article_number") - 1).alias("article_number"), F.get("parts", F.lit(0)).alias("patch")),
                F.struct("article_number", F.get("parts", F.lit(1)).alias("patch")),
            )
        ),
    ).withColumn("patch", X.clean_raw(X.strip(F.col("patch"))))
    patched = articles.join(patches, ["corpus_id", "article_number"], "left")
    patched = patched.withColumns(
        {
            "text_ar": F.when(F.col("patch").isNotNull(), X.normalize(F.col("patch"))).otherwise(F.col("text_ar")),
            "text_ar_raw": F.coalesce("patch", "text_ar_raw"),
        }
    ).select(*articles.columns)
    return others.unionByName(patched)
