"""How the sources of a language diverge: one-hot count levels, their blocked products, exact prices.

A term is a row, a pair (source, count) a column that is 1 where the source has the term so often. The matrix times its
transpose holds, for every two sources, the joint table of their counts; a divergence that depends on counts alone is a
price for each cell of that table.
"""

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.common import bounded_batches, scratch
from lexmill.session import broadcast_if_small, ship_package

LEAST_DOCS = 30
SMOOTH = 5
UNIT = 1_000_000_000
BEST = 50
TERMS = 1_024  # expected terms of a block
SOURCES = 64  # expected sources of a tile
HELD = 400_000  # counts a task holds before it passes them on
COUNTS = "lang string, source string, term string, n long, docs long"
#: Letters in lower case and all bytes of other characters stay, the rest parts terms.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _emptied(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def passed_on() -> Iterator[pa.RecordBatch]:
        for (lang, source), (uses, docs) in held.items():
            terms = pa.array(uses.keys(), pa.binary()).cast(pa.string())
            names = [pa.array([v]).take(pa.array(np.zeros(len(uses), np.int64))) for v in (lang, source)]
            counts = [pa.array(uses.values(), pa.int64()), pa.array([docs[t] for t in uses], pa.int64())]
            yield pa.RecordBatch.from_arrays([*names, terms, *counts], ["lang", "source", "term", "n", "docs"])
        held.clear()

    size = 0
    for batch in batches:
        for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
            terms = text.translate(_FOLD).split()
            uses, docs = held.setdefault((lang, source), (Counter(), Counter()))
            size -= len(uses)
            uses.update(terms)
            docs.update(set(terms))
            size += len(uses)
            if size > HELD:
                yield from passed_on()
                size = 0
    yield from passed_on()


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs``: uses of each term and documents with it, counted in the tasks first.

    Null texts, languages and sources are empty strings; every row is a document of its own, whatever its doc_id.
    """
    ship_package(docs.sparkSession)
    bounded_batches(docs.sparkSession)
    own = docs.select(*[_emptied(c) for c in ("lang", "source", "text")])
    return own.mapInArrow(_counted, COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def price(n: str, total: str, terms: str) -> Column:
    """1 + floor(UNIT * (n + SMOOTH) / (total + SMOOTH * terms)), exact; null without terms."""
    whole = f"CAST({UNIT} AS DECIMAL(10, 0)) * CAST({n} + {SMOOTH} AS DECIMAL(20, 0))"
    return F.expr(f"1 + ({whole}) div CAST(nullif({total} + {SMOOTH} * {terms}, 0) AS DECIMAL(20, 0))")


def kept_counts(docs: DataFrame, least_docs: int) -> tuple[DataFrame, DataFrame]:
    """The counts of kept terms with their prices, and every group with its totals.

    ``lang, source, term, n, p, q`` with q the term's price in the whole language;
    ``lang, source, total, terms, sources, p0`` with p0 the price of a term that the source lacks.
    """
    counts = scratch(term_counts(docs), "divergence-counts")
    vocabulary = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least_docs)
    vocabulary = scratch(vocabulary.drop("docs"), "divergence-terms")
    kept = scratch(counts.select("lang", "source", "term", "n").join(vocabulary, ["lang", "term"]), "divergence-kept")
    langs = vocabulary.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = docs.select(_emptied("lang"), _emptied("source")).distinct()
    sizes = groups.groupBy("lang").agg(F.count("*").alias("sources"))
    groups = groups.join(sizes, "lang").join(langs, "lang", "left").join(totals, ["lang", "source"], "left")
    groups = groups.fillna(0, ["terms", "lang_total", "total"]).withColumn("p0", price("0", "total", "terms"))
    groups = scratch(groups, "divergence-groups")
    priced = kept.join(broadcast_if_small(groups, 200_000), ["lang", "source"])
    priced = priced.select("lang", "source", "term", "n", price("n", "total", "terms").alias("p"), price("lang_n", "lang_total", "terms").alias("q"), "terms", "sources", "p0")
    return priced, groups


@dataclass
class OneHot:
    """The matrix of a block: ``at[term, source]`` is the column that is 1. Of each column the source (``owner``), its count
    and its price; of each source its name and tile. A term that a source lacks is at the source's column of count 0.
    """

    at: np.ndarray
    owner: np.ndarray
    count: np.ndarray
    cost: np.ndarray
    names: list[str]
    tile: np.ndarray

    def products(self, low: int, high: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Entries of the matrix times its transpose, source by source: ``(source, others, column, other column, terms)``.

        A row has one 1 a source, so its outer product has one entry for each two sources; the entries are summed as
        integers. Of sources of the same tile only those after the first are paired.
        """
        width = len(self.owner)
        for k in np.flatnonzero(self.tile == low):
            others = np.flatnonzero(self.tile == high)
            others = others[others > k] if low == high else others
            if len(others):
                entries, terms = np.unique(self.at[:, k, None] * width + self.at[:, others], return_counts=True)
                yield int(k), others, entries // width, entries % width, terms


def one_hot(rows: pa.Table) -> OneHot:
    """The matrix of counts ``rows``; those without a term only name a source."""
    source, term = (pc.dictionary_encode(rows.column(c).combine_chunks()) for c in ("source", "term"))
    names, real = source.dictionary.to_pylist(), pc.is_valid(term.indices).to_numpy(zero_copy_only=False)
    s, t = np.asarray(source.indices), np.asarray(term.indices.filter(pa.array(real)))
    n, p, p0, tile = (rows.column(c).to_numpy() for c in ("n", "p", "p0", "tile"))
    tiles, zero = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
    tiles[s], zero[s] = tile, p0
    levels, column = np.unique(np.stack([s[real], n[real]]), axis=1, return_inverse=True)
    column = column.ravel() + len(names)
    at = np.repeat(np.arange(len(names))[None], len(term.dictionary), 0)
    at[t, s[real]] = column
    cost = np.concatenate([zero, np.zeros(levels.shape[1], np.int64)])
    cost[column] = p[real]
    count = np.concatenate([np.zeros(len(names), np.int64), levels[1]])
    return OneHot(at, np.concatenate([np.arange(len(names)), levels[0]]), count, cost, names, tiles)


def _blocks(priced: DataFrame, groups: DataFrame, terms: int, sources: int) -> DataFrame:
    """Counts by block of terms and pair of source tiles: both sizes follow the language's own number of each.

    A row without a term names every source in every block, as the others' terms are its terms of count 0.
    """
    place = ["lang", "source", "term", "n", "p", "p0", "terms", "sources"]
    rows = priced.select(*place, F.expr(f"pmod(xxhash64(term), ceil(terms / {terms}))").cast("int").alias("block"))
    named = groups.filter("terms > 0").withColumns({"term": F.lit(None).cast("string"), "n": F.lit(0).cast("long"), "p": F.col("p0")})
    named = named.select(*place, F.explode(F.expr(f"sequence(0, CAST(ceil(terms / {terms}) AS INT) - 1)")).alias("block"))
    tiles = F.expr(f"CAST(ceil(sources / {sources}) AS INT)")
    tile = F.expr(f"CAST(pmod(xxhash64(source, 1), ceil(sources / {sources})) AS INT)")
    rows = rows.union(named).withColumns({"tile": tile, "with": F.explode(F.sequence(F.lit(0), tiles - 1))})
    return rows.withColumns({"low": F.least("tile", "with"), "high": F.greatest("tile", "with")}).drop("with", "terms", "sources").groupBy("lang", "block", "low", "high")


def _priced_block(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    matrix = one_hot(rows)
    names, cost = matrix.names, matrix.cost
    first, other, value = [], [], []
    for k, others, a, b, terms in matrix.products(key[2].as_py(), key[3].as_py()):
        sums = np.zeros(len(names), np.int64)
        np.add.at(sums, matrix.owner[b], terms * np.abs(cost[a] - cost[b]))
        first += [names[k]] * len(others)
        other += [names[j] for j in others]
        value.append(sums[others])
    value = np.concatenate(value) if value else np.zeros(0, np.int64)
    shape = [pa.array([key[0].as_py()] * len(first), pa.string()), pa.array(first, pa.string()), pa.array(other, pa.string())]
    return pa.Table.from_arrays([*shape, pa.array(value), pa.array(np.full(len(first), len(matrix.at)), pa.int64())], ["lang", "source", "other", "value", "seen"])


def _joint_block(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    matrix = one_hot(rows)
    names, count, owner = matrix.names, matrix.count, matrix.owner
    found = [(k, *x) for k, _, *x in matrix.products(key[2].as_py(), key[3].as_py())]
    first = np.concatenate([np.full(len(a), k) for k, a, _, _ in found] or [np.zeros(0, np.int64)])
    a, b, terms = (np.concatenate([x[i] for x in found] or [np.zeros(0, np.int64)]) for i in (1, 2, 3))
    named = pa.array(names, pa.string())
    lang = pa.array([key[0].as_py()] * len(first), pa.string())
    columns = [lang, named.take(pa.array(first)), named.take(pa.array(owner[b])), pa.array(count[a]), pa.array(count[b]), pa.array(terms.astype(np.int64))]
    return pa.Table.from_arrays(columns, ["lang", "source", "other", "level", "other_level", "n_terms"])


def joint_tables(docs: DataFrame, least_docs: int = LEAST_DOCS, terms: int = TERMS, sources: int = SOURCES) -> DataFrame:
    """``lang, source, other, level, other_level, n_terms``: for every two sources of a language how many kept terms have
    the one count in the first and the other count in the second, terms that both lack left out.
    """
    priced, groups = kept_counts(docs, least_docs)
    parts = _blocks(priced, groups, terms, sources).applyInArrow(_joint_block, "lang string, source string, other string, level long, other_level long, n_terms long")
    # each pair once, the lesser name first
    turned = F.col("source") > F.col("other")
    sides = [F.when(turned, F.col(b)).otherwise(F.col(a)).alias(a) for a, b in (("source", "other"), ("other", "source"), ("level", "other_level"), ("other_level", "level"))]
    return parts.filter("level > 0 OR other_level > 0").select("lang", *sides, "n_terms").groupBy("lang", "source", "other", "level", "other_level").agg(F.sum("n_terms").alias("n_terms"))


def source_divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, best: int = BEST, terms: int = TERMS, sources: int = SOURCES) -> DataFrame:
    """``lang, source, part, item, value, rank``: how far each source is from the others and the terms it favours.

    Part ``pair`` lists every other source of the language with the sum of price differences over all kept terms, part
    ``term`` the ``best`` terms that are dearer in the source than in the language. The joint tables are priced where
    they are made, so that only sums of two sources and a block travel. A language without kept terms has pairs of
    value 0 and no terms; a source that is alone in its language has no pair. No rows: no rows.
    """
    priced, groups = kept_counts(docs, least_docs)
    sums = _blocks(priced, groups, terms, sources).applyInArrow(_priced_block, "lang string, source string, other string, value long, seen long")
    # which of two sources comes first may differ between blocks
    sums = sums.withColumns({"source": F.least("source", "other"), "other": F.greatest("source", "other")})
    sums = sums.groupBy("lang", "source", "other").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"))
    sides = F.array(F.struct("source", "other"), F.struct(F.col("other").alias("source"), F.col("source").alias("other")))
    sums = sums.select("lang", F.explode(sides).alias("s"), "value", "seen").select("lang", "s.*", "value", "seen")
    a = groups.select("lang", "source", "terms", F.col("p0").alias("pa"))
    b = groups.select("lang", F.col("source").alias("other"), F.col("p0").alias("pb"))
    pairs = a.join(b, "lang").filter("source <> other").join(sums, ["lang", "source", "other"], "left").fillna(0, ["value", "seen"])
    # terms that no source of a block's tiles has are in no matrix: both sources price them at 0 uses
    rest = F.coalesce((F.col("terms") - F.col("seen")) * F.abs(F.col("pa") - F.col("pb")), F.lit(0))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), (F.col("value") + rest).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    dear = priced.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    dear = dear.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= best)
    return pairs.withColumn("rank", F.row_number().over(order)).union(dear)
