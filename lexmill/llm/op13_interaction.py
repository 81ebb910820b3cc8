"""How five filters interact: a byte transducer measures every text, masks of failed filters are counted by source.

The transducer reads a text's bytes once: a table gives each byte its class, a second one the next state and what is
counted on the way; the spans of its words go to a hash table in which equal hashes are compared byte by byte.
"""

import hashlib
from dataclasses import dataclass
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.common import bounded_batches, per_batch, scratch
from lexmill.llm.wordbuf import _BYTE_VALUES, mix, powers
from lexmill.session import ship_package

FILTERS = "ABCDE"
LONG_WORD = 64  # bytes; longer equal words are compared as byte strings
FACTS = "doc_id long, source string, n_words long, n_distinct long, n_capitals long, n_points long, n_symbols long, content binary"

SPACE, CAPITAL, SYMBOL, TAIL, OTHER = range(5)
#: Class of a byte: white space, capital, symbol, later byte of a code point, anything else.
CLASS = np.full(256, OTHER, np.uint8)
CLASS[0x80:0xC0] = TAIL
CLASS[65:91] = CAPITAL
CLASS[list(b"#$%&*|")] = SYMBOL
CLASS[[0x20, *range(0x09, 0x0E)]] = SPACE
OUTSIDE, INSIDE = range(2)
#: State after a byte of a class. It does not depend on the state before, so all bytes of a buffer step at once.
NEXT = np.array([OUTSIDE, INSIDE, INSIDE, INSIDE, INSIDE], np.uint8)
STARTS, ENDS, POINT, CAPITALS, SYMBOLS = 1, 2, 4, 8, 16
#: What a byte of a class means in a state: first byte of a word, first byte after one, a code point, a capital, a symbol.
EMITS = np.array([[POINT, STARTS | POINT | CAPITALS, STARTS | POINT | SYMBOLS, STARTS, STARTS | POINT], [ENDS | POINT, POINT | CAPITALS, POINT | SYMBOLS, 0, POINT]], np.uint8)


@dataclass
class Scan:
    """Facts of each text of a run, and the spans of all words in ``buffer`` with the text they belong to."""

    buffer: np.ndarray
    n_words: np.ndarray
    n_capitals: np.ndarray
    n_points: np.ndarray
    n_symbols: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray


def transduce(texts: list[bytes]) -> Scan:
    """One pass over all texts; a blank after each text ends its last word and is not counted."""
    buffer = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    first = np.cumsum(size) - size
    classes = CLASS[buffer]
    state = np.empty(len(buffer), np.uint8)
    state[:1] = OUTSIDE
    state[1:] = NEXT[classes[:-1]]
    emitted = EMITS[state, classes]

    def count(flag: int) -> np.ndarray:
        return np.add.reduceat((emitted & flag) != 0, first, dtype=np.int64) if len(texts) else np.zeros(0, np.int64)

    n_words = count(STARTS)
    doc = np.repeat(np.arange(len(texts)), n_words)
    return Scan(buffer, n_words, count(CAPITALS), count(POINT) - 1, count(SYMBOLS), np.flatnonzero(emitted & STARTS), np.flatnonzero(emitted & ENDS), doc)


def _same(scan: Scan, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether words ``a`` and ``b`` have equal bytes."""
    size = scan.end - scan.start
    same = size[a] == size[b]
    for k in range(min(LONG_WORD, int(size[a].max(initial=0)))):
        at = np.flatnonzero(same & (size[a] > k))
        if not len(at):
            break
        same[at] = scan.buffer[scan.start[a[at]] + k] == scan.buffer[scan.start[b[at]] + k]
    for i in np.flatnonzero(same & (size[a] > LONG_WORD)):
        x, y = int(a[i]), int(b[i])
        same[i] = scan.buffer[scan.start[x] : scan.end[x]].tobytes() == scan.buffer[scan.start[y] : scan.end[y]].tobytes()
    return same


def span_hashes(scan: Scan) -> np.ndarray:
    """64-bit hash of every word, from one running sum over the buffer."""
    up, down = powers(len(scan.buffer) + 1)
    sums = np.zeros(len(scan.buffer) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[scan.buffer] * up[: len(scan.buffer)], out=sums[1:])
    return mix((sums[scan.end] - sums[scan.start]) * down[scan.start])


def distinct_words(scan: Scan, hashes: np.ndarray | None = None) -> np.ndarray:
    """Distinct words of each text: spans are inserted into an open hash table, all of them a slot at a time.

    A word whose slot holds a word of the same text with the same bytes is a repeat; one that meets another word moves on.
    So the counts are exact whatever the hashes are.
    """
    texts, words = len(scan.n_words), len(scan.start)
    hashes = span_hashes(scan) if hashes is None else hashes
    room = 1 << max(4, (2 * words).bit_length())
    table = np.full(room, -1, np.int64)
    key = mix(hashes + scan.doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    slot = (key & np.uint64(room - 1)).astype(np.int64)
    left, found = np.arange(words), np.zeros(texts, np.int64)
    while len(left):
        free = left[table[slot[left]] < 0]
        table[slot[free]] = free
        holder = table[slot[left]]
        mine = holder == left
        found += np.bincount(scan.doc[left[mine]], minlength=texts)
        left, holder = left[~mine], holder[~mine]
        repeat = (scan.doc[left] == scan.doc[holder]) & (hashes[left] == hashes[holder])
        repeat[repeat] = _same(scan, left[repeat], holder[repeat])
        left = left[~repeat]
        slot[left] = (slot[left] + 1) & (room - 1)
    return found


def _facts(batch: pa.RecordBatch) -> pa.RecordBatch:
    texts = pc.fill_null(batch.column("text"), "").cast(pa.binary()).to_pylist()
    scan = transduce(texts)
    content = pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())
    counts = [scan.n_words, distinct_words(scan), scan.n_capitals, scan.n_points, scan.n_symbols]
    names = [f.split(" ")[0] for f in FACTS.split(", ")]
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), *map(pa.array, counts), content], names)


def text_facts(docs: DataFrame) -> DataFrame:
    """``doc_id, source, n_words, n_distinct, n_capitals, n_points, n_symbols, content`` per row, ``content`` the SHA-256
    of the text. Null texts and sources are empty. Map-side."""
    ship_package(docs.sparkSession)
    bounded_batches(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), "text")
    return own.mapInArrow(per_batch(_facts, 1 << 20), FACTS)


def _bit(letter: str) -> int:
    return 1 << FILTERS.index(letter)


def failed(least_words: int = 200, distinct_share: int = 50, capital_share: int = 2) -> Column:
    """Bits of the filters A to D that a text's facts fail."""
    conditions = {
        "A": F.col("n_words") < least_words, "B": 100 * F.col("n_distinct") < distinct_share * F.col("n_words"),
        "C": 100 * F.col("n_capitals") > capital_share * F.col("n_points"), "D": F.col("n_symbols") > 0,
    }
    bits = [F.when(c, _bit(letter)).otherwise(0) for letter, c in conditions.items()]
    return bits[0] + bits[1] + bits[2] + bits[3]


def failure_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``source, mask, n, good, toxic``: rows by source and set of failed filters, A as bit 0 to E as bit 4.

    E fails where a smaller doc_id has the same text. Rows that share a doc_id are judged each; a row without a doc_id
    fails no E, is nobody's earlier copy and has no label. A document is good or toxic if any of its labels says so.
    """
    facts = scratch(text_facts(docs).select("doc_id", "source", "content", failed().alias("mask")), "interaction-facts")
    known = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    rows = facts.filter("doc_id IS NOT NULL").join(known, "doc_id", "left").fillna(0, ["good", "toxic"])
    # per document first, where the join has put it; then copies of a source are one row before they travel by content
    kind = ["content", "source", "mask", "good", "toxic"]
    copies = rows.groupBy("doc_id", *kind).agg(F.count("*").alias("n"))
    copies = copies.groupBy(*kind).agg(F.sum("n").alias("n"), F.min(F.struct("doc_id", "n")).alias("least"))
    first = F.min("least.doc_id").over(Window.partitionBy("content")) == F.col("least.doc_id")
    copies = copies.withColumn("first", F.when(first, F.col("least.n")).otherwise(0))
    entries = F.array(F.struct("mask", F.col("first").alias("n")), F.struct((F.col("mask") + _bit("E")).alias("mask"), (F.col("n") - F.col("first")).alias("n")))
    copies = copies.select("source", "good", "toxic", F.explode(entries).alias("e")).select("source", "e.mask", "e.n", "good", "toxic")
    nameless = facts.filter("doc_id IS NULL").select("source", "mask", F.lit(1).cast("long").alias("n"), F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    return copies.union(nameless).filter("n > 0").groupBy("source", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic")
    )


def interaction_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, filter_order, step`` and what the filter at that place does: ``kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley``; a row for every source, order and step, zeros included.

    Only counts by source and mask are expanded, so the work per document does not depend on the orders. No rows: no rows.
    """
    masks = range(1 << len(FILTERS))
    counts = failure_counts(docs, labels)
    parts = counts.groupBy(F.col("source").alias("part")).agg(
        *[F.array(*[F.sum(F.when(F.col("mask") == m, F.col(c)).otherwise(0)) for m in masks]).alias(c) for c in ("n", "good", "toxic")]
    )
    orders = ",".join("".join(p) for p in permutations(FILTERS))
    rows = parts.withColumn("filter_order", F.explode(F.split(F.lit(orders), ","))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    bit_at = "shiftleft(1, ascii(substr(filter_order, {}, 1)) - 65)"
    rows = rows.withColumns({"bit": F.expr(bit_at.format("step")), "earlier": F.expr(f"aggregate(sequence(1, 5), 0, (s, k) -> s + IF(k < step, {bit_at.format('k')}, 0))")})

    def total(counts: str, condition: str, weight: str = "1") -> Column:
        """Sum of the counts of those masks ``m`` that meet the condition."""
        return F.expr(f"aggregate(sequence(0, {len(masks) - 1}), 0L, (s, m) -> s + IF({condition}, {counts}[m] * {weight}, 0L))")

    removed, orders_each = "m & bit <> 0 AND m & earlier = 0", len(list(permutations(FILTERS)))
    return rows.select(
        "part", "filter_order", "step", total("n", "m & (bit | earlier) = 0").alias("kept"), total("n", removed).alias("removed"),
        total("n", "m & bit <> 0 AND m & earlier <> 0").alias("redundant"), F.expr("n[bit]").alias("unique_fails"),
        total("good", removed).alias("good_lost"), total("toxic", removed).alias("toxic_lost"),
        # of the filters that a text fails each comes first in the same number of orders
        total("n", "m & bit <> 0", f"CAST({orders_each} / bit_count(m) AS BIGINT)").alias("shapley"),
    )
