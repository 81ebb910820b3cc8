"""Benchmark decontamination by spaced seeds: masked token hashes, then substitution-tolerant overlaps."""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import keep_rows, per_batch, texts
from lexmill.llm.wordbuf import FOLDED, Members, Words, inside_docs, odd_weights, windows, words

#: Fixed masks: 1 looks at a token, 0 ignores it. Every mask spans 9 tokens and looks at 6.
MASKS = ("110101011", "101110011", "111001101")
SPAN = len(MASKS[0])
HITS = "doc_id long, item_id long, item_start int, item_end int, doc_start int, doc_end int, n_same int, n_item_tokens int"


def mask_weights(k: int) -> np.ndarray:
    return odd_weights(SPAN, 80 + k) * np.array([int(c) for c in MASKS[k]], np.uint64)


@dataclass
class Block:
    """Token hashes of a bounded run of benchmark items, one after another, and their seeds by mask."""

    ids: list
    bounds: np.ndarray
    tokens: np.ndarray
    seeds: list[tuple[Members, np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, ids: list, column: pa.Array) -> "Block":
        w = words(column, FOLDED)
        seeds = []
        for k in range(len(MASKS)):
            at = np.flatnonzero(inside_docs(w, SPAN))
            h = windows(w.hash, mask_weights(k))[at]
            order = np.argsort(h, kind="stable")
            seeds.append((Members(h), h[order], at[order]))
        return cls(ids, w.bounds, w.hash, seeds)


def blocks_of(benchmark: DataFrame, block_bytes: int) -> list[Block]:
    """The benchmark in blocks of about ``block_bytes`` of text; each is collected and broadcast by itself."""
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text")).filter("text <> ''")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    out = []
    for k in range(n):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect() if total else []
        if rows:
            out.append(Block.of([r.item_id for r in rows], pa.array([r.text for r in rows], pa.string())))
    return out


def best_run(same: np.ndarray, share: float = 0.8) -> tuple[int, int]:
    """Of the runs of a diagonal in which at least ``share`` of the tokens are equal, the one with most equal tokens.

    Of equal ones the shortest, then the first. Without an equal token ``(0, 0)``.
    """
    equal = np.concatenate([[0], np.cumsum(same)])
    sums = equal - share * np.arange(len(equal))
    starts, stops = np.flatnonzero(same), np.flatnonzero(same) + 1  # a longest run of most equal tokens need not end beyond one
    if not len(starts):
        return 0, 0
    # the farthest stop that a start reaches: greatest sum from there on, found by bisection as it falls with the place
    tops = np.maximum.accumulate(sums[stops][::-1])[::-1]
    reach = len(tops) - np.searchsorted(tops[::-1], sums[starts] - 1e-9, "left") - 1
    gained = reach - np.arange(len(starts)) + 1
    most = np.flatnonzero(gained == gained.max())
    first = most[(stops[reach[most]] - starts[most]).argmin()]
    return int(starts[first]), int(stops[reach[first]])


def good_runs(same: np.ndarray, least: int, share: float) -> list[tuple[int, int]]:
    """``best_run``, and again beside it: all runs apart from each other with ``least`` equal tokens."""
    found, open_spans = [], [(0, len(same))]
    while open_spans:
        lo, hi = open_spans.pop()
        first, to = best_run(same[lo:hi], share)
        if int(same[lo + first : lo + to].sum()) >= max(least, 1):
            found.append((lo + first, lo + to))
            open_spans += [(lo, lo + first), (lo + to, hi)]
    return sorted(found)


def seed_hits(w: Words, block: Block) -> np.ndarray:
    """Distinct ``(document, item, diagonal)`` rows of all seed hits."""
    found = [np.zeros((0, 3), np.int64)]
    for k in range(len(MASKS)):
        members, seeds, places = block.seeds[k]
        h = windows(w.hash, mask_weights(k))
        at = members.positions(h)
        at = at[w.doc[at] == w.doc[at + SPAN - 1]]
        for part in np.array_split(at, len(at) // 50_000 + 1):
            lo, hi = np.searchsorted(seeds, h[part], "left"), np.searchsorted(seeds, h[part], "right")
            n = hi - lo
            i = np.repeat(part, n)
            j = places[np.repeat(lo, n) + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)]
            item = np.searchsorted(block.bounds, j, "right") - 1
            found.append(np.unique(np.stack([w.doc[i], item, i - j], 1), axis=0))
    return np.unique(np.concatenate(found), axis=0)


def scan(column: pa.Array, block: Block, least: int, share: float) -> list[tuple]:
    """Accepted overlaps ``(row, item, item_start, item_end, doc_start, doc_end, n_same, n_item_tokens)``."""
    w = words(column, FOLDED)
    accepted = []
    for d, item, diagonal in seed_hits(w, block).tolist():
        begin, end = int(block.bounds[item]), int(block.bounds[item + 1])
        base = int(w.bounds[d])
        lo, hi = max(begin, base - diagonal), min(end, int(w.bounds[d + 1]) - diagonal)
        same = w.hash[lo + diagonal : hi + diagonal] == block.tokens[lo:hi]
        # an item shorter than ``least`` needs the same share of all its tokens
        enough = least if end - begin >= least else int(np.ceil(share * (end - begin) - 1e-9))
        for first, to in good_runs(same, enough, share):
            equal = int(same[first:to].sum())
            at, start = lo + first - begin, lo + first + diagonal - base
            accepted.append((d, item, at, at + to - first, start, start + to - first, equal, end - begin))
    kept: dict[tuple[int, int], list[tuple]] = {}
    for x in sorted(accepted, key=lambda x: (-x[6], x)):
        others = kept.setdefault(x[:2], [])
        if all(x[5] <= y[4] or y[5] <= x[4] for y in others):
            others.append(x)
    return [x for same_pair in kept.values() for x in same_pair]


def contamination(
    docs: DataFrame, benchmark: DataFrame, least: int = 13, share: float = 0.8, block_bytes: int = 16 << 20
) -> DataFrame:
    """Overlaps of benchmark items with documents, one row each, in token places of the item and the document.

    Tokens are lower-case runs of letters and digits. A hit of any mask names a diagonal; a run of it is an
    overlap if ``least`` tokens agree (of a shorter item ``share`` of its tokens) and at least ``share`` of the run. Overlaps of
    one item and document that cover common tokens are reported once, by the best. Items under nine tokens
    carry no seed and are not searched: so short a text is no evidence. Documents only pass by blocks of the
    benchmark, each bounded by ``block_bytes``; nothing of the documents is shuffled. Null or empty texts
    give no row; a repeated document gives its rows again; a null doc_id is carried along.
    """
    found = None
    for block in blocks_of(benchmark, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def one(batch: pa.RecordBatch, shared=shared) -> pa.RecordBatch:
            block, ids = shared.value, batch.column(0).to_pylist()
            rows = [(ids[x[0]], block.ids[x[1]], *x[2:]) for x in scan(batch.column(1), block, least, share)]
            kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 6]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 8, kinds)]
            return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in HITS.split(", ")])

        hits = texts(docs).mapInArrow(per_batch(one), HITS)
        found = hits if found is None else found.union(hits)
    return docs.sparkSession.createDataFrame([], HITS) if found is None else found


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, least: int = 13, share: float = 0.8, block_bytes: int = 16 << 20
) -> DataFrame:
    """Rows of ``docs`` without an overlap in the sense of ``contamination``; all columns stay."""
    for block in blocks_of(benchmark, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def clean(column: pa.Array, shared=shared) -> np.ndarray:
            keep = np.ones(len(column), bool)
            keep[[x[0] for x in scan(column, shared.value, least, share)]] = False
            return keep

        docs = keep_rows(docs, clean)
    return docs
