"""SimHash near-duplicates: fingerprints, a binary-trie self-join under a Hamming budget, components."""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import per_batch, scratch, texts
from lexmill.llm.components import connected_components
from lexmill.session import broadcast_if_small

BITS = 64
HISTOGRAM_BITS = 16


def fingerprint(text: str, shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of the word shingles of ``text``, repeats included; 0 without words."""
    words = text.encode().lower().split()  # bytes: only A-Z fold and only ASCII white space parts words
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts.tolist(), last.tolist())], np.uint64)
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    majority = 2 * bits.sum(axis=0, dtype=np.int64) > len(hashes)
    return int(np.packbits(majority, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``doc_id, fp`` per row; the 64 bits as a signed long. A null text counts as empty."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], np.uint64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], names=["doc_id", "fp"])

    return texts(docs).mapInArrow(per_batch(one), "doc_id long, fp long")


class TrieCut:
    """Trie nodes whose subtrees hold at most ``most`` fingerprints, and the node pairs within the budget.

    Built from the histogram of the first 16 bits (65,536 counts at most, whatever the corpus). The pairs come
    from traversing the cut against itself from the root, adding up differing bits and pruning over ``budget``.
    """

    def __init__(self, counts: np.ndarray, most: int, least_depth: int, budget: int):
        total = np.concatenate([[0], np.cumsum(counts)])

        def size(prefix: int, depth: int) -> int:
            width = 1 << (HISTOGRAM_BITS - depth)
            return int(total[(prefix + 1) * width] - total[prefix * width])

        def splits(prefix: int, depth: int) -> bool:
            return depth < HISTOGRAM_BITS and size(prefix, depth) > 0 and (depth < least_depth or size(prefix, depth) > most)

        leaves: dict[tuple[int, int], int] = {}
        found: set[tuple[int, int]] = set()
        todo = [((0, 0), (0, 0), 0)]
        while todo:
            u, v, differing = todo.pop()
            below = [
                [(2 * p, d + 1), (2 * p + 1, d + 1)] if splits(p, d) else [(p, d)] for p, d in (u, v)
            ]
            if len(below[0]) == len(below[1]) == 1:
                if size(*u) and size(*v):
                    a, b = (leaves.setdefault(x, len(leaves)) for x in (u, v))
                    found.add((min(a, b), max(a, b)))
                continue
            for x in below[0]:
                for y in below[1]:
                    if u == v and x > y:
                        continue
                    d = self.differing(x, y)
                    if d <= budget:
                        todo.append((x, y, d))
        self.pairs = sorted(found)
        self.leaf_of = np.full(1 << HISTOGRAM_BITS, -1, np.int32)
        for (prefix, depth), i in leaves.items():
            width = 1 << (HISTOGRAM_BITS - depth)
            self.leaf_of[prefix * width : (prefix + 1) * width] = i
        self.of_leaf: list[list[tuple[int, int]]] = [[] for _ in leaves]
        for k, (a, b) in enumerate(self.pairs):
            self.of_leaf[a].append((k, 0))
            if a != b:
                self.of_leaf[b].append((k, 1))

    @staticmethod
    def differing(u: tuple[int, int], v: tuple[int, int]) -> int:
        depth = min(u[1], v[1])
        return ((u[0] >> (u[1] - depth)) ^ (v[0] >> (v[1] - depth))).bit_count()


def join_subtrees(left: np.ndarray, right: np.ndarray | None, budget: int = 3, leaf: int = 8, chunk: int = 400_000):
    """Local components of the fingerprints of one or two trie subtrees; ``(index, root index)`` of linked ones.

    ``left`` and ``right`` are sorted and distinct; indices run over both. Node pairs are ranges of the sorted
    arrays, traversed together from the root: the differing bits so far are carried along, a pair over the
    budget is dropped with all below it, and pairs of small nodes are compared outright. Pairs whose leaves
    are one component already are dropped too, so a dense group costs its members, not their pairs. The
    frontier is taken in pieces of ``chunk`` pairs, depth first, so memory does not depend on it.
    """
    both = right is not None
    values = np.concatenate([left, right]) if both else left
    parent = np.arange(len(values))

    def union(a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = parent[a], parent[b]
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = parent[parent]
                if (up == parent).all():
                    break
                parent[:] = up

    def compare(a0, a1, b0, b1):
        size = (a1 - a0) * (b1 - b0)
        for lo in range(0, len(size), 65_536):
            part = slice(lo, lo + 65_536)
            n = size[part]
            row = np.repeat(np.arange(len(n)), n)
            k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            width = (b1 - b0)[part][row]
            i, j = a0[part][row] + k // width, b0[part][row] + k % width
            near = np.bitwise_count(values[i] ^ values[j]) <= budget
            i, j = i[near], j[near]
            keep = (i != j) & (parent[i] != parent[j])
            union(i[keep], j[keep])

    n_left, one = len(left), np.array([0])
    second = (np.array([n_left]), np.array([len(values)])) if both else (one, np.array([n_left]))
    stack = [(0, one, np.array([n_left]), *second)]

    def child_bounds(lo, hi, depth):
        """Where the 1-branch of each node begins."""
        bit = np.uint64(1 << (BITS - 1 - depth))
        ones = np.concatenate([[0], np.cumsum((values & bit) != 0)])
        return hi - (ones[hi] - ones[lo])

    while stack:
        depth, a0, a1, b0, b1 = stack.pop()
        if len(a0) > chunk:
            half = len(a0) // 2
            stack += [(depth, a0[half:], a1[half:], b0[half:], b1[half:]), (depth, a0[:half], a1[:half], b0[:half], b1[:half])]
            continue
        small = ((a1 - a0) <= leaf) & ((b1 - b0) <= leaf)
        if small.any() or depth == BITS:
            take = small if depth < BITS else np.ones(len(a0), bool)
            compare(a0[take], a1[take], b0[take], b1[take])
            a0, a1, b0, b1 = (x[~take] for x in (a0, a1, b0, b1))
        if not len(a0):
            continue
        change = np.concatenate([[0], np.cumsum(parent[1:] != parent[:-1])])  # a run without change is one component
        done = (change[a0] == change[a1 - 1]) & (change[b0] == change[b1 - 1]) & (parent[a0] == parent[b0])
        a0, a1, b0, b1 = (x[~done] for x in (a0, a1, b0, b1))
        if not len(a0):
            continue
        am, bm = child_bounds(a0, a1, depth), child_bounds(b0, b1, depth)
        first = values[a0] ^ values[b0]
        gone = np.bitwise_count(first >> np.uint64(BITS - depth)) if depth else np.zeros(len(a0), np.uint8)
        below = []
        own = (a0 == b0) & (a1 == b1)
        for x0, x1, y0, y1, step, skip in (  # equal branches first: what they join, the others then skip
            (a0, am, b0, bm, 0, False), (am, a1, bm, b1, 0, False), (a0, am, bm, b1, 1, False), (am, a1, b0, bm, 1, own),
        ):
            ok = (x0 < x1) & (y0 < y1) & (gone + step <= budget) & ~np.asarray(skip)
            below.append([x[ok] for x in (x0, x1, y0, y1)])
        stack.append((depth + 1, *(np.concatenate(x) for x in zip(*below))))
    linked = np.flatnonzero(parent != np.arange(len(values)))
    return linked, parent[linked]


def trie_links(fps: DataFrame, budget: int = 3, subtree: int = 200_000, least_depth: int = 3) -> DataFrame:
    """``(a, b)`` links over distinct ``(fp, rep)``: enough of them to connect all within ``budget`` bits.

    Each task joins two subtrees of at most ``subtree`` fingerprints (more only if over that many share their
    first 16 bits), 16 bytes each. A fingerprint is sent once for each subtree within the budget of its own.
    """
    top = F.shiftrightunsigned("fp", BITS - HISTOGRAM_BITS).cast("int")
    counts = np.zeros(1 << HISTOGRAM_BITS, np.int64)
    for row in fps.groupBy(top.alias("p")).count().collect():  # 65,536 counts at most
        counts[row.p] = row["count"]
    cut = TrieCut(counts, subtree, least_depth, budget)
    leaf_of, of_leaf = cut.leaf_of, cut.of_leaf

    def place(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy()
            leaves = leaf_of[(fp.view(np.uint64) >> np.uint64(BITS - HISTOGRAM_BITS)).astype(np.int64)]
            for leaf in np.unique(leaves):
                rows = batch.take(pa.array(np.flatnonzero(leaves == leaf)))
                for pair, side in of_leaf[leaf]:
                    n = rows.num_rows
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, pair, np.int32)), pa.array(np.full(n, side, np.int8)), *rows.columns],
                        names=["pair", "side", "fp", "rep"],
                    )

    def join(table: pa.Table) -> pa.Table:
        fp, rep = table["fp"].to_numpy().view(np.uint64), table["rep"].to_numpy()
        side = table["side"].to_numpy()
        sides = []
        for s in (0, 1):
            own = np.flatnonzero(side == s)
            sides.append(own[np.argsort(fp[own])])
        right = fp[sides[1]] if len(sides[1]) else None
        at, root = join_subtrees(fp[sides[0]], right, budget)
        ids = rep[np.concatenate(sides)]
        return pa.table({"a": ids[at], "b": ids[root]})

    spread = fps.select("fp", "rep").mapInArrow(place, "pair int, side byte, fp long, rep long")
    return spread.groupBy("pair").applyInArrow(join, "a long, b long")


def simhash_components(docs: DataFrame, shingle: int = 3, budget: int = 3) -> DataFrame:
    """``doc_id, fp, component_id`` per row of ``docs``: documents linked by fingerprints at most ``budget`` bits apart.

    ``component_id`` is the smallest doc_id reachable. Equal fingerprints meet first, so copies of any number
    are one entry of the join. Texts without words have fingerprint 0 and are linked like any other. Rows with
    a null doc_id keep a place in the result and take the component of their fingerprint; they give no id.
    Repeated doc_ids: each row stays; two texts of one doc_id are joined where it is the smallest of both.
    """
    known = scratch(fingerprints(docs, shingle), "fingerprints")
    reps = scratch(known.groupBy("fp").agg(F.min("doc_id").alias("rep")), "fingerprint-reps")
    links = trie_links(reps.filter("rep IS NOT NULL"), budget)
    found = connected_components(links)
    of_rep = reps.join(found, reps.rep == found.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return known.join(of_rep, "fp").select("doc_id", "fp", "component_id")


def keep_representatives(docs: DataFrame, shingle: int = 3, budget: int = 3) -> DataFrame:
    """Rows of ``docs``, all columns: one document of each component, that of the smallest doc_id.

    Of rows that repeat this doc_id one stays, the first in order of its text. Rows with a null doc_id belong to
    no document that could be kept in their place, and stay.
    """
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    doc_id, text = F.col(f"c{names.index('doc_id')}").cast("long"), F.col(f"c{names.index('text')}")
    groups = scratch(simhash_components(docs.select("doc_id", "text"), shingle, budget), "simhash-groups")
    later = groups.filter("doc_id <> component_id").select(F.col("doc_id").alias("__later")).distinct()
    rows = plain.withColumn("__id", doc_id)
    kept = rows.join(broadcast_if_small(later, 400_000), F.col("__id") == F.col("__later"), "left_anti")
    again = groups.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("__again")).count().filter("count > 1").select("__again")
    if again.isEmpty():
        return kept.select(*plain.columns).toDF(*names)
    again = broadcast_if_small(again, 400_000)
    once = kept.join(again, F.col("__id") == F.col("__again"), "left_anti").select(*plain.columns)
    many = kept.join(again, F.col("__id") == F.col("__again"), "left_semi")
    first = many.groupBy("__id").agg(F.min_by(F.struct(*plain.columns), F.struct(F.xxhash64(text), text)).alias("r"))
    return once.union(first.select("r.*")).toDF(*names)
