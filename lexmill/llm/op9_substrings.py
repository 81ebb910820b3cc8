"""Substring dedup: suffix automata of reference shards, matching statistics, removal of repeated word windows."""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.common import per_batch, scratch, texts
from lexmill.llm.wordbuf import PLAIN, Words, inside_docs, mix, odd_weights, powers, windows, words
from lexmill.session import broadcast_if_small

GRAM = 6  # words of an anchor
OCCURRENCE = "anchor long, content long, doc_id long, start int, n int, more binary"
WANTED = "anchor long, doc_id long, start int, words binary"
CLEANED = "doc_id long, n_words long, n_removed long, kept binary"


def anchors(w: Words, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(window start, anchor place, anchor hash)`` of every window of ``width`` words.

    The anchor of a window is its smallest gram, the leftmost of equals, so equal windows have equal anchors.
    """
    grams = windows(w.hash, odd_weights(GRAM, 91))
    at = np.flatnonzero(inside_docs(w, width))
    span = width - GRAM + 1
    n = len(grams) - span + 1
    if n <= 0 or not len(at):
        return at[:0], at[:0], np.zeros(0, np.uint64)
    best, place = grams[:n].copy(), np.arange(n)
    for k in range(1, span):
        lower = grams[k : k + n] < best
        best[lower] = grams[k : k + n][lower]
        place[lower] = np.flatnonzero(lower) + k
    return at, place[at], best[at]


def segments_of(w: Words, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor place: ``(first window, number of windows, anchor hash)``."""
    at, place, value = anchors(w, width)
    if not len(at):
        return at, at, value
    new = np.concatenate([[True], (place[1:] != place[:-1]) | (w.doc[at[1:]] != w.doc[at[:-1]])])
    first = np.flatnonzero(new)
    return at[first], np.diff(np.append(first, len(at))), value[first]


class SuffixAutomaton:
    """All substrings of the sequences added so far, each state with the length of its longest one."""

    def __init__(self):
        self.next, self.link, self.length = [{}], [-1], [0]

    def start(self) -> None:
        self.last = 0

    def extend(self, symbol) -> None:
        nxt, link, length = self.next, self.link, self.length
        p = self.last
        if symbol in nxt[p]:  # a sequence that begins as an earlier one did
            q = nxt[p][symbol]
            self.last = q if length[q] == length[p] + 1 else self._clone(p, q, symbol)
            return
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[p] + 1)
        while p >= 0 and symbol not in nxt[p]:
            nxt[p][symbol] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][symbol]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, q, symbol)
        self.last = cur

    def _clone(self, p: int, q: int, symbol) -> int:
        nxt, link, length = self.next, self.link, self.length
        copy = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        while p >= 0 and nxt[p].get(symbol) == q:
            nxt[p][symbol] = copy
            p = link[p]
        link[q] = copy
        return copy

    def matching_statistics(self, sequence) -> list[int]:
        """For each place the length of the longest suffix up to it that has been added."""
        nxt, link, length = self.next, self.link, self.length
        state = size = 0
        out = []
        for symbol in sequence:
            while state and symbol not in nxt[state]:
                state = link[state]
                size = length[state]
            if symbol in nxt[state]:
                state = nxt[state][symbol]
                size += 1
            out.append(size)
        return out


def stream_shard(rows, width: int):
    """Yields ``(row index, window flags)``: of sequences in order, which windows an earlier one contains.

    ``rows`` are (key, sequence) in order of first occurrence within a key. One automaton serves a key and is
    given up with it.
    """
    key = automaton = None
    for i, (own, sequence) in enumerate(rows):
        if own != key:
            key, automaton = own, SuffixAutomaton()
        else:
            flags = [m >= width for m in automaton.matching_statistics(sequence)[width - 1 :]]
            if any(flags):
                yield i, flags
            if all(flags):
                continue
        automaton.start()
        for symbol in sequence:
            automaton.extend(symbol)


_PLACE = np.dtype([("doc", "<i8"), ("start", "<i4"), ("n", "<i4")])


def occurrences(docs: DataFrame, width: int) -> DataFrame:
    """Segments of all texts: anchor, hash of the content, document, start and number of windows.

    Equal segments of a block of texts are one row, the first of them, with the places of the others packed in
    ``more``: copies of any number leave a task as one row a block.
    """

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        w = words(batch.column(1), PLAIN)
        first, n, anchor = segments_of(w, width)
        if not len(first):
            return None
        # hash of the run of n + width - 1 words from the sums of all words before
        up, down = powers(len(w.hash) + 1)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(w.hash * up[: len(w.hash)])])
        last = first + n + width - 1
        content = mix((sums[last] - sums[first]) * down[first] + n.astype(np.uint64))
        place = np.empty(len(first), _PLACE)
        place["doc"] = batch.column(0).to_numpy()[w.doc[first]]
        place["start"], place["n"] = first - w.bounds[w.doc[first]], n
        order = np.lexsort((place["start"], place["doc"], content, anchor))
        place, anchor, content = place[order], anchor[order], content[order]
        new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (content[1:] != content[:-1])])
        heads = np.flatnonzero(new)
        sizes = np.diff(np.append(heads, len(place)))
        more: list[bytes | None] = [None] * len(heads)
        for k in np.flatnonzero(sizes > 1).tolist():
            more[k] = place[heads[k] + 1 : heads[k] + sizes[k]].tobytes()
        head = place[heads]
        return pa.RecordBatch.from_arrays(
            [pa.array(anchor[heads].view(np.int64)), pa.array(content[heads].view(np.int64)), pa.array(head["doc"].copy()),
             pa.array(head["start"].copy()), pa.array(head["n"].copy()), pa.array(more, pa.binary())],
            names=[c.split()[0] for c in OCCURRENCE.split(", ")],
        )

    return texts(docs).filter("doc_id IS NOT NULL").mapInArrow(per_batch(one), OCCURRENCE)


def repeated_segments(docs: DataFrame, width: int) -> DataFrame:
    """Occurrences that may hold a repeated window: their anchor occurs again. ``is_first`` of their content, ``mixed`` if
    the anchor has several contents."""
    rows = occurrences(docs, width).repartition("anchor")
    same, all_of = Window.partitionBy("anchor", "content"), Window.partitionBy("anchor")
    marked = rows.withColumns({
        "first": F.min(F.struct("doc_id", "start")).over(same), "copies": F.count("*").over(same),
        "low": F.min("content").over(all_of), "high": F.max("content").over(all_of),
    })
    return marked.filter("copies > 1 OR more IS NOT NULL OR low <> high").select(
        "anchor", "content", "doc_id", "start", "n", "more",
        F.expr("doc_id = first.doc_id AND start = first.start").alias("is_first"), F.expr("low <> high").alias("mixed"),
    )


def later_copies(repeated: DataFrame) -> DataFrame:
    """``doc_id, start, n``: window runs of segments whose whole content occurs earlier."""

    def unpack(batches):
        for batch in batches:
            blobs = batch.column(0).to_pylist()
            place = np.frombuffer(b"".join(blobs), _PLACE)
            yield pa.RecordBatch.from_arrays(
                [pa.array(place["doc"].copy()), pa.array(place["start"].copy()), pa.array(place["n"].copy())], names=["doc_id", "start", "n"]
            )

    packed = repeated.filter("more IS NOT NULL").select("more").mapInArrow(unpack, "doc_id long, start int, n int")
    return repeated.filter("NOT is_first").select("doc_id", "start", "n").union(packed)


def segment_words(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """``anchor, doc_id, start, words``: the word hashes of the wanted segments, from their texts."""
    lists = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "start", "n")).alias("wanted"))
    rows = texts(docs).join(lists, "doc_id").select("doc_id", "text", "wanted")

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        w = words(batch.column(1), PLAIN)
        raw, out = w.hash.astype("<u8").tobytes(), []
        for d, (doc_id, segments) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())):
            base, end = int(w.bounds[d]), int(w.bounds[d + 1])
            for x in segments:
                lo = base + x["start"]
                out.append((x["anchor"], doc_id, x["start"], raw[8 * lo : 8 * min(end, lo + x["n"] + width - 1)]))
        columns = zip(*out) if out else [()] * 4
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["anchor", "doc_id", "start", "words"])

    return rows.mapInArrow(per_batch(one), WANTED)


def earlier_windows(segments: DataFrame, width: int) -> DataFrame:
    """``doc_id, start, n``: window runs of first segments that an earlier segment of their anchor contains.

    The segments of an anchor are a reference shard: nothing else can hold their windows, so documents are
    streamed only past the automata that can match. A shard's automaton grows with its different contents.
    """

    def stream(batches):
        places: list[tuple[int, int]] = []

        def rows():
            for batch in batches:
                for anchor, doc_id, start, blob in zip(*(c.to_pylist() for c in batch.columns)):
                    places.append((doc_id, start))
                    yield anchor, np.frombuffer(blob, "<u8").tolist()

        ready: list[tuple[int, int, int]] = []
        for _, flags in stream_shard(rows(), width):
            doc_id, start = places[-1]
            edge = np.flatnonzero(np.diff(np.concatenate([[0], np.array(flags, np.int8), [0]])))
            ready += [(doc_id, start + a, b - a) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist())]
            places.clear()
            if len(ready) >= 20_000:
                yield _runs(ready)
                ready = []
        if ready:
            yield _runs(ready)

    ordered = segments.repartition("anchor").sortWithinPartitions("anchor", "doc_id", "start")
    return ordered.mapInArrow(stream, "doc_id long, start int, n int")


def _runs(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["doc_id", "start", "n"])


def crowded_windows(segments: DataFrame, width: int) -> DataFrame:
    """As ``earlier_windows`` for anchors of very many contents: their windows are grouped by hash, spread over all tasks."""

    def cut(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 20_000):
                out = []
                for doc_id, start, blob in zip(*(c.to_pylist() for c in batch.slice(lo, 20_000).columns[1:])):
                    for k in range(len(blob) // 8 - width + 1):
                        digest = hashlib.blake2b(blob[8 * k : 8 * (k + width)], digest_size=16).digest()
                        out.append((digest, doc_id, start + k))
                kinds = [pa.binary(), pa.int64(), pa.int32()]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["w", "doc_id", "start"])

    rows = segments.mapInArrow(cut, "w binary, doc_id long, start int")
    first = rows.groupBy("w").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count("*").alias("copies")).filter("copies > 1")
    later = rows.join(first, "w").filter("NOT (doc_id = first.doc_id AND start = first.start)")
    return later.select("doc_id", "start", F.lit(1).alias("n"))


def covered_windows(docs: DataFrame, width: int = 20, most_contents: int = 50_000) -> DataFrame:
    """``doc_id, runs``: runs of windows (start, n) whose words also start earlier, by document.

    Anchors of more than ``most_contents`` contents go the way of ``crowded_windows``; the runs are the same.
    """
    repeated = scratch(repeated_segments(docs, width), "repeated-segments")
    wanted = repeated.filter("is_first AND mixed")
    crowded = wanted.groupBy("anchor").count().filter(F.col("count") > most_contents).select("anchor")
    crowded = scratch(crowded, "crowded-anchors")
    runs = later_copies(repeated)
    if crowded.isEmpty():
        runs = runs.union(earlier_windows(segment_words(docs, wanted, width), width))
    else:
        segments = scratch(segment_words(docs, wanted, width), "segment-words")
        usual = segments.join(broadcast_if_small(crowded), "anchor", "left_anti")
        rest = segments.join(broadcast_if_small(crowded), "anchor", "left_semi")
        runs = runs.union(earlier_windows(usual, width)).union(crowded_windows(rest, width))
    return runs.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("runs"))


def remove_repeats(docs: DataFrame, width: int = 20) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` per row: the words left, joined by one blank, as bytes.

    A word goes if a window of ``width`` words around it also starts earlier (smaller doc_id, or earlier in the
    same text); windows are judged on the input. Words are compared by 64-bit hashes. Null or empty texts
    have no words; rows with a null doc_id keep all their words and are nobody's earlier text; rows that
    share a doc_id are taken as one document. Other columns are not read.
    """
    cover = scratch(covered_windows(docs, width), "covered-windows")
    rows = texts(docs).join(cover, "doc_id", "left").select("doc_id", "text", "runs")

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        total, removed, kept = [], [], []
        for text, runs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            ws = text.encode().split()  # bytes part at ASCII white space only
            n = len(ws)
            if runs:
                depth = np.zeros(n + 1, np.int32)
                for x in runs:
                    depth[x["start"]] += 1
                    depth[min(n, x["start"] + x["n"] + width - 1)] -= 1
                ws = [ws[i] for i in np.flatnonzero(np.cumsum(depth[:n]) == 0)]
            total.append(n)
            removed.append(n - len(ws))
            kept.append(b" ".join(ws))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())],
            names=["doc_id", "n_words", "n_removed", "kept"],
        )

    return rows.mapInArrow(per_batch(one), CLEANED)


def dedup_digests(docs: DataFrame, width: int = 20) -> DataFrame:
    """``remove_repeats`` with the SHA-256 of the kept text in its place."""
    return remove_repeats(docs, width).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
