"""Byte-level BPE encoding and decoding with a hierarchical-bitmap queue of merge ranks."""

import base64
import hashlib
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lexmill.llm.common import per_batch, texts

ENCODED = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()),
    T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("round_trip", T.BooleanType()),
])
DIGESTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()),
    T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()),
])


def read_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary file: one base64 token and its rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def merge_pieces(pieces: list[bytes], ranks: dict[bytes, int], pair_ranks: np.ndarray) -> list[tuple[int, ...]]:
    """Ids of each pre-token: lowest rank first, leftmost among equals, until no neighbours merge.

    The pre-tokens stand one after another in one buffer and share one queue; no pair reaches over an edge. Waiting
    pairs stand in buckets by rank. ``words`` holds a bit for each rank with a bucket and ``summary`` a bit for each
    word that has any, so two find-first-set steps give the next rank, whose bucket is then worked off from the left;
    what is left of it waits again if a lower rank turns up. A pair that changes is not deleted: ``waiting`` names the
    rank that counts at each position, and other entries are skipped as stale. ``pair_ranks`` has the rank of each two
    bytes at ``256 * first + second``, -1 for none. One function, as calls would cost more than the steps.
    """
    out: list = [None] * len(pieces)
    todo = []
    for k, piece in enumerate(pieces):
        if piece in ranks:
            out[k] = (ranks[piece],)
        elif piece:
            todo.append(k)
        else:
            out[k] = ()
    if not todo:
        return out
    data = b"".join(pieces[k] for k in todo)
    n = len(data)
    raw = np.frombuffer(data, np.uint8).astype(np.int64)
    edges = np.cumsum([0, *(len(pieces[k]) for k in todo)])
    end = list(range(1, n + 1))  # where the part that starts at i ends
    before = np.arange(-1, n - 1)
    before[edges[:-1]] = -1
    before = before.tolist()
    edge = bytearray(n + 1)  # whether a pre-token starts here
    for i in edges.tolist():
        edge[i] = 1
    pairs = np.full(n, -1, np.int64)
    pairs[:-1] = pair_ranks[256 * raw[:-1] + raw[1:]]
    pairs[edges[1:] - 1] = -1
    order = np.argsort(pairs, kind="stable")
    order = order[np.searchsorted(pairs[order], 0) :]  # positions rise within a rank
    starts = np.flatnonzero(np.diff(pairs[order], prepend=-1))
    filled, order, starts = pairs[order[starts]].tolist(), order.tolist(), [*starts.tolist(), len(order)]
    buckets = {rank: order[first:last] for rank, first, last in zip(filled, starts, starts[1:])}
    waiting = pairs.tolist()
    summary, words = 0, {}
    for rank in buckets:
        words[rank >> 6] = words.get(rank >> 6, 0) | 1 << (rank & 63)
    for word in words:
        summary |= 1 << word
    ids = np.array([ranks.get(bytes((b,)), -1) for b in range(256)])[raw].tolist()  # of the part that starts at i, -2 inside a part
    find = ranks.get
    while summary:
        word = (summary & -summary).bit_length() - 1
        bits = words[word]
        rank = (word << 6) + (bits & -bits).bit_length() - 1
        bucket = buckets.pop(rank)
        bits &= bits - 1
        words[word] = bits
        if not bits:
            summary ^= 1 << word
        if len(bucket) > 1:
            bucket.sort()
        for at, i in enumerate(bucket):
            if waiting[i] != rank:
                continue  # stale: one half has merged since
            j = end[i]
            stop = end[i] = end[j]
            waiting[i] = waiting[j] = -1
            ids[i], ids[j] = rank, -2
            left = before[i]
            lower = False
            if not edge[stop]:
                before[stop] = i
                new = find(data[i : end[stop]])
                if new is not None:
                    waiting[i] = new
                    if new in buckets:
                        buckets[new].append(i)
                    else:
                        buckets[new] = [i]
                        word = new >> 6
                        words[word] = words.get(word, 0) | 1 << (new & 63)
                        summary |= 1 << word
                    if new <= rank:
                        lower = True
            if left >= 0:
                new = find(data[left:stop])
                if new is None:
                    waiting[left] = -1
                elif new != waiting[left]:
                    waiting[left] = new
                    if new <= rank:
                        lower = True
                    if new in buckets:
                        buckets[new].append(left)
                    else:
                        buckets[new] = [left]
                        word = new >> 6
                        words[word] = words.get(word, 0) | 1 << (new & 63)
                        summary |= 1 << word
            if lower:  # the rest of the bucket comes after the lower rank
                rest = bucket[at + 1 :] + buckets.get(rank, [])
                if rest:
                    buckets[rank] = rest
                    word = rank >> 6
                    words[word] = words.get(word, 0) | 1 << (rank & 63)
                    summary |= 1 << word
                break
    ids = np.array(ids)
    live = np.flatnonzero(ids != -2)
    ids = ids[live].tolist()
    if -1 in ids:
        raise KeyError(data[live[ids.index(-1)] :][:1])
    bounds = np.searchsorted(live, edges).tolist()
    for k, first, last in zip(todo, bounds, bounds[1:]):
        out[k] = tuple(ids[first:last])
    return out


MERGED = 1 << 14  # bytes of pre-tokens that are merged together
REMEMBERED = 200_000  # pre-tokens of a generation, about 0.4 KB each
_codecs: dict[tuple[str, str, int], "Codec"] = {}


class Codec:
    """Encoder and decoder of one worker, kept from task to task.

    Short pre-tokens are remembered in two generations of ``remember`` each: when the younger is full it becomes
    the older, and what is met again moves up, so frequent ones stay and memory is bounded. What is remembered of a
    pre-token is its ids, the same written with commas, and the bytes that the ids decode to.
    """

    def __init__(self, path: str, pattern: str, remember: int = REMEMBERED, longest_remembered: int = 64):
        import regex

        self.ranks = read_ranks(path)
        self.pair_ranks = np.array([self.ranks.get(bytes((a, b)), -1) for a in range(256) for b in range(256)])
        self.split = regex.compile(pattern).findall
        self.known: dict[str, tuple[tuple[int, ...], str, bytes]] = {}
        self.older: dict[str, tuple[tuple[int, ...], str, bytes]] = {}
        self.remember, self.longest = remember, longest_remembered
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.own = {rank: rank for rank in self.tokens}  # one int object a rank, however often it is remembered
        self.names = {rank: str(rank) for rank in self.tokens}

    @classmethod
    def shared(cls, path: str, pattern: str, remember: int) -> "Codec":
        """The worker's codec of this vocabulary and pattern, which remembers so many pre-tokens."""
        if (path, pattern, remember) not in _codecs:
            _codecs[path, pattern, remember] = cls(path, pattern, remember)
        return _codecs[path, pattern, remember]

    def encoded(self, texts: list[str]) -> list[list[tuple[tuple[int, ...], str, bytes]]]:
        """For each text its pre-tokens: ids, ids as text, bytes of the decoded ids. New ones are merged together."""
        if len(self.known) > self.remember:
            self.older, self.known = self.known, {}
        pieces = [self.split(text) for text in texts]
        known, fresh = self.known, []
        new = set(chain.from_iterable(pieces)).difference(known)
        for piece in new:
            if (of := self.older.get(piece)) is None:
                fresh.append(piece)
            else:
                known[piece] = of
        raw = [piece.encode() for piece in fresh]
        part = [size // MERGED for size in accumulate(map(len, raw))]
        for first, last in _runs(part):
            for piece, ids in zip(fresh[first:last], merge_pieces(raw[first:last], self.ranks, self.pair_ranks)):
                known[piece] = tuple(map(self.own.__getitem__, ids)), ",".join(map(self.names.__getitem__, ids)), self.decode(ids)
        out = [list(map(known.__getitem__, row)) for row in pieces]
        for piece in new:
            if len(piece) > self.longest:
                del known[piece]
        return out

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(ids for ids, _, _ in self.encoded([text])[0]))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def _runs(values: list[int]):
    """Bounds of the runs of equal values."""
    start = 0
    for i in range(1, len(values) + 1):
        if i == len(values) or values[i] != values[start]:
            yield start, i
            start = i


def _mapped(docs: DataFrame, path: str, pattern: str, schema: T.StructType, columns, remember: int, limit: int) -> DataFrame:
    """``columns(codec, texts)`` gives the arrays after doc_id, of ``limit`` bytes of texts at a time."""

    def run(batches):
        codec = Codec.shared(path, pattern, remember)

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [batch.column(0), *columns(codec, batch.column(1).to_pylist())], names=[f.name for f in schema]
            )

        yield from per_batch(one, limit=limit)(batches)

    return texts(docs).mapInArrow(run, schema)


def bpe_encode(docs: DataFrame, path: str, pattern: str, remember: int = 40_000) -> DataFrame:
    """``doc_id, n_tokens, ids, round_trip`` of every whole text: pre-tokens of ``pattern`` merged by the ranks at ``path``.

    ``round_trip`` says that decoding the ids gives the text's bytes back.

    One row for each row of ``docs``, in no order; the text stays in its partition and nothing is shuffled.
    Null or empty text: no ids. Null or repeated doc_id: the row is encoded like any other. Other columns are
    not read. ``path`` is a vocabulary file that every worker has, as an installed package. ``remember`` bounds what a
    worker keeps between texts: as a stage of a pipeline it shares an executor with what the stages before it left.
    """

    def columns(codec: Codec, rows: list[str]):
        texts = codec.encoded(rows)
        ids = [list(chain.from_iterable(x for x, _, _ in parts)) for parts in texts]
        yield pa.array([len(x) for x in ids], pa.int64())
        yield pa.array(ids, pa.list_(pa.int32()))
        yield pa.array([b"".join([x for _, _, x in parts]) == t.encode() for parts, t in zip(texts, rows)], pa.bool_())

    return _mapped(docs, path, pattern, ENCODED, columns, remember, 1 << 19)


def bpe_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """As ``bpe_encode`` with SHA-256 digests of the comma-joined ids and of the decoded bytes in their place."""

    def columns(codec: Codec, rows: list[str]):
        counts, ids_sha, text_sha = [], [], []
        for parts in codec.encoded(rows):
            ids = ",".join([x for _, x, _ in parts])
            counts.append(ids.count(",") + 1 if ids else 0)
            ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
            text_sha.append(hashlib.sha256(b"".join([x for _, _, x in parts])).hexdigest())
        yield pa.array(counts, pa.int64())
        yield pa.array(ids_sha, pa.string())
        yield pa.array(text_sha, pa.string())

    return _mapped(docs, path, pattern, DIGESTS, columns, REMEMBERED, 2 << 20)
