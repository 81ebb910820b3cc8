"""Token counts of a piece model: distinct pre-tokens are counted once and joined to document frequencies."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lexmill.llm.common import per_batch, texts

COUNTS = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
MARK = "▁"  # what the piece model writes for a blank
SEGMENT = re.compile(r" *[^ ]+| +")


def pretokens(text: str) -> list[str]:
    """Pre-tokens of a text, each without the first of its leading blanks.

    The model puts one blank before a text, no piece has a blank after another character, and runs of blanks
    may join the word that follows: so merges never cross the place before such a run.
    """
    if not text:
        return []
    if MARK in text:
        text = text.replace(MARK, " ")
    if "  " not in text and text[0] != " " and text[-1] != " ":
        return text.split(" ")
    return [s[1:] for s in SEGMENT.findall(" " + text)]


class PieceCounter:
    """Numbers of pieces by pre-token; remembers up to ``remember`` of them between blocks of one task."""

    def __init__(self, path: str, remember: int = 300_000):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.known: dict[str, int] = {}
        self.remember = remember

    def count(self, distinct: list[str]) -> np.ndarray:
        known = self.known
        new = [t for t in distinct if t not in known]
        if len(known) + len(new) > self.remember:
            known.clear()
            new = distinct
        for lo in range(0, len(new), 20_000):
            part = new[lo : lo + 20_000]
            known.update(zip(part, map(len, self.model.encode(part, num_threads=1))))
        if "" in known:
            known[""] = 1  # a lone blank is one piece
        out = np.fromiter(map(known.__getitem__, distinct), np.int64, len(distinct))
        if len(known) > self.remember:
            known.clear()
        return out


def count_block(rows: list[str], counter: PieceCounter) -> np.ndarray:
    """Tokens of each text: (document, pre-token, frequency) rows joined to the counts of distinct pre-tokens."""
    place: dict[str, int] = {}
    docs, tokens, frequency = [], [], []
    for d, text in enumerate(rows):
        own = Counter(pretokens(text))
        tokens.extend([place.setdefault(t, len(place)) for t in own])
        frequency.extend(own.values())
        docs.append(len(own))
    pieces = counter.count(list(place))
    row = np.repeat(np.arange(len(rows)), docs)
    weight = pieces[np.array(tokens, np.int64)] * np.array(frequency, np.int64) if tokens else np.zeros(0)
    return np.bincount(row, weight, len(rows)).astype(np.int64)


def token_counts(docs: DataFrame, path: str, limit: int = 4096, block_bytes: int = 8 << 20) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every whole text as the piece model at ``path`` cuts it.

    Per block of texts the pre-tokens are counted once each, joined to the (document, pre-token) frequencies
    and summed; ids of a text are never made. Blocks need nothing of each other, so nothing is shuffled. Null
    or empty text: 0 bytes, 0 tokens. One row per row of ``docs``; a null or repeated doc_id is carried along.
    ``path`` is a model file that every worker has, as an installed package.
    """

    def run(batches):
        counter = PieceCounter(path)

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = batch.column(1).to_pylist()
            n = count_block(rows, counter)
            size = [len(t.encode()) for t in rows]
            return pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(n), pa.array(n > limit)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

        yield from per_batch(one, limit=block_bytes)(batches)

    return texts(docs).mapInArrow(run, COUNTS)
