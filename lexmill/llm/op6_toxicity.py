"""Toxicity: a support vector machine over a gapped subsequence string kernel with Nyström landmarks."""

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import labelled_sample, per_batch, texts

SCORED = "doc_id long, held_out boolean, score double, predicted int"
ORDER = 4  # characters of a subsequence
DECAY = 0.6  # weight of each character skipped between two of them; at most one is skipped at a place
BINS = 1 << 18
_EDGE, _OTHER = 0, 58
# Digits and signs that stand for letters, and letters with marks that keep a symbol of their own.
_STANDS_FOR = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a"}
_MARKED = "àâäáãåçèéêëîïíìñôöóòõœùûüúßæ"


def _symbol_table() -> np.ndarray:
    """Code point to symbol, -1 for what is skipped, -2 for white space; from 0x370 on letters share six symbols."""
    table = np.full(0x370, -1, np.int8)
    for c in range(0x370):
        low = chr(c).lower()[:1]
        if low in _MARKED:
            table[c] = 27 + _MARKED.index(low)
        elif "a" <= low <= "z":
            table[c] = ord(low) - 96
        elif low in _STANDS_FOR:
            table[c] = ord(_STANDS_FOR[low]) - 96
        elif low.isspace():
            table[c] = -2
        elif low.isalpha():
            table[c] = _OTHER
    return table


_TABLE = _symbol_table()
_STEPS = [(a, b, c) for a in (1, 2) for b in (1, 2) for c in (1, 2)]


@dataclass
class Units:
    """Symbols of many texts, one unit (word, or run of single letters) after another, edges marked."""

    symbols: np.ndarray
    unit: np.ndarray
    doc: np.ndarray  # by unit


def units_of(rows: list[str]) -> Units:
    """Units of all texts. Signs inside a word are dropped; three or more single letters in a row are one unit."""
    joined = "\n".join(rows)
    code = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    near = code < len(_TABLE)
    symbol = np.where(near, _TABLE[np.where(near, code, 0)], _OTHER + (code % 6).astype(np.int8))
    ends = np.cumsum([len(t) + 1 for t in rows])
    at = np.arange(len(code))
    doc = np.searchsorted(ends, at, "right")
    space = symbol == -2
    word = np.cumsum(space)
    real = symbol >= 0
    symbol, word, doc = symbol[real], word[real], doc[real]
    if not len(symbol):
        return Units(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    first = np.concatenate([[True], word[1:] != word[:-1]])
    starts = np.flatnonzero(first)
    size = np.diff(np.append(starts, len(symbol)))
    word_doc = doc[starts]
    single = size == 1
    follows = np.concatenate([[False], single[1:] & single[:-1] & (word_doc[1:] == word_doc[:-1])])
    run = np.cumsum(~follows)
    long_run = np.bincount(run)[run] >= 3
    merged = follows & long_run
    unit_of_word = np.cumsum(~merged) - 1
    n_units = int(unit_of_word[-1]) + 1
    unit = np.repeat(unit_of_word, size)
    own = np.bincount(unit, minlength=n_units)
    offset = np.concatenate([[0], np.cumsum(own + 2)])
    out = np.full(int(offset[-1]), _EDGE, np.int64)
    place = offset[unit] + 1 + np.arange(len(unit)) - np.concatenate([[0], np.cumsum(own)])[unit]
    out[place] = symbol
    return Units(out, np.repeat(np.arange(n_units), own + 2), word_doc[~merged])


def features(u: Units):
    """Yields ``(unit, bin, weight)`` arrays of all subsequences, one gap pattern at a time."""
    n = len(u.symbols)
    for a, b, c in _STEPS:
        width = a + b + c
        if n <= width:
            continue
        m = n - width
        inside = np.flatnonzero(u.unit[:m] == u.unit[width:])
        s = u.symbols
        quad = ((s[inside] * 64 + s[inside + a]) * 64 + s[inside + a + b]) * 64 + s[inside + width]
        bins = ((quad.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)).astype(np.int64)
        yield u.unit[inside], bins, DECAY ** (width - ORDER + 1)


def unit_scores(u: Units, weights: np.ndarray) -> np.ndarray:
    """Linear score of each unit: weights over its subsequences, by the norm of their decay weights."""
    n = len(u.doc)
    total, square = np.zeros(n), np.zeros(n)
    for unit, bins, w in features(u):
        total += np.bincount(unit, weights[bins], n) * w
        square += np.bincount(unit, minlength=n) * w * w
    return total / np.sqrt(np.maximum(square, 1e-12))


@dataclass
class Model:
    """``weights`` of the subsequence bins (the landmark expansion summed up), and the map of scores to 0..1."""

    weights: np.ndarray
    slope: float
    shift: float

    def best(self, rows: list[str]) -> np.ndarray:
        """Score of the highest unit of each text; texts without units get the lowest value, -1."""
        u = units_of(rows)
        out = np.full(len(rows), -1.0)
        if len(u.doc):
            np.maximum.at(out, u.doc, unit_scores(u, self.weights))
        return out

    def score(self, rows: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.best(rows) + self.shift, -40, 40)))


def sparse_rows(strings: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normalized kernel features of strings as ``(row, bin, value)``."""
    rows, bins, values = [], [], []
    u = units_of(strings)
    if not len(u.doc):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    square = np.zeros(len(u.doc))
    for unit, b, w in features(u):
        rows.append(unit)
        bins.append(b)
        values.append(np.full(len(b), w))
        square += np.bincount(unit, minlength=len(u.doc)) * w * w
    unit = np.concatenate(rows)
    return u.doc[unit], np.concatenate(bins), np.concatenate(values) / np.sqrt(square[unit])


def kernel(strings: list[str], landmarks: tuple, m: int) -> np.ndarray:
    """Kernel values of strings (one unit each) against the landmarks' features."""
    lr, lb, lv = landmarks
    used, column = np.unique(lb, return_inverse=True)
    dense = np.zeros((len(used), m), np.float32)
    np.add.at(dense, (column, lr), lv)
    out = np.zeros((len(strings), m), np.float32)
    for lo in range(0, len(strings), 4_000):
        r, b, v = sparse_rows(strings[lo : lo + 4_000])
        at = np.searchsorted(used, b)
        at[at == len(used)] = 0
        hit = used[at] == b
        block = np.zeros((min(4_000, len(strings) - lo), len(used)), np.float32)
        np.add.at(block, (r[hit], at[hit]), v[hit])
        out[lo : lo + 4_000] = block @ dense
    return out


def hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 1.0, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Linear SVM by dual coordinate descent, one cost per instance, bias as a constant feature."""
    x = np.concatenate([x, np.ones((len(x), 1), np.float32)], 1).astype(np.float64)
    alpha, v = np.zeros(len(x)), np.zeros(x.shape[1])
    square, top = (x * x).sum(1), cost * weight
    order = np.random.default_rng(6)
    for _ in range(rounds):
        moved = 0.0
        for i in order.permutation(len(x)):
            new = min(max(alpha[i] - (y[i] * (x[i] @ v) - 1) / square[i], 0), top[i])
            if new != alpha[i]:
                v += (new - alpha[i]) * y[i] * x[i]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return v[:-1], float(v[-1])


def platt(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic map of scores to label frequencies, fitted with smoothed targets by Newton steps."""
    pos, neg = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * score + b, -30, 30)))
        w, g = np.maximum(p * (1 - p), 1e-9), target - p
        h = np.array([[(w * score * score).sum() + 1e-6, (w * score).sum()], [(w * score).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(h, np.array([(g * score).sum(), g.sum()]))
        step *= min(1.0, 5 / max(1e-9, np.abs(step).max()))
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(a), float(b)


def train(rows: list[str], toxic: np.ndarray, landmarks: int = 300, rounds: int = 3) -> Model:
    """Fit on texts with labels. Words of a toxic text carry its label; the most telling ones stand for it.

    Landmarks are the words that part the labels best and frequent words of clean texts. Then, ``rounds``
    times: the highest unit of each toxic text against words of clean texts, among them the highest so far.
    Without words of either label the model scores every text alike, below any threshold of use.
    """
    words = [sorted(set(re.findall(r"[^\W_]{2,}", t.lower()))) for t in rows]
    bad = Counter(w for ws, y in zip(words, toxic) if y for w in ws)
    good = Counter(w for ws, y in zip(words, toxic) if not y for w in ws)
    nb, ng = max(1, toxic.sum()), max(1, (toxic == 0).sum())

    def telling(w: str) -> float:
        """Signed likelihood-ratio statistic of the word's document counts."""
        a, b = bad[w], good[w]
        share = (a + b) / (nb + ng)
        cells = ((a, nb * share), (b, ng * share), (nb - a, nb * (1 - share)), (ng - b, ng * (1 - share)))
        return sum(o * np.log(o / e) for o, e in cells if o > 0) * (1 if a * ng > b * nb else -1)

    value = {w: telling(w) for w in bad if bad[w] > 1 or nb < 20}
    best = sorted(value, key=lambda w: (-value[w], w))[: landmarks // 2]
    usual = sorted((w for w in good if w not in best), key=lambda w: (-good[w], w))
    rest = landmarks - len(best)
    marks = best + usual[: rest // 2] + usual[rest // 2 :: max(1, len(usual) // max(1, rest - rest // 2))][: rest - rest // 2]
    if not marks or not bad or not good:  # nothing to part: every text gets the same low score
        return Model(np.zeros(BINS, np.float32), 0.0, -3.0)
    lr, lb, lv = sparse_rows(marks)
    square = kernel(marks, (lr, lb, lv), len(marks)).astype(np.float64)
    eigen, vectors = np.linalg.eigh((square + square.T) / 2)
    keep = eigen > 1e-6 * eigen.max()
    root = vectors[:, keep] / np.sqrt(eigen[keep])
    clean = sorted(good, key=lambda w: (-good[w], w))
    negatives = dict.fromkeys(clean[:1500] + clean[1500 :: max(1, len(clean) // 2500)])
    witness = [max(ws, key=lambda w: (value.get(w, -9.0), w)) for ws, y in zip(words, toxic) if y and ws]
    model = None
    for _ in range(rounds):
        positive = Counter(w for w in witness if 5 * good[w] * nb <= bad[w] * ng)
        if not positive:
            break
        strings = [*positive, *(w for w in negatives if w not in positive)]
        y = np.array([1.0] * len(positive) + [-1.0] * (len(strings) - len(positive)))
        weight = np.array([min(20.0, float(positive[w])) for w in positive] + [1.0] * (len(strings) - len(positive)))
        v, bias = hinge(kernel(strings, (lr, lb, lv), len(marks)) @ root, y, weight)
        w = np.zeros(BINS)
        np.add.at(w, lb, (root @ v)[lr] * lv)
        model = Model(w.astype(np.float32), 1.0, bias)
        witness = []
        for i, (ws, y) in enumerate(zip(words, toxic)):
            if not ws:
                continue
            top = _highest(ws, model)
            if y:
                witness.append(top)
            else:
                negatives[top] = None
    if model is None:
        return Model(np.zeros(BINS, np.float32), 0.0, -3.0)
    model.slope, model.shift = platt(model.best(rows), toxic)
    return model


def _highest(ws: list[str], model: Model) -> str:
    u = units_of(ws)  # each word as a text of its own
    s = unit_scores(u, model.weights)
    return ws[int(u.doc[int(s.argmax())])] if len(s) else ws[0]


def fit(docs: DataFrame, labels: DataFrame, per_label: int = 1_500, longest: int = 20_000) -> Model:
    """Learn from labelled rows outside the held-out third: of each label the ``per_label`` of smallest hash.

    The bounds of the fit are ``per_label`` rows a label and ``longest`` characters a row (of longer ones none is
    used), so at most ``2 * per_label`` texts reach the driver.
    """
    known = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int").alias("label")).filter("label IN (0, 1)")
    known = known.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    sample = labelled_sample(docs, known, per_label, longest)
    got = sorted(sample.collect())
    return train([r.text for r in got], np.array([r.label for r in got]))


def held_out(doc_id):
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def toxicity_scores(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """``doc_id, held_out, score, predicted`` per row, from the whole text alone.

    The score is that of the most toxic unit, mapped to 0..1. Null or empty texts, and texts without letters,
    get the lowest score. Repeated rows are scored each; a null doc_id is carried along and not held out.
    The model is a fixed table of 1 MB, sent to every task.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        score = shared.value.score(batch.column(1).to_pylist()) if batch.num_rows else np.zeros(0)
        predicted = (score >= threshold).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(score), pa.array(predicted)],
            names=["doc_id", "held_out", "score", "predicted"],
        )

    rows = texts(docs).withColumn("held_out", held_out(F.col("doc_id")))
    return rows.mapInArrow(per_batch(one, limit=1 << 20), SCORED)
