"""Words of many texts at once: numpy arrays over one byte buffer, no Python loop over words."""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACES = bytes([0x20, *range(0x09, 0x0E)])
_rng = np.random.default_rng(20)
_BYTE_VALUES = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _classes(plain: bool) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes belong to words, and what a byte counts as. ``plain``: only white space parts words and case stays."""
    value = np.arange(256, dtype=np.uint8)
    inside = np.ones(256, bool)
    if not plain:
        inside = np.array([chr(c).isalnum() or c >= 0x80 for c in range(256)])
        value[65:91] += 32
    inside[list(SPACES)] = False
    return inside, value


#: Words as runs of anything but white space, and words as lower-case runs of letters and digits.
PLAIN, FOLDED = _classes(True), _classes(False)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every bit of a 64-bit value."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """``start``/``end``: bytes of ``buffer``; ``doc``: the row; ``bounds``: first word of each row, and the end."""

    buffer: np.ndarray
    origin: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    bounds: np.ndarray
    hash: np.ndarray

    def text(self, first: int, last: int) -> bytes:
        """Bytes from word ``first`` up to the end of word ``last - 1``."""
        return self.buffer[self.start[first] : self.end[last - 1]].tobytes()


def words(column: pa.Array, classes: tuple[np.ndarray, np.ndarray] = PLAIN) -> Words:
    """Words of all texts with a 64-bit hash each (polynomial over random byte values, then mixed)."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    origin = offsets[:-1] - offsets[0] + np.arange(n)
    buffer = np.full(int(offsets[-1] - offsets[0]) + n, 32, np.uint8)
    for i in range(n):  # one blank after each text keeps words of neighbours apart
        buffer[origin[i] : origin[i] + offsets[i + 1] - offsets[i]] = raw[offsets[i] : offsets[i + 1]]
    inside = np.zeros(len(buffer) + 2, np.int8)
    inside[1:-1] = classes[0][buffer]
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = powers(len(buffer) + 1)
    sums = np.zeros(len(buffer) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[classes[1]][buffer] * up[: len(buffer)], out=sums[1:])
    hashes = mix((sums[end] - sums[start]) * down[start])
    bounds = np.searchsorted(start, np.append(origin, len(buffer)))
    doc = np.repeat(np.arange(n), np.diff(bounds))
    return Words(buffer, origin, start, end, doc, bounds, hashes)


def windows(hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Hash of each run of ``len(weights)`` consecutive words; a zero weight leaves that place out."""
    n = len(hashes) - len(weights) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for i, w in enumerate(weights):
        if w:
            total += hashes[i : i + n] * w
    return mix(total)


def odd_weights(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def inside_docs(w: Words, width: int) -> np.ndarray:
    """For each window start, whether the window ends in the same text."""
    n = len(w.doc) - width + 1
    return w.doc[:n] == w.doc[width - 1 :] if n > 0 else np.zeros(0, bool)


class Members:
    """Sorted 64-bit set behind a small bit table that answers most misses with one look."""

    def __init__(self, values: np.ndarray, bits: int = 20):
        self.values = np.unique(values.astype(np.uint64))
        self.shift = np.uint64(64 - bits)
        self.table = np.zeros(1 << bits, bool)
        self.table[(self.values >> self.shift).astype(np.int64)] = True

    def positions(self, hashes: np.ndarray) -> np.ndarray:
        """Indices of ``hashes`` that are in the set."""
        maybe = np.flatnonzero(self.table[(hashes >> self.shift).astype(np.int64)])
        if not len(maybe) or not len(self.values):
            return maybe[:0]
        at = np.searchsorted(self.values, hashes[maybe])
        at[at == len(self.values)] = 0
        return maybe[self.values[at] == hashes[maybe]]
