"""Quality rules: a linear-chain conditional random field marks lines as content or boilerplate."""

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import keep_rows, labelled_sample, per_batch, texts

JUDGED = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, content_share double"
)
# White space that parts words, and the characters counted as symbols.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = b"#*$%&|<>"
LETTER = re.compile(r"[^\W\d_]")
WIDE = re.compile(r"[^\x00-\x7F]")
CAPITALS, DIGITS = (bytes(range(ord(a), ord(b) + 1)) for a, b in ("AZ", "09"))
LETTERS = CAPITALS + CAPITALS.lower()
BINS = (0.0, 0.05, 0.15, 0.3, 0.6, 0.9)
N_FEATURES = 7 * (len(BINS) + 1) + 6
CONTENT, BOILERPLATE = 0, 1


def splitter(text: str):
    """What gives the words of a text or a part of it; ``str.split`` where it parts at nothing but ASCII white space."""
    return WORD.findall if _ODD.search(text) else str.split


# white space to str.split, but not here
_ODD = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def _among(raw: bytes, kind: bytes) -> int:
    """Bytes of ``raw`` that are of a kind."""
    return len(raw) - len(raw.translate(None, kind))


@dataclass
class Facts:
    """What the base rules count in one text, and the words of each line."""

    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    lines: list[tuple[str, list[str]]]
    repeated: set[int]

    @property
    def base_failed(self) -> bool:
        return self.n_words < 50 or 100 * self.n_repeat_words > 50 * self.n_words


def facts_of(text: str) -> Facts:
    raw = text.split("\n")
    split = splitter(text)
    lines = [(line, split(line)) for line in raw]
    words = [w for _, ws in lines for w in ws]
    seen: set[str] = set()
    repeated: set[int] = set()
    for i, (line, ws) in enumerate(lines):
        if line in seen:
            if ws:
                repeated.add(i)
        else:
            seen.add(line)
    covered = 0
    if len(set(zip(words, words[1:], words[2:]))) < len(words) - 2:
        trigrams = list(zip(words, words[1:], words[2:]))
        again = {t for t, n in Counter(trigrams).items() if n > 1}
        until = 0
        for i, t in enumerate(trigrams):
            if t in again:
                covered += i + 3 - max(i, until)
                until = i + 3
    return Facts(
        len(words), sum(map(len, words)), _among(text.encode(), SYMBOLS), len(repeated), covered, lines, repeated
    )


def _bin(share: float) -> int:
    return sum(share > b for b in BINS)


def line_features(f: Facts) -> list[list[int]]:
    """Indices of the binary features of each line with a word; seven shares in bins, and six marks."""
    out = []
    width = len(BINS) + 1
    for i, (line, ws) in enumerate(f.lines):
        if not ws:
            continue
        n, size = len(ws), max(1, len(line))
        raw = line.encode()
        letters, upper, digits, signs = (_among(raw, kind) for kind in (LETTERS, CAPITALS, DIGITS, SYMBOLS))
        if len(raw) > len(line):  # the rest of the characters one by one
            wide = "".join(WIDE.findall(line))
            others = LETTER.findall(wide)
            letters, upper, digits = letters + len(others), upper + sum(map(str.isupper, others)), digits + sum(map(str.isdigit, wide))
        shares = (
            signs / n / 4, sum(not (w.isalnum() or any(map(str.isalnum, w))) for w in ws) / n, upper / max(1, letters),
            digits / size, 1 - len(set(ws)) / n, sum(w[-1] in "!?" for w in ws) / n,
            1 - letters / max(1, sum(map(len, ws))),
        )
        row = [k * width + _bin(s) for k, s in enumerate(shares)]
        base = len(shares) * width
        row += [base + k for k, on in enumerate((True, i in f.repeated, n < 4, n > 30, ws[-1][-1] in ".!?", not out)) if on]
        out.append(row)
    return out


@dataclass
class Field:
    """Weights of the field: ``emit`` by feature and state, ``move`` by neighbouring states, ``start`` by state."""

    emit: np.ndarray
    move: np.ndarray
    start: np.ndarray

    def potentials(self, rows: list[list[int]]) -> np.ndarray:
        return np.array([self.emit[r].sum(axis=0) for r in rows])

    def viterbi(self, rows: list[list[int]]) -> list[int]:
        """The likeliest sequence of states; content among equals."""
        e = self.emit
        (m00, m01), (m10, m11) = self.move.tolist()
        back = []
        a = b = None
        totals = np.add.reduceat(e[np.concatenate(rows).astype(np.int64)], np.cumsum([0, *map(len, rows[:-1])]), axis=0)
        for c, d in totals.tolist():
            if a is None:
                a, b = self.start[0] + c, self.start[1] + d
                continue
            from_c, from_b = a + m00 >= b + m10, a + m01 >= b + m11
            back.append((0 if from_c else 1, 0 if from_b else 1))
            a, b = (a + m00 if from_c else b + m10) + c, (a + m01 if from_b else b + m11) + d
        state = 0 if a >= b else 1
        path = [state]
        for step in reversed(back):
            state = step[state]
            path.append(state)
        return path[::-1]


def train_field(sequences: list[list[list[int]]], states: list[int], rounds: int = 120, penalty: float = 1.0) -> Field:
    """Maximum penalized likelihood by gradient steps; every line of a sequence carries its document's state.

    Forward-backward runs over all sequences at once, padded by length; one short sequence costs what it must.
    """
    order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
    seqs, y = [sequences[i] for i in order], np.array([states[i] for i in order])
    length = np.array([len(s) for s in seqs])
    steps = int(length.max())
    flat = [r for s in seqs for r in s]
    line_of = np.repeat(np.arange(len(flat)), [len(r) for r in flat])
    feature = np.concatenate(flat).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(length)[:-1]])
    gold = np.repeat(y, length)
    emit, move, start = np.zeros((N_FEATURES, 2)), np.zeros((2, 2)), np.zeros(2)
    want_emit = np.zeros_like(emit)
    np.add.at(want_emit, (feature, gold[line_of]), 1)
    want_move = np.diag(np.bincount(y, length - 1, 2))
    want_start = np.bincount(y, minlength=2).astype(float)
    memory = [np.full_like(x, 1e-8) for x in (emit, move, start)]
    active = [int((length > t).sum()) for t in range(steps)]
    for _ in range(rounds):
        score = np.stack([np.bincount(line_of, emit[feature, s], len(flat)) for s in (0, 1)], 1)
        forward, backward = np.zeros_like(score), np.zeros_like(score)
        total = np.zeros(len(seqs))
        for t in range(steps):
            at = first[: active[t]] + t
            if t == 0:
                forward[at] = start + score[at]
            else:
                forward[at] = score[at] + np.logaddexp(forward[at - 1, :1] + move[0], forward[at - 1, 1:] + move[1])
        last = first + length - 1
        total = np.logaddexp(forward[last, 0], forward[last, 1])
        got_move = np.zeros((2, 2))
        for t in range(steps - 1, 0, -1):
            at = first[: active[t]] + t
            ahead = score[at] + backward[at]
            for s in (0, 1):
                joint = forward[at - 1, s : s + 1] + move[s] + ahead
                got_move[s] += np.exp(joint - total[: active[t], None]).sum(0)
                backward[at - 1, s] = np.logaddexp(move[s, 0] + ahead[:, 0], move[s, 1] + ahead[:, 1])
        mass = np.exp(forward + backward - np.repeat(total, length)[:, None])
        got_emit = np.zeros_like(emit)
        for s in (0, 1):
            got_emit[:, s] = np.bincount(feature, mass[line_of, s], N_FEATURES)
        for k, (w, g) in enumerate((
            (emit, want_emit - got_emit - penalty * emit), (move, want_move - got_move - penalty * move),
            (start, want_start - mass[first].sum(0) - penalty * start),
        )):
            memory[k] += g * g
            w += 0.5 * g / np.sqrt(memory[k])
    return Field(emit, move, start)


def fit_field(docs: DataFrame, labels: DataFrame, per_label: int = 1_500, longest: int = 20_000) -> Field | None:
    """Learn from labelled rows: of each quality label the ``per_label`` of smallest hash, at most ``longest`` characters each.

    None where one of the labels has no row with a word.
    """
    known = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int").alias("label"))
    known = known.filter("doc_id IS NOT NULL AND label IN (0, 1)")
    got = sorted(labelled_sample(docs, known, per_label, longest).collect())
    pairs = [(line_features(facts_of(r.text)), BOILERPLATE if r.label == 0 else CONTENT) for r in got]
    pairs = [(x, y) for x, y in pairs if x]
    if len({y for _, y in pairs}) < 2:
        return None
    return train_field([x for x, _ in pairs], [y for _, y in pairs])


def content_share(f: Facts, field: Field | None) -> float:
    """Share of the characters of words that stand in content lines."""
    if field is None:
        return 1.0
    rows = line_features(f)
    if not rows:
        return 0.0
    sizes = [sum(map(len, ws)) for _, ws in f.lines if ws]
    return sum(n for n, s in zip(sizes, field.viterbi(rows)) if s == CONTENT) / sum(sizes)


def quality_verdicts(docs: DataFrame, field: Field | None, least_share: float = 0.5) -> DataFrame:
    """One row per document: base counts, ``base_failed``, ``kept`` and the content share.

    Words are parted by ASCII white space; null or empty texts have none and fail. A text that passes the base
    rules is kept if content lines hold ``least_share`` of its word characters. Without a field (nothing to
    learn from) the base rules decide alone. Repeated rows are judged each, a null doc_id is carried along.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)
    names = [c.split()[0] for c in JUDGED.split(", ")]
    kinds = [pa.int64()] * 6 + [pa.bool_(), pa.bool_(), pa.float64()]

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            f = facts_of(text)
            share = content_share(f, shared.value)
            kept = not f.base_failed and share >= least_share
            rows.append((doc_id, f.n_words, f.word_chars, f.n_symbols, f.n_dup_lines, f.n_repeat_words, f.base_failed, kept, share))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return texts(docs).mapInArrow(per_batch(one), JUDGED)


def keep_quality(docs: DataFrame, field: Field | None, least_share: float = 0.5) -> DataFrame:
    """Rows of ``docs``, all columns, that ``quality_verdicts`` keeps. Map-side only."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def keep(column: pa.Array) -> np.ndarray:
        out = []
        for text in column.to_pylist():
            f = facts_of(text)
            out.append(not f.base_failed and content_share(f, shared.value) >= least_share)
        return np.array(out, bool)

    return keep_rows(docs, keep)
