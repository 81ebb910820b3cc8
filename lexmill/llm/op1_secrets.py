"""Secret scan: base patterns, and credential formats learned as probabilistic automata by state merging."""

import hashlib
import math
import re
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import per_batch, scratch, texts

# The base kinds, in their order.
KINDS = ("assign", "access", "hex", "format")


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_KEYS = "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = re.compile(rf"""({_KEYS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
RUN = re.compile(r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{16,}")
#: What a letter counts as in a format; other characters of a run stand for themselves.
CLASSES = {**dict.fromkeys("0123456789", "0"), **dict.fromkeys("abcdef", "a"), **dict.fromkeys("ghijklmnopqrstuvwxyz", "g"),
           **dict.fromkeys("ABCDEF", "A"), **dict.fromkeys("GHIJKLMNOPQRSTUVWXYZ", "G")}
TO_CLASS = str.maketrans(CLASSES)
ALPHABET = 5 + len("+/_.=-") + 1  # classes, signs, end
SCANNED = "doc_id long, kind string, start long, end long, value string"


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """``(start, kind number, end, credential)`` of the base kinds, in code points."""
    found = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= 6:
                found.append((m.start(), 0, m.end(), m[2]))
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if len(m[0]) >= 20:
                found.append((m.start(), 1, m.end(), m[0]))
    for m in HEX.finditer(text):
        found.append((m.start(), 2, m.end(), m[0]))
    return sorted(found)


def other_runs(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, str]]:
    """Runs of 16 or more credential characters that no base span touches."""
    out = []
    for m in RUN.finditer(text):
        if all(m.end() <= s or e <= m.start() for s, _, e, _ in base):
            out.append((m.start(), m.end(), m[0]))
    return out


@dataclass
class Automaton:
    """Probabilistic automaton over format classes: per state the log-probability and target of each symbol."""

    steps: list[dict[str, tuple[float, int]]]
    ends: list[float]
    unseen: list[float]

    def score(self, shape: str) -> float:
        """Log-likelihood of a shape; a symbol that a state never saw is charged and leaves the state as it is."""
        state, total = 0, 0.0
        for c in shape:
            step = self.steps[state].get(c)
            if step is None:
                total += self.unseen[state]
            else:
                total += step[0]
                state = step[1]
        return total + self.ends[state]


def infer(shapes: dict[str, int], alpha: float = 0.05, max_states: int = 200_000) -> Automaton:
    """Merge compatible states of the prefix tree of ``shapes`` (counted), red-blue order, Hoeffding bound ``alpha``.

    Two states are compatible if end and symbol frequencies differ by no more than the bound, and so, by
    symbol, do the states below. ``max_states`` limits the tree: shapes beyond it are not added, rarest last.
    """
    moves: list[dict[str, int]] = [{}]
    flow: list[dict[str, int]] = [{}]
    stop, total = [0], [0]
    for shape, n in sorted(shapes.items(), key=lambda x: (-x[1], x[0])):
        if len(moves) > max_states:
            break
        at = 0
        total[0] += n
        for c in shape:
            if c not in moves[at]:
                moves[at][c] = len(moves)
                moves.append({})
                flow.append({})
                stop.append(0)
                total.append(0)
            flow[at][c] = flow[at].get(c, 0) + n
            at = moves[at][c]
            total[at] += n
        stop[at] += n
    width = math.sqrt(0.5 * math.log(2 / alpha))

    def differ(f1: int, n1: int, f2: int, n2: int) -> bool:
        return abs(f1 / n1 - f2 / n2) > width * (n1**-0.5 + n2**-0.5)

    def compatible(a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            na, nb = total[a], total[b]
            if not na or not nb:
                continue
            if differ(stop[a], na, stop[b], nb):
                return False
            for c in moves[a].keys() | moves[b].keys():
                if differ(flow[a].get(c, 0), na, flow[b].get(c, 0), nb):
                    return False
                if c in moves[a] and c in moves[b]:
                    todo.append((moves[a][c], moves[b][c]))
        return True

    def fold(a: int, b: int) -> None:
        """Add the tree below ``b`` to ``a``."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            total[a] += total[b]
            stop[a] += stop[b]
            for c, target in moves[b].items():
                if c in moves[a]:
                    todo.append((moves[a][c], target))
                else:
                    moves[a][c] = target
                flow[a][c] = flow[a].get(c, 0) + flow[b][c]

    red = [0]
    blue = [(c, 0) for c in sorted(moves[0])]
    while blue:
        blue.sort(key=lambda x: (-total[moves[x[1]][x[0]]], x))
        c, source = blue.pop(0)
        state = moves[source][c]
        if state in red:
            continue
        twin = next((r for r in red if compatible(r, state)), None)
        if twin is None:
            red.append(state)
        else:
            moves[source][c] = twin
            fold(twin, state)
        inside = set(red)
        blue = sorted({(s, r) for r in red for s, t in moves[r].items() if t not in inside})
    place = {r: i for i, r in enumerate(red)}
    steps, ends, unseen = [], [], []
    for r in red:
        n = total[r] + ALPHABET
        steps.append({c: (math.log((flow[r][c] + 1) / n), place[t]) for c, t in moves[r].items()})
        ends.append(math.log((stop[r] + 1) / n))
        unseen.append(math.log(1 / n))
    return Automaton(steps, ends, unseen)


def shape_of(value: str) -> str:
    return value.translate(TO_CLASS)


def labelled_values(docs: DataFrame, fit_documents: int, per_label: int) -> DataFrame:
    """``label, value``: credentials of the base kinds and, as ``other``, runs that are none.

    The bounded sample of the fit: about ``fit_documents`` documents by the hash of their doc_id, and of their
    values the ``per_label`` of smallest hash for each label.
    """
    rows = texts(docs)
    n = max(1, rows.count())
    if n > fit_documents:
        rows = rows.filter(F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1_000_000)) < int(1_000_000 * fit_documents / n) + 1)

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = []
        for text in batch.column(1).to_pylist():
            base = base_spans(text)
            found += [(KINDS[k], v) for _, k, _, v in base] + [("other", v) for *_, v in other_runs(text, base)]
        kept = []
        for label in (*KINDS, "other"):
            own = sorted((xxhash.xxh64_intdigest(v.encode()), v) for x, v in found if x == label)[:per_label]
            kept += [(label, v) for _, v in own]
        return pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in kept], pa.string()), pa.array([v for _, v in kept], pa.string())], names=["label", "value"]
        )

    values = scratch(rows.mapInArrow(per_batch(one), "label string, value string"), "secret-sample")
    best = None
    for label in (*KINDS[:3], "other"):
        top = values.filter(F.col("label") == label).orderBy(F.xxhash64("value"), "value").limit(per_label)
        best = top if best is None else best.union(top)
    return best


@dataclass
class Formats:
    """Automata of the credential kinds and of other runs; ``margin``: least gain in log-likelihood a character."""

    kinds: list[Automaton]
    other: Automaton
    margin: float

    def is_credential(self, value: str) -> bool:
        shape = shape_of(value)
        most = max((a.score(shape) for a in self.kinds), default=-math.inf)
        return most - self.other.score(shape) >= self.margin * len(shape)


def fit_formats(docs: DataFrame, fit_documents: int = 40_000, per_label: int = 2_000, margin: float = 0.5) -> Formats | None:
    """Learn the automata; None where a table has no base credential or no other run to learn from."""
    shapes: dict[str, dict[str, int]] = {}
    for row in labelled_values(docs, fit_documents, per_label).collect():  # four labels, per_label rows each
        own = shapes.setdefault(row.label, {})
        own[shape_of(row.value)] = own.get(shape_of(row.value), 0) + 1
    if "other" not in shapes or len(shapes) < 2:
        return None
    return Formats([infer(shapes[k]) for k in KINDS[:3] if k in shapes], infer(shapes["other"]), margin)


def spans_of(text: str, formats: Formats | None, known: dict[str, bool]) -> list[tuple[int, int, int, str]]:
    base = base_spans(text)
    if formats is None:
        return base
    found = list(base)
    for start, end, value in other_runs(text, base):
        shape = value.translate(TO_CLASS)
        hit = known.get(shape)
        if hit is None:
            hit = formats.is_credential(value)
            if len(known) < 200_000:
                known[shape] = hit
        if hit:
            found.append((start, 3, end, value))
    return sorted(found)


def _mapped(docs: DataFrame, formats: Formats | None, schema: str, rows_of) -> DataFrame:
    """``rows_of(doc_id, spans)`` gives the rows of a document."""
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [{"long": pa.int64(), "string": pa.string()}[c.split()[1]] for c in schema.split(", ")]
    shared = docs.sparkSession.sparkContext.broadcast(formats)  # at most per_label shapes a label

    def run(batches):
        formats, known = shared.value, {}

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows += rows_of(doc_id, spans_of(text, formats, known))
            columns = [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * len(kinds), kinds)]
            return pa.RecordBatch.from_arrays(columns, names=names)

        yield from per_batch(one)(batches)

    return texts(docs).mapInArrow(run, schema)


def scan_secrets(docs: DataFrame, formats: Formats | None = None) -> DataFrame:
    """One row per span of every whole text: ``doc_id, kind, start, end, value``.

    Base kinds ``assign``, ``access`` and ``hex`` by pattern, leftmost non-overlapping within each kind; ``format``
    for runs of 16 or more credential characters that touch no base span and that the automata of
    ``fit_formats`` find likelier as a credential than as another run, by ``margin`` a character. Positions are
    code points, end exclusive. Null or empty texts give no row; repeated rows give theirs again; a null
    doc_id is carried along; without ``formats`` only the base kinds are found.
    """
    return _mapped(docs, formats, SCANNED, lambda i, spans: [(i, KINDS[k], s, e, v) for s, k, e, v in spans])


def secret_digests(docs: DataFrame, formats: Formats | None) -> DataFrame:
    """One row per document: counts of the base kinds, SHA-256 of the base spans, all spans as ``kind:start:end``."""

    def rows(doc_id, spans):
        named = [(k, f"{KINDS[k]}:{s}:{e}") for s, k, e, _ in spans]
        base = ",".join(x for k, x in named if k < 3)
        n = [sum(k == i for k, _ in named) for i in range(4)]
        return [(doc_id, *n[:3], hashlib.sha256(base.encode()).hexdigest(), ",".join(x for _, x in named), n[3])]

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_format long"
    return _mapped(docs, formats, schema, rows)
