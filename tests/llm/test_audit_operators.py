import hashlib
import random
import re
import time
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.llm import op11_pii as o11
from lexmill.llm import op12_divergence as o12
from lexmill.llm import op13_interaction as o13
from tests.llm.helpers import EDGES, LONG, small, table

WORDS = re.compile("[^\x20\x09-\x0d]+")


# --- personal data


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(digits))) % 10 == 0


def only_digits(value):
    return "".join(c for c in value if c in "0123456789")


PLAIN = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", lambda v: True),
    "ip": (r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", lambda v: all(int(x) <= 255 for x in v.split("."))),
    "card": (r"[0-9](?:[\x20-]?[0-9])+", lambda v: 12 <= len(only_digits(v)) <= 19 and luhn(only_digits(v))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 9 <= len(only_digits(v)) <= 15),
}


def plain_base(text):
    found = []
    for rank, (kind, (pattern, good)) in enumerate(PLAIN.items()):
        found += [(m.start(), rank, m.end(), kind) for m in re.finditer(pattern, text or "") if good(m.group())]
    return sorted(found)


def plain_mod97(value):
    s = value.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def plain_extra(text):
    """Account numbers, identity numbers and local phone numbers with the score of their context."""
    text, found = text or "", []
    kinds = [
        (4, "iban", "A-Za-z0-9", lambda v: 15 <= len(v.replace(" ", "")) <= 34 and plain_mod97(v)),
        (5, "national_id", "0-9A-Za-z-", lambda v: not re.search("^(?:000|666|9)|-00-|-0000$", v)),
        (6, "local_phone", "0-9A-Za-z.+-", lambda v: True),
    ]
    for rank, name, inside, good in kinds:
        kind = o11.KINDS[rank]
        hits = list(re.finditer(kind.pattern, text))
        for k, m in enumerate(hits):
            before = text[hits[k - 1].end() if k else 0 : m.start()][-o11.NEAR :]
            after = text[m.end() : hits[k + 1].start() if k + 1 < len(hits) else len(text)][: o11.NEAR]
            if not good(m.group()) or re.match(f"[{inside}]", before[-1:]) or re.match(f"[{inside}]", after[:1]):
                continue
            score = kind.score
            for words, change in ((kind.words, o11.CONTEXT), (kind.against, -o11.CONTEXT)):
                if words and any(re.search(f"(?:^|[^a-z])(?:{words})(?:[^a-z]|$)", side.translate({c: c + 32 for c in range(65, 91)})) for side in (before, after)):
                    score += change
            if round(score, 2) >= o11.LEAST:
                found.append((m.start(), rank, m.end(), name))
    return sorted(found)


def listed(spans):
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)


PERSONAL = [
    (30, "mail me: a.b@c.de, or x@y.z_q@r.st; a@b c@d. u@v..w ip 1.2.3.4.5.6.7.8 and 999.1.1.1 000255.0.0.1 ﬁ𝄞 +1 (741) 555-3069"),
    (31, "IBAN GB82 WEST 1234 5698 7654 32 and DE89370400440532013000, not DE89370400440532013001; xGB82WEST12345698765432"),
    (32, "my SSN: 123-45-6789 is followed by a good many other words before the order 123-45-6780 and 000-12-3456 stand here"),
    (37, "Tel. 555-123-4567 is followed by a good many other words before the bare 555-123-4568 stands here"),
    (33, "4111 1111 1111 1111 visa 4111-1111-1111-1112 4111111111111111\n5500 0000 0000 0004 12 345 +49 30 123456-7 +1 2"),
    (34, "version 1.2.3.4 " * 700 + "x@y.z " * 700 + "+1 (741) 555-3069; " * 600),
    (35, "a" * 4_000 + "1" * 4_000), (36, "a@" + ".b" * 4_000 + " q@" + "c.d" * 4_000),
]


def test_pii_equals_brute_force(spark):
    rows = EDGES + PERSONAL + [(r.doc_id + 100, r.text) for r in small(spark).collect()]
    out = o11.pii_digests(table(spark, rows)).collect()
    got = sorted((str(r.doc_id), r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256, r.spans) for r in out)
    want = []
    for i, t in rows:
        base = plain_base(t)
        counts = Counter(x[3] for x in base)
        want.append((str(i), *[counts[k] for k in PLAIN], hashlib.sha256(listed(base).encode()).hexdigest(), listed(sorted(base + plain_extra(t)))))
    assert got == sorted(want)
    extra = Counter(x[3] for _, t in PERSONAL for x in plain_extra(t))
    assert extra == {"iban": 2, "national_id": 1, "local_phone": 1}
    assert o11.pii_digests(table(spark, [])).collect() == []


def test_pii_reads_no_run_twice(spark):
    runs = ["a" * 400_000, "1" * 400_000, "a@" + ".b" * 200_000, "q@" + "c.d" * 100_000, "1 " * 200_000, "+" * 300_000, "1." * 200_000, "A1" * 200_000]
    start = time.monotonic()
    counts = {r.doc_id: (r.n_email, r.n_ip) for r in o11.pii_digests(table(spark, list(enumerate(runs)))).collect()}
    assert counts[3] == (1, 0) and counts[0] == counts[1] == counts[2] == (0, 0) and counts[6] == (0, 50_000) and time.monotonic() - start < 60


def test_pii_context_and_redaction(spark):
    docs = table(spark, [(1, "release 10.0.0.1 host 10.0.0.2"), (2, "write to a@b.cd now"), (3, None)])
    spans = {r.doc_id: [(s.kind, s.value, s.score) for s in r.spans] for r in o11.find_pii(docs).collect()}
    assert spans == {1: [("ip", "10.0.0.1", 0.6), ("ip", "10.0.0.2", 0.9)], 2: [("email", "a@b.cd", 1.0)], 3: []}
    assert {r.doc_id: (r.text, r.n_spans) for r in o11.redact_pii(docs).collect()} == {
        1: ("release [ip] host [ip]", 2), 2: ("write to [email] now", 1), 3: ("", 0)
    }


def test_running_sums_of_many(spark):
    for n in (0, 1, o11.BLOCK, o11.BLOCK + 1, 5_000):
        got = spark.range(1).select(o11.running_sums(F.slice(F.sequence(F.lit(1), F.lit(6_000)), F.lit(1), F.lit(n))).alias("x")).first().x
        assert got == [k * (k + 1) // 2 for k in range(1, n + 1)]


def test_pii_plan_runs_no_python(spark):
    plan = o11.pii_digests(table(spark, EDGES))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange hash", plan)


# --- divergence of sources


def grouped(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for name in ("term", "n", "p", "q", "tile", "block", "low", "value", "part"):
        docs = docs.withColumn(name, F.lit("x"))
    return docs


def plain_counts(rows, least_docs):
    uses, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        terms = [re.sub("[A-Z]", lambda m: chr(ord(m.group()) + 32), t) for t in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text or "")]
        groups.add((lang or "", source or ""))
        uses[lang or "", source or ""].update(terms)
        docs[lang or ""].update(set(terms))
    kept = {lang: sorted(t for t, n in c.items() if n >= least_docs) for lang, c in docs.items()}
    return uses, groups, kept


def plain_divergence(rows, least_docs, best):
    uses, groups, kept = plain_counts(rows, least_docs)
    out = []

    def prices(count, lang):
        total = sum(count[t] for t in kept[lang])
        return {t: 1 + (10**9 * (count[t] + 5)) // (total + 5 * len(kept[lang])) for t in kept[lang]}

    for lang, source in groups:
        p = prices(uses[lang, source], lang)
        whole = Counter()
        for g in groups:
            if g[0] == lang:
                whole.update(uses[g])
        q = prices(whole, lang)
        pairs = [(s, sum(abs(p[t] - x) for t, x in prices(uses[lang, s], lang).items())) for g, s in groups if g == lang and s != source]
        terms = [(t, p[t] - q[t]) for t in kept[lang] if uses[lang, source][t] > 0 and p[t] > q[t]]
        for part, items, most in (("pair", pairs, len(pairs)), ("term", terms, best)):
            ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
            out += [(lang, source, part, item, value, rank) for rank, (item, value) in enumerate(ranked, 1)]
    return sorted(out)


def divergence_rows(spark):
    rng = random.Random(3)
    vocabulary = [f"{rng.choice('abcé𝄞')}{rng.choice('xyzK')}{'q' * (k % 5)}" for k in range(80)]
    rows = [(k, " ".join(rng.choices(vocabulary, k=rng.randint(0, 60))), rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", "s3", None, "é"])) for k in range(150)]
    rows += [(None, "ab Ab aB", "en", "s1"), (1, "ab", "en", "s1"), (1, None, "alone", "s9"), (2, "", "empty", "a"), (3, "1 2 3", "empty", "b")]
    rows += [(500, LONG, "en", "s2")] + [(600 + k, "the the same copied text", "en", "hot") for k in range(60)]
    return rows + [(1000 + r.doc_id, r.text, r.lang, r.source) for r in small(spark, 60).collect()]


@pytest.mark.parametrize("terms, sources", [(1_024, 64), (16, 2)])
def test_divergence_equals_brute_force(spark, terms, sources):
    rows = divergence_rows(spark)
    out = o12.source_divergence(grouped(spark, rows), least_docs=5, best=7, terms=terms, sources=sources).collect()
    want = plain_divergence(rows, 5, 7)
    assert sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in out) == want
    assert ("empty", "a", "pair", "b", 0, 1) in want and not [x for x in want if x[0] == "alone"]
    assert o12.source_divergence(grouped(spark, [])).collect() == []


def test_joint_tables_equal_brute_force(spark):
    rows = divergence_rows(spark)
    uses, groups, kept = plain_counts(rows, 5)
    want = Counter()
    for lang, a in groups:
        for b in (s for g, s in groups if g == lang and s > a):
            levels = [(uses[lang, a][t], uses[lang, b][t]) for t in kept[lang]]
            want.update((lang, a, b, *x) for x in levels if x != (0, 0))
    got = o12.joint_tables(grouped(spark, rows), least_docs=5, terms=16, sources=2).collect()
    assert {(r.lang, r.source, r.other, r.level, r.other_level): r.n_terms for r in got} == want


def test_price_is_exact_beyond_longs(spark):
    big = spark.createDataFrame([(10**12, 10**13, 10**6), (0, 0, 0)], "n long, total long, terms long")
    got = [r.x for r in big.select(o12.price("n", "total", "terms").alias("x")).collect()]
    assert got == [1 + 10**9 * (10**12 + 5) // (10**13 + 5 * 10**6), None]


def test_counts_pass_on_before_they_grow(spark, monkeypatch):
    docs = grouped(spark, divergence_rows(spark)).select("lang", "source", "text").na.fill("").toArrow().to_batches(max_chunksize=10)
    whole = [x for b in o12._counted(iter(docs)) for x in b.to_pylist()]
    monkeypatch.setattr(o12, "HELD", 50)
    parts = [x for b in o12._counted(iter(docs)) for x in b.to_pylist()]
    sums = Counter()
    for x in parts:
        sums[x["lang"], x["source"], x["term"]] += x["n"]
    assert len(parts) > len(whole) and sums == {(x["lang"], x["source"], x["term"]): x["n"] for x in whole}


# --- interaction of filters


def plain_masks(rows, labels):
    good, toxic, masks = set(), set(), []
    for i, q, t in labels:
        good |= {i} if q == 1 and i is not None else set()
        toxic |= {i} if t == 1 and i is not None else set()
    lowest = {}
    for i, text, _ in rows:
        if i is not None:
            lowest[text or ""] = min(lowest.get(text or "", i), i)
    for i, text, source in rows:
        t = text or ""
        words = WORDS.findall(t)
        fails = [
            len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            bool(re.search("[#$%&*|]", t)), i is not None and lowest[t] < i,
        ]
        masks.append((source or "", {"ABCDE"[k] for k in range(5) if fails[k]}, i in good, i in toxic))
    return masks


def plain_audit(rows, labels):
    out, shapley = {}, Counter()
    masks = plain_masks(rows, labels)
    for part in {m[0] for m in masks}:
        for order in map("".join, permutations("ABCDE")):
            left = [m for m in masks if m[0] == part]
            for step, letter in enumerate(order, 1):
                gone = [m for m in left if letter in m[1]]
                left = [m for m in left if letter not in m[1]]
                failing = [m for m in masks if m[0] == part and letter in m[1]]
                shapley[part, letter] += len(gone)
                out[part, order, step] = [
                    len(left), len(gone), len(failing) - len(gone), sum(m[1] == {letter} for m in failing), sum(m[2] for m in gone), sum(m[3] for m in gone)
                ]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audit_table(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for name in ("content", "mask", "good", "toxic", "n", "least", "first", "part", "step"):
        docs = docs.withColumn(name, F.lit("x"))
    return docs


def test_interaction_equals_brute_force(spark):
    rows = [(i, t, s) for (i, t), s in zip(EDGES, ["a", "b", None, "a", "a", "b", "a", "b", None, "", "a", "c"], strict=False)]
    rows += [(70 + k, LONG, "c") for k in range(3)] + [(k, "same # text", "hot") for k in range(80, 110)] + [(80, "same # text", "other"), (None, "same # text", "hot")]
    rows += [(1000 + r.doc_id, r.text, r.source) for r in small(spark, 80).collect()]
    labels = [(r[0], (r[0] or 0) % 2, (r[0] or 0) % 3 % 2) for r in rows[::2]] + [(85, 1, 1), (85, 0, 0), (85, None, None), (None, 1, 1)]
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = o13.interaction_audit(audit_table(spark, rows), known).collect()
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in out}
    assert got == plain_audit(rows, labels) and len(out) == len(got) == 600 * len({r[2] or "" for r in rows})
    assert o13.interaction_audit(audit_table(spark, []), known).collect() == []
    assert o13.interaction_audit(audit_table(spark, rows[:5]), known.limit(0)).count() == 600 * 3


def test_transducer_counts_every_byte():
    rng = random.Random(5)
    texts = ["".join(rng.choices("aB #$%&*|é𝄞\t\n\x0b\x0c\r\x1c\x85 x", k=rng.randint(0, 40))) for _ in range(400)] + ["", " ", "A"]
    scan = o13.transduce([t.encode() for t in texts])
    words = [WORDS.findall(t) for t in texts]
    assert scan.n_words.tolist() == [len(w) for w in words] and scan.n_points.tolist() == [len(t) for t in texts]
    assert scan.n_capitals.tolist() == [len(re.findall("[A-Z]", t)) for t in texts] and scan.n_symbols.tolist() == [len(re.findall("[#$%&*|]", t)) for t in texts]
    assert [scan.buffer[a:b].tobytes().decode() for a, b in zip(scan.start, scan.end, strict=True)] == [x for w in words for x in w]
    assert o13.transduce([]).n_words.tolist() == []
    distinct = [len(set(w)) for w in words]
    assert o13.distinct_words(scan).tolist() == distinct
    # counts stay exact if all hashes are one, or if words agree in them by chance
    for hashes in (np.zeros(len(scan.start), np.uint64), np.array([rng.randint(0, 3) for _ in scan.start], np.uint64)[scan.end - scan.start]):
        assert o13.distinct_words(scan, hashes).tolist() == distinct


def test_transducer_compares_long_words():
    word = "w" * 5_000
    scan = o13.transduce([f"{word}x {word}y {word}x {word}".encode()])
    assert o13.distinct_words(scan, np.zeros(4, np.uint64)).tolist() == [3]
