import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from lexmill.llm import op6_toxicity as o6
from lexmill.llm import op10_quality as o10
from tests.llm.helpers import EDGES, small, table

MIDDLE = "/root/testdata/sf0.1"


def test_toxicity_on_the_held_out_third(spark):
    docs, labels = (spark.read.parquet(f"{MIDDLE}/{t}.parquet") for t in ("documents", "labels"))
    rows = docs.join(labels.select("doc_id"), "doc_id", "left_semi").select(*docs.columns)
    model = o6.fit(rows, labels)
    scored = o6.toxicity_scores(rows, model).join(labels, "doc_id").filter("held_out").toPandas()
    toxic, clean = scored[scored.toxic == 1], scored[scored.toxic == 0]
    assert toxic.predicted.mean() > 0.75 and clean.predicted.mean() < 0.02
    assert (toxic.score.values[:, None] > clean.score.values[None]).mean() > 0.9
    assert scored.score.between(0, 1).all()
    again = o6.fit(rows, labels)
    assert np.array_equal(model.weights, again.weights) and (model.slope, model.shift) == (again.slope, again.shift)


def toy():
    rng = random.Random(6)
    plain = ["thing", "ration", "hearth", "lantern", "window", "garden", "winter", "number", "basket", "evening"]
    rows = []
    for i in range(300):
        words = [rng.choice(plain) + rng.choice(["", "s", "ly"]) for _ in range(30)]
        if i % 3 == 0:
            words[rng.randrange(30)] = rng.choice(["grobblewit", "snarfthick"])
        rows.append((" ".join(words), int(i % 3 == 0)))
    return rows


def test_gaps_and_inserted_signs_are_tolerated():
    rows = toy()
    model = o6.train([t for t, _ in rows], np.array([y for _, y in rows]))
    bad = ["you grobblewit", "a grob-blewit", "g r o b b l e w i t", "grobbblewit there", "GROBBLEWIT!!", "gr0bblewit"]
    good = ["a thing in the garden", "evenings", "", " \n", "123 456", "growing blue whites"]
    assert (model.score(bad) >= 0.7).all() and (model.score(good) < 0.5).all()


def test_unit_kernel_equals_brute_force():
    def plain(a, b):
        def vector(word):
            s = [0, *(ord(c) - 96 for c in word), 0]
            out, square = {}, 0.0
            for i in range(len(s)):
                for x in (1, 2):
                    for y in (1, 2):
                        for z in (1, 2):
                            if i + x + y + z < len(s):
                                key = (s[i], s[i + x], s[i + x + y], s[i + x + y + z])
                                w = o6.DECAY ** (x + y + z - 3)
                                out[key] = out.get(key, 0) + w
                                square += w * w
            return {k: v / square**0.5 for k, v in out.items()}

        va, vb = vector(a), vector(b)
        return sum(v * vb.get(k, 0) for k, v in va.items())

    words = ["idiot", "idioot", "thing", "banana", "bananas", "ab"]
    got = o6.kernel(words, o6.sparse_rows(words), len(words))
    want = np.array([[plain(a, b) for b in words] for a in words])
    assert np.allclose(got, want, atol=1e-5)


def test_toxicity_edges(spark):
    rows = toy()
    docs = table(spark, EDGES + [(i + 100, t) for i, (t, _) in enumerate(rows)])
    labels = spark.createDataFrame([(i + 100, y) for i, (_, y) in enumerate(rows)] + [(100, None), (None, 1)], "doc_id long, toxic int")
    model = o6.fit(docs, labels)
    out = o6.toxicity_scores(docs, model).collect()
    assert len(out) == len(EDGES) + len(rows) and all(0 <= r.score <= 1 for r in out)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out if r.doc_id is not None)
    nothing = o6.fit(table(spark, []), labels)
    assert {r.predicted for r in o6.toxicity_scores(docs, nothing).collect()} == {0}
    assert o6.toxicity_scores(table(spark, []), model).collect() == []
    # labels of the held-out third are never looked at
    flipped = labels.withColumn("toxic", F.when(o6.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert np.array_equal(o6.fit(docs, flipped).weights, model.weights)


def plain_facts(text):
    words = o10.WORD.findall(text)
    lines = text.split("\n")
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {k for i, g in enumerate(grams) if grams.count(g) > 1 for k in (i, i + 1, i + 2)}
    dup = sum(1 for i, x in enumerate(lines) if o10.WORD.search(x) and x in lines[:i])
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(hit)


def test_base_counts_equal_brute_force(spark):
    rng = random.Random(1)
    texts = [t or "" for i, t in EDGES if i != 8] + [r.text for r in small(spark, 60).collect()]
    texts += ["".join(rng.choice(["a", "b", " ", "\n", "\r\n", "#", "\x1c", "\x85", "é", "\t|"]) for _ in range(80)) for _ in range(300)]
    for text in texts:
        f = o10.facts_of(text)
        assert (f.n_words, f.word_chars, f.n_symbols, f.n_dup_lines, f.n_repeat_words) == plain_facts(text)


def test_line_features_equal_counts_by_character(spark):
    rng = random.Random(12)
    texts = ["".join(rng.choice("aAzZ09 \n\t|#$<!?._²½ÉßЖ中\x1c\x85\xa0\u3000٣Ⅷ") for _ in range(90)) for _ in range(400)]
    for text in texts + [r.text for r in small(spark, 40).collect()]:
        f, got, first = o10.facts_of(text), iter(o10.line_features(o10.facts_of(text))), True
        assert f.lines == [(line, re.findall(r"[^\x20\x09-\x0D]+", line)) for line in text.split("\n")]
        for i, (line, ws) in enumerate(f.lines):
            if not ws:
                continue
            n, letters = len(ws), [c for c in line if re.match(r"[^\W\d_]", c)]
            shares = (
                sum(c in "#*$%&|<>" for c in line) / n / 4, sum(not any(c.isalnum() for c in w) for w in ws) / n,
                sum(c.isupper() for c in letters) / max(1, len(letters)), sum(c.isdigit() for c in line) / len(line),
                1 - len(set(ws)) / n, sum(w[-1] in "!?" for w in ws) / n, 1 - len(letters) / len("".join(ws)),
            )
            marks = (True, i in f.repeated, n < 4, n > 30, ws[-1][-1] in ".!?", first)
            want = [k * 7 + sum(x > b for b in o10.BINS) for k, x in enumerate(shares)] + [49 + k for k, on in enumerate(marks) if on]
            assert next(got) == want
            first = False
        assert next(got, None) is None
    wide = "wörter über " * 20
    assert o10.splitter(wide) is str.split and o10.splitter("a\xa0b") is not str.split  # accents alone are no reason for the slow way


def test_viterbi_equals_all_paths():
    rng = np.random.default_rng(3)
    field = o10.Field(rng.normal(size=(o10.N_FEATURES, 2)), rng.normal(size=(2, 2)), rng.normal(size=2))
    for n in range(1, 8):
        rows = [sorted(rng.choice(o10.N_FEATURES, 4, replace=False).tolist()) for _ in range(n)]
        e = field.potentials(rows)

        def value(path):
            return field.start[path[0]] + sum(e[i, s] for i, s in enumerate(path)) + sum(field.move[a, b] for a, b in zip(path, path[1:]))

        paths = [[p >> i & 1 for i in range(n)] for p in range(2**n)]
        assert field.viterbi(rows) == max(paths, key=value)


def test_quality_verdicts(spark):
    docs, labels = (spark.read.parquet(f"{MIDDLE}/{t}.parquet") for t in ("documents", "labels"))
    rows = docs.join(labels.select("doc_id"), "doc_id", "left_semi").select(*docs.columns)
    field = o10.fit_field(rows, labels)
    judged = o10.quality_verdicts(rows, field).join(labels, "doc_id").toPandas()
    fit = judged[~judged.base_failed]
    assert fit[fit.quality == 1].kept.mean() > 0.98 and fit[fit.quality == 0].kept.mean() < 0.1
    edges = o10.quality_verdicts(table(spark, EDGES), field).collect()
    assert len(edges) == len(EDGES) and [r.doc_id for r in edges if r.kept] == []
    kept = o10.keep_quality(rows, field)
    assert kept.columns == rows.columns
    assert {r.doc_id for r in kept.select("doc_id").collect()} == set(judged[judged.kept].doc_id)
    assert o10.keep_quality(table(spark, EDGES), field).columns == table(spark, EDGES).columns
    assert o10.fit_field(table(spark, []), labels) is None
    assert o10.quality_verdicts(table(spark, []), None).collect() == []
    assert [r.kept for r in o10.quality_verdicts(table(spark, [(1, "w%d " % 1 + " ".join(f"w{i}" for i in range(60)))]), None).collect()] == [True]
