import hashlib
import os
import random
import re
import time
from urllib.parse import unquote, urlparse

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lexmill.llm import common
from lexmill.llm import op3_simhash as o3
from lexmill.llm import op7_lines as o7
from lexmill.llm import op9_substrings as o9
from lexmill.llm.components import connected_components
from tests.llm.helpers import EDGES, rows_of, small, table


def groups_of(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(5)
    pairs = [(i, i + 1) for i in range(60)] + [(200, x) for x in range(201, 260)] + [(rng.randint(300, 420), rng.randint(300, 420)) for _ in range(70)]
    links = spark.createDataFrame(pairs, "a long, b long")
    got = {r.node: r.component for r in connected_components(links).collect()}
    want = groups_of(pairs, {x for p in pairs for x in p})
    assert {n: c for n, c in want.items() if n in got} == got
    assert all(n in got for a, b in pairs if a != b for n in (a, b))
    assert connected_components(links.filter("a < 0")).collect() == []


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", text.encode().lower())
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint_equals_brute_force(spark):
    texts = [t or "" for _, t in EDGES] + [r.text for r in small(spark, 60).collect()]
    assert [o3.fingerprint(t) for t in texts] == [plain_fingerprint(t) for t in texts]


@pytest.mark.parametrize("subtree", [2, 50, 10_000])
def test_trie_join_equals_all_pairs(spark, subtree):
    rng = np.random.default_rng(subtree)
    centres = rng.integers(0, 2**64, 40, dtype=np.uint64)
    values = [int(c) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for c in centres for _ in range(12)]
    values = sorted(set(values) | {0, 2**64 - 1, 1, 3})
    frame = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v, i) for i, v in enumerate(values)], "fp long, rep long")
    links = [(r.a, r.b) for r in o3.trie_links(frame, subtree=subtree).collect()]
    near = [(i, j) for i in range(len(values)) for j in range(i) if (values[i] ^ values[j]).bit_count() <= 3]
    nodes = range(len(values))
    assert groups_of(links, nodes) == groups_of(near, nodes)


def test_dense_subtree_is_one_component():
    rng = np.random.default_rng(1)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, 2, replace=False)) for _ in range(1500)], np.uint64)
    values = np.unique(flips ^ np.uint64(0x0123456789ABCDEF))
    linked, root = o3.join_subtrees(values, None)
    pairs = [(i, j) for i in range(len(values)) for j in range(i) if int(values[i] ^ values[j]).bit_count() <= 3]
    want = groups_of(pairs, range(len(values)))
    assert {n: c for n, c in want.items() if n != c} == dict(zip(linked.tolist(), root.tolist()))


def test_simhash_components(spark):
    rows = EDGES + [(i + 100, r.text) for i, r in enumerate(small(spark, 60).collect())]
    out = o3.simhash_components(table(spark, rows)).collect()
    assert len(out) == len(rows)
    prints = {i: plain_fingerprint(t or "") for i, t in rows if i is not None}
    near = [(a, b) for a in prints for b in prints if b < a and (prints[a] ^ prints[b]).bit_count() <= 3]
    want = groups_of(near, prints)
    for r in out:
        if r.doc_id is not None:
            assert (r.fp & (2**64 - 1), r.component_id) == (prints[r.doc_id], want[r.doc_id])
    kept = o3.keep_representatives(table(spark, rows))
    assert kept.columns == table(spark, rows).columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(set(want.values())) and ids.count(None) == 1
    repeated = o3.keep_representatives(table(spark, [(1, "b c d"), (1, "b c d"), (2, "x y z w")]))
    assert sorted(r.doc_id for r in repeated.collect()) == [1, 2]
    assert o3.simhash_components(table(spark, [])).collect() == [] and o3.keep_representatives(table(spark, [])).collect() == []


def plain_norm(line):
    return re.sub("[ \t\n\x0b\f\r]+", " ", line.lower()).strip(" ")


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def majority(hashes):
    return sum(1 << b for b in range(60) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_bits(tokens):
    return majority([xxhash.xxh64_intdigest(w.encode(), 42) for w in set(tokens)])


def plain_cuts(norm):
    """The cuts of a line: its blocks as (by words, power, side, place, bits of the block that count)."""
    words = norm.split(" ")
    kinds = [True] * (len(words) >= 6) + [False] * (4 * len(words) < 30)
    out = []
    if len(norm) < 5:
        return out
    for by_words in kinds:
        tokens = words if by_words else list(norm)
        least = len(tokens).bit_length() - 1
        for power in [least] + [least + 1] * (len(tokens) >= 0.8 * 2 ** (least + 1)):
            size = max(3, (1 << power) // 4) if by_words else (1 << power) // 2
            cut = []
            for side, row in enumerate((tokens, tokens[::-1])):
                for j in range(len(tokens) // size if by_words else 1):
                    part = row[j * size : (j + 1) * size]
                    width, longs = (4, 2) if len(set(part)) < 8 else (7, 4) if len(set(part)) < 64 else (15, 8)
                    cut.append((by_words, power, side, j, plain_bits(part) & sum(1 << i + width * k for i in range(longs) for k in range(63 // width))))
            out.append(cut)
    return out


def plain_line_dedup(rows, similarity=0.8, links=True):
    """All pairs of distinct lines, on documents with different ids."""
    places = [(i, k, plain_norm(x)) for i, t in rows if i is not None for k, x in enumerate((t or "").split("\n")) if plain_norm(x)]
    norms = sorted({n for *_, n in places})
    meet = {}
    for n in norms:
        for cut in plain_cuts(n):
            for x in set(cut):
                meet.setdefault(x, []).append((n, majority([y[-1] for y in cut])))
    pairs = {(a, b) for group in meet.values() for a, fa in group for b, fb in group if a < b and (fa ^ fb).bit_count() <= 10}
    links = [
        (a, b) for a, b in pairs
        if abs(len(a) - len(b)) <= (1 - similarity) * max(len(a), len(b)) + 1e-9
        and edit_distance(a, b) <= (1 - similarity) * max(len(a), len(b)) + 1e-9
    ]
    group = groups_of(links, norms)
    first = {}
    for i, k, n in places:
        first[group[n]] = min(first.get(group[n], (i, k)), (i, k))
    late = {(i, k) for i, k, n in places if first[group[n]] != (i, k)}
    return {(i, t): "\n".join(x for k, x in enumerate((t or "").split("\n")) if (i, k) not in late) for i, t in rows}


def line_rows(spark):
    rng = random.Random(7)
    base = " ".join(f"token{i}" for i in range(60))
    near = []
    for i in range(14):  # a dense group: one or two of sixty words replaced
        words = base.split()
        for k in rng.sample(range(60), rng.randint(1, 2)):
            words[k] = f"other{rng.randint(0, 3)}"
        near.append((300 + i, f"own line number {i} stands here alone {i * 7919}\n" + " ".join(words)))
    return [x for x in EDGES if x[0] not in (6, 8)] + near + [(400, "A  b\tC\nx\n\na b c\nX"), (401, "a b c ")]


def test_line_dedup_equals_brute_force(spark):
    rows = line_rows(spark) + [(r.doc_id + 500, r.text) for r in small(spark, 30).collect()]
    want = plain_line_dedup(rows)
    out = o7.dedup_lines(table(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.text) for r in out) == sorted((str(i), x) for (i, _), x in want.items())
    by_id = {r.doc_id: r for r in out}
    assert (by_id[400].n_lines, by_id[400].n_removed) == (4, 2) and by_id[401].text == ""
    stage = o7.drop_repeated_lines(table(spark, rows))
    assert stage.columns == table(spark, rows).columns
    kept = {r.doc_id: r for r in stage.collect()}
    assert 401 not in kept and None in kept and 1 in kept and kept[400].n_chars == len(kept[400].text)
    assert kept[300].fp == "x" and kept[1].text is None


def test_line_dedup_finds_what_plain_edit_similarity_finds(spark):
    rng = random.Random(23)
    words = [f"{rng.choice('bcdfgklm')}{rng.choice('aeiou')}{rng.randint(10, 999)}" for _ in range(400)]
    rows, n = [], 0
    for size in (3, 4, 6, 10, 15, 20, 30, 40):  # copies with a tenth of the words exchanged, at least one
        for _ in range(25):
            line = [rng.choice(words) for _ in range(size)]
            near = list(line)
            for k in rng.sample(range(size), max(1, size // 10)):
                near[k] = near[k][:-1] + "x" if size < 6 else rng.choice(words)
            rows += [(n, " ".join(line)), (n + 1, " ".join(near))]
            n += 2
    norms = sorted({x for _, x in rows})
    near = [
        (a, b) for k, a in enumerate(norms) for b in norms[:k]
        if abs(len(a) - len(b)) <= 0.2 * max(len(a), len(b)) and edit_distance(a, b) <= 0.2 * max(len(a), len(b)) + 1e-9
    ]
    want = len(norms) - len(set(groups_of(near, norms).values()))
    lost = sum(r.n_removed for r in o7.dedup_lines(table(spark, rows)).collect()) - (len(rows) - len(norms))
    assert want > 150 and 0.95 * want <= lost <= want, (want, lost)


def test_lines_on_both_sides_of_a_power_of_two_meet(spark):
    rng = random.Random(5)
    words = [f"{rng.choice('bcdfgklm')}{rng.choice('aeiou')}{rng.randint(10, 999)}" for _ in range(500)]
    rows, n = [], 0
    for size in (6, 8, 16, 32, 64):  # a word less is cut by another power, or by characters
        for _ in range(20):
            line = [rng.choice(words) for _ in range(size)]
            rows += [(n, " ".join(line)), (n + 1, " ".join(line[:2] + line[3:]))]
            n += 2
    for size in (8, 16, 32):
        for _ in range(20):
            line = "".join(rng.choice("abcdefghijklmnop") for _ in range(size))
            rows += [(n, line), (n + 1, line[:3] + line[4:])]
            n += 2
    similar = sum(edit_distance(a, b) <= 0.2 * max(len(a), len(b)) for (_, a), (_, b) in zip(rows[::2], rows[1::2]))
    found = sum(r.n_removed for r in o7.dedup_lines(table(spark, rows)).collect())
    assert similar > 150 and 0.95 * similar <= found, (found, similar)


def test_edit_similarity_of_pairs(spark):
    rng = random.Random(11)
    words = ["alpha", "be", "gamma", "delta", "e", "zeta"]
    lines = sorted({" ".join(rng.choice(words) for _ in range(rng.randint(1, 9))) for _ in range(60)})
    docs = table(spark, [(1, "\n".join(lines))])
    ids = [xxhash.xxh64_intdigest(x.encode()) >> 1 for x in lines]
    places = spark.createDataFrame([(h, (1, k)) for k, h in enumerate(ids)], "h1 long, first struct<doc_id: long, pos: int>")
    pairs = [(a, b) for a in range(len(lines)) for b in range(a) if rng.random() < 0.5]
    frame = spark.createDataFrame([(ids[a], ids[b]) for a, b in pairs], "a long, b long")
    got = {(r.a, r.b) for r in o7.verified(frame, places, docs, 0.6).collect()}
    near = [(a, b) for a, b in pairs if edit_distance(lines[a], lines[b]) <= 0.4 * max(len(lines[a]), len(lines[b])) + 1e-9]
    assert got == {(ids[a], ids[b]) for a, b in near} and len(near) > 20


def test_line_dedup_of_very_long_lines_and_copies(spark):
    line = " ".join(f"w{i}" for i in range(20_000))
    docs = table(spark, [(1, line), (2, line + " x"), (3, line), (3, line), (4, None)])
    assert {r.doc_id: r.n_removed for r in o7.dedup_lines(docs, similarity=0.9).collect()} == {1: 0, 2: 1, 3: 1, 4: 0}
    assert o7.dedup_lines(table(spark, [])).collect() == [] and o7.drop_repeated_lines(table(spark, [])).collect() == []


def test_line_dedup_shuffles_texts_at_every_size_and_leaves_no_shuffle_files(spark, monkeypatch):
    plans, write = [], common.scratch
    monkeypatch.setattr(o7, "scratch", lambda df, label: plans.append((label, df)) or write(df, label))
    rows = line_rows(spark)
    o7.repeated_lines(table(spark, rows).select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    texts = [df._jdf.queryExecution().optimizedPlan().toString() for label, df in plans if label == "line-texts"]
    assert texts and not any("broadcast" in plan for plan in texts)
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {x.getName() for x in (blocks.getAllFiles().apply(i) for i in range(blocks.getAllFiles().size()))}
    before = files()
    made = common.scratch(spark.range(1000).repartition(5, "id").groupBy((F.col("id") % 7).alias("k")).count(), "shuffled")
    for _ in range(50):  # they are removed in the background
        written = [x for x in files() - before if x.startswith("shuffle_")]
        if not written:
            break
        time.sleep(0.1)
    assert written == [] and made.count() == 7


def test_line_dedup_by_parts_is_the_same_and_keeps_no_prints_beside_the_texts(spark, monkeypatch):
    rows = table(spark, line_rows(spark)).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    drops = lambda: {r.doc_id: sorted(r.drop) for r in o7.repeated_lines(rows, budget=20).collect()}
    want, made, beside, write = drops(), [], [], common.scratch

    def noted(df, label):
        if label == "line-texts":
            beside.extend(name for name, t in made if "prints" in t.columns and all(os.path.exists(unquote(urlparse(f).path)) for f in t.inputFiles()))
        made.append((label, write(df, label)))
        return made[-1][1]

    monkeypatch.setattr(o7, "scratch", noted)
    monkeypatch.setattr(o7, "PAIRS", 5)
    monkeypatch.setattr(o7, "FEW_LINES", 5)
    assert drops() == want and len(want) > 10 and beside == []
    count = {label: sum(1 for x, _ in made if x == label) for label, _ in made}
    assert count["distinct-lines"] == count["line-buckets"] == count["line-crosses"] == o7.PASSES and count["line-texts"] == 2 * o7.PASSES
    assert 2 < count["line-links"] <= 2 * o7.MOST_PASSES


def test_line_dedup_runs_no_python(spark):
    plan = o7.fuzzy_groups.__code__.co_names + o7.repeated_lines.__code__.co_names + o7.fingerprinted.__code__.co_names
    assert not {"mapInArrow", "mapInPandas", "applyInPandas", "udf", "pandas_udf", "rdd"} & set(plan)
    text = o7.dedup_lines(small(spark, 20))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", text)


def plain_removal(rows, width=20):
    seen, out = set(), {}
    for doc_id, text in sorted((i, t or "") for i, t in rows if i is not None):
        words = text.encode().split()
        gone = [False] * len(words)
        for k in range(len(words) - width + 1):
            window = tuple(words[k : k + width])
            if window in seen:
                gone[k : k + width] = [True] * width
            seen.add(window)
        kept = [w for w, g in zip(words, gone) if not g]
        out[doc_id] = (len(words), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


def passages():
    rng = random.Random(9)
    words = [f"p{i}" for i in range(50)]
    parts = [" ".join(rng.choice(words) for _ in range(n)) for n in (19, 20, 21, 45, 80, 33)]
    rows = []
    for i in range(60):
        rows.append((1000 + i, " ".join(rng.choice(parts) if rng.random() < 0.5 else f"own{i}x{k} and more" for k in range(6))))
    periodic = [(2000, "a b " * 60), (2001, "x " + "a b " * 30 + "y"), (2002, "b a " * 30), (2003, "a a b " * 25)]
    return [x for x in EDGES if x[0] not in (6,)] + rows + periodic


@pytest.mark.parametrize("most", [50_000, 1])
def test_window_removal_equals_brute_force(spark, most, monkeypatch):
    rows = passages() + [(r.doc_id + 5000, r.text) for r in small(spark, 60).collect()]
    cover = o9.covered_windows
    monkeypatch.setattr(o9, "covered_windows", lambda docs, width: cover(docs, width, most_contents=most))
    out = o9.dedup_digests(table(spark, rows)).collect()
    want = plain_removal(rows)
    assert len(out) == len(rows)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in out if r.doc_id is not None} == want
    assert next(r.n_removed for r in out if r.doc_id is None) == 0 and sum(x[1] for x in want.values()) > 1000


def test_window_removal_of_nothing(spark):
    assert o9.dedup_digests(table(spark, [])).collect() == []
    one = rows_of(o9.dedup_digests(table(spark, [(1, "a b"), (2, None)])))
    assert (one[1].n_words, one[2].n_words, one[2].kept_sha256) == (2, 0, hashlib.sha256(b"").hexdigest())


def test_suffix_automaton_against_all_substrings():
    rng = random.Random(3)
    for _ in range(60):
        automaton, known = o9.SuffixAutomaton(), set()
        for _ in range(4):
            s = [rng.randint(0, 2) for _ in range(rng.randint(1, 14))]
            sizes = automaton.matching_statistics(s)
            for i, m in enumerate(sizes):
                best = max((k for k in range(i + 2) if tuple(s[i + 1 - k : i + 1]) in known or k == 0), default=0)
                assert m == best
            automaton.start()
            for x in s:
                automaton.extend(x)
            known |= {tuple(s[i:j]) for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
