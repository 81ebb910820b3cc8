import hashlib
import random

import public_tokenizers as P
import pytest

from lexmill.llm import op4_bpe, op5_token_counts
from tests.llm.helpers import EDGES, rows_of, small, table

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
PIECES = P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=op4_bpe.read_ranks(RANKS), special_tokens={})


def random_texts(n, alphabet, seed=4):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_codec_equals_the_library(tiktoken_encoding):
    codec = op4_bpe.Codec(RANKS, P.PATTERN, remember=50)
    texts = random_texts(800, "ab  \n\t1!é€𝄞aaathe'sll") + ["a" * 3000 + "!" * 2000 + "ab" * 2000, "", "<|endoftext|>"]
    for text in texts:
        ids = codec.encode(text)
        assert ids == tiktoken_encoding.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


def test_texts_merged_together_equal_the_library(tiktoken_encoding, monkeypatch):
    texts = random_texts(900, "ab  \n\t1!é€𝄞aaathe'sll", seed=6) + ["a" * 500 + " " + "the" * 400, "", "a" * 499, " " * 70 + "x"]
    want = [tiktoken_encoding.encode_ordinary(t) for t in texts]
    for together in (1, 100, 1 << 20):
        monkeypatch.setattr(op4_bpe, "MERGED", together)
        codec = op4_bpe.Codec(RANKS, P.PATTERN, remember=50)
        got = codec.encoded(texts[:450]) + codec.encoded(texts[450:])
        assert [[i for ids, _, _ in parts for i in ids] for parts in got] == want
        assert [",".join(x for _, x, _ in parts) for parts in got] == [",".join(map(str, ids)) for ids in want]
        assert [b"".join(x for *_, x in parts) for parts in got] == [t.encode() for t in texts]
        assert all(len(piece) <= codec.longest for piece in codec.known)
    # a lower rank that only comes up within a bucket goes before the rest of it, and a byte without a rank is an error
    ranks = {b"a": 0, b"b": 1, b"c": 2, b"abc": 3, b"bc": 4, b"abcabc": 5, b"aa": 6}
    pairs = op4_bpe.np.array([ranks.get(bytes((a, b)), -1) for a in range(256) for b in range(256)])
    assert op4_bpe.merge_pieces([b"abcabcbc", b"", b"aabcaaa", b"c"], ranks, pairs) == [(5, 4), (), (0, 3, 6, 0), (2,)]
    with pytest.raises(KeyError):
        op4_bpe.merge_pieces([b"abx"], ranks, pairs)


def test_a_stage_remembers_less_than_a_query_and_shares_its_ints(monkeypatch):
    import inspect

    assert inspect.signature(op4_bpe.bpe_encode).parameters["remember"].default <= 50_000 < op4_bpe.REMEMBERED
    monkeypatch.setattr(op4_bpe, "_codecs", {})
    small_one, large = (op4_bpe.Codec.shared(RANKS, P.PATTERN, n) for n in (500, 100_000))
    assert small_one is op4_bpe.Codec.shared(RANKS, P.PATTERN, 500) and small_one is not large
    texts = [" ".join(f"zq{k:x}x{k * 7919:x}" for k in range(i, i + 100)) for i in range(0, 5_000, 100)]
    got = [codec.encoded([t])[0] for t in texts for codec in (small_one, large)]
    assert got[::2] == got[1::2] and len(small_one.known) + len(small_one.older) < 2_000 < len(large.known)
    seen = {}
    assert all(seen.setdefault(i, i) is i for ids, _, _ in large.known.values() for i in ids)


def test_bpe_digests(spark, tiktoken_encoding):
    rows = [(r.doc_id, r.text) for r in small(spark, 40).collect()]
    got = rows_of(op4_bpe.bpe_digests(small(spark, 40), RANKS, P.PATTERN))
    for doc_id, text in rows:
        ids = tiktoken_encoding.encode_ordinary(text)
        r = got[doc_id]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_bpe_edges(spark):
    out = op4_bpe.bpe_encode(table(spark, EDGES), RANKS, P.PATTERN).collect()
    assert len(out) == len(EDGES) and all(r.round_trip for r in out)
    by_id = {r.doc_id: r for r in out}
    assert by_id[1].ids == [] and by_id[2].n_tokens == 0 and by_id[None].n_tokens > 0
    assert op4_bpe.bpe_encode(table(spark, []), RANKS, P.PATTERN).collect() == []


def test_token_counts(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = random_texts(600, "ab  \n\t▁é<s>\x00") + ["", " ", "  ", "<s>", "</s> a", "▁", "a▁ b"]
    counter = op5_token_counts.PieceCounter(PIECES, remember=40)
    assert op5_token_counts.count_block(texts, counter).tolist() == [len(model.encode(t)) for t in texts]
    out = op5_token_counts.token_counts(table(spark, EDGES), PIECES).collect()
    assert len(out) == len(EDGES)
    want = {i: (len((t or "").encode()), len(model.encode(t or ""))) for i, t in EDGES}
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in out} == want
    assert {r.doc_id for r in out if r.over_limit} == {8}
    assert op5_token_counts.token_counts(table(spark, []), PIECES).collect() == []
