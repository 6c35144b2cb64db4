import random
from array import array

import numpy as np
import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from chronoframe.llm.bpe import Decoder, Encoder, Merges, Transducer, encode_decode  # noqa: E402
from chronoframe.llm.search import top_k  # noqa: E402
from chronoframe.llm.tokens import PreTokens, count_tokens, piece_counter  # noqa: E402

BYTE, WORD = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def merges():
    return Merges.load(BYTE)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    alphabet = "aàéthe ing'sTHE  \n\t-=.。日本語😀Σσς0123ab<|endoftext|>  İ\x1c\x00ﬁ"
    odd = ["", " ", "<|endoftext|>", "x<|endoftext|> y<|startoftext|>", "-" * 3000, "a" * 3000, "thethethe" * 500, "é" * 2000, "ΑΣ ΣΑΣ 'S it'LL", "\ua7cb\ua7dc\U00032808b"]
    wild = "".join(chr(rng.choice([rng.randint(1, 0xD7FF), rng.randint(0xE000, 0x10FFFF)])) for _ in range(4000))
    return odd + [wild] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80))) for _ in range(400)]


def test_encoder_equals_library(merges, texts):
    library, enc = Tokenizer.from_file(BYTE), Encoder(merges)
    for x in texts:
        ids = library.encode(x, add_special_tokens=False).ids
        assert array("I", b"".join(enc.pieces(x))).tolist() == ids
        dec = Decoder(merges)
        assert "".join(dec.feed([i]) for i in ids) + dec.finish() == library.decode(ids, skip_special_tokens=False)


def test_transducer_keeps_constant_memory(merges):
    library = Tokenizer.from_file(BYTE)
    rng = random.Random(1)
    for x in ("".join(rng.choice("abcdefthe") for _ in range(20_000)), "ab" * 10_000, "z" * 30_000):
        run, ids = Transducer(merges), []
        for at in range(0, len(x), 777):
            ids += run.feed(x[at : at + 777].encode())
        ids += run.finish()
        assert ids == library.encode(x, add_special_tokens=False).ids
        assert run.held <= 4 * merges.lookahead


def test_decoder_replaces_invalid_bytes(merges):
    library = Tokenizer.from_file(BYTE)
    rng = random.Random(2)
    for _ in range(200):
        ids = [rng.randrange(50_257) for _ in range(12)]
        dec = Decoder(merges)
        assert dec.feed(ids[:5]) + dec.feed(ids[5:]) + dec.finish() == library.decode(ids, skip_special_tokens=False)


def test_counts_equal_library(texts):
    library, pre, count = Tokenizer.from_file(WORD), PreTokens(WORD), piece_counter(WORD)
    for x in texts:
        found, special = pre.counts(x)
        assert special + sum(n * count(t) for t, n in found.items()) == len(library.encode(x, add_special_tokens=False).ids)


@pytest.mark.parametrize("hot", [0, 3, 1 << 18])
def test_count_frame(spark, texts, hot):
    library = Tokenizer.from_file(WORD)
    rows = [(i, t.replace("\x00", "")) for i, t in enumerate(texts[:60])] + [(None, "null id"), (3, None), (7, "again"), (7, "again")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n long")
    got = sorted(map(str, (tuple(r) for r in count_tokens(df, WORD, limit=20, hot=hot).collect())))
    want = [(i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 20) for i, t in rows]
    assert got == sorted(map(str, want))
    assert count_tokens(df.limit(0), WORD).count() == 0


def test_encode_frame(spark):
    df = spark.createDataFrame([(1, "Hello wörld", "x"), (None, None, "y"), (1, "Hello wörld", "x")], "doc_id long, text string, ids string")
    got = encode_decode(df, BYTE).collect()
    assert sorted((str(r["doc_id"]), r["decoded"]) for r in got) == [("1", "Hello wörld"), ("1", "Hello wörld"), ("None", "")]
    assert encode_decode(df.limit(0), BYTE).count() == 0


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(700, 12)), 2)
    x[100:140] = x[5]  # ties
    rows = [(int(i), [float(c) for c in v]) for i, v in enumerate(x)]
    odd = [(1000, None), (1050, [None] * 12), (1100, [float("nan")] * 12), (None, rows[0][1]), (1150, [1.0, 2.0])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")
    whole = {**{i: np.floor(256 * np.array(v)) for i, v in rows}, 1150: np.floor(256 * np.array([1.0, 2.0] + [0.0] * 10))}
    want = []
    for q in [i for i in whole if i % 50 == 0]:
        best = sorted(((-int(whole[q] @ v), i) for i, v in whole.items() if i != q))[:5]
        want += [(q, k, i, -s) for k, (s, i) in enumerate(best, 1)]
    assert sorted(tuple(r) for r in top_k(df, groups=3).collect()) == sorted(want)
    assert top_k(df.limit(0)).count() == 0
    assert top_k(df.filter(F.col("vec_id") < 3)).count() == 2


def test_top_k_of_huge_components_is_exact(spark):
    """Sums beyond 2**53 are taken in whole numbers; scores beyond 64 bits become the nearest long."""
    rng = random.Random(4)
    rows = [(i, [rng.choice([-1, 1]) * float(rng.randint(1, 2**52)) for _ in range(4)]) for i in range(101)] + [(101, [1e18] * 4), (102, [-1e18] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in top_k(df, scale=1).collect()}
    for q, v in rows:
        if q % 50 == 0:
            s = sorted((-max(min(sum(int(a) * int(b) for a, b in zip(v, w, strict=True)), 2**63 - 1), -(2**63)), i) for i, w in rows if i != q)
            assert [got[q, k] for k in range(1, 6)] == [(i, -x) for x, i in s[:5]]


def test_top_k_carries_scores_over_shards(spark, monkeypatch):
    from chronoframe.llm import search

    monkeypatch.setattr(search, "SHARD", 16)
    monkeypatch.setattr(search, "QUERY_BLOCK", 2)
    rng = np.random.default_rng(1)
    x = rng.integers(-3, 4, (300, 8)).astype(float)  # many ties
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    for groups in (1, 3, None):
        got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in top_k(df, scale=1, groups=groups).collect()}
        for q in range(0, 300, 50):
            best = sorted((-int(x[q] @ x[i]), i) for i in range(300) if i != q)[:5]
            assert [got[q, k] for k in range(1, 6)] == [(i, -s) for s, i in best]
