import random

import numpy as np
import pytest

from confab.llm import bpe, quantiles
from confab.llm.quantiles import Sketch, error_bound

QS = [0.001, 0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 0.999]


def rank_error(x, v, q):
    x, r = np.sort(x), np.ceil(q * len(x))
    return max(0, np.searchsorted(x, v, "left") + 1 - r, r - np.searchsorted(x, v, "right"))


@pytest.mark.parametrize("values", [np.random.default_rng(1).exponential(9, 120_000), np.arange(100_000.0), np.arange(100_000.0)[::-1], np.random.default_rng(2).integers(0, 40, 90_000).astype(float)])
def test_merged_sketches_stay_within_the_bound(values):
    total = Sketch()
    for i, part in enumerate(np.array_split(values, 23)):
        s = Sketch(seed=i)
        s.add(part)
        total.merge(Sketch.unpack(s.pack()))
    assert total.high.n == len(values) and len(total.pack()) < 120_000
    for q in QS:
        assert rank_error(values, total.quantile(q), q) <= error_bound(q) * len(values) + 1


def test_small_sets_are_exact_and_groups_with_nulls(spark):
    rows = [("a", float(i)) for i in range(1, 101)] + [(None, 5.0), (None, None), ("b", float("nan")), ("c", -3.0), ("c", 0.0)]
    df = spark.createDataFrame(rows, "g string, value double")
    got = {(r.g, r.q): (r.n, r.value) for r in quantiles.percentiles(quantiles.merged(quantiles.sketch(df, ["g"], ["value"]), ["g"]), ["g"], [0.0, 0.5, 1.0]).collect()}
    assert got["a", 0.5] == (100, 50.0) and got["a", 1.0] == (100, 100.0) and got[None, 0.5] == (1, 5.0) and got["c", 0.0] == (2, -3.0)
    assert not any(g == "b" for g, _ in got)
    assert quantiles.sketch(df.limit(0), ["g"], ["value"]).collect() == []


def test_ids_equal_the_public_encoder(spark):
    import public_tokenizers
    import tiktoken

    path = bpe.default_path()
    ref = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    assert bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.json")).items() >= bpe.read_ranks(path).items()
    enc, dec, rnd = bpe.Encoder(path, bpe.lookahead(path)), bpe.Decoder(path), random.Random(3)
    texts = ["", "Ahoj, světe!", "a  b", "x\n \n y ", "it's <|endoftext|> we'll", "​﻿ ﬁ İ", "ž" * 5000, "ab" * 40_000, "word " * 30_000]
    texts += ["".join(rnd.choice(["a", "b ", " ", "\n", "\r\n", "\t", "'s", "1", ".", "é", "\xa0", "漢"]) for _ in range(rnd.randrange(12))) for _ in range(3000)]
    texts += ["".join(rnd.choice("ab") for _ in range(3000)), "".join(rnd.choice("aeiouthe") for _ in range(4000))]
    for t in texts:
        ids = list(enc.encode(t))
        assert ids == ref.encode_ordinary(t), repr(t[:40])
        assert dec.decode(ids) == t
    df = spark.createDataFrame([(1, "a b"), (2, None), (3, ""), (3, ""), (None, "a b")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.ids) for r in bpe.encode(df).collect())
    assert got == [(0, ref.encode_ordinary("a b")), (1, ref.encode_ordinary("a b")), (2, []), (3, []), (3, [])]


def test_decoder_on_broken_bytes():
    d = bpe.Decoder(bpe.default_path())
    for data in (b"\xc5", b"\xe2\x82", b"\xff\xfeab", "žluť€😀".encode(), b"\xed\xa0\x80", b"a\xc5b"):
        d.reset()
        assert d.feed(data) + "�" * bool(d.need) == data.decode("utf-8", "replace")
    word = "žluť€😀".encode()
    d.reset()
    assert "".join(d.feed(word[i : i + 1]) for i in range(len(word))) == "žluť€😀"


@pytest.mark.parametrize("chunk", [1 << 16, 64, 17])
def test_windows_change_no_ids(chunk, monkeypatch):
    import tiktoken

    monkeypatch.setattr(bpe, "CHUNK", chunk)
    path = bpe.default_path()
    ref = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    enc, rnd = bpe.Encoder(path, bpe.lookahead(path)), random.Random(5)
    for _ in range(400):
        kinds = [" ", "  ", "\n", "a", "é", "Z" * rnd.randint(1, 90), "12" * rnd.randint(1, 40), "'s", " '", "!" * rnd.randint(1, 80), " " * rnd.randint(1, 80), "　", "word ", "日本" * rnd.randint(1, 30), "\x1c"]
        t = "".join(rnd.choice(kinds) for _ in range(rnd.randint(0, 60)))
        assert list(enc.encode(t)) == ref.encode_ordinary(t), repr(t)


@pytest.mark.parametrize("text", ["ab" * 500_000, " " * 500_000 + "x", "é1!" * 200_000, "slovo " * 500_000])
def test_memory_is_that_of_a_window(text):
    import tracemalloc

    path = bpe.default_path()
    enc = bpe.Encoder(path, bpe.lookahead(path))
    tracemalloc.start()
    n = sum(1 for _ in enc.encode(text))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n and peak < 3_000_000
