import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from stratalith.llm import token_files as T
from stratalith.llm.words import buffers

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("bits", [1, 7, 15, 16, 17, 32])
def test_files(tmp_path, bits):
    rng = np.random.default_rng(bits)
    ids = rng.integers(0, 2**bits, 20_001, dtype=np.uint64).astype(np.uint32)
    w = T.Writer(str(tmp_path / "f"), bits, 1000 if bits % 2 else 1003)
    cuts = [0, 0, 5, 999, 12_000, 20_001]
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        w.add(np.array([k]), np.array([b - a]), ids[a:b])
    w.close()
    r = T.Reader(str(tmp_path / "f"))
    assert (r.range(0, 20_001) == ids).all()
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        assert (r.document(k) == ids[a:b]).all()
    for _ in range(30):
        a, b = sorted(rng.integers(0, 20_002, 2))
        assert (r.range(int(a), int(b)) == ids[a:b]).all()


def test_round_trip(spark, monkeypatch):
    rnd = random.Random(2)
    bits = ["the", "Hello", "é", "don't", " ", "  ", "\n", "\n\n", "\t", ",", "<|endoftext|>", " ", "日本", "12345", "x's,", "(the)", "Ü!!", "\u00a0", "\u3000", "\r\n", "…", "'ll", "×,", "ñ\n", "\x1c", " ", "a.b", "x" * 50]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 60))) for _ in range(150)] + [" ".join(rnd.choice(bits) for _ in range(rnd.randint(0, 60))) for _ in range(150)]
    rows = [(i * 3, t) for i, t in enumerate(texts)] + [(1000, None), (1001, ""), (None, "null id"), (None, None), (6, texts[2]), (6, "other"), (1002, "word " * 200_000)]
    rnd.shuffle(rows)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, start long, ids string")
    got = [tuple(r) for r in T.digest(T.encode_documents(spark, df)).collect()]
    lib, want, at = Tokenizer.from_file(PATH), {}, 0
    plain = sorted((i is None, i or 0) for i, _ in rows)
    enc = sorted((str(i), lib.encode(t or "", add_special_tokens=False).ids + [0]) for i, t in rows)
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    assert sorted((str(g[0]), g[2], g[3]) for g in got) == sorted((i, len(x), crc(x)) for i, x in enc)
    for g in sorted(got, key=lambda g: g[1]):
        assert g[1] == at
        at += g[2]
    assert [(g[0] is None, g[0] or 0) for g in sorted(got, key=lambda g: g[1])] == plain
    for size in (400_000, 3):
        monkeypatch.setattr(T, "CACHE", size)
        e = T.Encoder(PATH)
        for lo in range(0, len(texts), 50):
            part = texts[lo : lo + 50]
            raw, off = buffers(pa.array(part))
            ids, n = e.encode(raw, off)
            cut = np.split(ids, np.cumsum(n)[:-1])
            assert [c.tolist() for c in cut] == [lib.encode(t, add_special_tokens=False).ids for t in part]
    assert T.encode_documents(spark, df.where("doc_id < 0")).collect() == []


def test_a_tokenizer_that_normalises_gets_whole_texts():
    path = public_tokenizers.path("word_bpe_49k.json")
    e, lib = T.Encoder(path), Tokenizer.from_file(path)
    texts = ["The  Quick\nbrown fox's café cafe\u0301", "", "A,b  c", "ONE two"] * 3
    raw, off = buffers(pa.array(texts))
    ids, n = e.encode(raw, off)
    assert not e.cuts and [c.tolist() for c in np.split(ids, np.cumsum(n)[:-1])] == [lib.encode(t, add_special_tokens=False).ids for t in texts]


def test_many_rows_without_an_id(spark):
    rnd = random.Random(3)
    rows = [(None if i % 3 == 0 else i, "".join(rnd.choice("ab ,é") for _ in range(rnd.randint(0, 30)))) for i in range(120)]
    got = [tuple(r) for r in T.digest(T.encode_documents(spark, spark.createDataFrame(rows, "doc_id long, text string"))).collect()]
    lib = Tokenizer.from_file(PATH)
    want = sorted((str(i), len(lib.encode(t, add_special_tokens=False).ids) + 1) for i, t in rows)
    assert sorted((str(g[0]), g[2]) for g in got) == want
    ends = sorted((g[1], g[1] + g[2]) for g in got)
    assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:]))
    assert all(g[0] is None for g in sorted(got, key=lambda g: g[1])[80:])
