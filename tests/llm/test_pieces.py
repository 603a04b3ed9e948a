import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from lumenframe.llm import pieces as p

PATH = public_tokenizers.path("piece_bpe_32k.model")
SPICE = [" ", "  ", "\n", "a", "the", "ing", "tion", "é", "日本語", "▁", "<s>", "<0x41>", "🙂", "x" * 30, " " * 20, "q", "\t", "Th", "ß"]


def as_unigram() -> bytes:
    """The same pieces and scores as a unigram model: the model type's varint is set to 1."""
    b = open(PATH, "rb").read()
    at = 0
    for f, _, v in p._fields(b):
        if f == 2:
            at = b.index(v)
            new = v.replace(b"\x18\x02\x20", b"\x18\x01\x20", 1)
            assert new != v
            return b[:at] + new + b[at + len(v) :]
    raise AssertionError


def texts():
    r = random.Random(2)
    out = ["", " ", "a", "  a ", "Hello, world"]
    for n in (3, 20, 120):
        out += ["".join(r.choice(SPICE) for _ in range(n)) for _ in range(25)]
    return [*out, "thtionering" * 60, "日本" * 300, "zq" * 200]


def test_equals_the_library():
    proto = open(PATH, "rb").read()
    lib, m = sentencepiece.SentencePieceProcessor(model_proto=proto), p.Model(proto)
    assert m.bpe and m.apart and m.identity
    for x in texts():
        ids = p.encode(m, x)
        assert np.frombuffer(ids, "<u4").tolist() == lib.encode(x)
        assert p.decode(m, ids) == lib.decode(lib.encode(x))
        s = p.Stream(m)  # the whole text in one stream gives the same
        if x:
            assert s.feed(p.normalized(m, x)) + s.finish() == lib.encode(x)


def test_unigram_path_has_the_best_score():
    """Against all segmentations of short texts."""
    m = p.Model(as_unigram())
    assert not m.bpe

    def every(x):
        if not x:
            yield 0.0
        for k in range(1, len(x) + 1):
            s = float(m.score[m.id[x[:k]]]) if x[:k] in m.id else float(m.penalty) if k == 1 else None
            if s is not None:
                for rest in every(x[k:]):
                    yield s + rest

    r = random.Random(4)
    for _ in range(60):
        x = "".join(r.choice("thetionrsq▁é") for _ in range(r.randint(1, 9)))
        s = p.Stream(m)
        ids = s.feed(x) + s.finish()
        got = sum(float(m.score[i]) if m.kind[i] == m.NORMAL else 0.0 for i in ids)
        got += float(m.penalty) * sum(1 for c in x if c not in m.id)
        assert got == pytest.approx(max(every(x)), rel=1e-6)


def test_window_is_bounded():
    m = p.model("piece_bpe_32k.model")
    s = p.Stream(m)
    out = s.feed("thtionering" * 3000)
    assert s.most <= 8 * m.longest and out


def test_table(spark):
    df = spark.createDataFrame([(1, None, 1), (2, "", 2), (3, "ab cd", 3)], "doc_id bigint, text string, ids int")
    lib = sentencepiece.SentencePieceProcessor(model_file=PATH)
    assert {r.doc_id: r.ids for r in p.encoded(df).collect()} == {1: [], 2: [], 3: lib.encode("ab cd")}
