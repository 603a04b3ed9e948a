import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from lumenframe.llm import tokencount as t

SPICE = [" ", "  ", "\n", "\n\n ", "\t", "a", "word", "don't", "é", "日本語", "<|endoftext|>", "<|endo", "123", "!!!", " ", "　", "x" * 40, "🙂", "\r\n"]


def texts():
    r = random.Random(11)
    out = ["", " ", "a", "  a", "a  ", "<|endoftext|>"]
    for n in (5, 50, 400, 3000):
        out += ["".join(r.choice(SPICE) for _ in range(n)) for _ in range(6)]
    return [*out, "日本語" * 2000, "a" * 5000, " " * 5000, "ab " * 3000]


@pytest.mark.parametrize("chunk,overlap", [(1 << 16, 256), (200, 4), (64, 1), (37, 8)])
def test_equals_the_libraries(chunk, overlap):
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    c = t.codec("byte_bpe_50k.json")
    assert isinstance(c, t.ByteLevel) and c.chunked
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    p = t.codec("piece_bpe_32k.model")
    assert p.chunked
    for x in texts():
        assert t.encode_long(c, x, chunk, overlap).tolist() == lib.encode(x, add_special_tokens=False).ids
        assert t.encode_long(p, x, chunk, overlap).tolist() == sp.encode(x)


def test_other_files_go_whole():
    c = t.codec("word_bpe_49k.json")
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert isinstance(c, t.Library)
    assert all(t.encode_long(c, x, 50, 4).tolist() == lib.encode(x, add_special_tokens=False).ids for x in texts())


def test_counts(spark):
    df = spark.createDataFrame([(1, None, 2), (2, "", 3), (3, "a b " * 2000, 4), (3, "a", 5)], "doc_id bigint, text string, n_tokens int")
    rows = sorted(map(tuple, t.counts(df).collect()))
    assert rows == [(1, 0, 0, False), (2, 0, 0, False), (3, 1, 1, False), (3, 8000, 4001, True)]
    assert np.all([r[2] >= 0 for r in rows])
