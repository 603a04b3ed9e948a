"""Token counts of whole texts, with overlap resynchronisation for huge ones.

A long text is encoded in overlapping chunks with offsets.  Two encodings are spliced at
a place that both have as a token boundary and that is proven stable: white space after
something else.  No pre-token of the pattern, no special string and no piece of the model
spans such a place (pieces and strings are checked when they are loaded), and scanning
onwards from it doesn't depend on what stands before, so the splice equals the whole
encoding.
If an overlap has no such place it is doubled, at last to the whole text.

Byte-level BPE files (.json) are encoded through equal rank tables, which is several
times as fast; a file that doesn't have the expected form goes through the tokenizers
library, whole.  .model files go through sentencepiece.

Defined cases: null counts as empty; an empty text has no tokens, except that
sentencepiece adds nothing either; special strings inside texts are special tokens for
.json files, and plain text for .model files, as those libraries have it by default.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm import common
from lumenframe.llm.textvec import runs

CHUNK, OVERLAP = 1 << 16, 1 << 8  # bytes
_PAIR = re.compile(r"\s\s")
_GPT2 = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_alphabet() -> dict[str, int]:
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    out |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
    return out


class ByteLevel:
    """Byte-level BPE by rank tables; ``encode`` gives the byte places where tokens end."""

    blanks = b" \t\n\r"

    def __init__(self, ranks: dict[bytes, int], special: dict[str, int]):
        import tiktoken

        self.full = tiktoken.Encoding("full", pat_str=_GPT2, mergeable_ranks=ranks, special_tokens=special)
        # without two white-space characters in a row the look-ahead changes nothing, and its absence is faster
        self.fast = tiktoken.Encoding("fast", pat_str=_GPT2.replace(r"\s+(?!\S)|", ""), mergeable_ranks=ranks, special_tokens=special)
        self.bytes = np.zeros(max([*ranks.values(), *special.values()]) + 1, np.int64)
        for x, i in ranks.items():
            self.bytes[i] = len(x)
        for x, i in special.items():
            self.bytes[i] = len(x.encode())
        # every alternative of the pattern is white space only, or begins with at most one space: no pre-token has it after something else
        self.chunked = not any(re.search(r"\s", x) for x in special)

    def ids(self, text: str) -> np.ndarray:
        return (self.full if _PAIR.search(text) else self.fast).encode_to_numpy(text, allowed_special="all")

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        i = self.ids(text)
        return i, np.cumsum(self.bytes[i])


class Library:
    """A .json file through tokenizers, always whole."""

    blanks, chunked = b"", False

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        self.t.no_truncation()
        self.t.no_padding()

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.t.encode(text, add_special_tokens=False).ids, np.uint32)


class Pieces:
    """A sentencepiece model; chunked if it keeps the text as it is and no piece has a word end inside."""

    blanks = b" "

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        inner = re.compile("[^▁]▁")
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        probe = " a  b\nÅẛ̣ "
        self.chunked = not any(inner.search(p) for p in pieces) and self.sp.normalize(probe).lstrip("▁") == probe.replace(" ", "▁").lstrip("▁")

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.sp.encode(text), np.uint32)

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        p = self.sp.encode(text, return_type="proto").pieces
        return np.array([x.id for x in p], np.uint32), np.array([x.end for x in p], np.int64)


@cache
def codec(name: str):
    """The encoder of a public vocabulary file, by name or by path."""
    path = name if "/" in name else public_tokenizers.path(name)
    if path.endswith(".model"):
        return Pieces(path)
    with open(path, encoding="utf-8") as f:
        j = json.load(f)
    m, pre, extra = j["model"], j.get("pre_tokenizer") or {}, j.get("added_tokens") or []
    plain = m.get("type") == "BPE" and j.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
    plain = plain and not any(m.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    plain = plain and not any(x[k] for x in extra for k in ("single_word", "lstrip", "rstrip"))
    if plain:
        abc = _byte_alphabet()
        special = {x["content"]: x["id"] for x in extra}
        ranks = {bytes(abc[c] for c in x): i for x, i in m["vocab"].items() if x not in special}
        pairs = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in m["merges"]]
        if all(m["vocab"].get(a + b) == 256 + k for k, (a, b) in enumerate(pairs)) and sorted(i for x, i in ranks.items() if len(x) == 1) == list(range(256)):
            return ByteLevel(ranks, special)
    return Library(path)


def stable(data: bytes, at: int, blanks: bytes) -> bool:
    """Whether white space follows something else at this byte place."""
    if not 0 < at < len(data) or data[at] not in blanks:
        return False
    k = at - 1
    while k and data[k] & 0xC0 == 0x80:
        k -= 1
    before = data[k:at].decode("utf-8", "replace")
    return not before.isspace() and before != "▁"


def _char_start(data: bytes, at: int) -> int:
    while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
        at -= 1
    return at


def encode_long(c, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> np.ndarray:
    """Ids of a text by overlapping chunks; equal to encoding it whole."""
    data = text.encode()
    if len(data) <= chunk or not c.chunked:
        return c.ids(text)
    out: list[np.ndarray] = []
    cut, begin, end = -1, 0, _char_start(data, chunk)  # ids up to ``cut`` are in ``out``
    ids, ends = c.encode(data[begin:end].decode())
    ends = ends + begin
    while end < len(data):
        wide = overlap
        while True:
            start = _char_start(data, max(begin, end - wide))
            if start <= begin:  # no place in the whole chunk: make the chunk itself longer
                end = _char_start(data, min(len(data), end + max(chunk, end - begin)))
                ids, ends = c.encode(data[begin:end].decode())
                ends = ends + begin
                at = None
                break
            stop = _char_start(data, min(len(data), start + max(chunk, 2 * wide)))
            ids2, ends2 = c.encode(data[start:stop].decode())
            ends2 = ends2 + start
            both = np.intersect1d(ends[(ends > max(start, cut)) & (ends < end)], ends2)
            at = next((int(x) for x in both if stable(data, int(x), c.blanks)), None)
            if at is not None:
                break
            wide *= 2
        if at is None:
            continue
        out.append(ids[(ends > cut) & (ends <= at)])
        cut, begin, end, ids, ends = at, start, stop, ids2, ends2
    out.append(ids[ends > cut])
    return np.concatenate(out)


def ids_of(c, text: str | None) -> np.ndarray:
    return encode_long(c, text or "")


def counts(df: DataFrame, id_col: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k.json", limit: int = 1024) -> DataFrame:
    """Per row: id, n_bytes, n_tokens, over_limit; map-only."""
    kind = df.select(F.col(f"`{id_col}`")).schema[0].dataType.simpleString()

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer)
        for b in it:
            t = b.column(1)
            for i, j in runs(t):
                texts = [x or "" for x in t.slice(i, j - i).to_pylist()]
                n = np.array([len(ids_of(c, x)) for x in texts], np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array([len(x.encode()) for x in texts], pa.int64()), pa.array(n), pa.array(n > limit)], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    return df.select(F.col(f"`{id_col}`"), F.col(f"`{text}`").cast("string").alias("__text")).mapInArrow(work, f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts(common.documents(spark, sf_dir))
