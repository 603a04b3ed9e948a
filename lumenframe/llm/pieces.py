"""SentencePiece encoding and decoding by a streaming Viterbi search.

The lattice of a text has a place before every character and an edge for every piece.
``Stream`` keeps the best edge into each place of a window as wide as the longest piece,
and commits ids as soon as all surviving backpointer paths meet in one boundary, so a
text of any length needs memory only for its unresolved end.

* Unigram models: the path of the highest score, in single precision, the longer piece
  on a tie, as the library has it.
* BPE models: scores of single pieces do not add up to what merging does.  An edge is
  allowed only if merging the previous piece and its own gives just these two; every
  place then has exactly one allowed path, which is the merge result of its prefix.

Every text goes through one stream.  Where no piece spans a word start (this is checked when
a model is loaded), all paths meet there and the stream commits its window; the ids between
two such boundaries are remembered in tables of bounded memory.
Unknown characters become byte pieces if the model has them, else the unknown id.

Defined cases: null and empty texts have no ids; ids out of range raise; byte pieces
that aren't UTF-8 decode to U+FFFD.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm import common
from lumenframe.llm.textvec import runs

MEMO_BYTES = 224 << 20  # about this much memory holds segments met before, and a third of it pairs of pieces
_ENTRY = 200  # bytes of an entry besides its characters and ids
_SEGMENT = re.compile("▁+[^▁]*|[^▁]+")


def _fields(b: bytes) -> Iterator[tuple[int, int, object]]:
    """Fields of a protocol buffer message."""
    i = 0

    def number() -> int:
        nonlocal i
        v = s = 0
        while True:
            x = b[i]
            i += 1
            v |= (x & 127) << s
            s += 7
            if x < 128:
                return v

    while i < len(b):
        k = number()
        f, w = k >> 3, k & 7
        if w == 0:
            yield f, w, number()
        elif w == 2:
            n = number()
            yield f, w, b[i : i + n]
            i += n
        else:
            n = 4 if w == 5 else 8
            yield f, w, b[i : i + n]
            i += n


class Model:
    """Pieces of a model file, and the lattice rules of its kind."""

    NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6

    def __init__(self, proto: bytes):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=proto)  # for its normaliser only
        self.text: list[str] = []
        self.kind: list[int] = []
        self.score: list[np.float32] = []
        self.bpe, self.dummy, self.squeeze, rule = False, True, True, b""
        for f, _, v in _fields(proto):
            if f == 1:
                piece, kind, score = "", 1, np.float32(0)
                for g, _, x in _fields(v):
                    if g == 1:
                        piece = x.decode()
                    elif g == 2:
                        score = np.frombuffer(x, "<f4")[0]
                    elif g == 3:
                        kind = x
                self.text.append(piece)
                self.kind.append(kind)
                self.score.append(score)
            elif f == 2:
                self.bpe = any(g == 3 and x == 2 for g, _, x in _fields(v))
                if any(g == 3 and x in (3, 4) for g, _, x in _fields(v)):
                    raise ValueError("only unigram and BPE models have a piece lattice")
            elif f == 3:
                for g, _, x in _fields(v):
                    if g == 2:
                        rule = x
                    elif g == 3:
                        self.dummy = bool(x)
                    elif g == 4:
                        self.squeeze = bool(x)
        self.identity = not rule and not self.squeeze
        self.id = {t: i for i, (t, k) in enumerate(zip(self.text, self.kind, strict=True)) if k in (self.NORMAL, self.USER)}
        if any(k == self.USER for k in self.kind):
            raise ValueError("user-defined pieces are not supported")
        self.byte = {int(t[3:5], 16): i for i, (t, k) in enumerate(zip(self.text, self.kind, strict=True)) if k == self.BYTE}
        self.unknown = self.kind.index(self.UNKNOWN)
        self.longest = max(map(len, self.id))
        self.apart = not any(re.search("[^▁]▁", t) for t in self.id)
        normal = [self.score[i] for i in self.id.values()]
        self.penalty = np.float32(min(normal) - np.float32(10))
        self.raw = [bytes([int(t[3:5], 16)]) if k == self.BYTE else b"" if k == self.CONTROL else " ⁇ ".encode() if k == self.UNKNOWN else t.replace("▁", " ").encode() for t, k in zip(self.text, self.kind, strict=True)]
        self.flat = np.frombuffer(b"".join(self.raw), np.uint8)
        self.sizes = np.array([len(x) for x in self.raw], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.after: dict[str, dict[str, bool]] = {}  # whether the second piece may follow the first
        self.pairs = 0
        self.known: dict[str, bytes] = {}  # segments met lately, and those met before them
        self.older: dict[str, bytes] = {}
        self.size = 0

    def remember(self, segment: str, ids: bytes) -> None:
        if len(segment) <= 64:
            self.known[segment] = ids
            self.size += _ENTRY + len(segment) + len(ids)
            if self.size > MEMO_BYTES // 2:
                self.older, self.size = dict(self.known), 0
                self.known.clear()

    def recall(self, segment: str) -> bytes | None:
        ids = self.known.get(segment)
        if ids is None:
            ids = self.older.get(segment)
            if ids is not None:
                self.remember(segment, ids)
        return ids

    def merge(self, text: str) -> list[str]:
        """Merges by rank, the leftmost of the best pair first."""
        s = list(text)
        while True:
            best, at = None, -1
            for k in range(len(s) - 1):
                i = self.id.get(s[k] + s[k + 1])
                if i is not None and (best is None or self.score[i] > best):
                    best, at = self.score[i], k
            if best is None:
                return s
            s[at : at + 2] = [s[at] + s[at + 1]]

    def follows(self, before: str) -> dict[str, bool]:
        x = self.after.get(before)
        if x is None:
            x = self.after[before] = {}
        return x

    def allowed(self, before: str, piece: str) -> bool:
        self.pairs += 1
        if self.pairs * _ENTRY > MEMO_BYTES // 3:
            self.after.clear()
            self.pairs = 0
        x = self.follows(before)[piece] = self.merge(before + piece) == ([before, piece] if before else [piece])
        return x

    def ids(self, piece: str) -> list[int]:
        i = self.id.get(piece)
        if i is not None:
            return [i]
        return [self.byte[b] for b in piece.encode()] if len(self.byte) == 256 else [self.unknown]


class Stream:
    """Feeds characters and commits ids, as bytes; ``finish`` gives the rest.

    A word start ends every surviving path, as no piece spans it: there the whole window is
    committed at once.  Within a word the paths are followed back to the boundary they share.
    """

    def __init__(self, model: Model):
        self.m = model
        self.most = self.commits = 0  # greatest window and number of commits so far
        self._restart()

    def _restart(self) -> None:
        self.window = ""  # characters from the last committed boundary on
        self.back: list[int] = [0]  # start of the best edge into each place; the first is the boundary
        self.best: list[np.float32 | None] = [np.float32(0)]
        self.next = [self.m.follows("")]  # of each place, what may follow its piece
        self.last = [""]  # piece of that edge, and before the boundary the last committed piece
        self.cut = False  # whether part of the word is committed

    def feed(self, text: str) -> list[int]:
        return np.frombuffer(self.put(text), "<u4").tolist()

    def finish(self) -> list[int]:
        return np.frombuffer(self.end(), "<u4").tolist()

    def put(self, text: str) -> bytes:
        """Ids, as bytes, that are sure now."""
        if not self.m.apart:
            return self._word(text)
        words = _SEGMENT.findall(text)
        if not words:
            return b""
        out = []
        if self.window and words[0][0] == "▁" and self.window[-1] != "▁":
            out.append(self.end())
        if self.window and len(words) > 1:
            out += [self._word(words.pop(0)), self.end()]
        known, older = self.m.known.get, self.m.older.get
        for x in words[:-1]:  # whole words; the last may go on
            ids = known(x)
            if ids is None:
                ids = older(x)
                if ids is None:
                    ids = self._word(x) + self.end()
                else:
                    self.m.remember(x, ids)
                older = self.m.older.get
            out.append(ids)
        self.commits += len(words) - 1
        out.append(self._word(words[-1]))
        return b"".join(out)

    def end(self) -> bytes:
        """The ids of the window: all paths pass its end."""
        if not self.window:
            return b""
        ids = self._path(len(self.window))
        self.commits += 1
        if self.m.apart and not self.cut:
            self.m.remember(self.window, ids)
        self._restart()
        return ids

    def _word(self, text: str) -> bytes:
        step = 2 * self.m.longest
        extend = self._extend_bpe if self.m.bpe else self._extend_unigram
        if len(self.window) + len(text) <= step:
            extend(text)
            return b""
        out = []
        for k in range(0, len(text), step):
            extend(text[k : k + step])
            if len(self.window) > step:
                out.append(self._commit())
        return b"".join(out)

    def _extend_bpe(self, text: str) -> None:
        m, back, last, after = self.m, self.back, self.last, self.next
        longest, have, follows = m.longest, m.id, m.follows
        first = len(self.window)
        self.window = x = self.window + text
        self.most = max(self.most, len(x))
        for i in range(first + 1, len(x) + 1):
            # just one edge is allowed, so the order of trying does not matter; it is mostly short
            for j in range(i - 1, i - longest - 1 if i > longest else -1, -1):
                t = x[j:i]
                ok = after[j].get(t)
                if ok is None:
                    ok = (t in have or j == i - 1) and m.allowed(last[j], t)
                if ok and back[j] >= 0:
                    back.append(j)
                    last.append(t)
                    after.append(follows(t))
                    break
            else:
                raise AssertionError("a prefix without a path")

    def _extend_unigram(self, text: str) -> None:
        m = self.m
        first = len(self.window)
        self.window += text
        self.most = max(self.most, len(self.window))
        for i in range(first + 1, len(self.window) + 1):
            start, score, piece = -1, None, ""
            for j in range(max(0, i - m.longest), i):
                t = self.window[j:i]
                k = m.id.get(t)
                if self.best[j] is not None and (k is not None or j == i - 1):
                    s = np.float32(self.best[j] + (m.score[k] if k is not None else m.penalty))
                    if score is None or s > score:
                        start, score, piece = j, s, t
            self.back.append(start)
            self.best.append(score)
            self.last.append(piece)

    def _commit(self) -> bytes:
        """Ids up to the one boundary through which every path that can go on passes."""
        n = len(self.window)
        live = {j for j in range(max(0, n - self.m.longest + 1), n + 1) if self.back[j] >= 0}
        while len(live) > 1:
            x = max(live)
            live.remove(x)
            live.add(self.back[x])
        at = live.pop()
        if not at:
            return b""
        out = self._path(at)
        last = self.last[at]
        self.commits += 1
        self.cut = True
        self.window = self.window[at:]
        self.back = [0] + [b - at for b in self.back[at + 1 :]]
        # edges from before the boundary lead to places that no path uses any more
        if not self.m.bpe:
            self.best = [b if k == 0 or self.back[k] >= 0 else None for k, b in enumerate(self.best[at:])]
        self.last = [last, *self.last[at + 1 :]]
        self.next = self.next[at:]
        return out

    def _path(self, at: int) -> bytes:
        back, last, have = self.back, self.last, self.m.id
        pieces = []
        while at:
            pieces.append(last[at])
            at = back[at]
        out = []
        for p in reversed(pieces):
            i = have.get(p)
            if i is None:
                out += self.m.ids(p)
            else:
                out.append(i)
        return struct.pack(f"<{len(out)}I", *out)


def normalized(m: Model, text: str) -> str:
    if not m.identity:
        return m.library.normalize(text)
    return ("▁" if m.dummy and text else "") + text.replace(" ", "▁")


def _fused(m: Model, ids: list[int]) -> list[int]:
    """Unknown ids in a row are one."""
    return [i for k, i in enumerate(ids) if i != m.unknown or not k or ids[k - 1] != m.unknown]


def encode(m: Model, text: str | None) -> bytes:
    """Ids of a text as little-endian unsigned 32-bit numbers."""
    if not text:
        return b""
    s = Stream(m)
    ids = s.put(normalized(m, text)) + s.end()
    if len(m.byte) != 256:
        return np.array(_fused(m, np.frombuffer(ids, "<u4").tolist()), "<u4").tobytes()
    return ids


def decode(m: Model, ids: bytes) -> str:
    """Text of ids; the blank that encoding put in front is taken away."""
    n = np.frombuffer(ids, "<u4")
    if len(n) and int(n.max()) >= len(m.text):
        raise ValueError("id out of range")
    size = m.sizes[n]
    begin = np.cumsum(size) - size
    data = m.flat[np.repeat(m.starts[n] - begin, size) + np.arange(int(size.sum()))].tobytes()
    if m.dummy and data[:1] == b" ":
        data = data[1:]
    return data.decode("utf-8", "replace")


@cache
def model(name: str) -> Model:
    path = name if "/" in name else public_tokenizers.path(name)
    with open(path, "rb") as f:
        return Model(f.read())


def encoded(df: DataFrame, id_col: str = "doc_id", text: str = "text", tokenizer: str = "piece_bpe_32k.model") -> DataFrame:
    """Per row: id, ids (array of int); map-only."""
    kind = df.select(F.col(f"`{id_col}`")).schema[0].dataType.simpleString()

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(tokenizer)
        for b in it:
            for i, j in runs(b.column(1)):
                ids = [np.frombuffer(encode(m, x), "<i4") for x in b.column(1).slice(i, j - i).to_pylist()]
                off = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(ids)))], names=[id_col, "ids"])

    return df.select(F.col(f"`{id_col}`"), F.col(f"`{text}`").cast("string").alias("__text")).mapInArrow(work, f"`{id_col}` {kind}, ids array<int>")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: n_tokens, the ids' CRC-32, and the CRC-32 and equality of the text decoded from them."""
    schema = "doc_id bigint, n_tokens bigint, ids_crc32 bigint, decoded_crc32 bigint, round_trip boolean"

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model("piece_bpe_32k.model")
        for b in it:
            for i, j in runs(b.column(1)):
                out = []
                for x in b.column(1).slice(i, j - i).to_pylist():
                    ids = encode(m, x)
                    back = decode(m, ids)
                    out.append((len(ids) // 4, zlib.crc32(ids), zlib.crc32(back.encode()), back == (x or "")))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), *(pa.array(c, pa.bool_() if isinstance(c[0], bool) else pa.int64()) for c in zip(*out, strict=True))], names=[x.split()[0] for x in schema.split(", ")])

    return common.documents(spark, sf_dir).select("doc_id", "text").mapInArrow(work, schema)
