"""Best-fit packing by bin completion.

Tokenising is one map over the texts that leaves a small table of pieces.  Their lengths
are at most ``capacity``, so the packing problem is a histogram of that many counts
however large the corpus is: it is solved on the driver, and pieces take their places by
rank.  Ranks are a count within each task plus an offset a (task, length), so a length
that a third of all pieces share is spread like any other.

Solver: best-fit decreasing gives the first incumbent, a greedy choice of the fullest filling
the second.  Bin completion then takes the longest remaining piece and tries fillings of its
sequence, of any number of parts, in order of waste, leaving out fillings that another one
dominates (its parts fit into the other's), and applies each as often as the counts allow,
then half as often and so on to once.  A branch ends when its waste rules out beating the
incumbent, which best-fit completions of nodes renew.  It stops at the lower bound of
Martello and Toth or after ``nodes`` nodes, and a node tries NODE_EFFORT lengths; that bounds
the search, not the pieces: the best packing found always holds them all.

Defined cases: a null or empty text is the closing id alone; longer texts are cut, with
the shorter piece first; rows that share an id are packed each on its own.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenframe.llm import common
from lumenframe.llm.textvec import runs
from lumenframe.llm.tokencount import codec, ids_of

CAPACITY, CLOSING, NODES = 2048, 0, 6_000
NODE_EFFORT = 4_000  # lengths tried at a node of the search; a test of dominance counts as DOMINANCE of them
DOMINANCE = 40
COMPLETE_EVERY = 40  # nodes between completions by best fit

Plan = list[tuple[tuple[int, ...], int]]  # lengths in a sequence, and how many sequences have them


def lower_bound(h: np.ndarray, capacity: int) -> int:
    """Least number of sequences for the counts h[length]."""
    n = np.concatenate([[0], np.cumsum(h)])  # n[k]: pieces shorter than k
    w = np.concatenate([[0], np.cumsum(h * np.arange(len(h)))])
    best = -(-int(w[-1]) // capacity)
    half = capacity // 2
    for k in range(1, half + 1):
        big = int(n[capacity + 1] - n[capacity - k + 1])
        mid, mid_w = int(n[capacity - k + 1] - n[half + 1]), int(w[capacity - k + 1] - w[half + 1])
        low_w = int(w[half + 1] - w[k])
        best = max(best, big + mid + max(0, -(-(low_w - (mid * capacity - mid_w)) // capacity)))
    return best


def best_fit(h: np.ndarray, capacity: int) -> Plan:
    """Best-fit decreasing over a histogram."""
    room: dict[int, Counter] = {}
    done: Plan = []
    for s in range(capacity, 0, -1):
        c = int(h[s])
        while c:
            r = min((x for x in room if x >= s), default=None)
            if r is None:
                each = min(capacity // s, c)
                k = c // each
                room.setdefault(capacity - each * s, Counter())[(s,) * each] += k
                c -= k * each
                continue
            p, n = next(iter(room[r].items()))
            each = min(r // s, c)
            k = min(n, c // each)
            room[r][p] -= k
            if not room[r][p]:
                del room[r][p]
            if not room[r]:
                del room[r]
            room.setdefault(r - each * s, Counter())[p + (s,) * each] += k
            c -= k * each
    for x in room.values():
        done += x.items()
    return done


def fullest(room: int, left: list[int], sizes: list[int]) -> list[int]:
    """Available lengths, of any number, whose sum is the greatest that fits the room: subset sums as bits, longest lengths first."""
    reach, steps = 1, []
    every = (2 << room) - 1
    for s in sizes:
        if s > room or not left[s]:
            continue
        steps.append((s, reach))
        copies, k = min(left[s], room // s), 1
        while copies:
            k = min(k, copies)
            reach |= (reach << (s * k)) & every
            copies -= k
            k *= 2
        if reach >> room & 1:
            break
    at, out = reach.bit_length() - 1, []
    for s, before in reversed(steps):
        while not before >> at & 1:
            at -= s
            out.append(s)
    return out


def minimum_slack(h: np.ndarray, capacity: int) -> Plan:
    """Around the longest piece the filling that wastes least, as often as the counts allow, and so on."""
    left = [int(x) for x in h]
    sizes = [s for s in range(capacity, 0, -1) if left[s]]
    done: Plan = []
    while sizes:
        top = sizes[0]
        left[top] -= 1
        f = (top, *fullest(capacity - top, left, sizes))
        left[top] += 1
        need = Counter(f)
        times = min(left[s] // k for s, k in need.items())
        for s, k in need.items():
            left[s] -= k * times
        done.append((f, times))
        sizes = [s for s in sizes if left[s]]
    return done


def _fits(parts: tuple[int, ...], into: tuple[int, ...]) -> bool:
    """Whether parts can be spread over pieces ``into`` used as bins: then ``into`` dominates."""
    if not parts:
        return True
    tried = set()
    for i, b in enumerate(into):
        if b >= parts[0] and b not in tried:
            tried.add(b)
            if _fits(parts[1:], tuple(sorted((*into[:i], *into[i + 1 :], b - parts[0]), reverse=True))):
                return True
    return False


def _exact(total: int, most: int, h: list[int], sizes: list[int], parts: int, effort: list[int]) -> Iterator[tuple[int, ...]]:
    """Multisets of ``parts`` available lengths up to ``most`` that sum to ``total``, longest first, while effort lasts."""
    if parts == 0:
        if total == 0:
            yield ()
        return
    if parts == 1:
        if 0 < total <= most and h[total]:
            yield (total,)
        return
    for s in sizes:
        if s > total or s > most or not h[s]:
            continue
        effort[0] -= 1
        if s * parts < total or effort[0] < 0:
            return
        h[s] -= 1
        try:
            for rest in _exact(total - s, s, h, sizes, parts - 1, effort):
                yield (s, *rest)
        finally:
            h[s] += 1


def fillings(room: int, waste: int, h: list[int], sizes: list[int], effort: int, width: int = 6) -> Iterator[tuple[int, ...]]:
    """Undominated fillings of a room, by waste and then by number of parts, at most ``width`` of a kind.

    If the effort ends before there is one, the fullest is given.
    """
    seen: list[tuple[int, ...]] = []
    left = [effort]
    least = sizes[-1] if sizes else room + 1
    for w in range(min(waste, room) + 1):
        for parts in range((room - w) // least + 1):
            found: list[tuple[int, ...]] = []
            tries = _exact(room - w, room, h, sizes, parts, left)
            for f in tries:
                left[0] -= DOMINANCE * len(seen)
                if not any(_fits(f, g) for g in seen):
                    seen.append(f)
                    found.append(f)
                    if len(found) >= width:
                        break
            tries.close()  # it holds counts while it waits
            yield from found
            if left[0] < 0:
                break
        if left[0] < 0:
            break
    if not seen:
        f = fullest(room, h, sizes)
        if room - sum(f) <= waste:
            yield tuple(f)


def complete(h: np.ndarray, capacity: int, nodes: int = NODES) -> Plan:
    """Bin completion; incumbents are best fit, minimum slack, and best fit of what a node leaves."""
    least = lower_bound(h, capacity)
    total = int((h * np.arange(len(h))).sum())
    best, count = [], -1
    for way in (best_fit, minimum_slack):
        plan = way(h, capacity)
        used = sum(n for _, n in plan)
        if count < 0 or used < count:
            best, count = plan, used
        if count <= least:
            return best
    left = [int(x) for x in h]
    sizes = [s for s in range(capacity, 0, -1) if left[s]]
    stack: list[list] = []  # [fillings, chosen filling or None, times, waste of it, largest, times to try next]
    wasted = used = 0

    def push() -> bool:
        """Opens the next level; false if all pieces are placed."""
        top = next((s for s in sizes if left[s]), 0)
        if not top:
            return False
        left[top] -= 1
        allowed = (count - 1) * capacity - total - wasted
        stack.append([fillings(capacity - top, max(0, allowed), left, [s for s in sizes if s <= capacity - top and left[s]], NODE_EFFORT), None, 0, 0, top, 0])
        left[top] += 1
        return True

    open_ = push()
    while stack and nodes > 0:
        level = stack[-1]
        top = level[4]
        nodes -= 1
        f, times = level[1], level[5]
        if f is not None:  # undo before the next choice
            for s in (top, *f):
                left[s] += level[2]
            used -= level[2]
            wasted -= level[3]
            level[1] = None
        if f is None or not times:
            left[top] -= 1
            f = next(level[0], None)
            left[top] += 1
            if f is None:
                stack.pop()
                continue
            times = min(left[s] // k for s, k in Counter((top, *f)).items())
            if times == 0:
                continue
        need = Counter((top, *f))
        level[5] = times // 2  # the same filling may come again below, so halves reach every number
        level[1], level[2], level[3] = f, times, (capacity - top - sum(f)) * times
        for s, k in need.items():
            left[s] -= k * times
        used += times
        wasted += level[3]
        if total + wasted > (count - 1) * capacity:
            continue
        if nodes % COMPLETE_EVERY == 0:
            rest = best_fit(np.array(left), capacity)
            if used + sum(n for _, n in rest) < count:
                best = [((x[4], *x[1]), x[2]) for x in stack if x[1] is not None] + rest
                count = used + sum(n for _, n in rest)
                if count <= least:
                    break
        open_ = push()
        if not open_ and used < count:
            # every piece is placed
            best, count = [((x[4], *x[1]), x[2]) for x in stack if x[1] is not None], used
            if count <= least:
                break
    return best


def table(plan: Plan) -> dict[str, np.ndarray]:
    """Where the pieces of each length go: length, first rank, first sequence and offset of each run."""
    rank: Counter = Counter()
    rows, seq = [], 0
    for lengths, times in plan:
        at = 0
        for s in lengths:
            rows.append((s, rank[s], seq, at))
            rank[s] += times
            at += s
        seq += times
    a = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return {"key": (a[:, 0] << 44) + a[:, 1], "rank": a[:, 1], "seq": a[:, 2], "at": a[:, 3]}


def pieces(df: DataFrame, id_col: str, text: str, tokenizer: str, capacity: int) -> DataFrame:
    """One row per piece with its rank among the task's pieces of its length."""
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, task int, nth bigint"

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer)
        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for b in it:
            ids = b.column(0).to_pylist()
            for i, j in runs(b.column(1)):
                out = []
                for d, x in zip(ids[i:j], b.column(1).slice(i, j - i).to_pylist(), strict=True):
                    t = np.append(ids_of(c, x), np.uint32(CLOSING)).astype("<u4")
                    n = len(t)
                    cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                    for k in range(len(cuts) - 1):
                        size = cuts[k + 1] - cuts[k]
                        out.append((d, k, cuts[k], size, zlib.crc32(t[cuts[k] : cuts[k + 1]]), task, int(seen[size])))
                        seen[size] += 1
                yield pa.RecordBatch.from_arrays([pa.array(x, ty) for x, ty in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)], names=[x.split()[0] for x in schema.split(", ")])

    return df.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(work, schema)


def pack(df: DataFrame, id_col: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k.json", capacity: int = CAPACITY, nodes: int = NODES) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    p = common.saved(pieces(df, id_col, text, tokenizer, capacity))
    per = common.saved(p.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")))
    h = np.zeros(capacity + 1, np.int64)
    for r in per.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``capacity`` rows
        h[r.length] = r.n
    runs_of = df.sparkSession.sparkContext.broadcast(table(complete(h, capacity, nodes)))
    w = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    first = per.select("length", "task", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
    ranked = p.join(first, ["length", "task"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))

    def place(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = runs_of.value
        for b in it:
            rank = b.column(5).to_numpy()
            at = np.searchsorted(t["key"], (b.column(3).to_numpy() << 44) + rank, "right") - 1
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(t["seq"][at] + rank - t["rank"][at]), pa.array(t["at"][at])], names=[id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, f"`{id_col}` bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.documents(spark, sf_dir))
