import random
import re

import pytest

from lumenframe.llm import linedup


def edits(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        p, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            p, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, p + (x != y))
    return d[-1]


def brute(rows, min_words, edit_words):
    lines = []
    for i, t in rows:
        for k, x in enumerate((t or "").split("\n") if t else []):
            w = [y.lower() for y in re.findall(r"[^\x20\x09-\x0D]+", x)]
            lines.append(((i, k), w))
    lines.sort()
    out = {}
    for n, (at, w) in enumerate(lines):
        out.setdefault(at[0], set())
        if len(w) < min_words:
            continue
        for _, v in lines[:n]:
            if v == w or (max(len(v), len(w)) >= edit_words and len(v) >= min_words and edits(v, w) <= 1):
                out[at[0]].add(at[1])
                break
    return out


def corpus():
    r = random.Random(5)
    vocab = ["a", "b", "Cé", "dd", "e"]
    base = [[r.choice(vocab) for _ in range(r.randint(1, 14))] for _ in range(12)]
    rows = []
    for i in range(60):
        text = []
        for _ in range(r.randint(1, 5)):
            w = list(r.choice(base))
            for _ in range(r.choice([0, 0, 1, 1, 2])):
                op, at = r.randint(0, 2), r.randrange(len(w))
                if op == 0:
                    w[at] = r.choice(vocab)
                elif op == 1:
                    w.insert(at, r.choice(vocab))
                elif len(w) > 1:
                    del w[at]
            text.append(r.choice([" ", "  "]).join(w))
        rows.append((i * 3, "\n".join(text)))
    return [*rows, (1, None), (2, ""), (4, "\n\n"), (5, " ")]


@pytest.mark.parametrize("lookup", [1_000_000, 0])
def test_matches_brute_force(spark, lookup):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = {r.d: {x.line for x in r.gone} for r in linedup.removals(df, min_words=3, edit_words=6, lookup_keys=lookup).collect()}
    want = {k: v for k, v in brute(rows, 3, 6).items() if v}
    assert got == want


def test_rebuilds_texts_and_keeps_other_columns(spark):
    rows = [(1, "one two three four five\nkeep me please now ok", "x", 7), (2, "ONE two  three four five", "y", None), (3, None, None, 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, d string, gone int")
    got = {r.doc_id: tuple(r) for r in linedup.dedup_lines(df).collect()}
    assert got == {1: rows[0], 2: (2, "", "y", None), 3: rows[2]}
    assert {r.doc_id for r in linedup.dedup_lines(df, drop_empty=True).collect()} == {1, 3}


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert linedup.dedup_lines(df).collect() == []


def brute_bound(rows, edit_words, every):
    lines = sorted(((i, k), x.split()) for i, t in rows for k, x in enumerate(t.split("\n")))
    out = {}
    for n, (at, w) in enumerate(lines):
        for _, v in lines[:n]:
            m = max(len(v), len(w))
            if v == w or (m >= edit_words and edits(v, w) <= max(1, m // every)):
                out.setdefault(at[0], set()).add(at[1])
                break
    return out


@pytest.mark.parametrize("lookup", [1_000_000, 0])
@pytest.mark.parametrize("every", [4, 20])
def test_bound_grows_with_the_line(spark, lookup, every):
    r = random.Random(7)
    base = [[r.choice(["a", "a", "b", "c", f"w{r.randint(0, 30)}"]) for _ in range(r.randint(3, 90))] for _ in range(9)] + [["a"] * 60]
    rows = []
    for i in range(70):
        w = list(r.choice(base))
        for _ in range(r.randint(0, max(2, len(w) // every + 1))):
            at = r.randrange(len(w))
            w[at : at + r.randint(0, 1)] = [] if r.random() < 0.3 and len(w) > 3 else [r.choice(["a", "b", f"w{r.randint(0, 30)}"])]
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = {x.d: {y.line for y in x.gone} for x in linedup.removals(df, min_words=1, edit_words=10, lookup_keys=lookup, edit_every=every).collect()}
    assert got == brute_bound(rows, 10, every)


def test_two_edits_in_a_long_line_by_default(spark):
    w = [f"w{k}" for k in range(80)]
    v = [*w[:20], "x", *w[21:60], "y", *w[60:]]
    df = spark.createDataFrame([(1, " ".join(w)), (2, " ".join(v))], "doc_id bigint, text string")
    assert [x.d for x in linedup.removals(df).collect()] == [2]


def test_within_is_the_edit_distance():
    r = random.Random(3)
    a = [linedup.np.array([r.randint(0, 2) for _ in range(r.randint(0, 9))], "u8") for _ in range(300)]
    b = [linedup.np.array([r.randint(0, 2) for _ in range(r.randint(0, 9))], "u8") for _ in range(300)]
    for k in range(5):
        assert linedup.within(a, b, k).tolist() == [edits(list(x), list(y)) <= k for x, y in zip(a, b, strict=True)]


def test_short_lines_repeat_exactly(spark):
    rows = [(1, "Read more\n\nok"), (2, "read  MORE\nread less"), (3, "\nok\n ")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {x.d: [y.line for y in x.gone] for x in linedup.removals(df).collect()} == {2: [0], 3: [1]}


def near_copies(n=60):
    r = random.Random(11)
    base = [[f"w{r.randint(0, 400)}" for _ in range(r.randint(45, 130))] for _ in range(6)]
    rows = []
    for i in range(n):
        w = list(r.choice(base))
        for _ in range(r.randint(0, len(w) // 20 + 1)):
            w[r.randrange(len(w))] = r.choice(["x", "y"])
        rows.append((i, " ".join(w)))
    return rows


def test_windows_are_packed(spark):
    df = spark.createDataFrame(near_copies(), "id bigint, text string").repartition(3)
    found = linedup._second_side(linedup._first_side(df, 4, 1, 10, 20))
    rec = linedup._looked_up(df, found, 4, 1, 10, 20).where("kind >= 4")
    packed = [linedup.blobs.unpack(x.bins) for x in rec.collect() if len(x.bins) != linedup.BINS]
    records = sum(len(x[0]) for x in packed)
    assert records > 200 and rec.count() <= 3 * 4  # one row a task and range of keys, however many windows


@pytest.mark.parametrize("lookup", [1_000_000, 100, 0])
def test_windows_found_either_way(spark, lookup):
    rows = near_copies()
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = {x.d: {y.line for y in x.gone} for x in linedup.removals(df, lookup_keys=lookup).collect()}
    assert got == brute_bound(rows, 10, 20)


def test_picked_lines():
    texts = ["a b\n\n c é\n", None, "", "one", "\n", "x\ny"]
    at = [(d, k) for d in range(len(texts)) for k in range(-1, 6)]
    doc, line = (linedup.np.array(x) for x in zip(*at, strict=True))
    for skip in (0, 2):  # an array that begins within another
        t = linedup.pa.array(["zz\n"] * skip + texts).slice(skip)
        got, some = linedup._picked(t, doc, line)
        want = [(d, k, x) for d, t in enumerate(texts) for k, x in enumerate(t.split("\n") if t else [])]
        assert [(*at[i], x.decode()) for i, x in zip(some.tolist(), got.to_pylist(), strict=True)] == want
        full = linedup.Lines(got, whole=True).full.tolist()
        assert full == [int(linedup.Lines(linedup.pa.array([x + "\n"])).full[0]) for _, _, x in want]


def test_within_in_long_lines():
    r = random.Random(4)
    a, b = [], []
    for _ in range(60):
        x = [r.randint(0, 30) for _ in range(r.randint(1, 220))]
        y = list(x)
        for _ in range(r.randint(0, 6)):
            i = r.randrange(len(y) + 1)
            y[i : i + r.randint(0, 1)] = [r.randint(0, 30)] * r.randint(0, 1)
        a.append(x)
        b.append(y)
    u = [[linedup.np.array(x, "u8") for x in s] for s in (a, b)]
    for k in (0, 1, 2, 4, 6):
        assert linedup.within(*u, k).tolist() == [edits(x, y) <= k for x, y in zip(a, b, strict=True)]


def test_key_lookup_equals_search():
    r = linedup.np.random.default_rng(2)
    for n in (0, 1, 5000):
        keys = linedup.np.sort(r.integers(0, 1 << 63, n, dtype="u8") * linedup._U(2))
        x = linedup.np.concatenate([keys[::3], r.integers(0, 1 << 63, 3000, dtype="u8"), linedup.np.array([0, (1 << 64) - 1], "u8")])
        assert (linedup._Keys(keys).has(x) == linedup.np.isin(x, keys)).all()
