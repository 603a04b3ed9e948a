import random
import re

import numpy as np
import pytest

from lumenframe.llm import graph, jaccard


def shingles(t, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute(rows, n, num, den):
    s = {i: shingles(t, n) for i, t in rows}
    link = {i: {j for j in s if j != i and s[i] and s[j] and den * len(s[i] & s[j]) >= num * len(s[i] | s[j])} for i in s}
    out = {}
    for i in s:
        seen, todo = {i}, [i]
        while todo:
            for j in link[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out[i] = (len(s[i]), len(link[i]), min(seen))
    return out


def corpus(seed, vocab, docs):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(vocab)]
    base = [[r.choice(words) for _ in range(r.choice([1, 3, 8, 30, 90]))] for _ in range(max(3, docs // 8))]
    rows = []
    for i in range(docs):
        w = list(r.choice(base))
        for _ in range(int(len(w) * r.choice([0, 0, 0.05, 0.15, 0.3]))):
            w[r.randrange(len(w))] = r.choice(words)
        if r.random() < 0.2:
            w += [r.choice(words) for _ in range(len(w) // 3)]
        rows.append((i * 2 + 1, " ".join(x.upper() if r.random() < 0.1 else x for x in w)))
    return [*rows, (2, None), (4, ""), (6, " \n"), (8, "lone"), (10, "LONE"), (12, "lone word")]


@pytest.mark.parametrize("seed,vocab,docs,low,hot,run", [(1, 4, 150, 64, 256, 4096), (2, 300, 250, 64, 256, 4096), (3, 12, 200, 2, 8, 4), (4, 40, 200, 1, 4, 8)])
def test_matches_brute_force(spark, monkeypatch, seed, vocab, docs, low, hot, run):
    """Small tiers, hot lists and runs bring every kind of segment and block into play."""
    monkeypatch.setattr(jaccard, "HOT_LEAST", hot)
    monkeypatch.setattr(jaccard, "RUN", run)
    rows = corpus(seed, vocab, docs)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.n_similar, r.component_id) for r in jaccard.near_duplicates(df, num=60).collect()}
    assert got == brute(rows, 2, 60, 100)


def test_signatures_meet_for_every_linked_pair():
    """The pigeonhole argument itself, with every tier forced."""
    r = np.random.default_rng(5)
    for low in (1, 3, 64):
        jaccard.LOW_DF, keep = low, jaccard.LOW_DF
        try:
            for _ in range(400):
                n = int(r.integers(2, 120))
                pool = np.sort(r.choice(1 << 40, 2 * n, replace=False).astype(np.uint64) << np.uint64(8))
                tiers = r.integers(0, 12, 2 * n).astype("u1")
                a = r.permutation(2 * n)[:n]
                b = np.unique(np.concatenate([r.permutation(a)[: int(n * r.uniform(0.7, 1))], r.permutation(2 * n)[: int(n * r.uniform(0, 0.3))]]))
                both = len(np.intersect1d(a, b))
                if 100 * both < 60 * (len(a) + len(b) - both):
                    continue
                tiers[np.intersect1d(a, b)] = np.maximum(tiers[np.intersect1d(a, b)], 1)
                sig = [jaccard.signatures(pool[x][tiers[x] > 0], tiers[x][tiers[x] > 0], len(x), 60, 100) for x in (a, b)]
                lone = [int((tiers[x] == 0).sum()) for x in (a, b)]
                total = len(a) + len(b)
                most, share = 40 * total // 160 - sum(lone), -(-60 * total // 160)
                met = False
                shared, i, j = np.intersect1d(sig[0][0], sig[1][0], return_indices=True)
                for x, y in zip(sig[0][1][i], sig[1][1][j], strict=True):
                    lim = (most, most) if x & 1 else (len(a) - share - lone[0], len(b) - share - lone[1])
                    met |= most >= 0 and x // 2 <= lim[0] and y // 2 <= lim[1]
                assert met
        finally:
            jaccard.LOW_DF = keep


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(1000 + k, 1001 + k) for k in range(60)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        parent[max(a, b)] = min(a, b)
    got = {x.node: x.root for x in graph.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {x: find(x) for u, v in edges if u != v for x in (u, v)}
    assert graph.components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_empty_and_repeated_rows(spark):
    df = spark.createDataFrame([(7, "a b c", 1), (7, "a b c", 2), (9, "a b c", 3)], "doc_id bigint, text string, id int")
    assert sorted(map(tuple, jaccard.near_duplicates(df).collect())) == [(7, 2, 2, 7), (7, 2, 2, 7), (9, 2, 2, 7)]
    assert jaccard.near_duplicates(df.limit(0)).count() == 0
    none = spark.createDataFrame([(None, "a b c"), (None, "x y"), (4, "a b c")], "doc_id bigint, text string")
    assert sorted(map(repr, map(tuple, jaccard.near_duplicates(none).collect()))) == sorted(map(repr, [(None, 2, 0, None), (None, 1, 0, None), (4, 2, 0, 4)]))


def test_representatives_of_rows_that_share_ids(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(30)) for x in "abc")
    rows = [(1, a, "p"), (1, b, "q"), (1, a, "r"), (2, a + " tail", "s"), (3, c, "t"), (3, b, "u"), (4, None, "v"), (4, "", "w"), (None, a, "x"), (None, a, "y")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, key string")
    got = sorted(r["key"] for r in jaccard.keep_representatives(df).collect())
    assert got in (["p", "q", "t", "v", "w", "x", "y"], ["q", "r", "t", "v", "w", "x", "y"])
    assert jaccard.keep_representatives(df).columns == df.columns
    unique = spark.createDataFrame([(5, a, "p"), (6, a, "q"), (7, b, "r"), (8, "", "s")], "doc_id bigint, text string, root string")
    assert sorted(r.doc_id for r in jaccard.keep_representatives(unique).collect()) == [5, 7, 8]
    assert jaccard.keep_representatives(unique.limit(0)).count() == 0


def test_large_family_of_different_texts(spark, monkeypatch):
    """Every two of many different near texts link, and their keys are compared in blocks."""
    monkeypatch.setattr(jaccard, "RUN", 64)
    base = [f"w{k}" for k in range(120)]
    rows = [(i, " ".join(base[: i % 100 + 10] + [f"x{i}"] + base[i % 100 + 10 :])) for i in range(600)]
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect()
    assert {(r.n_similar, r.component_id) for r in got} == {(599, 0)}


@pytest.mark.parametrize("seed,vocab,docs,centres,block,run", [(3, 12, 200, 3, 5, 4), (4, 40, 250, 4096, 5, 8)])
def test_families_match_brute_force(spark, monkeypatch, seed, vocab, docs, centres, block, run):
    """Families of a few sets, fewer centres than families, links counted in several blocks, ids that repeat with the same and other texts."""
    for name, value in (("KIN_LEAST", 3), ("CENTRES", centres), ("KIN_BLOCK", block), ("RUN", run), ("HOT_LEAST", 4)):
        monkeypatch.setattr(jaccard, name, value)
    rows = corpus(seed, vocab, docs)
    rows += [(i, t) for i, t in rows[:40] if t] + [(rows[0][0], rows[30][1]), (rows[1][0], rows[31][1])]
    want = brute([(k, t) for k, (_, t) in enumerate(rows)], 2, 60, 100)
    least = {}
    for k, (_, _, c) in want.items():
        least[c] = min(least.get(c, 10**9), rows[k][0])
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = [(r.doc_id, r.n_shingles, r.n_similar, r.component_id) for r in jaccard.near_duplicates(df, num=60).collect()]
    assert sorted(got) == sorted((rows[k][0], a, b, least[c]) for k, (a, b, c) in want.items())


def test_kin_counts_every_link():
    """Sets at all distances from the centre, against all pairs."""
    r = np.random.default_rng(2)
    for num, den in ((60, 100), (1, 2), (9, 10)):
        pool = np.sort(r.choice(1 << 40, 400, replace=False).astype(np.uint64))
        centre = pool[::2]
        kin = jaccard._Kin([centre], num, den)
        sets = [np.sort(np.concatenate([r.permutation(centre)[: int(200 * r.uniform(0.5, 1))], r.permutation(pool[1::2])[: r.integers(0, 60)]])) for _ in range(300)]
        sets = [s for s in sets if den * len(np.intersect1d(s, centre)) >= num * len(np.union1d(s, centre))]
        key, copies = np.arange(len(sets)) * 7 - 50, r.integers(1, 4, len(sets))
        for cut in (1, 4):
            got = dict.fromkeys(key.tolist(), 0)
            for block in range(cut):
                for k, c in zip(*kin.counts(key, copies, np.array([len(s) for s in sets]), [np.setxor1d(s, centre) for s in sets], block, cut), strict=True):
                    got[int(k)] += int(c)
            links = [[den * len(np.intersect1d(a, b)) >= num * len(np.union1d(a, b)) for b in sets] for a in sets]
            assert list(got.values()) == [sum(int(copies[j]) for j in range(len(sets)) if links[i][j] and j != i) for i in range(len(sets))]


def test_pairs_of_a_large_family_are_not_enumerated(spark, monkeypatch):
    """300 different near texts have 44,850 links; they are counted without a pair to verify, and none is lost."""
    met = []
    whole = jaccard._verified
    monkeypatch.setattr(jaccard, "_verified", lambda docs, classes, pairs, *rest: met.append(pairs.count()) or whole(docs, classes, pairs, *rest))
    base = [f"w{k}" for k in range(300)]
    rows = [(i, " ".join(base[: i % 100 + 10] + [f"x{i}"] + base[i % 100 + 10 :])) for i in range(300)]
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()
    assert {(r.n_similar, r.component_id) for r in got} == {(299, 0)}
    assert met[0] < 3000
