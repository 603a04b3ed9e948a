import random
import re
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from lumenframe.llm import langid, packing, quality

VOCAB = {"en": ["the", "house", "river", "walking", "under", "bright", "seven", "children"], "de": ["der", "schön", "straße", "geht", "über", "kinder", "haus", "nächste"], "fr": ["le", "être", "maison", "rivière", "marcher", "où", "garçon", "lumière"]}


def prose(r, lang, n):
    words = [r.choice(VOCAB[lang]) + (r.choice(VOCAB[lang]) if r.random() < 0.5 else "") for _ in range(n)]
    return "\n".join(" ".join(words[k : k + 12]).capitalize() + "." for k in range(0, n, 12))


def corpus(n=240):
    r = random.Random(9)
    rows = []
    for i in range(n):
        lang = r.choice(list(VOCAB))
        rows.append((i, prose(r, lang, r.randint(60, 160)), lang, f"s{i % 2}", 0))
    return rows


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


# --- quality rules ---------------------------------------------------------------------


def plain_stats(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    marked = {i + k for i, x in enumerate(tri) if tri.count(x) > 1 for k in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(marked)


def test_statistics_against_plain_counts():
    r = random.Random(1)
    texts = ["", " \n\t", "a", "é x　y z", "a b c a b c", "x\nx\n\nx \nx", "\n", "a\n"]
    texts += [" ".join(r.choice(["a", "b", "ö#", "c&d", "\n", "\n\n", "|"]) for _ in range(r.randint(1, 60))) for _ in range(80)]
    s = quality.text_stats(pa.array([*texts, None]))
    assert list(zip(*(s[k].tolist() for k in quality.STATS), strict=True)) == [plain_stats(t) for t in [*texts, None]]


def test_chi_square():
    assert quality.chi2_quantile(0.95, 1) == pytest.approx(3.841459, rel=1e-5) and quality.chi2_quantile(0.975, 7) == pytest.approx(16.01276, rel=1e-5)


def test_outliers_go_and_clean_documents_stay(spark):
    rows = corpus()
    r = random.Random(2)
    junk = {1000 + i: " ".join(w + r.choice(["###", "&&&", "$$$"]) for w in prose(r, "en", 90).split()) for i in range(12)}
    shout = {2000 + i: prose(r, "de", 90).upper().replace(" ", "!! ") for i in range(12)}
    bad = {3000: None, 3001: "", 3002: "too short", 3003: "same words again " * 40}
    table = [*rows, *((i, t, "en", "s0", 0) for i, t in junk.items()), *((i, t, "de", None, 0) for i, t in shout.items()), *((i, t, None, "s1", 0) for i, t in bad.items())]
    df = spark.createDataFrame(table, SCHEMA).repartition(3)
    got = {x.doc_id: x for x in quality.quality(df, min_rows=60).collect()}
    assert len(got) == len(table)
    assert [i for i, *_ in rows if not got[i].kept] == []
    assert [i for i in (*junk, *shout, *bad) if got[i].kept] == []
    assert {i for i in bad if got[i].base_failed} == set(bad) and not any(got[i].base_failed for i in junk)
    named = df.withColumnRenamed("n_chars", "kept")
    left = quality.keep_documents(named, min_rows=60)
    assert left.columns == named.columns and {x.doc_id for x in left.collect()} == {i for i, x in got.items() if x.kept}


def test_few_rows_take_the_base_rule(spark):
    df = spark.createDataFrame([(1, prose(random.Random(1), "en", 60), None, None, 0), (2, None, "x", "y", 0)], SCHEMA)
    assert {x.doc_id: (x.kept, x.base_failed) for x in quality.quality(df).collect()} == {1: (True, False), 2: (False, True)}
    assert quality.quality(df.limit(0)).count() == 0


# --- language ID -----------------------------------------------------------------------


def test_probabilities_against_a_plain_kneser_ney():
    """Every stored 4-gram against the textbook recursion on dictionaries."""
    r = random.Random(4)
    key, _, _ = langid.grams(pa.array([prose(r, "en", 200), prose(r, "en", 150)]))
    k, c = np.unique(key, return_counts=True)
    m = langid.Model({"en": (k, c)})
    four = {tuple(int(x) >> s & 63 for s in (18, 12, 6, 0)): int(n) for x, n in zip(k, c, strict=True)}
    levels = {4: four}
    for o in (3, 2, 1):
        levels[o] = {}
        for g in levels[o + 1]:
            levels[o][g[1:]] = levels[o].get(g[1:], 0) + 1

    def p(g):
        if not g:
            return 1 / 64
        t = levels[len(g)]
        one, two = sum(v == 1 for v in t.values()), sum(v == 2 for v in t.values())
        d = one / (one + 2 * two) if one and two else 0.5
        same = [v for h, v in t.items() if h[:-1] == g[:-1]]
        return p(g[1:]) if not same else (max(t.get(g, 0) - d, 0) + d * len(same) * p(g[1:])) / sum(same)

    for g in list(four)[::7]:
        at = np.searchsorted(m.keys, sum(x << s for x, s in zip(g, (18, 12, 6, 0), strict=True)))
        assert 2.0 ** m.logp[at, 0] == pytest.approx(p(g), rel=1e-4)
    unseen = (5, 9, 26, 17)
    assert unseen not in four
    got = m.gamma[(5 << 12) | (9 << 6) | 26, 0] + m.tri[(9 << 12) | (26 << 6) | 17, 0]
    assert 2.0**got == pytest.approx(p(unseen), rel=1e-4)


def test_grams_keep_texts_apart():
    both, bound, letter = langid.grams(pa.array(["Ab, c", None, "12 !", "éa"]))
    apart = [langid.grams(pa.array([x], pa.string()))[0].tolist() for x in ("Ab, c", None, "12 !", "éa")]
    assert [both[a:b].tolist() for a, b in zip(bound[:-1], bound[1:], strict=True)] == apart and letter.tolist() == [True, False, False, True]


def test_scanning_takes_little_memory_whatever_the_batch():
    arr = pa.array(["the river walks " * 125] * 1000)
    model = langid.Model({"en": (np.arange(64, dtype=np.uint32), np.ones(64, np.int64))})
    parts = list(langid.slices(arr))
    assert [k for i, j in parts for k in range(i, j)] == list(range(1000))
    model.entropies(arr.slice(0, 1))
    tracemalloc.start()
    h = np.concatenate([model.entropies(arr.slice(i, j - i))[0] for i, j in parts])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert h.shape == (1000, 1) and np.ptp(h) < 1e-9 and peak < 32 << 20


def test_held_out_accuracy_and_rejection(spark):
    rows = [*corpus(), (5000, None, "en", "a", 0), (5001, "123 --", "en", "a", 0), (5002, "xq zzk vvq kjq " * 80, None, "a", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    model = langid.fit(df.where(~langid.held_out(df.doc_id)))
    got = {r.doc_id: r for r in langid.predictions(df, model, "text", ["doc_id"]).collect()}
    held = [i for i, *_ in rows if zlib.crc32(str(i).encode()) % 4 == 2 and i < 5000]
    assert held and np.mean([got[i].asDict()["__lang_pred"] == rows[i][2] for i in held]) > 0.98
    assert [got[i]["__lang_pred"] for i in (5000, 5001)] == ["und", "und"] and all(got[i]["__rejected"] for i in (5000, 5001, 5002))
    assert not any(got[i]["__rejected"] for i in range(240)) and all(0 <= g["__score"] <= 1 for g in got.values())


def test_no_training_text(spark):
    df = spark.createDataFrame([(1, "abc", None, None, 0), (2, None, "en", None, 0)], SCHEMA)
    got = {r.doc_id: (r["__lang_pred"], r["__rejected"]) for r in langid.predictions(df, langid.fit(df), "text", ["doc_id"]).collect()}
    assert got == {1: ("und", False), 2: ("und", True)}


def test_more_languages_than_one_broadcast_holds(spark, monkeypatch):
    df = spark.createDataFrame(corpus(120), SCHEMA)
    one = {tuple(r) for r in langid.predictions(df, langid.fit(df), "text", ["doc_id"]).collect()}
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 2)
    assert {tuple(r) for r in langid.predictions(df, langid.fit(df), "text", ["doc_id"]).collect()} == one
    assert langid.keep_documents(df).count() == 120


def test_each_language_is_calibrated_on_its_own_rows(spark):
    df = spark.createDataFrame(corpus(), SCHEMA)
    assert np.isfinite(langid.fit(df, calibration_rows=40).limit).all()


def test_rare_language_still_rejects(spark):
    r = random.Random(2)
    rare = ["дом", "река", "яблоко", "ребёнок", "светлый", "улица"]
    rows = [*corpus(), *((900 + i, " ".join(r.choice(rare) for _ in range(300)), "ru", "a", 0) for i in range(6)), (990, " ".join(r.choice(rare) for _ in range(300)), None, "a", 0), (991, " ".join("".join(r.choice("абвгдежзиклмнопрстуфхцчшщэюя") for _ in range(6)) for _ in range(300)), None, "a", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {x.doc_id: (x["__lang_pred"], x["__rejected"]) for x in langid.predictions(df, langid.fit(df), "text", ["doc_id"]).collect()}
    assert got[991] == ("ru", True) and all(got[i] == ("ru", False) for i in [*range(900, 906), 990])
    assert not any(got[i][1] for i in range(240))


# --- packing ---------------------------------------------------------------------------


def least_bins(sizes, capacity):
    """By exhaustive search."""
    best = len(sizes)

    def go(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(sizes):
            best = len(bins)
            return
        for i in {b: i for i, b in enumerate(bins)}.values():
            if bins[i] >= sizes[k]:
                go(k + 1, (*bins[:i], bins[i] - sizes[k], *bins[i + 1 :]))
        go(k + 1, (*bins, capacity - sizes[k]))

    sizes = sorted(sizes, reverse=True)
    go(0, ())
    return best


def test_completion_finds_the_least_number():
    r = random.Random(6)
    for _ in range(150):
        cap = r.choice([10, 20, 30])
        sizes = [r.randint(1, cap) for _ in range(r.randint(1, 11))]
        h = np.bincount(sizes, minlength=cap + 1)
        plan = packing.complete(h, cap)
        used = [s for p, n in plan for _ in range(n) for s in p]
        assert sorted(used) == sorted(sizes) and all(sum(p) <= cap for p, _ in plan)
        assert packing.lower_bound(h, cap) <= least_bins(sizes, cap) == sum(n for _, n in plan) <= sum(n for _, n in packing.best_fit(h, cap))


def test_packing_of_a_table(spark):
    r = random.Random(8)
    texts = [None, "", "<|endoftext|>", *(prose(r, "en", r.choice([5, 40, 400, 1200])) for _ in range(60))]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(3, texts[3], 2)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id bigint, text string, piece int").repartition(4), capacity=512).collect()
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for i, t, _ in rows:
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 0]
        first = len(ids) % 512 or 512
        cuts = [0, *range(first, len(ids) + 1, 512)]
        want += [(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    assert sorted((x.doc_id, x.piece, x.start, x.length, x.ids_crc32) for x in got) == sorted(want)
    seqs = {}
    for x in got:
        seqs.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 512
    assert len(seqs) >= -(-sum(w[3] for w in want) // 512)


# --- pipeline --------------------------------------------------------------------------


def test_pipeline(spark, tmp_path):
    rows = corpus()
    r = random.Random(3)
    near = rows[5][1].split()
    near[10] = near[11] = "changed"
    rows += [(900, rows[4][1], "en", "s0", 0), (901, None, "en", "s0", 0), (902, "7 7 7", "en", "s0", 0), (903, " ".join(near), rows[5][2], "s1", 0), (904, " ".join(w + "###" for w in prose(r, "en", 80).split()), "en", "s0", 0)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    docs, left = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.dtypes == [tuple(x.split()) for x in SCHEMA.split(", ")], name
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        left.append({x.doc_id for x in docs.collect()})
    every = {x[0] for x in rows}
    assert every - left[0] == {901, 902} and left[0] - left[1] == {904} and left[1] - left[2] == {900} and left[2] - left[3] == {903}
    kept = {x.doc_id: x.text for x in docs.collect()}
    assert all(x.n_chars == len(x.text) for x in docs.collect())
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    total = {i: len(lib.encode(t, add_special_tokens=False).ids) + 1 for i, t in kept.items()}
    assert {i: sum(x.length for x in got if x.doc_id == i) for i in total} == total and {x.doc_id for x in got} == set(total)
