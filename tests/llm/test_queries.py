"""The registered queries over small tables with the hard rows: nulls, empty, repeated and very long texts, clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from lumenframe.llm import licenses, packing, queries
from tests.llm.test_linedup import brute_bound

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def rows():
    r = random.Random(11)
    sounds = {"aa": ["ka", "to", "mi", "ru"], "bb": ["sch", "ein", "zu", "ung"]}

    def prose(lang, n):
        return " ".join("".join(r.choice(sounds[lang]) for _ in range(r.randint(1, 4))) for _ in range(n)) + "."

    out = []
    for i in range(160):
        lang = "aa" if i % 2 else "bb"
        out.append((i, "\n".join(prose(lang, r.randint(4, 60)) for _ in range(r.randint(1, 4))), lang))
    out += [(200, None, "aa"), (201, "", None), (202, " \n\t ", "bb"), (203, "12 34 !?", None), (204, "é漢字😀 <|endoftext|> x", None), (205, "x" * 150_000, None), (206, prose("aa", 30_000), "aa"), (207, "\n".join(["Licensed under the MIT License"] * 7), None)]
    out += [(300, out[3][1], "aa"), (300, out[3][1], "aa"), (301, out[4][1], None)]
    return out


@pytest.fixture(scope="module")
def sf(tmp_path_factory, rows):
    at = tmp_path_factory.mktemp("sf")
    n = len(rows)
    names = ["id", "key", "n", "kind", "__text", "n_similar"]  # columns of the operators' own
    t = pa.table({"doc_id": pa.array([x[0] for x in rows], pa.int64()), "text": pa.array([x[1] for x in rows], pa.string()), "lang": pa.array([x[2] for x in rows], pa.string()), "source": ["s"] * n, "n_chars": pa.array([len(x[1] or "") for x in rows], pa.int64()), **{c: ["clash"] * n for c in names}})
    pq.write_table(t, at / "documents.parquet")
    none = at / "none"
    none.mkdir()
    pq.write_table(t.slice(0, 0), none / "documents.parquet")
    pq.write_table(pa.table({"page_id": pa.array([], pa.int64()), "url": pa.array([], pa.string()), "html": pa.array([], pa.string())}), none / "pages.parquet")
    return str(at)


def got(spark, sf, name):
    return [r.asDict() for r in queries.QUERIES[name](spark, sf).collect()]


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_empty_tables(spark, sf, name):
    assert got(spark, sf + "/none", name) == []


def test_op1_transport_streams(spark, sf, rows):
    out = got(spark, sf, "op1_transport_streams")
    want = []
    for i, t, _ in rows:
        raw = (t or "").encode()
        raw, n = raw + bytes(-len(raw) % 64 or (0 if raw else 64)), len(raw)
        want.append((i, n, len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:])))
    assert sorted((x["doc_id"], x["n_bytes"], x["payload_bytes"], x["payload_sha256"], x["tail_crc32"]) for x in out) == sorted(want)
    assert all(x["pts"] == sorted(x["pts"]) and len(x["pts"]) == len(x["dts"]) and x["random_access_offsets"] for x in out)
    same = {}
    text = dict((i, t) for i, t, _ in rows)
    for x in out:
        assert same.setdefault(text[x["doc_id"]] or "", (x["media_sha256"], x["feature"])) == (x["media_sha256"], x["feature"])


def test_op2_language_id(spark, sf, rows):
    out = got(spark, sf, "op2_language_id")
    assert Counter(x["doc_id"] for x in out) == Counter(x[0] for x in rows)
    lang = {i: x for i, _, x in rows if i < 200}
    for x in out:
        assert x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode()) % 4 == 2)
        assert 0 <= x["score"] <= 1
        if x["doc_id"] in (200, 201, 202, 203):
            assert (x["lang_pred"], x["score"], x["rejected"]) == ("und", 0.0, True)
        elif x["doc_id"] in lang:
            assert x["lang_pred"] == lang[x["doc_id"]] and not x["rejected"]
    assert next(x for x in out if x["doc_id"] == 205)["lang_pred"] in ("aa", "bb")


def test_op3_token_counts_and_op4_packing(spark, sf, rows):
    import tokenizers

    lib = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = [(i, lib.encode(t or "", add_special_tokens=False).ids) for i, t, _ in rows]
    out = got(spark, sf, "op3_token_counts")
    assert sorted((x["doc_id"], x["n_bytes"], x["n_tokens"], x["over_limit"]) for x in out) == sorted((i, len((t or "").encode()), len(k), len(k) > 1024) for (i, t, _), (_, k) in zip(rows, ids, strict=True))
    want = []
    for i, k in ids:
        k = np.array([*k, 0], "<u4")
        cuts = [0, *range(len(k) % 2048 or 2048, len(k) + 1, 2048)]
        want += [(i, n, a, b - a, zlib.crc32(k[a:b])) for n, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    out = got(spark, sf, "op4_best_fit_packing")
    assert sorted((x["doc_id"], x["piece"], x["start"], x["length"], x["ids_crc32"]) for x in out) == sorted(want)
    fill = {}
    for x in sorted(out, key=lambda x: (x["sequence_id"], x["offset"])):
        assert x["offset"] == fill.get(x["sequence_id"], 0)
        fill[x["sequence_id"]] = x["offset"] + x["length"]
    assert max(fill.values()) <= 2048
    assert len(fill) <= len(packing.best_fit(np.bincount([x[3] for x in want], minlength=2049), 2048)) or len(fill) == -(-sum(x[3] for x in want) // 2048)


def test_op6_base_statistics(spark, sf, rows):
    want = []
    for i, t, _ in rows:
        w = WORD.findall(t or "")
        three = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        inside = {k + d for k in range(len(w) - 2) if three[tuple(w[k : k + 3])] > 1 for d in range(3)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        failed = len(w) < 50 or 100 * len(inside) > 50 * len(w)
        want.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(inside), failed))
    out = got(spark, sf, "op6_quality_outliers")
    assert sorted((x["doc_id"], x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"], x["base_failed"]) for x in out) == sorted(want)
    assert not any(x["kept"] and x["base_failed"] for x in out)


def test_op7_sentencepiece(spark, sf, rows):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = []
    for i, t, _ in rows:
        k = np.array(lib.encode(t or ""), "<u4")
        want.append((i, len(k), zlib.crc32(k.tobytes())))
    out = got(spark, sf, "op7_sentencepiece")
    assert sorted((x["doc_id"], x["n_tokens"], x["ids_crc32"]) for x in out) == sorted(want)
    assert all(x["round_trip"] for x in out)


def test_op9_every_template_at_every_place(spark, sf):
    out = [x for x in got(spark, sf, "op9_license_scan") if x["doc_id"] == 207]
    text = "\n".join(["Licensed under the MIT License"] * 7)
    assert [(x["begin"], x["end"], x["license"]) for x in sorted(out, key=lambda x: x["begin"])] == [(m.start(), m.end(), "MIT") for m in re.finditer("Licensed under the MIT License", text)]
    index = licenses.Index()
    r = random.Random(2)
    filler = ["lorem", "ipsum", "dolor", "sit", "amet", "magna"]
    for (name, kind), template in licenses.TEMPLATES.items():
        for copies in (1, 2, 3):
            parts = []
            for _ in range(copies):
                parts += [" ".join(r.choice(filler) for _ in range(r.randint(1, 40))), template]
            text = ". ".join(parts)
            found = [x for x in licenses.matches(index, pa.array([text])) if x[1] == name]
            assert sum(x[4] == 1.0 for x in found) == copies, (name, kind, copies)


def test_op10_line_dedup(spark, sf, rows):
    short = [(i, t) for i, t, _ in rows if i not in (205, 206, 300)]
    gone = brute_bound([(i, t or "") for i, t in short], 10, 20)
    out = {x["doc_id"]: x for x in got(spark, sf, "op10_line_dedup")}
    assert set(out) == {x[0] for x in rows}
    for i, t in short:
        x = out[i]
        lines = t.split("\n") if t else []
        assert x["n_lines"] == len(lines)
        if i != 301:  # which repeats a text of a lower id
            assert set(x["removed"]) == {k for k in gone.get(i, set()) if k < len(lines) and lines[k].split()}, i
        kept = "\n".join(y for k, y in enumerate(lines) if k not in x["removed"])
        assert x["n_kept_chars"] == len(kept)
    assert len(out[301]["removed"]) == out[301]["n_lines"] and len(out[300]["removed"]) == out[300]["n_lines"]
    assert out[205]["removed"] == [] and out[206]["n_kept_chars"] == len(next(t for i, t, _ in rows if i == 206))


def test_search_beats_best_fit():
    for low, high, n in ((500, 900, 3000), (250, 420, 3000)):
        h = np.bincount(np.random.default_rng(1).integers(low, high, n), minlength=2049)
        count = {f: sum(k for _, k in getattr(packing, f)(h, 2048)) for f in ("best_fit", "minimum_slack", "complete")}
        assert count["complete"] < count["best_fit"] and count["complete"] <= count["minimum_slack"]
        have = np.zeros(2049, int)
        for parts, k in packing.complete(h, 2048):
            assert sum(parts) <= 2048
            np.add.at(have, list(parts), k)
        assert (have == h).all()
