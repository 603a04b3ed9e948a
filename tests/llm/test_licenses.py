import random
import re

import pyarrow as pa
import pytest

from lumenframe.llm import licenses as li


def lcs(a, b):
    d = [0] * (len(b) + 1)
    for x in a:
        p = 0
        for j, y in enumerate(b, 1):
            p, d[j] = d[j], p + 1 if x == y else max(d[j], d[j - 1])
    return d[-1]


def words(x):
    return [w.lower() for w in re.findall(r"[A-Za-z0-9\u0080-\U0010ffff]+", x)]


def test_finds_every_template_with_its_span():
    index = li.Index()
    r = random.Random(1)
    noise = lambda n: " ".join(r.choice(["lorem", "ípsum", "dolor", "under", "the", "License"]) for _ in range(n))
    for (name, kind), t in li.TEMPLATES.items():
        x = f"{noise(30)}\n{t}.\n{noise(30)}"
        m = li.matches(index, pa.array(["", x, None]))
        assert [(d, n) for d, n, *_ in m] == [(1, name)] and m[0][4] == 1.0
        assert x[m[0][5] : m[0][6]].rstrip(".") == t.rstrip(".:\"")


def test_edited_text_against_full_alignment():
    index = li.Index()
    r = random.Random(7)
    t = li.TEMPLATES[("MIT", "text")].split()
    for _ in range(5):
        e = [w for w in t if r.random() > 0.04]
        for _ in range(4):
            e.insert(r.randrange(len(e)), "foo")
        x = "alpha beta " + " ".join(e) + " gamma"
        m = li.matches(index, pa.array([x]))
        assert len(m) == 1 and m[0][1] == "MIT"
        best = lcs(words(" ".join(e)), words(li.TEMPLATES[("MIT", "text")]))
        assert best - 3 <= m[0][3] <= best


def test_clean_text_and_repeats(spark):
    one = "Released under the MIT License."
    df = spark.createDataFrame([(1, f"{one}\nabc def\n" + "x y z " * 50 + one, 3), (2, "the license of the software under which we live", 4), (3, None, 5), (4, "", 6)], "doc_id bigint, text string, kind int")
    rows = sorted((r.doc_id, r.license, r.begin, r.end) for r in li.scan(df).collect())
    assert rows == [(1, "MIT", 0, 30), (1, "MIT", 340, 370)]


@pytest.mark.parametrize("line", ["Released under the MIT License", "Licensed under the Apache License, Version 2.0", "Licensed under CC BY-NC 4.0"])
@pytest.mark.parametrize("between", ["\n", "\nfoo ", "\nname of a package: "])
def test_statements_on_neighbouring_lines(line, between):
    text = between.join([line] * 30)
    got = li.matches(li.Index(), pa.array([text]))
    assert [text[x[5] : x[6]] for x in got] == [line] * 30
