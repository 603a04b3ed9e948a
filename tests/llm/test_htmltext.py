import time
import html
import re

import pytest

from lumenframe.llm.htmltext import extract, main_text

P1 = "The first paragraph is long enough, has commas, and says something about nothing in particular."
P2 = "The second one goes on, with more words, and ends here &amp; now."


@pytest.mark.parametrize(
    "page,want",
    [
        (None, ""),
        ("", ""),
        ("   ", ""),
        ("Just text &lt;here&gt;", "Just text <here>"),
        (f"<html><head><title>x</title><script>var a='<p>no</p>'</script></head><body><nav><a href=/>Home</a></nav><article><h1>Title</h1><p>{P1}<p>{P2}</article><footer>foot</footer>", f"Title {P1} The second one goes on, with more words, and ends here & now."),
        (f"<body><header><h2>Site</h2></header><div class=content><p>{P1}</p><ul><li>One, two</li><li>three</li></ul><div class='share'><a>x</a></div><p><b>a</b>b<br>c&nbsp; d</p></div><div id=sidebar><p>{P2}</p></div><div class=comments><p>{P2}</p></div></body>", f"{P1} One, two three ab c d"),
        (f"<main><p>{P1}</p><div><a href=1>one</a> <a href=2>two</a> <a href=3>three</a></div><table><tr><td>cell<td>two</table><form>name</form></main><aside>{P2}</aside>", f"{P1} cell two"),
        (f"<div><p>{P1}</p></div><div class='cookie-notice'>We use cookies</div><div hidden><p>{P2}</p></div><!-- {P2} --><a hre", P1),
        (f"<article><p>{P1}<!-- cut", P1),
        ("<article><p>Tiny.</p></article><div class=ad>Buy, buy, buy, this great and long and shiny thing.</div>", "Tiny."),
        (f"<article><p>{P1}</p><div class=form-factor><p>Kept, too.</p></div><ul><li><a href=1>Source one</a></li><li><a href=2>Source two</a></li></ul><div class='share-bar'>Share</div></article>", f"{P1} Kept, too. Source one Source two"),
        ("<div>" * 5000 + "deep, text" + "</div>" * 5000, "deep, text"),
    ],
)
def test_pages(page, want):
    assert main_text(page) == want


def test_table_columns(spark):
    df = spark.createDataFrame([(1, None, "<p>a", "z"), (2, "u", None, "z")], "page_id bigint, url string, html string, text string")
    assert sorted(map(tuple, extract(df, "html", ["page_id", "url"]).collect())) == [(1, None, "a", 1), (2, "u", "", 0)]


def test_driver_pages_against_a_plain_reading(spark):
    """Their article is one element, so a reading by pattern is possible there."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    for r in pages:
        inner = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        want = " ".join(html.unescape(re.sub(r"</?(p|h1|br)>", " ", inner).replace("<b>", "").replace("</b>", "")).split())
        assert main_text(r.html) == want


@pytest.mark.parametrize("page", ['<p title="x>word ' * 20_000, "<a href='x>y " * 20_000, "<div>" * 2000 + "text" + "</span>" * 20_000, "<b>" * 20_000 + "</i></p>" * 20_000])
def test_broken_pages_take_linear_time(page):
    began = time.process_time()
    main_text(page)
    assert time.process_time() - began < 5
