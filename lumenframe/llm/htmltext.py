"""Main text of web pages by tree scoring.

A forgiving scanner builds the element tree (void elements, implied ends, raw text,
comments).  Menus, site headers, footers, sidebars, notices, adverts, forms, scripts,
hidden parts and reader comments are cut by element, role and the words of class and id,
unless that part holds most of the page's paragraphs.  Each paragraph then passes points
for its length and commas to its ancestors, in full to the parent, half to the
grandparent and less further up; a container's points are discounted by its link density.
The best container and its siblings that qualify are kept; without inner parts that are
mostly links, within article elements without bare rows of links only.

Scanning is linear in the page: quotes end a search for a tag's end, and names of elements
that are not open are known without a walk.

Defined cases: null and empty pages give an empty text; text outside any element counts
as a paragraph of the page; an unfinished tag at the end is dropped; any nesting depth
works; white space includes no-break spaces; of containers with equal points the first
scored stays; repeated pages and clashing column names are handled row by row.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm import common
from lumenframe.llm.textvec import runs

_OPEN = re.compile(r"<(?:(!--)|(/?)([a-zA-Z][^\s/>]*)|[!?/])")
_EDGE = re.compile("[>\"']")
LONG_TAG = 1 << 16  # a tag whose quotes do not end within so many characters ends at its first >
_ATTR = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes template svg math xmp".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul caption".split())
CLOSES_P = BLOCK - {"option", "body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "summary"}
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "tbody": ({"tbody", "thead", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"})}
CUT = frozenset("nav aside footer form button select fieldset dialog menu canvas object embed audio video map input label".split())
CUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist tooltip".split())
CUT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promos promotion promoted banner banners nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager "
    "sidebar sidebars aside widget widgets rail footer foot colophon masthead topbar toolbar cookie cookies consent gdpr notice notices notification notifications alert alerts popup modal overlay newsletter subscribe subscription "
    "signup signin login comment comments commentlist respond disqus discussion replies reply share sharing social related recommended recommendations trending form search skip hidden".split()
)
PLAIN_WORDS = frozenset("area bar block body bottom box button buttons card cards col column container content element footer form frame group grid head header heading icon icons inline inner item items label left line link links list main media message module news outer page panel policy post posts primary region right row secondary section side site slot small space strip tag target text thread title tools top unit user view wrap wrapper zone js the of for by".split())
HEADER_WORDS = frozenset(["header", "head"])
KEEP_WORDS = frozenset("article body content entry main page post story text prose column".split())
PARAGRAPH = frozenset("p pre td th blockquote li dd dt div section article main body figcaption h1 h2 h3 h4 h5 h6 #root".split())


LEVELS = 8  # ancestors that a paragraph passes points to


class Node:
    __slots__ = ("attrs", "cut", "inside", "kids", "link", "links", "parent", "score", "size", "tag")

    def __init__(self, tag: str, attrs: str, parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.inside = parent is not None and (parent.inside or parent.tag in ("article", "main"))
        self.kids: list[Node | str] = []
        self.score, self.size, self.link, self.links, self.cut = 0.0, 0, 0, 0, False


def tree(page: str) -> Node:
    root = Node("#root", "", None)
    at, here, n = 0, root, len(page)

    def text(x: str) -> None:
        if x:
            here.kids.append(html.unescape(x) if "&" in x else x)

    def close(x: Node) -> None:
        """Ends all elements up to x."""
        nonlocal here
        while here is not x:
            open_[here.tag] -= 1
            here = here.parent

    open_: Counter = Counter()  # elements that are open, by name; spares walks that would find nothing
    while at < n:
        m = _OPEN.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        if m[1]:
            stop = page.find("-->", m.end())
            at = stop + 3 if stop >= 0 else n
            continue
        stop = _tag_end(page, m.end()) if m[3] else page.find(">", m.end())
        if stop < 0:  # an unfinished tag
            break
        at = stop + 1
        end, name, attrs = m[2], m[3], page[m.end() : stop]
        if name is None:
            continue
        name = name.lower()
        if end:
            if not open_[name]:
                continue
            x = here
            while x is not root and x.tag != name:
                if x.tag in ("table", "td", "th") and name not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html"):
                    x = root
                    break
                x = x.parent
            if x is not root:
                close(x.parent)
            continue
        if name in RAW:
            if not attrs.rstrip().endswith("/") or name not in ("svg", "math"):
                stop = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
                at = page.find(">", stop.end()) + 1 if stop else n
                at = at or n
            continue
        if name in CLOSES_P and open_["p"]:
            x = here
            while x is not root and x.tag != "p" and x.tag not in ("td", "th", "table", "button"):
                if x.tag in BLOCK:
                    break
                x = x.parent
            if x.tag == "p":
                close(x.parent)
        if name in ENDS and any(open_[k] for k in ENDS[name][0]):
            closes, scope = ENDS[name]
            x, last = here, None
            while x is not root and x.tag not in scope:
                if x.tag in closes:
                    last = x
                x = x.parent
            if last is not None:
                close(last.parent)
        if name == "a" and open_["a"]:  # links don't nest
            x = here
            while x is not root and x.tag not in BLOCK:
                if x.tag == "a":
                    close(x.parent)
                    break
                x = x.parent
        if name in ("html", "body") and attrs == "" and here is not root and name == "body" and here.tag == "body":
            continue
        x = Node(name, attrs, here)
        here.kids.append(x)
        if name not in VOID:
            open_[name] += 1
            here = x
    return root


def _tag_end(page: str, at: int) -> int:
    """Place of the > that ends a tag, outside quotes; -1 if there is none."""
    k, most = at, at + LONG_TAG
    while m := _EDGE.search(page, k, most):
        if m[0] == ">":
            return m.start()
        k = page.find(m[0], m.end(), most) + 1
        if not k:
            break
    return page.find(">", at)


def _attributes(raw: str) -> dict[str, str]:
    return {k.lower(): html.unescape(a or b or c or "") for k, a, b, c in _ATTR.findall(raw)}


def unwanted(x: Node) -> bool:
    if x.tag in CUT:
        return True
    if x.tag == "header" and not x.inside:
        return True
    if not x.attrs or x.tag in ("html", "body"):
        return False
    a = _attributes(x.attrs)
    if a.get("role", "").lower() in CUT_ROLES or "hidden" in a or a.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", ""), re.I):
        return True
    if x.tag in ("article", "main", "p", "h1"):
        words = {w.lower() for w in _WORD.findall(a.get("class", "") + " " + a.get("id", ""))}
        return bool(words & {"comment", "ad", "advert", "advertisement", "sponsored"})
    if x.inside:  # in an article a name must speak of nothing but such a part: "share-bar", not "form-factor"
        names = [[w.lower() for w in _WORD.findall(t)] for t in (a.get("class", "") + " " + a.get("id", "")).split()]
        return any(CUT_WORDS.intersection(t) and all(w in CUT_WORDS or w in PLAIN_WORDS or w.isdigit() for w in t) for t in names)
    words = {w.lower() for w in _WORD.findall(a.get("class", "") + " " + a.get("id", ""))}
    return bool(words & CUT_WORDS) or (not x.inside and bool(words & HEADER_WORDS) and not words & KEEP_WORDS)


def _walk(root: Node) -> Iterator[tuple[Node | str, bool]]:
    """All nodes in page order, elements also when they end; cut ones are skipped."""
    stack: list = [(root, False)]
    while stack:
        x, end = stack.pop()
        yield x, end
        if isinstance(x, Node) and not end and not x.cut:
            stack.append((x, True))
            stack.extend((k, False) for k in reversed(x.kids))


def _measure(root: Node) -> None:
    """Text and link lengths of every element; cut ones count nothing."""
    within = 0
    at = [root]
    for x, end in _walk(root):
        if isinstance(x, str):
            size = len(" ".join(x.split()))
            at[-1].size += size
            if within:
                at[-1].link += size
        elif x.cut:
            continue
        elif not end:
            x.size = x.link = x.links = 0
            if x.tag == "a":
                within += 1
            at.append(x)
        else:
            at.pop()
            if x.tag == "a":
                within -= 1
                x.links += 1
            p = at[-1]
            if p is not x:
                p.size += x.size
                p.link += x.link
                p.links += x.links


def _cut(root: Node) -> None:
    """Cuts unwanted parts, but none that holds most of the page."""
    _measure(root)
    whole = max(root.size, 1)
    for x, end in _walk(root):
        if isinstance(x, Node) and not end and x.tag != "#root" and unwanted(x):
            most = x.size > 0.6 * whole and x.tag not in CUT and x.size > 400 and x.link < 0.3 * x.size
            x.cut = not most
    _measure(root)


def _direct(x: Node) -> str:
    """Text of an element outside inner blocks."""
    out: list[str] = []
    stack: list = list(reversed(x.kids))
    while stack:
        k = stack.pop()
        if isinstance(k, str):
            out.append(k)
        elif k.tag == "br":
            out.append(" ")
        elif not k.cut and k.tag not in BLOCK:
            stack.extend(reversed(k.kids))
    return " ".join("".join(out).split())


def _score(root: Node) -> list[Node]:
    found = []
    for x, end in _walk(root):
        if end or isinstance(x, str) or x.cut or x.tag not in PARAGRAPH:
            continue
        t = _direct(x)
        if not t:
            continue
        points = 1 + t.count(",") + t.count("，") + t.count("、") + min(len(t) / 100, 3)
        if x.tag in ("li", "td", "th", "dd", "dt", "h1", "h2", "h3", "h4", "h5", "h6"):
            points *= 0.5
        up, share, level = x if x.tag in ("div", "section", "article", "main", "body", "#root") else x.parent, 1.0, 0
        while up is not None and level < LEVELS:
            if up.score == 0:
                found.append(up)
            up.score += points * share
            level += 1
            share = 0.5 if level == 1 else 1 / (3 * level)
            up = up.parent
    for x in found:
        x.score *= 1 - x.link / max(x.size, 1)
        if x.tag in ("article", "main"):
            x.score = x.score * 1.5 + 5
    return found


def _linky(x: Node) -> bool:
    """Mostly links; within an article only a bare row of links, as lists there are the article's."""
    if x.links < 2 or x.link <= 0.6 * x.size:
        return False
    if x.inside:
        return x.tag in ("div", "section") and any(isinstance(k, Node) and k.tag == "a" for k in x.kids)
    return x.tag in ("ul", "ol", "dl", "table", "div", "section")


def blocks(kept: list[Node | str]) -> list[str]:
    """Texts of the blocks in page order."""
    out: list[str] = []
    line: list[str] = []

    def flush() -> None:
        t = " ".join("".join(line).split())
        if t:
            out.append(t)
        line.clear()

    for top in kept:
        if isinstance(top, str):
            line.append(top)
            continue
        for x, end in _walk(top):
            if isinstance(x, str):
                line.append(x)
            elif x.cut:
                continue
            elif x.tag == "br":
                line.append(" ")
            elif x.tag in BLOCK:
                flush()
    flush()
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    root = tree(page)
    _cut(root)
    found = _score(root)
    if not found:
        return " ".join(blocks([root]))
    best = max(found, key=lambda x: x.score)
    if best.tag == "#root":
        return _text_of([best], best)
    parent, kept = best.parent, []
    limit = max(10.0, 0.2 * best.score)
    for k in parent.kids:
        if k is best:
            kept.append(k)
        elif isinstance(k, str):
            if len(k.strip()) > 80 and parent.tag not in ("html", "#root"):
                kept.append(k)
        elif k.cut or not k.size:
            continue
        else:
            density = k.link / k.size
            if (k.score >= limit and density < 0.3) or (k.tag in ("p", "pre", "blockquote") and density < 0.25 and k.size > 80) or (k.tag == "h1" and not density):
                kept.append(k)
    return _text_of(kept, best)


def _text_of(kept: list[Node | str], best: Node) -> str:
    for top in kept:
        if isinstance(top, Node):
            for x, end in _walk(top):
                if isinstance(x, Node) and not end and x is not best and _linky(x):
                    x.cut = True
    return " ".join(blocks(kept))


def extract(df: DataFrame, html_col: str, keep: list[str]) -> DataFrame:
    """The columns ``keep`` with text and n_chars; map-only."""
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.select(*[F.col(f"`{c}`") for c in keep]).schema) + "`__text` string, `__n_chars` bigint"
    k = len(keep)

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for i, j in runs(b.column(k)):
                texts = [main_text(x) for x in b.column(k).slice(i, j - i).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(x).slice(i, j - i) for x in range(k)] + [pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=[*keep, "__text", "__n_chars"])

    return df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{html_col}`").cast("string").alias("__html")).mapInArrow(work, schema)


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.text_batches(spark)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract(pages, "html", ["page_id", "url"]).select("page_id", "url", F.col("__text").alias("text"), F.col("__n_chars").alias("n_chars"))
