"""Buttons, hidden words and adverts inside paragraphs, nesting of any depth, and importance against a plain entropy."""

import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from corpusweave.llm import style_tree

INLINE = [
    "<button>Click me</button>", "<button type=submit><b>Click</b> me</button>", "<span hidden>secret</span>", "<span aria-hidden='true'>x</span>", "<i style='display: none'>x</i>",
    "<a class='ad'>Buy</a>", "<small class=notice>Note</small>", "<span class='share'><a>Share</a></span>", "<label>Name</label>", "<select><option>one<option>two</select>",
    "<em class='cookie-notice'>We use</em>", "<span id='newsletter'>Join</span>", "<script>x()</script>", "<style>b{}</style>", "<!-- c -->",
]


@pytest.mark.parametrize("chrome", INLINE)
@pytest.mark.parametrize("around", ["<p>{}</p>", "<ul><li>{}</li></ul>", "<table><tr><td>{}</td></tr></table>", "<div>{}</div>", "<p><b>{}</b></p>", "<blockquote>{}"])
def test_inline_chrome_leaves_its_block_whole(chrome, around):
    for article in ("<article>{}</article>", "{}"):
        page = article.format(around.format(f"Alpha {chrome} omega"))
        assert style_tree.main_text(page) == "Alpha omega", page
        assert style_tree.main_text(article.format(around.format(f"{chrome}One"))) == "One"
        assert style_tree.main_text(article.format(around.format(f"un{chrome}broken"))) == "unbroken"


def test_plain_inline_names_stay():
    assert style_tree.main_text("<p>a <span class='hi'>b</span> <a href=x>c</a>d</p>") == "a b cd"
    assert style_tree.main_text("<p>a<br>b &amp; <b>c</b></p>&lt;d") == "a b & c\n<d"


@pytest.mark.parametrize("depth", [3, 45, 3000])
def test_depth_changes_nothing(depth):
    wrap, end = "<div>" * depth, "</div>" * depth
    assert style_tree.main_text(f"<article><p>Own</p><div class='sidebar'>{wrap}Side{end}</div></article>") == "Own"
    page = f"<article><p>Own</p><section>{wrap}Tip{end}</section></article>"
    branches = style_tree.branches(page)[1]
    section = style_tree.signed(f"{style_tree.signed('0 article.')} section.")
    assert section in branches and len(branches) == depth + 3
    assert style_tree.main_text(page, low=frozenset([section])) == "Own"
    names = "<div class='tip-widget'>" * depth  # names around a whole one
    assert style_tree.main_text(f"<article><p>Own</p>{names}<div class='sidebar'>Side</div></article>") == "Own"


def test_deep_pages_take_time_in_proportion():
    page = "<div>" * 20_000 + "a<p>" * 20_000
    assert style_tree.main_text(page).count("\n") == 19_999 and len(style_tree.branches(page)[1]) == 20_001


def plain_importance(pages):
    """Entropies over the different pages of a host, from each branch's texts themselves."""
    seen = defaultdict(set)
    for host, page in pages:
        pieces, elements, _ = style_tree.parse(page or "")
        texts = [(" ".join(p.text().split()), p.holder.branch) for p in pieces]
        whole = tuple(t for t, _ in texts if t)
        own = defaultdict(lambda: ([], []))
        for e in elements[1:]:
            for text, branch in texts[e.start : e.end]:
                if text:
                    own[e.branch][0].append(text)
                    own[e.branch][1].append(branch)
        for branch, both in own.items():
            for kind, value in enumerate(both):
                seen[host, branch, kind].add((whole, tuple(value)))
    entropy = {}
    for key, values in seen.items():
        counts, n = Counter(v for _, v in values), len(values)
        entropy[key] = (n, -sum(c / n * math.log(c / n) for c in counts.values()) / math.log(n) if n > 1 else 1.0)
    w = style_tree.LAYOUT_WEIGHT
    return {(h, b): (max(entropy[h, b, k][0] for k in (0, 1)), (1 - w) * entropy[h, b, 0][1] + w * entropy[h, b, 1][1]) for h, b, _ in entropy}


def test_importance(spark, sf):
    given = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select(F.regexp_extract("url", "://([^/]*)", 1), "html").collect()]
    pages = given + [("h", f"<div class=a>{i % 2}</div><p>same</p><section><i>{i}</i></section>") for i in range(7)] + [("h", None), (None, "<p>x"), ("h", "")]
    found = style_tree.branch_importance(spark.createDataFrame(pages, "host string, html string")).collect()
    expected = plain_importance(pages)
    assert len(found) == len(expected)
    for r in found:
        n, value = expected[r.host, r.branch]
        assert r.seen == n and r.importance == pytest.approx(value, abs=1e-9)
