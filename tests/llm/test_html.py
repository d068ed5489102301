"""Template deduction: what decides, on pages of many makes, and its vectors against plain counting."""

import time
from collections import Counter

import pandas as pd
import pytest

from docloom.llm import html_extract as h

SCHEMA = "page_id long, url string, html string"


def extracted(spark, pages: dict[str, list[str]]) -> list[str]:
    rows = [(i, f"https://{host}/p{i}", page) for i, (host, page) in enumerate((host, p) for host, ps in pages.items() for p in ps)]
    got = {r.page_id: (r.text, r.n_chars) for r in h.extract_pages(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(len(t) == n for t, n in got.values())
    return [got[i][0] for i in range(len(rows))]


def prose(i: int, n: int = 12) -> str:
    return " ".join(f"word{i * 37 + k * 11}" for k in range(n))


def test_the_host_decides_what_a_page_cannot(spark):
    """The same page: unnamed teasers that come back on other pages of the host go, and stay where nothing is known of it."""
    page = "<body><div class=x><p>{a}</p></div><div class=y><p>{t}</p><p>Sale ends soon</p></div></body>"
    made = [page.format(a=prose(i), t=f"Teaser number {i % 3}") for i in range(9)]
    got = extracted(spark, {"many.example": made, "one.example": made[:1]})
    assert got[:9] == [prose(i) for i in range(9)]
    assert got[9] == f"{prose(0)}\nTeaser number 0\nSale ends soon"


@pytest.mark.parametrize("pages", [1, 6])
def test_makes_of_pages(spark, pages):
    body = lambda i: f"<h1>Title {i}</h1><p>{prose(i)}</p><p>A <a href=/x>link</a> in {i}"
    text = lambda i: f"Title {i}\n{prose(i)}\nA link in {i}"
    around = "<nav><a href=/>Home</a></nav>{}<footer>Imprint</footer>"
    makes = {
        "no-article": "<body>" + around.format("<div class=c>{}</div>"),
        "classes": "<body class='home has-sidebar'>" + around.format("<article class='post no-comments'>{}</article>"),
        "form": "<body><form action=/>" + around.format("<div>{}</div>") + "</form>",
        "comments": "<body>" + around.format("<article>{}<section id=comments><p>First!</p><p>" + "I agree " * 40 + "</p></section></article>"),
        "adverts": "<body>" + around.format("<div class='ad'>Buy now</div><article>{}<div class='cookie-notice'>Cookies</div></article><div class=sidebar-widget>More</div>"),
    }
    ids = range(pages)
    got = extracted(spark, {f"{k}.example": [m.format(body(i)) for i in ids] for k, m in makes.items()})
    assert got == [text(i) for _ in makes for i in ids]
    prices = "<body><article>{}<div class=share-price-table>Price {}</div></article><article>Second {}</article>"
    got = extracted(spark, {"two.example": [prices.format(body(i), i, i) for i in ids]})
    assert got == [f"{text(i)}\nPrice {i}\nSecond {i}" for i in ids]


def test_pages_of_another_kind_and_repeated_rows(spark):
    usual = "<body><div class=top>Welcome to our pages</div><div class=c><p>{}</p></div></body>"
    other = "<body><div class=c><p>{}</p></div><section><p>Welcome to our pages</p></section></body>"
    rows = [(i % 5, "//x.example", usual.format(prose(i % 5))) for i in range(50)] + [(50, "//x.example", other.format(prose(50)))]
    got = sorted((r.page_id, r.text) for r in h.extract_pages(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == sorted([(i % 5, prose(i % 5)) for i in range(50)] + [(50, f"{prose(50)}\nWelcome to our pages")])


def test_vectors_are_plain_counts(spark):
    page = "<body><ul>{}</ul><p>same</p>{}</body>"
    rows = [(i % 7, "//v.example", page.format("<li>x" * (i % 3 + 1), "<p>t%d</p>" % (i % 2))) for i in range(12)]
    stats = h.token_stats(spark.createDataFrame(rows, SCHEMA)).toPandas().set_index(["kind", "token"])
    plain: dict = {}
    for i, (_, _, html) in enumerate(rows):
        nodes, blocks = h.parse(html)
        for key, n in Counter([(1, x.token) for x in nodes[1:]] + [(2, h._token("x", str(nodes[b.node].token), b.text)) for b in blocks]).items():
            plain.setdefault(key, {})[i] = n
    assert set(plain) == {k for k in stats.index if k[0]}
    for key, v in plain.items():
        s = stats.loc[key]
        assert (s.pages, s.times, s.least, s.most) == (len(v), sum(v.values()), min(v.values()), max(v.values()))
    same: dict = {}
    for key, v in plain.items():
        same.setdefault((stats.loc[key].v1, stats.loc[key].v2), set()).add(tuple(sorted(v.items())))
    assert all(len(x) == 1 for x in same.values())
    assert len({tuple(sorted(v.items())) for v in plain.values()}) == len(same)


def test_only_classes_of_several_tokens_are_template():
    rows = [r for i in range(6) for r in h.token_rows("x", str(i), "<body><ul>" + "<li>a" * (i + 1) + "</ul><div><p>" + prose(i) + "</div></body>")]
    t = pd.DataFrame(rows, columns=[c.split()[0] for c in h._STATS.split(", ")])
    keep = {c: "sum" for c in ("v1", "v2", "pages", "times", "place", "mass", "linked")} | {"parent": "min", "least": "min", "most": "max", "marked": "max", "article": "max", "holds": "max"}
    t = t.groupby(["kind", "token"], as_index=False).agg(keep).assign(repeated=0)
    tokens, gone, once, texts = h.deduced(t[t["kind"] > 0], 6, int(t[t["kind"] == 0]["mass"].iloc[0]))
    nodes, _ = h.parse("<body><ul><li>a</ul><div><p>x</div></body>")
    body, ul, li, div, p = (n.token for n in nodes[1:])
    assert tokens == once == [body, ul, div, p] and li not in tokens and not any(gone)


def test_marked_inline_elements_have_a_text_of_their_own():
    assert h.extract_page('<p>Real text <span class="ad">BUY <b>NOW</b></span> goes on.</p><p>Next</p>') == "Real text goes on.\nNext"
    assert h.extract_page("<p>A <span class=x>kept</span> word</p>") == "A kept word"
    note = '<article><p>Body</p><div class="user-feedback">I liked it</div></article>'
    assert h.extract_page(note) == "Body"


@pytest.mark.parametrize("page", ["<div>" * 10_000 + "x</p>" * 10_000, "<b>" * 10_000 + "x</i>" * 10_000, "<i><div>" + "<b>" * 10_000 + "x</i>" * 10_000, "<p>" + "<b>" * 5000 + "x<p>" * 5000, "<p>x" + "<span class=ad>y</span>z" * 5000])
def test_time_is_linear_in_tags_that_close_nothing(page):
    began = time.process_time()
    h.extract_page(page)
    assert time.process_time() - began < 3


def test_end_tags_reach_what_they_may():
    assert h.extract_page("<article><p>one <b>two</p><p>three</b> four</article><footer>x</footer>") == "one two\nthree four"
    assert h.extract_page("<article><i>a<div>b</i>c</div>d</article>") == "a\nbc\nd"
    assert h.extract_page("<article><p>a<div>b<p>c</div>d</article>") == "a\nb\nc\nd"
