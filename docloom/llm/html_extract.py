"""HTML extraction by equivalence-class template deduction.

A page is a sequence of tokens: elements with their path of names from the root, and the texts of blocks
with the path that they stand in. Per host every token has an occurrence vector (how often it
stands on each page), of which an order-free fingerprint is aggregated. Frequent element tokens
with the same vector form an equivalence class; classes of several tokens nest, by their paths,
into the host's template. What pages put between template tokens are its slots. A slot is
classed by what all pages of the host put there: how much of the host's text it holds, how much of that is
links, and how much of it comes back on other pages. Menus, teasers and notices are links or come
back; parts that say by their kind or class what they are (nav, footer, comments) go too, unless
nearly all of the host's text is in them. Texts that are themselves template go wherever they stand.

A page that does not hold the tokens that all others have, in their order, is of another kind; it and pages of hosts with few
pages are classed by their own text alone.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm._common import bounded_batches
from docloom.scratch import stage

LEX = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|[^<]+|<""", re.S)
ATTR = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
SPACE = re.compile(r"\s+")
#: Element kinds of HTML.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "ruby", "rt", "rp", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
#: Kinds that never hold text of a page, and kinds that say what they are.
SKIP = {"head", "button", "select", "option", "svg", "canvas", "object", "template", "audio", "video", "map", "datalist"} | RAW
MARKED = {"nav", "footer", "aside", "header", "form", "dialog", "menu", "fieldset"}
#: Kinds that hold the article even where the part around them says otherwise.
HOLDS = {"article", "main", "h1", "form", "fieldset"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar", "form"}
#: Words of class and id names of parts that are not the article, and words that go along with them.
NAMES = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adbox", "banner", "sponsor", "sponsored", "promo", "promotion", "sidebar", "aside", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "toc", "cookie", "cookies", "consent", "feedback", "gdpr", "notice", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "share", "sharing", "social", "related", "recommended", "recommendations", "comment", "comments", "commentlist", "disqus", "reply", "replies", "respond", "discussion", "footer", "masthead", "topbar", "widget", "widgets", "pagination", "pager", "copyright", "disclaimer", "hidden"}
WITH = {"area", "bar", "block", "bottom", "box", "buttons", "container", "form", "header", "inner", "item", "items", "left", "line", "link", "links", "list", "main", "page", "panel", "posts", "primary", "right", "secondary", "section", "side", "site", "slot", "text", "thread", "top", "unit", "user", "wrap", "wrapper"}
CLOSES_P = {"p", "div", "ul", "ol", "li", "h1", "h2", "h3", "h4", "h5", "h6", "table", "section", "article", "aside", "header", "footer", "nav", "main", "form", "blockquote", "pre", "hr", "dl", "figure", "address", "fieldset", "details"}
#: Pages of a host from which it has a template, and shares of them that frequent elements and texts stand on.
LEAST_PAGES, FREQUENT, FREQUENT_TEXT = 4, 0.5, 0.9
#: A slot with so much of the text is the page; one with so much in links, or repeated, is not the article.
WHOLE, LINKS, REPEATED = 0.9, 0.5, 0.5


@dataclass
class Node:
    token: int
    parent: int
    marked: bool
    article: bool
    holds: bool
    mass: int = 0
    linked: int = 0


@dataclass
class Block:
    text: str
    node: int
    linked: int


@dataclass
class Template:
    """Of element tokens: whether their slots go, and the order of those that all pages have once; and the texts."""

    gone: dict[int, bool] = field(default_factory=dict)
    order: list[int] = field(default_factory=list)
    texts: set[int] = field(default_factory=set)


def _token(*parts: str) -> int:
    return xxhash.xxh64_intdigest("\0".join(parts).encode("utf-8", "surrogatepass")) - (1 << 63)


@lru_cache(maxsize=1 << 16)
def _step(parent: int, name: str) -> int:
    return _token("e", str(parent), name)


def names_part(name: str) -> bool:
    """Whether a class or id is that of a part besides the article: known words only, one of them telling."""
    words = [w for w in re.split(r"[^a-z]+", name.lower()) if w]
    return any(w in NAMES for w in words) and all(w in NAMES or w in WITH for w in words)


@lru_cache(maxsize=1 << 14)
def _described(tag: str, attrs: str) -> tuple[str, bool, bool]:
    """Name of an element in paths, whether it is hidden, and whether it says that it is not the article."""
    classes, hidden, marked = [], False, tag in MARKED
    for k, v in ATTR.findall(attrs):
        k, v = k.lower(), v.strip("\"'").lower()
        if k in ("class", "id"):
            marked |= tag not in ("html", "body", "article", "main") and any(map(names_part, v.split()))
            classes += [c for c in v.split() if k == "class" and not re.search(r"\d", c)]
        hidden |= k == "hidden" or k == "aria-hidden" and v == "true" or k == "style" and bool(re.search(r"display\s*:\s*none", v))
        marked |= k == "role" and v in ROLES
    return ".".join([tag, *sorted(set(classes))]), hidden, marked


def parse(page: str) -> tuple[list[Node], list[Block]]:
    """Elements in page order (the first stands for the page), with the text in them; and the blocks of text."""
    nodes, blocks = [Node(0, -1, False, False, False)], []
    stack: list[tuple[str, int, bool]] = []  # tag, its element, a part that holds no text begins here
    places: dict[str, list[int]] = {}  # of each open tag in the stack; "" stands for all that are not inline
    text: list[tuple[int, str, bool]] = []  # element, text, in a link
    skipped = links = 0
    at, n = 0, len(page)

    def flush() -> None:
        # An inline element that says what it is has a text of its own, beside that of the block around it.
        parts: dict[int, list[tuple[int, str, bool]]] = {}
        for t in text:
            parts.setdefault(t[0], []).append(t)
        for k, own in parts.items():
            got = SPACE.sub(" ", entities.unescape("".join([t[1] for t in own]))).strip()
            if got:
                part = min(sum(len(t[1]) for t in own if t[2]), len(got))
                blocks.append(Block(got, k, part))
                nodes[k].mass += len(got)
                nodes[k].linked += part
        text.clear()

    def close(i: int) -> None:
        nonlocal skipped, links
        for tag, _, skip in stack[i:]:
            skipped -= skip
            links -= tag == "a"
            places[tag].pop()
            if tag not in INLINE:
                places[""].pop()
        del stack[i:]

    def last(tag: str) -> int:
        return places[tag][-1] if places.get(tag) else -1

    while at < n:
        m = LEX.match(page, at)
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            if not skipped and (page[m.start()] != "<" or at == m.start() + 1):
                text.append((stack[-1][1] if stack else 0, m[0], links > 0))
            continue
        tag, end, attrs = tag.lower(), m[1] or m[4], m[3] or m[6] or ""
        if tag not in INLINE:
            if tag == "br":
                text.append((stack[-1][1] if stack else 0, " ", False))
                continue
            flush()
        if end:
            # An inline end does not reach beyond the block that it stands in.
            if (i := last(tag)) >= 0 and (tag not in INLINE or i > last("")):
                close(i)
            continue
        if tag in CLOSES_P and (i := last("p")) >= 0 and i == last(""):
            close(i)
        if tag in ("li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1][0] == tag:
            close(len(stack) - 1)
        if tag in RAW:
            stop = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = stop.end() if stop else n
            continue
        if tag in VOID or attrs.endswith("/") and tag in ("svg", "path"):
            continue
        here = stack[-1][1] if stack else 0
        name, hidden, marked = _described(tag, attrs) if attrs.strip() else (tag, False, tag in MARKED)
        skip = tag in SKIP or hidden
        if tag not in INLINE or marked:
            up = nodes[here]
            # The header of an article is its own.
            nodes.append(Node(_step(up.token, name), here, marked and not (tag == "header" and up.article and name == "header"), up.article or tag in ("article", "main"), tag in HOLDS))
            here = len(nodes) - 1
        skipped += skip
        links += tag == "a"
        for t in (tag, "") if tag not in INLINE else (tag,):
            places.setdefault(t, []).append(len(stack))
        stack.append((tag, here, skip))
    flush()
    for node in reversed(nodes[1:]):
        nodes[node.parent].mass += node.mass
        nodes[node.parent].linked += node.linked
        nodes[node.parent].holds |= node.holds
    return nodes, blocks


def host_of(url: str | None) -> str:
    m = re.match(r"(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "", re.I)
    return m[1].lower() if m else ""


def goes(marked: bool, article: bool, holds: bool, mass: int, linked: int, repeated: int, whole: int) -> bool:
    """Whether the text of a slot is not the article's: by its kind, its links, or because it comes back."""
    if marked or not mass:
        return marked and not (holds and mass >= WHOLE * whole)
    return mass < WHOLE * whole and not article and (linked >= LINKS * mass or repeated >= REPEATED * mass)


_PATH, _TEXT, _PAGE = 1, 2, 0
_STATS = "host string, kind int, token long, parent long, v1 long, v2 long, pages long, times long, least long, most long, place long, mass long, linked long, marked boolean, article boolean, holds boolean, one long, other long"


def token_rows(host: str, who: str, page: str) -> list[list]:
    """Occurrences of all tokens of a page: the page itself, its elements and its texts. Last: which page, twice."""
    same = _token("p", page)
    nodes, blocks = parse(page)
    found: dict[tuple[int, int], list] = {}
    for place, x in enumerate(nodes):
        kind = _PATH if place else _PAGE
        f = found.setdefault((kind, x.token), [nodes[x.parent].token if place else 0, 0, place, 0, 0, x.marked, x.article, x.holds])
        f[1] += 1
        f[3] += x.mass
        f[4] += x.linked
    for b in blocks:
        up = nodes[b.node].token
        f = found.setdefault((_TEXT, _token("x", str(up), b.text)), [up, 0, 0, 0, 0, False, nodes[b.node].article, False])
        f[1] += 1
        f[3] += len(b.text)
    rows = []
    for (kind, token), (parent, times, place, mass, linked, marked, article, holds) in found.items():
        h = xxhash.xxh64_intdigest(f"{who} {times}")
        rows.append([host, kind, token, parent, h & 0xFFFFFFFF, h >> 32, 1, times, times, times, place, mass, linked, marked, article, holds, same, same])
    return rows


def token_stats(pages: DataFrame) -> DataFrame:
    """Each token of each host: the fingerprint of its occurrence vector, and sums over the host's pages (a staged table).

    Fingerprints are sums, so repeated rows count like others and tasks add up what they have seen first.
    """

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in _STATS.split(", ")]
        for b in batches:
            got: dict[tuple, list] = {}
            for i, url, page in zip(b["page_id"], b["url"], b["html"], strict=True):
                page = page if isinstance(page, str) else ""
                for r in token_rows(host_of(url), f"{i} {xxhash.xxh64_hexdigest(page.encode('utf-8', 'surrogatepass'))}", page):
                    g = got.get(key := (r[0], r[1], r[2]))
                    if g is None:
                        got[key] = r
                        continue
                    for k in (4, 5, 6, 7, 10, 11, 12):
                        g[k] += r[k]
                    g[8], g[9], g[16], g[17] = min(g[8], r[8]), max(g[9], r[9]), min(g[16], r[16]), max(g[17], r[17])
                    g[13:16] = [x or y for x, y in zip(g[13:16], r[13:16], strict=True)]
            yield pd.DataFrame(list(got.values()), columns=names)

    rows = pages.select("page_id", "url", "html").mapInPandas(counted, _STATS)
    return stage(
        rows.groupBy("host", "kind", "token").agg(
            F.min("parent").alias("parent"), *[F.sum(c).alias(c) for c in ("v1", "v2", "pages", "times", "place", "mass", "linked")],
            F.min("least").alias("least"), F.max("most").alias("most"), F.max("marked").alias("marked"), F.max("article").alias("article"), F.max("holds").alias("holds"),
            F.min("one").alias("one"), F.max("other").alias("other"),
        ),
        "host-tokens",
    )


def deduced(tokens: pd.DataFrame, of: int, whole: int) -> tuple[list[int], list[bool], list[int], list[int]]:
    """The template of a host from its frequent tokens: element tokens, whether their slots go, order, texts."""
    paths = tokens[tokens["kind"] == _PATH]
    texts = tokens.loc[tokens["kind"] == _TEXT, "token"].tolist()
    # Classes: the same vector, verified by pages, times and extremes. Large ones are template.
    same = ["v1", "v2", "pages", "times", "least", "most"]
    size = paths.groupby(same)["token"].transform("size")
    valid = paths[size >= 2].sort_values(["place", "token"])
    # What comes back on other pages counts for all elements around it.
    up = dict(zip(paths["token"], paths["parent"], strict=True))
    repeated = dict.fromkeys(paths["token"], 0)
    for token, own in zip(paths["token"], paths["repeated"], strict=True):
        while token in repeated:
            repeated[token] += int(own)
            token = up[token]
    gone = [goes(*x, repeated[t], whole) for t, *x in zip(*(valid[c].tolist() for c in ("token", "marked", "article", "holds", "mass", "linked")), strict=True)]
    once = valid[(valid["pages"] == of) & (valid["least"] == 1) & (valid["most"] == 1)]
    return valid["token"].tolist(), gone, once["token"].tolist(), texts


def host_templates(pages: DataFrame) -> DataFrame:
    """One row per host with a template: ``host tokens gone once texts`` (a staged table)."""
    stats = token_stats(pages)
    every = stats.filter(F.col("kind") == _PAGE).select("host", F.col("pages").alias("of"), F.col("mass").alias("whole")).filter(F.col("of") >= LEAST_PAGES)
    # Copies of one page say nothing about what comes back.
    back = stats.filter((F.col("kind") == _TEXT) & (F.col("one") != F.col("other"))).groupBy("host", F.col("parent").alias("token")).agg(F.sum("mass").alias("repeated"))
    # Frequent tokens of a host are at most those of two of its pages.
    frequent = stats.filter(F.col("kind") != _PAGE).join(every, "host").filter(
        (F.col("pages") >= LEAST_PAGES)
        & F.when(F.col("kind") == _PATH, F.col("pages") >= F.col("of") * FREQUENT).otherwise((F.col("pages") >= F.col("of") * FREQUENT_TEXT) & (F.col("one") != F.col("other")))
    )
    known = frequent.join(back, ["host", "token"], "left").fillna(0, ["repeated"])

    def deduce(group: pd.DataFrame) -> pd.DataFrame:
        got = deduced(group, int(group["of"].iloc[0]), int(group["whole"].iloc[0]))
        return pd.DataFrame([(group["host"].iloc[0], *got)], columns=["host", "tokens", "gone", "once", "texts"])

    return stage(known.groupBy("host").applyInPandas(deduce, "host string, tokens array<long>, gone array<boolean>, once array<long>, texts array<long>"), "templates")


def extract_page(page: str | None, template: Template | None = None) -> str:
    """The text of a page's slots that are the article's.

    Where nothing else is left, texts that are template stay; an element that no template knows is classed by this page's text.
    """
    nodes, blocks = parse(page or "")
    if template:
        first: dict[int, int] = {}
        for i, x in enumerate(nodes):
            first.setdefault(x.token, i)
        places = [first.get(t, -1) for t in template.order]
        if -1 in places or places != sorted(places):
            template = None
    gone = [False] * len(nodes)
    for i, x in enumerate(nodes[1:], 1):
        known = template.gone.get(x.token) if template else None
        gone[i] = gone[x.parent] or (goes(x.marked, x.article, x.holds, x.mass, x.linked, 0, nodes[0].mass) if known is None else known)
    left = [b for b in blocks if not gone[b.node]]
    kept = [b for b in left if _token("x", str(nodes[b.node].token), b.text) not in template.texts] if template else left
    return "\n".join(b.text for b in kept or left)


def extract_pages(pages: DataFrame) -> DataFrame:
    """One row per page: ``page_id url text n_chars``.

    Null and empty pages give an empty text. A null url belongs to the host with an empty name.
    Repeated rows count and return once each; pages of any length are parsed whole. Ties between tokens
    (the same place) go by their hash. An empty table gives an empty result; other columns are ignored.
    """
    bounded_batches(pages.sparkSession)
    templates = host_templates(pages)
    host = F.lower(F.coalesce(F.regexp_extract("url", r"(?i)^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    joined = pages.select("page_id", "url", "html", host.alias("host")).join(templates, "host", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, template = None, None
        held: dict[str, Template | None] = {}
        for b in batches:
            texts = []
            for host, page, tokens, gone, once, same in zip(*(b[c] for c in ("host", "html", "tokens", "gone", "once", "texts")), strict=True):
                if host != name:
                    if host not in held:
                        held = {} if len(held) > 256 else held
                        held[host] = Template(dict(zip(tokens.tolist(), gone.tolist(), strict=True)), once.tolist(), set(same.tolist())) if tokens is not None else None
                    name, template = host, held[host]
                texts.append(extract_page(page if isinstance(page, str) else "", template))
            yield pd.DataFrame({"page_id": b["page_id"].astype("Int64"), "url": b["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    return joined.mapInPandas(run, "page_id long, url string, text string, n_chars long")


def op6_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
