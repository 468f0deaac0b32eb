"""Main text of web pages: gradient-boosted trees over DOM-node features, decoded down the tree.

A page becomes the tree of its block elements; inline markup, comments, scripts and styles make no nodes. Every node
gets features of its own, its subtree, its ancestors and its siblings; trees give the probability that it is part of
the article or holds it. Decoding picks the likeliest labelling in which nothing is kept below a dropped node.

The trees learn from pages of the table itself that have an article element: what stands in it is kept. To carry over
to pages without such elements, the sample's pages are also rewritten with other tags and class names, with sidebars,
comments, notices and forms around and inside the article, and with tables, captions, summaries and quotations in it. Some made-up pages are always learned from as well,
so that a table without any article element has a model too.
"""

from __future__ import annotations

import html as entities
import random
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gameline.llm import trees
from gameline.llm.common import table, text_batches

#: Pages that the trees are fitted on: of those of at most SAMPLE_BYTES with an article, the smallest hashes of their html.
SAMPLE, SAMPLE_BYTES = 300, 200_000
#: Made-up pages that the trees are fitted on besides.
MADE = 40
#: A tag's attributes. Quotes count after an equals sign only; one that is never closed runs to the end of the page. Neither
#: this nor the names before it are given back, so that a tag is read once.
_ATTRIBUTES = r"(?:=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))|[^>])*+"
_BLOCKS = "p|div|section|article|main|aside|nav|header|footer|form|ul|ol|li|dl|dt|dd|table|tr|td|th|h[1-6]|blockquote|pre|figure|body|html"
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    # raw text, which only its own end tag or the page's end closes
    rf"|<(script|style|noscript|template|iframe|title|textarea)\b{_ATTRIBUTES}>.*?(?:</\1\s*>|\Z)"
    rf"|<(/?)([a-zA-Z][^\s/>]*+)({_ATTRIBUTES})(?:>|\Z)|<[!?][^>]*(?:>|\Z)|</[^>]*(?:>|\Z)",
    re.S | re.I,
)
#: Controls and drawings go with what they hold if they are closed before the next block; else their tag counts for nothing.
_CONTROLS = ("svg", "select", "button", "object", "canvas", "video", "audio")
_ENDS = re.compile(rf"</?(?:{_BLOCKS})\b|</({'|'.join(_CONTROLS)})\s*>", re.I)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
#: Marks a training label in a rewritten page; pages themselves are learned from without this character.
_MARK = "\0"
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")
_GROUPS = (("article", "main"), ("nav", "menu"), ("footer",), ("header",), ("aside",), ("form",
    "fieldset", "label", "legend", "dialog"), ("p", "blockquote", "pre", "figure", "figcaption"), ("h1",
    "h2", "h3", "h4", "h5", "h6", "hgroup"), ("ul", "ol", "li", "dl", "dt", "dd"), ("table", "thead",
    "tbody", "tfoot", "tr", "td", "th", "caption"), ("div", "section", "details", "summary",
    "center", "address", "hr"), ("html", "body"), ("head",))
_GROUP = {tag: i for i, tags in enumerate(_GROUPS) for tag in tags}
_WORDS = (
    ("article", "post", "content", "main", "entry", "story", "body", "text", "page", "prose"),
    ("nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "pagination", "pager", "toc", "tabs", "skip"),
    ("footer", "foot", "copyright", "legal", "header", "masthead", "topbar", "banner", "contentinfo"),
    ("sidebar", "side", "aside", "widget", "rail", "complementary", "related", "recommended", "more", "teaser", "tags"),
    ("ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "promotion", "adsense"),
    ("comment", "comments", "reply", "replies", "discussion", "disqus", "respond", "reviews"),
    ("cookie", "cookies", "consent", "notice", "alert", "popup", "modal", "overlay", "gdpr", "banner", "newsletter", "subscribe", "paywall"),
    ("form", "search", "login", "signup", "share", "social", "follow", "button", "toolbar"),
)
_WORD = {w: [i for i, ws in enumerate(_WORDS) if w in ws] for ws in _WORDS for w in ws}
_ENDS_P = set(_GROUP) - {"html", "body", "head", "label", "legend", "caption"}
_SIBLINGS = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"},
    {"tr", "table"})}


def _control_ends(source: str):
    """A function from a control's tag and the end of its opening tag to the end of its closing one, where that comes before
    the next block's tag; else to the same place. The page is read once."""
    blocks: list[int] = []
    ends: dict[str, list[tuple[int, int]]] = {}
    for m in _ENDS.finditer(source):
        if m.group(1):
            ends.setdefault(m.group(1).lower(), []).append(m.span())
        else:
            blocks.append(m.start())

    def end(tag: str, at: int) -> int:
        own = ends.get(tag, [])
        i, j = bisect_left(own, (at, 0)), bisect_left(blocks, at)
        return own[i][1] if i < len(own) and (j == len(blocks) or own[i][0] < blocks[j]) else at

    return end


class Forest:
    """Block elements and text blocks of many pages; a parent's number is smaller than its children's."""

    def __init__(self, training: bool = False) -> None:
        self.training = training
        self.page, self.parent, self.depth, self.group, self.words, self.label = [], [], [], [], [], []
        self.link, self.tags = [], []
        self.end: list[int] = []  # the number after the last one of the subtree
        self.blocks: list[tuple[int, str]] = []  # node, text

    def node(self, page: int, parent: int, tag: str, attributes: str) -> int:
        hits, label = 0, -1
        if attributes:
            if self.training and _MARK in attributes:
                label = int(attributes[attributes.index(_MARK) + 1])
            for _, a, b, c in _ATTRIBUTE.findall(attributes):
                for w in _SPLIT.split((a or b or c).lower()):
                    for i in _WORD.get(w, ()):
                        hits |= 1 << i
        self.page.append(page)
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.group.append(_GROUP[tag])
        self.words.append(hits)
        self.label.append(label if label >= 0 else 1 if tag == "article" else -1)
        self.link.append(0)
        self.tags.append(1)
        self.end.append(0)
        return len(self.page) - 1

    def add(self, page: int, source: str) -> None:
        root = self.node(page, -1, "html", "")
        stack: list[tuple[str, int]] = [("html", root)]
        places: dict[str, list[int]] = {}  # of the open elements of each tag, in the stack
        run: list[str] = []
        links = at = 0
        skips = None

        def last(tags) -> int:
            return max((places[t][-1] for t in tags if places.get(t)), default=0)

        def close(i: int) -> None:
            """Closes the element at place i and those in it."""
            while len(stack) > i:
                tag, node = stack.pop()
                places[tag].pop()
                self.end[node] = len(self.page)

        def flush() -> None:
            if run:
                text = " ".join(entities.unescape("".join(run)).split())
                if text:
                    self.blocks.append((stack[-1][1], text))
                run.clear()

        while m := _TOKEN.search(source, at):
            if m.start() > at:
                run.append(source[at : m.start()])
                if links:
                    self.link[stack[-1][1]] += m.start() - at
            at = m.end()
            tag = m.group(3)
            if tag is None:
                continue
            tag, closing = tag.lower(), m.group(2)
            if tag not in _GROUP:
                if tag in _CONTROLS and not closing and not m.group(4).endswith("/"):
                    skips = _control_ends(source) if skips is None else skips
                    at = skips(tag, at)
                    if at > m.end():
                        continue
                if tag == "br":
                    run.append(" ")
                elif tag == "a":
                    links = 0 if closing else 1
                self.tags[stack[-1][1]] += not closing
                continue
            flush()
            links = 0
            if tag in ("html", "hr"):
                continue
            if closing:
                if places.get(tag):
                    close(places[tag][-1])
                continue
            if tag in _ENDS_P or tag == "body":
                open_p = last(("p",))
                if open_p > last(("table", "td", "th", "caption")):
                    close(open_p)
            if tag == "body" and stack[-1][0] == "head":
                close(len(stack) - 1)
            if tag in _SIBLINGS:
                ends, scope = (last(x) for x in _SIBLINGS[tag])
                if ends > scope:
                    close(ends)
            places.setdefault(tag, []).append(len(stack))
            stack.append((tag, self.node(page, stack[-1][1], tag, m.group(4))))
        if at < len(source):
            run.append(source[at:])
        flush()
        close(1)
        self.end[root] = len(self.page)

    def arrays(self) -> None:
        self.page, self.parent, self.depth, self.end = (np.array(x) for x in (self.page, self.parent, self.depth, self.end))
        # nodes of each depth, deepest first
        order = np.argsort(-self.depth, kind="stable")
        cuts = np.flatnonzero(np.diff(-self.depth[order])) + 1
        self.levels = np.split(order, cuts) if len(order) else []

    def up(self, own: np.ndarray) -> np.ndarray:
        """Sums over subtrees, which are runs of numbers; of whole numbers, so that they are exact."""
        total = np.concatenate([[0.0], np.cumsum(own, dtype=np.float64)])
        return total[self.end] - total[:-1]

    def down(self, own: np.ndarray) -> np.ndarray:
        """1 where the node or one that holds it has a 1, for each column."""
        change = np.concatenate([own, np.zeros((1, own.shape[1]))])
        np.subtract.at(change, self.end, own)
        return (np.cumsum(change, axis=0)[:-1] > 0).astype(np.float64)

    def features(self) -> np.ndarray:
        n = len(self.page)
        group, words = np.array(self.group), np.array(self.words)
        size, stops, blocks = np.zeros(n), np.zeros(n), np.zeros(n)
        for node, text in self.blocks:
            size[node] += len(text)
            stops[node] += text.count(".") + text.count(",")
            blocks[node] += 1
        text, link, stop, tags, block = (self.up(x) for x in (size, np.array(self.link), stops, np.array(self.tags), blocks))
        link = np.minimum(link, text)
        paragraphs, items = self.up(group == 6), self.up(group == 8)
        hit = np.stack([(words >> i) & 1 for i in range(len(_WORDS))], axis=1).astype(np.float64)
        kind = np.stack([group == i for i in range(len(_GROUPS))], axis=1).astype(np.float64)
        above = self.down(np.concatenate([hit, kind[:, :6]], axis=1))  # of the node and its ancestors
        parent = np.maximum(self.parent, 0)
        siblings = np.bincount(parent, minlength=n)[parent].astype(np.float64)
        first = np.full(n, n)
        np.minimum.at(first, parent, np.arange(n))
        last = np.zeros(n, dtype=np.int64)
        np.maximum.at(last, parent, np.arange(n))
        root = np.flatnonzero(self.parent < 0)[np.cumsum(self.parent < 0) - 1]
        whole = np.maximum(text[root], 1)
        return np.column_stack([kind, hit, above, self.depth, np.log1p(text), np.log1p(size), link / np.maximum(text,
            1), np.log1p(paragraphs), np.log1p(items), np.log1p(tags), text / tags, stop / np.maximum(text,
            1), text / np.maximum(block, 1), siblings, (np.arange(n) - first[parent]) / np.maximum(last[parent] - first[parent],
            1), text / whole, text / np.maximum(text[parent], 1)])

    def decode(self, p: np.ndarray) -> np.ndarray:
        """The likeliest labels in which every kept node's parent is kept; the root is kept."""
        p = np.clip(p, 1e-6, 1 - 1e-6)
        keep, drop = np.log(p), np.log(1 - p)
        for level in self.levels[:-1]:
            np.add.at(keep, self.parent[level], np.maximum(keep[level], drop[level]))
            np.add.at(drop, self.parent[level], drop[level])
        kept = keep >= drop
        for level in self.levels[::-1]:
            kept[level] = np.where(self.parent[level] < 0, True, kept[level] & kept[np.maximum(self.parent[level], 0)])
        return kept

    def labels(self) -> np.ndarray:
        """1 inside a marked element unless a nearer one is marked 0, and for what holds a node labelled so."""
        own = np.array(self.label)
        inside = np.where(own >= 0, own, 0)
        for level in self.levels[::-1][1:]:
            inside[level] = np.where(own[level] >= 0, own[level], inside[self.parent[level]])
        return (self.up(inside) > 0).astype(np.float64)


def _rewritten(source: str, others: list[str], rng: random.Random) -> str:
    """The page with other names for its parts and with furniture made of other pages' sentences."""

    def sentence() -> str:
        return rng.choice(others)

    def extra() -> str:
        kind = rng.randrange(7)
        links = "".join(f'<li><a href="#">{" ".join(sentence().split()[:4])}</a></li>' for _ in range(rng.randrange(2, 6)))
        open_, close = rng.choice([("aside", "aside"), ("div", "div"), ("section", "section")])
        name = rng.choice([("sidebar", "widget", "related"), ("comments", "comment", "reply"), ("cookie-notice",
            "alert", "newsletter"), ("share", "social", "search"), ("ad", "promo", "sponsored")][kind % 5])
        if kind == 0:
            return f'<{open_} class="{name}" {_MARK}0><h3>{" ".join(sentence().split()[:3])}</h3><ul>{links}</ul></{close}>'
        if kind == 1:
            return f'<section class="comments" {_MARK}0>' + "".join(f'<div class="comment"><p>{sentence()}</p></div>' for _ in range(rng.randrange(1,
                4))) + "</section>"
        if kind == 2:
            return f'<form action="/s" {_MARK}0><label>{" ".join(sentence().split()[:2])}</label><input name="q"><p>{sentence()}</p></form>'
        if kind == 3:
            return f'<aside {_MARK}0><p>{sentence()}</p><ul>{links}</ul></aside>'
        return f'<div class="{name}" {_MARK}0><p>{sentence()}</p></div>'

    def part() -> str:
        """What articles hold besides paragraphs and lists."""
        few = [" ".join(sentence().split()[:3]) for _ in range(8)]
        rows = "".join(f"<tr><th>{a}</th><td>{b}</td></tr>" for a, b in zip(few[:4], few[4:], strict=True))
        return rng.choice([f'<table{rng.choice(["", " class=infobox", " class=data"])}>{rows}</table>',
            f"<figure><img src=a.png><figcaption>{sentence()}</figcaption></figure>",
            f"<details><summary>{few[0]}</summary><p>{sentence()}</p></details>",
            f"<dl><dt>{few[0]}</dt><dd>{sentence()}</dd><dt>{few[1]}</dt><dd>{few[2]}</dd></dl>",
            f"<blockquote><p>{sentence()}</p></blockquote>", f"<h2>{few[0]}</h2><pre>{few[1]}</pre>"])

    nav = rng.choice(["nav", "menu", "navbar", "breadcrumbs"])
    source = source.replace("<nav>", f'<div class="{nav}">').replace("</nav>", "</div>") if rng.random() < 0.6 else source
    foot = rng.choice(["footer", "site-footer", "copyright"])
    source = source.replace("<footer>", f'<div id="{foot}">').replace("</footer>", "</div>") if rng.random() < 0.6 else source
    source = source.replace('class="ad"', f'class="{rng.choice(["advert", "promo", "sponsored", "ads banner", "ad-slot"])}"')
    if rng.random() < 0.3:
        source = source.replace("<nav>", f'<header><p>{sentence()}</p></header><nav>', 1)
    inner = extra() if rng.random() < 0.4 else ""
    parts = [part() for _ in range(rng.randrange(1, 4))] if rng.random() < 0.6 else []
    first, rest = "".join(parts[:1]) if rng.random() < 0.5 else "", "".join(parts[1:] or parts)
    after = extra() + (extra() if rng.random() < 0.5 else "")
    open_, close = rng.choice([("<article", "</article>"), ("<main", "</main>"), ('<div class="post-content"',
        "</div>"), ('<div id="content"', "</div>"), ("<div", "</div>"), ('<section class="entry"',
        "</section>")])
    before = extra() if rng.random() < 0.4 else ""
    # functions, so that backslashes of the page's text stay as they are
    source = re.sub(rf"<article\b{_ATTRIBUTES}>", lambda _: f"{before}{open_} {_MARK}1>{first}", source, count=1, flags=re.I)
    return re.sub(r"</article\s*>", lambda _: f"{rest}{inner}{close}{after}", source, count=1, flags=re.I)


def made_pages(n: int, rng: random.Random) -> list[str]:
    """Pages of invented words with a menu, an advert, an article and a footer."""

    def words(least: int, most: int) -> str:
        return " ".join("".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(rng.randrange(1,
            4))) for _ in range(rng.randrange(least, most)))

    def sentences(most: int) -> str:
        return " ".join(f"{words(4, 14).capitalize()}." for _ in range(rng.randrange(1, most)))

    out = []
    for _ in range(n):
        menu = "".join(f'<li><a href="/{i}">{words(1, 3)}</a></li>' for i in range(rng.randrange(3, 8)))
        text = "".join(f"<p>{sentences(6)}</p>" for _ in range(rng.randrange(1, 9)))
        list_ = f"<ul><li>{words(3, 9)}</li><li>{words(3, 9)}</li></ul>" if rng.random() < 0.3 else ""
        out.append(f'<html><head><title>x</title></head><body><nav><ul>{menu}</ul></nav><div '
            f'class="ad">{words(3, 9)}</div><article><h1>{words(2, 8)}</h1>{text}{list_}</article><footer>&copy; '
            f'{words(2, 9)}.</footer></body></html>')
    return out


def fit(pages: list[str], seed: int = 11) -> dict:
    """Trees from the pages with an article, made-up ones, and two rewritten copies of each."""
    rng = random.Random(seed)
    pages = [p.replace(_MARK, "") for p in pages if re.search(r"<article\b", p, re.I)] + made_pages(MADE, rng)
    others = [t for page in pages for t in re.findall(r"<p>([^<]{40,300})", page)][:5000]
    forest = Forest(training=True)
    for i, page in enumerate(pages):
        forest.add(i, page)
        for _ in range(2):
            forest.add(i, _rewritten(page, others, rng))
    forest.arrays()
    return trees.fit(forest.features(), forest.labels(), rounds=50, depth=4, rate=0.2)


def main_texts(pages: list[str | None], model: dict) -> list[str]:
    forest = Forest()
    for i, page in enumerate(pages):
        if page:
            forest.add(i, page)
    out: list[list[str]] = [[] for _ in pages]
    if forest.page:
        forest.arrays()
        kept = forest.decode(trees.predict(model, forest.features()))
        for node, text in forest.blocks:
            if kept[node]:
                out[forest.page[node]].append(text)
    return ["\n".join(x) for x in out]


def _extract(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, "html", 2 << 20):
            text = pa.array(main_texts(batch.column("html").to_pylist(), model.value), pa.string())
            yield pa.record_batch({**{c: batch.column(c) for c in batch.schema.names if c != "html"}, "text": text})

    return run


def extract_pages(pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The columns of pages but html, with text and n_chars (code points of text); one row for each row of pages.

    Null and empty html gives an empty text; so does a page without a kept block. Blocks follow page order, joined by
    line feeds, with white space inside as one space and character references decoded. Markup that is cut off at the
    end is dropped with its tag; an element that is never closed loses its tag, not the text after it. Repeated rows
    have equal texts. At most SAMPLE pages are learned from, none of them longer than SAMPLE_BYTES. Columns of pages named text or n_chars are replaced; an empty table gives no rows.
    """
    fits = F.col("html").rlike("(?i)<article\\b") & (F.octet_length("html") <= SAMPLE_BYTES)
    chosen = pages.where(fits).orderBy(F.xxhash64(F.col("html")), "html").limit(sample).select("html")
    model = pages.sparkSession.sparkContext.broadcast(fit([r["html"] for r in chosen.toLocalIterator()]))
    pages = pages.drop("text", "n_chars").withColumn("html", F.col("html").cast("string"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema if f.name != "html")
    return pages.mapInArrow(_extract(model), f"{schema}, text string").withColumn("n_chars", F.length("text").cast("long"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
