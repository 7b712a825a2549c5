"""Main text of web pages by tag-path ratios.

Text nodes are grouped by the tag path from the root. A path's ratio is the text per node
on it, raised by the punctuation in that text; the ratios are smoothed over the page
order, fused with the structure (which paths can be content at all), and cut at a
threshold drawn from their own spread; where a page marks its article, only paths inside it
can be. The element that holds all selected nodes is the
article: all of its text is kept but for what is marked as something else inside it. A class
or id that names something else counts only where the ratios of the paths inside are lower
than those of the text around, or far below the page's best.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(?P<close>/?)(?P<tag>[A-Za-z][^\s/>]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*|[^>]*)>", re.DOTALL)
_ATTR = re.compile(r"([A-Za-z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: Elements whose content is no markup: it ends at the end tag alone.
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Never article text, wherever they stand.
DROPPED = frozenset("head script style title template noscript nav footer aside form button select textarea iframe svg canvas object menu dialog xmp noembed noframes option datalist audio video".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form toolbar".split())
#: Words in a class or id that name something other than the article.
DROPPED_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs footer header masthead topbar sidebar aside widget cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription signup login comment comments disqus respond related recommended share sharing social pagination pager search form skip".split()
)
_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: An open element on the left is ended by a start tag on the right, up to the nearest element of the last set.
_SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_PUNCTUATION = re.compile(r"[.,;:!?…。，、]")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: The cut: this share of the spread of the smoothed ratios.
SPREAD = 0.5
#: A path of which more than this share of the text is links is no content unless its ratio is over the cut.
LINKED = 0.5
#: An end tag, or a start tag that ends others, looks at so many open elements at most (a page nested deeper is no page to read).
DEPTH = 512


class _Page:
    """Elements and text nodes of a page. Element 0 is the page; parents come before children."""

    def __init__(self, source: str):
        self.tag, self.parent, self.dropped, self.path, self.named, self.linked = ["#page"], [-1], [False], [0], [False], [False]
        self.paths, self.open = {(-1, "#page"): 0}, {}
        self.text: list[tuple[int, str, bool]] = []  # element, text, whether a block begins here
        self._read(source)

    def _open(self, tag: str, attrs: str, stack: list[int]) -> int:
        up, name, drop, named = stack[-1], tag, tag in DROPPED, False
        if attrs:
            own = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(attrs)}
            words = re.split(r"[^a-z0-9]+", f"{own.get('class', '')} {own.get('id', '')}".lower())
            if tag not in ("html", "body", "main", "article"):
                named = not DROPPED_NAMES.isdisjoint(words)
                drop |= own.get("role", "").lower() in DROPPED_ROLES
                drop |= "hidden" in own or own.get("aria-hidden", "").lower() == "true" or bool(re.search(r"display\s*:\s*none", own.get("style", ""), re.I))
            name = f"{tag}.{own.get('class', '')}"
        if tag == "header":
            drop |= not self.open.get("article") and not self.open.get("main")
        self.tag.append(tag)
        self.linked.append(tag == "a" or self.linked[up])
        self.parent.append(up)
        self.named.append(named)
        self.dropped.append(drop or self.dropped[up])
        self.path.append(self.paths.setdefault((self.path[up], name), len(self.paths)))
        return len(self.tag) - 1

    def _implied_end(self, tag: str, stack: list[int]) -> int:
        """How many open elements stay when this start tag ends others."""
        low = max(0, len(stack) - 1 - DEPTH)
        if tag in _CLOSES_P:
            for k in range(len(stack) - 1, low, -1):
                if self.tag[stack[k]] == "p":
                    return k
                if self.tag[stack[k]] not in INLINE:
                    break
        elif tag in _SIBLINGS:
            ended, bounds = _SIBLINGS[tag]
            keep = len(stack)
            for k in range(len(stack) - 1, low, -1):
                if self.tag[stack[k]] in bounds:
                    break
                if self.tag[stack[k]] in ended:
                    keep = k
                    if tag != "tr":
                        break
            return keep
        return len(stack)

    def _cut(self, stack: list[int], keep: int) -> None:
        for e in stack[keep:]:
            self.open[self.tag[e]] -= 1
        del stack[keep:]

    def _read(self, source: str) -> None:
        stack, at, block, last = [0], 0, True, source.rfind(">")
        while True:
            # Behind the last ">" nothing is a tag; without that look a page of open tags would be tried from each of them to its end.
            m = _TOKEN.search(source, at) if at <= last or source.find("<!--", at) >= 0 else None
            chunk = source[at : m.start()] if m else source[at:]
            if chunk and not self.dropped[stack[-1]]:
                self.text.append((stack[-1], chunk, block))
                block = False
            if not m:
                return
            at, tag = m.end(), (m["tag"] or "").lower()
            if not tag:
                continue
            if tag not in INLINE:
                block = True
            if m["close"]:
                if self.open.get(tag):
                    k = len(stack) - 1
                    while self.tag[stack[k]] != tag:
                        k -= 1
                    self._cut(stack, k)
                continue
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
                at = end.end() if end else len(source)
                continue
            if tag in VOID:
                continue
            self._cut(stack, self._implied_end(tag, stack))
            stack.append(self._open(tag, m["attrs"], stack))
            self.open[tag] = self.open.get(tag, 0) + 1


def path_ratios(path: list[int], length: list[int], punctuation: list[int]) -> np.ndarray:
    """The ratio of the path of each text node, given its path and its own counts."""
    p = np.array(path)
    per_path = [np.bincount(p, np.array(x, dtype=float)) for x in (length, punctuation, np.ones(len(p)))]
    nodes = np.maximum(per_path[2], 1)
    fused = per_path[0] / nodes * (1 + per_path[1] / nodes)
    return fused[p]


def path_scores(path: list[int], length: list[int], punctuation: list[int]) -> np.ndarray:
    """The smoothed and fused ratio of each text node."""
    padded = np.pad(path_ratios(path, length, punctuation), 1, mode="edge")
    return (padded[:-2] + 2 * padded[1:-1] + padded[2:]) / 4


def _without_named(page: _Page, texts: list[tuple[int, str, bool]]) -> list[tuple[int, str, bool]]:
    """The texts but for those in elements named as something else whose best path ratio is below that of the text around, or far below the page's best."""
    if not any(page.named):
        return texts
    n = len(page.tag)
    owner = [0] * n  # the innermost named element
    for e in range(1, n):
        owner[e] = e if page.named[e] else owner[page.parent[e]]
    seen = [(e, page.path[e], len(s), len(_PUNCTUATION.findall(s))) for e, t, _ in texts if (s := t.strip())]
    own = [-1.0] * n
    if seen:
        for (e, *_), ratio in zip(seen, path_ratios([x[1] for x in seen], [x[2] for x in seen], [x[3] for x in seen]), strict=True):
            own[owner[e]] = max(own[owner[e]], float(ratio))
    inside = list(own)
    for e in range(n - 1, 0, -1):
        if page.named[e]:
            up = owner[page.parent[e]]
            inside[up] = max(inside[up], inside[e])
    around, gone, least = list(own), [False] * n, SPREAD * max(own)
    for e in range(1, n):
        up = owner[page.parent[e]]
        if page.named[e]:
            gone[e] = gone[up] or inside[e] < max(around[up], least)
            around[e] = max(own[e], around[up])
    kept, begins = [], False
    for e, text, new in texts:
        begins |= new
        if not gone[owner[e]]:
            kept.append((e, text, begins))
            begins = False
    return kept


def extract(source: str | None) -> str:
    """The main text of one page; empty where there is none."""
    page = _Page(source or "")
    texts = _without_named(page, [(e, html.unescape(t), new) for e, t, new in page.text])
    within = [False] * len(page.tag)
    for e in range(1, len(within)):
        within[e] = page.tag[e] in ("article", "main") or within[page.parent[e]]
    if any(within[e] and t.strip() for e, t, _ in texts):  # a page that marks its article has no content paths outside it
        texts = [x for x in texts if within[x[0]]]
    seen = [(page.path[e], e, len(s), len(_PUNCTUATION.findall(s))) for e, t, _ in texts if (s := t.strip())]
    if not seen:
        return ""
    path, element, length, marks = (list(x) for x in zip(*seen, strict=True))
    scores = path_scores(path, length, marks)
    by_path = np.bincount(path, scores) / np.maximum(np.bincount(path), 1)
    chosen = by_path >= min(SPREAD * scores.std(), by_path.max())
    held = np.zeros(len(page.tag))
    for p, e, n in zip(path, element, length, strict=True):
        if chosen[p] or within[e] and page.tag[e] in HEADINGS:
            held[e] += n
    for e in range(len(held) - 1, 0, -1):
        held[page.parent[e]] += held[e]
    article = 0
    for e in range(1, len(held)):  # the deepest element that holds all of it
        if page.tag[e] not in INLINE and page.tag[e] != "p" and held[e] == held[0]:
            article = e
    inside = np.zeros(len(held), dtype=bool)
    inside[article] = True
    for e in range(article + 1, len(held)):
        inside[e] = inside[page.parent[e]]
    # Of the paths inside, those under the cut stay unless they are mostly links (a list of them, not a link in a sentence).
    in_links = np.bincount(path, np.array(length) * np.array([page.linked[e] for e in element])) / np.maximum(np.bincount(path, length), 1)
    gone = {k for k in range(len(by_path)) if not chosen[k] and in_links[k] > LINKED}
    sentence = [False] * len(held)  # elements with selected text of their own around the link
    for p, e in zip(path, element, strict=True):
        if chosen[p]:
            sentence[e] = True
    for e in range(1, len(held)):
        if page.linked[e] or page.tag[e] in INLINE:
            sentence[e] = sentence[e] or sentence[page.parent[e]]
    for p, e in zip(path, element, strict=True):
        if p in gone and not sentence[e] and page.tag[e] not in HEADINGS:
            inside[e] = False
    blocks: list[str] = []
    for e, text, new in texts:
        if inside[e]:
            if new or not blocks:
                blocks.append(text)
            else:
                blocks[-1] += text
        elif blocks:
            blocks.append("")
    return " ".join(" ".join(blocks).split())


def extract_table(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page, from its whole html.

    Null and empty pages, and pages without an article, have an empty text; repeated rows
    repeat, null ids and urls stay null, an empty table gives an empty result, further
    columns are ignored. Reading a page is linear in its length.
    """

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [extract(x) for x in part.column(2).to_pylist()]
                columns = [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    cols = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return cols.mapInArrow(run, "page_id long, url string, text string, n_chars long")
