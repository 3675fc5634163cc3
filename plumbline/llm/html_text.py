"""Main text of web pages by tag-path ratios.

A lenient pass over the markup yields the page's text blocks, each with its
root-to-leaf tag path (tags of block elements with their class; inline elements
are no steps). Then, page by page:

1. *Aggregate.* Each path has the number, length and punctuation of its blocks; its
   raw ratio is the product of mean length and mean punctuation (plus one).
   Paths through elements that are listed as not carrying article text (navigation,
   header, footer, aside, or a class, id or role that names an advert, notice,
   sidebar or reader comments) have their raw ratio multiplied by ``listed``.
2. *Smooth.* Paragraphs, headings, lists and tables are steps within a container.
   A container has the mean raw ratio of its paths, by length, and is raised to
   what the subtrees have that it belongs to: by all of it below an article or main
   element or one without listed parts, else by the share of the path in common.
   What all paths of the page have in common counts for nothing.
3. *Fuse.* The ratio of a path is that of its container, or the mean of both if its
   own is greater.
4. *Threshold.* The paths whose ratio reaches ``share`` of the page's mean, by
   length, are content, and all their blocks are the text, in page order.

Scripts, styles, forms and other elements that hold no text are not read. Blocks
are decoded, their white space becomes one space, and they are joined by one line
feed; nothing else is dropped or shortened. A line break tag is white space. Time
and memory are of the order of the page, however deep its elements are nested.

Nulls and edges: a null, empty or text-free page has an empty text, as has one whose
text is all listed; unclosed, misnested and truncated markup is read as far as it
goes; parts with equal ratios, such as two articles, all stay; repeated rows are
read each. Columns besides page_id, url and html are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import table

MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<[/a-zA-Z](?:[^>"']|"[^"]*(?:"|\Z)|'[^']*(?:'|\Z))*\Z""", re.DOTALL)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that hold no text of the page, and elements that are parts around an article.
NO_TEXT = frozenset("head form script style noscript iframe template svg canvas object audio video button select option textarea input dialog title math".split())
AROUND = frozenset("nav header footer aside menu".split())
#: What an element with such a word in its class, id or role is not part of the article.
NO_ARTICLE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar nav navbar navigation menu breadcrumb breadcrumbs header footer masthead cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login comment comments disqus replies respond related recommended share sharing social widget toolbar pagination pager copyright complementary contentinfo search".split()
)
#: Names such as no-sidebar or has-comments tell what a page holds, not what the element is.
ABOUT_OTHERS = re.compile(r"\b(?:no|has|with|without)[-_][a-z0-9_-]+")
OUTER = frozenset("html body article main".split())
#: Steps within a container.
FLOW = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table caption thead tbody tfoot tr td th figure figcaption details summary".split())
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
PUNCTUATION = re.compile(r"""[.,;:!?…](?=[\s"')\]”’»]|\Z)|[。、，；：！？]""")


def _listed(tag: str, attributes: str) -> tuple[bool, bool, str]:
    """Whether an element is listed as around the article, whether it is hidden, and its class."""
    around, hidden, classes = tag in AROUND, False, ""
    for name, *values in ATTRIBUTE.findall(attributes) if attributes and tag not in OUTER else ():
        name, value = name.lower(), "".join(values).lower()
        if name == "class":
            classes = value
        if name in ("class", "id", "role") and not NO_ARTICLE.isdisjoint(re.split(r"[^a-z0-9]+", ABOUT_OTHERS.sub("", value))):
            around = True
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            hidden = True
    return around, hidden, classes


@dataclass
class Paths:
    """The tag paths of a page as a tree: parents come before children, the root is 0."""

    parent: list[int] = field(default_factory=lambda: [0])
    tag: list[str] = field(default_factory=lambda: [""])
    listed: list[bool] = field(default_factory=lambda: [False])
    known: dict[tuple[int, str, str, bool], int] = field(default_factory=dict)

    def step(self, parent: int, tag: str, classes: str, listed: bool) -> int:
        key = parent, tag, classes, listed
        if key not in self.known:
            self.known[key] = len(self.parent)
            self.parent.append(parent)
            self.tag.append(tag)
            self.listed.append(listed or self.listed[parent])
        return self.known[key]


def blocks(page: str) -> tuple[Paths, list[tuple[int, str]]]:
    """The tag paths of a page, and (path, text) of each of its text blocks."""
    paths, out = Paths(), []
    stack: list[tuple[str, int | None]] = []  # tag and path of the open elements; None: nothing in it is read
    still_open: Counter[str] = Counter()
    words: list[str] = []
    at = 0

    def path() -> int | None:
        return stack[-1][1] if stack else 0

    def flush() -> None:
        text = " ".join(html.unescape("".join(words)).split())
        words.clear()
        if text and path() is not None:
            out.append((path(), text))

    def pop(k: int) -> None:
        below = stack[k - 1][1] if k else 0
        if any(t not in INLINE or p != below for t, p in stack[k:]):
            flush()
        still_open.subtract(t for t, _ in stack[k:])
        del stack[k:]

    while found := MARKUP.search(page, at):
        if found.start() > at:
            words.append(page[at : found.start()])
        at = found.end()
        tag = (found[2] or "").lower()
        if not tag:
            continue
        if found[1]:
            if still_open[tag] > 0:
                pop(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag))
            elif tag not in INLINE:
                flush()
            continue
        if tag == "br":
            words.append(" ")
        if tag in VOID:
            if tag not in INLINE:
                flush()
            continue
        if tag in RAW:
            end = re.compile(f"</{tag}[\\s/>]", re.IGNORECASE).search(page, at)
            at = end.start() if end else len(page)
            stop = MARKUP.match(page, at)
            at = stop.end() if stop else len(page)
            continue
        if tag not in INLINE:
            closing = CLOSES.get(tag, ("p",))
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in closing:
                    pop(i)
                elif stack[i][0] not in INLINE and stack[i][0] != "p" or not any(still_open[t] > 0 for t in closing):
                    break
            flush()
        inside = path()
        around, hidden, classes = _listed(tag, found[3])
        if inside is None or hidden or tag in NO_TEXT:
            now = None
        elif around or tag not in INLINE:
            now = paths.step(inside, tag, classes, around)
        else:
            now = inside
        if now != inside:
            flush()
        stack.append((tag, now))
        still_open[tag] += 1
    words.append(page[at:])
    flush()
    return paths, out


def path_ratios(paths: Paths, found: list[tuple[int, str]], listed: float) -> dict[int, float]:
    """The smoothed and fused ratio of each path that has blocks."""
    size = len(paths.parent)
    number, length, marks = Counter(p for p, _ in found), Counter(), Counter()
    for p, text in found:
        length[p] += len(text)
        marks[p] += len(PUNCTUATION.findall(text))
    raw = {p: length[p] / n * (1 + marks[p] / n) * (listed if paths.listed[p] else 1.0) for p, n in number.items()}
    container = list(range(size))
    for p in range(1, size):
        if paths.tag[p] in FLOW:
            container[p] = container[paths.parent[p]]
    own, below = [[0.0, 0.0] for _ in range(size)], [[0.0, 0.0, 0.0] for _ in range(size)]
    for p, r in raw.items():
        weight = length[p]
        for sums in (own[container[p]], below[container[p]]):
            sums[0] += weight
            sums[1] += weight * r
        below[container[p]][2] += weight * (paths.listed[p] and listed < 1)
    children: list[list[int]] = [[] for _ in range(size)]
    for p in range(size - 1, 0, -1):
        up = below[paths.parent[p]]
        if below[p][0]:
            children[paths.parent[p]].append(p)
        for i, x in enumerate(below[p]):
            up[i] += x
    top = 0  # the lowest path that all containers have in common
    while not own[top][0] and len(children[top]) == 1:
        top = children[top][0]
    smooth = {top: own[top][1] / own[top][0] if own[top][0] else 0.0}
    todo = [(c, 1, 0.0, 0.0) for c in children[top]]
    while todo:
        p, depth, whole, shared = todo.pop()
        weight, total, apart = below[p]
        if paths.tag[p] in ("article", "main") or not apart:
            whole = max(whole, total / weight)
        shared = max(shared, depth * total / weight)
        if own[p][0]:
            smooth[p] = (own[p][1] / own[p][0] + max(whole, shared / depth)) / 2 if not (paths.listed[p] and listed < 1) else own[p][1] / own[p][0]
        todo += [(c, depth + 1, whole, shared) for c in children[p]]
    return {p: max(smooth[container[p]], (smooth[container[p]] + r) / 2) for p, r in raw.items()}


def main_text(page: str, share: float = 0.4, listed: float = 0.0) -> str:
    paths, found = blocks(page)
    ratios = path_ratios(paths, found, listed)
    mean = sum(len(text) * ratios[p] for p, text in found) / max(1, sum(len(text) for _, text in found))
    return "\n".join(text for p, text in found if ratios[p] >= share * mean and ratios[p] > 0)


def _extract(batches):
    for batch in batches:
        texts = [main_text(page) if page else "" for page in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string")


def op5_html_text(spark, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
