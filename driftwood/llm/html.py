"""Main text of web pages by tag-path ratios (operator 8).

The text of a page is aggregated by root-to-leaf tag path: characters, punctuation and characters in links, per text node. Text length and
punctuation are smoothed over paths that lie next to each other in the page and fused by their product; what the path's names and links say
weighs it. The paths that reach a share of the highest are the content, in page order, one line a block. Elements that never hold an
article's text (menus, page headers and footers, sidebars, forms, scripts) are left out as the page is read; names of classes only weigh.
Text that a style or an attribute hides is text like any other.
"""

from __future__ import annotations

import html as entities
import math
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from driftwood.llm.common import as_bytes, chunks, table

# HTML's element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript plaintext".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
INLINE = frozenset(
    "a abbr acronym audio b bdi bdo big canvas cite code data del dfn em font i ins kbd label map mark math object output picture q rp rt ruby s samp small span strike strong sub sup svg time tt u var video "
    "annotation g maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot mrow ms msqrt mspace mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics text tspan".split()
)
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
    "tbody": ("tbody", "thead", "tr", "td", "th"), "tfoot": ("tbody", "thead", "tr", "td", "th"), "body": ("head",),
}
CLOSES_P = BLOCK - {"html", "body", "head", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "title", "option", "optgroup", "legend", "summary"}
SCOPE = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "option": ("select",), "tbody": ("table",), "tfoot": ("table",)}
DROPPED = frozenset("script style noscript template title head nav footer aside form button select option textarea iframe noembed noframes menu dialog input datalist".split())
#: Whole class and id names, or all their parts between hyphens, that say "not the article"; those of GENERAL say nothing by themselves.
BOILERPLATE = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright "
    "disclaimer disqus footer footnav gdpr masthead menu menubar nav navbar navigation newsletter notice notices notification overlay pager pagination paywall popup promo promoted "
    "promotion recommend recommended recommendations replies reply respond share sharing sidebar signup sponsor sponsored subscribe subscription toc toolbar "
    "complementary contentinfo alert alertdialog".split()
)
GENERAL = frozenset("area block bottom box container item items left list main page reader right section site top user widget wrap wrapper".split())
ARTICLE = frozenset("article main content entry story post articlebody article-body maincontent main-content post-content entry-content".split())
#: What paths count for: in boilerplate by name; outside the article elements of a page that has some; prose and headings.
BY_NAME, OUTSIDE, PROSE_WEIGHT, LINKS_ONLY = 0.01, 0.01, 3.0, 0.05
#: The share of the highest fused ratio that makes a path content: on a page with an article element, and without one.
SHARE_INSIDE, SHARE_ELSE = 0.04, 0.12
SMOOTH = 3

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'>/=][^\s>/=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*)))?""")
HYPHENS = re.compile(r"[-_]+")
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th figcaption caption summary".split())
PUNCTUATION = re.compile(r"[.,;:!?…。，、！？؟।]")
LEGAL = re.compile(r"\s*(?:©|\(c\)|copyright\b|all rights reserved)", re.I)


@dataclass(slots=True)
class Path:
    """A tag path, by its last step and its parent; weight: what the names on it say."""

    parent: int
    label: str
    article: bool
    weight: float
    prose: bool


@dataclass(slots=True)
class Node:
    """A run of text, the number of the path that it is at, its block, and whether it is in a link."""

    path: int
    text: str
    block: int
    link: bool


@dataclass(slots=True)
class Open:
    tag: str
    path: int
    dropped: bool
    link: bool


def names(attributes: str) -> list[str]:
    """The values of class, id and role, cut at spaces; of two attributes of one name the first counts."""
    if "=" not in attributes:
        return []
    seen: dict[str, str] = {}
    for name, *values in ATTRIBUTE.findall(attributes):
        seen.setdefault(name.lower(), "".join(values))
    said = " ".join(seen.get(x, "") for x in ("class", "id", "role")).lower()
    return (entities.unescape(said) if "&" in said else said).split()


def boilerplate(name: str) -> bool:
    parts = HYPHENS.split(name)
    return not BOILERPLATE.isdisjoint(parts) and all(x in BOILERPLATE or x in GENERAL for x in parts)


class Stack:
    """The open elements. Where the last one of each tag, and the last block, is open is known without a search."""

    def __init__(self):
        self.open = [Open("", 0, False, False)]
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.others: list[int] = []  # what is not inline

    def last(self, *tags: str) -> int:
        """The place of the newest open one of these tags; 0: none."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def push(self, item: Open) -> None:
        k = len(self.open)
        self.open.append(item)
        self.places.setdefault(item.tag, []).append(k)
        if item.tag in BLOCK:
            self.blocks.append(k)
        if item.tag not in INLINE:
            self.others.append(k)

    def pop_to(self, k: int) -> bool:
        """Closes all from place k on; whether a block was among them."""
        for item in self.open[k:]:
            self.places[item.tag].pop()
        del self.open[k:]
        found = bool(self.blocks) and self.blocks[-1] >= k
        for places in (self.blocks, self.others):
            while places and places[-1] >= k:
                places.pop()
        return found


def text_nodes(page: str) -> tuple[list[Node], list[Path]]:
    """All text outside dropped elements, and the page's tag paths, the parents first."""
    stack = Stack()
    paths = [Path(-1, "", False, 1.0, False)]
    numbers: dict[tuple[int, str], int] = {}
    nodes: list[Node] = []
    block, at, n = 0, 0, len(page)

    def add(raw: str) -> None:
        top = stack.open[-1]
        if raw and not top.dropped:
            nodes.append(Node(top.path, entities.unescape(raw) if "&" in raw else raw, block, top.link))

    while at < n:
        m = TOKEN.search(page, at)
        if not m:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        closing, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            if m[0].startswith("<![CDATA["):
                add(m[0][9:-3] if m[0].endswith("]]>") else m[0][9:])
            continue
        tag = tag.lower()
        if closing:
            k = stack.last(tag)
            if k and not (tag in INLINE and stack.blocks and stack.blocks[-1] > k):
                block += stack.pop_to(k)
            if tag == "br":
                add(" ")
            continue
        if tag in VOID:
            if tag == "br":
                add("\n")
            elif tag == "hr":
                block += 1
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at) if tag != "plaintext" else None
            at = end.end() if end else n
            continue
        if tag in CLOSES_P:
            k = stack.last("p")
            if k and k == (stack.others[-1] if stack.others else 0):
                block += stack.pop_to(k)
        if tag in CLOSES:
            k = stack.last(*CLOSES[tag])
            if k and k > stack.last(*SCOPE.get(tag, ())):
                block += stack.pop_to(k)
        if tag in BLOCK:
            block += 1
        top, said = stack.open[-1], names(attributes)
        above = paths[top.path]
        dropped = top.dropped or tag in DROPPED or (tag == "header" and not above.article)
        path = top.path
        # inline marks are no step of a path: they'd split a paragraph's statistics
        if tag not in INLINE and not dropped:
            label = " ".join([tag, *sorted(set(said))])
            path = numbers.get((top.path, label), -1)
            if path < 0:
                path = numbers[top.path, label] = len(paths)
                article = above.article or tag in ("article", "main") or (tag != "body" and not ARTICLE.isdisjoint(said))
                weight = min(above.weight, BY_NAME if any(map(boilerplate, said)) else 1.0)
                paths.append(Path(top.path, label, article, weight, above.prose or tag in PROSE))
        stack.push(Open(tag, path, dropped, top.link or tag == "a"))
    return nodes, paths


@dataclass
class Ratios:
    """Of a path: text nodes, and their characters without spaces, punctuation marks and characters in links."""

    nodes: int = 0
    chars: int = 0
    marks: int = 0
    linked: int = 0
    legal: bool = True


def ratios(nodes: list[Node]) -> dict[int, Ratios]:
    """By path, in the order in which paths first have text."""
    found: dict[int, Ratios] = {}
    for node in nodes:
        chars = sum(map(len, node.text.split()))
        if chars:
            r = found.setdefault(node.path, Ratios())
            r.nodes += 1
            r.chars += chars
            r.marks += len(PUNCTUATION.findall(node.text))
            r.linked += chars * node.link
            r.legal &= bool(LEGAL.match(node.text))
    return found


def smoothed(values: list[float]) -> list[float]:
    """A Gaussian of width 1 over up to SMOOTH neighbours on each side."""
    w = [math.exp(-d * d / 2) for d in range(SMOOTH + 1)]
    out = []
    for i in range(len(values)):
        near = [(w[abs(i - j)], values[j]) for j in range(max(0, i - SMOOTH), min(len(values), i + SMOOTH + 1))]
        out.append(sum(a * b for a, b in near) / sum(a for a, _ in near))
    return out


def fused_ratios(found: dict[int, Ratios], paths: list[Path]) -> dict[int, float]:
    """Smoothed text length times smoothed punctuation of each path, weighted.

    Only paths that their names and the article elements say the same of are smoothed together: an advert gains nothing by standing next to the article.
    """
    some = any(paths[p].article for p in found)
    said = {p: paths[p].weight * (OUTSIDE if some and not paths[p].article else 1.0) for p in found}
    out: dict[int, float] = {}
    for weight in set(said.values()):
        mine = [p for p in found if said[p] == weight]
        length = smoothed([math.log2(1 + found[p].chars / found[p].nodes) for p in mine])
        marks = smoothed([math.log2(2 + found[p].marks / found[p].nodes) for p in mine])
        for p, a, b in zip(mine, length, marks, strict=True):
            r = found[p]
            links = 1.0 if paths[p].article else max(LINKS_ONLY, 1 - r.linked / r.chars)  # an article may hold a list of references
            out[p] = a * b * weight * links * (PROSE_WEIGHT if paths[p].prose else 1.0) * (BY_NAME if r.legal else 1.0)
    return out


def content_paths(nodes: list[Node], paths: list[Path], share: float | None = None) -> set[int]:
    """The paths whose fused ratio reaches `share` of the highest (by default as the page has an article element with text, or not)."""
    found = ratios(nodes)
    fused = fused_ratios(found, paths)
    if share is None:
        share = SHARE_INSIDE if any(paths[p].article for p in found) else SHARE_ELSE
    bar = share * max(fused.values(), default=0.0)
    return {p for p, x in fused.items() if x >= bar}


def main_text(page: str, share: float | None = None) -> str:
    nodes, paths = text_nodes(page)
    chosen = content_paths(nodes, paths, share)
    blocks: dict[int, list[str]] = {}
    for node in nodes:
        if node.path in chosen:
            blocks.setdefault(node.block, []).append(node.text)
    lines = (" ".join("".join(parts).split()) for _, parts in sorted(blocks.items()))
    return "\n".join(x for x in lines if x)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row; null html is empty, a page without content has an empty text.

    Rows are independent: repeated ones stay, other columns are not read, an empty table gives an empty result.
    """

    def run(batches):
        for batch in chunks(batches, 8 << 20):
            texts = [main_text(h.decode("utf-8", "replace")) for h in as_bytes(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
