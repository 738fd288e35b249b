"""Main text of web pages by tag-path ratios.

A page is read as a tag soup into blocks: runs of text between block-level tags, each with its
root-to-leaf tag path. Text length and punctuation are summed for each path; the length ratio (text per block) and the
punctuation ratio (marks per block) of a path are smoothed with those of the paths beside it and fused by multiplication, with a prior.
Paths above a threshold (a part of the spread over blocks) are content. Content blocks are the article, and so are the other blocks
of the smallest container that holds nearly all of them, headings and short lines say, if their prior is whole, and a title before it.

The prior is whole but for parts that by element, role or name are never the article (menus, headers, footers, sidebars, notices, adverts, forms, reader
comments): none for elements and roles, little for names; and little outside <article> or <main>. A paragraph or heading is named only by a word of class or id of which half
the parts are such names. Inline elements are named only where they are the whole of their block, so a sentence never loses words. What ratios
without a prior say decides whether these hints hold: a part that has WRAPPER of the content is no side part (but reader comments always are), and
<article> or <main> count only with half of it. Where all blocks have names of side parts, names mean nothing.

Scripts, styles and hidden elements are no text. Pages are independent: one pass without a shuffle, and memory is that of a page. Defined
results. Null and empty html, and html without text: the empty text. Pages are read whole, however long, in linear time.
Repeated rows give repeated results. An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import html
import math
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import per_worker, read, texts

SMOOTH = 0.5  # weight of a path's nearest paths
SPREAD = 0.3  # threshold, in standard deviations over blocks
WRAPPER = 0.8  # an element with this part of the content is no side part
WHOLE = 0.9  # a container with this part of the content is the article's
HINT = 1e-4  # prior of a part that is named as a side part, or outside the article element

SKIPPED = frozenset("script style noscript template iframe object embed svg math canvas audio video map head title select datalist textarea".split())
ASIDE = frozenset("nav header footer aside form button dialog menu fieldset".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark meter nobr output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tablist".split())
#: words of class and id values that name what is not the article
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adbox adslot adsense adunit banner billboard sponsor sponsored sponsors promo promos promotion promoted dfp taboola outbrain "
    "nav navbar navigation menu menubar submenu breadcrumb breadcrumbs topbar toolbar masthead header footer sitefooter siteheader colophon copyright "
    "sidebar side aside rail widget widgets related recommended recommendations trending popular share sharing social follow newsletter subscribe subscription signup login signin register search searchbox "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay paywall disclaimer "
    "comment comments commentlist commentform respond reply replies discussion disqus feedback pagination pager tags tagcloud".split()
)
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote dd dt td th figcaption".split())
REPLIES = frozenset("comment comments commentlist commentform respond reply replies discussion disqus".split())
MODIFIERS = frozenset("with has no without".split())  # as in "with-sidebar", said of what lies beside it
CLOSED_BY = {  # an open element of the key ends where one of these begins, up to a limiting container
    "p": frozenset("p div ul ol dl table h1 h2 h3 h4 h5 h6 section article aside header footer nav main form blockquote pre figure hr address fieldset details li dd dt tr td th".split()),
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody", "thead", "tfoot"]),
    "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "option": frozenset(["option", "optgroup"]),
}
REGIONS = frozenset("html body div section article main table tbody tr td form center aside".split())  # containers that may be an article's
LIMITS = frozenset("html body div section article aside nav header footer main ul ol dl table td th form blockquote figure".split())


def tools():
    return per_worker(
        "html_tools",
        lambda: {
            "markup": re.compile(r"<(?:!--(?:.*?)(?:-->|$)|(/?)([a-zA-Z][^\s/>]*+)((?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+)>|[!?/][^>]*+(?:>|$)|/?[a-zA-Z][^>]*+>)", re.S),
            "attribute": re.compile(r"([^\s=\"'>/]++)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))|([^\s=\"'>/]++)"),
            "words": re.compile(r"[a-z]+"),
            "camel": re.compile(r"(?<=[a-z0-9])(?=[A-Z])"),
            "marks": re.compile(r"[.,;:!?…。，！？；：、]"),
            "unseen": re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I),
            "tag": re.compile(r"[a-zA-Z][^\s/>]*"),
        },
    )


SEEN, SIDE, NAMED, REPLY, UNSEEN = range(5)  # kinds of elements: plain, side part by element or role, by name, reader comments, not shown


def kind_of(tag: str, attributes: str, in_article: bool) -> int:
    found, out = tools(), SIDE if tag in ASIDE and not (tag == "header" and in_article) else SEEN
    if not attributes or attributes.isspace():
        return out
    for m in found["attribute"].finditer(attributes):
        name = (m[1] or m[5] or "").lower()
        value = html.unescape(m[2] or m[3] or m[4] or "")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and found["unseen"].search(value):
            return UNSEEN
        if name == "role" and ROLES & set(value.lower().split()):
            out = max(out, SIDE)
        if name in ("class", "id") and tag not in ("html", "body", "main"):
            said = found["words"].findall(found["camel"].sub(" ", value if tag not in PARAGRAPHS else mostly_named(value)).lower())
            words = {w for w, before in zip(said, ["", *said]) if w in NAMES and before not in MODIFIERS}
            if words & REPLIES:
                out = REPLY
            elif words - {"header"} if in_article or tag == "article" else words:
                out = out or NAMED
    return out


def mostly_named(value: str) -> str:
    """The words of a class or id of which half the parts at least are names of what is not the article."""
    found, out = tools(), []
    for word in value.split():
        parts = found["words"].findall(found["camel"].sub(" ", word).lower())
        if 2 * sum(part in NAMES for part in parts) >= len(parts):
            out.append(word)
    return " ".join(out)


class Node:
    __slots__ = ("aside", "block", "dropped", "kind", "number", "parent", "path", "tag")

    def __init__(self, tag: str, parent, number: int, path: int, kind: int) -> None:
        self.tag, self.parent, self.number, self.path, self.kind = tag, parent, number, path, kind
        inline = tag in INLINE
        self.block = parent.block if inline and parent else self  # the nearest element that isn't inline
        self.dropped = bool(parent and parent.dropped) or kind == UNSEEN
        self.aside = inline and (kind not in (SEEN, UNSEEN) or bool(parent and parent.aside))  # an inline element, or in one, that is named as a side part


class Page:
    """nodes (elements, parents first), blocks ((element, text) in page order), parent_path (by path number)."""

    def __init__(self, page: str) -> None:
        found = tools()
        self.paths: dict[tuple[int, str, int], int] = {}
        self.parent_path = [-1]
        self.nodes = [Node("#", None, 0, 0, SEEN)]
        self.blocks: list[tuple[Node, str]] = []
        self.stack, self.run, self.sentence = self.nodes[:], [], False  # sentence: the run has text outside named inline elements
        self.open: dict[str, int] = {}
        at, unclosed = 0, set()
        while at < len(page):
            m = found["markup"].search(page, at) if page.find(">", at) >= 0 or page.find("<!--", at) >= 0 else None
            if not m:
                self.add(page[at:])
                break
            self.add(page[at : m.start()])
            at = m.end()
            closing, tag, attributes = m[1], m[2], m[3]
            if tag is None:
                loose = found["tag"].match(page, m.start() + 1)  # a tag with an unclosed quote
                if not loose:
                    continue
                closing, tag, attributes = "", loose[0], ""
            tag = tag.lower()
            if closing:
                self.close(tag)
            elif tag == "br":
                self.add(" ")
            elif tag in RAW or tag in SKIPPED and tag != "head":
                self.add(" ")
                if not attributes.endswith("/") and tag not in VOID:
                    end = per_worker(f"html_end_{tag}", lambda: re.compile(f"</{re.escape(tag)}", re.I)).search(page, at) if tag not in unclosed else None
                    if end:
                        at = page.find(">", end.end()) + 1 or len(page)
                    elif tag in ("script", "style"):
                        at = len(page)
                    else:
                        unclosed.add(tag)
            else:
                self.begin(tag, attributes)
        self.flush()

    def add(self, text: str) -> None:
        if text and not self.stack[-1].dropped:
            self.run.append(text)
            self.sentence |= not self.stack[-1].aside and not text.isspace()

    def flush(self) -> None:
        if self.run:
            text = " ".join(html.unescape("".join(self.run)).split())
            if text and self.sentence:
                self.blocks.append((self.stack[-1].block, text))
            self.run.clear()
            self.sentence = False

    def cut_stack(self, i: int) -> None:
        for node in self.stack[i:]:
            self.open[node.tag] -= 1
        del self.stack[i:]

    def close(self, tag: str) -> None:
        inline = tag in INLINE
        if not inline:
            self.flush()
        if not self.open.get(tag):
            return
        for i in range(len(self.stack) - 1, 0, -1):
            here = self.stack[i].tag
            if here == tag:
                return self.cut_stack(i)
            if inline and here not in INLINE or tag in CLOSED_BY and here in LIMITS:
                return

    def begin(self, tag: str, attributes: str) -> None:
        if tag not in INLINE:
            self.flush()
            if any(self.open.get(t) and tag in ends for t, ends in CLOSED_BY.items()):
                for i in range(len(self.stack) - 1, 0, -1):
                    here = self.stack[i].tag
                    if tag in CLOSED_BY.get(here, ()):
                        self.cut_stack(i)
                        break
                    if here in LIMITS or here in ("li", "tr") and tag not in ("li", "tr", "td", "th"):
                        break
        if tag in VOID or attributes.endswith("/") and tag not in ("p", "div", "a", "span"):
            return
        parent = self.stack[-1]
        kind = UNSEEN if tag == "head" else kind_of(tag, attributes, bool(self.open.get("article") or self.open.get("main")))
        path = self.paths.setdefault((parent.path, tag, kind), len(self.parent_path))
        if path == len(self.parent_path):
            self.parent_path.append(parent.path)
        node = Node(tag, parent, len(self.nodes), path, kind)
        self.nodes.append(node)
        self.stack.append(node)
        self.open[tag] = self.open.get(tag, 0) + 1


def content_paths(rows: list[tuple[int, int, int]], parent_path: list[int], prior: dict[int, float]) -> set[int]:
    """Of (tag path, length, marks) of blocks, the paths that are content."""
    sums: dict[int, list[int]] = {}
    for path, length, marks in rows:
        found = sums.setdefault(path, [0, 0, 0])
        found[0] += 1
        found[1] += length
        found[2] += marks
    groups: dict[int, list[int]] = {}  # sums over the paths of one parent
    for p, found in sums.items():
        group = groups.setdefault(parent_path[p], [0, 0, 0])
        for i in range(3):
            group[i] += found[i]
    fused = {}
    for p, (n, length, marks) in sums.items():
        near = groups[parent_path[p]]
        m, ratio, marked = near[0] - n, length / n, (marks + 1) / n
        if m:
            ratio = (ratio + SMOOTH * (near[1] - length) / m) / (1 + SMOOTH)
            marked = (marked + SMOOTH * (near[2] - marks) / m) / (1 + SMOOTH)
        fused[p] = ratio * marked * prior.get(p, 1.0)
    total = sum(s[0] for s in sums.values())
    mean = sum(fused[p] * s[0] for p, s in sums.items()) / total
    spread = math.sqrt(sum((fused[p] - mean) ** 2 * s[0] for p, s in sums.items()) / total)
    least = min(SPREAD * spread, max(fused.values()))
    return {p for p, x in fused.items() if x > 0 and x >= least}


def weights(nodes: list[Node], blocks: list[tuple[Node, str]], paths: set[int]) -> tuple[list[int], list[int]]:
    """Length and number of the content blocks within each element."""
    weight, held = [0] * len(nodes), [0] * len(nodes)
    for node, text in blocks:
        if node.path in paths:
            weight[node.number] += len(text)
            held[node.number] += 1
    for node in reversed(nodes):
        if node.parent:
            weight[node.parent.number] += weight[node.number]
            held[node.parent.number] += held[node.number]
    return weight, held


def priors(nodes: list[Node], blocks: list[tuple[Node, str]], weight: list[int]) -> list[float]:
    """The prior of each element, from the content weight that ratios without a prior give."""
    chosen: set[int] = set()
    plain = [True] * len(nodes)  # neither it nor an element around it is a side part
    for node in nodes[1:]:
        plain[node.number] = plain[node.parent.number] and node.kind == SEEN
    for tags in (("article",), ("article", "main")):
        marked = outermost(nodes, tags)
        for some in ([n for n in marked if plain[n]], marked):
            if not chosen and some and sum(weight[n] for n in some) >= 0.5 * weight[0]:
                chosen = set(some)
    around = [False] * len(nodes)
    for n in chosen:
        node = nodes[n]
        while node and not around[node.number]:
            around[node.number] = True
            node = node.parent
    out, within = [1.0] * len(nodes), [not chosen] * len(nodes)
    for names in (True, False):
        for node in nodes[1:]:
            above, n = node.parent.number, node.number
            within[n] = within[above] or n in chosen
            holds = around[n] or weight[n] >= WRAPPER * weight[0]
            own = 1.0
            if node.kind == REPLY:
                own = 0.0
            elif node.kind != SEEN and not holds:
                own = 0.0 if node.kind == SIDE else HINT if names else 1.0
            out[n] = min(out[above], own)
        if not names or any(out[node.number] == 1 and within[node.number] for node, _ in blocks):
            break
    return [x if w else min(x, HINT) for x, w in zip(out, within)]


def main_text(page: str) -> str:
    found = Page(page)
    nodes, blocks = found.nodes, found.blocks
    if not blocks:
        return ""
    marks = tools()["marks"]
    rows = [(node.path, len(text), len(marks.findall(text))) for node, text in blocks]
    weight, _ = weights(nodes, blocks, content_paths(rows, found.parent_path, {}))
    prior = priors(nodes, blocks, weight)
    of_path: dict[int, float] = {}
    for node, _ in blocks:
        of_path[node.path] = max(of_path.get(node.path, 0.0), prior[node.number])
    paths = content_paths(rows, found.parent_path, of_path)
    weight, _ = weights(nodes, blocks, paths)
    at = 0  # the smallest container that holds nearly all content (a section: all of it); only one child can
    for node in nodes[1:]:
        if node.parent.number == at and node.tag in REGIONS and weight[node.number] >= (1 if node.tag == "section" else WHOLE) * weight[0]:
            at = node.number
    inside = [False] * len(nodes)
    for node in nodes:
        inside[node.number] = node.number == at or bool(node.parent and inside[node.parent.number])
    kept = [inside[node.number] and (node.path in paths or prior[node.number] == 1) for node, _ in blocks]
    first = at = kept.index(True) if True in kept else 0
    while at and prior[blocks[at - 1][0].number] == 1:  # a title outside the container, with what lies between
        at -= 1
        if blocks[at][0].tag == "h1":
            kept[at:first] = [True] * (first - at)
            break
    return "\n".join(text for (_, text), keep in zip(blocks, kept) if keep)


def outermost(nodes: list[Node], tags: tuple[str, ...]) -> list[int]:
    """Numbers of the elements of these tags that aren't within another one."""
    within, out = [False] * len(nodes), []
    for node in nodes:
        above = bool(node.parent and within[node.parent.number])
        within[node.number] = above or node.tag in tags
        if node.tag in tags and not above:
            out.append(node.number)
    return out


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for begin in range(0, batch.num_rows, 1000):
                part = batch.slice(begin, 1000)
                found = [main_text(h) for h in texts(part.column(2))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))


QUERIES = {"op4_html": op4_html}
SQL: dict[str, str] = {}
