"""Markup to elements and chunks.

Parsing works page by page in Arrow batches (html.parser, which takes any markup); everything after it is DataFrame work over the `elements` table, and over
the nodes of `outline` for chunks.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNREAD = frozenset(["script", "style", "svg", "math"])
BLOCKS = frozenset("p li blockquote figure table div section article ul ol dl h1 h2 h3 h4 h5 h6 pre hr header footer nav aside main".split())
ENDS_P = frozenset("p div ul ol dl table h1 h2 h3 h4 h5 h6 blockquote figure section article pre hr".split())
FALLBACK_IMAGE_TEXT = "image"

ELEMENTS = "doc long, seq int, parent int, depth int, tag string, attrs map<string,string>, text string"
CHUNKS = "doc long, sequence int, type string, title string, element_id string, epub_type string, content string, metadata map<string,string>"


class Node:
    __slots__ = ("attrs", "children", "parent", "seq", "tag")

    def __init__(self, tag: str, attrs: dict, parent, seq: int) -> None:
        self.tag, self.attrs, self.parent, self.seq = tag, attrs, parent, seq
        self.children: list = []  # nodes and strings


class Tree(HTMLParser):
    """nodes in document order; the first is an artificial root."""

    def __init__(self, markup: str) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes = [Node("#root", {}, None, 0)]
        self.here = self.nodes[0]
        self.feed(markup)
        self.close()

    def handle_starttag(self, tag, attrs):
        if self.here.tag == "p" and tag in ENDS_P or self.here.tag == tag == "li":
            self.here = self.here.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.here, len(self.nodes))
        self.nodes.append(node)
        self.here.children.append(node)
        if tag not in VOID:
            self.here = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        node = self.here
        while node.parent and node.tag != tag:
            node = node.parent
        if node.parent:
            self.here = node.parent

    def handle_data(self, data):
        self.here.children.append(data)


def normalized(text: str) -> str:
    return " ".join(text.replace(" ", " ").split())


def full_text(node: Node) -> str:
    """All text below a node, a space after every text node, without unread elements."""
    out, stack = [], [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x + " ")
        elif x.tag not in UNREAD:
            stack += reversed(x.children)
    return normalized("".join(out))


def element_rows(doc, markup: str):
    tree = Tree(markup)
    depth = {0: 0}
    for n in tree.nodes[1:]:
        depth[n.seq] = depth[n.parent.seq] + 1
        yield doc, n.seq, n.parent.seq, depth[n.seq], n.tag, list(n.attrs.items()), full_text(n) if n.tag in TEXT_OF else None


TEXT_OF = frozenset("title h1 h2 h3 h4 h5 h6 p a li td th caption figcaption button label span em strong b i".split())


def css_rows(text: str):
    """STYLE chunks: top-level rules of a style sheet, without comments; braces in strings don't count."""
    text = re.sub(r"/\*.*?(\*/|$)", "", text, flags=re.S)
    depth, quote, start, brace, i = 0, "", 0, 0, 0
    while i < len(text):
        c = text[i]
        if quote:
            if c == "\\":
                i += 1
            elif c == quote:
                quote = ""
        elif c in "\"'":
            quote = c
        elif c == "{":
            if not depth:
                brace = i
            depth += 1
        elif c == "}" and depth:
            depth -= 1
            if not depth:
                selector = normalized(text[start:brace])
                yield "STYLE", selector, "", "", f"{selector} {{ {normalized(text[brace + 1 : i])} }}", {}
                start = i + 1
        i += 1


def text_rows(text: str):
    for block in re.split(r"\n[ \t\x0b\f]*\n", text.replace("\r\n", "\n").replace("\r", "\n")):
        if found := normalized(block):
            yield "TEXT", "", "", "", found, {}


ROW_READERS = {"CSS": css_rows, "TEXT": text_rows, "MARKDOWN": text_rows, "JSON": text_rows}  # kinds without a tree


def elements(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", references: tuple[str, ...] | None = None) -> DataFrame:
    """Every element of every page: doc, seq (document order), parent, depth, tag, attrs, text (of elements that carry text).

    Character references are decoded as browsers do, or, if names are given, only these, with their semicolon.
    """
    other = re.compile(f"&(?!(?:{'|'.join(map(re.escape, references))});)") if references else None

    def run(batches):
        import pyarrow as pa

        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.map_(pa.string(), pa.string()), pa.string()]
        for batch in batches:
            for begin in range(0, batch.num_rows, 200):
                part = batch.slice(begin, 200)
                read = zip(part.column(0).to_pylist(), (other.sub("&amp;", m) if other and m else m for m in part.column(1).to_pylist()))
                rows = [r for doc, markup in read for r in element_rows(doc, markup or "")]
                columns = zip(*rows) if rows else [[]] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [c.split()[0] for c in ELEMENTS.split(", ")])

    return pages.select(F.col(id_col).cast("long").alias("doc"), F.col(html_col).cast("string")).mapInArrow(run, ELEMENTS)


def chunks(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", kind: str | None = "XHTML", kind_col: str | None = None, unknown: str = "skip") -> DataFrame:
    """Typed chunks of every page, in order, by its kind: one for all, or that in kind_col.

    Content documents (XHTML, HTML, XML), NAV, NCX and OPF are queries over their trees (`outline`); style sheets are rules; text, Markdown and JSON are blocks between blank lines.
    Pages of other kinds have no chunks, or are an error if unknown is "error".
    """
    from . import outline

    trees = {"XHTML": outline.page_chunks, "HTML": outline.page_chunks, "XML": outline.page_chunks, "NAV": outline.toc_chunks, "NCX": outline.ncx_chunks, "OPF": outline.opf_chunks}

    def flat(batches):
        import pyarrow as pa

        kinds = [pa.int64(), pa.int32(), *[pa.string()] * 5, pa.map_(pa.string(), pa.string())]
        for batch in batches:
            rows = []
            for doc, markup, own in zip(*(batch.column(i).to_pylist() for i in range(3))):
                rows += [(doc, i, k, t, e, p, c, list(m.items())) for i, (k, t, e, p, c, m) in enumerate(ROW_READERS[own](markup or ""))]
            columns = zip(*rows) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [c.split()[0] for c in CHUNKS.split(", ")])

    own = F.col(kind_col) if kind_col else F.lit(kind)
    if unknown == "error":
        own = F.when(own.isin(*trees, *ROW_READERS), own).otherwise(F.raise_error(F.concat(F.lit("no reader for "), F.coalesce(own, F.lit("null")))).cast("string"))
    rows = pages.select(F.col(id_col).cast("long").alias("doc"), F.col(html_col).cast("string").alias("_markup"), own.alias("_kind"))
    readers: dict = {}
    for name, reader in trees.items():
        readers.setdefault(reader, []).append(name)
    asked = [kind] if not kind_col else [*trees, *ROW_READERS]
    found = [reader(outline.nodes(rows.where(F.col("_kind").isin(*names)), "doc", "_markup")) for reader, names in readers.items() if set(names) & set(asked)]
    if set(ROW_READERS) & set(asked) or not found:
        found.append(rows.where(F.col("_kind").isin(*ROW_READERS)).mapInArrow(flat, CHUNKS))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def unreadable(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """doc of the pages without any markup."""
    return pages.where(~F.coalesce(F.contains(html_col, F.lit("<")), F.lit(False))).select(F.col(id_col).alias("doc"))


def attr(name: str):
    return F.element_at("attrs", name)


def links(found: DataFrame) -> DataFrame:
    return found.where("tag = 'a'").select("doc", "seq", attr("href").alias("href"), "text")


def images(found: DataFrame) -> DataFrame:
    return found.where("tag = 'img'").select("doc", "seq", *(attr(a).alias(a) for a in ("src", "id", "alt", "role", "title")))


def headings(found: DataFrame) -> DataFrame:
    return found.where(F.col("tag").rlike("^h[1-6]$")).select("doc", "seq", F.substring("tag", 2, 1).cast("int").alias("level"), "text")


def list_of_images(found: DataFrame, spine: DataFrame) -> DataFrame:
    """doc, id, title of images with id and alt, in spine order (spine: doc, position)."""
    rows = images(found).where((T.jtrim(F.coalesce("id", F.lit(""))) != "") & (T.jtrim(F.coalesce("alt", F.lit(""))) != ""))
    return rows.join(spine, "doc").select("position", "doc", "seq", "id", F.col("alt").alias("title"))


def list_of_tables(found: DataFrame, spine: DataFrame) -> DataFrame:
    """doc, id, title of tables with an id; the title is the caption, else aria-label, else the text of the aria-labelledby target."""
    tables = found.where("tag = 'table'").select("doc", "seq", attr("id").alias("id"), attr("aria-label").alias("label"), attr("aria-labelledby").alias("labelledby")).where(F.coalesce("id", F.lit("")) != "")
    captions = found.where("tag = 'caption'").groupBy("doc", F.col("parent").alias("seq")).agg(F.min_by("text", "seq").alias("caption"))
    targets = found.where(attr("id").isNotNull()).groupBy("doc", attr("id").alias("labelledby")).agg(F.min_by("text", "seq").alias("target"))
    blank = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c))
    rows = tables.join(captions, ["doc", "seq"], "left").join(targets, ["doc", "labelledby"], "left")
    return rows.join(spine, "doc").select("position", "doc", "seq", "id", F.coalesce(blank("caption"), blank("label"), blank("target")).alias("title")).where("title is not null")
