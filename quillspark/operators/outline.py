"""Typed chunks as queries over an interval-encoded tree.

`nodes` is all that parses: a row for each element and each text node of a page, with its place in document order (seq), the place of the last node
below it (last), and the run of text nodes that it covers (from first_text, n_texts of them). An element is below another exactly if its seq lies between the other's seq and
last, so what nests in what is a comparison, a running maximum of last or an interval join, and an element's text is a slice of its page's texts. All rules of chunking are
expressions over that table. A page's rows meet in one task, as they did when it was parsed; pages never do.

White space is what Unicode calls so. A null page has no nodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..shared import cut
from .markup import BLOCKS, FALLBACK_IMAGE_TEXT, UNREAD, Tree

NODES = "doc long, seq int, last int, parent int, depth int, tag string, attrs map<string,string>, first_text int, n_texts int, text string"
TEXT = "#text"
HEADINGS = tuple(f"h{i}" for i in range(1, 7))
PROSE = {"p": "PARAGRAPH", "li": "LIST_ITEM", "blockquote": "QUOTE"}
CHUNKED = (*HEADINGS, *PROSE, "figure", "img", "table")


def node_rows(doc, markup: str):
    """Rows of NODES: elements and text nodes of one page in document order; the artificial root has seq 0."""
    rows, stack, texts = [], [(Tree(markup).nodes[0], -1, 0)], 0
    while stack:
        node, parent, depth = stack.pop()
        if node is None:  # all below the element at `parent` has been seen
            rows[parent][2], rows[parent][8] = len(rows) - 1, texts - rows[parent][7]
            continue
        seq = len(rows)
        if isinstance(node, str):
            rows.append([doc, seq, seq, parent, depth, TEXT, [], texts, 1, node])
            texts += 1
            continue
        rows.append([doc, seq, seq, parent, depth, node.tag, list(node.attrs.items()), texts, 0, None])
        stack.append((None, seq, depth))
        stack += [(c, seq, depth + 1) for c in reversed(node.children)]
    return rows


def nodes(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """The interval-encoded trees of all pages, one row a node."""

    def run(batches):
        import pyarrow as pa

        kinds = [pa.int64(), *[pa.int32()] * 4, pa.string(), pa.map_(pa.string(), pa.string()), pa.int32(), pa.int32(), pa.string()]
        for batch in batches:
            for begin in range(0, batch.num_rows, 100):
                part = batch.slice(begin, 100)
                rows = [r for doc, markup in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) if markup for r in node_rows(doc, markup)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)], [c.split()[0] for c in NODES.split(", ")])

    return pages.select(F.col(id_col).cast("long").alias("doc"), F.col(html_col).cast("string")).mapInArrow(run, NODES)


def squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, f"[{T.SPACES}]+", " "))


def attr(name: str, of: str = "attrs") -> Column:
    return F.coalesce(F.element_at(of, name), F.lit(""))


def in_page(*more):
    return Window.partitionBy("doc", *more).orderBy("seq")


def below(test: Column, *within) -> Column:
    """Whether a node lies below one of its page (and of what else is within) that passes the test: intervals nest, so the furthest end so far tells."""
    window = in_page(*within).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.max(F.when(test, F.col("last"))).over(window) >= F.col("seq"), F.lit(False))


def texts_of(tree: DataFrame, wanted: Column, readable: Column) -> DataFrame:
    """doc, seq, content of the elements wanted: their readable text nodes, white space collapsed. Elements may nest."""
    text = F.when(F.col("tag") == TEXT, F.struct("first_text", F.when(readable, F.col("text")).otherwise("").alias("text")))
    grouped = tree.groupBy("doc").agg(F.array_sort(F.collect_list(text)).alias("texts"), F.collect_list(F.when(wanted, F.struct("seq", "first_text", "n_texts"))).alias("marks"))
    grouped = grouped.select("doc", F.transform("texts", lambda x: x["text"]).alias("texts"), "marks")
    read = lambda m: F.struct(m["seq"].alias("seq"), squeezed(F.array_join(F.slice("texts", m["first_text"] + 1, m["n_texts"]), " ")).alias("content"))
    return grouped.select("doc", F.explode(F.transform("marks", read)).alias("m")).select("doc", "m.*")


def ordered(rows: DataFrame, *order: str) -> DataFrame:
    """Chunks without empty ones, numbered from 0 in each page."""
    place = F.row_number().over(Window.partitionBy("doc").orderBy(*order)) - 1
    kept = rows.where(F.col("content") != "").withColumn("sequence", place)
    return kept.select("doc", "sequence", "type", "title", "element_id", "epub_type", "content", "metadata")


def pairs(*entries) -> Column:
    """A map of (name, value) without those whose value is null."""
    listed = F.array(*(F.struct(F.lit(k).alias("k"), v.cast("string").alias("v")) for k, v in entries))
    return F.map_from_entries(F.filter(listed, lambda e: e["v"].isNotNull()))


def filled(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit("")) != "", c)


def page_chunks(tree: DataFrame) -> DataFrame:
    """Chunks of content documents: headings, paragraphs, list items, quotes, images, figures and tables that are not within one another.

    A paragraph, list item or quote has the text of blocks right below it, not of deeper ones. A figure gives its caption and its images; a table its caption and rows.
    The title of a chunk is the heading at or before it.
    """
    seen = tree.withColumn("unread", below(F.col("tag").isin(*UNREAD)))
    stops = F.col("tag").isin(*CHUNKED, *UNREAD, "head")
    seen = seen.withColumn("top", F.col("tag").isin(*CHUNKED) & ~below(stops))
    owner = F.last(F.when(F.col("top"), F.struct(F.col("seq").alias("seq"), F.col("last").alias("last"), F.col("depth").alias("depth"), F.col("tag").alias("tag"))), ignorenulls=True).over(in_page())
    seen = seen.withColumn("owner", owner).withColumn("owned", F.coalesce(F.expr("owner.last >= seq"), F.lit(False)))
    deep = below(F.col("tag").isin(*BLOCKS) & (F.col("depth") >= F.col("owner.depth") + 2), "owner.seq")
    seen = seen.withColumn("readable", F.col("owned") & ~F.col("unread") & ~(F.col("owner.tag").isin(*PROSE) & deep))
    every = cut(seen)  # many branches read it, and each would parse all pages again
    seen = every.where("owned")
    parts = F.col("tag").isin("figcaption", "caption", "td", "th") & F.col("owner.tag").isin("figure", "table")
    # texts keep their page-wide places, so pages give whole lists of texts: those outside chunks are left out, and empty ones stand for them
    marks = seen.where((F.col("top") & F.col("tag").isin(*HEADINGS, *PROSE)) | parts).select("doc", "seq", "tag", "first_text", "n_texts", F.lit(None).cast("string").alias("text"), F.lit(False).alias("readable"))
    texts = every.where(F.col("tag") == TEXT).select("doc", "seq", "tag", "first_text", "n_texts", F.when(F.col("readable"), F.col("text")).alias("text"), F.coalesce("readable", F.lit(False)).alias("readable"))
    contents = cut(texts_of(texts.unionByName(marks), F.col("tag") != TEXT, F.col("readable")))

    of = ["doc", F.col("owner.seq").alias("at")]
    first = lambda tag, owner: seen.where((F.col("tag") == tag) & (F.col("owner.tag") == owner)).groupBy(*of).agg(F.min("seq").alias("seq")).join(contents, ["doc", "seq"]).select("doc", "at", F.col("content").alias("caption"))
    tops = seen.where("top").select("doc", F.col("seq").alias("at"), "tag", "attrs", "owner.last")
    tops = tops.join(contents.withColumnRenamed("seq", "at"), ["doc", "at"], "left")
    title = F.last(F.when(F.col("tag").isin(*HEADINGS), F.coalesce("content", F.lit(""))), ignorenulls=True).over(Window.partitionBy("doc").orderBy("at"))
    tops = tops.withColumn("title", F.coalesce(title, F.lit("")))
    common = ["doc", "at", "title"]
    own = [attr("id").alias("element_id"), attr("epub:type").alias("epub_type")]

    is_heading = F.col("tag").isin(*HEADINGS)
    kind = F.when(is_heading, "HEADING").otherwise(F.element_at(F.create_map(*(F.lit(x) for e in PROSE.items() for x in e)), F.col("tag")))
    prose = tops.where(F.col("tag").isin(*HEADINGS, *PROSE)).select(*common, F.lit(0).alias("sub"), kind.alias("type"), *own, "content", pairs(("headingLevel", F.when(is_heading, F.substring("tag", 2, 1))), ("tagName", F.col("tag"))).alias("metadata"))

    figures = tops.where("tag = 'figure'").join(first("figcaption", "figure"), ["doc", "at"], "left")
    captions = figures.select(*common, F.lit(0).alias("sub"), F.lit("IMAGE").alias("type"), *own, F.coalesce("caption", F.lit("")).alias("content"), pairs(("caption", F.col("caption"))).alias("metadata"))
    inner = seen.where("tag = 'img' AND owner.tag IN ('figure', 'img')").select(*of, F.col("seq").alias("sub"), "attrs")
    around = figures.select(*common, filled(F.col("caption")).alias("caption"), filled(attr("id")).alias("figure")).unionByName(tops.where("tag = 'img'").select(*common, F.lit(None).cast("string").alias("caption"), F.lit(None).cast("string").alias("figure")))
    images = inner.join(around, ["doc", "at"]).withColumn("alt", squeezed(attr("alt"))).withColumn("src", attr("src"))
    bare = F.col("alt") == ""
    images = images.select(
        *common, "sub", F.when(bare, "IMAGE").otherwise("ALT_TEXT").alias("type"), *own, F.when(bare, F.coalesce("caption", filled(F.col("src")), F.lit(FALLBACK_IMAGE_TEXT))).otherwise(F.col("alt")).alias("content"),
        pairs(("src", F.col("src")), ("caption", F.col("caption")), ("figureId", F.col("figure")), ("altMissing", F.when(bare, "true"))).alias("metadata"),
    )

    lines = seen.where("tag = 'tr' AND owner.tag = 'table'").select(*of, "seq")
    cells = seen.where("tag IN ('td', 'th') AND owner.tag = 'table'").select("doc", "seq", "parent").join(contents, ["doc", "seq"])
    cells = cells.groupBy("doc", F.col("parent").alias("seq")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "content"))), lambda c: c["content"]), " | ").alias("line"))
    lines = lines.join(cells, ["doc", "seq"], "left").groupBy("doc", "at").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.coalesce("line", F.lit("")).alias("line")))), lambda x: x["line"]).alias("lines"))
    tables = tops.where("tag = 'table'").join(first("caption", "table"), ["doc", "at"], "left").join(lines, ["doc", "at"], "left")
    shown = F.filter(F.concat(F.array(F.coalesce("caption", F.lit(""))), F.coalesce("lines", F.array().cast("array<string>"))), lambda x: x != "")
    tables = tables.select(*common, F.lit(0).alias("sub"), F.lit("TABLE").alias("type"), *own, F.array_join(shown, "\n").alias("content"), pairs(("rowCount", F.coalesce(F.size("lines"), F.lit(0)))).alias("metadata"))
    return ordered(prose.unionByName(captions).unionByName(images).unionByName(tables), "at", "sub")


def full_texts(tree: DataFrame, wanted: Column) -> DataFrame:
    """doc, seq, content: all text below the elements wanted, but for that below unread ones."""
    return texts_of(tree.withColumn("_unread", below(F.col("tag").isin(*UNREAD))), wanted, ~F.col("_unread"))


def toc_chunks(tree: DataFrame) -> DataFrame:
    """TOC_ENTRY chunks of navigation documents, one a link; its depth is the number of lists around it, its kind that of the nearest nav that has one."""
    links = tree.where("tag = 'a'").select("doc", "seq", "attrs")
    around = tree.where("tag IN ('ol', 'ul', 'nav')").select("doc", F.col("seq").alias("outer"), "last", F.col("tag").alias("kind"), filled(attr("epub:type")).alias("nav"))
    held = links.join(around, "doc", "left").where("outer IS NULL OR (outer < seq AND seq <= last)")
    held = held.groupBy("doc", "seq").agg(F.count_if(F.col("kind") != "nav").alias("lists"), F.max_by("nav", F.when((F.col("kind") == "nav") & F.col("nav").isNotNull(), F.col("outer"))).alias("nav"))
    rows = links.join(held, ["doc", "seq"], "left").join(full_texts(tree, F.col("tag") == "a"), ["doc", "seq"])
    nav = F.coalesce("nav", F.lit(""))
    return ordered(rows.select("doc", "seq", F.lit("TOC_ENTRY").alias("type"), F.col("content").alias("title"), attr("id").alias("element_id"), nav.alias("epub_type"), "content", pairs(("href", attr("href")), ("navigationDepth", F.coalesce("lists", F.lit(0))), ("navType", nav)).alias("metadata")), "seq")


def ncx_chunks(tree: DataFrame) -> DataFrame:
    """TOC_ENTRY chunks of NCX documents, one a navPoint: its first navLabel child and its first content child."""
    child = lambda tag, value: tree.where(F.col("tag") == tag).groupBy("doc", F.col("parent").alias("seq")).agg(F.min_by(value, "seq").alias(tag))
    labels = full_texts(tree, F.col("tag") == "navlabel")
    first = tree.where("tag = 'navlabel'").groupBy("doc", "parent").agg(F.min("seq").alias("seq")).join(labels, ["doc", "seq"]).select("doc", F.col("parent").alias("seq"), "content")
    rows = tree.where("tag = 'navpoint'").select("doc", "seq", "attrs").join(first, ["doc", "seq"]).join(child("content", attr("src")).withColumnRenamed("content", "src"), ["doc", "seq"], "left")
    return ordered(rows.select("doc", "seq", F.lit("TOC_ENTRY").alias("type"), F.col("content").alias("title"), attr("id").alias("element_id"), F.lit("").alias("epub_type"), "content", pairs(("src", F.coalesce("src", F.lit(""))), ("playOrder", attr("playorder"))).alias("metadata")), "seq")


def opf_chunks(tree: DataFrame) -> DataFrame:
    """METADATA chunks of package documents: entries right below metadata, then manifest items, then references of the spine."""
    entries = tree.where(F.col("tag") != TEXT).select("doc", "seq", "tag", "attrs", "parent").join(tree.where("tag = 'metadata'").select("doc", F.col("seq").alias("parent")), ["doc", "parent"])
    contents = full_texts(tree, F.col("tag") != TEXT)
    value = F.coalesce(filled(F.col("content")), attr("content"))
    name = F.coalesce(filled(attr("property")), filled(attr("name")), F.col("tag"))
    columns = [attr("id").alias("element_id"), F.lit("").alias("epub_type"), F.lit("").alias("title"), F.lit("METADATA").alias("type")]
    said = entries.join(contents, ["doc", "seq"]).where(value != "").select("doc", F.lit(0).alias("part"), "seq", *columns, F.concat(name, F.lit(": "), value).alias("content"), pairs(("kind", F.lit("metadata"))).alias("metadata"))
    merged = lambda kind, *more: F.map_concat(F.map_filter(pairs(("kind", F.lit(kind)), *more), lambda k, _: ~F.array_contains(F.map_keys("attrs"), k)), "attrs")
    items = tree.where("tag = 'item'").select("doc", F.lit(1).alias("part"), "seq", *columns, F.rtrim(F.concat_ws(" ", F.lit("manifest:"), attr("id"), attr("href"), attr("media-type"))).alias("content"), merged("manifest").alias("metadata"))
    places = tree.where("tag = 'itemref'").withColumn("position", F.row_number().over(in_page()) - 1)
    spine = places.select("doc", F.lit(2).alias("part"), "seq", *columns, F.concat(F.lit("spine: "), attr("idref")).alias("content"), merged("spine", ("position", F.col("position"))).alias("metadata"))
    return ordered(said.unionByName(items).unionByName(spine), "part", "seq")
