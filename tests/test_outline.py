"""Chunks over interval labels against a walk of each page's tree."""

import json
import re

import duckdb
import pytest

from quillspark.operators import markup, outline
from quillspark.operators.markup import BLOCKS, FALLBACK_IMAGE_TEXT, UNREAD, Node, Tree, full_text, normalized


def chunk_text(node: Node) -> str:
    """Text of a paragraph, list item or quote: with block elements that are its direct children, without deeper ones and images."""
    out, stack = [], [(c, True) for c in reversed(node.children)]
    while stack:
        x, direct = stack.pop()
        if isinstance(x, str):
            out.append(x + " ")
        elif x.tag not in UNREAD and x.tag != "img" and (direct or x.tag not in BLOCKS):
            stack += [(c, False) for c in reversed(x.children)]
    return normalized("".join(out))


def find(node: Node, *tags: str):
    """Descendants of these tags, in document order."""
    stack = [c for c in reversed(node.children) if not isinstance(c, str)]
    while stack:
        x = stack.pop()
        if x.tag in tags:
            yield x
        stack += [c for c in reversed(x.children) if not isinstance(c, str)]


def chunk_rows(markup: str):
    """(type, title, element_id, epub_type, content, metadata) of a page's chunks in order."""
    title = ""
    stack = [c for c in reversed(Tree(markup).nodes[0].children) if not isinstance(c, str)]

    def image(n: Node, caption: str, figure: str):
        alt, src = normalized(n.attrs.get("alt", "")), n.attrs.get("src", "")
        extra = {"src": src, **({"caption": caption} if caption else {}), **({"figureId": figure} if figure else {})}
        if alt:
            return "ALT_TEXT", alt, n, extra
        return "IMAGE", caption or src or FALLBACK_IMAGE_TEXT, n, {**extra, "altMissing": "true"}

    while stack:
        n = stack.pop()
        found = []
        if n.tag in UNREAD or n.tag == "head":
            continue
        if re.fullmatch("h[1-6]", n.tag):
            title = full_text(n)
            found.append(("HEADING", title, n, {"headingLevel": n.tag[1], "tagName": n.tag}))
        elif n.tag in ("p", "li", "blockquote"):
            found.append(({"p": "PARAGRAPH", "li": "LIST_ITEM", "blockquote": "QUOTE"}[n.tag], chunk_text(n), n, {"tagName": n.tag}))
        elif n.tag == "figure":
            caption = next((full_text(c) for c in find(n, "figcaption")), "")
            if caption:
                found.append(("IMAGE", caption, n, {"caption": caption}))
            found += [image(i, caption, n.attrs.get("id", "")) for i in find(n, "img")]
        elif n.tag == "img":
            found.append(image(n, "", ""))
        elif n.tag == "table":
            caption = next((full_text(c) for c in find(n, "caption")), "")
            rows = [" | ".join(full_text(c) for c in r.children if not isinstance(c, str) and c.tag in ("td", "th")) for r in find(n, "tr")]
            found.append(("TABLE", "\n".join(x for x in (caption, *rows) if x), n, {"rowCount": str(len(rows))}))
        else:
            stack += [c for c in reversed(n.children) if not isinstance(c, str)]
        for kind, content, node, metadata in found:
            if content:
                yield kind, title, node.attrs.get("id", ""), node.attrs.get("epub:type", ""), content, metadata


def toc_rows(markup: str):
    """TOC_ENTRY chunks of a navigation document, one per link."""
    tree = Tree(markup)
    for a in find(tree.nodes[0], "a"):
        depth, nav, n = 0, "", a.parent
        while n:
            depth += n.tag in ("ol", "ul")
            nav = nav or (n.attrs.get("epub:type", "") if n.tag == "nav" else "")
            n = n.parent
        text = full_text(a)
        if text:
            yield "TOC_ENTRY", text, a.attrs.get("id", ""), nav, text, {"href": a.attrs.get("href", ""), "navigationDepth": str(depth), "navType": nav}


def ncx_rows(markup: str):
    """TOC_ENTRY chunks of an NCX document, one per navPoint."""
    for n in find(Tree(markup).nodes[0], "navpoint"):
        label = next((full_text(x) for c in n.children if not isinstance(c, str) and c.tag == "navlabel" for x in [c]), "")
        src = next((c.attrs.get("src", "") for c in n.children if not isinstance(c, str) and c.tag == "content"), "")
        if label:
            yield "TOC_ENTRY", label, n.attrs.get("id", ""), "", label, {"src": src, "playOrder": n.attrs.get("playorder", "")}


def opf_rows(markup: str):
    """METADATA chunks of a package document: metadata, manifest items, spine references."""
    tree = Tree(markup)
    for part in find(tree.nodes[0], "metadata"):
        for n in part.children:
            if not isinstance(n, str):
                value = full_text(n) or n.attrs.get("content", "")
                if value:
                    yield "METADATA", "", n.attrs.get("id", ""), "", f"{n.attrs.get('property') or n.attrs.get('name') or n.tag}: {value}", {"kind": "metadata"}
    for n in find(tree.nodes[0], "item"):
        yield "METADATA", "", n.attrs.get("id", ""), "", f"manifest: {n.attrs.get('id', '')} {n.attrs.get('href', '')} {n.attrs.get('media-type', '')}".rstrip(), {"kind": "manifest", **n.attrs}
    for i, n in enumerate(find(tree.nodes[0], "itemref")):
        yield "METADATA", "", n.attrs.get("id", ""), "", f"spine: {n.attrs.get('idref', '')}", {"kind": "spine", "position": str(i), **n.attrs}




READ = {"XHTML": chunk_rows, "NAV": toc_rows, "NCX": ncx_rows, "OPF": opf_rows}

FIXTURES = [
    ("XHTML", "<h1>A</h1><p>one<div>x<p>deep</p></div></p><h2></h2><p id='i' epub:type='z'>two <b>bold<i> in</i></b><script>no</script></p><li>a<ul><li>b</li></ul></li>"),
    ("XHTML", "<table><tr><td>1<table><caption>in</caption><tr><th>x</th><td>y</td></tr></table></td><td>2</td></tr><tr></tr><tr><td></td></tr></table><table></table><table><caption> only </caption></table>"),
    ("XHTML", "<figure id='f'><div><img src='a' alt=' A  b '><img></div><figcaption>one<p>two</p></figcaption><figcaption>three</figcaption></figure><figure><img src='q'></figure><img src='z' epub:type='e'><img alt=' '>"),
    ("XHTML", "<head><title>t</title><p>no</p></head><svg><p>no</p><text>n</text></svg><blockquote><p>q1</p><div><div>deep</div>q2</div></blockquote><section><p> a b\x1cc\u0085d</p></section>text at the top<p>"),
    ("XHTML", "no markup at all"), ("XHTML", "<p>unclosed <b>bold<p>next</b> para<li>x<li>y<br>z"), ("XHTML", "<div><h3>H<span>ead</span></h3><ul><li><h4>in li</h4></li></ul></div><p>after</p>"),
    ("NAV", '<nav epub:type="toc"><ol><li><a href="a.xhtml" id="q">A</a><ol><li><a href="b.xhtml">B <b>x</b></a></li></ol></li></ol></nav><nav><ul><li><a>loose</a><a href="e"></a></li></ul></nav><a href="out">Out</a><nav epub:type="landmarks"><nav><a href="l">L</a></nav></nav>'),
    ("NCX", '<navMap><navPoint id="n" playOrder="1"><navLabel><text>One</text></navLabel><content src="a"/><navPoint playOrder="2"><navLabel><text>Two</text></navLabel><navLabel><text>no</text></navLabel></navPoint></navPoint><navPoint><content src="x"/></navPoint></navMap>'),
    ("OPF", '<package><metadata><dc:title id="t">Book <b>x</b></dc:title><meta name="cover" content="c"/><meta property="p">v</meta><dc:x></dc:x></metadata><manifest><item id="a" href="a.xhtml" media-type="x"/><item id="b" kind="k"/></manifest><spine><itemref idref="a" linear="no"/><itemref idref="b"/></spine></package>'),
]


def plain(kind, doc, text):
    return [(doc, i, t, title, e, p, c, json.dumps(m, sort_keys=True)) for i, (t, title, e, p, c, m) in enumerate(READ[kind](text))]


def spark_rows(found):
    return sorted((r.doc, r.sequence, r.type, r.title, r.element_id, r.epub_type, r.content, json.dumps(r.metadata, sort_keys=True)) for r in found.collect())


def test_fixtures_of_every_kind(spark):
    rows = [(i, kind, text) for i, (kind, text) in enumerate(FIXTURES)] + [(100, "XHTML", None), (101, "XHTML", "")]
    found = markup.chunks(spark.createDataFrame(rows, "page_id long, kind string, html string"), kind_col="kind")
    expected = sorted(x for i, kind, text in rows if text for x in plain(kind, i, text))
    assert spark_rows(found) == expected


def test_all_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    expected = sorted(x for r in pages.collect() for x in plain("XHTML", r.page_id, r.html))
    assert len(expected) > 300 and spark_rows(markup.chunks(pages)) == expected


def test_unknown_kinds(spark):
    rows = spark.createDataFrame([(1, "ODD", "<p>x</p>"), (2, None, "<p>x</p>")], "page_id long, kind string, html string")
    assert markup.chunks(rows, kind_col="kind").isEmpty()
    with pytest.raises(Exception, match="no reader for"):
        markup.chunks(rows, kind_col="kind", unknown="error").collect()


def test_intervals(spark):
    """Labels nest, and prose of the pages is what interval joins in another engine give."""
    rows = [r for i, (_, text) in enumerate(FIXTURES) for r in outline.node_rows(i, text)]
    for doc in range(len(FIXTURES)):
        of = [r for r in rows if r[0] == doc]
        for _, seq, last, parent, *_ in of[1:]:
            assert of[parent][1] < seq <= last <= of[parent][2]
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    import pandas as pd

    n = pd.DataFrame([r[:6] + r[9:] for p in pages.collect() for r in outline.node_rows(p.page_id, p.html)], columns=["doc", "seq", "last", "parent", "depth", "tag", "text"])  # noqa: F841
    stops = ", ".join(f"'{t}'" for t in (*outline.CHUNKED, *UNREAD, "head"))
    sql = f"""WITH t AS (SELECT * FROM n WHERE tag IN ('p', 'h1', 'h2') AND NOT EXISTS (SELECT 1 FROM n o WHERE o.doc = n.doc AND o.tag IN ({stops}) AND o.seq < n.seq AND n.seq <= o.last))
    SELECT t.doc, t.tag, trim(regexp_replace(string_agg(x.text, ' ' ORDER BY x.seq), '\\s+', ' ', 'g')) AS content FROM t JOIN n x ON x.doc = t.doc AND x.tag = '#text' AND x.seq > t.seq AND x.seq <= t.last
    WHERE NOT EXISTS (SELECT 1 FROM n b WHERE b.doc = t.doc AND b.tag IN ('script', 'style', 'div', 'p', 'ul', 'li') AND b.depth > t.depth + 1 AND t.seq < b.seq AND b.seq < x.seq AND x.seq <= b.last) GROUP BY t.doc, t.seq, t.tag HAVING content <> ''"""
    expected = sorted(duckdb.sql(sql).fetchall())
    found = markup.chunks(pages).where("metadata['tagName'] IN ('p', 'h1', 'h2')")
    assert len(expected) >= 100 and sorted((r.doc, r.metadata["tagName"], r.content) for r in found.collect()) == expected


def test_pages_are_parsed_once(spark):
    pages = spark.createDataFrame([(i, f"<h1>T{i}</h1><p>a<b>b</b></p><figure><img src='x'><figcaption>c</figcaption></figure><table><tr><td>d</td></tr></table>") for i in range(20)], "page_id long, html string")
    parsed = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            parsed.add(batch.num_rows)
            yield batch

    found = outline.page_chunks(outline.nodes(pages.mapInArrow(count, "page_id long, html string")))
    assert found.count() == 20 * 5
    assert parsed.value == 20
