"""Quality rules for documents and packages: accessibility, package structure, manifests, typography, typos, releases.

Accessibility rules are DataFrames over the `elements` table of operators.markup; each gives issues (doc, seq, code).
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions import text as T
from ..shared import cut
from .markup import attr, headings

# fixed values
CODES = {
    "IMAGE_ALT_MISSING": ("ERROR", "IMAGE"),
    "IMAGE_ALT_EMPTY": ("ERROR", "IMAGE"),
    "IMAGE_ALT_TOO_LONG": ("WARNING", "IMAGE"),
    "IMAGE_ALT_REDUNDANT_PREFIX": ("WARNING", "IMAGE"),
    "IMAGE_ALT_DUPLICATES_CAPTION": ("INFO", "IMAGE"),
    "IMAGE_ALT_FILENAME_USED": ("ERROR", "IMAGE"),
    "IMAGE_SOURCE_MISSING": ("ERROR", "IMAGE"),
    "DECORATIVE_IMAGE_ALT_NOT_EMPTY": ("WARNING", "IMAGE"),
    "DECORATIVE_IMAGE_ROLE_INVALID": ("WARNING", "IMAGE"),
    "MEANINGFUL_IMAGE_HIDDEN": ("ERROR", "IMAGE"),
    "DOCUMENT_LANGUAGE_MISSING": ("ERROR", "DOCUMENT"),
    "DOCUMENT_LANGUAGE_INVALID": ("ERROR", "DOCUMENT"),
    "DOCUMENT_LANGUAGE_MISMATCH": ("WARNING", "DOCUMENT"),
    "HEADING_MISSING": ("WARNING", "HEADING"),
    "HEADING_LEVEL_SKIPPED": ("WARNING", "HEADING"),
    "HEADING_EMPTY": ("ERROR", "HEADING"),
    "MULTIPLE_PRIMARY_HEADINGS": ("WARNING", "HEADING"),
    "HEADING_ORDER_INVALID": ("WARNING", "HEADING"),
    "LINK_TEXT_EMPTY": ("ERROR", "LINK"),
    "LINK_TEXT_AMBIGUOUS": ("WARNING", "LINK"),
    "LINK_TARGET_MISSING": ("ERROR", "LINK"),
    "LINK_TARGET_NOT_FOUND": ("ERROR", "LINK"),
    "IMAGE_LINK_NAME_MISSING": ("ERROR", "LINK"),
    "TABLE_CAPTION_MISSING": ("WARNING", "TABLE"),
    "TABLE_HEADER_MISSING": ("ERROR", "TABLE"),
    "TABLE_HEADER_SCOPE_MISSING": ("WARNING", "TABLE"),
    "TABLE_HEADER_REFERENCE_INVALID": ("ERROR", "TABLE"),
    "TABLE_STRUCTURE_COMPLEX": ("WARNING", "TABLE"),
    "TABLE_LAYOUT_USAGE": ("WARNING", "TABLE"),
    "ARIA_REFERENCE_INVALID": ("ERROR", "ARIA"),
    "ARIA_ROLE_INVALID": ("ERROR", "ARIA"),
    "ARIA_ATTRIBUTE_INVALID": ("ERROR", "ARIA"),
    "ARIA_ATTRIBUTE_NOT_ALLOWED": ("ERROR", "ARIA"),
    "ARIA_LABEL_EMPTY": ("WARNING", "ARIA"),
    "ARIA_HIDDEN_FOCUSABLE": ("ERROR", "ARIA"),
    "REDUNDANT_ARIA_ROLE": ("INFO", "ARIA"),
    "DUPLICATE_ELEMENT_ID": ("ERROR", "STRUCTURE"),
    "VALIDATION_FAILED": ("ERROR", "GENERAL"),
}
SEVERITY_ORDER = {"ERROR": 0, "WARNING": 1, "INFO": 2}
AMBIGUOUS_LINKS = ["click here", "click", "here", "read more", "more", "details", "link", "go", "continue", "download", "this", "이곳", "여기", "여기를 클릭", "클릭", "클릭하세요", "더보기", "자세히", "자세히 보기", "계속", "링크", "바로가기"]
EXTERNAL_SCHEMES = ["http", "https", "mailto", "tel", "sms", "ftp", "data", "javascript"]
GENERIC_ALTS = ["image", "img", "photo", "picture", "graphic", "illustration", "이미지", "사진", "그림", "삽화"]
REDUNDANT_PREFIXES = ["image of ", "an image of ", "a picture of ", "picture of ", "photo of ", "photograph of ", "graphic of ", "illustration of ", "이미지:", "이미지 ", "사진:", "사진 ", "그림:", "그림 ", "삽화:", "삽화 "]
LONGEST_ALT = 150
ARIA_ROLES = [
    "alert", "alertdialog", "application", "article", "banner", "blockquote", "button", "caption", "cell", "checkbox", "code", "columnheader", "combobox",
    "complementary", "contentinfo", "definition", "deletion", "dialog", "directory", "document", "emphasis", "feed", "figure", "form", "generic", "grid",
    "gridcell", "group", "heading", "img", "insertion", "link", "list", "listbox", "listitem", "log", "main", "mark", "marquee", "math", "menu", "menubar",
    "menuitem", "menuitemcheckbox", "menuitemradio", "meter", "navigation", "none", "note", "option", "paragraph", "presentation", "progressbar", "radio",
    "radiogroup", "region", "row", "rowgroup", "rowheader", "scrollbar", "search", "searchbox", "separator", "slider", "spinbutton", "status", "strong",
    "subscript", "superscript", "switch", "tab", "table", "tablist", "tabpanel", "term", "textbox", "time", "timer", "toolbar", "tooltip", "tree", "treegrid",
    "treeitem",
]
PUBLISHING_ROLES = [
    "doc-abstract", "doc-acknowledgments", "doc-afterword", "doc-appendix", "doc-backlink", "doc-biblioentry", "doc-bibliography", "doc-biblioref",
    "doc-chapter", "doc-colophon", "doc-conclusion", "doc-cover", "doc-credit", "doc-credits", "doc-dedication", "doc-endnote", "doc-endnotes", "doc-epigraph",
    "doc-epilogue", "doc-errata", "doc-example", "doc-footnote", "doc-foreword", "doc-glossary", "doc-glossref", "doc-index", "doc-introduction",
    "doc-noteref", "doc-notice", "doc-pagebreak", "doc-pagefooter", "doc-pageheader", "doc-pagelist", "doc-part", "doc-preface", "doc-prologue",
    "doc-pullquote", "doc-qna", "doc-subtitle", "doc-tip", "doc-toc",
]
FOCUSABLE = ["a", "button", "input", "select", "textarea", "summary", "iframe", "object", "embed"]
OWN_ROLES = {"a": "link", "button": "button", "img": "img", "nav": "navigation", "main": "main", "article": "article", "aside": "complementary", "table": "table", "ul": "list", "ol": "list", "li": "listitem", "figure": "figure", "h1": "heading", "h2": "heading", "h3": "heading", "h4": "heading", "h5": "heading", "h6": "heading"}
LANGUAGE_TAG = "^[A-Za-z]{2,8}(?:-[A-Za-z]{4})?(?:-(?:[A-Za-z]{2}|[0-9]{3}))?(?:-[A-Za-z0-9]{5,8}|-[0-9][A-Za-z0-9]{3})*$"
SPINE_ORDERS = [("cover.xhtml", 10_000), ("nav.xhtml", 11_000), ("loi.xhtml", 12_000), ("lot.xhtml", 13_000), ("author.xhtml", 20_000), ("prologue.xhtml", 30_000), ("epilogue.xhtml", 800_000), ("quiz.xhtml", 810_000), ("copyright.xhtml", 820_000)]
UNKNOWN_ORDER = 700_000


def _blank(c) -> Column:
    return T.jtrim(F.coalesce(c, F.lit(""))) == ""


def _code(rows: DataFrame, code: str, *extra) -> DataFrame:
    return rows.select("doc", "seq", F.lit(code).alias("code"), *extra)


def _all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _ids(found: DataFrame) -> DataFrame:
    return found.where(~_blank(attr("id"))).select("doc", attr("id").alias("target")).distinct()


def _children(found: DataFrame, tag_test: Column, name: str) -> DataFrame:
    """Of each parent the number of its children that pass a test."""
    return found.where(tag_test).groupBy("doc", F.col("parent").alias("seq")).agg(F.count("*").alias(name))


def heading_rule(found: DataFrame) -> DataFrame:
    rows = headings(found)
    order = Window.partitionBy("doc").orderBy("seq")
    rows = rows.withColumn("before", F.lag("level").over(order)).withColumn("n", F.row_number().over(order))
    rows = rows.withColumn("primaries", F.count_if(F.col("level") == 1).over(order))
    none = found.groupBy("doc").agg(F.count_if(F.col("tag").rlike("^h[1-6]$")).alias("n")).where("n = 0").withColumn("seq", F.lit(0))
    return _all([
        _code(none, "HEADING_MISSING"),
        _code(rows.where(_blank(F.col("text"))), "HEADING_EMPTY"),
        _code(rows.where("n = 1 and level <> 1"), "HEADING_ORDER_INVALID"),
        _code(rows.where("level = 1 and primaries > 1"), "MULTIPLE_PRIMARY_HEADINGS"),
        _code(rows.where("level - before > 1"), "HEADING_LEVEL_SKIPPED"),
    ])


def language_rule(found: DataFrame, expected: Column | None = None) -> DataFrame:
    rows = found.where("tag = 'html'").withColumn("lang", T.jtrim(F.coalesce(attr("lang"), F.lit("")))).withColumn("xml", T.jtrim(F.coalesce(attr("xml:lang"), F.lit(""))))
    value = F.when(F.col("lang") != "", F.col("lang")).otherwise(F.col("xml"))
    fits = value.rlike(LANGUAGE_TAG) & (F.lower(value) != "und")
    mismatch = (F.col("lang") != "") & (F.col("xml") != "") & (F.lower("lang") != F.lower("xml"))
    if expected is not None:
        mismatch = mismatch | (fits & (F.lower(F.substring_index(value, "-", 1)) != F.lower(expected)))
    return _all([_code(rows.where(value == ""), "DOCUMENT_LANGUAGE_MISSING"), _code(rows.where((value != "") & ~fits), "DOCUMENT_LANGUAGE_INVALID"), _code(rows.where(mismatch), "DOCUMENT_LANGUAGE_MISMATCH")])


def image_rule(found: DataFrame) -> DataFrame:
    """Alternative texts. A missing alt ends the checks of an image, an empty one is judged by whether the image is decorative."""
    rows = found.where("tag = 'img'").select("doc", "seq", "parent", attr("alt").alias("alt"), attr("src").alias("src"), F.lower(F.coalesce(attr("role"), F.lit(""))).alias("role"), F.lower(F.coalesce(attr("aria-hidden"), F.lit(""))).alias("hidden"))
    captions = found.where("tag = 'figcaption'").groupBy("doc", "parent").agg(F.min_by("text", "seq").alias("caption"))
    rows = rows.join(captions, ["doc", "parent"], "left")
    alt = T.jtrim(F.col("alt"))
    decorative = F.col("role").isin("presentation", "none")
    named, empty = F.col("alt").isNotNull() & (alt != ""), F.col("alt").isNotNull() & (alt == "")
    lower = F.lower(alt)
    prefixed = reduce(Column.__or__, (lower.startswith(p) for p in REDUNDANT_PREFIXES))
    links = found.where("tag = 'a'").select("doc", F.col("seq").alias("parent"), F.col("text").alias("link_text"), F.coalesce(attr("aria-label"), attr("title")).alias("link_label"))
    unnamed = rows.where(empty).join(links, ["doc", "parent"]).where(_blank(F.col("link_text")) & _blank(F.col("link_label")))
    return _all([
        _code(rows.where(_blank(F.col("src"))), "IMAGE_SOURCE_MISSING"),
        _code(rows.where("alt is null"), "IMAGE_ALT_MISSING"),
        _code(rows.where(empty & ~decorative & (F.col("hidden") != "true")), "IMAGE_ALT_EMPTY"),
        _code(unnamed, "IMAGE_LINK_NAME_MISSING"),
        _code(rows.where(named & ~decorative & (F.col("hidden") == "true")), "MEANINGFUL_IMAGE_HIDDEN"),
        _code(rows.where(named & (F.length(alt) > LONGEST_ALT)), "IMAGE_ALT_TOO_LONG"),
        _code(rows.where(named & lower.isin(GENERIC_ALTS)), "IMAGE_ALT_EMPTY"),
        _code(rows.where(named & alt.rlike("(?i)^.+\\.(png|jpe?g|gif|webp|bmp|svg)$")), "IMAGE_ALT_FILENAME_USED"),
        _code(rows.where(named & prefixed), "IMAGE_ALT_REDUNDANT_PREFIX"),
        _code(rows.where(named & (lower == F.lower(F.col("caption")))), "IMAGE_ALT_DUPLICATES_CAPTION"),
        _code(rows.where(named & decorative), "DECORATIVE_IMAGE_ALT_NOT_EMPTY"),
        _code(rows.where(empty & (F.col("role") != "") & ~decorative), "DECORATIVE_IMAGE_ROLE_INVALID"),
    ])


def link_rule(found: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """files: path of every file of the project; without it only fragments of the same document are looked up."""
    targets = found.where(~_blank(attr("id"))).groupBy("doc", attr("id").alias("labelledby")).agg(F.min_by("text", "seq").alias("labelled_text"))
    alts = found.where("tag = 'img'").groupBy("doc", F.col("parent").alias("seq")).agg(F.concat_ws(" ", F.collect_list(attr("alt"))).alias("image_alt"), F.count("*").alias("images"))
    rows = found.where("tag = 'a'").select("doc", "seq", "text", attr("href").alias("href"), attr("aria-label").alias("label"), attr("aria-labelledby").alias("labelledby"), attr("title").alias("title"))
    rows = rows.join(targets, ["doc", "labelledby"], "left").join(alts, ["doc", "seq"], "left")
    named = lambda c: F.when(~_blank(F.col(c)), T.jtrim(F.col(c)))
    rows = rows.withColumn("name", F.coalesce(*(named(c) for c in ("label", "labelled_text", "text", "image_alt", "title")), F.lit("")))
    scheme = F.lower(F.regexp_extract("href", "^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    fragment = rows.where(F.col("href").startswith("#") & (F.length("href") > 1)).withColumn("target", F.expr("substring(href, 2)"))
    out = [
        _code(rows.where((F.col("name") == "") & F.col("images").isNull()), "LINK_TEXT_EMPTY"),
        _code(rows.where((F.col("name") == "") & F.col("images").isNotNull()), "IMAGE_LINK_NAME_MISSING"),
        _code(rows.where(F.lower(F.regexp_replace("name", T.SPACE, " ")).isin(AMBIGUOUS_LINKS)), "LINK_TEXT_AMBIGUOUS"),
        _code(rows.where(_blank(F.col("href"))), "LINK_TARGET_MISSING"),
        _code(fragment.join(_ids(found), ["doc", "target"], "left_anti"), "LINK_TARGET_NOT_FOUND"),
        _code(rows.where(~_blank(F.col("labelledby")) & F.col("labelled_text").isNull()), "ARIA_REFERENCE_INVALID"),
    ]
    if files is not None:
        local = rows.where(~_blank(F.col("href")) & ~scheme.isin(EXTERNAL_SCHEMES) & ~F.col("href").startswith("#")).withColumn("path", F.regexp_replace("href", "[?#].*$", ""))
        out.append(_code(local.join(files.select("path"), "path", "left_anti"), "LINK_TARGET_NOT_FOUND"))
    return _all(out)


def table_rule(found: DataFrame) -> DataFrame:
    """Cells belong to the nearest table above them; tables nested in cells are tables of their own."""
    parents = found.select("doc", F.col("seq").alias("up"), F.col("tag").alias("up_tag"), F.col("parent").alias("next"))
    # cells -> row -> (section ->) table
    cells = found.where("tag in ('td', 'th')").select("doc", "seq", "tag", F.col("parent").alias("row"), attr("scope").alias("scope"), attr("headers").alias("headers"), attr("rowspan").cast("int").alias("rowspan"), attr("colspan").cast("int").alias("colspan"))
    row_of = parents.where("up_tag = 'tr'").select("doc", F.col("up").alias("row"), F.col("next").alias("above"))
    section = parents.where("up_tag in ('tbody', 'thead', 'tfoot')").select("doc", F.col("up").alias("above"), F.col("next").alias("table"))
    cells = cells.join(row_of, ["doc", "row"]).join(section, ["doc", "above"], "left").withColumn("table", F.coalesce("table", "above"))
    tables = found.where("tag = 'table'").select("doc", "seq", attr("role").alias("role"))
    shape = cells.groupBy("doc", F.col("table").alias("seq")).agg(
        F.count_if(F.col("tag") == "th").alias("headers"),
        F.count_if(F.col("tag") == "td").alias("data"),
        F.count_if((F.col("tag") == "td") & _blank(F.col("headers"))).alias("unreferenced"),
        F.countDistinct("row").alias("rows"),
        F.countDistinct(F.when(F.col("tag") == "th", F.col("row"))).alias("header_rows"),
        F.count_if((F.coalesce("rowspan", F.lit(1)) > 1) | (F.coalesce("colspan", F.lit(1)) > 1)).alias("spans"),
    )
    widths = cells.groupBy("doc", F.col("table").alias("seq"), "row").agg(F.count("*").alias("n")).groupBy("doc", "seq").agg(F.max("n").alias("columns"))
    captions = _children(found, (F.col("tag") == "caption") & ~_blank(F.col("text")), "captions")
    groups = _children(found, F.col("tag") == "colgroup", "colgroups")
    rows = tables.join(shape, ["doc", "seq"], "left").join(widths, ["doc", "seq"], "left").join(captions, ["doc", "seq"], "left").join(groups, ["doc", "seq"], "left").fillna(0, ["headers", "data", "rows", "header_rows", "spans", "columns", "captions", "colgroups", "unreferenced"])
    layout = F.lower(F.coalesce("role", F.lit(""))).isin("presentation", "none") | ((F.col("headers") == 0) & (F.col("captions") == 0) & (F.col("rows") <= 2) & (F.col("columns") <= 3))
    complicated = ((F.col("spans") > 0) | (F.col("header_rows") > 1) | (F.col("colgroups") > 0)) & (F.col("unreferenced") > 0)
    heads = cells.where("tag = 'th'")
    named = cells.where(~_blank(F.col("headers"))).select("doc", "seq", F.explode(F.split("headers", T.SPACE)).alias("target"))
    return _all([
        _code(rows.where(layout), "TABLE_LAYOUT_USAGE"),
        _code(rows.where(~layout & (F.col("captions") == 0)), "TABLE_CAPTION_MISSING"),
        _code(rows.where(~layout & (F.col("headers") == 0)), "TABLE_HEADER_MISSING"),
        _code(heads.where(_blank(F.col("scope"))), "TABLE_HEADER_SCOPE_MISSING"),
        _code(rows.where(~layout & complicated), "TABLE_STRUCTURE_COMPLEX"),
        _code(named.join(_ids(found), ["doc", "target"], "left_anti").distinct(), "TABLE_HEADER_REFERENCE_INVALID"),
    ])


def aria_rule(found: DataFrame) -> DataFrame:
    role = F.lower(T.jtrim(F.coalesce(attr("role"), F.lit(""))))
    rows = found.withColumn("role", role)
    roles = rows.where("role <> ''").select("doc", "seq", F.explode(F.split("role", T.SPACE)).alias("one"))
    labels = rows.where(attr("aria-label").isNotNull())
    references = [rows.where(~_blank(attr(a))).select("doc", "seq", F.explode(F.split(T.jtrim(attr(a)), T.SPACE)).alias("target")) for a in ("aria-labelledby", "aria-describedby")]
    hidden = F.lower(F.coalesce(attr("aria-hidden"), F.lit("")))
    focusable = F.col("tag").isin(FOCUSABLE) & ((F.col("tag") != "a") | attr("href").isNotNull()) | (F.coalesce(attr("tabindex").cast("int"), F.lit(-1)) >= 0)
    level = attr("aria-level")
    accessible = ~_blank(attr("aria-label")) | ~_blank(attr("aria-labelledby"))
    own = F.create_map(*(x for pair in OWN_ROLES.items() for x in map(F.lit, pair)))
    repeated = found.where(~_blank(attr("id"))).withColumn("n", F.row_number().over(Window.partitionBy("doc", attr("id")).orderBy("seq"))).where("n > 1")
    return _all([
        _code(roles.where(~F.col("one").isin(ARIA_ROLES + PUBLISHING_ROLES)).distinct(), "ARIA_ROLE_INVALID"),
        _code(labels.where(_blank(attr("aria-label"))), "ARIA_LABEL_EMPTY"),
        *(_code(r.join(_ids(found), ["doc", "target"], "left_anti"), "ARIA_REFERENCE_INVALID") for r in references),
        _code(rows.where((hidden != "") & ~hidden.isin("true", "false")), "ARIA_ATTRIBUTE_INVALID"),
        _code(rows.where((hidden == "true") & focusable), "ARIA_HIDDEN_FOCUSABLE"),
        _code(rows.where((F.col("role") == "heading") & ~F.coalesce(level.rlike("^[1-6]$"), F.lit(False))), "ARIA_ATTRIBUTE_INVALID"),
        _code(rows.where(F.col("role").isin("presentation", "none") & accessible), "ARIA_ATTRIBUTE_NOT_ALLOWED"),
        _code(rows.where((F.col("role") != "") & (F.col("role") == F.element_at(own, F.col("tag")))), "REDUNDANT_ARIA_ROLE"),
        _code(repeated, "DUPLICATE_ELEMENT_ID"),
    ])


RULES = {"image": image_rule, "language": language_rule, "heading": heading_rule, "link": link_rule, "table": table_rule, "aria": aria_rule}


def page_rule(judge):
    """A rule from judge(elements of a page, in order: rows with seq, parent, depth, tag, attrs, text) -> (seq, code) pairs.

    A page that judge fails on has the issue VALIDATION_FAILED of that rule, and all issues of other rules; other pages are judged all the same.
    """

    def run(table):
        import pyarrow as pa

        doc, out = table.column("doc")[0].as_py(), []
        rows = sorted(table.to_pylist(), key=lambda r: r["seq"])
        try:
            out = [(doc, seq, code) for seq, code in judge([{**r, "attrs": dict(r["attrs"] or ())} for r in rows])]
        except Exception:
            out = [(doc, 0, "VALIDATION_FAILED")]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 3, (pa.int64(), pa.int32(), pa.string()))], names=["doc", "seq", "code"])

    return lambda found: found.groupBy("doc").applyInArrow(run, "doc long, seq int, code string")


def accessibility(found: DataFrame, rules: list[str] | None = None, with_info: bool = False, failed: DataFrame | None = None, more: list | None = None) -> DataFrame:
    """Distinct issues of the rules with severity and category; order them by severity, code, doc, seq.

    Documents that could not be read (failed: doc, see markup.unreadable) have the one issue VALIDATION_FAILED; the others are judged all the same. more are rules
    besides those named, functions from elements to (doc, seq, code), such as `page_rule` makes; codes that are not in CODES are errors of category OTHER.
    """
    found = cut(found)  # every rule reads it; pages are parsed once
    rows = _all([RULES[r](found) for r in (RULES if rules is None else rules)] + [rule(found) for rule in more or ()])
    if failed is not None:
        rows = rows.join(failed.select("doc"), "doc", "left_anti").unionByName(_code(failed.withColumn("seq", F.lit(0)), "VALIDATION_FAILED"))
    rows = rows.distinct()
    value = lambda i: F.create_map(*(x for c, v in CODES.items() for x in (F.lit(c), F.lit(v[i]))))
    rows = rows.withColumn("severity", F.coalesce(F.element_at(value(0), F.col("code")), F.lit("ERROR"))).withColumn("category", F.coalesce(F.element_at(value(1), F.col("code")), F.lit("OTHER")))
    return rows if with_info else rows.where("severity <> 'INFO'")


def issue_counts(issues: DataFrame) -> DataFrame:
    """Per document the number of issues by severity and by category, and passed (no errors)."""
    categories = sorted({category for _, category in CODES.values()})
    rows = issues.groupBy("doc").agg(*(F.count_if(F.col("severity") == s).alias(s.lower() + "s") for s in SEVERITY_ORDER), *(F.count_if(F.col("category") == c).alias(f"in_{c.lower()}") for c in categories))
    return rows.withColumn("passed", F.col("errors") == 0)


def package_documents(packages: DataFrame, files: DataFrame) -> DataFrame:
    """project_id, code, subject of packages (project_id, package_path, xml) that can't be read further: no path, no file, no XML, another root, or no manifest or spine element."""
    found = packages.join(files.select("project_id", F.col("path").alias("package_path"), F.lit(True).alias("there")).distinct(), ["project_id", "package_path"], "left")
    parsed = found.withColumn("tags", root_and_children(F.col("xml")))
    root = F.col("tags")[0]
    code = F.when(_blank(F.col("package_path")), "PACKAGE_PATH_NOT_FOUND").when(F.col("there").isNull(), "PACKAGE_DOCUMENT_MISSING").when(F.col("tags").isNull(), "PACKAGE_DOCUMENT_INVALID").when(root != "package", "PACKAGE_ELEMENT_MISSING")
    lacks = lambda tag, name: F.when(code.isNull() & ~F.array_contains(F.slice("tags", 2, 1_000_000), tag), name)
    codes = F.filter(F.array(code, lacks("manifest", "MANIFEST_MISSING"), lacks("spine", "SPINE_MISSING")), lambda c: c.isNotNull())
    return parsed.select("project_id", F.explode(codes).alias("code"), F.col("package_path").alias("subject"))


@F.pandas_udf(ArrayType(StringType()))
def root_and_children(xml):
    """Local names of a document's root and of its children; null if it is not well-formed."""
    from xml.etree import ElementTree

    def names(text):
        try:
            root = ElementTree.fromstring(text)
        except (ElementTree.ParseError, TypeError, ValueError):
            return None
        return [e.tag.rpartition("}")[2] for e in (root, *root)]

    return xml.map(names)


def structure_severity(code) -> Column:
    return F.when(code == "SPINE_NAV_REFERENCE", "WARNING").otherwise("ERROR")


def package_structure(manifest: DataFrame, spine: DataFrame, files: DataFrame) -> DataFrame:
    """project_id, code, subject. manifest: project_id, id, href, media_type, properties. spine: project_id, position, idref. files: project_id, path.

    A repeated id, href or idref is an issue for each time after the first. A spine document is out of order after the one before it.
    """
    def issue(rows: DataFrame, code: str, subject: str) -> DataFrame:
        return rows.select("project_id", F.lit(code).alias("code"), F.col(subject).alias("subject"))

    def repeated(rows: DataFrame, column: str) -> DataFrame:
        return rows.where(~_blank(F.col(column))).groupBy("project_id", column).agg(F.count("*").alias("n")).where("n > 1").withColumn("again", F.explode(F.sequence(F.lit(2), F.col("n").cast("int"))))

    projects = manifest.select("project_id").union(spine.select("project_id")).union(files.select("project_id")).distinct()
    items = manifest.where(~_blank(F.col("id"))).groupBy("project_id", F.col("id").alias("idref")).agg(F.first(F.struct("href", "media_type", "properties")).alias("item"))
    linked = spine.join(items, ["project_id", "idref"], "left").select("project_id", "position", "idref", F.col("item").isNotNull().alias("known"), "item.*")
    order = Window.partitionBy("project_id").orderBy("position")
    placed = linked.where("href is not null").withColumn("order", spine_order(F.col("href"))).withColumn("before", F.lag("order").over(order))
    navs = manifest.withColumn("is_nav", F.array_contains(F.split(F.coalesce("properties", F.lit("")), " "), "nav")).groupBy("project_id").agg(F.count_if("is_nav").alias("n"), F.max(F.when(F.col("is_nav"), F.col("media_type"))).alias("media_type"))
    return _all([
        issue(projects.join(manifest, "project_id", "left_anti"), "MANIFEST_MISSING", "project_id"),
        issue(projects.join(spine, "project_id", "left_anti"), "SPINE_EMPTY", "project_id"),
        issue(manifest.where(_blank(F.col("id"))), "MANIFEST_ID_MISSING", "href"),
        issue(repeated(manifest, "id"), "MANIFEST_ID_DUPLICATED", "id"),
        issue(manifest.where(_blank(F.col("href"))), "MANIFEST_HREF_MISSING", "id"),
        issue(repeated(manifest, "href"), "MANIFEST_HREF_DUPLICATED", "href"),
        issue(manifest.where(_blank(F.col("media_type"))), "MANIFEST_MEDIA_TYPE_MISSING", "id"),
        issue(manifest.where(~_blank(F.col("href")) & ~F.col("href").rlike("^[A-Za-z][A-Za-z0-9+.-]*:")).join(files.select("project_id", F.col("path").alias("href")), ["project_id", "href"], "left_anti"), "MANIFEST_RESOURCE_MISSING", "href"),
        issue(spine.where(_blank(F.col("idref"))), "SPINE_IDREF_MISSING", "idref"),
        issue(repeated(spine, "idref"), "SPINE_IDREF_DUPLICATED", "idref"),
        issue(linked.where(~_blank(F.col("idref")) & ~F.col("known")), "SPINE_MANIFEST_REFERENCE_MISSING", "idref"),
        issue(linked.where(F.col("known") & ~F.coalesce(F.lower("media_type").isin("application/xhtml+xml", "image/svg+xml"), F.lit(False))), "SPINE_RESOURCE_NOT_DOCUMENT", "href"),
        issue(placed.where("order < before"), "SPINE_ORDER_INVALID", "href"),
        issue(linked.where(F.array_contains(F.split(F.coalesce("properties", F.lit("")), " "), "nav")), "SPINE_NAV_REFERENCE", "href"),
        issue(navs.where("n = 0"), "NAV_ITEM_MISSING", "project_id"),
        issue(navs.where("n > 1"), "NAV_ITEM_DUPLICATED", "project_id"),
        issue(navs.where("n > 0 and not coalesce(lower(media_type) = 'application/xhtml+xml', false)"), "NAV_MEDIA_TYPE_INVALID", "project_id"),
    ])


def spine_order(path) -> Column:
    """The place of a document in a spine by its file name."""
    name = F.lower(T.file_name(T.normalize_path(path)))
    part, chapter = "^part(\\d+)\\.xhtml$", "^chapter(\\d+)_(\\d+)\\.xhtml$"
    number = lambda p, i: F.regexp_extract(name, p, i).cast("int")
    out = F.when(name == SPINE_ORDERS[0][0], SPINE_ORDERS[0][1])
    for known, value in SPINE_ORDERS[1:]:
        out = out.when(name == known, value)
    out = out.when(name.rlike(part), 100_000 + number(part, 1) * 10_000).when(name.rlike(chapter), 100_000 + number(chapter, 1) * 1000 + number(chapter, 2))
    return out.otherwise(UNKNOWN_ORDER)


def compare_manifest(files: DataFrame, manifest: DataFrame, kind: Column | None = None) -> DataFrame:
    """project_id, path, status (MATCHED, NOT_IN_MANIFEST, FILE_MISSING). kind: a test on path that picks texts, fonts, images, scripts or styles."""
    a = files.select("project_id", "path").distinct().withColumn("_file", F.lit(True))
    b = manifest.select("project_id", F.col("href").alias("path")).distinct().withColumn("_item", F.lit(True))
    status = F.when(F.col("_file") & F.col("_item"), "MATCHED").when(F.col("_file"), "NOT_IN_MANIFEST").otherwise("FILE_MISSING")
    rows = a.join(b, ["project_id", "path"], "full").select("project_id", "path", status.alias("status"))
    return rows if kind is None else rows.where(kind)


RESOURCE_KINDS = {"TEXT": ["xhtml", "html", "htm"], "FONT": ["ttf", "otf", "woff", "woff2"], "IMAGE": ["png", "jpg", "jpeg", "gif", "webp", "bmp", "svg"], "SCRIPT": ["js"], "STYLE": ["css"]}


def resource_kind(path) -> Column:
    ending = F.lower(F.regexp_extract(path, "\\.([^./]+)$", 1))
    out = None
    for kind, endings in RESOURCE_KINDS.items():
        out = F.when(ending.isin(endings), kind) if out is None else out.when(ending.isin(endings), kind)
    return out.otherwise("OTHER")


def archive_statistics(entries: DataFrame) -> DataFrame:
    """Number and bytes of an archive's entries by kind. entries: project_id, path, size."""
    return entries.groupBy("project_id", resource_kind(F.col("path")).alias("kind")).agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


MEDIA_ENDINGS = {"audio": ["mp3", "m4a", "aac", "ogg", "wav"], "video": ["mp4", "webm", "m4v"]}  # fixed values


def inspect_archives(entries: DataFrame, parts: DataFrame) -> DataFrame:
    """One row an archive: its entries by kind, whether its mimetype and container are as they must be, its package's title, language and numbers, and what could not be read.

    entries: see sources.files.archive_entries; parts: packages of them. An archive without container is not read further, as nothing names its package.
    """
    kind = resource_kind(F.col("entry"))
    is_type, is_container = F.col("entry") == "mimetype", F.col("entry") == "META-INF/container.xml"
    text = F.decode("content", "UTF-8")
    rootfile = F.when(is_container, F.regexp_extract(text, "<(?:\\w+:)?rootfile\\b[^>]*?\\bfull-path\\s*=\\s*[\"']([^\"']+)", 1))
    said = lambda test: F.coalesce(F.bool_or(F.when(is_type, test)), F.lit(False))
    found = entries.groupBy("archive").agg(
        F.count("*").alias("entries"), F.sum("size").alias("bytes"), *(F.count_if(kind == k).alias(f"n_{k.lower()}") for k in ("TEXT", "STYLE", "IMAGE", "FONT")), *(F.count_if(F.lower("entry").rlike(f"\\.({'|'.join(v)})$")).alias(f"n_{k}") for k, v in MEDIA_ENDINGS.items()),
        F.bool_or(is_type).alias("mimetype_present"), said(text == "application/epub+zip").alias("mimetype_valid"), said(F.col("stored")).alias("mimetype_stored"), said(F.col("first")).alias("mimetype_first"),
        F.bool_or(is_container).alias("container_present"), F.max(rootfile).alias("package_path"),
    )
    found = found.withColumn("package_path", F.when(F.col("package_path") != "", F.col("package_path")))
    there = entries.select("archive", F.col("entry").alias("package_path"), F.lit(True).alias("package_present")).distinct()
    value = lambda name: F.min_by(F.when((F.col("kind") == "metadata") & (F.col("a") == name), F.col("b")), F.when((F.col("kind") == "metadata") & (F.col("a") == name), F.col("position")))
    of = parts.groupBy("archive").agg(
        value("title").alias("title"), value("language").alias("language"), F.count_if(F.col("kind") == "manifest").alias("n_manifest"), F.count_if(F.col("kind") == "spine").alias("n_spine"),
        F.count_if((F.col("kind") == "spine") & (F.col("b") != "no")).alias("n_linear"), F.bool_or((F.col("kind") == "manifest") & F.coalesce(F.col("c").rlike("(^|\\s)nav(\\s|$)"), F.lit(False))).alias("has_navigation"),
        F.bool_or((F.col("kind") == "manifest") & F.coalesce(F.col("b") == "application/x-dtbncx+xml", F.lit(False))).alias("has_ncx"), F.bool_or(F.col("kind") == "error").alias("_broken"),
    )
    out = found.join(there, ["archive", "package_path"], "left").withColumn("package_present", F.coalesce("package_present", F.lit(False)))
    out = out.join(of.withColumn("package_present", F.lit(True)), ["archive", "package_present"], "left")
    issue = F.when(F.col("container_present") & F.col("package_path").isNull(), "EPUB_INSPECT_CONTAINER_READ_ERROR").when(F.col("_broken"), "EPUB_INSPECT_PACKAGE_READ_ERROR")
    return out.select(*found.columns, "package_present", "title", "language", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_manifest", "n_spine", "n_linear")), *(F.coalesce(c, F.lit(False)).alias(c) for c in ("has_navigation", "has_ncx")), issue.alias("issue"))


def issue_category(file, message) -> Column:
    """Category of a checker's message by file name, then by words."""
    file, text = F.lower(F.coalesce(file, F.lit(""))), F.lower(F.coalesce(message, F.lit("")))
    package = F.when(F.contains(text, F.lit("manifest")), "MANIFEST").when(text.rlike("spine|itemref"), "SPINE").when(F.contains(text, F.lit("meta")), "METADATA").otherwise("PACKAGE")
    return F.when(file.endswith(".opf"), package).when(file.endswith("nav.xhtml"), "NAVIGATION").when(file.rlike("\\.x?html$"), "XHTML").when(file.endswith(".css"), "STYLESHEET").when(file.rlike("\\.(png|jpe?g|gif|webp|svg)$"), "IMAGE").when(F.contains(text, F.lit("resource")), "RESOURCE").otherwise("UNKNOWN")


def ellipsis(c) -> Column:
    """Every three dots in a row become one ellipsis."""
    return F.regexp_replace(c, "\\.{3}", "…")


def ellipsis_count(c) -> Column:
    """How many ellipses that makes."""
    return F.size(F.regexp_extract_all(c, F.lit("(\\.{3})"), 1))


# fixed values: marks after which a quotation begins and before which it ends
OPENING, CLOSING = "([{<“‘", ".,!?;:)]}>”’"
OPENING_CLASS, CLOSING_CLASS = (re.sub(r"([\[\]])", r"\\\1", marks) for marks in (OPENING, CLOSING))


def quoted(rows: DataFrame, mark: str, pair: str, by: list[str], order: str, text_col: str = "text") -> DataFrame:
    """rows with the straight marks of their texts as curly ones. Whether a quotation is open carries over from text to text of the same by.

    A mark opens or closes by the characters beside it, or else turns the state over; a mark right after another one opens unless it must close. So a mark is a function from
    state to state, a constant or a negation, and states are their running composition: the last constant, turned over as often as negations followed it. It is composed
    first within each text, then over texts, one row each. An apostrophe between letters or digits leaves the state as it is. by and order tell rows apart.
    """
    key, odd = [*by, order], lambda c: F.pmod(F.col(c), F.lit(2)).cast("int")
    pieces = F.split(F.col(text_col), mark)
    cut = rows.select(*key, pieces.alias("_p"), F.posexplode(F.slice(pieces, F.lit(1), F.size(pieces) - 1)).alias("_i", "_piece"))
    before, after = F.substring("_piece", -1, 1), F.substring(F.element_at("_p", F.col("_i") + 2), 1, 1)
    follows = (before == "") & (F.col("_i") > 0)  # right after another mark
    starts = (before == "") | before.rlike(f"[{T.SPACES}{OPENING_CLASS}]")
    ends = F.when(after == "", F.col("_i") + 2 == F.size("_p")).otherwise(after.rlike(f"[{T.SPACES}{CLOSING_CLASS}]"))
    inner = F.lit(mark == "'") & before.rlike("[\\p{L}\\p{N}]") & after.rlike("[\\p{L}\\p{N}]")
    constant = F.when(inner, None).when(follows, ~ends).when(starts != ends, starts)
    marks = cut.select(*key, "_i", inner.alias("_inner"), constant.cast("int").alias("_set")).withColumn("_turns", (~F.col("_inner") & F.col("_set").isNull()).cast("int"))

    here = Window.partitionBy(*key).orderBy("_i")
    marks = marks.withColumn("_n", F.sum("_turns").over(here))  # negations so far; a constant counts as what it would be before all of them
    marks = marks.withColumn("_base", F.last(F.col("_set").bitwiseXOR(odd("_n")), ignorenulls=True).over(here))
    whole = marks.groupBy(*key).agg(F.max("_n").alias("_all"), F.max_by("_base", "_i").alias("_last"))
    up_to = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.withColumn("_earlier", F.coalesce(F.sum("_all").over(up_to), F.lit(0)))
    whole = whole.withColumn("_fixed", F.coalesce(F.last(F.col("_last").bitwiseXOR(odd("_earlier")), ignorenulls=True).over(up_to), F.lit(0)))
    whole = whole.select(*key, F.col("_fixed").bitwiseXOR(odd("_earlier")).alias("_start"))

    state = F.coalesce("_base", "_start").bitwiseXOR(odd("_n"))
    form = F.when(F.col("_inner"), "’").when(state == 1, pair[0]).otherwise(pair[1])
    forms = marks.join(whole, key).groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", form.alias("form")))), lambda x: x["form"]).alias("_forms"))
    text = F.array_join(F.zip_with(pieces, F.concat("_forms", F.array(F.lit(""))), lambda p, f: F.concat(p, f)), "")
    joined = rows.join(forms, key, "left")
    return joined.select(*(F.when(F.col("_forms").isNull(), F.col(c)).otherwise(text).alias(c) if c == text_col else F.col(c) for c in rows.columns))


def typography(rows: DataFrame, by: list[str], order: str, text_col: str = "text") -> DataFrame:
    """rows with curly quotes, single ones first, and ellipses in their texts; texts of the same by are consecutive in order."""
    found = quoted(quoted(rows, "'", "‘’", by, order, text_col), '"', "“”", by, order, text_col)
    return found.withColumn(text_col, ellipsis(text_col))


def typo_counts(docs: DataFrame, dictionary: DataFrame, id_col: str = "doc_id", text_col: str = "text", largest: int = 10_000) -> DataFrame:
    """id, wrong, right, n of the non-overlapping occurrences of each dictionary entry (wrong, right) in each text.

    The dictionary is shipped to the tasks; one of over `largest` entries is an error. One pass of an automaton over a text finds all entries.
    """
    entries = {r.wrong: r.right for r in dictionary.select("wrong", "right").limit(largest + 1).collect() if r.wrong}
    if len(entries) > largest:
        raise ValueError(f"a dictionary of over {largest} entries")
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        find = finder(entries)
        for batch in batches:
            ids, found = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                times: dict[str, int] = {}
                for _, wrong in find(text or ""):
                    times[wrong] = times.get(wrong, 0) + 1
                ids += [i] * len(times)
                found += times.items()
            wrong, n = zip(*found) if found else ((), ())
            columns = [batch.column(0).take(pa.array(ids, pa.int64())), pa.array(wrong, pa.string()), pa.array([entries[w] for w in wrong], pa.string()), pa.array(n, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [id_col, "wrong", "right", "n"])

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, wrong string, right string, n long")


def finder(entries):
    """A function of a text that gives (offset, entry) of the occurrences of each entry that do not overlap one another, in order of their ends."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for entry in entries:
        automaton.add_word(entry, entry)
    automaton.make_automaton()

    def find(text: str):
        free: dict[str, int] = {}
        for end, entry in automaton.iter(text) if len(automaton) else ():
            start = end + 1 - len(entry)
            if start >= free.get(entry, 0):
                free[entry] = end + 1
                yield start, entry

    return find


def typo_positions(docs: DataFrame, dictionary: dict[str, str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, wrong, right, offset, line (from 1) of every occurrence."""
    entries = {k: v for k, v in dictionary.items() if k}
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        find = finder(entries)
        for batch in batches:
            ids, rows = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                line = last = 0
                for at, wrong in sorted(find(text or "")):
                    line, last = line + text.count("\n", last, at), at
                    ids.append(i)
                    rows.append((wrong, entries[wrong], at, line + 1))
            columns = zip(*rows) if rows else ((), (), (), ())
            kinds = (pa.string(), pa.string(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds))], [id_col, "wrong", "right", "offset", "line"])

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, wrong string, right string, offset int, line int")


LEAST_CONFIDENCE = 0.80
REPLY = "struct<issues:array<struct<original:string,suggestion:string,type:string,reason:string,confidence:double>>>"


def typo_replies(docs: DataFrame, replies: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST_CONFIDENCE) -> DataFrame:
    """id, original, suggestion, type, reason, confidence, start, end, line of every occurrence of what a model's replies (id, reply as JSON) propose.

    Proposals without original or suggestion, without a change, or of too little confidence are left out. A reply that is no JSON object is an error.
    """
    parsed = F.from_json("reply", REPLY)
    checked = F.when(parsed.isNull() | ~F.trim("reply").startswith("{"), F.raise_error(F.lit("a reply is no JSON object"))).otherwise(parsed["issues"])
    found = replies.select(id_col, F.explode(F.coalesce(checked, F.array().cast("array<struct<original:string,suggestion:string,type:string,reason:string,confidence:double>>"))).alias("i")).select(id_col, "i.*")
    found = found.where(~_blank(F.col("original")) & ~_blank(F.col("suggestion")) & (F.col("original") != F.col("suggestion")) & (F.coalesce("confidence", F.lit(0.0)) >= least))
    # the parts between occurrences give their places, from left to right and not overlapping
    parts = F.split(F.col(text_col), F.concat(F.lit("\\Q"), F.replace(F.col("original"), F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")), -1)
    rows = found.join(docs.select(id_col, text_col), id_col).withColumn("_parts", parts).where(F.size("_parts") > 1)
    rows = rows.withColumn("_n", F.explode(F.sequence(F.lit(1), F.size("_parts") - 1)))
    start = F.aggregate(F.slice("_parts", 1, F.col("_n")), F.lit(0), lambda s, p: s + F.length(p)) + (F.col("_n") - 1) * F.length("original")
    rows = rows.withColumn("start", start).withColumn("end", F.col("start") + F.length("original"))
    before = F.substring(F.col(text_col), F.lit(1), F.col("start"))
    return rows.select(id_col, "original", "suggestion", "type", "reason", "confidence", "start", "end", (F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).alias("line"))


def version(c) -> Column:
    """A semantic version as a comparable struct; null if malformed."""
    pattern = "^(\\d+)\\.(\\d+)\\.(\\d+)$"
    return F.when(c.rlike(pattern), F.struct(*(F.regexp_extract(c, pattern, i).cast("int").alias(n) for i, n in ((1, "major"), (2, "minor"), (3, "patch")))))


def accepts_release(releases: DataFrame, candidate: str) -> DataFrame:
    """One row: whether a version is new and higher than that of the release of latest released_at. releases: version, released_at."""
    new = version(F.lit(candidate))
    latest = F.max_by(version(F.col("version")), "released_at")
    return releases.agg((new.isNotNull() & (latest.isNull() | (new > latest)) & (F.count_if(F.col("version") == candidate) == 0)).alias("accepted"))


# fixed values: the kinds of fixes, and the endings that name a media type
FIX_TYPES = ["UPDATE_METADATA", "UPDATE_MANIFEST", "UPDATE_SPINE", "UPDATE_NAVIGATION", "UPDATE_XHTML", "UPDATE_STYLESHEET", "UPDATE_RESOURCE", "INSPECT_REQUIRED", "MANUAL_REQUIRED", "UNKNOWN"]
MEDIA_TYPES = {
    "xhtml": "application/xhtml+xml", "html": "application/xhtml+xml", "css": "text/css", "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "svg": "image/svg+xml",
    "webp": "image/webp", "js": "application/javascript", "ttf": "font/ttf", "otf": "font/otf", "woff": "font/woff", "woff2": "font/woff2",
}


def media_type(path) -> Column:
    """By the ending of a path; null if unknown."""
    known = F.create_map(*(x for pair in MEDIA_TYPES.items() for x in map(F.lit, pair)))
    return F.element_at(known, F.lower(F.regexp_extract(path, "\\.([^./]+)$", 1)))


def fix_plan(issues: DataFrame, files: DataFrame, manifest: DataFrame, spine: DataFrame, navigation: DataFrame) -> DataFrame:
    """project_id, issue_id, file, fix_type, operation (ADD, REMOVE or null), target of the steps that mend a checker's issues (project_id, issue_id, file).

    A file that is not there leaves spine, navigation and manifest; one that is there enters the manifest, then, if it is a text, the
    spine. Whatever that does not settle is MANUAL_REQUIRED. files: project_id, path; manifest: project_id, id, href; spine: project_id, idref;
    navigation: project_id, href. Paths are relative to the package.
    """
    path = F.regexp_replace(F.regexp_replace(T.normalize_path(F.regexp_replace("file", "#.*$", "")), "^OEBPS/", ""), "^(\\./)+", "")
    is_text = F.lower(F.col("path")).rlike("\\.x?html$")
    rows = issues.select("project_id", "issue_id", "file", path.alias("path"))
    rows = rows.withColumn("path", F.when(~F.contains("path", F.lit("/")) & is_text, F.concat(F.lit("Text/"), "path")).otherwise(F.col("path")))
    there = files.select("project_id", "path").distinct().withColumn("on_disk", F.lit(True))
    items = manifest.where(~_blank(F.col("id"))).groupBy("project_id", F.col("href").alias("path")).agg(F.min("id").alias("item"))
    placed = spine.select("project_id", F.col("idref").alias("item")).distinct().withColumn("in_spine", F.lit(True))
    linked = navigation.select("project_id", F.regexp_replace("href", "#.*$", "").alias("nav_href")).distinct().withColumn("in_nav", F.lit(True))
    rows = rows.join(there, ["project_id", "path"], "left").join(items, ["project_id", "path"], "left").join(placed, ["project_id", "item"], "left")
    rows = rows.withColumn("nav_href", F.regexp_replace("path", "^Text/", "")).join(linked, ["project_id", "nav_href"], "left")
    step = lambda kind, operation, target: F.struct(F.lit(kind).alias("fix_type"), F.lit(operation).cast("string").alias("operation"), target.cast("string").alias("target"))
    when = lambda test, *made: F.when(test, F.array(*made)).otherwise(F.array().cast("array<struct<fix_type:string,operation:string,target:string>>"))
    item, has_item, text = F.col("item"), F.col("item").isNotNull(), is_text & (F.lower(T.file_name(F.col("path"))) != "nav.xhtml")
    gone = F.concat(when(F.col("in_spine"), step("UPDATE_SPINE", "REMOVE", item)), when(F.col("in_nav"), step("UPDATE_NAVIGATION", "REMOVE", F.col("nav_href"))), when(has_item, step("UPDATE_MANIFEST", "REMOVE", item)))
    new = when(~has_item & media_type(F.col("path")).isNotNull(), step("UPDATE_MANIFEST", "ADD", F.col("path")))
    unplaced = when(has_item & F.coalesce(text, F.lit(False)) & F.col("in_spine").isNull(), step("UPDATE_SPINE", "ADD", item))
    steps = F.when(F.col("path").isNull(), when(F.lit(False), step("UNKNOWN", None, item))).when(F.col("on_disk"), F.concat(new, unplaced)).otherwise(gone)
    steps = F.when(F.size(steps) == 0, F.array(step("MANUAL_REQUIRED", None, F.col("file")))).otherwise(steps)
    return rows.withColumn("steps", steps).select("project_id", "issue_id", "file", F.explode("steps").alias("s")).select("project_id", "issue_id", "file", "s.*")


def composite(structure: DataFrame, accessibility_issues: DataFrame, checker: DataFrame, documents: DataFrame) -> DataFrame:
    """One row a project: issues by severity of all validators together, and valid (no errors).

    structure: project_id, code, subject. accessibility_issues: doc, severity. checker: project_id, severity. documents: project_id, doc.
    """
    rows = structure.select("project_id", structure_severity(F.col("code")).alias("severity"), F.lit("structure").alias("validator"))
    rows = rows.unionByName(accessibility_issues.join(documents, "doc").select("project_id", "severity", F.lit("accessibility").alias("validator")))
    rows = rows.unionByName(checker.select("project_id", "severity", F.lit("checker").alias("validator")))
    count = lambda severity: F.count_if(F.col("severity") == severity)
    made = rows.groupBy("project_id").agg(count("ERROR").alias("errors"), count("WARNING").alias("warnings"), count("INFO").alias("infos"), *(F.count_if(F.col("validator") == v).alias(v) for v in ("structure", "accessibility", "checker")))
    every = documents.select("project_id").distinct().join(made, "project_id", "left").na.fill(0)
    return every.withColumn("valid", F.col("errors") == 0)


def upsert_items(items: DataFrame, incoming: DataFrame, key: str = "href") -> DataFrame:
    """Manifest, spine or navigation items with incoming ones in place of those of the same key, in spine order (place from 1)."""
    rows = items.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    first = Window.partitionBy("project_id", key).orderBy(F.desc("_new"))
    rows = rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "_new")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("project_id").orderBy(spine_order(F.col(key)), key)))
