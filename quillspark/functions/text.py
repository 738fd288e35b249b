"""String functions as column expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values
PARTICLES = ["에서는", "에게는", "으로는", "이라는", "에서", "에게", "으로", "라고", "은", "는", "이", "가", "을", "를", "의", "에", "와", "과", "도"]
STOP_WORDS = ["어떤", "어떻게", "무엇", "무엇인가요", "인가요", "있나요", "하나요", "소개되나요", "소개", "저자", "예전", "책"]
LOCATION_PHRASES = ["어디", "어느 곳", "어떤 곳", "어느 장소", "어떤 장소", "장소는", "장소가", "곳은 어디", "곳이 어디"]
TITLE_BRACKETS = [("『", "』"), ("「", "」"), ("《", "》")]
EXTRA_PUNCTUATION = "·ㆍ『』「」《》“”‘’"

SPACE = "[ \\t\\n\\x0B\\f\\r]+"
BREAKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" + EXTRA_PUNCTUATION + " \t\n\x0b\f\r"  # punctuation and white space; character by character, which is quicker than a class


def jtrim(c) -> Column:
    """Strips every character up to U+0020 from both ends, unlike trim, which strips spaces only."""
    return F.regexp_replace(c, "^[\\x00-\\x20]+|[\\x00-\\x20]+$", "")


def _filled(c) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def normalize_tokens(c) -> Column:
    """Lower case, punctuation as space, white space collapsed."""
    return jtrim(F.regexp_replace(F.translate(F.lower(_filled(c)), BREAKS, " " * len(BREAKS)), " {2,}", " "))


def normalize_match(c) -> Column:
    """Lower case without punctuation and white space."""
    return F.translate(F.lower(_filled(c)), BREAKS, "")


def keywords(c) -> Column:
    """Distinct tokens of at least two characters, without one particle suffix each and without stop words, in order."""
    bare = F.transform(F.split(normalize_tokens(c), " "), lambda t: F.regexp_replace(t, "^(.{2,}?)(?:" + "|".join(PARTICLES) + ")$", "$1"))
    return F.array_distinct(F.filter(bare, lambda t: (F.length(t) >= 2) & ~t.isin(STOP_WORDS)))


def abbreviate(c, most: int) -> Column:
    flat = jtrim(F.regexp_replace(_filled(c), SPACE, " "))
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(F.substring(flat, 1, most), F.lit("...")))


def normalize_block(c) -> Column:
    """No-break space as space, white space collapsed, trimmed."""
    return jtrim(F.regexp_replace(F.translate(_filled(c), " ", " "), SPACE, " "))


def normalize_path(c) -> Column:
    """Trimmed, with / as separator; null if blank."""
    path = F.translate(jtrim(_filled(c)), "\\", "/")
    return F.when(path != "", path)


def file_name(c) -> Column:
    return F.substring_index(c, "/", -1)


def has_title_brackets(c) -> Column:
    found = F.lit(False)
    for a, b in TITLE_BRACKETS:
        found = found | (F.contains(c, F.lit(a)) & F.contains(c, F.lit(b)))
    return found


def sha256_hex(c) -> Column:
    return F.sha2(_filled(c), 256)


def sha256_base64(c) -> Column:
    return F.base64(F.unhex(sha256_hex(c)))


def source_type(path) -> Column:
    """Type of a source by its file name."""
    name = F.lower(file_name(path))
    stem = F.regexp_replace(name, "\\.[^.]*$", "")
    kind = F.when(name.isin("nav.xhtml", "toc.xhtml") | stem.rlike("[_-]nav$"), "NAV")
    for ending, value in (("xhtml", "XHTML"), ("html", "HTML"), ("htm", "HTML"), ("opf", "OPF"), ("ncx", "NCX"), ("css", "CSS"), ("xml", "XML"), ("json", "JSON"), ("md", "MARKDOWN"), ("txt", "TEXT")):
        kind = kind.when(name.endswith("." + ending), value)
    return kind.otherwise("UNKNOWN")


def media_source_type(media_type) -> Column:
    """Type of a source by its media type."""
    kind = None
    for value, name in (("application/xhtml+xml", "XHTML"), ("text/html", "HTML"), ("application/oebps-package+xml", "OPF"), ("application/x-dtbncx+xml", "NCX"), ("text/css", "CSS"), ("application/xml", "XML"), ("text/xml", "XML"), ("application/json", "JSON"), ("text/markdown", "MARKDOWN"), ("text/plain", "TEXT")):
        test = F.lower(jtrim(F.substring_index(media_type, ";", 1))) == value
        kind = F.when(test, name) if kind is None else kind.when(test, name)
    return kind.otherwise("UNKNOWN")


def lexical_boost(query_text, query_keywords, title, content) -> Column:
    """What headings, content and title brackets add to a chunk's score for a query."""
    return boost_of(normalize_match(query_text), query_keywords, normalize_match(title), normalize_match(content), has_title_brackets(_filled(content)))


def boost_of(query, query_keywords, heading, body, titled) -> Column:
    """The same from normalised texts and whether the content has title brackets."""
    # as a lambda's variable a text is normalised once, not once a keyword
    hits = F.transform(F.array(heading, body), lambda t: F.size(F.filter(query_keywords, lambda k: F.contains(t, k))))
    in_heading, in_body = hits[0], hits[1]
    exact = F.when((F.length(heading) >= 2) & F.contains(query, heading), 0.18).otherwise(0.0)
    both = F.when((in_heading > 0) & (in_body > 0), 0.05).otherwise(0.0)
    named = F.when(F.array_contains(query_keywords, "제목") & titled, 0.10).otherwise(0.0)
    return exact + F.least(F.lit(0.18), in_heading * 0.06) + F.least(F.lit(0.16), in_body * 0.04) + both + named


def rerank_weight(query_text) -> Column:
    """0.58 for questions after a place, else 0.30."""
    return F.when(_filled(query_text).rlike("|".join(LOCATION_PHRASES)), 0.58).otherwise(0.30)


#: what Unicode calls white space, as the inside of a character class
SPACES = "\\t-\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def stripped(c) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, f"^[{SPACES}]+|[{SPACES}]+$", "")
