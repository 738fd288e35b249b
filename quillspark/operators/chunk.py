"""Documents to ordered, typed chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

LONGEST = 2000
LOOK_BACK = 300
SENTENCE_ENDS = ".!?。！？\\n"  # the inside of a character class


def plain_blocks(docs: DataFrame, path_col: str, text_col: str, separator: str = "\\n[ \\t\\x0B\\f\\r]*\\n") -> DataFrame:
    """source_path, sequence (from 0, blank blocks left out), type TEXT, content of the blocks of plain text."""
    lines = F.transform(F.split(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), "\\r\\n?", "\n"), separator), T.normalize_block)
    kept = F.filter(lines, lambda b: b != "")
    return docs.select(F.col(path_col).alias("source_path"), F.posexplode(kept).alias("sequence", "content")).withColumn("type", F.lit("TEXT"))


def chunk_id(path, element_id, kind, sequence):
    """path#element id, or path#type_0001 by sequence (at least four digits) if there is no element id."""
    named = F.when(F.coalesce(element_id, F.lit("")) != "", F.concat_ws("#", path, element_id))
    return named.otherwise(F.concat(path, F.lit("#"), F.lower(kind), F.format_string("_%04d", sequence.cast("long"))))


def split_parts(c, longest: int = LONGEST):
    """Parts of at most longest characters each; joined without white space they are the text without white space.

    A part ends after the last sentence end of its last LOOK_BACK characters, else after the last white space there, else where it is full. Each step cuts one part off what is
    left, and takes longest - LOOK_BACK characters at least, which bounds the steps.
    """
    low = max(1, longest - LOOK_BACK)
    upto = lambda text, marks: F.length(F.regexp_extract(text, f"(?s)^(.*[{marks}])", 1))

    def step(state, _):
        rest = state["rest"]
        tail = F.substring(rest, low + 1, longest - low)
        sentence, space = upto(tail, SENTENCE_ENDS), upto(tail, T.SPACES)
        at = F.when(F.length(rest) <= longest, F.length(rest)).when(sentence > 0, low + sentence).when(space > 0, low + space).otherwise(longest)
        part = T.stripped(F.substring(rest, F.lit(1), at))
        left = F.regexp_replace(F.substring(rest, at + 1, F.length(rest)), f"^[{T.SPACES}]+", "")
        return F.struct(left.alias("rest"), F.when(part != "", F.concat(state["parts"], F.array(part))).otherwise(state["parts"]).alias("parts"))

    c = F.col(c) if isinstance(c, str) else c
    steps = F.sequence(F.lit(0), F.floor(F.length(c) / F.lit(low)).cast("int"))
    return F.aggregate(steps, F.struct(c.alias("rest"), F.array().cast("array<string>").alias("parts")), step, lambda state: state["parts"])


def split_chunks(chunks: DataFrame, content_col: str = "content", longest: int = LONGEST) -> DataFrame:
    """chunks with part_index, part_count and content cut to at most longest characters (`split_parts`). Shorter ones, and null, stay as they are."""
    limit = F.length(content_col) > longest
    short = chunks.where(~F.coalesce(limit, F.lit(False))).withColumn("part_index", F.lit(0)).withColumn("part_count", F.lit(1))
    cut = chunks.where(limit).withColumn("_parts", split_parts(content_col, longest))
    others = [c for c in chunks.columns if c != content_col]
    long = cut.select(*others, F.size("_parts").alias("part_count"), F.posexplode("_parts").alias("part_index", content_col))
    return short.unionByName(long)


def embedding_text(chunks: DataFrame, by: str = "source_path", order: str = "sequence") -> DataFrame:
    """Adds embedding_text: a paragraph after the paragraph before it in its source, other types with labelled fields. Sources are told apart by project_id where chunks have it."""
    before = Window.partitionBy(by, *(["project_id"] if "project_id" in chunks.columns else [])).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    paragraph = F.col("type") == "PARAGRAPH"
    previous = F.last(F.when(paragraph, F.col("content")), ignorenulls=True).over(before)
    field = lambda label, c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(label), F.col(c)))
    labelled = F.concat_ws("\n", field("제목: ", "title"), F.concat(F.lit("문서 유형: "), F.col("type")), field("EPUB 유형: ", "epub_type"), F.concat(F.lit("내용: "), F.col("content")))
    return chunks.withColumn("embedding_text", F.when(paragraph, F.concat_ws("\n", previous, "content")).otherwise(labelled))


def duplicate_ids(chunks: DataFrame, id_col: str = "id", by: str = "source_path") -> DataFrame:
    """Chunk ids that a source holds more than once; with any, the source can't be indexed."""
    return chunks.groupBy(by, id_col).agg(F.count("*").alias("n")).where("n > 1")
