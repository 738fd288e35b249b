"""Text documents, EPUB archives and JSON files as DataFrames, and writers."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

SUPPORTED = ["xhtml", "html", "htm", "xml", "txt", "md"]
ENTRIES = "archive string, entry string, size long, stored boolean, first boolean, content binary"
GOLDEN = "name string, projectId string, projectName string, cases array<struct<id:string,type:string,question:string,referenceAnswer:string,expectedDocuments:array<string>>>"
RELEASES = "releaseId string, projectId string, version string, path string, sha256 string, size long, releasedAt timestamp, status string"


def text_files(spark: SparkSession, folder: str, endings: list[str] | None = None, exclude: tuple[str, ...] = ("quiz.xhtml",), include_dirs: tuple[str, ...] = (), exclude_dirs: tuple[str, ...] = (), recursive: bool = True, hidden: bool = False) -> DataFrame:
    """relative_path, source_type, content, size, last_modified_at (epoch ms), content_hash of the supported files under folder.

    Paths are relative to folder, so none can leave it. Spark's own readers list and read the files.
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(folder)
    root = rows.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    root = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(root).toUri().getPath()
    path = F.regexp_replace(F.regexp_replace("path", "^[a-z0-9]+:(//[^/]*)?", ""), "^" + re.escape(root.rstrip("/")) + "/", "")
    rows = rows.withColumn("relative_path", path)
    within = lambda dirs: "^(" + "|".join(re.escape(d.strip("/")) for d in dirs) + ")/"
    rows = rows.where(F.lower("relative_path").rlike("\\.(" + "|".join(endings or SUPPORTED) + ")$") & ~F.lower(T.file_name(F.col("relative_path"))).isin(list(exclude)))
    if not hidden:
        rows = rows.where(~F.col("relative_path").rlike("(^|/)\\."))
    if include_dirs:
        rows = rows.where(F.col("relative_path").rlike(within(include_dirs)))
    if exclude_dirs:
        rows = rows.where(~F.col("relative_path").rlike(within(exclude_dirs)))
    return rows.select("relative_path", T.source_type(F.col("relative_path")).alias("source_type"), F.decode("content", "UTF-8").alias("content"), F.col("length").alias("size"), F.unix_millis("modificationTime").alias("last_modified_at"), F.sha2("content", 256).alias("content_hash"))


def archive_entries(spark: SparkSession, path: str, pattern: str = "*.epub") -> DataFrame:
    """Every entry of every EPUB (ZIP) archive: archive, entry, size, stored (uncompressed), first, content."""

    def run(batches):
        import pyarrow as pa

        kinds = [pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary()]
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    rows = [(name, m.filename, m.file_size, m.compress_type == zipfile.ZIP_STORED, i == 0, archive.read(m)) for i, m in enumerate(archive.infolist()) if not m.is_dir()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 6, kinds)], [c.split()[0] for c in ENTRIES.split(", ")])

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return files.select("path", "content").mapInArrow(run, ENTRIES)


def package_rows(content: bytes):
    """(kind, position, id, a, b, c) of a package document: metadata (name, value), manifest (href, media type, properties), spine (idref, linear)."""
    root = ElementTree.fromstring(content)
    local = lambda e: e.tag.rpartition("}")[2]
    for part in root:
        for i, e in enumerate(part):
            get = lambda k, e=e: e.attrib.get(k)
            if local(part) == "metadata":
                yield "metadata", i, get("id"), get("property") or get("name") or local(e), (e.text or "").strip() or get("content"), None
            elif local(part) == "manifest":
                yield "manifest", i, get("id"), get("href"), get("media-type"), get("properties")
            elif local(part) == "spine":
                yield "spine", i, get("id"), get("idref"), get("linear") or "yes", None


def packages(entries: DataFrame) -> DataFrame:
    """archive, kind, position, id, a, b, c (see package_rows) of the archives' package documents; of one that can't be read the one row of kind error, a saying why.

    The package document is the first rootfile that META-INF/container.xml names; an archive without that file has the first entry that ends in .opf.
    """
    schema = "archive string, kind string, position int, id string, a string, b string, c string"

    def run(batches):
        import pyarrow as pa

        kinds = [pa.string(), pa.string(), pa.int32(), *[pa.string()] * 4]
        for batch in batches:
            rows = []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    rows += [(name, *r) for r in package_rows(content)]
                except ElementTree.ParseError as e:
                    rows.append((name, "error", 0, None, str(e), None, None))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 7, kinds)], [c.split()[0] for c in schema.split(", ")])

    named = F.regexp_extract(F.decode("content", "UTF-8"), "<(?:\\w+:)?rootfile\\b[^>]*?\\bfull-path\\s*=\\s*[\"']([^\"']+)", 1)
    rootfile = F.max(F.when(F.col("entry") == "META-INF/container.xml", named))
    chosen = entries.groupBy("archive").agg(F.coalesce(rootfile, F.min(F.when(F.lower("entry").endswith(".opf"), F.col("entry")))).alias("entry"))
    return entries.join(chosen, ["archive", "entry"], "left_semi").select("archive", "content").mapInArrow(run, schema)


def manifest(parts: DataFrame) -> DataFrame:
    return parts.where("kind = 'manifest'").select(F.col("archive").alias("project_id"), "id", F.col("a").alias("href"), F.col("b").alias("media_type"), F.col("c").alias("properties"))


def spine(parts: DataFrame) -> DataFrame:
    return parts.where("kind = 'spine'").select(F.col("archive").alias("project_id"), "position", F.col("a").alias("idref"), (F.col("b") != "no").alias("linear"))


def metadata(parts: DataFrame) -> DataFrame:
    return parts.where("kind = 'metadata'").select(F.col("archive").alias("project_id"), "id", F.col("a").alias("name"), F.col("b").alias("value"))


def fingerprints(spark: SparkSession, path: str, pattern: str = "*.epub") -> DataFrame:
    """path, sha256, size of artifacts."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return rows.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"))


def latest_artifact(spark: SparkSession, path: str, pattern: str = "*.epub") -> DataFrame:
    """The artifact modified last; contents are not read."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return rows.select("path", "modificationTime").agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path"), F.max("modificationTime").alias("modified_at"))


def golden_cases(spark: SparkSession, path: str) -> DataFrame:
    """One row per case of golden dataset files: type ANSWERABLE unless given, expected documents normalised, once each, without quiz pages."""
    cases = spark.read.schema(GOLDEN).json(path, multiLine=True).select(F.col("name").alias("dataset"), "projectId", F.explode("cases").alias("c")).select("dataset", F.col("projectId").alias("project_id"), "c.*")
    paths = F.array_distinct(F.filter(F.transform(F.coalesce("expectedDocuments", F.array().cast("array<string>")), T.normalize_path), lambda p: p.isNotNull() & (F.lower(T.file_name(p)) != "quiz.xhtml")))
    return cases.select("dataset", "project_id", F.col("id").alias("case_id"), F.coalesce("type", F.lit("ANSWERABLE")).alias("type"), "question", F.col("referenceAnswer").alias("reference_answer"), paths.alias("expected_documents"))


def releases(spark: SparkSession, path: str) -> DataFrame:
    """Release files, newest first."""
    return spark.read.schema(RELEASES).json(path, multiLine=True).orderBy(F.desc("releasedAt"), "releaseId")


def write_json(rows: DataFrame, path: str, overwrite: bool = False, by: str | None = None) -> None:
    """Reports, comparisons, baselines and releases; existing ones are an error unless overwrite is set. With by each value of that column has a folder of its own with one file."""
    rows = rows if by is None else rows.repartition(by)
    writer = rows.write.mode("overwrite" if overwrite else "errorifexists")
    (writer if by is None else writer.partitionBy(by)).json(path)


def read_table(spark: SparkSession, url: str, table: str, partition_column: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 1, **options) -> DataFrame:
    """A table of a JDBC database, such as conversations or their messages; read in as many partitions as bounds of a numeric column give."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if partition_column and bounds:
        reader = reader.options(partitionColumn=partition_column, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=partitions)
    return reader.load()


def write_table(rows: DataFrame, url: str, table: str, mode: str = "append", **options) -> None:
    rows.write.format("jdbc").options(url=url, dbtable=table, **options).mode(mode).save()
