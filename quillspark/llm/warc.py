"""WARC files and their fixity audit by Merkle trees.

Every task writes its pages as WARC records, each a gzip member of its own, into files of its own and returns an index row for each
record (file, number, offset, length, digest), so nothing is shuffled to write. A replica is a copy of the files
under another folder. Trees have records as leaves (the digest of a record's offset, length and stored bytes), ordered offset
ranges of NODE_BYTES above them (the digest of the records that begin there, in order), and up to FANOUT consecutive ranges a node
from there on, up to one root a file. The expected tree comes from the index alone, and each replica's from its bytes, read
anew. Roots are compared first, and only below nodes that differ are the next levels joined and compared, down to the
damaged records, whichever replicas they are in and even if all are damaged alike.

Defined results. Null html is an empty body, a null url the empty string. Records are whole, however long. Repeated rows are
repeated records. Bytes that are missing at a file's end make the records concerned damaged; a missing file makes all of its records so.
An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, new_folder, read
from .media import file_system

FANOUT = 16
FILE_BYTES = 64 << 20  # a file is closed beyond this
NODE_BYTES = 256 << 10  # of a file, for the lowest ranges of a tree
RANGE_BYTES = 4 << 20  # read at once
DRILL = 64  # one in so many records of the second replica is damaged on purpose by the query
LEVEL = 1  # of gzip
DATE = "1970-01-01T00:00:00Z"  # records carry no time of their own, so that a rewrite gives the same bytes

INDEX = "file string, number long, offset long, length long, page_id long, url string, record_sha256 string"


def record(page_id: int | None, url: str, body: bytes) -> bytes:
    digest = hashlib.sha256(body).hexdigest()
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id} {url} {digest}")
    clean = url.replace("\r", "%0D").replace("\n", "%0A")
    head = f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:{name}>\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: {clean}\r\nWARC-Block-Digest: sha256:{digest}\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n"
    return gzip.compress(head.encode() + body + b"\r\n\r\n", LEVEL, mtime=0)


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Write pages (page_id, url, html) as WARC files under folder; returns their index, written once in the shared folder.

    File names are new for each attempt of a task, and only files of the attempt whose index was kept are listed.
    """

    def run(batches):
        import pyarrow as pa

        system, path = file_system(folder)
        rows, sink, number = [], None, 0

        def batch():
            columns = zip(*rows)
            kinds = [pa.string(), *[pa.int64()] * 4, pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [c.split()[0] for c in INDEX.split(", ")])

        for incoming in batches:
            for page_id, url, html in zip(*(incoming.column(i).to_pylist() for i in range(3))):
                if sink is None:
                    name, number, at = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    sink = system.open_output_stream(f"{path}/{name}", compression=None)
                data = record(page_id, url or "", (html or "").encode())
                sink.write(data)
                rows.append((name, number, at, len(data), page_id, url, hashlib.sha256(data).hexdigest()))
                number, at = number + 1, at + len(data)
                if at > FILE_BYTES:
                    sink.close()
                    sink = None
            if rows:
                yield batch()
                rows = []
        if sink is not None:
            sink.close()

    system, path = file_system(folder)
    system.create_dir(path, recursive=True)
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return cut(rows.mapInArrow(run, INDEX))


def replicate(index: DataFrame, source: str, target: str, spoiled: str = "false") -> None:
    """Copy the indexed files to another folder, a file a task at a time. A byte of each record for which the condition spoiled holds is changed, for drills."""

    def run(batches):
        import pyarrow as pa

        a, at = file_system(source)
        b, to = file_system(target)
        for batch in batches:
            names = batch.column(0).to_pylist()
            for name, spots in zip(names, batch.column(1).to_pylist()):
                done = 0
                with a.open_input_stream(f"{at}/{name}", compression=None) as old, b.open_output_stream(f"{to}/{name}", compression=None) as new:
                    while block := old.read(8 << 20):
                        wrong = [x - done for x in spots if done <= x < done + len(block)]
                        if wrong:
                            block = bytearray(block)
                            for x in wrong:
                                block[x] ^= 1
                        new.write(bytes(block))
                        done += len(block)
            yield pa.RecordBatch.from_arrays([pa.array([len(names)], pa.int64())], ["files"])

    system, path = file_system(target)
    system.create_dir(path, recursive=True)
    spot = F.when(F.expr(spoiled), F.col("offset") + F.floor(F.col("length") / 2))  # a file holds few records, FILE_BYTES in all
    index.groupBy("file").agg(F.collect_list(spot).alias("spots")).mapInArrow(run, "files long").agg(F.sum("files")).collect()


def leaves(index: DataFrame, folder: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The index rows' file, number, offset and length, with the digest of the record's bytes as they are now, null if some are missing."""

    def run(batches):
        import pyarrow as pa

        system, path = file_system(folder)
        for batch in batches:
            files, numbers, offsets, lengths = [], [], [], []
            for name, members in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for m in members:
                    files.append(name)
                    numbers.append(m["number"])
                    offsets.append(m["offset"])
                    lengths.append(m["length"])
            found, source, name = [], None, None
            for file, offset, length in zip(files, offsets, lengths):
                if file != name:
                    if source:
                        source.close()
                    name, source = file, None
                    try:
                        source = system.open_input_file(f"{path}/{file}")
                    except FileNotFoundError:
                        pass
                data = b""
                if source:
                    try:
                        source.seek(offset)
                        data = source.read(length)
                    except OSError:
                        data = b""
                found.append(hashlib.sha256(data).hexdigest() if len(data) == length else None)
            if source:
                source.close()
            columns = [pa.array(files, pa.string()), *(pa.array(x, pa.int64()) for x in (numbers, offsets, lengths)), pa.array(found, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["file", "number", "offset", "length", "record_sha256"])

    block = F.floor(F.col("offset") / range_bytes)
    ranges = index.groupBy("file", block.alias("block")).agg(F.sort_array(F.collect_list(F.struct("offset", "number", "length"))).alias("members"))  # the records that begin in range_bytes
    # index rows are few bytes for many bytes of file, so tasks are counted by those
    total = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(index.sparkSession.sparkContext.defaultParallelism, -(-total // (4 * range_bytes)))
    return ranges.repartition(tasks, "file", "block").select("file", "members").mapInArrow(run, "file string, number long, offset long, length long, record_sha256 string")


def tree(records: DataFrame, last: int, fanout: int = FANOUT, node_bytes: int = NODE_BYTES) -> list[DataFrame]:
    """Levels (file, node, parent, digest) of the Merkle trees of files, records first, roots last; last is the greatest offset of all."""

    def above(level: DataFrame) -> DataFrame:
        kids = F.sort_array(F.collect_list(F.struct("node", "digest")))
        grouped = level.groupBy("file", F.col("parent").alias("node")).agg(kids.alias("kids"))
        return grouped.select("file", "node", F.floor(F.col("node") / fanout).alias("parent"), F.sha2(F.concat_ws(",", F.col("node").cast("string"), F.col("kids.digest")), 256).alias("digest"))

    stored = F.concat_ws(":", F.col("offset").cast("string"), F.col("length").cast("string"), F.coalesce("record_sha256", F.lit("")))
    out = [cut(records.select("file", F.col("number").alias("node"), F.floor(F.col("offset") / node_bytes).alias("parent"), F.sha2(stored, 256).alias("digest")))]
    width = last // node_bytes
    out.append(cut(above(out[-1])))
    while width:
        width //= fanout
        out.append(cut(above(out[-1])))
    return out


def descend(expected: list[DataFrame], actual: list[DataFrame]) -> tuple[DataFrame, list[int]]:
    """(file, number) of the records in which two trees differ, found from the roots down, and how many nodes were compared on each level from the roots on."""
    bad, compared = None, []
    for one, other in zip(reversed(expected), reversed(actual)):
        if bad is not None:
            one, other = (x.join(bad, ["file", "parent"], "left_semi") for x in (one, other))
        other = other.select("file", "node", F.col("digest").alias("now"))
        pair = cut(one.select("file", "node", "digest").join(other, ["file", "node"], "full").select("file", "node", F.col("digest").eqNullSafe(F.col("now")).alias("same")))
        compared.append(pair.count())
        differing = pair.where("not same")
        bad = differing.select("file", F.col("node").alias("parent"))
        if differing.isEmpty():
            break
    return bad.select("file", F.col("parent").alias("number")), compared


def audit(index: DataFrame, folders: list[str], fanout: int = FANOUT, node_bytes: int = NODE_BYTES) -> DataFrame:
    """Index rows with status: intact, or damaged with the replicas (numbers in folders) whose bytes aren't those that were written."""
    last = index.agg(F.max("offset")).first()[0]
    written = tree(index, last or 0, fanout, node_bytes)
    bad = None
    for n, folder in enumerate(folders):
        found, _ = descend(written, tree(leaves(index, folder), last or 0, fanout, node_bytes))
        found = found.withColumn("replica", F.lit(n))
        bad = found if bad is None else bad.unionByName(found)
    bad = bad.groupBy("file", "number").agg(F.sort_array(F.collect_set("replica")).alias("damaged_in"))
    out = index.join(bad, ["file", "number"], "left")
    return out.withColumn("status", F.when(F.col("damaged_in").isNull(), "intact").otherwise("damaged"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages are written as WARC and replicated, with one in DRILL records of the replica damaged on the way (planted), and audited; a row per record."""
    first, second = new_folder(spark, "warc"), new_folder(spark, "warc-replica")
    planted = f"coalesce(pmod(xxhash64(page_id), {DRILL}) = 0, false)"
    index = write(read(spark, sf_dir, "pages"), first)
    replicate(index, first, second, planted)
    found = audit(index, [first, second])
    return found.select("page_id", "url", "file", "number", "offset", "length", "record_sha256", "status", F.array_join(F.col("damaged_in").cast("array<string>"), ",").alias("damaged_in"), F.expr(planted).alias("planted"))


QUERIES = {"op8_warc": op8_warc}
SQL: dict[str, str] = {}
