"""Media columns by a custom Spark data source over archive directories.

Payloads are stored as 8-bit grey images (PNG, 576 samples a row) in ZIP archives, one member each, uncompressed by the
archive itself so that a member's bytes lie in one range. `media_archive` is a Spark data source:

* Writing: every task streams its rows into archives of its own, under a name of its own, so a repeated task never
  shares a file with its first attempt. The commit lists the archives of the successful tasks in a manifest; others are never read.
* Reading: the driver plans byte ranges from the archives' sizes in the manifest (one row an archive). A task reads an
  archive's central directory, takes the members whose headers begin in its range, streams their payloads
  in offset order and yields Arrow batches of bounded size. A member whose bytes or checksum are wrong is read again alone, by its
  offset, RETRIES times; then its row holds an error in place of the payload, and the other members go on.

Files are reached through Arrow's file systems, so the folder may be any that they know (local, object store, HDFS).

Defined results. Null text is the empty text, of one row of 576 bytes 255. Payloads are whole, however long. Repeated rows are
repeated members. An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zipfile
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .common import byte_texts, new_folder, read

ROW = 576
LEVEL = 1  # of zlib
ARCHIVE_BYTES = 128 << 20  # an archive is closed beyond this
RANGE_BYTES = 16 << 20
BATCH_BYTES = 4 << 20
RETRIES = 3
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def padded(text: bytes) -> bytes:
    return text + b"\xff" * (-len(text) % ROW or (0 if text else ROW))


def png(payload: bytes) -> bytes:
    """The payload as the samples of a grey image, ROW a line."""
    height = len(payload) // ROW
    lines = b"".join(b"\0" + payload[i : i + ROW] for i in range(0, len(payload), ROW))

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", ROW, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines, LEVEL)) + chunk(b"IEND", b"")


def samples(image: bytes) -> bytes:
    """The samples of an image written by png."""
    if image[:8] != SIGNATURE:
        raise ValueError("no PNG")
    at, data = 8, []
    while at < len(image):
        n, kind = struct.unpack_from(">I4s", image, at)
        body = image[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", image, at + 8 + n)[0]:
            raise ValueError(f"checksum of {kind!r}")
        if kind == b"IHDR":
            width, height, depth, color = struct.unpack_from(">IIBB", body)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    lines = zlib.decompress(b"".join(data))
    if (depth, color) != (8, 0) or len(lines) != height * (width + 1) or any(lines[:: width + 1]):
        raise ValueError("not an image written here")
    return b"".join(lines[i + 1 : i + 1 + width] for i in range(0, len(lines), width + 1))


def file_system(path: str):
    """The Arrow file system of a path or URI, and the path within it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class Range(InputPartition):
    def __init__(self, archive: str, first: int, end: int) -> None:
        self.archive, self.first, self.end = archive, first, end


class Written(WriterCommitMessage):
    def __init__(self, archives: list[tuple[str, int]]) -> None:
        self.archives = archives


class ArchiveWriter(DataSourceArrowWriter):
    """Rows are (id, media)."""

    def __init__(self, folder: str) -> None:
        self.folder, self.run = folder, uuid.uuid4().hex
        system, path = file_system(folder)
        system.create_dir(path, recursive=True)

    def write(self, iterator):
        system, path = file_system(self.folder)
        done, archive, sink, n = [], None, None, 0

        def close():
            archive.close()
            done.append((name, sink.tell()))
            sink.close()

        for batch in iterator:
            for i, media in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if archive is None:
                    name = f"{uuid.uuid4().hex}.zip"
                    sink = system.open_output_stream(f"{path}/{name}")
                    archive = zipfile.ZipFile(Unseekable(sink), "w", zipfile.ZIP_STORED)
                archive.writestr(f"{n}/{'' if i is None else i}.png", media)
                n += 1
                if sink.tell() > ARCHIVE_BYTES:
                    close()
                    archive = None
        if archive is not None:
            close()
        return Written(done)

    def commit(self, messages) -> None:
        system, path = file_system(self.folder)
        with system.open_output_stream(f"{path}/manifest-{self.run}.json") as f:
            f.write(json.dumps([a for m in messages if m for a in m.archives]).encode())

    def abort(self, messages) -> None:
        system, path = file_system(self.folder)
        for name in (a for m in messages if m for a, _ in m.archives):
            system.delete_file(f"{path}/{name}")


class Unseekable:
    """What zipfile needs to write to a stream."""

    def __init__(self, sink) -> None:
        self.sink = sink

    def write(self, data) -> int:
        self.sink.write(data)
        return len(data)

    def flush(self) -> None:
        self.sink.flush()


def member_id(name: str) -> int | None:
    value = name.rpartition("/")[2].removesuffix(".png")
    return int(value) if value else None


def member_at(source, offset: int, size: int, crc: int) -> bytes:
    """The bytes of the member whose local header begins at offset."""
    source.seek(offset)
    head = source.read(30)
    if head[:4] != b"PK\3\4":
        raise ValueError(f"no member at {offset}")
    name, extra = struct.unpack_from("<HH", head, 26)
    data = source.read(name + extra + size)[name + extra :]
    if len(data) != size or zlib.crc32(data) != crc:
        raise ValueError(f"damaged member at {offset}")
    return data


class ArchiveReader(DataSourceReader):
    def __init__(self, folder: str, range_bytes: int) -> None:
        self.folder, self.range_bytes = folder, range_bytes

    def partitions(self):
        from pyarrow import fs

        system, path = file_system(self.folder)
        out = []
        for info in system.get_file_info(fs.FileSelector(path)):
            if info.base_name.startswith("manifest-"):
                with system.open_input_stream(info.path) as f:
                    for name, size in json.loads(f.read()):
                        out += [Range(name, a, a + self.range_bytes) for a in range(0, size, self.range_bytes)]
        return out or [Range("", 0, 0)]

    def read(self, partition):
        import pyarrow as pa

        if not partition.archive:
            return
        system, path = file_system(self.folder)
        file = f"{path}/{partition.archive}"
        rows, held = [], 0

        def batch():
            columns = list(zip(*rows))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["id", "archive", "offset", "media", "error"])

        with system.open_input_file(file) as source:
            members = [m for m in zipfile.ZipFile(source).infolist() if partition.first <= m.header_offset < partition.end]
        with system.open_input_file(file) as source:
            for m in sorted(members, key=lambda m: m.header_offset):
                media, error = None, None
                try:
                    media = member_at(source, m.header_offset, m.file_size, m.CRC)
                except (OSError, ValueError, struct.error):
                    media, error = self.again(system, file, m)
                rows.append((member_id(m.filename), partition.archive, m.header_offset, media, error))
                held += len(media or b"")
                if held > BATCH_BYTES:
                    yield batch()
                    rows, held = [], 0
        if rows:
            yield batch()

    @staticmethod
    def again(system, file: str, m):
        """The member read alone by its offset, from the file opened anew each time."""
        for _ in range(RETRIES):
            try:
                with system.open_input_file(file) as source:
                    return member_at(source, m.header_offset, m.file_size, m.CRC), None
            except (OSError, ValueError, struct.error) as e:
                error = str(e)
        return None, error


class MediaArchive(DataSource):
    """spark.read.format("media_archive").load(folder); df.write.format("media_archive").mode("append").save(folder)."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return "id long, archive string, offset long, media binary, error string"

    def reader(self, schema):
        return ArchiveReader(self.options["path"], int(self.options.get("rangeBytes", RANGE_BYTES)))

    def writer(self, schema, overwrite: bool):
        if overwrite:
            raise ValueError("archives are only appended")
        return ArchiveWriter(self.options["path"])


def images(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and media (the text's UTF-8 bytes, padded, as an image) of every row."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                part = batch.slice(begin, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([png(padded(t)) for t in byte_texts(part.column(1))], pa.binary())], ["id", "media"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, media binary")


def store(media: DataFrame, folder: str) -> None:
    """Write (id, media) rows into archives under folder."""
    media.sparkSession.dataSource.register(MediaArchive)
    media.write.format("media_archive").mode("append").save(folder)


def load(spark: SparkSession, folder: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """id, archive, offset, media, error of every member under folder."""
    spark.dataSource.register(MediaArchive)
    return spark.read.format("media_archive").option("rangeBytes", range_bytes).load(folder)


def feature(payload: bytes) -> str:
    """Mean, variance and entropy of the samples and the mean step between neighbours, in thousandths."""
    import numpy as np

    x = np.frombuffer(payload, np.uint8)
    n = np.bincount(x, minlength=256)
    share = n[n > 0] / len(x)
    levels = np.arange(256)
    mean = int((n * levels).sum()) / len(x)
    square = int((n * levels * levels).sum()) / len(x)
    step = int(np.abs(np.diff(x.astype(np.int16))).sum(dtype=np.int64)) / (len(x) - 1)
    return ";".join(f"{k}={round(v * 1000)}" for k, v in (("mean", mean), ("variance", square - mean * mean), ("entropy", -(share * np.log2(share)).sum()), ("step", step)))


def described(members: DataFrame) -> DataFrame:
    """Digests and features of the payloads read back from members; rows with an error have nulls."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"
    names = [c.split()[0] for c in schema.split(", ")]

    def row(i, media, error):
        if media is None:
            return i, None, None, None, None, None, None, None, error
        payload = samples(media)
        # bytes 255 occur in no UTF-8 text
        return i, len(payload.rstrip(b"\xff")), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload), error

    def run(batches):
        import pyarrow as pa

        kinds = [pa.int64()] * 3 + [pa.string()] + [pa.int64()] * 2 + [pa.string()] * 3
        for batch in batches:
            columns = zip(*(row(*r) for r in zip(*(batch.column(c).to_pylist() for c in range(3)))))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return members.select("id", "media", "error").mapInArrow(run, schema)


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a stored image, read back and described. A member that can't be read after all retries has its error, and nulls in the other columns."""
    folder = new_folder(spark, "media")
    store(images(read(spark, sf_dir, "documents")), folder)
    return described(load(spark, folder))


QUERIES = {"op7_media": op7_media}
SQL: dict[str, str] = {}
