"""Releases, one file each, written all or none.

`write` saves rows as `<folder>/<project_id>/releases/<release_id>.json`. Tasks write drafts; only when all have ended are these put in place, and not if any release is
there already or comes twice. A job that fails leaves no release, and a task that is run again leaves no second one, as drafts of lost attempts are not named by the commit.
"""

from __future__ import annotations

import os
import re
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

NAME = re.compile(r"[\w.-]+")


def file_system(path: str):
    """The file system of a path, as Arrow knows it, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if re.match(r"[a-z0-9]+:", path) else (fs.LocalFileSystem(), os.path.abspath(path))


def exists(files, path: str) -> bool:
    from pyarrow import fs

    return files.get_file_info(path).type != fs.FileType.NotFound


def remove(files, paths) -> None:
    for path in paths:
        if exists(files, path):
            files.delete_file(path)


@dataclass
class Drafts(WriterCommitMessage):
    pairs: list  # (draft, place)


class ReleaseWriter(DataSourceWriter):
    def __init__(self, folder: str) -> None:
        self.folder = folder

    def write(self, iterator):
        files, folder = file_system(self.folder)
        pairs = []
        try:
            for row in iterator:
                if not all(NAME.fullmatch(x or "") and x.strip(".") for x in (row.project_id, row.release_id)):
                    raise ValueError(f"not a name: {row.project_id!r}, {row.release_id!r}")
                draft, place = f"{folder}/_drafts/{uuid.uuid4().hex}", f"{folder}/{row.project_id}/releases/{row.release_id}.json"
                files.create_dir(f"{folder}/_drafts", recursive=True)
                pairs.append((draft, place))
                with files.open_output_stream(draft) as out:
                    out.write(row.content.encode())
        except BaseException:
            remove(files, (d for d, _ in pairs))
            raise
        return Drafts(pairs)

    def commit(self, messages) -> None:
        from pyarrow import fs

        files, _ = file_system(self.folder)
        pairs, done = [p for m in messages if m for p in m.pairs], []
        places = [place for _, place in pairs]
        try:
            taken = sorted({p for p in places if places.count(p) > 1} if len(set(places)) < len(places) else {p for p in places if exists(files, p)})
            if taken:
                raise FileExistsError(f"releases that exist or come twice: {', '.join(taken)}")
            for draft, place in pairs:
                files.create_dir(place.rpartition("/")[0], recursive=True)
                if isinstance(files, fs.LocalFileSystem):
                    os.link(draft, place)  # fails if another writer has been here meanwhile
                else:
                    files.copy_file(draft, f"{place}.new")
                    files.move(f"{place}.new", place)
                done.append(place)
        except BaseException:
            remove(files, done)
            raise
        finally:
            remove(files, (d for d, _ in pairs))

    def abort(self, messages) -> None:
        files, _ = file_system(self.folder)
        remove(files, (d for m in messages if m for d, _ in m.pairs))


class ReleaseFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "release_files"

    def schema(self) -> str:
        return "project_id string, release_id string, content string"

    def writer(self, schema, overwrite: bool):
        return ReleaseWriter(self.options["path"])


def write(rows: DataFrame, folder: str) -> None:
    """Save releases (project_id, release_id and whatever else is to be kept), one JSON file each; all of them or, if one exists, none."""
    rows.sparkSession.dataSource.register(ReleaseFiles)
    content = F.to_json(F.struct(*rows.columns))
    rows.select(F.col("project_id").cast("string"), F.col("release_id").cast("string"), content.alias("content")).write.format("release_files").option("path", folder).mode("append").save()


def read(spark: SparkSession, folder: str, schema: str, project_id: str | None = None) -> DataFrame:
    """The releases in a folder, of one project or all."""
    return spark.read.schema(schema).json(f"{folder}/{project_id or '*'}/releases/*.json")
