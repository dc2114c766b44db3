"""A data source that reads archives of repositories (zip, tar, with or without compression) as file rows, a partition for each archive.

    spark.dataSource.register(RepositoryArchives)
    spark.read.format("repository_archives").option("max_bytes", 524288).load("/archives")

Rows are as those of `read_directory`: repo_name is the archive's name without its endings, and the one folder that
all of an archive's files lie in, if there is one, is no part of their paths.
"""

from __future__ import annotations

import io
import posixpath
import re
import tarfile
import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from chunkwell.sources.files import EXCLUDE, INCLUDE, MAX_BYTES, glob_regex

FILES = "repo_name string, file_path string, file_type string, content string"
ENDINGS = re.compile(r"\.(zip|tar|tar\.gz|tgz|tar\.bz2|tbz2|tar\.xz|txz)\Z", re.I)


class Archive(InputPartition):
    """One archive, by its path."""

    def __init__(self, path: str) -> None:
        self.path = path


class RepositoryArchives(DataSource):
    """Options: path (a folder or an archive, of any store that Arrow reads), max_bytes."""

    @classmethod
    def name(cls) -> str:
        return "repository_archives"

    def schema(self) -> str:
        return FILES

    def reader(self, schema: object) -> ArchiveReader:
        return ArchiveReader(self.options["path"], int(self.options.get("max_bytes", MAX_BYTES)))


class ArchiveReader(DataSourceReader):
    """Lists archives on the driver, reads each in a task of its own."""

    def __init__(self, path: str, max_bytes: int) -> None:
        self.path, self.max_bytes = path, max_bytes

    def partitions(self) -> list[Archive]:
        from pyarrow import fs

        files, base = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        at = files.get_file_info(base)
        found = [at] if at.is_file else files.get_file_info(fs.FileSelector(base, recursive=True))
        head = self.path[: -len(base)] if self.path.endswith(base) and "://" in self.path else ""
        return [Archive(head + x.path) for x in sorted(found, key=lambda x: x.path) if x.is_file and ENDINGS.search(x.path)]

    def read(self, partition: Archive) -> Iterator[tuple[str, str, str, str]]:
        from pyarrow import fs

        files, path = fs.FileSystem.from_uri(partition.path) if "://" in partition.path else (fs.LocalFileSystem(), partition.path)
        include, exclude = (re.compile(glob_regex(p).replace(r"\z", r"\Z")) for p in (INCLUDE, EXCLUDE))
        repo = ENDINGS.sub("", posixpath.basename(path))
        with files.open_input_file(path) as stream:
            top = _common_folder([name for name, _, _ in _entries(stream)])
            stream.seek(0)
            for name, size, load in _entries(stream):
                inner = name[len(top) :]
                if size <= self.max_bytes and include.search(inner) and not exclude.search(inner):
                    yield repo, inner, _file_type(inner), load().decode("utf-8", "replace").replace("\r\n", "\n")


def _entries(stream: io.IOBase) -> Iterator[tuple[str, int, object]]:
    """Paths, sizes and readers of an archive's files, in its order."""
    if zipfile.is_zipfile(stream):
        stream.seek(0)
        with zipfile.ZipFile(stream) as archive:
            for info in archive.infolist():
                if not info.is_dir():
                    yield info.filename, info.file_size, lambda info=info: archive.read(info)
        return
    stream.seek(0)
    with tarfile.open(fileobj=stream, mode="r:*") as archive:
        for info in archive:
            if info.isfile():
                yield info.name.removeprefix("./"), info.size, lambda info=info: archive.extractfile(info).read()


def _common_folder(names: list[str]) -> str:
    """The first folder with its slash, if all files lie in it."""
    tops = {n.partition("/")[0] if "/" in n else "" for n in names}
    return tops.pop() + "/" if len(tops) == 1 and "" not in tops else ""


def _file_type(path: str) -> str:
    """As the column function `file_type`."""
    name = posixpath.basename(path)
    bare = name.lstrip(".")
    return bare.rpartition(".")[2].lower() if "." in bare else "unknown"


def read_archives(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """The files of all archives below a path."""
    spark.dataSource.register(RepositoryArchives)
    return spark.read.format(RepositoryArchives.name()).option("max_bytes", max_bytes).load(path)
