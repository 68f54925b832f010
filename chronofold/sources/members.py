"""Members of ZIP archives as partitions of their own.

An archive's directory stands at its end, so a file that can be read by ranges
gives up its list of members without being read.  Each member is then one
task's, which inflates it as it goes: what is held is a block, whatever the
sizes of the archive and of the member.
"""

from __future__ import annotations

import fnmatch
import io
import zipfile
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from chronofold.staging import arrow_file



def _open(uri: str):
    """A file of any store that Arrow can open by its address, with random access."""
    store, path = arrow_file(uri)
    return store.open_input_file(path)


def _archives(uri: str) -> list[str]:
    """The archives in a folder, or the one that is named."""
    from pyarrow import fs

    store, path = arrow_file(uri)
    info = store.get_file_info(path)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(uri)
    if info.type != fs.FileType.Directory:
        return [uri]
    return sorted(f"{uri.rstrip('/')}/{f.base_name}" for f in store.get_file_info(fs.FileSelector(path)) if f.base_name.lower().endswith(".zip"))


class _Member(InputPartition):
    def __init__(self, archive: str, name: str):
        super().__init__((archive, name))
        self.archive, self.name = archive, name


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.pattern = options["path"], options.get("members", "*")
        self.encoding = options.get("encoding", "utf-8")

    def partitions(self) -> list[InputPartition]:
        found = []
        for archive in _archives(self.path):
            with _open(archive) as file, zipfile.ZipFile(file) as z:
                found += [_Member(archive, i.filename) for i in z.infolist() if not i.is_dir() and fnmatch.fnmatchcase(i.filename, self.pattern)]
        return found or [_Member("", "")]

    def read(self, partition: _Member) -> Iterator[tuple]:
        if not partition.archive:
            return
        with _open(partition.archive) as file, zipfile.ZipFile(file) as z, z.open(partition.name) as body:
            for number, line in enumerate(io.TextIOWrapper(body, self.encoding, newline=None)):
                yield partition.archive, partition.name, number, line.removesuffix("\n")


class ZipLines(DataSource):
    """``spark.read.format("zip_lines")``: archive, member, number and line of each line of each member.

    Options: ``path`` of an archive or of a folder of them, as an address that
    Arrow can open; ``members``, a pattern of names; ``encoding``.  A member
    whose checksum is wrong, or a file that is no archive, is an error.
    """

    @classmethod
    def name(cls) -> str:
        return "zip_lines"

    def schema(self) -> str:
        return "archive string, member string, number long, line string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)
