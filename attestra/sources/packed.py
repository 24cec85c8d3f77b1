"""Records packed into archives: a data source whose writes are there as a whole or not at all.

Each task writes one ZIP of its records, under a name that no reader looks for; the commit lists the
archives of all tasks in one manifest, and readers take listed archives only. An aborted write removes
what its tasks have written. Paths may be URIs of any store that Arrow reaches.
"""

from __future__ import annotations

import io
import json
import uuid
import zipfile
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, StringStartsWith, WriterCommitMessage


def _files(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    archive: str | None
    names: list[str]


@dataclass
class Archive(InputPartition):
    name: str
    members: list[str] | None


class PackedWriter(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite

    def write(self, rows) -> Written:
        """One archive a task, made in memory a record at a time and written when the task has read all its rows: a
        row that fails leaves nothing."""
        files, base = _files(self.path)
        names, archive = [], f"part-{uuid.uuid4().hex}.zip"
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
            for row in rows:
                if row.name is None:
                    raise ValueError("a record needs a name")
                z.writestr(zipfile.ZipInfo(row.name), bytes(row.content or b""), zipfile.ZIP_DEFLATED)
                names.append(row.name)
        if not names:
            return Written(None, [])
        files.create_dir(base, recursive=True)
        with files.open_output_stream(f"{base}/{archive}") as f:
            f.write(held.getvalue())
        return Written(archive, names)

    def commit(self, messages: list[Written | None]) -> None:
        files, base = _files(self.path)
        files.create_dir(base, recursive=True)
        before = [] if not self.overwrite else manifests(self.path)
        name = uuid.uuid4().hex
        listed = {m.archive: sorted(m.names) for m in messages if m is not None and m.archive}
        with files.open_output_stream(f"{base}/.{name}") as f:
            f.write(json.dumps(listed).encode())
        files.move(f"{base}/.{name}", f"{base}/manifest-{name}.json")
        for old in before:
            files.delete_file(old)

    def abort(self, messages: list[Written | None]) -> None:
        files, base = _files(self.path)
        for m in messages:
            if m is not None and m.archive:
                files.delete_file(f"{base}/{m.archive}")


def manifests(path: str) -> list[str]:
    from pyarrow import fs

    files, base = _files(path)
    if files.get_file_info(base).type != fs.FileType.Directory:
        return []
    found = files.get_file_info(fs.FileSelector(base))
    return sorted(f.path for f in found if f.base_name.startswith("manifest-"))


class PackedReader(DataSourceReader):
    """Filters on the name choose members before an archive is opened."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.prefixes: list[str] = []
        self.names: set[str] | None = None

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if isinstance(f, StringStartsWith) and f.attribute == ("name",):
                self.prefixes.append(f.value)
            elif isinstance(f, (EqualTo, In)) and f.attribute == ("name",):
                own = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.names = own if self.names is None else self.names & own
            else:
                yield f

    def _wanted(self, name: str) -> bool:
        return all(name.startswith(p) for p in self.prefixes) and (self.names is None or name in self.names)

    def partitions(self) -> list[InputPartition]:
        files, _ = _files(self.path)
        out = []
        for m in manifests(self.path):
            with files.open_input_stream(m) as f:
                for archive, names in json.loads(f.read()).items():
                    members = [n for n in names if self._wanted(n)]
                    if members:
                        out.append(Archive(archive, members))
        return out or [Archive("", [])]

    def read(self, partition: Archive):
        if not partition.members:
            return
        files, base = _files(self.path)
        wanted = set(partition.members)
        with files.open_input_file(f"{base}/{partition.name}") as f, zipfile.ZipFile(f) as z:
            for info in z.infolist():
                if info.filename in wanted:
                    yield info.filename, z.read(info)


class Packed(DataSource):
    """spark.dataSource.register(Packed); df (name, content).write.format("packed").save(path)"""

    @classmethod
    def name(cls) -> str:
        return "packed"

    def schema(self) -> str:
        return "name string, content binary"

    def reader(self, schema) -> PackedReader:
        return PackedReader(self.options)

    def writer(self, schema, overwrite: bool) -> PackedWriter:
        return PackedWriter(self.options, overwrite)
