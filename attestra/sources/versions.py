"""A folder of immutable files with an atomic manifest of the current version, on any Hadoop file system.

Writers put their files under new names and then commit a manifest ``manifest-<n>`` that must not exist
yet: of two writers on one version one fails (:class:`Conflict`), and its files are never read. Readers
take the manifest of the highest version, or of the one they began with.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer has committed this version."""


class Versions:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm = spark._jvm
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def current(self) -> int:
        """The highest version, 0 before the first."""
        if not self.fs.exists(self._path("")):
            return 0
        names = [s.getPath().getName() for s in self.fs.listStatus(self._path(""))]
        return max([0, *(int(n[9:]) for n in names if n.startswith("manifest-") and n[9:].isdigit())])

    def manifest(self, version: int | None = None) -> dict:
        version = self.current() if version is None else version
        if not version:
            return {}
        stream = self.fs.open(self._path(f"manifest-{version}"))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, version: int, manifest: dict) -> None:
        """Writes the manifest whole under a name of its own, then links it to its version; a version that is there
        is a conflict. The rename doesn't replace: it is the file system's own test."""
        draft = self._path(f".draft-{uuid.uuid4().hex}")
        stream = self.fs.create(draft, False)
        try:
            stream.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        finally:
            stream.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri() if draft.toUri().getScheme() else self.fs.getUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark._sc._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(draft, self._path(f"manifest-{version}"), none)
        except Exception as e:
            self.fs.delete(draft, False)
            if "FileAlreadyExists" in str(e) or self.fs.exists(self._path(f"manifest-{version}")):
                raise Conflict(f"version {version} of {self.path} is there") from e
            raise

    def new(self, name: str) -> str:
        """A new folder's name, relative to the path."""
        return f"{name}-{uuid.uuid4().hex}"

    def full(self, name: str) -> str:
        return f"{self.path}/{name}"

    def drop(self, names: list[str]) -> None:
        for n in names:
            self.fs.delete(self._path(n), True)
