"""Numbered states of a folder of tables: a state is a small JSON file that is created once and never changed."""

from __future__ import annotations

import json
import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark import SparkContext
from pyspark.sql import SparkSession


class Files:
    """Listing, reading, exclusive creation and deletion through the file system that a path belongs to."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm = spark._jvm
        self._conf = spark._jsparkSession.sessionState().newHadoopConf()
        self._fs = self._path(root).getFileSystem(self._conf)

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _local(self, path: str) -> str | None:
        uri = self._fs.makeQualified(self._path(path)).toUri()
        return uri.getPath() if uri.getScheme() == "file" else None

    def names(self, pattern: str) -> list[str]:
        """Full paths that match a glob pattern."""
        return [found.getPath().toString() for found in self._fs.globStatus(self._path(pattern)) or []]

    def is_folder(self, path: str) -> bool:
        """A path that does not exist, or is a glob pattern, is none."""
        place = self._path(path)
        return self._fs.exists(place) and self._fs.getFileStatus(place).isDirectory()

    def read(self, path: str) -> str:
        if local := self._local(path):
            with open(local, encoding="utf-8") as file:
                return file.read()
        stream = self._fs.open(self._path(path))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, path: str, text: str) -> bool:
        """Put a whole file in place unless there is one: of several writers exactly one succeeds.

        The text is written beside it first, so nobody reads half a file. A local file is then linked, which is refused
        if the name exists; elsewhere the rename that does not overwrite decides, which HDFS does atomically.
        """
        folder, _, name = path.rpartition("/")
        spare = f"{folder}/.{name}-{uuid.uuid4().hex}"
        if local := self._local(path):
            os.makedirs(os.path.dirname(local), exist_ok=True)
            spare = self._local(spare)
            with open(spare, "w", encoding="utf-8") as file:
                file.write(text)
                file.flush()
                os.fsync(file.fileno())
            try:
                os.link(spare, local)
                return True
            except FileExistsError:
                return False
            finally:
                os.unlink(spare)
        stream = self._fs.create(self._path(spare), False)
        stream.write(bytearray(text, "utf-8"))
        stream.close()
        hadoop = self._jvm.org.apache.hadoop.fs
        no_options = SparkContext._gateway.new_array(hadoop.Options.Rename, 0)
        try:
            hadoop.FileContext.getFileContext(self._fs.getUri(), self._conf).rename(self._path(spare), self._path(path), no_options)
            return True
        except Py4JJavaError as error:
            self._fs.delete(self._path(spare), False)
            if "FileAlreadyExistsException" in str(error.java_exception):
                return False
            raise

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)


class Manifest:
    """The states ``000000000001.json``, … in a folder; the highest number counts."""

    def __init__(self, spark: SparkSession, folder: str):
        self.files, self.folder = Files(spark, folder), folder.rstrip("/")

    def _numbers(self) -> list[int]:
        return sorted(int(path.rpartition("/")[2].removesuffix(".json")) for path in self.files.names(f"{self.folder}/[0-9]*.json"))

    def _file(self, number: int) -> str:
        return f"{self.folder}/{number:012d}.json"

    def latest(self) -> tuple[int, dict] | None:
        numbers = self._numbers()
        return (numbers[-1], json.loads(self.files.read(self._file(numbers[-1])))) if numbers else None

    def put(self, number: int, state: dict) -> bool:
        """Make ``state`` the one of this number; False if another writer was first."""
        return self.files.create(self._file(number), json.dumps(state))

    def forget(self, keep: int) -> None:
        """Delete all but the last ``keep`` states."""
        for number in self._numbers()[:-keep]:
            self.files.delete(self._file(number))
