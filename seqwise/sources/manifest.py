"""Numbered manifests in a folder, each committed by an atomic rename.

Works on any file system that Hadoop's ``FileContext`` serves; on one whose
rename is not atomic (some object stores) commits need a single writer."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Manifests:
    """``<folder>/<number>.json``; the largest number is the current state."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, name: str = ""):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def numbers(self) -> list[int]:
        fs = self._path().getFileSystem(self.conf)
        if not fs.exists(self._path()):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(self._path())]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def read(self, number: int) -> dict:
        # wholetext: a manifest is one row
        return json.loads(self.spark.read.text(f"{self.folder}/{number:012d}.json", wholetext=True).first()[0])

    def newest(self) -> tuple[int, dict] | None:
        numbers = self.numbers()
        return (numbers[-1], self.read(numbers[-1])) if numbers else None

    def commit(self, number: int, state: dict) -> None:
        """Publish ``state`` as ``number``; fails if that number is taken."""
        at = self._path()
        fs = at.getFileSystem(self.conf)
        fs.mkdirs(at)
        part = self._path(f".{uuid.uuid4().hex}.tmp")
        out = fs.create(part, True)
        try:
            out.write(bytearray(json.dumps(state).encode()))
        finally:
            out.close()
        no_overwrite = self.spark.sparkContext._gateway.new_array(
            getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(at).toUri(), self.conf)
        context.rename(fs.makeQualified(part), fs.makeQualified(self._path(f"{number:012d}.json")), no_overwrite)
