"""A registry that several writers may change at once, by optimistic commits.

A writer reads the latest committed version, writes the changed rows to a folder of its own, and then
creates the commit marker of the next version, which names that folder.  Creating fails if the marker
exists: another writer was first, so the change is made again on top of that version.  Readers see only
committed versions; folders of attempts that lost are never read.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from py4j.protocol import Py4JJavaError

from lexiforge.operators import registry


class RegistryStore:
    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    def _path(self, name: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
        return place, place.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _read(self, version: int) -> str:
        place, fs = self._path(f"commits/{version:020d}")
        stream = fs.open(place)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def version(self) -> int:
        """The latest committed version, -1 if there is none.  A marker that is still empty is not committed."""
        place, fs = self._path("commits")
        if not fs.exists(place):
            return -1
        done = [int(f.getPath().getName()) for f in fs.listStatus(place) if f.getPath().getName().isdigit() and f.getLen() > 0]
        return max(done, default=-1)

    def load(self, version: int | None = None) -> DataFrame:
        version = self.version() if version is None else version
        if version < 0:
            return registry.empty(self.spark)
        return self.spark.read.schema(registry.SCHEMA).parquet(self._read(version))

    def _commit(self, version: int, data: str) -> bool:
        """Create the marker if it does not exist; False if another writer was first."""
        place, fs = self._path(f"commits/{version:020d}")
        fs.mkdirs(place.getParent())
        if fs.getUri().getScheme() == "file":  # a whole file appears at once under a name that must be new
            target = place.toUri().getPath()
            draft = f"{os.path.dirname(target)}/.{uuid.uuid4().hex}"
            with open(draft, "w") as f:
                f.write(data)
            try:
                os.link(draft, target)
                return True
            except FileExistsError:
                return False
            finally:
                os.unlink(draft)
        try:
            stream = fs.create(place, False)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception) or fs.exists(place):
                return False
            raise
        stream.write(bytearray(data.encode()))
        stream.close()
        return True

    def change(self, change: Callable[[DataFrame], DataFrame], attempts: int = 50) -> int:
        """Apply ``change`` to the latest rows and commit the result; returns its version."""
        for _ in range(attempts):
            version = self.version()
            data = f"{self.base}/data/{uuid.uuid4().hex}"
            change(self.load(version)).write.parquet(data)
            if self._commit(version + 1, data):
                return version + 1
        raise RuntimeError(f"no commit in {attempts} attempts")

    def upsert(self, incoming: DataFrame) -> int:
        return self.change(lambda existing: registry.upsert(existing, incoming))
