"""A store of fitted models in a shared folder: immutable versions, published all at once.

A version is a folder of its own, ``<root>/<kind>/v<number>-<attempt>``, that a writer fills (model tables, a
``PipelineModel``, several of them). The file ``_COMMITTED`` comes last and holds what is said about
the version; a version without it was never finished, is never loaded, and its folder is never written to again.
This needs no rename, so it works alike on a file system and on an object store.

Two writers at a time may take the same number; their folders differ, both are complete, and the
attempt's name decides which is the latest.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from typing import Any, TypeVar

from pyspark.sql import SparkSession

COMMITTED = "_COMMITTED"
Model = TypeVar("Model")


@dataclass(frozen=True, order=True)
class Version:
    number: int
    attempt: str
    path: str
    complete: bool


class ModelStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _at(self, path: str):
        """(file system, path) of Hadoop's interface, which knows every store that Spark writes to."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def versions(self, kind: str, complete: bool | None = True) -> list[Version]:
        """Versions of a kind, oldest first: complete ones, unfinished ones (``False``) or both (``None``)."""
        fs, folder = self._at(f"{self.root}/{kind}")
        if not fs.exists(folder):
            return []
        found = []
        for status in fs.listStatus(folder):
            number, _, attempt = status.getPath().getName().removeprefix("v").partition("-")
            if status.isDirectory() and number.isdigit() and attempt:
                path = status.getPath().toString()
                found.append(Version(int(number), attempt, path, fs.exists(self._at(f"{path}/{COMMITTED}")[1])))
        return sorted(v for v in found if complete is None or v.complete == complete)

    def publish(self, kind: str, write: Callable[[str], None], about: Mapping[str, Any] | None = None) -> Version:
        """A new version: ``write(path)`` fills its folder, then the marker makes it the latest. If ``write``
        fails, nothing is published."""
        number = max((v.number for v in self.versions(kind, None)), default=0) + 1
        attempt = uuid.uuid4().hex
        path = f"{self.root}/{kind}/v{number:08d}-{attempt}"
        write(path)
        fs, marker = self._at(f"{path}/{COMMITTED}")
        out = fs.create(marker, False)
        out.write(bytearray(json.dumps(dict(about or {})), "utf-8"))
        out.close()
        return Version(number, attempt, path, True)

    def latest(self, kind: str) -> Version | None:
        return max(self.versions(kind), default=None)

    def about(self, version: Version) -> dict[str, Any]:
        """What the writer said about a version."""
        fs, marker = self._at(f"{version.path}/{COMMITTED}")
        stream = fs.open(marker)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def load(self, kind: str, read: Callable[[str], Model]) -> Model:
        """``read(path)`` of the latest complete version."""
        version = self.latest(kind)
        if version is None:
            raise LookupError(f"no complete version of {kind} below {self.root}")
        return read(version.path)

    def publish_pipeline(self, kind: str, model, about: Mapping[str, Any] | None = None) -> Version:
        """A fitted ``PipelineModel``, or any other model of Spark's library."""
        return self.publish(kind, lambda path: model.write().save(f"{path}/model"), about)

    def load_pipeline(self, kind: str):
        from pyspark.ml import PipelineModel

        return self.load(kind, lambda path: PipelineModel.load(f"{path}/model"))
