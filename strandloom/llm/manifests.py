"""Versions of a small JSON state in a folder, each published whole or not at all, by one writer only."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Lost(RuntimeError):
    """Another writer has published the version; read the newest one and try again."""


class Manifests:
    """`v<n>.json` below a folder. Publishing never replaces a version that is there: on a local disk by a hard link, elsewhere by a
    rename, which Hadoop's file systems refuse where the name is taken."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.path = spark, folder, spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(folder).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def name(self, version: int) -> str:
        return f"{self.folder}/v{version:08d}"

    def newest(self) -> dict | None:
        folder = self.path(self.folder)
        names = [x.getPath().getName() for x in self.fs.listStatus(folder)] if self.fs.exists(folder) else []
        versions = sorted(n for n in names if n.startswith("v") and n.endswith(".json"))
        if not versions:
            return None
        stream = self.fs.open(self.path(f"{self.folder}/{versions[-1]}"))
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()

    def exists(self, version: int) -> bool:
        return self.fs.exists(self.path(self.name(version) + ".json"))

    def publish(self, state: dict) -> dict:
        """Publish state under its `version`; Lost if that is there already."""
        self.fs.mkdirs(self.path(self.folder))
        draft, final = self.path(f"{self.folder}/.draft-{uuid.uuid4().hex}"), self.path(self.name(state["version"]) + ".json")
        out = self.fs.create(draft, False)
        out.write(json.dumps(state).encode())
        out.close()
        try:
            if not self._named(draft, final):
                raise Lost(f"version {state['version']} is taken")
        finally:
            self.fs.delete(draft, False)
        return state

    def _named(self, draft, final) -> bool:
        if final.toUri().getScheme() not in (None, "file"):
            return bool(self.fs.rename(draft, final))
        own = lambda p: self.spark._jvm.java.io.File(p.toUri().getPath()).toPath()
        try:
            self.spark._jvm.java.nio.file.Files.createLink(own(final), own(draft))
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception):
                return False
            raise
        return True

    def remove(self) -> None:
        self.fs.delete(self.path(self.folder), True)
