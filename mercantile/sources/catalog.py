"""Marts published by version, with a manifest that says what a version holds.

A version is a folder of its own. Only when it is whole does the mart's manifest point to it, by one atomic rename; readers see
the old version or the new one, and a half-written one not at all. The manifest holds schema, rows, a checksum that
does not depend on the rows' order, and the files with their sizes. A mart exists if it has a manifest: whatever else goes
wrong while reading is an error and not a missing mart.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from mercantile.functions.fingerprint import fingerprint

_MANIFEST = "_manifest.json"


class BrokenMart(ValueError):
    """A mart's files are not those that its manifest names."""


class MartCatalog:
    """Marts below a folder of the shared file system."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs

    def _path(self, *parts: str):
        return self._hadoop.Path("/".join([self.folder, *parts]))

    def _files(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def names(self) -> list[str]:
        """Marts that have been published."""
        files = self._files()
        if not files.exists(self._path()):
            return []
        found = [s.getPath().getName() for s in files.listStatus(self._path()) if s.isDirectory()]
        return sorted(n for n in found if files.exists(self._path(n, _MANIFEST)))

    def manifest(self, name: str) -> dict[str, Any]:
        path = self._path(name, _MANIFEST)
        if not self._files().exists(path):
            raise FileNotFoundError(f"no mart {name} in {self.folder}")
        # A small file: one object, read whole.
        return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(self._files().open(path), "UTF-8"))

    def _sizes(self, name: str, version: str) -> dict[str, int]:
        """Data files of a version with their sizes."""
        top = self._path(name, version)
        if not self._files().exists(top):
            return {}
        listed, sizes = self._files().listFiles(top, True), {}
        while listed.hasNext():
            found = listed.next()
            file = found.getPath().toString().split(f"/{version}/", 1)[1]
            if not file.rsplit("/", 1)[-1].startswith(("_", ".")):
                sizes[file] = found.getLen()
        return sizes

    def _switch(self, name: str, manifest: dict[str, Any]) -> None:
        """Put the manifest in place of the old one in one step."""
        draft = self._path(name, f"{_MANIFEST}.{uuid.uuid4().hex}")
        out = self._files().create(draft)
        out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        out.close()
        rename = getattr(self._hadoop, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        context = self._hadoop.FileContext.getFileContext(draft.toUri(), self.spark._jsc.hadoopConfiguration())
        context.rename(draft, self._path(name, _MANIFEST), options)

    def publish(self, name: str, df: DataFrame, partition_by: Iterable[str] = ()) -> dict[str, Any]:
        """Write a version and switch to it. Versions before the last one are deleted; readers of that may still be at work."""
        version = f"version-{uuid.uuid4().hex}"
        df.write.partitionBy(*partition_by).parquet(self._path(name, version).toString())
        written = self._read(name, version, df.schema)
        manifest = {
            "version": version,
            "schema": df.schema.jsonValue(),
            "checksum": fingerprint(written, df.columns),
            "files": self._sizes(name, version),
        }
        manifest["rows"] = int(manifest["checksum"].split("-")[0])
        before = self.manifest(name)["version"] if self._files().exists(self._path(name, _MANIFEST)) else None
        self._switch(name, manifest)
        for old in self._files().listStatus(self._path(name)):
            if old.isDirectory() and old.getPath().getName() not in (version, before):
                self._files().delete(old.getPath(), True)
        return manifest

    def _read(self, name: str, version: str, schema: StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self._path(name, version).toString()).select(*schema.names)

    def read(self, name: str) -> DataFrame:
        """The published version. Files that are missing or of another size are an error; see ``verify`` for their content."""
        manifest = self.manifest(name)
        found = self._sizes(name, manifest["version"])
        if found != manifest["files"]:
            wrong = sorted(f for f in {*found, *manifest["files"]} if found.get(f) != manifest["files"].get(f))
            raise BrokenMart(f"{name}: {', '.join(wrong[:3])}{' and more' * (len(wrong) > 3)} not as published")
        return self._read(name, manifest["version"], StructType.fromJson(manifest["schema"]))

    def verify(self, name: str) -> None:
        """Read the whole mart and compare it with its checksum."""
        df = self.read(name)
        if fingerprint(df, df.columns) != self.manifest(name)["checksum"]:
            raise BrokenMart(f"{name}: rows not as published")
