"""Fitted models in the cluster's shared folder, found again by what they were fitted on.

A model's name is a fingerprint of its training rows, columns and settings. A later query with the same rows loads
it instead of fitting again. The fingerprint adds hashes of rows, so it depends on neither their order nor their files.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from mercantile.functions.fingerprint import fingerprint
from mercantile.sources.scratch import shared_root


class ModelStore:
    """Models below ``folder``; None for a folder in the shared one."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        self.folder = (folder or f"{shared_root(spark)}/mercantile-models").rstrip("/")

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(name)

    def fitted(
        self, kind: str, rows: DataFrame, columns: Sequence[str], settings: dict[str, Any], fit: Callable[[], PipelineModel]
    ) -> PipelineModel:
        """The stored model for these rows, columns and settings, else ``fit()``, which is then stored.

        A model is written aside and moved to its name when it is whole, so a half-written one is never loaded. If two
        jobs fit the same model at once, one of the equal copies stays.
        """
        known = [fingerprint(rows, columns), list(columns), settings, self.spark.version]
        name = hashlib.sha256(json.dumps(known, sort_keys=True).encode()).hexdigest()[:32]
        path = self._path(f"{self.folder}/{kind}-{name}")
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if files.exists(path):
            return PipelineModel.load(path.toString())
        model = fit()
        draft = self._path(f"{path.toString()}.{uuid.uuid4().hex}")
        model.write().save(draft.toString())
        if files.exists(path) or not files.rename(draft, path):
            files.delete(draft, True)
        return model
