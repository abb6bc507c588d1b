"""Results of micro-batches in the cluster's shared folder.

A micro-batch may run again after a failure, under the same number and over the same rows. What a batch writes is therefore a folder of
its number, which a second try replaces. A folder counts once its writer has finished it, so a half-written one is
never read. Streams that sum up write deltas; a reader adds them, and older ones are folded into one folder now and then.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_DONE = "_SUCCESS"
_BATCH, _UPTO = "batch=", "upto="


def run_batches(frame: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Hand everything available to ``handle`` batch by batch; a restart continues after the last finished batch."""
    query = (
        frame.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


class BatchLedger:
    """Rows by micro-batch below ``folder``: ``batch=7`` holds what batch 7 wrote, ``upto=6`` the folded batches up to 6."""

    def __init__(self, spark: SparkSession, folder: str, schema: StructType):
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), schema

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _files(self, path):
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _numbers(self, prefix: str) -> list[int]:
        """Numbers of the finished folders of a kind."""
        top = self._path("")
        files = self._files(top)
        if not files.exists(top):
            return []
        names = [s.getPath().getName() for s in files.listStatus(top) if s.isDirectory()]
        own = [n for n in names if n.startswith(prefix) and files.exists(self._path(f"{n}/{_DONE}"))]
        return sorted(int(n[len(prefix) :]) for n in own)

    def write(self, batch: int, rows: DataFrame) -> None:
        """Set the rows of a batch, in place of those of an earlier try."""
        rows.select(*self.schema.names).write.mode("overwrite").parquet(f"{self.folder}/{_BATCH}{batch}")

    def batches(self) -> list[int]:
        """Finished batches that no folded folder holds."""
        folded = max(self._numbers(_UPTO), default=-1)
        return [n for n in self._numbers(_BATCH) if n > folded]

    def _read(self, names: Iterable[str]) -> DataFrame:
        paths = [f"{self.folder}/{n}" for n in names]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def read(self) -> DataFrame:
        """All rows, folded or not."""
        folded = self._numbers(_UPTO)[-1:]
        return self._read([f"{_UPTO}{n}" for n in folded] + [f"{_BATCH}{n}" for n in self.batches()])

    def compact(self, before: int, fold: Callable[[DataFrame], DataFrame], least: int = 16) -> None:
        """Fold the batches before ``before``, which can't run again any more, if there are ``least`` of them or more.

        The new folder is written beside the old ones, which go only when it is finished. A batch that
        lies in both is read from the folded one.
        """
        old = [n for n in self.batches() if n < before]
        if len(old) < least:
            return
        folded = self._numbers(_UPTO)
        rows = fold(self._read([f"{_UPTO}{n}" for n in folded[-1:]] + [f"{_BATCH}{n}" for n in old]))
        rows.select(*self.schema.names).write.mode("overwrite").parquet(f"{self.folder}/{_UPTO}{old[-1]}")
        for name in [f"{_UPTO}{n}" for n in folded] + [f"{_BATCH}{n}" for n in old]:
            path = self._path(name)
            self._files(path).delete(path, True)
