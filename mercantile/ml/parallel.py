"""Partitions and settings of model fits, and several at once."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")

#: Partitions of the rows of a fit. Trees are bagged per partition, so a fit depends on this number and on nothing else:
#: not on the files that hold the rows, on their number or on the cluster's cores. More rows make larger partitions; a
#: cluster with more cores than this passes a larger number as ``partitions``, and then gets another, equally good model.
FIT_PARTITIONS = 16

#: Settings of every forest. Rows keep the node that they are in, by tree, so a level moves them one step instead of walking each
#: tree from its root; the trees are the same. Trees are at most ten levels deep, so lost nodes are found again from the cached rows
#: and none are written to the checkpoint folder.
FOREST = {"cacheNodeIds": True, "checkpointInterval": -1}

#: Fits at once. The tasks of one fill the cores that the other leaves idle: at the end of a level, while it picks splits and while its
#: model is written. Each holds its rows and their nodes in memory (about 2 KB a row for 100 trees), so there are no more than two.
FITS_AT_ONCE = 2


def together(spark: SparkSession, jobs: Sequence[Callable[[], T]]) -> list[T]:
    """The results of independent jobs, in their order, ``FITS_AT_ONCE`` of them at a time."""
    with ThreadPoolExecutor(FITS_AT_ONCE) as pool:
        running = [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]
        return [job.result() for job in running]


def spread(df: DataFrame, *keys: str, partitions: int = FIT_PARTITIONS) -> DataFrame:
    """``df`` dealt to a fixed number of partitions by ``keys``, in their order within each."""
    return df.repartition(partitions, *keys).sortWithinPartitions(*keys)
