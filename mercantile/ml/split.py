"""Train and test splits that give the same rows on any cluster layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mercantile.operators.ordering import add_positions, split_at_position
from mercantile.sources.scratch import Scratch


def shuffled_key(key: str, seed: int) -> Column:
    """A pseudo-random sort key that any engine can reproduce."""
    return F.md5(F.concat(F.lit(f"{seed}-"), F.col(key).cast("string")))


def by_recency(df: DataFrame, key: str, scratch: Scratch, test_share: float = 0.2) -> DataFrame:
    """Most recent customers train, the longest absent test."""
    return split_at_position(
        df,
        F.col("recency_days"),
        key,
        lambda n: int(n * (1 - test_share)),
        scratch,
        bucket=lambda days: F.floor(days / 32),
    )


def stratified(
    df: DataFrame, key: str, label: str, scratch: Scratch, test_share: float = 0.2, seed: int = 42
) -> DataFrame:
    """The same share of every class tests, chosen by a seeded hash of the key."""
    return split_at_position(
        df,
        shuffled_key(key, seed),
        key,
        lambda n: int(n * test_share + 0.5),
        scratch,
        names=("test", "train"),
        within=label,
        key_type="string",
        bucket=lambda digits: F.substring(digits, 1, 3),
    )


def with_fold(df: DataFrame, key: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """Adds ``fold`` from a seeded hash of the key. The class is not looked at, so a fold may lack a rare one."""
    digits = F.conv(F.substring(shuffled_key(key, seed), 1, 8), 16, 10).cast("long")
    return df.withColumn("fold", (digits % folds).cast("int"))


def stratified_folds(df: DataFrame, key: str, label: str, scratch: Scratch, folds: int = 5, seed: int = 42) -> DataFrame:
    """Adds ``fold``: rows of each class are dealt in turn, in the order of a seeded hash of the key.

    So every fold has the same share of every class, but for one row.
    """
    placed = add_positions(df, shuffled_key(key, seed), key, scratch, within=label)
    return placed.withColumn("fold", (F.col("position") % folds).cast("int")).drop("position")
