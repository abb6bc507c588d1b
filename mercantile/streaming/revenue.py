"""Revenue per purchase month of arriving payments, kept as deltas by micro-batch.

Each batch folds its payments per order, in tasks first, so an order with very many payments joins as one row. It writes what it adds to
each month under its number; a batch that runs again writes the same in its place. The result is the sum of the deltas,
older ones being folded into one. Neither the driver nor a stream's state holds anything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DecimalType, StructField, StructType

from mercantile.functions.dates import month_of
from mercantile.operators.cleaning import orders_clean
from mercantile.streaming.ledger import BatchLedger, run_batches

_DELTAS = StructType([StructField("month", DateType()), StructField("revenue", DecimalType(38, 2))])


def _summed(deltas: DataFrame) -> DataFrame:
    return deltas.groupBy("month").agg(F.sum("revenue").cast("decimal(38,2)").alias("revenue"))


class RevenueLedger:
    """Revenue of a stream of payments (order_id, payment_value) against a stored table of orders, below ``folder``."""

    def __init__(self, spark: SparkSession, folder: str, orders: DataFrame, fold_after: int = 16):
        self.folder, self.fold_after = folder.rstrip("/"), fold_after
        self.placed = orders_clean(orders).select("order_id", month_of("order_purchase_timestamp").alias("month"))
        self.deltas = BatchLedger(spark, f"{self.folder}/deltas", _DELTAS)

    def run(self, payments: DataFrame) -> None:
        """Take in everything that has arrived since the last run."""
        run_batches(payments, self.take, f"{self.folder}/checkpoint")

    def take(self, payments: DataFrame, batch: int) -> None:
        """One micro-batch."""
        paid = payments.groupBy("order_id").agg(F.sum("payment_value").alias("revenue"))
        self.deltas.write(batch, _summed(paid.join(self.placed, "order_id")))
        # Batches before this one are through, as this one has begun.
        self.deltas.compact(batch, _summed, self.fold_after)

    def monthly(self) -> DataFrame:
        """(month, revenue) of all payments taken in."""
        return _summed(self.deltas.read())
