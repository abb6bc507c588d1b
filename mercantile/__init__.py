"""Customer and revenue analytics for retail orders, written as Spark DataFrame jobs."""
