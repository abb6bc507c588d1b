"""Build all marts from raw tables and write them.

    python -m mercantile.plans.export RAW_FOLDER OUT_FOLDER [--form csv|parquet] [--raw csv|parquet] [--as-of DATE]
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercantile.operators import products
from mercantile.plans.warehouse import Warehouse
from mercantile.sources.catalog import MartCatalog
from mercantile.sources.marts import write_mart
from mercantile.sources.retail import read_raw_csv, read_raw_parquet
from mercantile.sources.schemas import MART_FILES


def marts(w: Warehouse) -> dict[str, DataFrame]:
    """Marts by name. Those about items need the item, product and seller tables."""
    found = {
        "customer_retention_base": w.retention_base,
        "customer_rfm": w.rfm,
        "rfm_segments": w.rfm,
        "cohort_retention": w.cohort_retention_by_churn,
        "churn_summary": w.churn_summary,
        "monthly_revenue": w.monthly_revenue.orderBy("month"),
        "top_states": products.top_states(w.states),
        "customer_churn": w.churn_features,
    }
    t = w.tables
    if t.order_items is not None and t.products is not None and t.category_translation is not None:
        ranked = products.category_revenue_rank(t.order_items, t.products, t.category_translation)
        found["product_revenue"] = ranked
        found["top_categories"] = w.top_categories.orderBy(F.desc("profit"))
        if t.sellers is not None:
            found["top_sellers"] = w.top_sellers
    return found


def export(w: Warehouse, folder: str, form: str = "parquet") -> list[str]:
    """Write every mart below ``folder`` and return the names written.

    Parquet marts are published by version with a manifest; CSV ones are plain files for other tools.
    """
    written, catalog = marts(w), MartCatalog(w.spark, folder)
    for name, df in written.items():
        if form == "csv":
            write_mart(df, f"{folder.rstrip('/')}/{MART_FILES.get(name, f'{name}.csv')}", form)
        else:
            catalog.publish(name, df)
    return list(written)


def main() -> None:
    parser = argparse.ArgumentParser(description="Build and write all marts.")
    parser.add_argument("raw_folder")
    parser.add_argument("out_folder")
    parser.add_argument("--raw", choices=["csv", "parquet"], default="csv")
    parser.add_argument("--form", choices=["csv", "parquet"], default="parquet")
    parser.add_argument("--as-of", default="2018-06-30")
    args = parser.parse_args()
    spark = SparkSession.builder.appName("mercantile-export").getOrCreate()
    read = read_raw_csv if args.raw == "csv" else read_raw_parquet
    warehouse = Warehouse(spark, read(spark, args.raw_folder), churn_as_of=args.as_of, store_facts=True)
    for name in export(warehouse, args.out_folder, args.form):
        print("written:", name)
    warehouse.scratch.release()


if __name__ == "__main__":
    main()
