"""CSV export of history and forecast."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_export(rows: DataFrame, path: str, files: int | None = None) -> None:
    """CSV with header, the rows of a product together and in month order.

    Products are grouped by hash into files rather than given a folder each,
    so the number of files does not grow with the number of products.
    """
    spread = rows.repartition(files, "Product_ID") if files else rows.repartition("Product_ID")
    spread.sortWithinPartitions("Product_ID", "Month").write.mode("overwrite").csv(path, header=True)


def write_export_by_product(rows: DataFrame, path: str) -> None:
    """One folder per product, for exports of a chosen few."""
    (
        rows.repartition("Product_ID")
        .sortWithinPartitions("Product_ID", "Month")
        .write.mode("overwrite")
        .partitionBy("Product_ID")
        .csv(path, header=True)
    )
