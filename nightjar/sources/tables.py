"""Driver-table access.

Each table is one parquet file (or folder) under ``sf_dir``. Reading through
``spark.read.parquet`` keeps projection and predicate pushdown in Catalyst's
hands: operators only ``select``/``filter`` and the scan prunes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from nightjar.session import share_package

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    share_package(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
