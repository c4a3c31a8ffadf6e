"""Materialised statistics: written once, read by the browsing queries."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession

from lexigraph.plans import relational
from lexigraph.session import drop_path, rename_path

# In order of dependence.
STATISTICS = {"cluster_books": "a01_cluster_books", "cluster_stats": "a03_cluster_stats", "domain_stats": "a04_domain_stats", "book_relevance": "a06_relevance"}


def refresh(spark: SparkSession, sf_dir: str, target: str) -> DataFrame:
    """(table, rows, seconds) after writing each statistic below ``target``.

    A table is written beside the old one and takes its place when it is complete.
    """
    out = []
    for name, query in STATISTICS.items():
        began = time.time()
        path, new = f"{target}/{name}.parquet", f"{target}/{name}.parquet.new"
        relational.run(spark, sf_dir, relational.Q[query](relational.SPARK)).write.mode("overwrite").parquet(new)
        drop_path(spark, path)
        rename_path(spark, new, path)
        out.append((name, spark.read.parquet(path).count(), round(time.time() - began, 3)))
    return spark.createDataFrame(out, "table string, rows long, seconds double")
