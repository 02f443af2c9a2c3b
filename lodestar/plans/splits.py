"""File scans whose splits stay the same, however many executors there are when they run."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_LEAST = "spark.sql.files.minPartitionNum"
_PREFIX = "spark.sql.files."


def fixed_splits(spark: SparkSession, read: Callable[[SparkSession], DataFrame]) -> DataFrame:
    """``read(session)`` as a DataFrame of ``spark`` whose file splits depend on nothing but the files from now on.

    Spark derives the size of splits from the settings, and by default from the cores at hand, each time a scan
    runs. ``read`` gets a session of its own in which both are fixed; its scan is handed over as a view.
    """
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if key.startswith(_PREFIX) and own.conf.isModifiable(key):
            own.conf.set(key, value)
    if own.conf.get(_LEAST, None) is None:
        own.conf.set(_LEAST, str(max(1, spark.sparkContext.defaultParallelism)))
    name = f"scan_{uuid.uuid4().hex}"
    read(own).createGlobalTempView(name)
    try:
        return spark.table(f"global_temp.{name}")
    finally:
        spark.catalog.dropGlobalTempView(name)
