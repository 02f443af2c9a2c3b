"""Intermediate tables in the shared folder of the cluster.

They stay there, like checkpoints, until the folder of the application is dropped;
those of a stream's batches are written over (``BatchStage``).
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def _checkpoint_dir(spark: SparkSession) -> str:
    """Spark's checkpoint folder, taken from ``spark.checkpoint.dir``.

    A temporary folder stands in only in local mode, where the machine is the cluster.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="lodestar-"))
    return context.getCheckpointDir()


def stage(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into a table of the shared folder and read it from there.

    This cuts the lineage and survives the loss of executors; being columnar, the
    table is read by the columns a plan needs, and its size is known to the planner.
    """
    path = fresh_dir(df.sparkSession, "stage")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class BatchStage:
    """``stage`` for one micro-batch: its tables take the place of those of the batch before the last.

    Whatever a batch keeps is written elsewhere before the next one begins, so two sets of folders, used in turn,
    do for a stream of any length. A batch that runs again writes over its own tables.
    """

    def __init__(self, path: str, batch_id: int):
        self.folder = f"{path}/{batch_id % 2}"
        self.used = 0

    def __call__(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{self.used}"
        self.used += 1
        df.write.mode("overwrite").parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A new folder beside the checkpoints."""
    return f"{_checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"


# Larger tables are never moved for the sake of even work: their files split well enough.
SPREAD_BYTES = 1 << 28


def spread(scan: DataFrame) -> DataFrame:
    """Spread a small table that cannot be split further, such as one Parquet row group, over all cores.

    Spark already splits files by cores and ``spark.sql.files.maxPartitionBytes``.
    """
    size = scan._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    if int(str(size)) > SPREAD_BYTES:
        return scan
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)


def empty(spark: SparkSession, schema: str) -> DataFrame:
    """No rows of the schema, known to be empty when the plan is made."""
    fields = StructType.fromDDL(schema).fields
    return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in fields])
