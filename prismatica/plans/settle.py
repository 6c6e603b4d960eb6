"""Where a table that several later jobs read is kept."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str | None:
    """The folder the cluster names in spark.checkpoint.dir or the context's own, if any."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()


def scratch_folder(spark: SparkSession) -> str:
    """A new folder name under the shared one, or else beside the warehouse. A folder of one
    machine is refused where the executors run on others."""
    base = shared_folder(spark) or spark.conf.get("spark.sql.warehouse.dir")
    if not spark.sparkContext.master.startswith("local") and shared_folder(spark) is None and base.partition(":")[0] in ("file", base):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    tag = spark.sparkContext._jvm.java.util.UUID.randomUUID().toString()
    return f"{base.rstrip('/')}/prismatica-{tag}"


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once: a reliable checkpoint in the shared folder, so a
    lost executor costs a read and not the shuffle behind it. Without such a
    folder it is persisted, and Spark recomputes what gets lost."""
    if shared_folder(df.sparkSession) is not None:
        return df.checkpoint()
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def columnar(df: DataFrame) -> DataFrame:
    """``df`` computed once, for a wide table that many passes read a few columns of: Parquet
    files in the shared folder, of which a pass reads the columns it asks for. Without such a
    folder it is persisted, which keeps columns apart too."""
    if shared_folder(df.sparkSession) is None:
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    path = scratch_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
