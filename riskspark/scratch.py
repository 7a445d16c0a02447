"""Where a job may put intermediate tables, and how wide it may spread costly rows."""

import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """A fresh folder below the shared folder that the session names; without one there is no fallback."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return os.path.join(base, f"riskspark-{uuid.uuid4().hex}")


def stored(df: DataFrame) -> DataFrame:
    """Write once to shared storage and read back: cuts lineage, survives executor loss."""
    path = scratch_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def holds_files(spark: SparkSession, folder: str) -> bool:
    """Whether an earlier run stored anything here; errors of reading it are not taken for absence."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def task_count(spark: SparkSession) -> int:
    """Partitions for rows that are small but costly; a fixed count is not packed together at run time."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
