"""Fixture tables as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: A table with fewer bytes than this for each core is dealt out anew, as it may lie in one row group, which is one task.
SMALL = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a scale-factor folder, read lazily through Spark."""
    path = f"{sf_dir}/{name}.parquet"
    frame = spark.read.parquet(path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    size = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(where).getLength()
    cores = spark.sparkContext.defaultParallelism
    return frame.repartition(cores) if size < SMALL * cores else frame
