"""Intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def workdir(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir; where that is unset on a single machine, one is made and set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir is not set: intermediate tables need a folder that all executors share")
        base = tempfile.mkdtemp(prefix="checkpoint-")  # a single machine, as in tests
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system, wherever it lies."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Stages:
    """Intermediate tables written to the shared folder, so that no lost executor takes a result with it.

    ``keep`` writes a DataFrame and returns it read back: the lineage is cut and nothing is computed twice.
    ``drop`` deletes a table as soon as what follows it is written; ``clear`` deletes all that are left. ``compression`` is
    that of the tables, for work that holds many of them at once; without it they have the session's.
    """

    def __init__(self, spark: SparkSession, compression: str | None = None):
        self.spark, self.options = spark, {"compression": compression} if compression else {}
        self.root = f"{workdir(spark)}/{uuid.uuid4().hex}"

    def keep(self, frame: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        frame.write.options(**self.options).parquet(path)
        back = self.spark.read.schema(frame.schema).parquet(path)
        back.kept_at = path
        return back

    def kept(self, frame: DataFrame, name: str, measures: dict[str, Column]) -> tuple[DataFrame, dict]:
        """``keep``, with aggregates over the rows that the job which writes them also gives."""
        seen = Observation()
        back = self.keep(frame.observe(seen, *(value.alias(of) for of, value in measures.items())), name)
        return back, seen.get

    def drop(self, *frames: DataFrame) -> None:
        for frame in frames:
            drop_path(self.spark, frame.kept_at)

    def clear(self) -> None:
        drop_path(self.spark, self.root)
